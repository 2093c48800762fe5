"""Variant spellings of names typed by people (problem 4).

A name is read into a rare core word (surname, firm, place or product line) and
what stands around it (given name, line of business, model number). Cores are
joined by metric-space partitioning: each core goes to its nearest pivot, and to
every other pivot no more than twice the radius farther, so by the triangle
inequality any two cores within the radius of each other meet in the home cell of
either. The metric is the unrestricted Damerau-Levenshtein distance, a true
metric in which a transposition is one edit. In a cell the radius join is exact.

Cores that meet form a block; in a block the rest of the names decides: persons by
given name (nickname, initial or abbreviation), firms by line of business, devices
by model number. The words that are common (given names, lines of business) are
learned by counts over all names, and so are short forms of given names, from
descriptions and aliases that names share. Up to ``MOST_HELD`` words every task holds
them all; beyond, each name is joined with those that one of its words may be.

Defined results: null and blank names take no part; ids repeated count once; a
name without any rare word links only to equal words; of several entities that fit
a name without distinguishing words (a bare surname initial or firm name), the one
with the same description is taken, or the only one, else none.

Aliases are further spellings of their entity and go through the same cells: the
entity an alias names is united with that of its holder. An alias several other
entities claim ("the company", an initial) decides nothing, nor does one that fits
several entities.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.components import connected_components, pairs_of_groups
from siftline.sources.shared import materialize

# Forms of address, legal forms and words that name no entity.
TITLES = frozenset("mr mrs ms miss dr prof eng capt herr frau sir sr sra".split())
LEGAL = frozenset("ltd limited plc ab aktiebolag llc inc incorporated gmbh gesellschaft mbh co corp corporation company group holding holdings ag sa se nv bv kg oy as spa".split())
FILLER = frozenset("of the and de la du no model site direct".split())
#: Words of a vocabulary that each task may hold.
MOST_HELD = 60_000


def fold(s: str) -> str:
    """Case and accents folded."""
    s = unicodedata.normalize("NFKD", s.casefold())
    return "".join(c for c in s if not unicodedata.combining(c)).replace("ø", "o").replace("ß", "ss").replace("æ", "ae")


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2)] + [[far, *([0] * (len(b) + 1))] for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        at = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), at
            if x == y:
                at = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


def damerau_many(pivot: str, names: list[str]) -> np.ndarray:
    """Distances of one pivot to many names, one numpy step for each cell of the table."""
    n, la, lb = len(names), len(pivot), max([1, *map(len, names)])
    codes = np.zeros((n, lb), np.int32)
    for r, s in enumerate(names):
        codes[r, : len(s)] = [ord(c) for c in s]
    lengths = np.array([len(s) for s in names])
    far = la + lb
    d = np.full((n, la + 2, lb + 2), far, np.int16)
    d[:, 1, 1:] = np.arange(lb + 1)
    d[:, 1:, 1] = np.arange(la + 1)
    rows = np.arange(n)
    last: dict[int, int] = {}
    for i in range(1, la + 1):
        x = ord(pivot[i - 1])
        at = np.zeros(n, np.int64)
        for j in range(1, lb + 1):
            y = codes[:, j - 1]
            k = np.zeros(n, np.int64)
            for c, row in last.items():
                k[y == c] = row
            same = y == x
            swap = d[rows, k, at] + (i - k - 1) + 1 + (j - at - 1)
            best = np.minimum(np.minimum(d[:, i, j] + ~same, d[:, i + 1, j] + 1), d[:, i, j + 1] + 1)
            d[:, i + 1, j + 1] = np.minimum(best, swap)
            at[same] = j
        last[x] = i
    return d[rows, la + 1, lengths + 1]


def within_one(a: str, b: str) -> bool:
    return abs(len(a) - len(b)) <= 1 and damerau(a, b) <= 1


# --- reading a name ---------------------------------------------------------


def words_of(name: str) -> list[str]:
    """Words with joined forms taken apart at capitals and digits; parentheses dropped."""
    s = re.sub(r"\([^)]*\)", " ", unicodedata.normalize("NFC", name))
    s = re.sub(r"\b(G?)mbH\b", r"\1mbh", s)
    s = re.sub(r"(?<=\w)-(?=[a-zà-ÿ]{2,})", "", s)  # a word broken by a hyphen
    if not s.isupper():
        s = re.sub(r"(?<=[a-zà-ÿ])(?=[A-Z])", " ", s)
    s = re.sub(r"(?<=[^\W\d])(?=\d)", " ", s)
    s = re.sub(r"\b(?:[A-Za-z]\.){2,}", lambda m: m.group().replace(".", ""), s)
    return [fold(w) for w in re.findall(r"\w+", s)]


class Vocabulary:
    def __init__(self, given: list[str], common: list[str], short: dict[str, str] | None = None):
        self.short = short or {}  # full forms of short given names
        self.given = {fold(g) for g in given} | {*self.short, *self.short.values()}
        self.common = ({fold(c) for c in common} | LEGAL | FILLER | TITLES) - self.given
        self.all = self.given | self.common
        self.longest = sorted(self.all, key=lambda w: (-len(w), w))
        self.long = defaultdict(list)
        for w in self.all:
            if len(w) >= (4 if w in self.given else 5):
                for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                    self.long[k].append(w)

    def known(self, w: str) -> str | None:
        """The common word that ``w`` is, or is one edit from."""
        if w in self.all:
            return w
        if len(w) < 4:
            return None
        near = {x for k in (w, *(w[:i] + w[i + 1 :] for i in range(len(w)))) for x in self.long.get(k, ()) if within_one(w, x)}
        return min(near) if near else None

    def take_apart(self, w: str) -> list[str]:
        for other in self.longest:
            if len(other) >= 4 and len(w) - len(other) >= 5:
                if w.endswith(other):
                    return [w[: -len(other)], other]
                if w.startswith(other) and other in self.given:
                    return [other, w[len(other) :]]
        return [w]


def lookups(name: str) -> set[str]:
    """Keys of which one is among ``found_by`` of every word of a vocabulary that reading the name may come upon."""
    words = words_of(name)
    keys = {k for w in words for k in (w, *(w[:i] + w[i + 1 :] for i in range(len(w))))}
    if len(words) == 1:  # may be taken apart
        keys |= {words[0][:i] for i in range(4, len(words[0]))} | {words[0][i:] for i in range(len(words[0]) - 3)}
    return keys


def found_by(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def read_name(name: str, vocabulary: Vocabulary) -> tuple[str, str, str, str]:
    """(core, given, line, number): what distinguishes an entity of that core."""
    given, line, number, rare, letters = [], [], [], [], []
    abbreviated = bool(re.match(r"^\s*\w{2,5}\.\s", name)) and fold(re.match(r"^\s*(\w+)", name).group(1)) not in TITLES
    words = words_of(name)
    for pos, w in enumerate(words):
        if w.isdigit():
            number.append(w)
        elif len(w) == 1:
            letters.append(w)
        elif pos == 0 and abbreviated and w not in vocabulary.given:
            given.append(w)
        else:
            k = vocabulary.known(w)
            if k is None and len(w) >= 9 and len(words) == 1:
                parts = vocabulary.take_apart(w)
                if len(parts) == 2:
                    for p in parts:
                        (given if p in vocabulary.given else line if p in vocabulary.common else rare).append(p)
                    continue
            if k is None:
                rare.append(w)
            elif k in vocabulary.given:
                given.append(k)
            elif k not in TITLES:
                line.append(k)
    core = max(rare, key=len) if rare else ""
    short = [w for w in rare if w != core and (len(w) <= 4 or not number)]
    if not core and (given or line):  # a common word may be the name itself
        core, pool = (given.pop(), given) if given else (max(line, key=len), line)
    line = [w for i, w in enumerate(line) if w not in FILLER and w != core and (w not in LEGAL or (w == "company" and i and line[i - 1] not in LEGAL | FILLER))] + ([w for w in short if not given] if not number else [])
    if number:
        return core, "", "", "".join(letters[-1:]) + "".join(number)
    given = [vocabulary.short.get(g, g) for g in given]
    return core, (given[0] if given else letters[0] if letters and not line else ""), " ".join(line), ""


def abbreviates(short: str, full: str) -> bool:
    """``short`` starts as ``full`` does and its letters occur there in order."""
    if not short or not full or short[0] != full[0] or len(short) >= len(full):
        return False
    it = iter(full)
    return all(c in it for c in short)


def lines_agree(a: str, b: str) -> bool:
    """Lines of business: equal, abbreviated word by word, initials, or one a part of the other."""
    if a == b:
        return True
    x, y = a.split(), b.split()
    if len(x) > len(y):
        x, y = y, x
    if len(x) == 1 and len(y) > 1 and x[0] == "".join(w[0] for w in y):
        return True
    used: set[int] = set()
    for w in x:
        hit = next((i for i, v in enumerate(y) if i not in used and (w == v or abbreviates(w, v) or abbreviates(v, w))), None)
        if hit is None:
            return False
        used.add(hit)
    return True


def given_agree(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) <= 4 and (a.startswith(b) or b.startswith(a)))


def resolve_block(rows: list[tuple]) -> list[int]:
    """Entity number of each (given, line, number, description) within one block of cores."""
    group: dict[tuple, int] = {}
    out = [-1] * len(rows)
    kinds = []
    for g, l, n, desc in rows:
        kinds.append("device" if n else "person" if g else "firm" if l else "bare")
    # complete names first: each complete form is an entity, short forms join one of them
    complete: list[tuple[str, str, int]] = []
    described: dict[int, Counter] = defaultdict(Counter)
    order = sorted(range(len(rows)), key=lambda i: (kinds[i] == "person" and len(rows[i][0]) == 1, -len(rows[i][0]), -len(rows[i][1]), rows[i][1]))
    for i in order:
        g, l, n, desc = rows[i]
        kind = kinds[i]
        if kind == "bare":
            continue
        key = (kind, n) if kind == "device" else (kind, g) if kind == "person" else (kind, l)
        if key not in group:
            fits = []
            if kind == "person" and len(g) <= 4:
                fits = [e for k, v, e in complete if k == kind and len(v) > len(g) and given_agree(g, v)]
                fits = fits or [e for k, v, e in complete if k == "firm" and g == "".join(w[0] for w in v.split())]
            elif kind == "firm":
                fits = [e for k, v, e in complete if k == kind and lines_agree(l, v)]
            fits = list(dict.fromkeys(fits))
            if len(fits) > 1 and desc:
                fits = [e for e in fits if described[e][desc]] or fits
            if len(fits) == 1:
                group[key] = fits[0]
            else:
                group[key] = len(set(group.values())) and max(group.values()) + 1
                complete.append((kind, key[1], group[key]))
        out[i] = group[key]
        if desc:
            described[out[i]][desc] += 1
    n_found = 1 + max([-1, *out])
    for i, kind in enumerate(kinds):
        if kind != "bare":
            continue
        desc = rows[i][3]
        entities = list(dict.fromkeys(e for k, _, e in complete if k != "device")) or ["own"]
        fits = [e for e in entities if e != "own" and desc and described[e][desc]] or entities
        if len(fits) == 1 and fits[0] != "own":
            out[i] = fits[0]
        elif fits == ["own"]:
            out[i] = n_found  # all bare names of a block are one entity
    return out


# --- Spark ------------------------------------------------------------------


def common_table(names: DataFrame, *, least: int = 4) -> DataFrame:
    """(word): words that follow several first words in names of firms, places and products."""
    w = F.transform(F.regexp_extract_all(F.col("name"), F.lit(r"([\p{L}\p{M}]+)"), 1), lambda x: F.lower(x))
    pairs = names.where(~F.col("person")).select(w.alias("w")).where(F.size("w") > 1).select(F.col("w")[0].alias("first"), F.explode(F.slice("w", 2, F.size("w"))).alias("word"))
    return pairs.where((F.length("word") > 1) & (F.col("word") != F.col("first"))).groupBy("word").agg(F.approx_count_distinct("first").alias("n")).where(F.col("n") >= least).select("word")


def vocabulary_table(given: DataFrame, common: DataFrame, short: DataFrame | None = None) -> DataFrame:
    """(word, given, common, full): ``given``: g; ``common``: word; ``short``: a, full, where known."""

    def folded(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(word=[fold(w) for w in pdf["word"]])

    none = F.lit(None).cast("string")
    every = given.select(F.col("g").alias("word"), F.lit(True).alias("given"), F.lit(False).alias("common"), none.alias("full"))
    every = every.unionByName(common.select("word", F.lit(False).alias("given"), F.lit(True).alias("common"), none.alias("full")))
    if short is not None:
        row = lambda c, full: short.select(F.col(c).alias("word"), F.lit(True).alias("given"), F.lit(False).alias("common"), full.alias("full"))
        every = every.unionByName(row("a", F.col("full"))).unionByName(row("full", none))
    columns = "word string, given boolean, common boolean, full string"
    return materialize(every.mapInPandas(folded, columns).groupBy("word").agg(F.max("given").alias("given"), F.max("common").alias("common"), F.max("full").alias("full")), "vocabulary")


def _vocabulary(rows: Iterable) -> Vocabulary:
    """Of rows (word, given, common, full)."""
    rows = list(rows)
    return Vocabulary([r["word"] for r in rows if r["given"]], [r["word"] for r in rows if r["common"]], {r["word"]: r["full"] for r in rows if r["full"]})


def with_vocabulary(names: DataFrame, spelt: Column, vocabulary: DataFrame, most_held: int) -> tuple[DataFrame, Callable[[pd.DataFrame], Vocabulary]]:
    """(names, what gives the vocabulary of a batch of them). ``spelt``: array of the names in a row.

    A vocabulary above ``most_held`` words is joined: names have ``known`` then, all
    words that one of theirs is, is one edit from, or begins or ends with.
    """
    if vocabulary.count() <= most_held:
        held = [r.asDict() for r in vocabulary.collect()]
        made: list[Vocabulary] = []
        return names, lambda _: made[0] if made else made.append(_vocabulary(held)) or made[0]

    def keys(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([(h, k) for h, ns in zip(pdf["_h"], pdf["ns"]) for k in {k for n in ns if n for k in lookups(n)}], columns=["_h", "key"])

    def words(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.loc[pdf.index.repeat([len(found_by(w)) for w in pdf["word"]])].assign(key=[k for w in pdf["word"] for k in found_by(w)])

    h = F.sha2(F.to_json(F.struct(spelt.alias("ns"))), 256)
    asked = names.select(h.alias("_h"), spelt.alias("ns")).distinct().mapInPandas(keys, "_h string, key string")
    fields = "word string, given boolean, common boolean, full string"
    known = asked.join(vocabulary.mapInPandas(words, f"{fields}, key string"), "key").groupBy("_h").agg(F.collect_set(F.struct("word", "given", "common", "full")).alias("known"))
    joined = names.withColumn("_h", h).join(known, "_h", "left").drop("_h")
    return joined, lambda pdf: _vocabulary({r["word"]: r for rs in pdf["known"] if rs is not None for r in rs}.values())


def short_form_table(names: DataFrame, vocabulary: DataFrame, *, least: int = 2, share: float = 0.3, few: int = 6, most_held: int = MOST_HELD) -> DataFrame:
    """(a, full): short and full forms of given names, from rows of (name, description, aliases).

    Two given names are seen together where names of one core have the same description,
    or one is an alias of the other. The rarer is a short form of the other if that
    happens with ``least`` cores and with ``share`` of the cores it is seen with. Where
    more than ``few`` given names of a core have one description, each two of them count
    for less: (few - 1) / (names - 1). All rows, groups and pairs count. Beginnings of up
    to four letters need no learning.
    """
    spelt = names.where(F.trim("name") != "").select("name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).distinct()
    spelt, vocabulary_of = with_vocabulary(spelt, F.concat(F.array("name"), "aliases"), vocabulary, most_held)

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            v = vocabulary_of(pdf)
            rows = []
            for name, description, aliases in zip(pdf["name"], pdf["description"], pdf["aliases"]):
                core, g, *_ = read_name(name, v)
                if len(g) < 2 or not core:
                    continue
                if description:
                    rows.append((core, description, g))
                for other in aliases:
                    c, o, *_ = read_name(other or "", v)
                    if c == core and len(o) > 1 and o != g:
                        rows += [(core, "\x00" + "\x00".join(sorted((g, o))), x) for x in (g, o)]
            yield pd.DataFrame(rows, columns=["core", "about", "given"])

    seen = materialize(spelt.mapInPandas(read, "core string, about string, given string").distinct(), "seen")
    use = seen.groupBy("given").agg(F.countDistinct("core").alias("cores"))
    size = seen.groupBy("core", "about").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    met = seen.join(size, ["core", "about"]).withColumn("weight", F.least(F.lit(1.0), (few - 1) / (F.col("m") - 1)))
    # a pair that is met only where each meeting counts for less than ``share`` can't reach it: candidates come from smaller groups
    small = met.where(F.col("weight") >= share)
    pairs = small.select("core", "about", F.col("given").alias("a")).join(small.select("core", "about", F.col("given").alias("b"), "weight"), ["core", "about"]).where(F.col("a") != F.col("b")).select("core", "a", "b", "weight")
    large = met.where(F.col("weight") < share)
    more = large.select("core", "about", F.col("given").alias("a")).join(pairs.select("a", "b").distinct(), "a").join(large.select("core", "about", F.col("given").alias("b"), "weight"), ["core", "about", "b"]).select("core", "a", "b", "weight")
    counted = pairs.unionByName(more).groupBy("a", "b", "core").agg(F.max("weight").alias("weight")).groupBy("a", "b").agg(F.sum("weight").alias("n")).where(F.col("n") >= least - 1e-9)
    full = counted.join(use.toDF("a", "use_a"), "a").join(use.toDF("b", "use_b"), "b").where((F.col("use_b") > F.col("use_a")) & (F.col("n") >= share * F.col("use_a") - 1e-9))
    full = full.where(~((F.length("a") <= 4) & F.expr("startswith(b, a)")))
    best = materialize(full.groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), -F.col("use_b"), "b")).alias("b")), "short")
    return best.join(best.toDF("b", "further"), "b", "left").select("a", F.coalesce("further", "b").alias("full"))


def _as_table(spark: SparkSession, given: Iterable[str], common: Iterable[str], short: dict[str, str] | None = None) -> DataFrame:
    rows = [*((g, True, False, None) for g in given), *((c, False, True, None) for c in common)]
    rows += [(w, True, False, full) for a, b in (short or {}).items() for w, full in ((a, b), (b, None))]
    t = spark.createDataFrame(rows, "word string, given boolean, common boolean, full string")
    return vocabulary_table(t.where("given").select(F.col("word").alias("g")), t.where("common").select("word"), t.where("full is not null").select(F.col("word").alias("a"), "full"))


def learn_short_forms(names: DataFrame, given: list[str], common: list[str], **limits) -> dict[str, str]:
    """``short_form_table`` as {short form: full form}, for vocabularies known to be small."""
    return {r["a"]: r["full"] for r in short_form_table(names, _as_table(names.sparkSession, given, common), **limits).collect()}


def core_links(cores: DataFrame, *, radius: int = 1, pivots_a_root: float = 0.15, most_pivots: int = 512) -> DataFrame:
    """Pairs (a, b) of distinct ``core`` within the radius, by pivot cells."""
    n = cores.count()
    m = int(max(1, min(most_pivots, pivots_a_root * n**0.5)))
    pivots = [r["core"] for r in cores.orderBy(F.xxhash64("core"), "core").limit(m).collect()]

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            names = list(pdf["core"])
            d = np.stack([damerau_many(p, names) for p in pivots], axis=1)
            near = d.min(axis=1, keepdims=True)
            who, cell = np.nonzero(d <= near + 2 * radius)
            home = d.argmin(axis=1)
            yield pd.DataFrame({"cell": cell.astype("int32"), "home": home[who] == cell, "core": [names[i] for i in who]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        names = list(pdf["core"])
        home = dict(zip(names, pdf["home"]))
        index: dict[str, list[str]] = defaultdict(list)
        out = set()
        for s in names:
            keys = {s}
            for _ in range(radius):
                keys |= {k[:i] + k[i + 1 :] for k in keys for i in range(len(k))}
            for k in keys:
                for t in index[k]:
                    pair = (s, t) if s < t else (t, s)
                    if pair not in out and (home[s] or home[t]) and damerau(s, t) <= radius:
                        out.add(pair)
                index[k].append(s)
        return pd.DataFrame(sorted(out), columns=["a", "b"])

    cells = cores.repartition(max(2, n // 5000)).mapInPandas(place, "cell int, home boolean, core string")
    return cells.groupBy("cell").applyInPandas(lambda _, pdf: join(pdf), "a string, b string").distinct()


def alias_numbers(forms: list[tuple], number: dict[tuple, int], aliases: list[tuple]) -> dict[tuple, str]:
    """Entity number (as text) of each form of an alias in a block, ``~`` before it if no name has it; forms that fit several are left out."""
    every = list(dict.fromkeys([*forms, *aliases]))
    joint = dict(zip(every, resolve_block(every)))
    reached: dict[int, set[int]] = defaultdict(set)
    for form in forms:
        reached[joint[form]].add(number[form])
    out = {}
    for form in aliases:
        found = {number[form]} if form in number else reached[joint[form]]
        if joint[form] >= 0 and -1 not in found and len(found) <= 1:
            out[form] = str(min(found)) if found else f"~{joint[form]}"
    return out


def link_names(names: DataFrame, given: list[str], common: list[str], short: dict[str, str] | None = None) -> DataFrame:
    """``link_entities`` with a vocabulary given as lists."""
    return link_entities(names, _as_table(names.sparkSession, given, common, short))


def link_entities(names: DataFrame, vocabulary: DataFrame, *, most_held: int = MOST_HELD) -> DataFrame:
    """(id, entity) of every usable row of ``names`` (id, name, description and, where known, aliases); ``vocabulary`` as of ``vocabulary_table``."""
    columns = ["id", "core", "given", "line", "number", "description", "spelling", "alias"]

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            v = vocabulary_of(pdf)
            rows = [(i, *read_name(s, v), d, " ".join(words_of(s)), a) for i, s, d, a in zip(pdf["id"], pdf["name"], pdf["description"], pdf["alias"])]
            yield pd.DataFrame(rows, columns=columns)

    description = F.coalesce("description", F.lit("")).alias("description")
    usable = names.where(F.trim("name") != "").select("id", "name", description, F.lit(False).alias("alias")).dropDuplicates(["id"])
    if "aliases" in names.columns:
        held = names.where(F.trim("name") != "").select("id", F.explode("aliases").alias("name"), description, F.lit(True).alias("alias"))
        usable = usable.unionByName(held.where(F.trim("name") != "").dropDuplicates(["id", "name"]))
    usable, vocabulary_of = with_vocabulary(usable, F.array("name"), vocabulary, most_held)
    parsed = materialize(usable.mapInPandas(read, "id string, core string, given string, line string, number string, description string, spelling string, alias boolean").where(F.col("core") != ""), "names")
    links = core_links(parsed.select("core").distinct())
    typed = parsed.where(~F.col("alias")).select("core").distinct()
    if "aliases" in names.columns:  # blocks are made of names; an alias core takes the block of the names it meets, if there is one
        links = materialize(links, "links")
        both = links.join(typed.withColumnRenamed("core", "a"), "a", "left_semi").join(typed.withColumnRenamed("core", "b"), "b", "left_semi")
        blocks = connected_components(both).withColumnRenamed("node", "core").withColumnRenamed("component", "block")
        blocks = typed.join(blocks, "core", "left").select("core", F.coalesce("block", "core").alias("block"))
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met = ends.join(typed.withColumnRenamed("core", "a"), "a", "left_anti").join(blocks.withColumnRenamed("core", "b"), "b").groupBy(F.col("a").alias("core")).agg(F.min("block").alias("block"), F.max("block").alias("last"))
        blocks = blocks.unionByName(met.select("core", F.when(F.col("block") == F.col("last"), F.col("block")).alias("block")))
    else:
        blocks = connected_components(links).withColumnRenamed("node", "core").withColumnRenamed("component", "block")
    placed = parsed.join(blocks, "core", "left").withColumn("block", F.coalesce("block", "core"))

    def resolve(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def solve(rows: list[tuple]) -> list[tuple]:
            own, others = [r for r in rows if not r[6]], [r for r in rows if r[6]]
            forms = list(dict.fromkeys(r[1:5] for r in own))
            number = dict(zip(forms, resolve_block(forms)))
            out, spelt = [], defaultdict(set)
            for r in own:
                b, first, n = r[0], r[7], r[8]
                k = number[r[1:5]]
                spelt[r[5]].update((f"{b}#{k}",) if k >= 0 else (f"{b}#{first}", *("",) * (n > 1)))
                out.append((*r[:7], f"{b}#{k}" if k >= 0 else None))
            reached = alias_numbers(forms, number, [r[1:5] for r in others]) if others else {}
            for r in others:
                if len(same := spelt.get(r[5], ())) == 1:
                    out.append((*r[:7], *same))
                elif not same and (k := reached.get(r[1:5])) is not None:
                    out.append((*r[:7], f"{r[0]}#{k}"))
            return out

        for pdf in it:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    out += solve(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=[*form, "entity"])
        if held:
            yield pd.DataFrame(solve(held), columns=[*form, "entity"])

    # a block holds each way of writing once, however many rows write so
    form = ["block", "given", "line", "number", "description", "spelling", "alias"]
    forms = placed.groupBy(*form).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    tasks = max(2, parsed.count() // 10_000)
    decided = forms.repartition(tasks, "block").sortWithinPartitions("block", "id").mapInPandas(resolve, "block string, given string, line string, number string, description string, spelling string, alias boolean, entity string")
    own = F.coalesce("entity", F.concat_ws("#", "block", "id"))  # a bare name nothing decides stays alone
    found = materialize(placed.join(materialize(decided, "forms"), form).select("id", own.alias("entity"), "alias"), "entities")
    linked = found.where(~F.col("alias")).select("id", "entity")
    if "aliases" not in names.columns:
        return linked
    claims = linked.join(found.where("alias").select("id", F.col("entity").alias("named")), "id").where(F.col("entity") != F.col("named"))
    edges = claims.groupBy("named").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).where(F.col("a") == F.col("b"))  # an alias of several entities decides nothing
    united = connected_components(edges.select("a", F.col("named").alias("b"))).withColumnRenamed("node", "entity")
    return materialize(linked.join(united, "entity", "left").select("id", F.coalesce("component", "entity").alias("entity")), "united")


def name_pairs(linked: DataFrame) -> DataFrame:
    return pairs_of_groups(linked, ["entity"], "id").select("id_a", "id_b")
