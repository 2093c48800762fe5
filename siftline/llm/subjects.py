"""Subject areas of documents (problem 9).

Documents are embedded by term weighting and truncated singular value
decomposition; sentences are projected into the same space. Centroids start from
labelled documents (some for each subject and language, two for each where labels
allow, since a subject may hold fields that share no words), every sentence goes to
the most similar centroid, and centroids are taken anew from the sentences that are
clearly theirs. A document deals with a subject if its share of sentences does.

Term weights: the least idf over the language groups, so a word common in any
language weighs little, times how far the subjects of the texts around a term
differ from those of the language as a whole; firm names, notices and sentence
patterns, which stand beside every subject, lose their weight. That measure comes
from labels first, then from all documents, a sentence's own assignment left out.

Counts, weights, decomposition and centroids cover all documents. Labels are read
up to ``most_labels`` documents (by hash), the vocabulary up to ``most_terms``
terms of each language group (by number of texts); both bounds are parameters.
Rare languages are one group, so their terms have a place too.

Defined results: null, empty and blank texts and texts without a clear sentence
have no subject; less than ``share`` of the sentences is a passing mention; a lone sentence
among more than three must be clearly of its subject (``lone_similarity``);
repeated texts count each; an id repeated counts once; without
labels there is no result; subjects need not be known beforehand.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.llm.blocks import SCHEMA, block_rows, n_tasks, sum_blocks
from siftline.llm.near_duplicates import _arrow
from siftline.llm.terms import WORD
from siftline.sources.shared import materialize

ABBREVIATION = re.compile(r"\b(mr|ms|mrs|dr|prof|e\.g|i\.e|(?:approx|cf|no|sect|incl|etc|kg|nr|art)(?=\.(?!\s+[\"'“(]?(?-i:[A-ZÀ-Þ]))))\.", re.IGNORECASE)
CASED = re.compile(r"\n+|(?<=[.?!])[\"'”)]?\s+(?=[\"'“¿¡(]?[A-ZÀ-Þ0-9])")
MARKUP = re.compile(r"<[^<>]{1,200}>|^#.*$", re.MULTILINE)
UNCASED = re.compile(r"\n+|(?<=[.?!])[\"'”)]?\s+")
HAS_CASE = re.compile(r"[.?!]\s+[A-ZÀ-Þ]")
BLOCK = 512
POOL = "*"  # language group of all texts in rare languages
LIGHT = 2.0


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence with at least two words; headings and tags are none."""
    text = ABBREVIATION.sub(r"\1", MARKUP.sub("\n", text))
    parts = (CASED if HAS_CASE.search(text) else UNCASED).split(text)
    return [ws for p in parts if len(ws := WORD.findall(p.lower())) >= 2]


def _language(lang: object) -> str:
    return lang.strip()[:2].lower() if isinstance(lang, str) else ""


def _vocabulary(docs: DataFrame, *, least: int = 3, most_terms: int = 20_000, least_texts: int = 20, least_share: float = 0.01) -> tuple[dict[str, int], dict[str, np.ndarray], dict[str, int]]:
    """(term numbers, texts that hold each term by language group, texts by language group).

    Languages below ``least_texts`` or ``least_share`` of the texts are pooled into the
    group ``POOL``; each group has its own ``most_terms`` terms.
    """

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            seen: Counter = Counter()
            for t, lang in zip(pdf["text"], pdf["lang"]):
                if ws := set(WORD.findall(t.lower())):
                    g = _language(lang)
                    seen.update((g, w) for w in ws)
                    seen[g, ""] += 1
            yield pd.DataFrame([(g, w, n) for (g, w), n in seen.items()], columns=["g", "term", "n"])

    counts = materialize(docs.select("text", "lang").mapInPandas(count, "g string, term string, n bigint").groupBy("g", "term").agg(F.sum("n").alias("n")), "counts")
    texts = counts.where(F.col("term") == "")
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = [r["g"] for r in texts.where(F.col("n") >= max(least_texts, least_share * total)).orderBy(F.desc("n"), "g").collect()]  # at most 1 / least_share
    pooled = counts.select(F.when(F.col("g").isin(large), F.col("g")).otherwise(POOL).alias("g"), "term", "n").groupBy("g", "term").agg(F.sum("n").alias("n"))
    pooled = materialize(pooled, "pooled")
    sizes = {r["g"]: r["n"] for r in pooled.where(F.col("term") == "").collect()}
    groups = {g: sizes[g] for g in (*large, POOL) if g in sizes}
    often = pooled.where(F.col("term") != "").groupBy("term").agg(F.sum("n").alias("all")).where(F.col("all") >= least).select("term")
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.desc("n"), "term"))
    top = pooled.join(often, "term", "left_semi").withColumn("rank", rank).where(F.col("rank") <= most_terms).select("term").distinct()
    rows = pooled.join(top, "term", "left_semi").collect()
    index = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    df = {g: np.zeros(len(index)) for g in groups}
    for r in rows:
        df[r["g"]][index[r["term"]]] = r["n"]
    return index, df, groups


def _idf(df: dict[str, np.ndarray], groups: dict[str, int], least_texts: int = 20) -> np.ndarray:
    """Least idf over the language groups; a pool of few texts speaks only for terms no other group holds."""
    with np.errstate(divide="ignore"):
        by = {g: np.where(df[g] > 0, np.log(groups[g] / np.maximum(df[g], 1)), np.inf) for g in groups}
    large = [by[g] for g in groups if g != POOL]
    if POOL not in by or not large:
        return np.min([*by.values()], axis=0)
    idf = np.min(large, axis=0)
    return np.minimum(idf, by[POOL]) if groups[POOL] >= least_texts else np.where(np.isfinite(idf), idf, by[POOL])


def _encode(docs: DataFrame, index: dict[str, int], groups: list[str]) -> DataFrame:
    """(doc_id, g, sizes, terms): term numbers of each sentence, laid end to end."""
    shared = docs.sparkSession.sparkContext.broadcast((index, {g: i for i, g in enumerate(groups)}))

    def encode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, number = shared.value
        for pdf in it:
            rows = []
            for key, t, lang in zip(pdf["doc_id"], pdf["text"], pdf["lang"]):
                parts = [sorted({i for w in s if (i := index.get(w, -1)) >= 0}) for s in sentences(t)]
                if parts:
                    rows.append((key, number.get(_language(lang), number.get(POOL, -1)), [len(p) for p in parts], [i for p in parts for i in p]))
            yield pd.DataFrame(rows, columns=["doc_id", "g", "sizes", "terms"])

    return docs.select("doc_id", "text", "lang").mapInPandas(encode, "doc_id bigint, g int, sizes array<int>, terms array<int>")


class _Batch:
    """Flat arrays of some encoded documents."""

    def __init__(self, sizes: list, terms: list):
        per = [len(s) for s in sizes]
        self.docs = len(per)
        self.doc = np.repeat(np.arange(self.docs), per)  # of each sentence
        self.size = np.concatenate([np.asarray(s, np.int64) for s in sizes]) if per else np.zeros(0, np.int64)
        self.term = np.concatenate([np.asarray(t, np.int64) for t in terms]) if per else np.zeros(0, np.int64)
        self.sentence = np.repeat(np.arange(len(self.size)), self.size)

    def project(self, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """Unit vectors of the sentences; zero where the terms weigh less than ``LIGHT`` together."""
        out = np.zeros((len(self.size), basis.shape[1]), np.float32)
        w = weight[self.term]
        heavy = np.bincount(self.sentence, w * w, len(self.size)) >= LIGHT * LIGHT
        use = np.flatnonzero((w > 0) & heavy[self.sentence])  # most terms have no weight
        if not len(use):
            return out
        scaled = weight[:, None] * basis
        term, sentence = self.term[use], self.sentence[use]
        starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        step = 4096
        for s in range(0, len(starts), step):
            part = starts[s : s + step]
            last = starts[s + step] if s + step < len(starts) else len(term)
            out[sentence[part]] = np.add.reduceat(scaled[term[part[0] : last]], part - part[0], axis=0)
        filled = sentence[starts]
        out[filled] /= np.maximum(np.linalg.norm(out[filled], axis=1, keepdims=True), 1e-9)
        return out

    def documents(self, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, weight of unit length) of each distinct pair with weight."""
        use = weight[self.term] > 0
        key, n = np.unique(self.doc[self.sentence[use]] * size + self.term[use], return_counts=True)
        d, k = key // size, key % size
        w = np.log1p(n) * weight[k]
        norm = np.sqrt(np.bincount(d, w * w, self.docs))
        return d, k, (w / norm[d]).astype(np.float32)


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Batch]]:
    for batch in it:
        if batch.num_rows:
            yield batch, _Batch(batch.column("sizes").to_pylist(), batch.column("terms").to_pylist())


def _add_blocks(df: DataFrame, fill, rows: int, width: int) -> np.ndarray:
    """Sum over all partitions of a ``rows`` x ``width`` matrix that ``fill`` adds to, block by block and in levels."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width), np.float32)
        for batch, b in _batches(it):
            fill(total, batch, b)
        yield block_rows(total.ravel().astype("<f4"), BLOCK * width)

    return sum_blocks(df.mapInArrow(part, SCHEMA), "<f4", BLOCK * width, rows * width, n_tasks(df)).reshape(rows, width)


def _truncated_svd(encoded: DataFrame, weight: np.ndarray, rank: int, passes: int, start: np.ndarray | None = None) -> np.ndarray:
    """Right singular vectors of the weighted document-term matrix, by subspace iteration over all documents."""
    size = len(weight)
    rank = min(rank, size)
    q = start if start is not None else np.random.default_rng(0).standard_normal((size, rank)).astype(np.float32)
    for _ in range(passes):
        shared = encoded.sparkSession.sparkContext.broadcast((q, weight))

        def fill(total: np.ndarray, _: pa.RecordBatch, b: _Batch) -> None:
            q, weight = shared.value  # noqa: B023
            d, k, w = b.documents(weight, len(weight))
            if not len(d):
                return
            starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            x = np.zeros((b.docs, q.shape[1]), np.float32)
            x[d[starts]] = np.add.reduceat(w[:, None] * q[k], starts, axis=0)
            order = np.argsort(k, kind="stable")
            k, d, w = k[order], d[order], w[order]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            total[k[starts]] += np.add.reduceat(w[:, None] * x[d], starts, axis=0)

        q = np.linalg.qr(_add_blocks(encoded, fill, size, rank).astype(np.float64))[0].astype(np.float32)
    return q


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _two_means(z: np.ndarray, near: float = 0.3) -> np.ndarray:
    """One or two unit centroids of some unit vectors.

    The start is a split along the main direction of spread, which two fields of a
    subject make and a few wrong labels do not; vectors far from both centroids then
    have no say in them.
    """
    if len(z) < 4:
        return _unit(z.mean(axis=0, keepdims=True))
    centred = z - z.mean(axis=0)
    side = (centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1] > 0).astype(int)
    c = None
    for _ in range(8):
        inner = np.ones(len(z), bool) if c is None else (z @ c.T).max(axis=1) >= near
        means = [z[inner & (side == h)].mean(axis=0) if (inner & (side == h)).any() else None for h in range(2)]
        means = [m for m in means if m is not None]
        if not means:
            break
        c = _unit(np.stack(means))
        side = (z @ c.T).argmax(axis=1)
    return c


def _unlike(counts: np.ndarray, prior: np.ndarray, mass: float) -> np.ndarray:
    """Divergence of each row's distribution (smoothed) from its prior."""
    p = (counts + mass * prior) / (counts.sum(axis=1, keepdims=True) + mass)
    return (p * np.log(np.maximum(p, 1e-9) / np.maximum(prior, 1e-9))).sum(axis=1)


def _assign(x: np.ndarray, centroids: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, subject, similarity, lead over the next subject) of each sentence."""
    s = x @ centroids.T
    best = np.full((len(x), n), -1.0, np.float32)
    for j in range(n):
        if (of == j).any():
            best[:, j] = s[:, of == j].max(axis=1)
    subject = best.argmax(axis=1)
    two = np.partition(best, n - 2, axis=1)[:, -2:] if n > 1 else np.c_[np.full(len(x), -1.0), best]
    return s.argmax(axis=1), subject, two[:, 1], two[:, 1] - two[:, 0]


def document_subjects(
    documents: DataFrame, labels: DataFrame, *, rank: int = 112, rounds: int = 2, refinements: int = 4, similarity: float = 0.35, lone_similarity: float = 0.8, share: float = 0.18, most_labels: int = 20_000, most_terms: int = 20_000,
) -> DataFrame:
    """(doc_id, subject, share). ``documents``: doc_id, text, lang. ``labels``: doc_id, subject."""
    spark = documents.sparkSession
    schema = "doc_id bigint, subject string, share double"
    docs = documents.where(F.col("doc_id").isNotNull() & (F.trim("text") != "")).select("doc_id", "text", "lang")
    index, df, groups = _vocabulary(docs, most_terms=most_terms)
    names = list(groups)
    encoded = materialize(_encode(docs, index, names), "encoded")
    marked = labels.where(F.col("subject").isNotNull()).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    seeds = encoded.join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).collect()
    subjects = sorted({s for r in seeds for s in r["subjects"]})
    if not subjects or not index:
        return spark.createDataFrame([], schema)
    n, size = len(subjects), len(index)
    number = {s: i for i, s in enumerate(subjects)}
    seed = _Batch([r["sizes"] for r in seeds], [r["terms"] for r in seeds])
    allowed = np.zeros((len(seeds), n), np.float32)
    for i, r in enumerate(seeds):
        allowed[i, [number[s] for s in r["subjects"]]] = 1 / len(r["subjects"])

    idf = _idf(df, groups)
    base = np.where(np.isfinite(idf) & (idf >= 0.7), idf, 0).astype(np.float32)
    held = np.unique(seed.doc[seed.sentence] * size + seed.term)
    by_label = np.zeros((size, n))
    np.add.at(by_label, held % size, allowed[held // size])
    prior = (allowed.sum(axis=0) + 1) / (allowed.sum() + n)
    label_unlike, label_seen = _unlike(by_label, np.tile(prior, (size, 1)), 1.0), by_label.sum(axis=1)
    weight = (base * np.where(label_seen >= 3, np.clip((label_unlike - 0.35) / 0.6, 0, 1), 0.35)).astype(np.float32)

    basis = None
    for turn in range(rounds):
        basis = _truncated_svd(encoded, weight, rank, 3 if basis is None else 2, basis)
        d, k, w = seed.documents(weight, size)
        x = np.zeros((seed.docs, basis.shape[1]))
        np.add.at(x, d, w[:, None] * basis[k])
        x = _unit(x)
        centroids, of = [], []
        lang = np.array([r["g"] for r in seeds])
        for g in np.unique(lang):
            for s in range(n):
                z = x[(lang == g) & (allowed[:, s] == 1) & (np.abs(x).sum(axis=1) > 0)]
                if len(z):
                    found = _two_means(z)
                    centroids += list(found)
                    of += [s] * len(found)
        if not centroids:
            return spark.createDataFrame([], schema)
        c, of = np.stack(centroids).astype(np.float32), np.array(of)
        for _ in range(refinements):
            shared = spark.sparkContext.broadcast((weight, basis, c, of))

            def gather(total: np.ndarray, _: pa.RecordBatch, b: _Batch) -> None:
                weight, basis, c, of = shared.value  # noqa: B023
                x = b.project(weight, basis)
                centroid, _, s, lead = _assign(x, c, of, n)
                clear = (s >= similarity) & (lead >= 0.1)
                for j in np.unique(centroid[clear]):
                    mine = clear & (centroid == j)
                    total[j, :-1] += x[mine].sum(axis=0)
                    total[j, -1] += mine.sum()

            sums = _add_blocks(encoded, gather, len(c), c.shape[1] + 1)
            c = np.where(sums[:, -1:] >= 3, _unit(sums[:, :-1]), c).astype(np.float32)
        shared = spark.sparkContext.broadcast((weight, basis, c, of))
        if turn + 1 == rounds:
            break
        known = spark.sparkContext.broadcast({r["doc_id"]: allowed[i] for i, r in enumerate(seeds)})
        m = len(names)

        def around(total: np.ndarray, batch: pa.RecordBatch, b: _Batch) -> None:
            # of each term: subjects of the other sentences around it, and its languages; last rows: subjects of each language
            weight, basis, c, of = shared.value  # noqa: B023
            _, subject, s, _ = _assign(b.project(weight, basis), c, of, n)
            ok = s >= similarity
            doc = np.zeros((b.docs, n), np.float32)
            np.add.at(doc, (b.doc[ok], subject[ok]), 1)
            labelled = np.zeros(b.docs, bool)
            for i, key in enumerate(batch.column("doc_id").to_pylist()):
                if (a := known.value.get(key)) is not None:  # noqa: B023
                    doc[i], labelled[i] = 3 * a, True
            rest = doc[b.doc]
            own = ok & ~labelled[b.doc]
            rest[np.flatnonzero(own), subject[own]] -= 1
            rest **= 2  # what prevails in the document counts
            mass = rest.sum(axis=1, keepdims=True)
            rest = np.where(mass > 0, rest / np.maximum(mass, 1e-9), 0)
            lang = batch.column("g").to_numpy()
            np.add.at(total, b.term, np.hstack([rest, (lang[b.doc, None] == np.arange(m)).astype(np.float32)])[b.sentence])
            for g in range(m):
                total[size + g, :n] += doc[lang == g].sum(axis=0)

        total = _add_blocks(encoded, around, size + m, n + m).astype(np.float64)
        counts, langs, mix = total[:size, :n], total[:size, n:], total[size:, :n] + 1
        priors = (langs / np.maximum(langs.sum(axis=1, keepdims=True), 1)) @ (mix / mix.sum(axis=1, keepdims=True))
        priors = np.where(priors.sum(axis=1, keepdims=True) > 0, priors, prior)
        unlike = _unlike(counts, priors, 2.0)
        unlike = np.where(label_seen >= 8, (np.maximum(unlike, 0) + label_unlike) / 2, unlike)
        weight = (base * np.clip((unlike - 0.25) / 0.5, 0, 1)).astype(np.float32)

    def decide(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, basis, c, of = shared.value
        for batch, b in _batches(it):
            x = b.project(weight, basis)
            _, subject, s, _ = _assign(x, c, of, n)
            ok = (s >= similarity) & (np.abs(x).sum(axis=1) > 0)
            part = np.zeros((b.docs, n))
            np.add.at(part, (b.doc[ok], subject[ok]), 1)
            n_sentences = np.maximum(np.bincount(b.doc, minlength=b.docs), 1)[:, None]
            clearest = np.zeros((b.docs, n))
            np.maximum.at(clearest, (b.doc[ok], subject[ok]), s[ok])
            lone = (part == 1) & (n_sentences > 3)
            part /= n_sentences
            i, j = np.nonzero((part >= share) & (~lone | (clearest >= lone_similarity)))
            yield _arrow(doc_id=batch.column("doc_id").take(pa.array(i)), subject=pa.array([subjects[k] for k in j], pa.string()), share=part[i, j])

    return encoded.mapInArrow(decide, schema).groupBy("doc_id", "subject").agg(F.max("share").alias("share"))
