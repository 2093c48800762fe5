"""Guardrails as columns: injection rules, personal data, input and output chains."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import GuardThresholds
from siftline.functions import text as X
from siftline.functions.checks import luhn_ok, verhoeff_ok, verhoeff_valid

def _near(first: str, then: str, gap: int = 4) -> str:
    """A word of ``first`` and, at most ``gap`` words on, something of ``then``."""
    words = lambda s: "|".join(s.split())
    return rf"\b(?:{words(first)})\b(?:\W+\w+){{0,{gap}}}?\W+(?:{then if ' ' not in then else words(then)})\b"


#: What each rule looks for: a verb near its object, or a telling phrase.
INJECTION = {
    name: "(?i)" + pattern
    for name, pattern in {
        "ignore previous instructions": _near("bypass disregard forget ignore override", "instruction instructions prompt prompts"),
        "reveal system prompt": _near("display expose leak print repeat reveal show", r"(?:hidden|internal|system)\W+(?:\w+\W+)?(?:instructions|message|prompt)"),
        "role override": r"\byou\W+are\W+now\W+(?:a|an|my|the)\b|\bfrom\W+now\W+on\W+you\b",
        "jailbreak": r"\bjail\W?break\w*|\b(?:dan|developer|god)\W+mode\b",
        "unrestricted persona": _near("act behave play pretend roleplay", "lawless uncensored unfiltered unrestricted"),
        "chat-template tokens": r"<\|\w+\|>|\[/?inst\]|<</?sys>>",
    }.items()
}


def injection_rules(c: Column) -> Column:
    """Names of the rules that match, in order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(name)) for name, p in INJECTION.items()]))


# --- personal data, in the JVM ----------------------------------------------

PATTERNS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "CREDIT_CARD": r"\b(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})\b",
    "IN_AADHAAR": r"\b[2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "IN_PAN": r"\b[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]\b",
    "PHONE_NUMBER": r"\+[0-9]{1,3}[ -]?[0-9](?:[ -]?[0-9]){6,11}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}|\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b",
}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def valid_matches(c: Column, kind: str) -> Column:
    """Distinct matches of the pattern that pass the check of their type."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({PATTERNS[kind]})"), F.lit(1)))
    if kind == "CREDIT_CARD":
        return F.filter(found, lambda x: F.call_function("luhn_check", _digits(x)))
    if kind == "IN_AADHAAR":
        return F.filter(found, lambda x: (F.length(_digits(x)) == 12) & verhoeff_valid(_digits(x)))
    return found


def pii_counts(c: Column) -> Column:
    """map<type, distinct values>, types without a value left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.size(valid_matches(c, k)).alias("n")) for k in PATTERNS])
    return F.map_from_entries(F.filter(entries, lambda e: e["n"] > 0))


def mask_pii(c: Column) -> Column:
    """``<TYPE>`` in the place of every valid match; types in a fixed order, so overlaps go to the surer type."""
    for kind in PATTERNS:
        if kind in ("CREDIT_CARD", "IN_AADHAAR"):
            found = valid_matches(c, kind)
            tag = F.lit(f"<{kind}>")
            c = F.aggregate(found, c, lambda t, x: F.replace(t, x, tag))  # noqa: B023 - the lambda runs at once
        else:
            c = F.regexp_replace(c, PATTERNS[kind], f"<{kind}>")
    return c


def mask_string(t: str) -> str:
    """``mask_pii`` of one Python string, for text that arrives in pieces."""
    check = {"CREDIT_CARD": luhn_ok, "IN_AADHAAR": verhoeff_ok}
    for kind, pattern in PATTERNS.items():
        ok = check.get(kind, lambda _: True)
        t = re.sub(pattern, lambda m: f"<{kind}>" if ok(re.sub("[^0-9]", "", m.group())) else m.group(), t, flags=re.ASCII)  # noqa: B023
    return t


# --- chains -----------------------------------------------------------------


def _check(name: str, verdict: Column, reason: Column, score: Column, threshold: float) -> Column:
    return F.struct(F.lit(name).alias("name"), verdict.alias("verdict"), reason.cast("string").alias("reason"), score.cast("double").alias("score"), F.lit(float(threshold)).alias("threshold"))


def input_guards(df: DataFrame, limits: GuardThresholds = GuardThresholds()) -> DataFrame:
    """Checks length, personal data, injection, toxicity and topic, in that order.

    ``df``: text, tokens, and the classifier's injection_score, toxicity_score (null if
    it was not asked or failed) and similarity to the corpus. Adds blocked, masked and
    checks. A score equal to its threshold blocks; topic only warns, and later checks
    are skipped once a question is blocked.
    """
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    none = F.lit(None)
    rules = injection_rules(F.col("text"))
    long = F.col("tokens") > limits.max_tokens
    d = df.withColumn("_rules", rules).withColumn("_long", F.coalesce(long, F.lit(False))).withColumn("_kinds", F.map_keys(pii_counts(F.col("text"))))
    d = d.withColumn("_inj", F.size("_rules") > 0).withColumn("_inj_score", clip(F.col("injection_score")))
    d = d.withColumn("_inj", F.col("_inj") | F.coalesce(F.col("_inj_score") >= limits.injection, F.lit(False)))
    d = d.withColumn("_tox_asked", ~F.col("_long") & (F.size("_rules") == 0) & F.col("toxicity_score").isNotNull()).withColumn("_tox", F.col("_tox_asked") & (clip(F.col("toxicity_score")) >= limits.toxicity))
    d = d.withColumn("blocked", F.col("_long") | F.col("_inj") | F.col("_tox"))
    word = lambda bad, skip=F.lit(False), ill="block": F.when(skip, "skipped").when(bad, ill).otherwise("pass")
    checks = F.array(
        _check("length", word(F.col("_long")), F.when(F.col("_long"), F.lit("too many tokens")), F.col("tokens"), limits.max_tokens),
        _check("pii", word(F.size("_kinds") > 0, ill="masked"), F.array_join("_kinds", ", "), F.size("_kinds"), 0),
        _check("injection", word(F.col("_inj")), F.array_join("_rules", ", "), F.col("_inj_score"), limits.injection),
        _check("toxicity", word(F.col("_tox"), ~F.col("_tox_asked")), none, F.when(F.col("_tox_asked"), F.col("toxicity_score")), limits.toxicity),
        _check("off_topic", word(F.coalesce(F.col("similarity") < limits.off_topic, F.lit(False)), F.col("blocked"), "warn"), none, F.when(~F.col("blocked"), F.col("similarity")), limits.off_topic),
    )
    return d.withColumn("checks", checks).withColumn("masked", mask_pii(F.col("text"))).drop("_rules", "_long", "_kinds", "_inj", "_inj_score", "_tox_asked", "_tox")


def output_guards(df: DataFrame, limits: GuardThresholds = GuardThresholds()) -> DataFrame:
    """Citations, groundedness, personal data, empty answers and format, in that order.

    ``df``: answer, context_ids, unsupported (share of unsupported sentences, null if
    not judged), and regenerated with regenerated_unsupported, the one second answer
    that both first checks share. Adds final, verdict and cited.
    """
    first = X.citations(F.col("answer"), F.col("context_ids"))
    bad = (F.size(first[1]) > 0) | F.coalesce(F.col("unsupported") > limits.unsupported, F.lit(False))
    d = df.withColumn("_again", bad & F.col("regenerated").isNotNull())
    d = d.withColumn("_text", F.when(F.col("_again"), F.col("regenerated")).otherwise(F.col("answer"))).withColumn("_share", F.when(F.col("_again"), F.col("regenerated_unsupported")).otherwise(F.col("unsupported")))
    valid, unknown = X.citations(F.col("_text"), F.col("context_ids"))
    d = d.withColumn("_unknown", unknown).withColumn("_text", X.strip_ids(F.col("_text"), F.col("_unknown"))).withColumn("_ungrounded", F.coalesce(F.col("_share") > limits.unsupported, F.lit(False)))
    shown = F.array_join(F.transform(F.slice("context_ids", 1, 3), lambda x: F.concat(F.lit("["), x, F.lit("]"))), " ")
    fallback = F.concat(F.lit("I couldn't produce an answer that is fully supported by the documents. The most relevant passages are: "), shown, F.lit("."))
    d = d.withColumn("_text", F.when(F.col("_ungrounded"), fallback).otherwise(F.col("_text")))
    d = d.withColumn("_masked", mask_pii(F.col("_text"))).withColumn("cited", X.citations(F.col("_masked"), F.col("context_ids"))[0])
    d = d.withColumn("_final", X.truncate_at_sentence(X.repair_markdown(X.no_answer(F.col("_masked"), F.col("cited"))), limits.max_chars))
    verdict = F.when(F.col("_ungrounded"), "replaced").when(F.col("_masked") != F.col("_text"), "redacted").when(F.size("_unknown") > 0, "repaired").when(F.col("_again"), "regenerated").when(F.col("_final") != F.col("_masked"), "repaired").otherwise("pass")
    return d.withColumn("verdict", verdict).withColumnRenamed("_final", "final").drop("_again", "_text", "_share", "_unknown", "_ungrounded", "_masked")


PARTS = re.compile(r"\s+|\S+")


def word_diff(before: str, after: str) -> list[tuple[str, str]]:
    """(same | removed | added, text) runs; words and the white space between them are the parts.

    The longest common subsequence is the longest rising chain through the places at
    which parts agree, so the work grows with the number of agreements.
    """
    a, b = PARTS.findall(before or ""), PARTS.findall(after or "")
    places: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).insert(0, j)
    ends: list[int] = []  # least place in b at which a chain of each length ends
    chains: list[tuple] = []  # (place in a, place in b, chain before)
    for i, w in enumerate(a):
        for j in places.get(w, ()):
            k = bisect_left(ends, j)
            link = (i, j, chains[k - 1] if k else None)
            ends[k : k + 1], chains[k : k + 1] = [j], [link]
    agreed, link = [(len(a), len(b))], chains[-1] if chains else None
    while link:
        agreed.append(link[:2])
        link = link[2]
    runs: list[tuple[str, str]] = []
    i = j = 0
    for x, y in reversed(agreed):
        runs += [("removed", "".join(a[i:x])), ("added", "".join(b[j:y])), ("same", "".join(a[x : x + 1]))]
        i, j = x + 1, y + 1
    out = []
    for kind, group in groupby((r for r in runs if r[1]), key=itemgetter(0)):
        out.append((kind, "".join(t for _, t in group)))
    return out


def diff_column(before: Column, after: Column) -> Column:
    """array<struct<kind, text>>: ``word_diff`` of two columns, Arrow batches at a time."""

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def diff(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "text": t} for k, t in word_diff(p, q)] for p, q in zip(x, y)])

    return diff(before, after)


def with_diff(df: DataFrame, before: str, after: str, *, out: str = "diff") -> DataFrame:
    """``df`` with ``diff_column`` of two of its columns, whatever expressions made them.

    A scan of rows stands between the two: Spark folds a column's expression into the
    arguments of a Python function, and with a lambda inside a lambda (the check digits
    of ``mask_pii``) it then can no longer take the function out of the plan.
    """
    kept = [c for c in df.columns if c != out]

    def diff(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            runs = [[{"kind": k, "text": t} for k, t in word_diff(p, q)] for p, q in zip(pdf[before], pdf[after])]
            yield pdf[kept].assign(**{out: runs})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
    return df.mapInPandas(diff, f"{fields}, `{out}` array<struct<kind:string,text:string>>")
