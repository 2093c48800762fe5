"""Text columns: cleaning, tokens, citations, sentences. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character falls in exactly one alternative, so tokens joined give the text back.
TOKEN = r"'(?:s|t|re|ve|m|ll|d)|[ \t\n]?\p{L}+|[ \t\n]?\p{N}{1,3}|[ \t\n]?[^ \t\n\p{L}\p{N}]+|[ \t\n]+"
SPACE = r"[ \t\r\n\x0B\f]"
# Characters that close a sentence and those that may open the next.
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9\[(\"'])"
NO_ANSWER = "I could not find the answer in the provided documents."
WITHHELD = "[withheld: PII redaction was unavailable]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def normalise(c: Column) -> Column:
    """Line ends, hard spaces, hyphenation, runs of blanks and of empty lines; in this order."""
    for pattern, by in (
        (r"\r\n|\r", "\n"),
        ("\u00a0", " "),
        (r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2"),
        (r"[ \t\f\x0B]+", " "),
        (r" *\n *", "\n"),
        (r"\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, by)
    return strip(c)


def line_key(c: Column) -> Column:
    """Lines that differ in case, outer blanks and numbers have one key."""
    return F.regexp_replace(F.lower(strip(c)), "[0-9]+", "#")


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    return F.size(tokens(F.coalesce(c, F.lit(""))))


def cap_payload(json: Column, limit: int = 256_000) -> Column:
    """A payload above the limit gives way to a marker with its sorted keys."""
    marker = F.to_json(F.struct(F.lit(True).alias("truncated"), F.array_sort(F.json_object_keys(json)).alias("keys")))
    return F.when(F.length(json) > limit, marker).otherwise(json)


def citations(answer: Column, valid: Column) -> tuple[Column, Column]:
    """(valid ids in order of first appearance, unknown ids that look like chunk ids)."""
    groups = F.regexp_extract_all(answer, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    parts = F.array_distinct(F.filter(F.flatten(F.transform(groups, lambda g: F.split(g, r"[,;\s]+"))), lambda x: x != ""))
    return F.filter(parts, lambda x: F.array_contains(valid, x)), F.filter(parts, lambda x: ~F.array_contains(valid, x) & x.rlike(r"^[0-9a-f]{8}-v[0-9]+-[0-9]+$"))


def strip_citations(answer: Column) -> Column:
    return strip(F.regexp_replace(answer, r"\s*\[[^\[\]]+\]", ""))


def strip_ids(answer: Column, unknown: Column) -> Column:
    """Remove unknown ids: the whole bracket, or a list entry with its comma."""

    def one(text: Column, x: Column) -> Column:
        q = F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
        text = F.regexp_replace(text, F.concat(F.lit(r"\s*\["), q, F.lit(r"\]")), F.lit(""))
        text = F.regexp_replace(text, F.concat(F.lit(r"[,;]\s*"), q, F.lit(r"(?=[\],;])")), F.lit(""))
        return F.regexp_replace(text, F.concat(F.lit(r"(?<=\[)"), q, F.lit(r"[,;]\s*")), F.lit(""))

    return F.aggregate(unknown, answer, one)


def sentences(c: Column) -> Column:
    return F.filter(F.split(strip(c), SENTENCE_BREAK), lambda x: x != "")


def repair_markdown(c: Column) -> Column:
    """Close an open code fence; drop the last of an odd number of bold marks."""
    fenced = F.when(F.regexp_count(c, F.lit("```")) % 2 == 1, F.concat(c, F.lit("\n```"))).otherwise(c)
    bold = F.regexp_count(fenced, F.lit(r"\*\*")) % 2 == 1
    return F.when(bold, F.regexp_replace(fenced, r"(?s)^(.*)\*\*", "$1")).otherwise(fenced)


def truncate_at_sentence(c: Column, limit: int) -> Column:
    """Cut below the limit, at the last sentence end if that keeps more than half."""
    cut = F.left(c, F.lit(limit - 1))
    at = F.length(cut) - F.greatest(F.lit(0), F.length(F.regexp_extract(cut, r"(?s)^.*\.(?=[ \n])(.*)$", 1)))
    ends = cut.rlike(r"(?s)^.*\.[ \n].*$") & (at > limit / 2)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.when(ends, F.substring(cut, F.lit(1), at)).otherwise(F.rtrim(cut)), F.lit(" …")))


# Phrases by which an answer says that the documents hold none.
SAYS_NOTHING = (
    r"(?i)(do(es)? not (cover|contain|mention|include)|don'?t know|not (found|mentioned|covered) in"
    r"|no (relevant )?information|cannot (find|answer)|isn'?t (covered|mentioned))"
)


def no_answer(answer: Column, cited: Column) -> Column:
    """The standard message where an answer says it found nothing and cites nothing valid."""
    return F.when(answer.rlike(SAYS_NOTHING) & (F.size(cited) == 0), F.lit(NO_ANSWER)).otherwise(answer)


def cache_key(kind: Column, model: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", kind, model, F.regexp_replace(F.lower(strip(text)), rf"{SPACE}+", " ")), 256)


def duration_label(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit(" ms"))).otherwise(F.format_string("%.1f s", ms / 1000))


def unwrap_json(c: Column) -> Column:
    """The object inside an answer that may stand in a code fence; null if it is none."""
    inner = strip(F.regexp_replace(F.regexp_replace(strip(c), r"(?s)^```[a-zA-Z]*\s*", ""), r"(?s)\s*```$", ""))
    return F.when(inner.startswith("{") & F.get_json_object(inner, "$").isNotNull(), inner)


def normalise_name(c: Column) -> Column:
    """Key of an entity: lower case, words parted by one space, no leading article."""
    words = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}_]+", " "))
    return F.regexp_replace(words, r"^(the|a|an) ", "")


def normalise_relation(c: Column) -> Column:
    return F.left(F.regexp_replace(F.lower(strip(c)), rf"{SPACE}+", " "), F.lit(60))


def ngrams(c: Column, most: int = 6) -> Column:
    """All runs of up to ``most`` words of the normalised text, a leading article dropped from each."""
    w = F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}_]+", " ")), " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(w) - i + 1)), lambda n: F.array_join(F.slice(w, i, n), " "))))
    return F.array_distinct(F.filter(F.transform(spans, lambda x: F.regexp_replace(x, r"^(the|a|an) ", "")), lambda x: x != ""))


def answer_segments(answer: Column, valid: Column) -> Column:
    """array<struct<kind, value>>: text and cite parts in order; a bracket cites only if all its ids are valid."""
    parts = F.filter(F.split(answer, r"(?=\[[^\[\]]+\])|(?<=\])"), lambda p: p != "")

    def part(p: Column) -> Column:
        ids = F.filter(F.split(F.regexp_extract(p, r"^\[([^\[\]]+)\]$", 1), r"[,;\s]+"), lambda x: x != "")
        cites = (F.size(ids) > 0) & F.forall(ids, lambda x: F.array_contains(valid, x))
        return F.struct(F.when(cites, "cite").otherwise("text").alias("kind"), p.alias("value"))

    return F.transform(parts, part)


def run_label(question: Column, filenames: Column) -> Column:
    """The question of a query run, the files of an ingest run."""
    return F.when(question.isNotNull(), question).otherwise(F.array_join(filenames, ", "))
