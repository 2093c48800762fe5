"""Interfaces of models with deterministic stand-ins: embedder, reranker, language model."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Instruction put before queries of models whose name holds this part.
QUERY_PREFIX = {"bge": "Represent this sentence for searching relevant passages: "}


class Embedder(Protocol):
    model_name: str
    dimension: int

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashedEmbedder:
    """Counts of words by hash, scaled to unit length."""

    model_name, limit = "hashed-words", 512

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                out[i, int(hashlib.md5(w.encode()).hexdigest(), 16) % self.dimension] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def embed_query(self, text: str) -> np.ndarray:
        prefix = next((p for k, p in QUERY_PREFIX.items() if k in self.model_name), "")
        return self.embed_documents([prefix + text])[0]

    def count_truncated(self, texts: list[str]) -> int:
        return sum(len(t.split()) > self.limit for t in texts)


def embed_column(c: Column, make=HashedEmbedder) -> Column:
    """array<float> of a text column; the model is made once in each worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            yield pd.Series(list(model.embed_documents(s.fillna("").tolist())), index=s.index)

    return run(c)


class LLM(Protocol):
    def complete(self, prompt: str) -> str: ...


class FirstSentence:
    """Answers with the first sentence of the first context block and its id."""

    def complete(self, prompt: str) -> str:
        m = re.search(r"^\[([^\]]+)\][^\n]*\n(.+?)(?:(?<=[.!?])\s|\n|$)", prompt, re.MULTILINE | re.DOTALL)
        return f"{m.group(2).strip()} [{m.group(1)}]" if m else ""


class RuleExtractor:
    """Capitalised phrases as entities, each related to the next."""

    def complete(self, prompt: str) -> str:
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}(?: [A-Z][a-z]{3,})+\b", prompt)))
        return json.dumps({"entities": [{"name": n, "type": "CONCEPT"} for n in names], "relations": [{"source": a, "relation": "related to", "target": b} for a, b in zip(names, names[1:])]})


def complete_column(c: Column, model: LLM) -> Column:
    """Answers with usage: struct<answer, prompt_words, answer_words, error>. A failed call gives an error, never a failed task."""

    @F.pandas_udf("answer string, prompt_words int, answer_words int, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for p in s:
            try:
                a = model.complete(p) if p is not None else None
                rows.append((a, len((p or "").split()), len((a or "").split()), None))
            except Exception as e:  # noqa: BLE001
                rows.append((None, len((p or "").split()), 0, type(e).__name__))
        return pd.DataFrame(rows, columns=["answer", "prompt_words", "answer_words", "error"])

    return run(c)


def extract_entities(texts: DataFrame, model: LLM) -> DataFrame:
    """(id, name, type, relations, error) from the model's JSON for each whole text."""
    schema = "entities array<struct<name:string,type:string>>, relations array<struct<source:string,relation:string,target:string>>"
    asked = texts.where(F.col("text").isNotNull()).select("id", complete_column(F.col("text"), model).alias("c"))
    parsed = asked.select("id", F.from_json("c.answer", schema).alias("j"), "c.error")
    return parsed.select("id", F.explode_outer("j.entities").alias("e"), F.size("j.relations").alias("relations"), "error").select("id", "e.name", "e.type", "relations", "error")
