"""Seams for external models, and deterministic stand-ins for each.

A provider is an object that can be pickled; a worker opens its model once. Rows reach it in batches,
and only those that an earlier filter has left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType

#: Texts that an embedding model gets at a time.
BATCH = 32


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def logits(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    def answer(self, prompt: str, options: dict) -> str: ...


class Recogniser(Protocol):
    """Pages (text, method) of a file's bytes."""

    def pages(self, path: str, content: bytes) -> list[tuple[str, str]]: ...


class LetterEmbedder:
    """Counts of the letters a to p."""

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(c) for c in "abcdefghijklmnop"] for t in texts], dtype=float)


@dataclass(frozen=True)
class LengthReranker:
    """Longer passages first: the logit of a passage of `middle` characters is 0, and grows by 1 every `scale`."""

    middle: int = 2000
    scale: int = 1000

    def logits(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [(len(text) - self.middle) / self.scale for _, text in pairs]


class QuotingGenerator:
    """Quotes the first passage of the prompt, or refuses where there is none."""

    def answer(self, prompt: str, options: dict) -> str:
        head, _, rest = prompt.partition("[1] ")
        quote = rest.partition("\n")[2].split("\n\n")[0].strip()
        thought = "" if options.get("think") is False else "<think>the first passage</think>"
        return f"{thought}{quote} [1]" if quote else "[YANITLANAMADI]"


class TextRecogniser:
    """Text files, whose pages a form feed parts."""

    def pages(self, path: str, content: bytes) -> list[tuple[str, str]]:
        return [(page, "text_layer") for page in content.decode("utf-8", "replace").split("\f")]


def embed(rows: DataFrame, provider: Embedder, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """The rows with unit vectors of their texts; zero vectors stay zero, null texts have none."""

    @F.pandas_udf(ArrayType(FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found: list = []
            for a in range(0, len(texts), BATCH):
                part = texts.iloc[a : a + BATCH]
                x = np.asarray(provider.embed(["" if t is None else t for t in part]), dtype=float)
                length = np.linalg.norm(x, axis=1, keepdims=True)
                unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
                found += [None if t is None else v.tolist() for t, v in zip(part, unit, strict=True)]
            yield pd.Series(found)

    return rows.withColumn(out, vectors(F.col(text_col)))


def embed_questions(questions: DataFrame, provider: Embedder, text_col: str = "question", out: str = "embedding") -> DataFrame:
    """Like embed, each distinct question once."""
    distinct = embed(questions.select(text_col).where(F.col(text_col).isNotNull()).distinct(), provider, text_col, out)
    return questions.join(distinct, text_col, "left")


def rerank_scores(pairs: DataFrame, provider: Reranker, question: str = "question", text_col: str = "text", out: str = "rerank_score") -> DataFrame:
    """The pairs with the sigmoid of the model's logit."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for asked, texts in batches:
            logits = np.asarray(provider.logits([(q or "", t or "") for q, t in zip(asked, texts, strict=True)]), dtype=float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -500, 500))))

    return pairs.withColumn(out, score(F.col(question), F.col(text_col)))


def generate(prompts: DataFrame, provider: Generator, options: dict, prompt: str = "prompt", out: str = "raw_answer") -> DataFrame:
    """The prompts with raw answers. A provider that doesn't know an option is called without it."""

    @F.pandas_udf(StringType())
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = []
            for p in batch:
                try:
                    found.append(provider.answer(p or "", options))
                except TypeError:
                    found.append(provider.answer(p or "", {k: v for k, v in options.items() if k != "think"}))
            yield pd.Series(found, dtype=object)

    return prompts.withColumn(out, answers(F.col(prompt)))
