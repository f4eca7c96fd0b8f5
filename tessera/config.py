"""Settings, passed on explicitly; the values are the fixed ones that results depend on."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    k: int = 5
    depth: int = 20
    rerank_depth: int = 10
    fusion_constant: int = 10
    fusion_weights: tuple[float, ...] = (2.0, 1.0)
    least_score: float = 0.003
    #: Short names of generators, and how many tokens each may write.
    tiers: Mapping[str, str] = field(default_factory=lambda: {"turbo": "small-instruct", "large": "large-instruct"})
    limits: Mapping[str, int] = field(default_factory=lambda: {"large-instruct": 1536})
    default_limit: int = 512
    reasoning: str = r"(?i)(reason|think|r1)"
    context_tokens: int = 8192


def resolve_corpus(documents: Sequence[str], variants: Mapping[str, Sequence[str]], variant: str) -> list[str]:
    """Names of a corpus: the documents that all share, and those of one variant out of several that exclude each other."""
    if variant not in variants:
        raise ValueError(f"unknown variant {variant!r}: one of {sorted(variants)}")
    return [*documents, *variants[variant]]


def model_prefix(model: Column, kind: str) -> Column:
    """What a model of the e5 family wants before a text: kind is query or passage."""
    return F.when(F.lower(model).contains("e5"), f"{kind}: ").otherwise("")


def tier_model(tier: Column, config: Config) -> Column:
    """A generator by its short name; any other name is one already."""
    known = F.create_map(*(F.lit(x) for pair in config.tiers.items() for x in pair))
    return F.coalesce(F.try_element_at(known, tier), tier)


def token_limit(model: Column, config: Config) -> Column:
    known = F.create_map(*(F.lit(x) for pair in config.limits.items() for x in pair))
    return F.coalesce(F.try_element_at(known, model), F.lit(config.default_limit))


def reasons(model: Column, config: Config) -> Column:
    """Does the model think aloud, so that it must be told not to?"""
    return model.rlike(config.reasoning)


def options(model: str, config: Config) -> dict:
    """What a generator is called with."""
    found = {"temperature": 0, "context": config.context_tokens, "limit": config.limits.get(model, config.default_limit)}
    return found | ({"think": False} if re.search(config.reasoning, model) else {})
