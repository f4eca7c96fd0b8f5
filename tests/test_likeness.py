"""Fuzzy likeness against every part of a text, and the bootstrap against draws of collected rows."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import tessera.operators.metrics as metrics
from tessera.functions.similarity import partial, ratio
from tessera.operators.golden import anchor_status


def _every_part(a, b):
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    return max(ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))


@settings(max_examples=300, deadline=None)
@given(st.text("abç 😀", max_size=14), st.text("abç 😀", max_size=40), st.sampled_from([0.0, 60.0, 85.0]))
def test_partial_equals_every_part(a, b, least):
    best = _every_part(a, b)
    assert partial(a, b, least) == (best if best >= least else 0.0)


def test_long_page_in_bounded_time():
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    page = " ".join(rng.choice(words) for _ in range(170_000))
    quote = page[500_000:500_200]
    spoilt = "".join("#" if i % 17 == 0 else c for i, c in enumerate(quote))
    start = time.time()
    assert len(page) > 900_000 and partial(spoilt, page, 85.0) >= 85.0
    assert partial("".join(rng.sample(quote, len(quote))), page, 85.0) == 0.0
    assert time.time() - start < 60


def test_fuzzy_status(spark):
    pages = spark.createDataFrame([("d", 1, "The quick brown fox jumps over the lazy dog."), ("d", 2, "Nothing of it.")], "doc string, page_no int, text string")
    anchors = spark.createDataFrame([("q", 0, "d", 1, "quick brwn fox jumqs over"), ("q", 1, "d", 2, "quick brwn fox jumqs over"), ("q", 2, "d", 1, "quick brown")], "id string, place int, doc string, page int, quote string")
    assert {r["place"]: r["status"] for r in anchor_status(anchors, pages).collect()} == {0: "fuzzy", 1: "not_found", 2: "ok"}


def _areas(p, a, w):
    pos, neg = p, ~p
    won = (a[pos][:, None] > a[neg][None]) + 0.5 * (a[pos][:, None] == a[neg][None])
    both = w[pos][:, None] * w[neg][None]
    return (won * both).sum() / both.sum()


@pytest.mark.parametrize("hot", [False, True])
def test_bootstrap_equals_collected_form(spark, hot):
    """The same weights over collected rows give the same interval; draws with replacement one near it."""
    rng, rounds = np.random.default_rng(4), 300
    p = rng.random(200) < 0.5
    a, b = p + rng.normal(size=200), np.round(p * 0.3 + rng.normal(size=200), 1)
    if hot:
        a[::2] = 0.25
    rows = spark.createDataFrame([(int(i), bool(x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(p, a, b))], "id int, p boolean, a double, b double").repartition(3)
    found = metrics.paired_bootstrap(rows, F.col("p"), F.col("a"), F.col("b"), F.col("id"), rounds).first()
    hashes = {r["id"]: r["h"] for r in rows.select("id", F.xxhash64("id").alias("h")).collect()}
    w = metrics.poisson(np.array([hashes[i] for i in range(200)], np.int64).astype(np.uint64), np.arange(rounds, dtype=np.uint64)).astype(float)
    deltas = sorted(_areas(p, a, w[:, r]) - _areas(p, b, w[:, r]) for r in range(rounds))
    assert abs(found["low"] - deltas[int(0.025 * rounds)]) < 1e-9 and abs(found["high"] - deltas[int(0.975 * rounds)]) < 1e-9
    drawn = [np.bincount(np.concatenate([rng.choice(np.flatnonzero(s), s.sum()) for s in (p, ~p)]), minlength=200).astype(float) for _ in range(rounds)]
    other = sorted(_areas(p, a, x) - _areas(p, b, x) for x in drawn)
    width = other[int(0.975 * rounds)] - other[int(0.025 * rounds)]
    assert abs(found["low"] - other[int(0.025 * rounds)]) < 0.35 * width and abs(found["high"] - other[int(0.975 * rounds)]) < 0.35 * width


def test_weights_are_poisson():
    w = metrics.poisson(np.arange(2000, dtype=np.uint64), np.arange(200, dtype=np.uint64))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert np.abs(np.corrcoef(w[:, :20].T.astype(float)) - np.eye(20)).max() < 0.12
