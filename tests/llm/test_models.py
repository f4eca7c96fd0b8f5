"""Learned models against their definitions: quality and toxicity scores word by word, probabilities that add up, expectation-maximisation by hand."""

import math
import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm.language_model import CONTEXT_BUCKETS, EM_ROUNDS, STEPS, _bucket, _step, learn_weights, score_texts
from tessera.llm.quality import BIGRAMS, BUCKETS, GRAMS, QualityModel, document_features, fit
from tessera.llm.toxicity import Lexicon, fold, learn_lexicon

_FACTOR, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def _word_features(word):
    """Its hash, and the buckets of the word and its n-grams, by whole numbers."""
    raw = [b + 1 for b in f"<{word}>".encode()]
    name, power = 0, 1
    for b in raw:
        power = power * _FACTOR & _MASK
        name = (name + b * power) & _MASK
    name = _mix(name)
    found = [name % BUCKETS]
    for n in GRAMS:
        for a in range(len(raw) - n + 1):
            gram = n
            for b in raw[a : a + n]:
                gram = (gram * _FACTOR + b) & _MASK
            found.append(_mix(gram) % BUCKETS)
    return name, found


def _logit(text, weights, bias):
    words = text.split()
    features = [_word_features(w) for w in words]
    z = bias
    if words:
        z += sum(sum(float(weights[b]) for b in f) / len(f) for _, f in features) / len(words)
    if len(words) > 1:
        z += sum(float(weights[BUCKETS + _mix((a * _FACTOR + b) & _MASK) % BIGRAMS]) for (a, _), (b, _) in zip(features, features[1:])) / (len(words) - 1)
    return z


TEXTS = ["", " ", "one", "çok güzel  bir\tgün", "a b a b a b", "x" * 300 + " tail", "the same text twice"] + ["the same text twice"]


def test_quality_scores_word_by_word():
    rng = np.random.default_rng(3)
    model = QualityModel(rng.normal(size=BUCKETS + BIGRAMS), 0.25)
    score = model.scorer()
    for texts in (TEXTS, TEXTS[::-1]):
        got = score(pa.array(texts))[0].to_pylist()
        assert np.allclose(got, [1 / (1 + math.exp(-_logit(t, model.weights, 0.25))) for t in texts], rtol=0, atol=1e-6)


def test_features_carry_what_scores_use():
    """A document's features in training give the logit that scoring gives."""
    weights = np.random.default_rng(5).normal(size=BUCKETS + BIGRAMS).astype(np.float32)
    for text, (buckets, shares) in zip(TEXTS, document_features(pa.array(TEXTS)), strict=True):
        assert abs(float(weights[buckets] @ shares) - _logit(text, weights, 0.0)) < 1e-5


def test_training_separates_and_keeps_the_shares():
    rng = random.Random(4)
    texts = [(" ".join(rng.choice(["alpha", "beta", "gamma"] if y else ["delta", "beta", "omega"]) for _ in range(20)), y) for y in (0, 1) for _ in range(60)]
    rows = [(b, w, y) for (b, w), (_, y) in zip(document_features(pa.array([t for t, _ in texts])), texts, strict=True)]
    model = fit(rows, 0.5)
    scores = model.scorer()(pa.array([t for t, _ in texts]))[0].to_pylist()
    assert all((s > 0.5) == bool(y) for s, (_, y) in zip(scores, texts, strict=True))
    assert fit(rows, 0.9).bias - model.bias > 2 and fit(rows[:60], 0.3).bias == math.log(0.3 / 0.7)


def _naive_features(lexicon, words):
    """Every entry tried at every place."""
    text = f" {' '.join(words)} "
    spans = [(i, i + len(e) + 1) for e in lexicon.exceptions for i in range(len(text)) if text.startswith(f" {e} ", i)]
    total = 0.0
    for i in range(len(text)):
        here = [(w, i + len(e) - 1) for e, w in lexicon.entries.items() if text.startswith(e, i)]
        if here:
            best = max(w for w, _ in here)
            # Of entries of one weight the first that is met, which ends first, counts.
            end = min(e for w, e in here if w == best)
            if not any(a <= i and end <= b for a, b in spans):
                total += best
    return (math.log1p(total), 100 * total / len(words)) if words else (0.0, 0.0)


def test_toxicity_features_equal_every_entry_at_every_place():
    rng = random.Random(9)
    lexicon = Lexicon({" bad ": 2.0, " ba": 1.5, " worse": 3.0, " worst ": 3.0}, ["bad luck", "not bad luck"])
    automaton = lexicon.automaton()
    for _ in range(300):
        words = [rng.choice(["bad", "badly", "luck", "not", "worse", "worst", "fine"]) for _ in range(rng.randrange(12))]
        assert np.allclose(lexicon.features(automaton, words), _naive_features(lexicon, words)), words


def test_folding_of_disguises():
    assert fold("B4d  ã") == ["bad", "a"] and fold("вас") == ["bac"] and fold("ｂａｄ") == ["bad"] and fold("b​ad") == ["bad"]
    assert fold("l1i") == ["iii"] and fold("a-b") == ["a", "b"] and unicodedata.category("​") == "Cf"


def test_lexicon_learns_words_and_exceptions():
    rng = random.Random(2)
    neutral = [f"word{c}" for c in "abcdefghkm"]
    say = lambda *more: " ".join([*(rng.choice(neutral) for _ in range(12)), *more, rng.choice(neutral)])
    texts = [(say("zorgle"), 1) for _ in range(40)] + [(say(), 0) for _ in range(60)]
    lexicon = learn_lexicon(texts)
    assert any(e.strip().startswith("zorg") for e in lexicon.entries) and not any(e.strip().startswith("word") for e in lexicon.entries)
    automaton = lexicon.automaton()
    score = lambda t: lexicon.score(lexicon.features(automaton, fold(t)))
    assert score("a z0rgle b") > 0.7 > 0.3 > score("worda wordb") and 0 <= score("") <= 1


def _em(cells, uniform):
    """Rounds by hand for one bucket of contexts."""
    out = {}
    for bucket in sorted({c // 1_000_000 for c in cells}):
        own = [(c // 1000 % 1000, c % 1000, n) for c, n in cells.items() if c // 1_000_000 == bucket]
        weights = [0.4, 0.4, 0.2]
        for _ in range(EM_ROUNDS):
            total = [1.0, 1.0, 1.0]
            for a, b, n in own:
                p = [2 ** (-(a - 1) / STEPS) if a else 0.0, 2 ** (-(b - 1) / STEPS) if b else 0.0, uniform]
                mixed = [w * x for w, x in zip(weights, p)]
                for k in range(3):
                    total[k] += n * mixed[k] / sum(mixed)
            weights = [t / sum(total) for t in total]
        out[bucket] = weights
    return out


def test_weights_equal_rounds_by_hand():
    rng = random.Random(6)
    cells = {(b * 1000 + rng.randrange(0, 40)) * 1000 + rng.randrange(1, 60): rng.randrange(1, 500) for b in (3, 4, 9) for _ in range(20)}
    got, want = learn_weights(cells, 1e-4), _em(cells, 1e-4)
    for bucket, weights in want.items():
        assert np.allclose(got[bucket], weights)
    assert got.shape == (CONTEXT_BUCKETS, 3) and np.allclose(got.sum(1), 1)
    assert np.allclose(got[5], got[4]) and got[0][0] == 0


def test_scores_are_logarithms_of_probabilities(spark):
    """The mixture by counts of words and pairs gives every document's score, and its probabilities of all next words add up to 1."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(1, 30)))) for i in range(120)]
    held = lambda i: zlib.crc32(str(i).encode()) % 10
    split = {i: [*t.split(), None] for i, t in rows}
    word, pair, start = {}, {}, 0
    fit_word, fit_pair, fit_start = {}, {}, 0
    for i, ws in split.items():
        if held(i):
            before = "^"
            start += 1
            fit_start += held(i) != 1
            for w in ws:
                word[w] = word.get(w, 0) + 1
                pair[before, w] = pair.get((before, w), 0) + 1
                if held(i) != 1:
                    fit_word[w] = fit_word.get(w, 0) + 1
                    fit_pair[before, w] = fit_pair.get((before, w), 0) + 1
                before = w
    total, distinct = sum(word.values()), len(word)
    fit_total, cells = sum(fit_word.values()), {}
    for i, ws in split.items():
        if held(i) == 1:
            before = "^"
            for w in ws:
                c = fit_start if before == "^" else fit_word.get(before, 0)
                p = np.array([fit_pair.get((before, w), 0) / max(c, 1), fit_word.get(w, 0) / max(fit_total, 1)])
                cell = (int(_bucket(np.array([c]))[0]) * 1000 + int(_step(p[:1])[0])) * 1000 + int(_step(p[1:])[0])
                cells[cell] = cells.get(cell, 0) + 1
                before = w
    weights = learn_weights(cells, 1 / (distinct + 1))

    def probability(before, w):
        c = start if before == "^" else word.get(before, 0)
        a, b, u = weights[int(_bucket(np.array([c]))[0])]
        return a * pair.get((before, w), 0) / max(c, 1) + b * word.get(w, 0) / total + u / (distinct + 1)

    for before in ["^", *(w for w in word if w is not None)]:
        assert abs(sum(probability(before, w) for w in [*word, "unknown"]) - 1) < 1e-9
    got = {r["doc_id"]: r["score"] for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, ws in split.items():
        assert abs(got[i] - sum(math.log10(probability(b, w)) for b, w in zip(["^", *ws], ws))) < 1e-6
