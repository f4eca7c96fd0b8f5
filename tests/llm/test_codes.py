"""Vector codes, secret scans and periodic runs against brute force, with nulls, empty and long texts, copies, clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm.periodic_runs import collapsed, find_runs, runs_of
from tessera.llm.secret_scan import CLASSES, ENTROPY, Scanner, ALLOWED, PATTERNS, CharacterClass, scan_secrets
from tessera.llm.vector_codes import code_vectors, integers, nearest

ODD = "doc_id long, text string, kind string, runs string, `my col` int, hash int"


def _lloyd(rows, parts, entries, rounds, scale=256):
    """rows: (id, vector, label) without nulls. Per row (id, code, error), and the codebooks, all with Python's integers."""
    d = max(len(v) for _, v, _ in rows)
    d += -d % parts
    cut = d // parts
    whole = [[math.floor(scale * x) for x in v] + [0] * (d - len(v)) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    books = [[whole[i][p * cut : (p + 1) * cut] for i in order[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in whole:
            far = [[sum((x - y) ** 2 for x, y in zip(v[p * cut : (p + 1) * cut], e)) for e in books[p]] for p in range(parts)]
            out.append(([f.index(min(f)) for f in far], sum(map(min, far))))
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * cut : (p + 1) * cut] for v, (code, _) in zip(whole, found) if code[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    return [(r[0], bytes(code), error) for r, (code, error) in zip(rows, assign())], books


@pytest.mark.parametrize("scale_up", [1.0, 4e5])
def test_vector_codes(spark, scale_up):
    """Sums kept by differences end in the codebooks of sums made anew; at the larger scale distances leave the doubles."""
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(60)]), [rng.choice([-1, 1]) * rng.random() * scale_up for _ in range(12)], None if i % 3 else i % 2) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 400 + i) for i in range(40)]
    bad = [(5, None, 1), (6, [1.0, None] * 6, 1), (7, [float("nan")] * 12, 1), (8, [float("inf")] * 12, None)]
    table = spark.createDataFrame([(*r, 1, 1, "x") for r in rows + bad], "vec_id long, embedding array<double>, label int, code int, error int, slot string").repartition(5)
    found = code_vectors(table, parts=4, entries=7, rounds=3)
    want, books = _lloyd(rows, 4, 7, 3)
    got = found.rows.collect()
    assert Counter((r["vec_id"], bytes(r["code"]), r["error"]) for r in got) == Counter(want)
    assert found.codebooks.tolist() == books
    sums = Counter()
    for (_, _, label), (_, _, error) in zip(rows, want):
        sums[label] += error
    assert {r["label"]: r["label_error"] for r in got} == dict(sums)


def test_vector_codes_of_few_empty_and_uneven(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert code_vectors(spark.createDataFrame([], schema)).rows.collect() == []
    rows = [(1, [0.5] * 5, "a"), (2, [], None), (3, [0.25] * 17, "a"), (3, [0.25] * 17, "a")]
    found = code_vectors(spark.createDataFrame(rows, schema))
    want, _ = _lloyd([(i, v, label) for i, v, label in rows], 16, 64, 2)
    assert sorted((r["vec_id"], bytes(r["code"]), r["error"]) for r in found.rows.collect()) == sorted(want)
    with pytest.raises(ValueError):
        code_vectors(spark.createDataFrame(rows, schema), entries=300)


def test_integers_are_held_and_ties_go_to_the_lower_entry():
    held = integers([[1e300, -1e300, 0.999 / 256]], 4, 256)
    assert held[0, 0] == -held[0, 1] > 10**8 and held[0, 2] == 0
    codes, errors = nearest(np.array([[[1, 1]]]), np.array([[[0, 1], [2, 1], [1, 0]]]))
    assert codes.tolist() == [[0]] and errors.tolist() == [[1]]


def _entropy(w):
    return math.log2(len(w)) - sum(c * math.log2(c) for c in Counter(w).values()) / len(w)


def _random_spans(text, classes):
    """Every window of every unbroken string by itself."""
    marks = [0] * len(text)
    for own in classes:
        inside = [bool(re.match(f"[{own.characters}]", c)) for c in text]
        for i in range(len(text) - own.window + 1):
            w = text[i : i + own.window]
            if all(inside[i : i + own.window]) and _entropy(w) >= own.bits and all(re.search(f"[{g}]", w) for g in own.groups):
                marks[i : i + own.window] = [1] * own.window
    return marks


def test_windows_of_entropy_equal_brute_force():
    rng = random.Random(8)
    own = (CharacterClass("a-d0-3", 6, 1.7, ("a-d", "0-3")), CharacterClass("A-Z", 5, 2.0, ()))
    scanner = Scanner((), own, ())
    for _ in range(300):
        text = "".join(rng.choice("aabbcd0123 XYZ") for _ in range(rng.randrange(60)))
        marks = [0] * len(text)
        for a, b, kind in scanner.scan(text)[1]:
            assert kind == ENTROPY
            marks[a:b] = [1] * (b - a)
        assert marks == _random_spans(text, own), text


def test_kinds_of_secrets():
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = "".join(rng.choice(letters) for _ in range(64))
    hexa = "".join(rng.choice("0123456789ABCDEF") for _ in range(48))
    scanner = Scanner(PATTERNS, CLASSES, ALLOWED)

    def kinds(text):
        known, spans = scanner.scan(text)
        return [(text[a:b], k) for a, b, k in known], [text[a:b] for a, b, k in spans if k == ENTROPY]

    assert kinds(f"key {key}== end") == ([], [key + "=="])
    assert kinds(f"é {hexa}.") == ([], [hexa])
    # Allowed: named digests, links, data, placeholders, ids; inside a known span nothing is added.
    for text in (f"sha256:{key}", f"see https://a.example/{key}?x", f"data:image/png;base64,{key}", f"{key}EXAMPLE", "id 6F9619FF-8B86-D011-B42D-00C04FC964FF", "plain words and Donaudampfschifffahrtsgesellschaftskapitaen", "getUserAccountInformationFromDatabaseById", "-" * 100):
        assert kinds(text) == ([], []), text
    known, added = kinds(f'Api_Key = "{key}" AKIA{"A1" * 9} deadbeef01234567 token: short password=token=abcdefghijkl')
    assert [k for _, k in known] == ["assign", "access", "hex", "assign"] or [k for _, k in known] == ["assign", "assign", "access", "hex"]
    assert known[0][0].startswith("Api_Key") and added == []
    # A short match is consumed: what follows in it isn't asked again. Letters of other alphabets don't count as a case.
    assert kinds("secret: token: abcdefghijklmno")[0] == []
    assert kinds("\u017fecret=abcdefghijklmnop")[0] == [] and kinds("to\u212aen=abcdefghijklmnop")[0] == []


def test_secrets_of_odd_rows(spark):
    long = "word " * 200_000 + "token=abcdefghijklmnop" + "a1B2" * 200_000
    rows = [(1, None), (2, ""), (None, "secret='0123456789abcdef'"), (None, "secret='0123456789abcdef'"), (3, long)]
    found = scan_secrets(spark.createDataFrame([(*r, "k", "r", 1, 2) for r in rows], ODD), ["doc_id", "kind", "my col"]).collect()
    assert len(found) == 5 and found[0].asDict().keys() == {"doc_id", "kind", "my col", "known", "spans"}
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by[1]["known"] == by[2]["spans"] == []
    assert [(s["start"], s["kind"]) for s in by[3]["known"]] == [(1_000_000, "assign")]
    odd = [r for r in found if r["doc_id"] is None]
    assert odd[0]["known"] == odd[1]["known"] and [s["kind"] for s in odd[0]["known"]] == ["assign", "hex"]
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).collect() == []


def _runs(words, least, exponent):
    """By every period, the stretches in which words so far apart are equal; of equal stretches the smallest period."""
    seen = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                seen.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (1, 3)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(60))]
            if words and rng.random() < 0.5:
                a, p = rng.randrange(len(words)), rng.randrange(1, 8)
                words = [words[i] if i < a else words[min(len(words) - 1, a + (i - a) % p)] for i in range(len(words))]
            texts.append(words)
        assert runs_of(texts, least, exponent) == [_runs(w, least, exponent) for w in texts]


def test_runs_of_odd_rows(spark):
    line = [f"w{i}" for i in range(500)]
    rows = [(1, None), (2, " \n"), (None, "a b a b a b a b c"), (None, "a b a b a b a b c"), (3, "x\x0by z " * 3), (4, " ".join(["start", *line * 5, "end"])), (5, "a " * 300_000)]
    found = find_runs(spark.createDataFrame([(*r, "k", "r", 1, 2) for r in rows], ODD), ["doc_id", "hash"]).collect()
    by = {r["doc_id"]: r for r in found}
    listed = {k: [tuple(x) for x in r["runs"]] for k, r in by.items()}
    assert listed[1] == listed[2] == listed[3] == [] and (by[1]["n_words"], by[1]["collapsed"]) == (0, "")
    assert listed[None] == [(0, 8, 2)] and by[None]["collapsed"] == "a b c"
    assert by[3]["collapsed"] == " ".join(["x", "y z"] * 3)
    assert listed[4] == [(1, 2500, 500)] and by[4]["collapsed"] == " ".join(["start", *line, "end"])
    assert listed[5] == [(0, 300_000, 1)] and by[5]["collapsed"] == "a"
    assert len(found) == 7
    assert find_runs(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).collect() == []


def test_words_under_several_runs_go_once():
    words = list("aaaaaabaaaaaab")
    runs = [(0, 6, 1), (7, 6, 1)]
    assert "".join(collapsed(words, runs)) == "abab"
