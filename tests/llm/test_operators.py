"""Dealt operators against brute force, on small tables with nulls, empty texts, copies, clashing columns."""

import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

import tessera.llm.near_duplicates as near
from tessera.llm.components import components
from tessera.llm.decontamination import blocks_of_items, decontaminate
from tessera.llm.language import ContextTrees, score_languages, train_language_model
from tessera.llm.language_model import OCTAVES, STEPS, _step, learn_weights, score_texts
from tessera.llm.near_duplicates import CHILDREN, COORDINATES, MISSED, branches, link_near_duplicates, missed, paths, trees_for
from tessera.llm.packing import pack_documents
from tessera.llm.quality import score_quality, train_quality_model
from tessera.llm.queries import vocabulary
from tessera.llm.shared import Scratch
from tessera.llm.token_counts import count_tokens
from tessera.llm.token_files import decode_chunk, encode_chunk, read_token_files, write_token_files
from tessera.llm.toxicity import score_toxicity, train_toxicity
from tessera.llm.vector_duplicates import link_vectors

SCHEMA = "doc_id long, text string, lang string, n long, node long, score double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    out = [(None, "no id at all", "en"), (1, None, None), (2, "", "en"), (3, " \n", "en"), (4, "one", "en"), (4, "one", "en"), (5, "Two words", "fr")]
    for i in range(10, 60, 5):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        for j in range(5):
            new = list(base)
            for _ in range(j):
                new[rng.randrange(len(new))] = rng.choice(words)
            out.append((i + j, " ".join(new), rng.choice(["en", "fr"])))
    out.append((99, "long " + " ".join(rng.choice(words) for _ in range(60_000)), "en"))
    return [(*r, 1, 1, 0.5) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _roots(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b", Scratch(spark), "roots").collect()}
    assert got == _roots({x for p in links for x in p}, links)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b", Scratch(spark), "roots").count() == 0


@pytest.mark.parametrize("size,percent,small", [(3, 85, 1000), (5, 80, 1000), (3, 85, 3)])
def test_near_duplicates(spark, docs, rows, size, percent, small):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").lower().split()
        if i is not None:
            sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = link_near_duplicates(docs, shingle=size, similarity=percent / 100, small=small).collect()
    assert len(found) == len(rows) and links
    root = _roots(sets, links)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == root  # whole nodes and blocks of three alike
    assert {r.doc_id: r.n_shingles for r in found if r.doc_id is not None} == {i: len(s) for i, s in sets.items()}
    assert link_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("percent,small", [(80, 1), (80, 1000), (85, 1)])
def test_near_duplicates_at_the_threshold(spark, percent, small):
    """Pairs of exactly the threshold; with small = 1 every node of theirs branches."""
    made = []
    for i in range(1000):
        shared = [f"{i}-{x}" for x in range(2 * percent)]
        made += [(2 * i + j, " ".join([*shared, *(f"{i}-{j}-{x}" for x in range(100 - percent))])) for j in (0, 1)]
    found = link_near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(4), shingle=1, similarity=percent / 100, small=small).collect()
    parted = sum(r.kept for r in found) - 1000
    assert all(r.component_id // 2 == r.doc_id // 2 for r in found)
    assert parted == 0  # by branching 13, by the sketch's cut 2 of 1000 pairs were lost at 0.8


def test_sketches_that_fall_short():
    """Four deviations below the threshold a pair is still a candidate; full sets are compared without any sketch."""
    signs = np.zeros((2, COORDINATES), np.uint8)
    signs[1, : round(COORDINATES * (1 - 0.85 + 4 * (0.85 * 0.15 / COORDINATES) ** 0.5))] = 1
    pair = [{"node": 1, "class": c, "sign": x.tobytes(), "n": 100} for c, x in zip((b"a", b"b"), signs, strict=True)]
    assert near._forest(0.85)(pair) == [(1, b"a", b"b")]
    rng, sets = np.random.default_rng(4), []
    for i in range(60):
        base = rng.integers(0, 1 << 48, rng.integers(20, 40), dtype=np.uint64)
        sets += [np.unique(np.concatenate([base, rng.integers(0, 1 << 48, k, dtype=np.uint64)])) for k in (0, 2, 5, 30)]
    rows = [{"node": 1, "class": b"%03d" % i, "sign": rng.bytes(COORDINATES), "shingles": near.packed(x), "root": b"%03d" % i} for i, x in enumerate(sets)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    found = [(int(a), int(b)) for a, b in near._exhaustive(85)(rows)]
    assert links and _roots(range(len(sets)), found) == _roots(range(len(sets)), links)


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_trees_reach_their_recall(similarity):
    """Simulated sketches of pairs at the threshold against the computed share of pairs that no tree brings together."""
    trees, rng = trees_for(similarity), np.random.default_rng(2)
    lost = {0: 0, CHILDREN: 0}
    for _ in range(20):
        a, b = rng.integers(0, 1 << 32, (2, 10_000, COORDINATES), dtype=np.uint64)
        b = np.where(rng.random(b.shape) < similarity, a, b)
        x, y = paths(a, trees), paths(b, trees)
        lost[0] += int((x != y).all(1).sum())
        met = np.zeros(len(a), bool)
        for t in range(trees):
            met |= (branches(x[:, t], a.astype(np.uint8)) == branches(y[:, t], b.astype(np.uint8))).any(1)
        lost[CHILDREN] += int((~met).sum())
    for children, n in lost.items():
        assert missed(similarity, trees, children) <= MISSED and n <= 2.5 * MISSED * 200_000


@pytest.mark.parametrize("leaf", [4, 64, 4096])
def test_vectors(spark, leaf):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 16))
    x[20:60] = x[0] + rng.normal(size=(40, 16)) * 0.2
    x[60:64] = x[3]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, []), (204, [1.0, 2.0]), (205, [1.0, 2.0]), (206, [None] * 16)]
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95 - 1e-12]
    n, root = Counter(x for p in links for x in p), _roots([i for i, _ in rows], links)
    got = link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.95, leaf=leaf).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n[i], root[i], root[i] == i) for i, _ in rows}
    assert len(links) > 40


def test_language_model(spark, docs, rows):
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 10
    split = [(i, [*(t or "").lower().split(), None]) for i, t, *_ in rows]
    c = Counter(w for i, ws in split if fold(i) for w in ws)
    total, distinct = sum(c.values()), len(c)
    got = score_texts(docs).collect()
    expected = Counter((i, fold(i) == 0, len(ws), sum(c[w] > 0 for w in ws), total, round(sum(log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), 6)) for i, ws in split)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert score_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rare_words_of_large_tables_keep_their_probability():
    """c / N far below 2^-30 comes back from the histogram within half a step, and the weights follow it."""
    p = np.array([1.0, 0.5, 2.0**-30, 2.0**-33, 3 / 5e9, 2.0**-63])
    back = np.exp2(-(_step(p) - 1) / STEPS)
    assert np.allclose(np.log2(back), np.log2(p), rtol=0, atol=0.5 / STEPS + 1e-9)
    assert _step(np.array([0.0, 2.0**-64])).tolist() == [0, 1 + STEPS * 64] and STEPS * OCTAVES + 1 < 1000
    cell = (5 * 1000 + 0) * 1000 + int(_step(np.array([2.0**-34]))[0])
    weights = learn_weights({cell: 1_000_000}, 2.0**-32)[5]
    assert weights[2] > 0.99  # the uniform estimate is 4 times the word's


def test_tokens(spark, docs, rows):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in rows]
    assert Counter((r.doc_id, r.n_tokens) for r in count_tokens(docs, path).collect()) == Counter((i, len(x) - 1) for i, x in ids)
    pieces = pack_documents(docs, path, 1, with_ids=True).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(i for i, _ in ids)
    whole = {i: x for i, x in ids}
    assert all(p.ids == whole[p.doc_id][p.start : p.start + p.length] for p in pieces)
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in ids)
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048


def test_token_files(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    write_token_files(docs, f"file://{tmp_path}/t", path, 1)
    at = 0
    read = read_token_files(spark, f"file://{tmp_path}/t", with_ids=True).orderBy("start").collect()
    wanted = Counter((i, *library.encode(t or "", add_special_tokens=False).ids, 1) for i, t, *_ in rows)
    assert Counter((r.doc_id, *r.ids) for r in read) == wanted
    assert [r.doc_id for r in read] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    for r in read:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += len(r.ids)
    for planes in ("byte", "bit"):
        x = np.random.default_rng(0).integers(0, 50_000, 1001).astype(np.uint32)
        assert (decode_chunk(encode_chunk(x, planes)) == x).all()


def test_decontamination(spark, docs, rows):
    source = rows[30][1].split()
    items = [(1, " ".join(source[:12])), (2, "nowhere to be found"), (3, None), (4, "Two words!"), (None, "no id"), (None, None)]
    got = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    assert len(got) == len(rows)
    for r in got:
        words = (next(t for i, t, *_ in rows if i == r.doc_id) or "").lower().split()
        hit, found = set(), set()
        for item, text in items:
            own = (text or "").lower().replace("!", "").split()
            for j in range(max(1, len(own) - 9) if own else 0):
                window = own[j : j + 10]
                for a in range(len(words) - len(window) + 1):
                    if words[a : a + len(window)] == window:
                        hit |= set(range(a, a + len(window)))
                        found |= {str(item)} - {"None"}
        assert (r.n_words, r.n_hit, sorted(r.items), r.contaminated) == (len(words), len(hit), sorted(found), bool(hit))


def test_learned_scores(spark, docs):
    rng = random.Random(5)
    good, bad = [f"fine{i}" for i in range(40)], [f"junk{i}" for i in range(40)]
    made = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(30)), "aa" if i % 2 else "bb", i % 2) for i in range(200)]
    learned = spark.createDataFrame(made, "doc_id long, text string, lang string, label int")
    model = train_quality_model(learned, label_col="label")
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in score_quality(learned, model, ["doc_id"]).collect())
    trees = train_language_model(learned)
    assert all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in score_languages(learned, trees, ["doc_id"]).collect())
    lexicon = train_toxicity(learned, label_col="label")
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in score_toxicity(learned, lexicon, ["doc_id"]).collect())
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string, label int")
    for found in (score_quality(docs, train_quality_model(nothing, label_col="label"), ["doc_id"]), score_languages(docs, train_language_model(nothing), ["doc_id"]), score_toxicity(docs, train_toxicity(nothing, label_col="label"), ["doc_id"])):
        assert found.count() == docs.count() and all(0 <= r.score <= 1 for r in found.collect())
    assert {r.lang_pred for r in score_languages(docs, trees, ["doc_id"]).collect() if r.doc_id in (1, 2, 3)} == {"und"}


def test_pipeline_gives_token_ids(spark, docs, rows):
    import corpus_pipeline

    pieces = corpus_pipeline.packing(spark, docs, "").collect()
    assert all(len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)
    assert {p.doc_id for p in pieces} == {i for i, *_ in rows}


def test_every_language_is_learned(spark):
    """200 languages of long texts, and one whose only text stands in 30 copies beside many others."""
    rng = random.Random(11)
    rows = []
    for lang in range(200):
        own = [f"{chr(0x4E00 + 40 * lang + rng.randrange(40))}{chr(0x4E00 + 40 * lang + rng.randrange(40))}" for _ in range(20)]
        rows += [(1000 * lang + i, " ".join(rng.choice(own) for _ in range(300)), f"l{lang:03d}") for i in range(12)]
    rows += [(900_000 + i, "the one text of it", "xx") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    trees = train_language_model(table, train_bytes=2000, train_chars=400)
    assert trees.languages == sorted({r[2] for r in rows})
    got = {r["doc_id"]: r["lang_pred"] for r in score_languages(table, trees, ["doc_id"]).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) / len(rows) > 0.99


def _bits(texts, word, order):
    """Code length of a word by counting contexts as the definition has it, one byte after the other."""
    words = [b" " + w.encode() + b" " for t in texts for w in t.split()]

    def cost(context, byte):
        if context is None:
            return 8.0
        seen = Counter(w[i] for w in words for i in range(1, len(w)) if len(context) <= i and w[i - len(context) : i] == context)
        n, q = sum(seen.values()), len(seen)
        shorter = context[1:] if context else None
        if not n:
            return cost(shorter, byte)
        return -np.log2(seen[byte] / (n + q)) if seen[byte] else -np.log2(q / (n + q)) + cost(shorter, byte)

    own = b" " + word.encode() + b" "
    return sum(cost(own[max(0, i - order) : i], own[i]) for i in range(1, len(own)))


def test_code_lengths_equal_the_definition(spark):
    texts = {"a": ["the cat sat on the mat", "that hat"], "b": ["el gato se sienta", "está allí"]}
    trees = ContextTrees(["a", "b"], texts, 3)
    words = ["the", "gato", "hats", "zz", "é"]
    want = [[_bits(texts[lang], w, 3) for lang in ("a", "b")] for w in words]
    assert np.allclose(trees.words(words), want)


def test_repeated_items_are_one(spark):
    items = spark.createDataFrame([(i % 3, "one two three") for i in range(2000)], "item_id int, text string")
    blocks = list(blocks_of_items(items, "item_id", "text", 1 << 20))
    assert sum(map(len, blocks)) == 3
