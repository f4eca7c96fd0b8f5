"""The stages of the pipeline against brute force, on a small fixture with null and repeated ids."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm.queries import CAPACITY, END_ID, vocabulary

SCHEMA = "doc_id long, text string, lang string, n long, row string"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder of tables, and the rows: languages aa and bb, of which texts in junk words are of low quality."""
    rng = random.Random(7)
    words = {("aa", 1): [f"alma{i}ka" for i in range(80)], ("bb", 1): [f"sturz{i}en" for i in range(80)], ("aa", 0): [f"alma{i}xjunk" for i in range(40)], ("bb", 0): [f"sturz{i}xjunk" for i in range(40)]}
    text = lambda lang, good, n=60: " ".join(rng.choice(words[lang, good]) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        lang, good = "ab"[i % 2] * 2, int(i % 4 < 3)
        rows.append((i, text(lang, good), lang))
        labels.append((i, good))
    leak = rows[0][1].split()[5:25]
    rows += [(None, text("aa", 1), "aa"), (None, text("bb", 1), "bb"), (None, text("aa", 0), "aa"), (None, None, None), (None, "", "aa"), (500, " ", "bb"), (501, "12 34 -- 56", "aa")]
    rows += [(502, text("aa", 1), "aa"), (502, text("bb", 1), "bb"), (502, text("bb", 0), "bb")]  # an id of different rows
    once = text("aa", 1)
    rows += [(503, once, "aa"), (503, once, "aa"), (504, once, "aa"), (None, once, "aa")]  # copies, of one id and of others
    base = text("bb", 1, 100).split()
    rows += [(510 + i, " ".join([*base[: 98 - i], *(f"sturz{i}{j}en" for j in range(2 + i))]), "bb") for i in range(4)]  # near copies
    rows += [(520, " ".join([*text("aa", 1).split(), *leak, *text("aa", 1).split()]), "aa")]
    rows = [(*r, 7, f"row {k}") for k, r in enumerate(rows)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxicity int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(leak)), (2, "not there at all"), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, [" ".join(leak).split()]


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def _without_near_duplicates(rows):
    """Of each group the row of the smallest id stays; a null id is larger than all; of equal ids any one."""
    sets, root = [_shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(rows[i])
    return [(min((r[0] is None, r[0] or 0) for r in g), g) for g in groups.values()]


def _contaminated(text, items):
    words = text.lower().split()
    windows = {tuple(words[i : i + 10]) for i in range(len(words) - 9)}
    return any(tuple(own[j : j + 10]) in windows for own in items for j in range(len(own) - 9))


def test_stages(spark, made):
    folder, rows, items = made
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def after(name, docs):
        out = corpus_pipeline.materialize(stages[name](spark, docs, folder), f"test-{name}")
        assert name == "packing" or out.schema == docs.schema
        return out, [tuple(r) for r in out.collect()]

    docs, got = after("language_id", docs)
    expected = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert Counter(got) == Counter(expected) and len(expected) == len(rows) - 4

    docs, got = after("quality", docs)
    expected = [r for r in expected if "junk" not in r[1]]
    assert Counter(got) == Counter(expected)

    docs, got = after("near_duplicates", docs)
    groups = _without_near_duplicates(expected)
    assert len(got) == len(groups) < len(expected)
    for least, group in groups:
        (kept,) = [r for r in got if r in group]
        assert (kept[0] is None, kept[0] or 0) == least

    expected = [r for r in got if not _contaminated(r[1], items)]
    docs, kept = after("decontamination", docs)
    assert Counter(kept) == Counter(expected) and 0 < len(got) - len(expected) <= 2

    pieces = stages["packing"](spark, docs, folder).collect()
    _whole(pieces, expected)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter(p.doc_id for p in whole) == Counter(p.doc_id for p in pieces)
    _whole(whole, expected)


def _whole(pieces, rows):
    """The pieces give the token ids of all rows, and fill sequences without gaps."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = Counter((r[0], *library.encode(r[1], add_special_tokens=False).ids, END_ID) for r in rows)
    assert all(len(i) - 1 <= CAPACITY for i in ids) and all(len(p.ids) == p.length for p in pieces)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    placed = []
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= CAPACITY
        placed += s
    # Ids of several rows (null, 502) may be cut alike, so tokens are counted by id and place.
    found = Counter((p.doc_id, p.start + k, t) for p in placed for k, t in enumerate(p.ids))
    assert found == Counter((i[0], k, t) for i, n in ids.items() for _ in range(n) for k, t in enumerate(i[1:]))
