"""Files, pages and images in; results, runs, texts, uploads and indexes out and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import resolve_corpus
from tessera.operators import golden, images
from tessera.operators.routing import ocr_method
from tessera.providers import TextRecogniser
from tessera.sources import sinks, tables
from tessera.sources.documents import extract_pages, routed_pages, scan_files, stream_files
from tessera.streaming.store import Store, put_stream


def _page(angle=0.0, shadow=0.0):
    """Lines of dark strokes on white, turned clockwise by the angle."""
    page = np.full((240, 320), 250, np.uint8)
    for y in range(60, 180, 12):
        for x in range(50, 270, 9):
            page[y : y + 5, x : x + 6] = 20
    return images.shadowed(images.turned(page, -angle, 250), shadow) if shadow else images.turned(page, -angle, 250)


@pytest.mark.parametrize("angle", [-30.0, -7.3, -1.2, 0.0, 0.9, 4.0, 12.5, 40.0])
def test_planted_angles_are_found(angle):
    found = images.skew_angle(_page(angle) < 128)
    assert abs(found - angle) < 0.5


def test_preprocessing_makes_pages_upright_and_plain():
    out = images.preprocessed(_page(5.0, 0.5))
    assert set(np.unique(out)) <= {0, 255} and abs(images.skew_angle(out == 0)) < 0.8
    dark = (out == 0).any(1)
    # Upright lines have clear rows between them.
    assert np.count_nonzero(np.diff(dark.astype(int)) == 1) >= 8
    assert images.skew_angle(np.zeros((50, 50), bool)) == 0.0
    assert len(images.hull(np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2], [2, 0]]))) == 4


def test_photos_alone_are_preprocessed(spark):
    plain, photo = _page(), _page(0.0, 0.6)
    rows = [("plain", 240, 320, plain.tobytes()), ("photo", 240, 320, photo.tobytes()), ("broken", 240, 320, b"xx"), ("none", None, None, None)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "page string, height int, width int, grey binary, method int")
    got = {r["page"]: r for r in images.preprocess_images(table).collect()}
    assert {k: r["method"] for k, r in got.items()} == {"plain": "ocr_raw", "photo": "ocr_preprocessed", "broken": "ocr_raw", "none": "ocr_raw"}
    assert bytes(got["plain"]["grey"]) == plain.tobytes() and set(got["photo"]["grey"]) <= {0, 255}
    spreads = images.image_spreads(table).select("page", ocr_method(F.col("spread")).alias("method")).collect()
    assert {r["page"]: r["method"] for r in spreads if r["page"] in ("plain", "photo")} == {"plain": "ocr_raw", "photo": "ocr_preprocessed"}


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "files"
    place.mkdir()
    (place / "a.txt").write_text("page one " * 30 + "\f" + "short\f" + "page three " * 30, encoding="utf-8")
    (place / "b.JPG").write_text("seen on an image\fnever read", encoding="utf-8")
    (place / "empty.txt").write_text("", encoding="utf-8")
    return str(place)


def test_pages_of_files(spark, folder):
    # Spark leaves files without content out.
    assert {r["doc"] for r in scan_files(spark, folder).collect()} == {"a.txt", "b.JPG"}
    assert [r["doc"] for r in scan_files(spark, folder, images=True).collect()] == ["b.JPG"]
    pages = extract_pages(scan_files(spark, folder), TextRecogniser()).collect()
    assert sorted((r["doc"], r["page_no"]) for r in pages) == [("a.txt", 1), ("a.txt", 2), ("a.txt", 3), ("b.JPG", 1)]
    routed = routed_pages(scan_files(spark, folder, images=False), TextRecogniser(), TextRecogniser()).where("doc = 'a.txt'").collect()
    assert sorted(r["page_no"] for r in routed) == [1, 2, 3]


def test_pages_of_a_stream_of_files(spark, folder, tmp_path):
    """Files that arrive are put into the store by document; what comes again replaces its pages."""
    batch = extract_pages(scan_files(spark, folder), TextRecogniser())
    store = Store(spark, str(tmp_path / "store"), batch.schema, "doc", buckets=2)
    put_stream(extract_pages(stream_files(spark, folder), TextRecogniser()), store, str(tmp_path / "one"), once=True).awaitTermination()
    put_stream(extract_pages(stream_files(spark, folder), TextRecogniser()), store, str(tmp_path / "two"), once=True).awaitTermination()
    assert sorted(map(tuple, store.rows().collect())) == sorted(map(tuple, batch.collect()))


def test_results_runs_and_texts(spark, tmp_path):
    path = sinks.result_path(str(tmp_path), "digital", "org/model", "dense", 5)
    assert path.endswith("digital/org__model/dense_k5.json")
    for value in (0.123456789, 0.5):
        sinks.write_results(spark.createDataFrame([("q", value, 3)], "id string, score double, n int"), path)
    (row,) = spark.read.json(path).collect()
    assert (row["id"], row["score"], row["n"]) == ("q", 0.5, 3) and row["written_at"].endswith("Z")
    runs = str(tmp_path / "runs")
    planned = spark.createDataFrame([("c1", "d1"), ("c1", "d2"), ("c2", "d1")], "config string, doc string")
    assert sinks.read_runs(spark, runs).collect() == []
    done = spark.createDataFrame([("d1", "c1", "tr", 0.25, 1.5, 10)], "doc string, config string, lang string, cer double, elapsed double, chars int")
    for _ in range(2):
        sinks.append_runs(done, runs)
    assert sinks.read_runs(spark, runs).count() == 2
    assert sorted(map(tuple, sinks.open_runs(planned, sinks.read_runs(spark, runs)).collect())) == [("c1", "d2"), ("c2", "d1")]
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "d.1.txt").write_text("two\nlines", encoding="utf-8")
    assert [tuple(r) for r in sinks.read_texts(spark, str(tmp_path / "texts")).collect()] == [("d.1", "two\nlines")]
    (tmp_path / "times.csv").write_text("doc,method,chars,tr_ratio,elapsed\nd,raw,5,0.1,2.0\nd,raw,5,0.1,4.0\n", encoding="utf-8")
    assert [tuple(r) for r in sinks.read_elapsed(spark, str(tmp_path / "times.csv")).collect()] == [("d", "raw", 3.0)]


def test_uploads_and_corpus(tmp_path):
    path = sinks.save_upload(str(tmp_path / "up"), "..\\..\\x/report.pdf", b"abc")
    assert path == str(tmp_path / "up" / "report.pdf") and open(path, "rb").read() == b"abc"
    for bad in ("", "a/..", "b/"):
        with pytest.raises(ValueError):
            sinks.upload_name(bad)
    variants = {"digital": ["v1"], "scanned": ["v2"]}
    assert resolve_corpus(["a", "b"], variants, "scanned") == ["a", "b", "v2"]
    with pytest.raises(ValueError):
        resolve_corpus(["a"], variants, "other")


def test_indexes(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        tables.read_index(spark, path, "v", "m")
    row = lambda variant, doc, method: (variant, "m", doc, method, [0.5, 0.5])
    schema = "variant string, model string, doc string, method string, embedding array<double>"
    tables.write_index(spark.createDataFrame([row("v", "a", "text_layer"), row("v", "b", "ocr_raw"), row("w", "c", "text_layer")], schema), path)
    tables.write_index(spark.createDataFrame([row("v", "d", "mixed")], schema), path)
    assert [r["doc"] for r in tables.read_index(spark, path, "v", "m").collect()] == ["d"] and tables.read_index(spark, path, "w", "m").count() == 1
    assert sorted(map(tuple, tables.index_facts(spark.read.parquet(path)).collect())) == [("v", "m", 1, 1, 1, 2), ("w", "m", 1, 1, 0, 2)]
    with pytest.raises(FileNotFoundError):
        tables.read_index(spark, path, "x", "m")


def test_golden_sets(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    good = {"id": "q1", "question": "How long?", "category": "single_doc", "lang": "en", "expected": "answer", "reference_answer": "Nine.", "anchors": [{"doc": "d", "page": 1, "quote": "nine terms"}]}
    change = lambda **more: {k: v for k, v in (good | more).items() if v is not None}
    cases = {
        "no question": change(question=" "),
        "unknown category": change(category="other"),
        "unknown language": change(lang="de"),
        "unknown expectation": change(expected="maybe"),
        "answer without anchors": change(anchors=None),
        "refusal with anchors": change(expected="refuse", category="unanswerable"),
        "category wants a refusal": change(category="out_of_domain"),
        "category wants an answer": change(expected="refuse", anchors=None),
        "fewer than two documents": change(category="multi_doc"),
        "anchor in an excluded document": change(exclude_docs=["d"]),
        "Turkish letters in an English question": change(question="Kaç dönem sürer, ağaç?"),
        "anchor of digits alone": change(anchors=[{"doc": "d", "page": 1, "quote": "12,5 %"}]),
        "anchor without a quote": change(anchors=[{"doc": "d", "page": 1, "quote": " "}]),
    }
    rows = [good] + [c | {"id": f"x{i}"} for i, c in enumerate(cases.values())] + [good]
    (tmp_path / "golden.yaml").write_text(yaml.safe_dump(rows, allow_unicode=True), encoding="utf-8")
    read = golden.read_golden(spark, str(tmp_path / "golden.yaml"))
    assert read.count() == len(rows) and [r["id"] for r in golden.duplicate_ids(read).collect()] == ["q1"]
    problems = {}
    for r in golden.label_problems(read).collect():
        problems.setdefault(r["id"], set()).add(r["problem"])
    assert "q1" not in problems
    for i, name in enumerate(cases):
        assert name in problems[f"x{i}"], name
    assert golden.anchors_of(read).where("id = 'q1'").select("doc", "page", "quote").distinct().count() == 1
