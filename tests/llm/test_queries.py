"""The registered opN queries: against their SQL, and the contract's columns, types and folds over a table of odd rows."""

import os
import zlib

import duckdb
import pytest

from tessera.llm.oracles import ORACLES
from tessera.llm.queries import CAPACITY, QUERIES

SF = "/root/testdata/sf0.001"

# Columns of the contract, with types.
COLUMNS = {
    "op1_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op3_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op4_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op6_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op7_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op8_language_model": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9_vector_duplicates": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op12_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}
HELD_OUT = {"op1_quality": (4, 2), "op4_language": (4, 2), "op8_language_model": (10, 0), "op10_toxicity": (3, 1)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"create view {file.split('.')[0]} as from read_parquet('{SF}/{file}')")
    want, got = con.sql(ORACLES[name]), QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(str, want.select(*got.columns).fetchall())) == sorted(str(tuple(r)) for r in got.collect())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """sf0.001 with columns of odd and clashing names, null and repeated ids, null, empty and very long texts."""
    place = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(None, "no id", "en", "s", 5), (None, None, None, None, None), (3, "", "en", "s", 0), (3, None, "en", "s", 0), (900, "many words and letters " * 220_000, "en", "s", 0)], docs.schema)
    extra = "1 as `my col`, 2 as `a-b`, 'r' as row, 0.5 as score, 7 as class, 8 as hash, 'k' as kind, 4 as length"
    docs.unionByName(more).selectExpr("*", *extra.split(", ")).write.parquet(f"{place}/documents.parquet")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    spoilt = spark.createDataFrame([(None, [0.5] * 64, None), (7, None, 1), (8, [float("nan")] * 64, 1), (9, [0.0] * 64, 1), (10, [None] * 64, 2)], vectors.schema)
    vectors.unionByName(spoilt).selectExpr("*", "1 as code", "2 as `my col`", "3 as cell").write.parquet(f"{place}/embeddings.parquet")
    for name in ("benchmark", "labels"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        rows.unionByName(rows.limit(3)).selectExpr("*", "1 as `my col`", "2 as score").write.parquet(f"{place}/{name}.parquet")
    return place


def test_contract_of_all_queries_over_odd_rows(spark, odd):
    docs, vectors = (spark.read.parquet(f"{odd}/{n}.parquet").count() for n in ("documents", "embeddings"))
    assert set(QUERIES) == set(COLUMNS)
    for name, query in QUERIES.items():
        found = query(spark, odd)
        types = dict(found.dtypes)
        for column in COLUMNS[name].split(", "):
            own, kind = column.split(" ")
            assert types[own] == kind, (name, column)
        rows = found.toPandas()
        if name == "op6_packing":
            assert rows.groupby("sequence_id")["length"].sum().max() <= CAPACITY
        elif name == "op11_vector_codes":
            assert len(rows) == vectors - 3, name
        else:
            assert len(rows) == (vectors if "vec_id" in types else docs), name
        if name in HELD_OUT:
            n, which = HELD_OUT[name]
            ids = rows["doc_id"].dropna().astype(int)
            assert (rows.loc[ids.index, "held_out"] == ids.map(lambda i: zlib.crc32(str(i).encode()) % n == which)).all(), name
        if "predicted" in types:
            assert ((rows["score"] >= 0.7).astype(int) == rows["predicted"]).all() and rows["score"].between(0, 1).all()


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "benchmark", "labels", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).collect() == [], name


def test_little_padding(spark):
    """Sequences but the last are padded to the capacity: at most a fiftieth of all places is empty on sf0.001."""
    pieces = QUERIES["op6_packing"](spark, SF).toPandas()
    used = pieces.groupby("sequence_id")["length"].sum()
    assert (CAPACITY * len(used) - used.sum()) / used.sum() < 0.02
