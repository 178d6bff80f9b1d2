"""The pipeline's stages one by one, against plain versions, and the registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from lectern.llm import decontaminate, language, neardup, queries
from lectern.llm.shared import crc_mod
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_neardup import brute as groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, "123 456"), (10**6 + 2, "")], "doc_id long, text string")
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd, allowMissingColumns=True).withColumn("extra", F.lit(1))


def test_language_stage_keeps_what_is_wanted(spark, docs):
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 7 != 1, F.col("lang"))).withColumn("lang_pred", F.lit("x"))
    got = P.keep_known_languages(spark, docs, SF)
    assert got.columns == docs.columns
    network = language.fit(docs, crc_mod(F.col("doc_id"), 4) != 2)
    said = {r.doc_id: r for r in language.identify(docs, network).select("row.doc_id", "row.lang", F.col("lang_pred").alias("said"), "score").collect()}
    rows = {r.doc_id: r for r in got.collect()}
    assert set(rows) == {i for i, r in said.items() if r.said != "und" and r.score >= 0.5} and not {10**6, 10**6 + 1, 10**6 + 2} & set(rows)
    assert len(rows) >= 0.99 * (len(said) - 3) and all(r.lang == (said[i].lang or said[i].said) for i, r in rows.items())
    some = P.keep_known_languages(spark, docs, SF, wanted=["de", "fr"], least_score=0.9)
    assert {r.doc_id for r in some.collect()} == {i for i, r in said.items() if r.said in ("de", "fr") and r.score >= 0.9}


def test_language_stage_without_labels(spark, docs):
    got = P.keep_known_languages(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF)
    assert got.count() == docs.count() - 3


def test_dedup_stage_keeps_one_of_each_group(spark, docs):  # rows of one id with different texts: test_neardup
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = P.keep_one_of_each_group(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, (_, c) in groups(rows, 5, 80).items() if i == c)
    assert P.keep_one_of_each_group(spark, docs.unionByName(docs), SF).count() == got.count()


def test_decontamination_stage(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = contaminated([(r.doc_id, r.text) for r in docs.collect()], items)
    got = P.keep_uncontaminated(spark, docs, SF)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {i for i, (n, hit, _) in want.items() if not (hit and 20 * hit >= n)}


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(P.run(spark, SF)) == key(docs) and [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing"]


def test_stages_take_empty_tables(spark, docs):
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, name):
    table = "pages" if name.startswith(("op1_", "op6_", "op10_", "part6_")) else "embeddings" if name.startswith(("op11_", "op13_")) else "documents"
    key = {"pages": "page_id", "embeddings": "vec_id"}.get(table, "doc_id")
    got = queries.QUERIES[name](spark, SF)
    rows = got.collect()
    ids = [r[key] for r in rows]
    assert set(ids) == {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert len(ids) == (2 if name.startswith("op10_") else 1) * len(set(ids))
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "embeddings"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(queries.ORACLES[name])
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        assert sorted(str([r[c] for c in columns]) for r in rows) == sorted(str([dict(zip(want.columns, w, strict=True))[c] for c in columns]) for w in want.fetchall())


def test_entry_registers_them():
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in entry.queries() if q.startswith("op")}
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert neardup.SHORT_LIST and decontaminate.PIECE_WORDS
