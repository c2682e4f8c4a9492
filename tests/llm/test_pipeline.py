"""The pipeline on a small table, stage by stage, and the registered queries against SQL."""

import os

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from keelson.llm import common, ngram_join, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        sizes.append(docs.count())
        if n < 4:
            assert docs.columns == columns
        if n < 3:
            assert docs.select("doc_id").distinct().count() == sizes[-1] <= sizes[-2]
    assert sizes[1] > 0.7 * sizes[0] and sizes[2] > 0.5 * sizes[1] and sizes[-1] == sizes[-2]
    assert docs.where("size(ids) = 0 OR ids IS NULL").count() == 0


def test_texts_are_written_in_small_pieces(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(common, "ROW_GROUP", 1 << 14)
    spark.conf.unset(common.BLOCK)
    try:
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        out = corpus_pipeline.one_of_each(spark, docs, DATA)
        # Texts are dealt out once, on their way to the ids that stay.
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        out.coalesce(1).write.parquet(str(tmp_path / "own"))
        common.write(docs.coalesce(1), str(tmp_path / "scratch"))
        for name in ("own", "scratch"):
            (part,) = (tmp_path / name).glob("part-*")
            assert pq.ParquetFile(part).metadata.num_row_groups > 1
        # A size that the caller has set stays.
        spark.conf.set(common.BLOCK, "1000000")
        common.small_pieces(spark)
        assert spark.conf.get(common.BLOCK) == "1000000"
    finally:
        spark.conf.unset(common.BLOCK)
        spark.conf.unset(common.BATCH)


def test_texts_reach_scans_and_python_in_small_pieces(spark):
    import pyarrow as pa

    def lengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(b)], pa.int64())})

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "parquet.read.allocation.size"
    try:
        spark.conf.set(size, "1000000")
        corpus_pipeline.mixed(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)
        assert spark.range(0, 5000, 1, 1).mapInArrow(lengths, "n long").agg(F.max("n")).first()[0] == 1000
        hadoop = spark._jsparkSession.sessionState().newHadoopConf()
        assert hadoop.get("parquet.hadoop.vectored.io.enabled") == "false"
        # A size that the caller has set stays.
        assert hadoop.get(size) == "1000000"
    finally:
        for key in (rows, size, "parquet.hadoop.vectored.io.enabled", common.BLOCK, common.BATCH):
            spark.conf.unset(key)


def test_one_of_each_with_repeated_and_null_ids(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(30))
    rows = [(5, text(1)), (5, text(1)), (5, text(2)), (3, text(2)), (7, text(3)), (8, text(3)), (None, text(4)), (None, text(4)), (None, text(3)), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.join(docs).select(F.col("class_id").alias("kept")).distinct()
    want = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept"]), "left_semi").distinct()
    got = corpus_pipeline.one_of_each(spark, docs, DATA)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 7
