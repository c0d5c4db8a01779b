"""Rounding of confidences as SQL's round_even does it."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestra.operators import metrics


def test_precision_coverage_ties(spark, tmp_path):
    chars = [5750, 5450, 5749, 5751, 1250, 250, 350, 150, 50, 9950, 0, None] * 3
    rows = [(i, "x", "en", "s", n) for i, n in enumerate(chars)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 3 // 2, 0) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["d_precision_coverage"]).fetchall()
    got = entry.queries()["d_precision_coverage"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_half_even_is_round_even(spark):
    con = duckdb.connect()
    for digits, over in ((2, 10000), (4, 9984)):
        want = [v for (v,) in con.execute(f"select round_even(range / {over}, {digits}) from range(30000) order by range").fetchall()]
        got = [r.v for r in spark.range(30000).orderBy("id").select(metrics.half_even(F.col("id") / over, digits).alias("v")).collect()]
        assert got == want
