"""Operator 4: line dedup by overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines are hashed. A window that occurs more than once anywhere
keeps its first place (least doc_id, then position); all later places are covered, covered
positions are merged into runs, and the lines in runs are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.common import read_table

WIDTH = 3


def _keyed(docs: DataFrame) -> DataFrame:
    """The row as one struct, its document key and its lines; columns of any name stay in the struct."""
    text = F.col("text")
    return docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("k1"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("k2"),
        F.when(text.isNotNull(), F.split(text, "\n", -1)).alias("lines"),
    )


def _windows(keyed: DataFrame, width: int) -> DataFrame:
    """A row for each window of `width` lines that are not all blank: document key, position, 128-bit hash."""
    parts = [F.get("lines", F.col("pos") + i) for i in range(width)]
    starts = F.expr(f"sequence(0, size(lines) - {width})")
    at = keyed.where(F.size("lines") >= width).select("k1", "k2", "lines", F.explode(starts).alias("pos"))
    filled = F.translate(F.concat(*parts), " \t\r", "") != ""
    return at.where(filled).select("k1", "k2", "pos", F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(7), *reversed(parts)).alias("h2"))


def dedup_lines(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs with repeated windows of lines removed.

    Returns the columns row (the input row as a struct), text (what is left), n_lines and
    n_removed. Texts of fewer than `width` lines have no window and stay; null texts stay null with
    0 lines; windows of blank lines only never count. Rows with null doc_id come last in order.
    Rows alike in doc_id and text are one document: they get the same result. Documents of
    one doc_id are ordered by their texts' hash.
    """
    keyed = _keyed(docs)
    windows = _windows(keyed, width)
    place = F.struct("k1", "k2", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h1", "h2", "first")
    later = windows.join(repeated, ["h1", "h2"]).where(place != F.col("first")).select("k1", "k2", "pos").distinct()
    by_doc = Window.partitionBy("k1", "k2").orderBy("pos")
    begins = F.coalesce(F.col("pos") > F.lag("pos").over(by_doc) + width, F.lit(True))
    runs = (
        later.withColumn("begins", begins)
        .withColumn("run", F.sum(F.col("begins").cast("int")).over(by_doc))
        .groupBy("k1", "k2", "run")
        .agg(F.min("pos").alias("begin"), (F.max("pos") + width - 1).alias("end"))
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("runs"))
    )
    joined = keyed.join(runs, ["k1", "k2"], "left")
    gap_from = "IF(j = 0, 0, get(runs, j - 1).end + 1)"
    gap_to = "IF(j = size(runs), size(lines), get(runs, j).begin)"
    kept = F.expr(f"flatten(transform(sequence(0, size(runs)), j -> slice(lines, {gap_from} + 1, {gap_to} - ({gap_from}))))")
    removed = F.expr("aggregate(runs, 0, (s, r) -> s + r.end - r.begin + 1)")
    return joined.select(
        "row",
        F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed")


OP4_SQL = """
with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
w as (
  select doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] as h
  from (select doc_id, ls, unnest(range(0, len(ls) - 2)) as i from d where len(ls) >= 3)
  where translate(ls[i + 1] || ls[i + 2] || ls[i + 3], ' ' || chr(9) || chr(13), '') <> ''
),
later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as rn from w) where rn > 1
),
covered as (
  select distinct doc_id, i + s as i from later, (select unnest(range(0, 3)) as s)
),
lines as (select doc_id, unnest(range(0, len(ls))) as i, unnest(ls) as line from d),
kept as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.i) as text
  from lines l left join covered c on l.doc_id = c.doc_id and l.i = c.i where c.i is null group by l.doc_id
),
gone as (select doc_id, count(*) as n from covered group by doc_id)
select d.doc_id, coalesce(k.text, case when d.text is not null then '' end) as text,
  cast(coalesce(len(d.ls), 0) as bigint) as n_lines, cast(coalesce(g.n, 0) as bigint) as n_removed
from d left join kept k on d.doc_id = k.doc_id left join gone g on d.doc_id = g.doc_id
"""
