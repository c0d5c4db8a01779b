"""Designed extensions: controlled negatives, sentence ranking, bridge entities, evidence metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.metrics import ratio, rounded


def sample_negatives(pool: DataFrame, positives: DataFrame, group: str, key: str, per_positive: int) -> DataFrame:
    """Of each group at most per_positive rows of the pool for each positive, picked by the hash of their key.

    Positives never count as negatives. The pick is the same on every run and every cluster.
    """
    most = positives.groupBy(group).agg((F.count("*") * per_positive).alias("most"))
    free = pool.join(positives.select(key), key, "left_anti").join(F.broadcast(most), group)
    w = Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), key)
    return free.withColumn("n", F.row_number().over(w)).where(F.col("n") <= F.col("most")).drop("n", "most")


def bm25(queries: DataFrame, corpus: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(q, id, score) of all pairs with a word in common. queries: q, word (distinct); corpus: id, word (repeated as it stands)."""
    tf = corpus.groupBy("id", "word").agg(F.count("*").alias("tf"))
    size = corpus.groupBy("id").agg(F.count("*").alias("size"))
    totals = size.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))  # one row
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    rows = queries.join(df, "word").join(tf, "word").join(size, "id").crossJoin(F.broadcast(totals))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return rows.groupBy("q", "id").agg(F.bround(F.sum(part), 4).alias("score"))


def bridges(mentions: DataFrame, heads: DataFrame, tails: DataFrame, over: DataFrame) -> DataFrame:
    """(doc, head, tail, bridge): a bridge stands with the head in one sentence and with the tail in another of the document.

    mentions: doc, sent, entity. heads, tails, over: the ids that may play each part, column entity.
    """

    def of(part: DataFrame, name: str) -> DataFrame:
        return mentions.join(part, "entity", "left_semi").withColumnRenamed("entity", name)

    near_head = of(heads, "head").join(of(over, "bridge"), ["doc", "sent"]).withColumnRenamed("sent", "sent_a")
    near_tail = of(tails, "tail").join(of(over, "bridge"), ["doc", "sent"]).withColumnRenamed("sent", "sent_b")
    both = near_head.join(near_tail, ["doc", "bridge"]).where("sent_a != sent_b and head != tail and head != bridge and tail != bridge")
    return both.select("doc", "head", "tail", "bridge").distinct()


def evidence_prf(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    """One row over two array columns: hits, precision, recall, f1, all pooled."""
    n = rows.agg(*(F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(a) for c, a in ((F.array_intersect(predicted, gold), "hits"), (F.col(predicted), "p"), (F.col(gold), "g"))))
    p, r = ratio(F.col("hits"), F.col("p")), ratio(F.col("hits"), F.col("g"))
    return n.select("hits", rounded(p).alias("precision"), rounded(r).alias("recall"), rounded(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).alias("f1"))
