"""Documents of more than a thousand lines."""

from attestra import catalog


def test_all_sentences(spark, tmp_path):
    spark.createDataFrame([(7, "\n".join(["x"] * 1203))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id for r in catalog.QUERIES["doc_sentences"](spark, str(tmp_path)).collect()}
    assert len(got) == 1203 and {"sent_d7_000", "sent_d7_999", "sent_d7_1000", "sent_d7_1202"} <= got
