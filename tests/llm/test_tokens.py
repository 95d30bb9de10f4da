"""Token counts against the tokenizer itself."""

from pyspark.sql import functions as F

from knotwork.llm.queries import QUERIES, SQL
from knotwork.llm.tokens import encoder, token_count


def test_counts(spark):
    texts = ["hello world", "", None, "日本語 text", "a" * 50_000, "hello world", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r["n"] for r in df.select("id", token_count("text").alias("n")).orderBy("id").collect()]
    assert got == [len(encoder().encode_ordinary(t)) if t else 0 for t in texts]
    assert df.select(token_count(F.col("text")).alias("n")).limit(0).count() == 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
