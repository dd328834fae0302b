from pyspark.sql import functions as F

from trailframe.llm import language_id


def test_copies_do_not_thin_a_language(spark):
    rows = [("aa", f"text {i} of many") for i in range(40)] + [("aa", "the same text")] * 4000 + [("bb", f"other {i}") for i in range(15)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    sample = language_id.sample_texts(docs, F.col("text"), F.col("lang"), docs=20)
    assert {k: len(v) for k, v in sample.items()} == {"aa": 20, "bb": 15}
