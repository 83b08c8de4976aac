"""Word search deals the heads around what it found, not all of them."""

from pyspark.sql import functions as F

from factloom.operators import postings

from .helpers import frame, rows


def test_heads_far_from_all_scores_are_left_out(spark):
    heads = spark.range(10 * postings.STRETCH).select(F.col("id").alias("number"), F.concat(F.lit("r"), "id").alias("resource_id"))
    scored = frame(spark, [("q", postings.STRETCH + 5), ("q", postings.STRETCH + 9), ("p", 3)], "query_id string, number long")
    near = postings._near(heads, scored)
    assert near.columns == heads.columns and near.count() == 2 * postings.STRETCH
    assert rows(scored.join(near, "number").select("resource_id")) == [("r3",), (f"r{postings.STRETCH + 5}",), (f"r{postings.STRETCH + 9}",)]
