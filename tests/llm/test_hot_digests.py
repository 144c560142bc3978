"""A text that a large share of the rows holds, in the pipeline's exact dedup."""

from featloom.llm import exact


def test_rows_of_a_hot_digest_are_not_shuffled_to_their_group(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i}") for i in range(300)] + [(None, "copy")]
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        left = exact.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert "BroadcastHashJoin" in left._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in left.collect()) == [i for i in range(300) if i % 3 or i == 0]
    finally:
        spark.conf.set(threshold, before)
