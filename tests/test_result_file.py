"""A written report read back, without a shuffle of its lines."""

from seqlake.plans import file_queries


def test_lines_are_not_shuffled_to_be_numbered(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = file_queries.result_file(spark, "/root/testdata/sf0.001")
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        places = [r.place for r in rows.select("place").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(places) == list(range(len(places)))
    assert {f.rsplit(".", 1)[1] for f in rows.inputFiles()} == {"gz"}
