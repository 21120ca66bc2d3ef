"""Stored results: order, expiry, pruning to one query's files, and dropping."""

from sievekit.sources.results import drop_expired, reread_result, store_result


def test_results_keep_their_order_and_expire(spark, tmp_path):
    path, schema = str(tmp_path), "id long, name string"
    rows = spark.range(0, 1000, 1, 7).selectExpr("id", "concat('n', id) AS name").orderBy("name")
    want = sorted(((i, f"n{i}") for i in range(1000)), key=lambda r: r[1])
    store_result(rows, path, "007", "s", ttl_seconds=60, now=1000)
    store_result(rows.limit(0), path, "none", "s", ttl_seconds=60, now=1000)
    read = lambda q, s, now, limit=None: [tuple(r) for r in reread_result(spark, path, q, s, schema, limit, now).collect()]
    assert read("007", "s", 1059) == want and read("007", "s", 1059, 3) == want[:3] and read("007", "s", 1059, 0) == []
    assert read("007", "t", 1059) == [] and read("7", "s", 1059) == [] and read("none", "s", 1059) == [] and read("007", "s", 1060) == []
    store_result(rows.filter("id < 2"), path, "007", "s", ttl_seconds=60, now=1030)
    assert read("007", "s", 1059) == [(0, "n0"), (1, "n1")]
    plan = reread_result(spark, path, "007", "s", schema, now=1059)._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "query_id" in filters and "expires" in filters
    assert drop_expired(spark, path, now=1060) == 1 and read("007", "s", 1000) == [(0, "n0"), (1, "n1")] and drop_expired(spark, path, now=1060) == 0
