"""Keyed state of drop alerts: restarts from the checkpoint, replays, late rows, keys that expire."""

import datetime as dt

from quillspan.streaming import jobs

START = dt.datetime(2024, 1, 1)


def land(spark, path, rows):
    """rows: (site, event, query, day, position)."""
    data = [(s, e, q, "/p", (START + dt.timedelta(days=d)).date(), START + dt.timedelta(days=d), None if p is None else float(p), 1, 0) for s, e, q, d, p in rows]
    spark.createDataFrame(data, jobs.SEARCH_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def work(spark, tmp_path, **options):
    """All that has landed, in a query started anew from its checkpoint."""
    stream = jobs.drop_alerts(jobs.search_stream(spark, f"{tmp_path}/in"), **options)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted((r["site_id"], r["query"], r["event_id"], r["previous_position"], r["current_position"]) for r in spark.read.schema(jobs.ALERT_SCHEMA).parquet(f"{tmp_path}/out").collect())


def test_restart_replay_and_order(spark, tmp_path):
    land(spark, f"{tmp_path}/in", [(1, 3, "a", 3, 9), (1, 1, "a", 1, 2), (1, 2, "a", 2, 4), (2, 1, "a", 1, 5), (1, 4, "b", 1, None)])
    want = [(1, "a", 3, 4.0, 9.0)]
    assert work(spark, tmp_path) == want
    land(spark, f"{tmp_path}/in", [(1, 3, "a", 3, 50), (1, 2, "a", 3, 60), (2, 5, "a", 4, 8), (1, 7, "a", 4, 11), (1, 8, "a", 4, 14), (1, 8, "a", 4, 14)])
    want += [(1, "a", 8, 11.0, 14.0), (2, "a", 5, 5.0, 8.0)]
    assert work(spark, tmp_path) == sorted(want)
    assert work(spark, tmp_path) == sorted(want)  # nothing new has landed


def test_silent_keys_are_forgotten(spark, tmp_path):
    land(spark, f"{tmp_path}/in", [(1, 1, "gone", 0, 1), (1, 1, "kept", 0, 1)])
    work(spark, tmp_path, ttl_days=10)
    land(spark, f"{tmp_path}/in", [(1, 2, "kept", 8, 1)])
    work(spark, tmp_path, ttl_days=10)
    land(spark, f"{tmp_path}/in", [(1, 3, "other", 14, 1)])  # moves the watermark to day 13
    work(spark, tmp_path, ttl_days=10)
    land(spark, f"{tmp_path}/in", [(1, 9, "gone", 14, 30), (1, 9, "kept", 14, 30)])
    assert work(spark, tmp_path, ttl_days=10) == [(1, "kept", 9, 1.0, 30.0)]


def test_many_rows_of_one_key(spark, tmp_path):
    n = 30_000
    rows = spark.range(n).selectExpr("1L AS site_id", f"({n} - id) AS event_id", "'q' AS query", "'/p' AS page", "DATE '2024-01-01' AS dt", "TIMESTAMP '2024-01-01 00:00:00' AS ts", f"CAST((({n} - id) % 4) * 2 AS DOUBLE) AS position", "1L AS impressions", "0L AS clicks")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = work(spark, tmp_path, least=2.0)
    assert len(got) == sum(1 for k in range(2, n + 1) if (k % 4) * 2 - ((k - 1) % 4) * 2 >= 2)


def test_parts_of_many_files_lose_no_rows(spark, sf_dir, tmp_path):
    from quillspan.plans import streams
    from quillspan.sources.fixtures import view

    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(5, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    rows = view(spark, str(tmp_path), "fx_search")
    want = sorted(map(tuple, jobs.batch_drop_alerts(rows).collect()))
    assert want and sorted(map(tuple, streams.QUERIES["stream_drop_alerts"](spark, str(tmp_path)).collect())) == want
    whole = streams.QUERIES["stream_burst"](spark, sf_dir)
    assert sorted(map(tuple, streams.QUERIES["stream_burst"](spark, str(tmp_path)).collect())) == sorted(map(tuple, whole.collect()))
