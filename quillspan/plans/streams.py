"""Streaming jobs run over files derived from the tables, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.sources.fixtures import oracle, view
from quillspan.streaming import jobs
from quillspan.workspace import fresh_path

FILES = 3


def _chunks(s, d, by: str):
    """Search rows cut into FILES parts by a rising order, as they would land one after the other."""
    rows = view(s, d, "fx_search").select("site_id", "event_id", "query", "page", "dt", "ts", "position", "impressions", "clicks")
    order = F.expr(by)
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = ((high or 0) - (low or 0)) // FILES + 1
    for i in range(FILES):
        start = (low or 0) + i * step
        yield rows.filter((order >= start) & (order < start + step))


def _sync(s, d):
    """FILES batches, the job started anew from its checkpoint for each."""
    path, root = fresh_path(s, "stream-in"), fresh_path(s, "rank-sync")
    for rows in _chunks(s, d, "event_id"):
        rows.write.mode("append").parquet(path)
        jobs.RankSync(s, root).run(jobs.search_stream(s, path, files_per_trigger=100_000))
    return jobs.RankSync(s, root).snapshot()


def _to_table(job, s, d, label: str, by: str = "event_id"):
    """What ``job`` appends over FILES batches, started anew from its checkpoint for each.

    A part is many files, which lie in no order among themselves, so it is one
    batch whole: split into several, a late file would hold rows from before
    those that an earlier one had already moved the state or the watermark past.
    """
    path, out, check = (fresh_path(s, x) for x in ("stream-in", label, label + "-checkpoint"))
    for rows in _chunks(s, d, by):
        rows.write.mode("append").parquet(path)
        stream = job(jobs.search_stream(s, path, files_per_trigger=100_000))
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


def _burst(s, d):
    """Days that the watermark has passed; the last days stay open, as in a running stream."""
    return jobs.burst_from_days(_to_table(lambda rows: jobs.daily_counts(rows, F.col("site_id")), s, d, "stream-days", "datediff(dt, DATE '2024-01-01')"))


def _alerts(s, d):
    """Event ids rise but times do not, so the watermark has to wait for the whole month."""
    return _to_table(lambda rows: jobs.drop_alerts(rows, delay="60 days"), s, d, "stream-alerts")


QUERIES = {"stream_rank_sync": _sync, "stream_burst": _burst, "stream_drop_alerts": _alerts}

ORACLES = {
    "stream_rank_sync": oracle("fx_search", f"""
, st AS (SELECT min(event_id) AS low, (max(event_id) - min(event_id)) // {FILES} + 1 AS step FROM fx_search), c AS (SELECT f.*, (event_id - low) // step AS batch FROM fx_search f, st)
, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch, site_id, query ORDER BY position, event_id) AS rn FROM c) WHERE rn = 1)
, l AS (SELECT *, lag(position) OVER w AS previous_position, min(position) OVER (PARTITION BY site_id, query) AS best_position, row_number() OVER (PARTITION BY site_id, query ORDER BY batch DESC) AS last FROM b WINDOW w AS (PARTITION BY site_id, query ORDER BY batch))
SELECT site_id, query AS keyword, position AS current_position, previous_position, best_position, impressions, clicks FROM l WHERE last = 1"""),
    "stream_drop_alerts": oracle("fx_search", ", l AS (SELECT *, lag(position) OVER (PARTITION BY site_id, query ORDER BY event_id) AS previous_position FROM fx_search) SELECT site_id, query, event_id, previous_position, position AS current_position, position - previous_position AS delta FROM l WHERE position - previous_position >= 3"),
    "stream_burst": oracle("fx_search", ", c AS (SELECT site_id AS site, dt, count(*) AS n FROM fx_search WHERE CAST(dt AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM fx_search) - INTERVAL 1 DAY GROUP BY ALL) SELECT site, count(*) AS days, sum(n)::BIGINT AS total, floor(max(n) / sum(n)::DOUBLE * 10000 + 0.5) / 10000 AS burst_share FROM c GROUP BY site"),
}
