"""The keyword snapshot over several batches: only touched parts are written, replays change nothing, old parts go."""

import datetime as dt
import os

from quillspan.streaming import jobs

ROW = "site_id bigint, event_id bigint, query string, page string, dt date, ts timestamp, position double, impressions bigint, clicks bigint"


def batch(spark, rows):
    """rows: (site, query, position)."""
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(s, k, q, "/p", at.date(), at, float(p), 10 + k, k) for k, (s, q, p) in enumerate(rows)], ROW)


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def state(job):
    return {(r["site_id"], r["keyword"]): (r["current_position"], r["previous_position"], r["best_position"]) for r in job.snapshot().collect()}


def test_batches_touch_their_own_parts(spark, tmp_path):
    root = str(tmp_path)
    job = jobs.RankSync(spark, f"file://{root}", buckets=16)
    job.apply(batch(spark, [(k % 3, f"q{k}", 10 + k) for k in range(200)]), 0)
    assert len(state(job)) == 200
    first = files(root + "/snapshot")
    job.apply(batch(spark, [(1, "q1", 3), (1, "q1", 30)]), 1)
    second = files(root + "/snapshot")
    assert len({p.split("/")[1] for p in second if p.startswith("batch=1")}) == 1  # one keyword: one part
    assert {p: t for p, t in second.items() if p.startswith("batch=0")} == first
    assert state(job)[(1, "q1")] == (3.0, 11.0, 3.0) and len(state(job)) == 200
    once = state(job)
    job.apply(batch(spark, [(1, "q1", 3), (1, "q1", 30)]), 1)  # replayed after a failure before the commit
    assert state(job) == once
    job.apply(batch(spark, [(1, "q1", 8), (9, "new", 1)]), 2)
    assert state(job)[(1, "q1")] == (8.0, 3.0, 3.0) and state(job)[(9, "new")] == (1.0, None, 1.0) and len(state(job)) == 201
    job.apply(batch(spark, [(1, "q1", 7)]), 4)  # a batch without rows in between
    left = {p.split("/")[0] for p in files(root + "/snapshot") if p.split("/")[1] == next(x.split("/")[1] for x in second if x.startswith("batch=1"))}
    assert left == {"batch=2", "batch=4"} and state(job)[(1, "q1")] == (7.0, 8.0, 3.0)
    assert job.history().count() == 200 + 1 + 2 + 1


def test_interrupted_batch_is_not_seen(spark, tmp_path):
    job = jobs.RankSync(spark, f"file://{tmp_path}", buckets=4)
    assert state(job) == {}
    job.apply(batch(spark, [(1, "a", 5)]), 0)
    before = state(job)
    # the parts of batch 1 are there, its versions are not
    batch(spark, []).selectExpr("site_id", "query as keyword", "position as current_position", "position as previous_position", "position as best_position", "impressions", "clicks").write.parquet(f"file://{tmp_path}/snapshot/batch=1/bucket=0")
    os.makedirs(f"{tmp_path}/versions/batch=1/_temporary")
    assert state(job) == before
    job.apply(batch(spark, [(1, "a", 4)]), 1)
    assert state(job) == {(1, "a"): (4.0, 5.0, 4.0)}
