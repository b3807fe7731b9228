"""Ordered work lists: heads, batches, cursors and lanes. Limits here are the operators' own meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copytrail.operators.lifecycle import FENCE_CODE


def queue_head(jobs: DataFrame, status: str, k: int = 1, by: str = "created_at") -> DataFrame:
    """The oldest jobs in a status; sorted and cut per task before they meet."""
    return jobs.filter(F.col("status") == status).orderBy(by, "job_id").limit(k)


def stale_jobs(jobs: DataFrame, owners: DataFrame, now: Column, limit: int = 25, fence_code: str = FENCE_CODE) -> DataFrame:
    """Jobs to recover: owned and silent in processing, or failed behind a fence; oldest first."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1..100")
    fenced = (F.col("state") == "cleanup_required") & (F.col("safe_error_code") == fence_code)
    flags = owners.groupBy("job_id").agg(F.coalesce(F.bool_or(fenced), F.lit(False)).alias("_fenced"))
    waiting = jobs.filter(F.col("status").isin("processing", "failed")).join(flags, "job_id")
    stale = (F.col("status") == "processing") & (F.col("updated_at") < now - F.expr("INTERVAL '15' MINUTE"))
    tomb = (F.col("status") == "failed") & F.col("_fenced") & (F.col("kind") == "issuance")
    return waiting.filter(stale | tomb).drop("_fenced").orderBy("updated_at", "job_id").limit(limit)


def cleanup_batch(candidates: DataFrame, attempted: DataFrame, limit: int) -> DataFrame:
    """The next objects to remove, in category priority, skipping the ones already tried."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be within 1..500")
    fresh = candidates.join(attempted.select("category", "id").distinct(), ["category", "id"], "left_anti")
    return fresh.orderBy("priority", "at", "id").limit(limit)


def keyset_next(rows: DataFrame, at: str, key: str, cursor_at: Column | None, cursor_key: Column | None, k: int = 1) -> DataFrame:
    """The next rows after a (time, id) cursor, wrapping to the start when none is left."""
    if cursor_at is None or cursor_key is None:
        return rows.orderBy(at, key).limit(k)
    passed = ~((F.col(at) > cursor_at) | ((F.col(at) == cursor_at) & (F.col(key) > cursor_key)))
    return rows.withColumn("_passed", passed).orderBy("_passed", at, key).limit(k).drop("_passed")


def lane_interleave(ordinary: DataFrame, reconciliation: DataFrame, batch: int, first: str = "ordinary") -> DataFrame:
    """Alternate two lanes of (at, id). Each lane is cut to the batch before the lanes are ranked together."""
    if not 1 <= batch <= 500:
        raise ValueError("batch must be within 1..500")
    lanes = None
    for name, rows in (("ordinary", ordinary), ("reconciliation", reconciliation)):
        part = rows.orderBy("at", "id").limit(batch).select("at", "id", F.lit(name).alias("lane"), F.lit(int(name != first)).alias("_turn"))
        lanes = part if lanes is None else lanes.unionByName(part)
    place = F.row_number().over(Window.partitionBy("lane").orderBy("at", "id"))
    ordered = lanes.withColumn("_place", place).orderBy("_place", "_turn").limit(batch)
    return ordered.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_place", "_turn"))).drop("_place", "_turn")
