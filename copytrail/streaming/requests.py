"""Message ingestion, request-result matching and the audit stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copytrail.functions import evidence as E
from copytrail.operators.messages import accepted_messages, parse_messages, rejected_messages


def ingest_requests(raw: DataFrame, at: str = "received_at", delay: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """Valid messages once per message id, and the rejects with their broken rules."""
    parsed = parse_messages(raw)
    valid = accepted_messages(parsed).withColumn("message_id", F.col("m.message_id")).withWatermark(at, delay)
    return valid.dropDuplicatesWithinWatermark(["message_id"]), rejected_messages(parsed)


def request_result_join(requests: DataFrame, results: DataFrame, within: str, delay: str = "10 minutes", grace: str = "0 SECONDS") -> DataFrame:
    """Each request with its result, with a late one, or without one when none came in time.

    ``requests`` has (job_id, attempt, requested_at) and ``results`` (job_id, attempt, finished_at, outcome). A result up to
    ``within`` after its request is ``matched``; one up to ``grace`` after that still comes out, as ``late``; without either the
    request is ``missing``. Both sides are watermarked and bounded in time, so old state is dropped: after within + grace + delay.
    """
    left = requests.withWatermark("requested_at", delay).alias("q")
    right = results.withWatermark("finished_at", delay).alias("r")
    match = F.expr(f"""q.job_id = r.job_id AND q.attempt = r.attempt AND r.finished_at >= q.requested_at
                       AND r.finished_at <= q.requested_at + INTERVAL {within} + INTERVAL {grace}""")
    in_time = F.col("r.finished_at") <= F.col("q.requested_at") + F.expr(f"INTERVAL {within}")
    return left.join(right, match, "left_outer").select(
        "q.job_id", "q.attempt", "q.requested_at", "r.finished_at", "r.outcome",
        F.when(F.col("r.finished_at").isNull(), "missing").when(in_time, "matched").otherwise("late").alias("state"))


def audit_stream(events: DataFrame) -> DataFrame:
    """Audit rows ready to append: metadata redacted, broken rules named. Stateless."""
    errors = E.audit_event_errors(*[F.col(c) for c in ("actor_id", "organization_id", "target_organization_id", "is_system", "action", "outcome",
                                                       "target_type", "target_id", "correlation_id")])
    return events.withColumn("metadata", E.redact_metadata(F.col("metadata_json"))).withColumn("errors", errors).drop("metadata_json")
