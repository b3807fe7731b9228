"""Stored objects, request messages and limits checked against what was declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copytrail import constants as C
from copytrail.functions import evidence as E
from copytrail.skew import running_sum


def scan_objects(objects: DataFrame, content: Column, declared_sha256: Column, max_bytes: int = C.MAX_BYTES) -> DataFrame:
    """Hash and size of stored bytes, and a code when they differ from what was declared."""
    digest, size = F.sha2(content, 256), F.octet_length(content)
    code = F.when(size > max_bytes, "size_limit").when(~digest.eqNullSafe(declared_sha256), "sha256_mismatch")
    return objects.withColumn("sha256", digest).withColumn("size_bytes", size.cast("long")).withColumn("error_code", code)


def parse_messages(raw: DataFrame, body: str = "body") -> DataFrame:
    """Messages with their parsed fields and broken rules; one pass serves both branches.

    The one-element explode keeps later filters on ``errors`` above this step. A plain column would be
    copied into the filter, and every rule would parse the text again.
    """
    parsed = raw.withColumn("m", F.from_json(body, E.MESSAGE_SCHEMA))
    return parsed.select("*", F.explode(F.array(E.job_message_errors(F.col(body), F.col("m")))).alias("errors"))


def accepted_messages(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.size("errors") == 0)


def rejected_messages(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.size("errors") > 0)


def reconcile_objects(declared: DataFrame, observed: DataFrame, now: Column) -> DataFrame:
    """State of each declared upload against the object found in storage."""
    seen = observed.select("upload_id", F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha"), F.lit(True).alias("_seen"))
    state = (
        F.when(F.col("finalized_at").isNotNull(), "final").when(now >= F.col("expires_at"), "expired").when(F.col("_seen").isNull(), "missing")
        .when(~(F.col("_size").eqNullSafe(F.col("size_bytes")) & F.col("_sha").eqNullSafe(F.col("expected_sha256"))), "mismatched")
        .otherwise("ok")
    )
    return declared.join(seen, "upload_id", "left").withColumn("state", state).drop("_size", "_sha", "_seen")


def outbox_match(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Whether each job has exactly one unpublished event whose payload equals the one the job would build.

    ``jobs`` brings the input binding (``input_object_key``, ``input_sha256``); null binding never matches. Parsed events are
    wider than their estimate, so they are merged, never broadcast.
    """
    parsed = parse_messages(events.withColumnRenamed("payload", "body"))
    one = parsed.groupBy("job_id").agg(
        F.count("*").alias("_n"),
        F.min_by(F.struct("organization_id", "attempt", "published_at", "topic", "message_id", "m", "errors"), "message_id").alias("_e"))
    kind = F.concat("kind", F.lit(".requested"))
    same = {
        "message_type": kind, "message_id": F.col("_e.message_id"), "job_id": F.col("job_id"), "attempt": F.col("attempt"),
        "issuance_id": F.col("issuance_id"), "verification_id": F.col("verification_id"),
        "input_object_key": F.col("input_object_key"), "input_sha256": F.col("input_sha256"),
        "deadline_at": F.col("deadline_text"), "correlation_id": F.col("correlation_id")}
    equal = F.lit(True)
    for field, value in same.items():
        equal = equal & F.col(f"_e.m.{field}").eqNullSafe(value)
    fits = (
        (F.col("_n") == 1) & (F.col("_e.organization_id") == F.col("organization_id")) & (F.col("_e.attempt") == F.col("attempt"))
        & F.col("_e.published_at").isNull() & F.col("input_object_key").isNotNull() & F.col("input_sha256").isNotNull()
        & (F.col("_e.topic") == kind) & (F.size("_e.errors") == 0) & equal
    )
    return jobs.join(one.hint("merge"), "job_id", "left").withColumn("event_count", F.coalesce("_n", F.lit(0))).withColumn(
        "matches", F.coalesce(fits, F.lit(False))).drop("_n", "_e")


def describe_error(rows: DataFrame, texts: DataFrame, generic: str, code: str = "error_code", into: str = "message") -> DataFrame:
    """Rows with the text of their code from ``texts`` (code, text); unknown codes get the generic text, no code gets none.

    The caller brings the texts, one row per code; of repeated codes the smallest text counts.
    """
    named = texts.groupBy(F.col("code").alias("_code")).agg(F.min("text").alias("_text"))
    joined = rows.join(named, F.col(code) == F.col("_code"), "left")
    return joined.withColumn(into, F.when(F.length(code) > 0, F.coalesce("_text", F.lit(generic)))).drop("_code", "_text")


def _slice(page: str) -> Column:
    return F.floor(F.col(page) / 1024)


def limit_screen(pages: DataFrame, order: list[str], max_bytes: int = C.MAX_BYTES, max_pages: int = C.MAX_PAGES,
                 max_pixels: int = C.MAX_IMAGE_PIXELS, max_document_pixels: int = C.MAX_DOCUMENT_PIXELS) -> DataFrame:
    """First ceiling each page breaks; pages of a document accumulate pixels in page order."""
    sized = pages.withColumn("pixels", F.col("width") * F.col("height"))
    summed = running_sum(sized, ["document_id"], [F.col(c) for c in order], "pixels", _slice(order[0]), "cumulative_pixels")
    code = (
        F.when(F.col("document_bytes") > max_bytes, "bytes").when(F.col("document_pages") > max_pages, "pages")
        .when(F.col("pixels") > max_pixels, "page_pixels").when(F.col("cumulative_pixels") > max_document_pixels, "document_pixels")
    )
    return summed.withColumn("error_code", code)


def running_budget(pages: DataFrame, order: list[str], budget: int = C.MAX_DOCUMENT_PIXELS) -> DataFrame:
    """Per document the first page at which the summed pixels pass the budget."""
    sized = pages.withColumn("pixels", F.col("width") * F.col("height"))
    summed = running_sum(sized, ["document_id"], [F.col(c) for c in order], "pixels", _slice(order[0]), "cumulative_pixels")
    return summed.filter(F.col("cumulative_pixels") > budget).groupBy("document_id").agg(F.min(order[0]).alias("first_page_over"))
