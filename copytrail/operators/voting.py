"""Payload and integrity votes reduced to decisions.

Every stage is a ``groupBy`` whose partial sums shrink the votes before the shuffle, so a subject with very
many votes needs no single task to hold them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copytrail import constants as C
from copytrail.skew import lookup_join


def _support_groups(tiles: DataFrame, denominator: Column, keys: Sequence[str] = ("subject_id",)) -> DataFrame:
    """Votes, support and summed bit errors per (subject, candidate, identity)."""
    counted = tiles.groupBy(*keys, "candidate_id", "issuance_id").agg(
        F.count("*").alias("_votes"), F.sum("bit_error_rate").alias("_errors"), F.count("bit_error_rate").alias("_measured"))
    return counted.withColumn("_support", F.col("_votes") / denominator)


def soft_vote(votes: DataFrame, threshold: float = C.VOTE_SUPPORT) -> DataFrame:
    """First-generation vote: support is the share of a candidate's tiles, undecodable ones included.

    A tile counted twice must carry equal evidence, else the subject is an error row. Identities are eligible
    with two votes and enough support; two eligible identities give partial evidence.
    """
    value = F.struct("reason", "issuance_id", "bit_error_rate")
    tiles = votes.groupBy("subject_id", "candidate_id", "tile_ordinal").agg(
        F.min(value).alias("_v"), (~F.min(value).eqNullSafe(F.max(value))).alias("_conflict")).select(
        "subject_id", "candidate_id", "_conflict", "_v.*")
    named = (F.col("reason") == "decoded") & F.col("issuance_id").isNotNull()
    groups = tiles.withColumn("_id", F.when(named, F.col("issuance_id"))).groupBy("subject_id", "candidate_id", "_id").agg(
        F.count("*").alias("_votes"), F.sum("bit_error_rate").alias("_errors"), F.count("bit_error_rate").alias("_measured"),
        F.bool_or("_conflict").alias("_conflict"), F.bool_or(F.col("reason") == "invalid_crc").alias("_crc"))
    totals = groups.groupBy("subject_id", "candidate_id").agg(F.sum("_votes").alias("_all"))
    placed = lookup_join(groups, totals, ["subject_id", "candidate_id"], "inner", counted=votes, spread=["_id"]).withColumn("_support", F.col("_votes") / F.col("_all"))
    real = F.col("_id").isNotNull()
    fits = real & (F.col("_votes") >= C.VOTE_QUORUM) & (F.col("_support") >= threshold)
    rank = F.struct("_support", "_votes", F.col("_errors").alias("_e"), F.col("_measured").alias("_m"), "candidate_id")
    decided = placed.groupBy("subject_id").agg(
        F.bool_or("_conflict").alias("_conflict"), F.coalesce(F.bool_or("_crc"), F.lit(False)).alias("_crc"),
        F.max(F.when(real, rank)).alias("_best"), F.min(F.when(fits, F.col("_id"))).alias("_low"),
        F.max(F.when(fits, F.col("_id"))).alias("_high"), F.max(F.when(fits, F.col("_support"))).alias("_fit_support"),
        F.max(F.when(fits, F.col("_votes"))).alias("_fit_most"), F.sum(F.when(fits, F.col("_votes"))).alias("_fit_votes"),
        F.sum(F.when(fits, F.col("_errors"))).alias("_fit_errors"), F.sum(F.when(fits, F.col("_measured"))).alias("_fit_measured"))
    none, single = F.col("_best").isNull(), F.col("_low") == F.col("_high")
    status = (
        F.when(F.col("_conflict"), "conflicting_duplicate").when(none & F.col("_crc"), "invalid_crc").when(none, "not_detected")
        .when(F.col("_low").isNull(), "partial").when(single, "decoded").otherwise("partial")
    )
    open_votes = F.col("_low").isNull()
    return decided.withColumn("reason", status).select(
        "subject_id", F.when(F.col("reason") == "decoded", F.col("_low")).alias("issuance_id"),
        F.when(F.col("_conflict"), None).when(none, 0.0).when(open_votes, F.col("_best._support")).otherwise(
            F.col("_fit_support")).alias("confidence"),
        F.when(F.col("_conflict"), None).when(none, 0).when(open_votes, F.col("_best._votes")).when(
            single, F.col("_fit_votes")).otherwise(F.col("_fit_most")).alias("valid_votes"),
        F.when(F.col("_conflict") | none, None).when(open_votes, F.try_divide("_best._e", "_best._m")).when(
            single, F.try_divide("_fit_errors", "_fit_measured")).alias("bit_error_rate"), "reason")


def _strongest(groups: DataFrame) -> DataFrame:
    """Per subject the best supported (candidate, identity), one that meets the quorum before all others, and the identities seen."""
    enough = (F.col("_votes") >= C.VOTE_QUORUM) & (F.col("_support") >= C.VOTE_SUPPORT)
    rank = F.struct(enough.alias("_enough"), "_support", "_votes", "candidate_id", "issuance_id", "_errors", "_measured")
    return groups.groupBy("subject_id").agg(
        F.max(rank).alias("b"), F.min("issuance_id").alias("_low"), F.max("issuance_id").alias("_high"))


def _decision(best: DataFrame, status: Column) -> DataFrame:
    return best.withColumn("status", status).select(
        "subject_id", F.when(F.col("status") == "decoded", F.col("b.issuance_id")).alias("issuance_id"),
        F.col("b._support").alias("confidence"), F.col("b._votes").alias("valid_votes"),
        F.try_divide("b._errors", "b._measured").alias("bit_error_rate"), "status")


def _with_silent(decided: DataFrame, subjects: DataFrame, geometry_confidence: float) -> DataFrame:
    """Subjects without a single payload vote keep the geometry confidence and are not detected."""
    joined = subjects.select("subject_id").distinct().join(decided, "subject_id", "left")
    blank = F.col("status").isNull()
    return joined.select(
        "subject_id", "issuance_id", F.when(blank, F.lit(geometry_confidence)).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("valid_votes", F.lit(0)).alias("valid_votes"), "bit_error_rate",
        F.coalesce("status", F.lit("payload_not_detected")).alias("status"))


def _repetitions(repetitions: dict[str, int]) -> Column:
    pairs = [F.lit(x) for pair in repetitions.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.col("candidate_id"))


def payload_votes_v2(votes: DataFrame, repetitions: dict[str, int], geometry_confidence: float = 0.0) -> DataFrame:
    """Second generation: support is over the contracted repetitions, and any second identity is partial evidence.

    A repeated (candidate, tile) with unequal evidence makes the subject an error row.
    """
    payload = votes.filter((F.col("reason") == "decoded") & F.col("issuance_id").isNotNull())
    value = F.struct("issuance_id", "bit_error_rate")
    tiles = payload.groupBy("subject_id", "candidate_id", "tile_ordinal").agg(
        F.min(value).alias("_v"), (~F.min(value).eqNullSafe(F.max(value))).alias("_conflict"))
    groups = _support_groups(tiles.select("subject_id", "candidate_id", "_v.*"), _repetitions(repetitions))
    conflicts = tiles.groupBy("subject_id").agg(F.bool_or("_conflict").alias("_conflict"))
    best = _strongest(groups).join(conflicts, "subject_id")
    status = (
        F.when(F.col("_conflict"), "conflicting_duplicate").when(F.col("_low") != F.col("_high"), "partial_payload_evidence")
        .when((F.col("b._votes") >= C.VOTE_QUORUM) & (F.col("b._support") >= C.VOTE_SUPPORT), "decoded")
        .otherwise("partial_payload_evidence")
    )
    return _with_silent(_decision(best, status), votes, geometry_confidence)


def payload_votes_v3(votes: DataFrame, repetitions: dict[str, int], first_by: Sequence[str],
                     geometry_confidence: float = 0.0) -> DataFrame:
    """Third generation: one vote per (candidate, identity, tile), the first one by ``first_by``.

    Conflicting identities keep their votes and bit errors but never expose an identity.
    """
    payload = votes.filter((F.col("reason") == "decoded") & F.col("issuance_id").isNotNull())
    tiles = payload.groupBy("subject_id", "candidate_id", "issuance_id", "tile_ordinal").agg(
        F.min_by("bit_error_rate", F.struct(*first_by)).alias("bit_error_rate"))
    best = _strongest(_support_groups(tiles, _repetitions(repetitions)))
    status = (
        F.when(F.col("_low") != F.col("_high"), "conflicting_payload_evidence")
        .when((F.col("b._votes") >= C.VOTE_QUORUM) & (F.col("b._support") >= C.VOTE_SUPPORT), "decoded")
        .otherwise("partial_payload_evidence")
    )
    return _with_silent(_decision(best, status), votes, geometry_confidence)


def integrity_regions(replicas: DataFrame) -> DataFrame:
    """Match, mismatch or indeterminate per region, from two agreeing replica votes above the bit confidence."""
    sure = F.col("confidence") >= C.BIT_CONFIDENCE
    counted = replicas.groupBy("page_id", "region_index").agg(
        F.count_if(sure & F.col("is_match")).alias("_match"), F.count_if(sure & ~F.col("is_match")).alias("_mismatch"),
        F.sum("confidence").alias("_confidence"), F.count("confidence").alias("_replicas"))
    verdict = (F.when(F.col("_match") >= C.REPLICA_QUORUM, "match").when(F.col("_mismatch") >= C.REPLICA_QUORUM, "mismatch")
               .otherwise("indeterminate"))
    return counted.select("page_id", "region_index", verdict.alias("verdict"), "_confidence", "_replicas")


def integrity_decision(replicas: DataFrame) -> DataFrame:
    """Page score and limitation; a limited page names no suspicious region."""
    pages = integrity_regions(replicas).groupBy("page_id").agg(
        F.count("*").alias("regions"), F.count_if(F.col("verdict") == "match").alias("matches"),
        F.count_if(F.col("verdict") == "mismatch").alias("mismatches"),
        F.count_if(F.col("verdict") == "indeterminate").alias("_open"),
        (F.sum("_confidence") / F.sum("_replicas")).alias("mean_confidence"))
    ratio = F.col("mismatches") / F.col("regions")
    few = F.col("regions") < C.MIN_REGIONS
    limitation = (
        F.when(few, "integrity.insufficient_complete_regions")
        .when(F.col("_open") * 2 >= F.col("regions"), "integrity.indeterminate")
        .when((ratio >= C.GEOMETRY_MISMATCH) & (F.col("mean_confidence") >= C.HIGH_CONFIDENCE), "integrity.geometry_failure")
        .when((ratio >= C.COMPRESSION_MISMATCH) & (F.col("mean_confidence") < C.HIGH_CONFIDENCE), "integrity.strong_compression")
    )
    return pages.withColumn("limitation", limitation).select(
        "page_id", F.when(few, 0).otherwise(F.col("regions")).alias("evaluated_regions"),
        F.when(few, 0.0).otherwise(F.col("matches") / F.col("regions")).alias("score"), "limitation",
        F.when(F.col("limitation").isNull(), F.col("mismatches")).otherwise(0).alias("suspicious_regions"))


def suspicious_regions(replicas: DataFrame) -> DataFrame:
    """The mismatching regions of the pages without a limitation, one row each."""
    open_pages = integrity_decision(replicas).filter(F.col("limitation").isNull()).select("page_id")
    return integrity_regions(replicas).filter(F.col("verdict") == "mismatch").select("page_id", "region_index").join(
        open_pages, "page_id", "left_semi")
