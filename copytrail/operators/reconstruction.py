"""Evidence of result rows computed again from the plan, and stored summaries compared with what the rows give."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copytrail.functions.geometry import RECTS, SIDES, fold_operations, merge_regions, compose_transforms, transform_regions
from copytrail.functions.text import codes, let

#: Numbers went through text once, so they agree up to this.
TOLERANCE = 1e-12


def same_number(found: Column, wanted: Column, tolerance: float = TOLERANCE) -> Column:
    """Both null, or both finite and at most ``tolerance`` apart."""
    both = found.isNotNull() & wanted.isNotNull() & ~F.isnan(found) & ~F.isnan(wanted)
    return F.coalesce((found.isNull() & wanted.isNull()) | (both & (F.abs(found - wanted) <= tolerance)), F.lit(False))


def _same_matrix(found: Column, wanted: Column) -> Column:
    cells = F.zip_with(found, wanted, lambda a, b: F.coalesce(F.abs(a - b) <= TOLERANCE, F.lit(False)))
    return F.coalesce((found.isNull() & wanted.isNull()) | ((F.size(found) == F.size(wanted)) & F.forall(cells, lambda c: c)), F.lit(False))


def _same_regions(found: Column, wanted: Column) -> Column:
    def near(a: Column, b: Column) -> Column:
        test = F.lit(True)
        for side in SIDES:
            test = test & F.coalesce(F.abs(a[side] - b[side]) <= TOLERANCE, F.lit(False))
        return test

    return F.coalesce((F.size(found) == F.size(wanted)) & F.forall(F.zip_with(found, wanted, near), lambda c: c), F.lit(False))


def expected_evidence(planned: DataFrame) -> DataFrame:
    """``planned`` with ``_present`` and ``_absent``: the evidence with the altered artifact and without one.

    ``planned`` holds source_regions, ``canvas`` (matrix from source to page), ``operations`` (an array of
    ``geometry.operation``) and planned_removed, what a planned crop would remove even if it never ran (null: no crop).
    Source regions move through the whole chain at once; regions that a step changed move through the later ones.
    """
    def present(chain: Column) -> Column:
        # The canvas comes before the chain, so source regions move by the product.
        return let(F.struct(chain.alias("c"), transform_regions(F.col("source_regions").cast(RECTS), compose_transforms(chain["matrix"], F.col("canvas"))).alias("t")),
                   lambda v: F.struct(v["c"]["matrix"].alias("matrix"), merge_regions(v["t"]["regions"], v["c"]["regions"]).alias("regions"),
                                      v["c"]["removed"].alias("removed"), F.coalesce(v["c"]["error"], v["t"]["error"]).alias("error")))

    absent = let(transform_regions(F.col("source_regions").cast(RECTS), F.col("canvas")), lambda t: F.struct(
        F.lit(None).cast("array<double>").alias("matrix"), t["regions"].alias("regions"), F.col("planned_removed").cast("double").alias("removed"),
        t["error"].alias("error")))
    return planned.withColumn("_present", let(fold_operations(F.col("operations")), present)).withColumn("_absent", absent)


def evidence_audit(rows: DataFrame, planned: DataFrame, key: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """(row_id, code): where the geometry a row reports is not the one its plan gives.

    ``rows`` holds source_to_output (matrix of the chain; null without an artifact), tamper_ground_truth (regions),
    removed_area_fraction and artifact_absent. Codes: ``unplanned``, ``transform_mismatch``, ``ground_truth_mismatch``,
    ``removed_fraction_mismatch``, and ``unreconstructable`` where a region's corner lies at infinity. A row that does not say
    whether there was an artifact may agree with either state; if it agrees with neither, it is held against the one with an artifact.

    Chains are folded once per plan row, before the join; rows then only compare numbers.
    """
    wanted = expected_evidence(planned).select(*key, F.lit(True).alias("_due"), "_present", "_absent")
    joined = rows.join(wanted, list(key), "left")

    def against(state: Column) -> Column:
        return codes(("unreconstructable", state["error"].isNotNull()),
                     ("transform_mismatch", ~_same_matrix(F.col("source_to_output"), state["matrix"])),
                     ("ground_truth_mismatch", state["error"].isNull() & ~_same_regions(F.col("tamper_ground_truth"), state["regions"])),
                     ("removed_fraction_mismatch", ~same_number(F.col("removed_area_fraction"), state["removed"])))

    both = F.struct(against(F.col("_present")).alias("with"), against(F.col("_absent")).alias("without"))
    found = let(both, lambda b: F.when(F.col("artifact_absent"), b["without"]).when(~F.col("artifact_absent"), b["with"]).when(
        (F.size(b["with"]) == 0) | (F.size(b["without"]) == 0), F.array().cast("array<string>")).otherwise(b["with"]))
    return joined.select(row_id, F.explode(F.when(F.col("_due").isNull(), F.array(F.lit("unplanned"))).otherwise(found)).alias("code"))


def rows_digest(rows: DataFrame, key: str, fields: Sequence[str], by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """``by`` and rows_sha256: one digest over all rows that any changed, missing, added or repeated row changes.

    A tree over the hash of the key: rows are hashed, leaves (the first ``digits`` hex digits of the key's hash) hash their rows in
    order, and every level above hashes up to 256 nodes. It depends on keys and values only, not on files, order or partitions, and
    neither a group nor the driver ever holds more than a leaf. With six digits a leaf has about 4096 rows at 7e10 rows. A row that
    is repeated a million times is one entry with its count. Rows are dealt by leaf once, as two binary digests, and counted and
    hashed where they are; text is only what enters a hash.
    """
    value = F.concat_ws("\x00", F.col(key).cast("string"), *[F.coalesce(F.concat(F.lit("="), F.col(f).cast("string")), F.lit("~")) for f in fields])
    hashed = rows.select(*by, F.sha2(F.col(key).cast("string"), 256).alias("_hex"), F.unhex(F.sha2(value, 256)).alias("digest"))
    dealt = hashed.select(*by, F.substring("_hex", 1, digits).alias("short"), F.unhex("_hex").alias("path"), "digest").repartition(*by, "short")
    counted = dealt.groupBy(*by, "short", "path", "digest").agg(F.count("*").alias("n"))
    level = _hashed(counted, by, ("path", "digest", "n"), lambda r: F.concat(_hex(r["path"]), F.lit(":"), _hex(r["digest"]), F.lit("*"), r["n"].cast("string")))
    for kept in range(digits - 2, -1, -2):
        level = _hashed(level.withColumn("short", F.substring("path", 1, kept)), by, ("path", "digest"), lambda r: F.concat(r["path"], F.lit(":"), _hex(r["digest"])))
    return level.select(*by, _hex(F.col("digest")).alias("rows_sha256"))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hashed(nodes: DataFrame, by: Sequence[str], members: Sequence[str], line: Callable[[Column], Column]) -> DataFrame:
    """(by, path, digest): one level of a digest tree, the lines of each ``short`` path's nodes hashed in order."""
    listed = F.array_sort(F.collect_list(F.struct(*members)))
    return nodes.groupBy(*by, "short").agg(F.unhex(F.sha2(F.array_join(F.transform(listed, line), "\n"), 256)).alias("digest")).withColumnRenamed("short", "path")


def evidence_summary(rows: DataFrame, by: Sequence[str], digest_fields: Sequence[str]) -> DataFrame:
    """What a stored summary claims of each group, from the rows: counts, means, status and the digest of the rows."""
    right = F.col("expected_id").isNotNull() & (F.col("decoded_id") == F.col("expected_id")) & (F.col("reason") != "execution_error")
    wrong = F.col("decoded_id").isNotNull() & ~F.col("decoded_id").eqNullSafe(F.col("expected_id"))
    counted = rows.groupBy(*by).agg(
        F.count("*").alias("completed_rows"), F.count_if(F.col("reason") == "execution_error").alias("execution_errors"),
        F.count_if(right).alias("true_attribution"), F.count_if(wrong).alias("false_attribution"),
        F.avg(F.col("psnr_db").cast("double")).alias("mean_psnr_db"), F.avg("ssim").alias("mean_ssim"))
    status = F.when(F.col("execution_errors") > 0, "complete_with_errors").otherwise("complete")
    return counted.withColumn("status", status).join(rows_digest(rows, "row_id", digest_fields, by), list(by))


def summary_diff(stored: DataFrame, recomputed: DataFrame, by: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """``by`` and field: each field of a stored summary that the rows do not bear out.

    Doubles may differ by ``tolerance`` (a distributed mean has no fixed order); everything else must be equal, also where it is null.
    Groups only one side has are ``missing`` (no stored summary) or ``unexpected``; a group stored more than once is ``repeated``.
    """
    fields = [f for f in recomputed.schema.fields if f.name not in by]
    ours = recomputed.select(*by, F.struct(*[f.name for f in fields]).alias("_b"))
    theirs = stored.groupBy(*by).agg(F.count("*").alias("_n"), F.any_value(F.struct(*[f.name for f in fields])).alias("_a"))
    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_n") == 1)

    def agrees(f: T.StructField) -> Column:
        a, b = F.col("_a")[f.name], F.col("_b")[f.name]
        return same_number(a, b, tolerance) if isinstance(f.dataType, T.DoubleType) else a.eqNullSafe(b)

    found = codes(("missing", F.col("_a").isNull()), ("unexpected", F.col("_b").isNull()), ("repeated", F.coalesce(F.col("_n") > 1, F.lit(False))),
                  *[(f.name, paired & ~agrees(f)) for f in fields])
    return theirs.join(ours, list(by), "full_outer").select(*by, F.explode(found).alias("field"))
