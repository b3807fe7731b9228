"""Benchmark scoring: detection measures, release gates, selections, diffs and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copytrail import constants as C
from copytrail.functions.evidence import ELIGIBILITY_REASONS
from copytrail.session import materialize
from copytrail.skew import exact_percentiles


def _wrong() -> Column:
    """A decoded id that is not the expected one; pages without an expected id count too."""
    return F.col("decoded_id").isNotNull() & ~F.col("decoded_id").eqNullSafe(F.col("expected_id"))


def detection_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Thirteen outcome measures. False attribution is over all scheduled rows, the decode rate is not."""
    error = F.col("reason") == "execution_error"
    positive = F.col("expected_id").isNotNull() & (F.col("eligible") | error)
    blank = F.col("decoded_id").isNull()
    counted = rows.groupBy(*by).agg(
        F.count_if(positive & (F.col("decoded_id") == F.col("expected_id"))).alias("true_attribution"),
        F.count_if(positive & blank).alias("missed_detection"), F.count_if(_wrong()).alias("false_attribution"),
        F.count_if(blank & (F.col("reason") == "not_detected")).alias("not_detected"),
        F.count_if(blank & (F.col("reason") == "partial")).alias("partial"),
        F.count_if(blank & (F.col("reason") == "invalid_crc")).alias("invalid_crc"),
        F.count_if(error).alias("execution_errors"),
        F.count_if(F.col("expected_id").isNotNull() & F.col("eligible")).alias("eligible_positive_cases"),
        F.count_if(positive).alias("decode_denominator_positive_cases"),
        F.count_if("eligible").alias("eligible_evaluated_cases"), F.count("*").alias("scheduled_evaluated_cases"))
    return counted.withColumn(
        "decode_rate", F.try_divide("true_attribution", "decode_denominator_positive_cases")).withColumn(
        "false_attribution_rate", F.try_divide("false_attribution", "scheduled_evaluated_cases"))


@dataclass(frozen=True)
class ScoreRules:
    """What differs between the four published scorings."""

    errors_gate: str
    false_gate: str
    quality_gates: tuple[str, ...]
    quality_from_errors: bool = False
    use_minimum: bool = False
    gradient_fixture: str | None = None
    blank_rate: float | None = None


# Gate names and their order are fixed values.
PROFILE_V1 = ScoreRules("benchmark_execution_errors_zero", "false_attribution_zero", (
    "mean_psnr_db_at_least_38", "mean_ssim_at_least_0.95", "complete_quality_population_12"), blank_rate=float("nan"))
PROFILE_V2 = ScoreRules("benchmark_execution_errors_zero", "false_attribution_zero", (
    "complete_quality_population_12", "mean_psnr_db_at_least_38", "mean_ssim_at_least_0.95"),
    quality_from_errors=True, blank_rate=float("nan"))
PREGATE_V2 = ScoreRules("execution_errors_zero", "false_attribution_zero", (
    "mean_psnr_db_at_least_38", "mean_ssim_at_least_0.95", "complete_quality_population_12",
    "gradient_completed_all_four_attacks"), gradient_fixture="image-clean-gradient")
PREGATE_V3 = ScoreRules("execution_errors_zero", "false_attributions_zero", (
    "minimum_psnr_db_at_least_38", "minimum_ssim_at_least_0.95", "complete_quality_population_12"), use_minimum=True)


def profile_scores(rows: DataFrame, rules: ScoreRules, by: Sequence[str] = ("profile_id",),
                   positive_pages: int = C.POSITIVE_PAGES, gradient_fixture: str | None = None,
                   gradient_attacks: int = 4) -> DataFrame:
    """Score each profile in two aggregations: per page (one quality pair each), then per profile.

    Both steps reduce map-side, so a profile holding most rows costs no more than its share of the scan.
    """
    error = F.col("reason") == "execution_error"
    expected = F.col("expected_id").isNotNull()
    hit = ~error & (F.col("decoded_id") == F.col("expected_id"))
    measured = expected if rules.quality_from_errors else expected & ~error
    rated = {}
    for name, (attack, _) in C.RATE_GATES.items():
        scope = expected & (F.col("attack_id") == attack)
        rated[name] = scope & F.col("eligible") if name == "crop025" else scope
    fixture = gradient_fixture or rules.gradient_fixture
    gradient = (F.col("fixture_id") == fixture) & ~error if fixture else F.lit(False)
    page_sums = [F.count("*").alias("scheduled_rows"), F.count_if(error).alias("execution_errors"),
                 F.count_if(_wrong()).alias("false_attribution"), F.sum("elapsed_ms").alias("_ms"),
                 F.count_if(gradient).alias("gradient_completed_attacks")]
    for name, scope in rated.items():
        page_sums += [F.count_if(scope & hit).alias(f"{name}_true_attribution"), F.count_if(scope).alias(f"{name}_denominator")]
    pages = rows.groupBy(*by, "fixture_id", "page_index").agg(
        *page_sums, F.min("candidate_id").alias("_c0"), F.max("candidate_id").alias("_c1"),
        *[fn(F.when(measured, F.col(q))).alias(f"_{tag}_{q}") for q in ("psnr_db", "ssim")
          for tag, fn in (("lo", F.min), ("hi", F.max))])
    names = ["scheduled_rows", "execution_errors", "false_attribution", "gradient_completed_attacks"] + [
        f"{name}_{part}" for name in rated for part in ("true_attribution", "denominator")]

    def reduce(column: str) -> Column:
        # Twelve places: the order of a distributed sum must not decide a gate at its exact threshold.
        return F.min(column) if rules.use_minimum else F.round(F.avg(column), 12)

    word = "minimum" if rules.use_minimum else "mean"
    scored = pages.groupBy(*by).agg(
        F.min("_c0").alias("candidate_id"), (F.min("_c0") == F.max("_c1")).alias("identity_consistent"),
        *[F.sum(n).alias(n) for n in names], F.count("_lo_psnr_db").alias("quality_observations"),
        reduce("_lo_psnr_db").alias(f"{word}_psnr_db"), reduce("_lo_ssim").alias(f"{word}_ssim"),
        F.coalesce(F.bool_and((F.col("_lo_psnr_db") == F.col("_hi_psnr_db")) & (F.col("_lo_ssim") == F.col("_hi_ssim"))),
                   F.lit(True)).alias("quality_consistent"),
        (F.sum("_ms") / F.sum("scheduled_rows")).alias("processing_ms_per_page"))
    for name in rated:
        rate = F.try_divide(f"{name}_true_attribution", f"{name}_denominator")
        if rules.blank_rate is not None:
            rate = F.coalesce(rate, F.lit(rules.blank_rate))
        scored = scored.withColumn(f"{name}_rate", rate)

    def below(column: str, least: float) -> Column:
        return F.col(column).isNull() | ~_finite(column) | (F.col(column) < least)

    failing = {
        f"{word}_psnr_db_at_least_38": below(f"{word}_psnr_db", C.MIN_PSNR_DB),
        f"{word}_ssim_at_least_0.95": below(f"{word}_ssim", C.MIN_SSIM),
        "complete_quality_population_12": F.col("quality_observations") != positive_pages,
        "gradient_completed_all_four_attacks": F.col("gradient_completed_attacks") != gradient_attacks,
    }
    gates = [(rules.errors_gate, F.col("execution_errors") != 0), (rules.false_gate, F.col("false_attribution") != 0)]
    gates += [(f"{name}_decode_rate_at_least_{least:.2f}", below(f"{name}_rate", least))
              for name, (_, least) in C.RATE_GATES.items()]
    gates += [(gate, failing[gate]) for gate in rules.quality_gates]
    failed = F.filter(F.array(*[F.when(test, F.lit(gate)) for gate, test in gates]), lambda g: g.isNotNull())
    return scored.withColumn("failed_gates", failed)


def quality_observations(rows: DataFrame, by: Sequence[str] = ("profile_id",), include_errors: bool = False) -> DataFrame:
    """The single clean quality pair of each profile and page, or an error when repeats disagree."""
    kept = rows.filter(F.col("expected_id").isNotNull())
    if not include_errors:
        kept = kept.filter(F.col("reason") != "execution_error")
    pair = F.struct("psnr_db", "ssim")
    seen = kept.groupBy(*by, "fixture_id", "page_index").agg(F.min(pair).alias("_lo"), F.max(pair).alias("_hi"))
    agree = F.col("_lo") == F.col("_hi")
    return seen.select(*by, "fixture_id", "page_index", F.when(agree, F.col("_lo.psnr_db")).alias("psnr_db"),
                       F.when(agree, F.col("_lo.ssim")).alias("ssim"),
                       F.when(~agree, "inconsistent_quality").alias("error_code"))


def _finite(column: str) -> Column:
    """Neither infinite nor not a number; such quality never passes a gate."""
    return ~F.isnan(column) & (F.abs(column) < float("inf"))


def _worst_rate() -> Column:
    return F.least(*[F.col(f"{name}_rate") for name in C.RATE_GATES])


def eligible_profiles(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles passing all seven thresholds, ranked; empty for a run with any execution error."""
    tests = (F.col("false_attribution") == 0) & (F.col("mean_psnr_db") >= C.MIN_PSNR_DB) & (F.col("mean_ssim") >= C.MIN_SSIM)
    tests &= _finite("mean_psnr_db") & _finite("mean_ssim")
    for name, (_, least) in C.RATE_GATES.items():
        tests &= (F.col(f"{name}_rate") >= least) & ~F.isnan(f"{name}_rate")
    whole = Window.partitionBy(*by)
    order = Window.partitionBy(*by).orderBy(
        F.col("mean_ssim").desc(), F.col("worst_rate").desc(), F.col("processing_ms_per_page"), F.col("profile_id"))
    # One row per profile reaches these windows: the candidate grid holds at most a few dozen.
    clean = scores.withColumn("_errors", F.sum("execution_errors").over(whole)).filter(F.col("_errors") == 0).filter(tests)
    return clean.withColumn("worst_rate", _worst_rate()).withColumn("rank", F.row_number().over(order)).drop("_errors")


def run_status(rows: DataFrame, planned: DataFrame, by: Sequence[str], sharded: bool = False) -> DataFrame:
    """Completion of each run from its row and error counts against the planned number."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("completed_rows"),
                                    F.count_if(F.col("reason") == "execution_error").alias("failed_rows"))
    joined = planned.join(counted, list(by), "left").na.fill(0, ["completed_rows", "failed_rows"])
    whole = F.col("completed_rows") == F.col("planned_rows")
    errors = F.col("failed_rows") > 0
    word = "complete_shard" if sharded else "complete"
    status = (F.when(whole & errors, f"{word}_with_errors").when(whole, word)
              .otherwise("partial" if sharded else "incomplete"))
    return joined.withColumn("status", status)


def qualified_selection(scores: DataFrame, status: DataFrame, by: Sequence[str], all_or_nothing: bool,
                        rows_per_candidate: int | None = 88, denominator: int | None = C.POSITIVE_PAGES) -> DataFrame:
    """Candidates that qualify. Version 2 keeps each passing one; version 3 keeps all or none.

    Either way an incomplete or failing run qualifies nobody.
    """
    passes = (F.size("failed_gates") == 0)
    if not all_or_nothing:
        passes &= F.col("crop025_denominator") > 0
        if rows_per_candidate is not None:
            passes &= F.col("scheduled_rows") == rows_per_candidate
        if denominator is not None:
            passes &= (F.col("jpeg70_denominator") == denominator) & (F.col("resize075_denominator") == denominator)
    run = scores.groupBy(*by).agg(F.bool_and(passes).alias("_all"), F.sum("false_attribution").alias("_false"))
    whole = status.filter((F.col("status") == "complete") & (F.col("failed_rows") == 0)).select(*by)
    chosen = scores.withColumn("_pass", passes).join(whole, list(by)).join(run, list(by))
    keep = (F.col("_all") & (F.col("_false") == 0)) if all_or_nothing else F.col("_pass")
    return chosen.filter(keep).select(*by, "candidate_id")


def error_details(rows: DataFrame) -> DataFrame:
    """Counts of execution errors per fixture and first embedding message."""
    first = F.filter("limitations", lambda item: item.startswith("embedding "))
    message = F.coalesce(F.get(first, F.lit(0)), F.lit("execution error without a specific diagnostic"))
    return rows.filter(F.col("reason") == "execution_error").groupBy("fixture_id", message.alias("message")).agg(
        F.count("*").alias("rows"))


def attack_envelope(rows: DataFrame) -> DataFrame:
    """Hits among positives and false hits among negatives per attack, with a TOTAL row."""
    right = F.col("positive") & F.col("decoded_matches_expected")
    counted = rows.rollup("attack").agg(
        F.count_if("positive").alias("positives"),
        F.count_if(right & F.col("attributed_quorum2")).alias("quorum2_hits"),
        F.count_if(right & F.col("attributed_quorum1")).alias("quorum1_hits"),
        F.count_if(~F.col("positive") & F.col("attributed_quorum2")).alias("quorum2_false"),
        F.count_if(~F.col("positive") & F.col("attributed_quorum1")).alias("quorum1_false"),
        F.grouping("attack").alias("_total"))
    named = counted.withColumn("attack", F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("attack")))
    return named.filter(F.col("positives") > 0).drop("_total").withColumn(
        "quorum2_rate", F.col("quorum2_hits") / F.col("positives")).withColumn(
        "quorum1_rate", F.col("quorum1_hits") / F.col("positives"))


def undecided_breakdown(rows: DataFrame) -> DataFrame:
    """Positives that no policy attributes, by attack and decode status."""
    open_rows = rows.filter(F.col("positive") & ~(F.col("attributed_quorum1") & F.col("decoded_matches_expected")))
    return open_rows.groupBy("attack", "decode_status").agg(F.count("*").alias("rows")).orderBy(
        F.col("rows").desc(), "attack", "decode_status")


def variant_matrix(rows: DataFrame, attacks: Sequence[str]) -> DataFrame:
    """Correct and total per attack as columns, with the worst quality, per variant."""
    cells = []
    for attack in attacks:
        here = F.col("attack") == attack
        cells += [F.count_if(here & F.col("matched")).alias(f"{attack}_correct"), F.count_if(here).alias(f"{attack}_total")]
    return rows.groupBy("variant").agg(*cells, F.min("psnr_db").alias("minimum_psnr_db"), F.min("ssim").alias("minimum_ssim"))


def variant_failures(rows: DataFrame) -> DataFrame:
    """Per variant and page the failing attacks with their vote counts.

    Equal entries are merged before the list is built, so a list never exceeds attacks x vote counts.
    """
    entry = F.format_string("%s(votes=%d)", "attack", "valid_vote_count")
    return rows.filter(~F.col("matched")).select("variant", "fixture_id", "page_index", entry.alias("_entry")).distinct().groupBy(
        "variant", "fixture_id", "page_index").agg(F.concat_ws(", ", F.array_sort(F.collect_list("_entry"))).alias("failures"))


def probe_hits(rows: DataFrame) -> DataFrame:
    return rows.groupBy("attack", "variant").agg(F.count_if("matched").alias("hits"), F.count("*").alias("total"))


def tamper_summary(rows: DataFrame) -> DataFrame:
    """Mean overlap per tamper and overall; limited or failed cases score zero but stay in the denominator."""
    limited, failed = F.size("limitations") > 0, F.col("failure").isNotNull()
    score = F.when(limited | failed, 0.0).otherwise(F.col("measured_iou"))
    summed = rows.rollup("tamper_id").agg(
        F.count("*").alias("scheduled_cases"), F.avg(score).alias("aggregate_iou"), F.count_if(failed).alias("failed_cases"),
        F.count_if(limited).alias("limited_cases"), F.grouping("tamper_id").alias("_total"))
    return summed.withColumn("tamper_id", F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("tamper_id"))).drop("_total")


def limitation_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("limitations").alias("limitation")).groupBy("limitation").agg(F.count("*").alias("cases"))


def timing_distribution(rows: DataFrame, by: Sequence[str], measure: str, approximate: bool = False) -> DataFrame:
    """Count, mean, median, 95th percentile and extremes of a measure."""
    basic = [F.count(measure).alias("n"), F.avg(measure).alias("mean"), F.min(measure).alias("minimum"),
             F.max(measure).alias("maximum")]
    if approximate:
        return rows.groupBy(*by).agg(*basic, F.percentile_approx(measure, 0.5).alias("median"),
                                     F.percentile_approx(measure, 0.95).alias("p95"))
    points = exact_percentiles(rows, by, measure, {"median": 0.5, "p95": 0.95})
    return rows.groupBy(*by).agg(*basic).join(points, list(by))


def population_counts(rows: DataFrame) -> DataFrame:
    """Positive and negative pages and scheduled rows of each candidate."""
    pages = rows.groupBy("candidate_id", "fixture_id", "page_index").agg(
        F.bool_or(F.col("fixture_kind") != "negative_external").alias("_positive"), F.count("*").alias("_rows"))
    return pages.groupBy("candidate_id").agg(
        F.count_if("_positive").alias("positive_pages"), F.count_if(~F.col("_positive")).alias("negative_pages"),
        F.sum("_rows").alias("scheduled_rows"))


def population_equal(observed: DataFrame, contract: DataFrame, key: str) -> DataFrame:
    """Differences between the observed and the contracted set of ids; no rows means equal."""
    seen = observed.groupBy(key).agg(F.count("*").alias("_n"))
    due = contract.select(key).distinct().withColumn("_due", F.lit(True))
    joined = seen.join(due, key, "full_outer")
    code = F.when(F.col("_n").isNull(), "missing").when(F.col("_due").isNull(), "unexpected").when(F.col("_n") > 1, "duplicate")
    return joined.select(key, code.alias("code")).filter(F.col("code").isNotNull())


def _failures(rows: DataFrame, attacks: Sequence[str]) -> DataFrame:
    """Per positive page the set of attacks it failed; at most one entry per listed attack."""
    failed = F.col("expected_id").isNotNull() & ~F.col("decoded_id").eqNullSafe(F.col("expected_id"))
    return rows.filter(failed & F.col("attack_id").isin(*attacks)).groupBy("fixture_id", "page_index").agg(
        *[F.bool_or(F.col("attack_id") == a).alias(f"f{n}") for n, a in enumerate(attacks)])


def shared_failures(rows: DataFrame, attacks: Sequence[str]) -> DataFrame:
    """Pages that fail under every listed attack."""
    marked = _failures(rows, attacks)
    for n in range(len(attacks)):
        marked = marked.filter(F.col(f"f{n}"))
    return marked.select("fixture_id", "page_index")


def failures_beyond_baseline(rows: DataFrame, attacks: Sequence[str], baseline: str = "identity") -> DataFrame:
    """Failing pages per attack, those that pass the baseline, and whether both fail the same pages."""
    every = [baseline, *[a for a in attacks if a != baseline]]
    marked = _failures(rows, every)
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("attack_id"), F.col(f"f{n}").alias("here")) for n, a in enumerate(every) if a != baseline]))
    return marked.select("f0", cells.alias("c")).groupBy("c.attack_id").agg(
        F.count_if("c.here").alias("failing_pages"), F.count_if(F.col("c.here") & ~F.col("f0")).alias("beyond_baseline"),
        (F.count_if(F.col("c.here") != F.col("f0")) == 0).alias("same_pages"))


SCHEDULE_KEY = ("fixture_id", "page_index", "profile_id", "attack_id")


def schedule_diff(planned: DataFrame, observed: DataFrame) -> DataFrame:
    """Every disagreement between a plan and the rows that came back, one code per key and one per repeated id.

    Row ids are only asked for equality, so they travel as 120 bits of their digest; texts are compared where ids repeat.
    """
    seen = observed.withColumns(_id_digest()).groupBy(*SCHEDULE_KEY).agg(
        F.count("*").alias("_n"), *[fn(c).alias(f"_{t}_{c}") for c in ("_id0", "_id1", "candidate_id", "expected_id")
                                    for t, fn in (("lo", F.min), ("hi", F.max))],
        F.count("expected_id").alias("_truths"))
    planned = planned.withColumns(_id_digest()).drop("row_id")
    joined = planned.withColumn("_due", F.lit(True)).join(seen, list(SCHEDULE_KEY), "full_outer")
    present = F.col("_n").isNotNull() & F.col("_due").isNotNull()

    def differs(name: str) -> Column:
        return present & ~(F.col(f"_lo_{name}").eqNullSafe(F.col(name)) & F.col(f"_hi_{name}").eqNullSafe(F.col(name)))

    blank = present & F.col("expected_id").isNotNull() & (F.col("_truths") < F.col("_n"))
    codes = F.filter(F.array(
        F.when(F.col("_n").isNull(), "missing"), F.when(F.col("_due").isNull(), "unexpected"),
        F.when(F.col("_n") > 1, "duplicate_key"), F.when(differs("_id0") | differs("_id1"), "id_mismatch"),
        F.when(differs("candidate_id"), "provenance_mismatch"),
        F.when(differs("expected_id") | blank, "truth_mismatch")), lambda c: c.isNotNull())
    by_key = joined.select(*SCHEDULE_KEY, F.lit(None).cast("string").alias("row_id"), F.explode(codes).alias("code"))
    blank_key = [F.lit(None).cast(planned.schema[c].dataType).alias(c) for c in SCHEDULE_KEY]
    number = F.xxhash64("row_id")
    again = materialize(observed.groupBy(number.alias("_x")).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select("_x"), "repeated_ids")
    by_id = observed.select("row_id", number.alias("_x")).join(again, "_x", "left_semi").groupBy("row_id").agg(F.count("*").alias("_n")).filter(
        F.col("_n") > 1).select(*blank_key, "row_id", F.lit("duplicate_id").alias("code"))
    return by_key.unionByName(by_id)


def _id_digest() -> dict[str, Column]:
    """Two numbers of 60 bits each; null where there is no row id."""
    digest = F.sha2(F.col("row_id").cast("string"), 256)
    return {f"_id{n}": F.conv(F.substring(digest, 1 + 15 * n, 15), 16, 10).cast("long") for n in (0, 1)}


# Reasons of a result row (fixed values).
DECODE_REASONS = ("decoded", "not_detected", "partial", "invalid_crc", "execution_error")


def row_audit(rows: DataFrame, planned: DataFrame, contract: dict[str, object]) -> DataFrame:
    """(row_id, code): everything in which a result row departs from what its plan and contracts say, one row per code.

    ``contract`` gives the values that all rows share: schema version, the four contract digests, the seed. ``planned`` has
    one row per scheduled key with candidate_id, fixture_kind, attack_kind, attack_parameters and ``remaining_tiles``, the
    tiles recomputed by ``crop_eligibility`` (null where no crop applies). A row that failed to run is eligible by default.
    The plan is small beside the rows, so the join moves the rows once at most.
    """
    fields = ("candidate_id", "fixture_kind", "attack_kind", "attack_parameters")
    plan = planned.select(*SCHEDULE_KEY, F.lit(True).alias("_due"), F.col("remaining_tiles").alias("_left"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = rows.join(plan, list(SCHEDULE_KEY), "left")
    due = F.col("_due").isNotNull()
    cropped = F.col("_left").isNotNull() & (F.col("reason") != "execution_error")
    enough = F.col("_left") >= 2
    found = F.struct(F.col("eligible"), F.col("remaining_embedded_tiles").cast("int"), F.col("eligibility_reason"))
    wanted = F.when(cropped, F.struct(enough.alias("eligible"), F.col("_left").cast("int").alias("remaining_embedded_tiles"), F.when(
        enough, ELIGIBILITY_REASONS[1]).otherwise(ELIGIBILITY_REASONS[2]).alias("eligibility_reason"))).otherwise(F.struct(
            F.lit(True).alias("eligible"), F.lit(None).cast("int").alias("remaining_embedded_tiles"), F.lit(ELIGIBILITY_REASONS[0]).alias("eligibility_reason")))
    tests = [("unplanned", ~due)]
    tests += [(f"{name}_mismatch", ~F.col(name).eqNullSafe(F.lit(value))) for name, value in contract.items()]
    tests += [(f"{name}_mismatch", due & ~F.col(name).eqNullSafe(F.col(f"_{name}"))) for name in fields]
    tests += [("reason_invalid", ~F.coalesce(F.col("reason").isin(*DECODE_REASONS), F.lit(False))),
              ("remaining_invalid", F.coalesce(F.col("remaining_embedded_tiles") < 0, F.lit(False))),
              ("eligibility_mismatch", due & ~found.eqNullSafe(wanted))]
    codes = F.filter(F.array(*[F.when(test, F.lit(code)) for code, test in tests]), lambda c: c.isNotNull())
    return joined.select("row_id", F.explode(codes).alias("code"))


def resume_plan(planned: DataFrame, completed: DataFrame) -> DataFrame:
    """Planned rows that have no result yet."""
    return planned.join(completed.select("row_id").distinct(), "row_id", "left_anti")


def select_candidates(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected candidates; ids the grid does not hold come out as error rows."""
    wanted = selected.select("candidate_id").distinct()
    known = candidates.join(wanted, "candidate_id", "left_semi").select("candidate_id", F.lit(None).cast("string").alias("error_code"))
    unknown = wanted.join(candidates, "candidate_id", "left_anti").select("candidate_id", F.lit("unknown_candidate").alias("error_code"))
    empty = wanted.agg(F.count("*").alias("_n")).filter(F.col("_n") == 0).select(
        F.lit(None).cast("string").alias("candidate_id"), F.lit("empty_selection").alias("error_code"))
    return known.unionByName(unknown).unionByName(empty)


def run_field_diff(first: DataFrame, second: DataFrame, key: str = "row_id", ignore: Sequence[str] = ("elapsed_ms", "peak_rss_bytes")) -> DataFrame:
    """Fields that differ between two runs, one row each; timing and memory are expected to differ."""
    fields = [c for c in first.columns if c != key and c not in ignore]
    left = first.select(key, F.struct(*fields).alias("_a"))
    right = second.select(key, F.struct(*fields).alias("_b"))
    joined = left.join(right, key, "full_outer")
    codes = [F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.lit("row"))] + [
        F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields]
    return joined.select(key, F.explode(F.filter(F.array(*codes), lambda c: c.isNotNull())).alias("field"))


def score_lines(scores: DataFrame) -> DataFrame:
    """One fixed-precision table line per scored profile, in profile order (report format is a fixed value)."""
    rate = "%d / %d (%.6f)"
    parts = []
    for name in C.RATE_GATES:
        parts.append(F.format_string(rate, f"{name}_true_attribution", f"{name}_denominator", f"{name}_rate"))
    failed = F.when(F.size("failed_gates") == 0, "none").otherwise(F.array_join("failed_gates", ", "))
    line = F.concat(
        F.format_string("| `%s` | `%s` | %d / %d | %d / %d | ", "profile_id", "candidate_id", "false_attribution",
                        "scheduled_rows", "execution_errors", "scheduled_rows"),
        F.concat_ws(" | ", *parts),
        F.format_string(" | %.6f | %.9f | %.6f | ", "mean_psnr_db", "mean_ssim", "processing_ms_per_page"), failed, F.lit(" |"))
    return scores.select("profile_id", line.alias("line")).orderBy("profile_id")


def tamper_lines(summary: DataFrame) -> DataFrame:
    """One table line per tamper (report format is a fixed value)."""
    return summary.filter(F.col("tamper_id") != "TOTAL").select("tamper_id", F.format_string(
        "| `%s` | %d | %.6f | %d | %d |", "tamper_id", "scheduled_cases", "aggregate_iou", "failed_cases", "limited_cases"
    ).alias("line")).orderBy("tamper_id")


def psnr(pairs: DataFrame, first: str = "a", second: str = "b", data_range: float = 255.0) -> DataFrame:
    """Peak signal-to-noise ratio of aligned sample arrays; infinite when equal, null when shapes differ."""
    squares = F.zip_with(first, second, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)
    mse = total / F.size(first)
    value = F.when(mse == 0.0, F.lit(float("inf"))).otherwise(F.lit(10.0) * F.log10(F.lit(data_range * data_range) / mse))
    aligned = (F.size(first) == F.size(second)) & (F.size(first) > 0)
    return pairs.withColumn("psnr_db", F.when(aligned, value))
