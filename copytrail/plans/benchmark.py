"""Benchmark plans: attack cases, candidate grids and the rows they span.

Contracts are small by definition; their size is checked before their rows become literals of a plan. The
sources may be many, so plan rows come from exploding literals next to each source page: no join, no
shuffle, and every row computes its ordinal by arithmetic.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copytrail.functions import ids
from copytrail.functions.text import codes
from copytrail.plans import contracts as K
from copytrail.session import materialize
from copytrail.skew import running_sum

CONTRACT_ROWS = 10_000

_FAMILIES = (
    # family, case-id format over (value or index), kind, parameter name for plain values
    ("jpeg_quality", "jpeg-q", "jpeg", "quality"), ("crop_fraction", "crop-f", "crop", "fraction"),
    ("resize_scale", "resize-s", "resize", "scale"), ("rotation_degrees", "rotation-d", "rotation", "degrees"),
    ("brightness_contrast", "brightness-contrast-", "brightness_contrast", None),
    ("gaussian_noise_blur", "noise-blur-", "noise_blur", None), ("screenshot", "screenshot-", "screenshot", None),
    ("combined", "combined-", "combined", None), ("tamper", "tamper-", "tamper", None),
)
MATRIX_SCHEMA = "schema_version int, " + ", ".join(f"{family} array<string>" for family, *_ in _FAMILIES)


def contract_rows(df: DataFrame, bound: int = CONTRACT_ROWS) -> list:
    """Rows of a contract table, refused when there are more than a contract may hold."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"a contract holds at most {bound} rows")
    return rows


def read_attack_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Attack cases of a JSON contract, in contract order."""
    return attack_cases(spark.read.schema(MATRIX_SCHEMA).option("multiLine", True).json(path))


def default_attacks(spark: SparkSession) -> DataFrame:
    text = json.dumps(K.ATTACK_MATRIX)
    return attack_cases(spark.range(1).select(F.from_json(F.lit(text), MATRIX_SCHEMA).alias("m")).select("m.*"))


def _operation(case_id: str, kind: str, parameters: Column) -> Column:
    return F.struct(F.lit(case_id).alias("case_id"), F.lit(kind).alias("kind"), parameters.alias("parameters"))


def attack_cases(matrix: DataFrame) -> DataFrame:
    """One row per attack: ordinal, case id, kind, parameters as JSON, and the ordered parts of a combined one."""
    spec = F.col("spec")
    slug = F.replace(F.replace(spec, F.lit("-"), F.lit("m")), F.lit("."), F.lit("p"))

    def member(name: str) -> Column:
        return F.get_json_object(spec, f"$.{name}")

    def pair(name: str, source: str) -> Column:
        return F.concat(F.lit(f'{{"{name}":'), member(source), F.lit("}"))

    raster = F.concat(F.lit('{"kind":"raster","width_px":'), member("width_px"), F.lit(',"height_px":'), member("height_px"), F.lit("}"))
    parts = (
        F.when(member("operations") == '["jpeg","crop"]', F.array(
            _operation("combined-jpeg", "jpeg", pair("quality", "jpeg_quality")), _operation("combined-crop", "crop", pair("fraction", "crop_fraction"))))
        .when(member("operations") == '["screenshot","perspective"]', F.array(
            _operation("combined-screenshot", "screenshot", raster), _operation("combined-perspective", "perspective", pair("corner_offsets", "corner_offsets"))))
    )
    none = F.lit(None).cast("array<struct<case_id:string,kind:string,parameters:string>>")
    cases = None
    for place, (family, prefix, kind, plain) in enumerate(_FAMILIES):
        rows = matrix.select(F.posexplode(family).alias("position", "spec"))
        if plain:
            case_id, parameters = F.concat(F.lit(prefix), slug), F.concat(F.lit(f'{{"{plain}":'), spec, F.lit("}"))
        else:
            suffix = F.concat(F.lit("-"), member("kind")) if kind in ("screenshot", "tamper") else F.lit("")
            case_id, parameters = F.concat(F.lit(prefix), F.col("position").cast("string"), suffix), spec
        part = rows.select(F.lit(place).alias("family"), "position", case_id.alias("case_id"), F.lit(kind).alias("kind"),
                           parameters.alias("parameters"), (parts if kind == "combined" else none).alias("operations"))
        cases = part if cases is None else cases.unionByName(part)
    return cases.withColumn("error_code", F.when((F.col("kind") == "combined") & F.col("operations").isNull(), "unsupported_operations"))


def attack_order(cases: DataFrame) -> list[str]:
    """Case ids in contract order."""
    rows = contract_rows(cases.select("family", "position", "case_id"))
    return [r.case_id for r in sorted(rows, key=lambda r: (r.family, r.position))]


def candidate_grid(spark: SparkSession, version: int) -> DataFrame:
    """Every candidate of a grid version: ordinal, swept values as JSON, and a digest over them and the fixed part."""
    sweep = K.SWEEPS[version]
    grid, size = spark.range(1).select(F.lit(0).alias("ordinal")), 1
    for name, values in sweep.items():
        flat = [v if isinstance(v, dict) else {name: v} for v in values]
        texts = F.array(*[F.lit(json.dumps(v)[1:-1]) for v in flat])
        grid = grid.select("*", F.posexplode(texts).alias("_at", name)).withColumn("ordinal", F.col("ordinal") * len(values) + F.col("_at")).drop("_at")
        size *= len(values)
    # Members are put in key order so that equal candidates have equal text.
    order = sorted(sweep, key=lambda n: "qim_delta" if n == "level" else n)
    members = F.concat_ws(", ", *[F.col(n) for n in order]) if version != 2 else F.concat_ws(
        ", ", F.col("payload_repetitions"), F.regexp_extract("level", '("pilot_strength_rms": [0-9.]+)', 1),
        F.regexp_extract("level", '("qim_delta": [0-9.]+)', 1), F.col("tile_size_px"))
    text = F.concat(F.lit("{"), F.replace(F.replace(members, F.lit(": "), F.lit(":")), F.lit(", "), F.lit(",")), F.lit("}"))
    fixed = json.dumps(K.FIXED[version], sort_keys=True, separators=(",", ":"))
    digest = F.sha2(F.concat(F.lit('{"candidate":'), text, F.lit(f',"fixed":{fixed},"schema_version":{version}}}')), 256)
    return grid.select("ordinal", text.alias("candidate"), digest.alias("profile_sha256"), _candidate_id(version, text).alias("candidate_id"))


def _candidate_id(version: int, text: Column) -> Column:
    """Binary identity of a version-1 candidate as hex: tag, version, strength as a double, three integers.

    The identities of later versions also hold the digest of a contract file and are left null.
    """
    if version != 1:
        return F.lit(None).cast("string")
    doubles = F.create_map(*[F.lit(x) for v in K.SWEEPS[1]["qim_delta"] for x in (str(v), struct.pack(">d", v).hex())])
    fields = [F.lpad(F.hex(F.get_json_object(text, f"$.{name}").cast("int")), 8, "0") for name in ("tile_size_px", "tiles_per_page", "payload_repetitions")]
    return F.lower(F.concat(F.lit(K.CANDIDATE_TAG.hex() + "00000001"), F.element_at(doubles, F.get_json_object(text, "$.qim_delta")), *fields))


GRID_SCHEMA = (
    "schema_version int, fixed struct<tiles_per_page:int,bit_replication:int,payload_codeword_bytes:int>, "
    "coupled_levels array<struct<qim_delta:double,pilot_strength_rms:double>>, sweep struct<tile_size_px:array<int>,payload_repetitions:array<int>>")
#: Pixels of a tile's side per carrier, and bits that each carrier holds.
CARRIER_PX, CARRIER_BITS = 16, 2


def read_candidate_grid(spark: SparkSession, path: str, tag: bytes = K.GRID_TAG) -> DataFrame:
    """Candidates of a caller's contract file: coupled levels x tile sizes x repetitions, in that order, with their identities.

    candidate_id is hex: the tag, the SHA-256 of the file's bytes, the schema version, two doubles and four integers, most
    significant byte first. ``errors`` names what a candidate breaks: ``capacity`` (its tile cannot hold the codeword),
    ``identity`` (a member is missing or no number) or ``duplicate``. A file that is no such object gives no candidates.
    """
    files = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("contract_sha256"), F.from_json(F.decode("content", "UTF-8"), GRID_SCHEMA).alias("g"))
    grid = files.select("contract_sha256", "g.schema_version", "g.fixed.*", "g.sweep", F.posexplode("g.coupled_levels").alias("_l", "level"))
    grid = grid.select("*", F.posexplode("sweep.tile_size_px").alias("_t", "tile_size_px"))
    grid = grid.select("*", F.posexplode("sweep.payload_repetitions").alias("_r", "payload_repetitions"))
    tiles, rounds = F.size("sweep.tile_size_px"), F.size("sweep.payload_repetitions")

    def word(column: str) -> Column:
        return F.lower(F.lpad(F.hex(F.col(column)), 8, "0"))

    identity = F.concat(F.lit(tag.hex()), "contract_sha256", word("schema_version"), ids.double_hex(F.col("level.qim_delta")), ids.double_hex(F.col("level.pilot_strength_rms")),
                        word("tile_size_px"), word("tiles_per_page"), word("payload_repetitions"), word("bit_replication"))
    named = grid.select(((F.col("_l") * tiles + F.col("_t")) * rounds + F.col("_r")).alias("ordinal"), "contract_sha256", "level.*", "tile_size_px", "tiles_per_page",
                        "payload_repetitions", "bit_replication", "payload_codeword_bytes", identity.alias("candidate_id"))
    side = F.floor(F.col("tile_size_px") / CARRIER_PX)
    same = F.count("*").over(Window.partitionBy("contract_sha256", "candidate_id"))  # a contract holds a few dozen candidates
    errors = codes(("capacity", side * side * CARRIER_BITS < F.col("payload_codeword_bytes") * 8 * F.col("bit_replication")),
                   ("identity", F.col("candidate_id").isNull()), ("duplicate", F.col("candidate_id").isNotNull() & (same > 1)))
    return named.withColumn("errors", errors).drop("payload_codeword_bytes")


def candidate_order(grid: DataFrame) -> list[str]:
    return [r.profile_sha256 for r in sorted(contract_rows(grid), key=lambda r: r.ordinal)]


CORPUS_SCHEMA = (
    "schema_version int, begin bigint, entries array<struct<fixture_id:string,kind:string,relative_path:string,sha256:string,pages:int,"
    "ground_truth_regions:array<struct<x:double,y:double,width:double,height:double>>>>")
#: Entries in one piece of a manifest.
PIECE = 4096


def write_corpus(sources: DataFrame, path: str, schema_version: int = 1) -> None:
    """Sources (ordinal and the members of an entry) as a manifest in pieces: one JSON object a line, each with a run of entries.

    ``begin`` is where a piece's run starts in the order of all. Ordinals count from 0 without gaps.
    """
    members = F.struct("ordinal", F.struct("fixture_id", "kind", "relative_path", "sha256", "pages", "ground_truth_regions").alias("e"))
    runs = sources.groupBy((F.floor(F.col("ordinal") / PIECE) * PIECE).alias("begin")).agg(F.array_sort(F.collect_list(members), lambda a, b: F.signum(a["ordinal"] - b["ordinal"]).cast("int")).alias("m"))
    runs.select(F.lit(schema_version).alias("schema_version"), "begin", F.transform("m", lambda m: m["e"]).alias("entries")).write.json(path)


def read_corpus(spark: SparkSession, path: str, pieces: bool = False) -> DataFrame:
    """Sources of a corpus manifest with the rules each one breaks.

    A manifest is one JSON document, which one task reads, or, with ``pieces``, what ``write_corpus`` wrote, which many do.
    """
    from copytrail.functions.geometry import rect_valid

    entries = spark.read.schema(CORPUS_SCHEMA).option("multiLine", not pieces).option("mode", "FAILFAST").json(path).select(
        F.coalesce("begin", F.lit(0)).alias("begin"), F.posexplode("entries").alias("place", "e")).select((F.col("begin") + F.col("place")).alias("ordinal"), "e.*")
    repeated = entries.groupBy("fixture_id").agg(F.count("*").alias("_n"))
    rows = entries.join(repeated, "fixture_id", "left")
    truth = F.coalesce("ground_truth_regions", F.array().cast("array<struct<x:double,y:double,width:double,height:double>>"))
    errors = codes(
        ("fixture_id", F.coalesce(F.length("fixture_id"), F.lit(0)) == 0), ("duplicate_fixture_id", F.col("_n") > 1),
        ("kind", ~F.coalesce(F.col("kind").isin(*K.SOURCE_KINDS), F.lit(False))),
        ("relative_path", F.col("relative_path").isNull() | F.col("relative_path").startswith("/") | F.col("relative_path").rlike(r"(^|/)\.\.(/|$)")),
        ("sha256", F.coalesce(F.length("sha256"), F.lit(0)) != 64), ("pages", F.coalesce("pages", F.lit(0)) < 1),
        ("ground_truth_invalid", F.exists(truth, lambda r: ~rect_valid(r))),
        ("ground_truth_missing", (F.col("kind") == "tamper_ground_truth") & (F.size(truth) == 0)))
    return rows.withColumn("errors", errors).drop("_n")


def execution_plan(sources: DataFrame, candidates: Sequence[str], attacks: Sequence[str], seed: int) -> DataFrame:
    """Pages x candidates x attacks with row id, case seed, expected id and global ordinal.

    ``sources`` carries (ordinal, fixture_id, kind, pages). Page offsets are a running sum over slices of the
    source order; everything after it is a projection.
    """
    if not candidates or not attacks:
        raise ValueError("a plan needs candidates and attacks")
    if max(len(candidates), len(attacks)) > CONTRACT_ROWS:
        raise ValueError("contract too large")
    placed = running_sum(sources.select("ordinal", "fixture_id", "kind", "pages").withColumn("_plan", F.lit(0)), ["_plan"],
                         [F.col("ordinal")], "pages", F.floor(F.col("ordinal") / 65536), "_upto")
    pages = placed.select("fixture_id", "kind", (F.col("_upto") - F.col("pages")).alias("_before"),
                          F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page_index"))
    rows = pages.select("*", F.posexplode(F.array(*[F.lit(c) for c in candidates])).alias("_c", "profile_sha256")).select(
        "*", F.posexplode(F.array(*[F.lit(a) for a in attacks])).alias("_a", "attack_id"))
    fx, page, profile, attack = F.col("fixture_id"), F.col("page_index"), F.col("profile_sha256"), F.col("attack_id")
    ordinal = ((F.col("_before") + page) * len(candidates) + F.col("_c")) * len(attacks) + F.col("_a")
    expected = F.when(F.col("kind") != "negative_external", ids.expected_issuance_id(seed, fx, page, profile))
    return rows.select(ordinal.alias("ordinal"), "fixture_id", "page_index", "profile_sha256", "attack_id",
                       ids.row_id(fx, page, profile, attack).alias("row_id"),
                       ids.case_seed(seed, fx, page, profile, attack).alias("case_seed"), expected.alias("expected_id"))


def shard_assign(plan: DataFrame, shard_count: int) -> DataFrame:
    """Shard of each plan row: its ordinal modulo the shard count."""
    if shard_count < 1:
        raise ValueError("shard_count must be positive")
    return plan.withColumn("shard_index", F.col("ordinal") % shard_count)


def first_rows(plan: DataFrame, by: Sequence[str], *counts: Column) -> DataFrame:
    """``by``, ``counts`` and first_row, the least row id of each group.

    The least of texts makes Spark sort all rows of a task before it combines them. So groups take the least number that the first
    15 hex digits of an id give, which combines in place, and only rows with that number are compared as texts.
    """
    lead = F.conv(F.substring("row_id", 1, 15), 16, 10).cast("long")
    groups = materialize(plan.groupBy(*by).agg(*counts, F.min(lead).alias("_lead")), "plan_groups")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    wanted = groups.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_lead").alias("_least"))
    first = plan.select(*by, "row_id", lead.alias("_at")).join(wanted, reduce(and_, [F.col("_at") == F.col("_least"), *same])).groupBy(*by).agg(
        F.min("row_id").alias("first_row")).select(*[F.col(c).alias(f"_{c}") for c in by], "first_row")
    return groups.join(first, reduce(and_, same), "left").select(*[c for c in groups.columns if c != "_lead"], "first_row")


def pregate_plan(sources: DataFrame, candidates: Sequence[str], attacks: Sequence[str], seed: int,
                 positive_pages: int | None = None, negative_pages: int | None = None, candidate_count: int | None = None) -> DataFrame:
    """A plan over identity and the three gate attacks; a dimension that differs from the contract is an error."""
    missing = [a for a in K.PREGATE_ATTACKS[1:] if a not in attacks]
    if missing:
        raise ValueError(f"attack matrix lacks {missing}")
    if candidate_count is not None and len(candidates) != candidate_count:
        raise ValueError("candidate grid does not match the contract")
    if positive_pages is not None or negative_pages is not None:
        negative = F.col("kind") == "negative_external"
        found = sources.agg(F.sum(F.when(~negative, F.col("pages"))).alias("p"), F.sum(F.when(negative, F.col("pages"))).alias("n")).first()
        if (found.p or 0, found.n or 0) != (positive_pages, negative_pages):
            raise ValueError("corpus does not match the contracted population")
    return execution_plan(sources, candidates, K.PREGATE_ATTACKS, seed)


def smoke_sources(sources: DataFrame) -> DataFrame:
    """The preferred positive source (else the first image source) and the first negative one."""
    image = F.col("kind").isin("clean_image", "tamper_ground_truth") | (F.col("fixture_id") == K.SMOKE_SOURCE)
    whole = F.struct("ordinal", "fixture_id", "kind", "pages")
    order = F.struct((F.col("fixture_id") != K.SMOKE_SOURCE).alias("_other"), F.col("ordinal"))
    negative = F.col("kind") == "negative_external"
    picked = sources.agg(F.min_by(F.when(image, whole), F.when(image, order)).alias("a"),
                         F.min_by(F.when(negative, whole), F.when(negative, F.col("ordinal"))).alias("b"))
    return picked.select(F.explode(F.array_compact(F.array("a", "b"))).alias("s")).select("s.*")


def smoke_attacks(attacks: Sequence[str]) -> list[str]:
    chosen = [a for a in attacks if a in K.SMOKE_ATTACKS]
    return chosen or list(attacks[:3])


def smoke_subset(sources: DataFrame, candidates: Sequence[str], attacks: Sequence[str], seed: int) -> DataFrame:
    return execution_plan(smoke_sources(sources), candidates[:1], smoke_attacks(attacks), seed)


DIGEST_CHUNK = 4096


def _chunked(rows: DataFrame) -> DataFrame:
    """One digest per run of ``DIGEST_CHUNK`` neighbouring ordinals."""
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "digest")))
    return rows.groupBy(F.floor(F.col("ordinal") / DIGEST_CHUNK).alias("ordinal")).agg(
        F.sha2(F.array_join(F.transform(listed, lambda r: r["digest"]), "\n"), 256).alias("digest"))


def plan_digest(sources: DataFrame, candidates: Sequence[str], attacks: Sequence[str]) -> DataFrame:
    """Order-sensitive digest of a plan.

    Source lines are hashed, then runs of 4096 digests are hashed, three times over; no step holds more than
    one run, for up to 6.8e10 sources. The two short lists enter the last hash as text.
    """
    level = sources.select("ordinal", F.sha2(F.concat_ws("\x00", "fixture_id", "kind", "sha256", F.col("pages").cast("string")), 256).alias("digest"))
    for _ in range(3):
        level = _chunked(level)
    tail = "\n" + json.dumps({"attacks": list(attacks), "candidates": list(candidates)}, separators=(",", ":"))
    return level.select(F.sha2(F.concat("digest", F.lit(tail)), 256).alias("plan_sha256"))
