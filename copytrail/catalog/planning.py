"""Queries that plan benchmarks over the documents of the tables."""

import hashlib
import json
from itertools import product

from pyspark.sql import functions as F

from copytrail.catalog import query
from copytrail.plans import benchmark as B
from copytrail.plans import contracts as K

SEED = 20260905


def profile_hashes(version):
    """Candidate digests computed apart from the grid operator, for the statements below."""
    fixed, out = K.FIXED[version], []
    for values in product(*K.SWEEPS[version].values()):
        candidate = {}
        for name, value in zip(K.SWEEPS[version], values):
            candidate.update(value if isinstance(value, dict) else {name: value})
        text = json.dumps({"schema_version": version, "fixed": fixed, "candidate": candidate}, sort_keys=True, separators=(",", ":"))
        out.append(hashlib.sha256(text.encode()).hexdigest())
    return out


ATTACKS = (
    [f"jpeg-q{q}" for q in (95, 85, 70, 50)] + ["crop-f0p1", "crop-f0p25", "crop-f0p5", "resize-s0p5", "resize-s0p75", "resize-s1p5"]
    + [f"rotation-d{d}" for d in ("m5", "m3", "m1", "1", "3", "5")] + [f"brightness-contrast-{n}" for n in range(3)]
    + [f"noise-blur-{n}" for n in range(3)] + ["screenshot-0-raster", "screenshot-1-raster", "screenshot-2-perspective", "combined-0", "combined-1",
    "tamper-0-replace_text", "tamper-1-cover_region", "tamper-2-copy_move", "tamper-3-insert_object"])


def values(items):
    return ", ".join(f"({n}, '{item}')" for n, item in enumerate(items))


def plan_sql(source, candidates, attacks):
    """The plan by joining the dimensions and hashing each combination."""
    seed = f"{SEED:016x}"
    return f"""
    offsets AS (SELECT *, sum(pages) OVER (ORDER BY ordinal) - pages AS before FROM {source}),
    page AS (SELECT fixture_id, kind, before, CAST(unnest(range(pages)) AS INT) AS page_index FROM offsets),
    crossed AS (SELECT p.*, c.n AS cn, c.v AS profile_sha256, a.n AS an, a.v AS attack_id FROM page p, (VALUES {values(candidates)}) c(n, v),
                (VALUES {values(attacks)}) a(n, v)),
    bound AS (SELECT *, unhex('{seed}') || CAST(fixture_id AS BLOB) || unhex('00') || unhex(printf('%08x', page_index)) || unhex(profile_sha256) AS b FROM crossed),
    hashed AS (SELECT *, sha256(CAST('copytrail-case-v1' AS BLOB) || unhex('00') || b || CAST(attack_id AS BLOB)) AS ch,
                 sha256(CAST('copytrail-identity-v1' AS BLOB) || unhex('00') || b) AS ih FROM bound),
    plan AS (SELECT CAST(((before + page_index) * {len(candidates)} + cn) * {len(attacks)} + an AS BIGINT) AS ordinal, fixture_id, page_index, profile_sha256, attack_id,
               sha256(concat(fixture_id, chr(0), CAST(page_index AS STRING), chr(0), profile_sha256, chr(0), attack_id)) AS row_id,
               CAST(concat('0x', substr(ch, 1, 16)) AS UBIGINT) AS seed_number, CAST(CAST(concat('0x', substr(ch, 1, 16)) AS UBIGINT) AS VARCHAR) AS case_seed,
               CASE WHEN kind <> 'negative_external' THEN concat(substr(ih, 1, 8), '-', substr(ih, 9, 4), '-4', substr(ih, 14, 3), '-',
                 substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(ih, 17, 1)), 1), substr(ih, 18, 3), '-', substr(ih, 21, 12)) END AS expected_id FROM hashed)"""


def readable(plan):
    """Seeds as text, because an unsigned 64-bit value has no common type in both engines."""
    return plan.withColumn("case_seed", F.col("case_seed").cast("string"))


def _contracts(i, version):
    return B.candidate_order(B.candidate_grid(i.spark, version)), B.attack_order(B.default_attacks(i.spark))


@query("execution_plan", "WITH" + plan_sql("small_sources", profile_hashes(1), ATTACKS) + "SELECT * EXCLUDE (seed_number) FROM plan")
def _(i):
    return readable(B.execution_plan(i.small_sources, *_contracts(i, 1), SEED))


@query("shard_assign", "WITH" + plan_sql("sources", profile_hashes(3), K.PREGATE_ATTACKS) + """
    SELECT ordinal % 4 AS shard_index, attack_id, count(*) AS rows, min(row_id) AS first_row FROM plan GROUP BY 1, 2""")
def _(i):
    candidates, attacks = _contracts(i, 3)
    plan = B.shard_assign(B.pregate_plan(i.sources, candidates, attacks, SEED), 4)
    return B.first_rows(plan, ["shard_index", "attack_id"], F.count("*").alias("rows"))


@query("pregate_plan_v3", "WITH" + plan_sql("sources", profile_hashes(3), K.PREGATE_ATTACKS) + "SELECT * EXCLUDE (seed_number) FROM plan")
def _(i):
    candidates, attacks = _contracts(i, 3)
    return readable(B.pregate_plan(i.sources, candidates, attacks, SEED, candidate_count=4))


@query("pregate_plan_v2", "WITH" + plan_sql("sources", profile_hashes(2), K.PREGATE_ATTACKS) + """
    SELECT profile_sha256, attack_id, count(*) AS rows, count(expected_id) AS positives, min(row_id) AS first_row, CAST(max(seed_number) AS VARCHAR) AS largest_seed
    FROM plan GROUP BY 1, 2""")
def _(i):
    candidates, attacks = _contracts(i, 2)
    found = B.first_rows(B.pregate_plan(i.sources, candidates, attacks, SEED, candidate_count=16), ["profile_sha256", "attack_id"],
                         F.count("*").alias("rows"), F.count("expected_id").alias("positives"), F.max("case_seed").alias("largest_seed"))
    return found.select("profile_sha256", "attack_id", "rows", "positives", "first_row", F.col("largest_seed").cast("string"))


@query("smoke_subset", """
    WITH pos AS (SELECT * FROM sources WHERE kind IN ('clean_image', 'tamper_ground_truth') ORDER BY ordinal LIMIT 1),
    neg AS (SELECT * FROM sources WHERE kind = 'negative_external' ORDER BY ordinal LIMIT 1),
    chosen AS (SELECT * FROM pos UNION ALL SELECT * FROM neg),""" + plan_sql("chosen", profile_hashes(1)[:1], [a for a in ATTACKS if a in K.SMOKE_ATTACKS])
       + "SELECT * EXCLUDE (seed_number) FROM plan")
def _(i):
    return readable(B.smoke_subset(i.sources, *_contracts(i, 1), SEED))


TAIL = "\n" + json.dumps({"attacks": ATTACKS, "candidates": profile_hashes(1)}, separators=(",", ":"))


@query("plan_digest", """
    WITH d0 AS (SELECT ordinal, sha256(concat(fixture_id, chr(0), kind, chr(0), sha256, chr(0), CAST(pages AS STRING))) AS d FROM sources),
    d1 AS (SELECT ordinal // 4096 AS ordinal, sha256(string_agg(d, chr(10) ORDER BY ordinal)) AS d FROM d0 GROUP BY 1),
    d2 AS (SELECT ordinal // 4096 AS ordinal, sha256(string_agg(d, chr(10) ORDER BY ordinal)) AS d FROM d1 GROUP BY 1),
    d3 AS (SELECT ordinal // 4096 AS ordinal, sha256(string_agg(d, chr(10) ORDER BY ordinal)) AS d FROM d2 GROUP BY 1)
    SELECT sha256(concat(d, '""" + TAIL + "')) AS plan_sha256 FROM d3")
def _(i):
    return B.plan_digest(i.sources, *_contracts(i, 1))
