"""Known values and boundaries."""

import json

import pytest
from pyspark.sql import functions as F

from copytrail import constants as C
from copytrail.functions import evidence as E
from copytrail.functions import geometry as G
from copytrail.functions import ids as I
from copytrail.functions import text as X
from copytrail.operators import lifecycle as L
from copytrail.operators import scoring as S
from copytrail.operators import tracing as T
from copytrail.operators import voting as V
from copytrail.plans import benchmark as B
from copytrail.plans import contracts as K


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_payload_vector(spark):
    frame = I.payload_frame(F.lit("12345678-1234-5678-1234-567812345678"))
    assert one(spark, F.lower(F.hex(frame))) == "534201123456781234567812345678123456789ae24281"
    assert one(spark, I.payload_check(frame)).asDict() == {"reason": None, "issuance_id": "12345678-1234-5678-1234-567812345678"}
    assert one(spark, I.payload_check(F.substring(frame, 1, 22))).reason == "length"


def test_name_id_is_version_five(spark):
    import uuid

    assert one(spark, I.name_id(F.lit("a:b:1"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a:b:1"))


def test_candidate_grids(spark):
    sizes = {version: B.candidate_grid(spark, version).count() for version in (1, 2, 3)}
    assert sizes == {1: 48, 2: 16, 3: 4}
    first = {r.profile_sha256: r.candidate_id for r in B.candidate_grid(spark, 1).collect()}
    # Two published candidate digests with their binary identities.
    assert first["03510a2e34b63a408b304d69a40155e8b5217f05f52c8f1f3a13184e7f50b613"] == "5342465001000000014024000000000000000001800000001800000003"
    assert first["0c23090699a7028897b011009c0e2ba0a00d3106c5586d1ba1efc342557025ac"] == "5342465001000000014020000000000000000001000000000c00000003"


def test_attack_cases(spark, tmp_path):
    path = tmp_path / "matrix.json"
    path.write_text(json.dumps(K.ATTACK_MATRIX, indent=1))
    cases = B.read_attack_matrix(spark, str(path))
    order = B.attack_order(cases)
    assert len(order) == 31 and order[0] == "jpeg-q95" and order[-1] == "tamper-3-insert_object"
    assert {"rotation-dm5", "resize-s0p75", "screenshot-2-perspective"} <= set(order)
    combined = {r.case_id: r for r in cases.filter("kind = 'combined'").collect()}
    assert [o.kind for o in combined["combined-0"].operations] == ["jpeg", "crop"]
    assert json.loads(combined["combined-1"].operations[1].parameters)["corner_offsets"][0] == [0.03, 0.02]
    assert cases.filter("error_code IS NOT NULL").count() == 0


def corpus(spark):
    kinds = [("clean_pdf", 1)] * 3 + [("clean_pdf", 3), ("clean_pdf", 2)] + [("clean_image", 1)] * 3 + [("negative_external", 1)] * 10 + [("tamper_ground_truth", 1)]
    rows = [(n, f"src-{n}", kind, "0" * 64, pages) for n, (kind, pages) in enumerate(kinds)]
    return spark.createDataFrame(rows, "ordinal bigint, fixture_id string, kind string, sha256 string, pages int")


def test_plan_sizes(spark):
    attacks = B.attack_order(B.default_attacks(spark))
    full = B.execution_plan(corpus(spark), B.candidate_order(B.candidate_grid(spark, 1)), attacks, 20260827)
    stats = full.agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"),
                     F.countDistinct("ordinal").alias("places"), F.count("expected_id").alias("positive")).first()
    assert tuple(stats) == (32736, 32736, 0, 32735, 32736, 12 * 48 * 31)
    for version, rows in ((2, 1408), (3, 352)):
        plan = B.pregate_plan(corpus(spark), B.candidate_order(B.candidate_grid(spark, version)), attacks, 1, 12, 10)
        assert plan.count() == rows
    with pytest.raises(ValueError):
        B.pregate_plan(corpus(spark), ["c"], attacks, 1, 11, 10)
    shards = B.shard_assign(full, 4).groupBy("shard_index").count().collect()
    assert {r["count"] for r in shards} == {8184}


def test_plan_digest_depends_on_order(spark):
    sources = corpus(spark)
    swapped = sources.withColumn("ordinal", F.expr("CASE ordinal WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE ordinal END"))
    digest = lambda s, c=("a", "b"): B.plan_digest(s, c, ["x"]).first()[0]
    assert digest(sources) == digest(sources) != digest(swapped) and digest(sources) != digest(sources, ("b", "a"))


def test_read_corpus_names_broken_rules(spark, tmp_path):
    good = {"fixture_id": "a", "kind": "clean_pdf", "relative_path": "g/a.pdf", "sha256": "0" * 64, "pages": 1}
    entries = [good, {**good, "fixture_id": "b", "pages": 0}, {**good, "fixture_id": "c", "kind": "tamper_ground_truth"},
               {**good, "fixture_id": "d", "kind": "odd", "relative_path": "../x"}, {**good, "fixture_id": "e"}, {**good, "fixture_id": "e"}]
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps({"schema_version": 1, "entries": entries}, indent=1))
    found = {(r.fixture_id, tuple(r.errors)) for r in B.read_corpus(spark, str(path)).collect()}
    assert found == {("a", ()), ("b", ("pages",)), ("c", ("ground_truth_missing",)), ("d", ("kind", "relative_path")), ("e", ("duplicate_fixture_id",))}


def test_corpus_in_pieces_keeps_its_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "PIECE", 3)
    rows = spark.createDataFrame([(k, f"f{k}", "clean_pdf", "a", "0" * 64, 1, []) for k in range(10)],
                                 "ordinal long, fixture_id string, kind string, relative_path string, sha256 string, pages int, ground_truth_regions array<struct<x:double,y:double,width:double,height:double>>")
    B.write_corpus(rows, str(tmp_path / "c"))
    back = B.read_corpus(spark, str(tmp_path / "c"), pieces=True).collect()
    assert {(r.ordinal, r.fixture_id, tuple(r.errors)) for r in back} == {(k, f"f{k}", ()) for k in range(10)}


def test_transition_matrix(spark):
    states = list(C.JOB_EDGES)
    requests = spark.createDataFrame([(s, t, a) for s in states for t in states for a in (0, 2, 3)], "status string, target string, attempt int")
    for r in L.apply_transitions(requests).collect():
        if r.attempt == 3:
            want = "JOB_ATTEMPT"
        elif r.target not in C.JOB_EDGES[r.status]:
            want = "JOB_TRANSITION"
        else:
            want = "JOB_ATTEMPT" if (r.status, r.target, r.attempt) == ("retryable_failed", "queued", 2) else None
        assert r.error_code == want


ROW = "profile_id string, candidate_id string, fixture_id string, page_index int, attack_id string, expected_id string, decoded_id string, reason string, eligible boolean, psnr_db double, ssim double, elapsed_ms double"


def benchmark_rows(hits, psnr=38.0, ssim=0.95, error=False):
    out = []
    for page in range(12):
        for attack in ("identity", "jpeg-q70", "resize-s0p75", "crop-f0p25"):
            hit = page < hits.get(attack, 12)
            out.append(("p", "c", f"fx{page}", 0, attack, "id", "id" if hit else None, "decoded" if hit else "not_detected", True, psnr, ssim, 1.0))
    if error:
        out[0] = out[0][:6] + ("id", "execution_error") + out[0][8:]
    return out


@pytest.mark.parametrize("hits,psnr,ssim,error,failed", [
    ({}, 38.0, 0.95, False, []),
    ({"jpeg-q70": 11}, 38.0, 0.95, False, ["jpeg70_decode_rate_at_least_0.95"]),
    ({"crop-f0p25": 11}, 38.0, 0.95, False, []),
    ({"crop-f0p25": 10}, 38.0, 0.95, False, ["crop025_decode_rate_at_least_0.90"]),
    ({}, 37.999, 0.949, False, ["mean_psnr_db_at_least_38", "mean_ssim_at_least_0.95"]),
    ({}, 38.0, 0.95, True, ["benchmark_execution_errors_zero"]),
])
def test_gate_boundaries(spark, hits, psnr, ssim, error, failed):
    rows = spark.createDataFrame(benchmark_rows(hits, psnr, ssim, error), ROW)
    assert S.profile_scores(rows, S.PROFILE_V1).first().failed_gates == failed


def test_error_row_with_the_right_id_is_a_miss(spark):
    rows = benchmark_rows({})
    rows[1] = rows[1][:7] + ("execution_error",) + rows[1][8:]
    score = S.profile_scores(spark.createDataFrame(rows, ROW), S.PREGATE_V2).first()
    assert (score.jpeg70_true_attribution, score.jpeg70_denominator) == (11, 12)


def test_minimum_quality_differs_from_mean(spark):
    rows = [r[:9] + (36.0 if r[2] == "fx0" else 50.0,) + r[10:] for r in benchmark_rows({})]
    frame = spark.createDataFrame(rows, ROW)
    assert S.profile_scores(frame, S.PROFILE_V1).first().failed_gates == []
    assert S.profile_scores(frame, S.PREGATE_V3).first().failed_gates == ["minimum_psnr_db_at_least_38"]


def test_inconsistent_quality_is_an_error(spark):
    rows = benchmark_rows({})
    rows[1] = rows[1][:9] + (39.0,) + rows[1][10:]
    found = S.quality_observations(spark.createDataFrame(rows, ROW)).filter("error_code IS NOT NULL").collect()
    assert [(r.fixture_id, r.psnr_db) for r in found] == [("fx0", None)]


VOTE = "subject_id string, candidate_id string, tile_ordinal int, issuance_id string, reason string, bit_error_rate double"


def votes(*rows):
    return [("s", c, t, i, "decoded" if i else r, b) for c, t, i, r, b in rows]


@pytest.mark.parametrize("rows,reason,issuance,support", [
    (votes(("c", 0, "a", "", 0.0), ("c", 1, "a", "", 0.0), ("c", 2, None, "not_detected", None)), "decoded", "a", 2 / 3),
    (votes(("c", 0, "a", "", 0.0), ("c", 1, None, "invalid_crc", None)), "partial", None, 0.5),
    (votes(("c", 0, None, "invalid_crc", None), ("c", 1, None, "not_detected", None)), "invalid_crc", None, 0.0),
    (votes(("c", 0, None, "not_detected", None)), "not_detected", None, 0.0),
    (votes(("c", 0, "a", "", 0.0), ("c", 1, "a", "", 0.0), ("d", 0, "b", "", 0.0), ("d", 1, "b", "", 0.0)), "partial", None, 1.0),
    (votes(("c", 0, "a", "", 0.0), ("c", 0, "b", "", 0.0)), "conflicting_duplicate", None, None),
    (votes(("c", 0, "a", "", 0.0), ("c", 0, "a", "", 0.0)), "partial", None, 1.0),
])
def test_soft_vote(spark, rows, reason, issuance, support):
    r = V.soft_vote(spark.createDataFrame(rows, VOTE)).first()
    assert (r.reason, r.issuance_id) == (reason, issuance) and r.confidence == pytest.approx(support)


def test_later_votes_fail_closed_on_a_second_identity(spark):
    frame = spark.createDataFrame(votes(("c", 0, "a", "", 0.0), ("c", 1, "a", "", 0.0), ("c", 2, "a", "", 0.0), ("c", 3, "b", "", 0.0)), VOTE)
    two = V.payload_votes_v2(frame, {"c": 3}).first()
    three = V.payload_votes_v3(frame, {"c": 3}, ["bit_error_rate"]).first()
    assert (two.status, two.issuance_id) == ("partial_payload_evidence", None)
    assert (three.status, three.issuance_id, three.valid_votes) == ("conflicting_payload_evidence", None, 3)


@pytest.mark.parametrize("status,exact,sig,code", [
    ("PROCESSING_FAILED", True, True, "processing_failed"), ("VERIFIED_INTACT", True, False, "invalid_manifest"),
    ("VERIFIED_INTACT", True, True, "intact"), ("VERIFIED_INTACT", True, None, "unresolved"), ("NO_WATERMARK", False, None, "no_match"),
    ("NO_WATERMARK", None, None, "unresolved"), ("SOURCE_IDENTIFIED_MODIFIED", False, None, "identified_modified"), (None, None, None, "unresolved")])
def test_verdict_view(spark, status, exact, sig, code):
    assert one(spark, E.verdict_view(F.lit(status).cast("string"), F.lit(exact).cast("boolean"), F.lit(sig).cast("boolean"))).code == code


def test_exact_only_never_names_a_transformed_source(spark):
    suspects = spark.createDataFrame([("s1", "o", "h1"), ("s2", "o", "h9")], "suspect_id string, organization_id string, input_sha256 string")
    registry = spark.createDataFrame([("i1", "o", "h1")], "issuance_id string, organization_id string, output_sha256 string")
    retained = spark.createDataFrame([("i1", "o", True, None)], "issuance_id string, organization_id string, evidence_valid boolean, manifest_valid boolean")
    decodes = spark.createDataFrame([("s2", "decoded", "i1")], "suspect_id string, status string, issuance_id string")
    strict = {r.suspect_id: r.verdict for r in T.resolve_verdict(suspects, registry, retained, decodes, exact_only=True).collect()}
    loose = {r.suspect_id: r.verdict for r in T.resolve_verdict(suspects, registry, retained, decodes).collect()}
    assert strict == {"s1": C.INVALID_MANIFEST, "s2": C.NO_WATERMARK}
    assert loose == {"s1": C.VERIFIED_INTACT, "s2": C.SOURCE_IDENTIFIED_MODIFIED}


@pytest.mark.parametrize("name,safe", [
    ("a/b\\c.pdf", "c.pdf"), ("..hidden.pdf", "hidden.pdf"), ("bad<>name.pdf", "badname.pdf"), ("noext", ""), ("x.", ""), (" .pdf", ""),
    ("n" * 200 + ".pdf", "n" * 120 + ".pdf"), ("tab\there.png", "tabhere.png"), ("", ""), (None, "")])
def test_safe_filename(spark, name, safe):
    assert one(spark, X.safe_filename(F.lit(name).cast("string"))) == safe


def test_document_slug(spark):
    assert one(spark, X.document_slug(F.lit("Hợp Đồng số 12/Ấn bản"))) == "hop-dong-so-12-an-ban"


@pytest.mark.parametrize("value,kept", [("https://h/p", 0), ("//h/p", 0), ("plain //h", 1), ("mailto:x", 1), ("http:///p", 1)])
def test_redaction_of_links(spark, value, kept):
    assert one(spark, F.size(E.redact_map(F.create_map(F.lit("status"), F.lit(value), F.lit("Status"), F.lit("x"))))) == kept


def test_transform_identity_and_infinity(spark):
    r = G.rect(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(0.4))
    same = one(spark, G.transform_regions(F.array(r), F.array(*[F.lit(v) for v in G.IDENTITY])))
    assert same.error is None and tuple(same.regions[0]) == (0.1, 0.2, 0.3, 0.4)
    lost = one(spark, G.transform_regions(F.array(r), F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)])))
    assert lost.error == "corner_at_infinity" and lost.regions is None


def test_crop_rounds_half_to_even(spark):
    g = one(spark, G.crop_geometry(F.lit(0.75), F.lit(5).cast("long"), F.lit(7).cast("long")))
    assert (g.kept_width, g.kept_height, g.x0, g.y0) == (4, 2, 1, 1)


def test_psnr_of_equal_arrays_is_infinite(spark):
    frame = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([0.0, 0.0], [255.0, 255.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r.psnr_db for r in S.psnr(frame).collect()] == [float("inf"), 0.0, None]


def test_erasure_ladder(spark):
    rank = F.array(*[F.lit(v) for v in range(20)])
    ladder = one(spark, G.erasure_ladder(F.array(F.lit(0)), rank))
    assert ladder == [[0], list(range(16)), list(range(8)), [0, 1, 2, 3], [0, 1], []]


def test_active_signing_key_windows(spark):
    keys = spark.createDataFrame([
        ("a", "o", "active", 0, 10), ("b", "o", "active", 10, 20), ("c", "o", "active", 15, None), ("d", "o", "revoked", 0, 99),
        ("e", "p", "active", 5, 5), ("f", "p", "active", 7, 9)], "key_id string, organization_id string, status string, f long, u long").selectExpr(
        "key_id", "organization_id", "status", "'Ed25519' AS algorithm", "timestamp_seconds(f) AS valid_from", "timestamp_seconds(u) AS valid_until")
    asked = [("o", n) for n in (0, 9, 10, 14, 15, 19, 20, 99)] + [("p", n) for n in (4, 5, 7, 8, 9)] + [("q", 1)]
    requests = spark.createDataFrame(asked, "organization_id string, s long").selectExpr("organization_id", "s", "timestamp_seconds(s) AS at")
    found = {(r.organization_id, r.s): r.signing_key_id for r in T.active_signing_key(requests, keys).collect()}
    assert found == {("o", 0): "a", ("o", 9): "a", ("o", 10): "b", ("o", 14): "b", ("o", 15): None, ("o", 19): None, ("o", 20): "c", ("o", 99): "c",
                     ("p", 4): None, ("p", 5): None, ("p", 7): "f", ("p", 8): "f", ("p", 9): None, ("q", 1): None}
