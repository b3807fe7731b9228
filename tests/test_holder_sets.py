"""Attribution by the sets of copies that hold a suspect's lines."""

import random

from pyspark.sql import functions as F

from copytrail.operators import tracing as T


def chunks(spark, key, texts):
    frame = spark.createDataFrame([(k, "org", t) for k, t in texts.items()], f"{key} string, organization_id string, text string")
    return T.text_chunks(frame, key, "organization_id") if key == "suspect_id" else T.text_chunks(frame, "organization_id", key)


def traced(spark, suspects, copies):
    return {r.suspect_id: r for r in T.trace_modified_copy(chunks(spark, "suspect_id", suspects), chunks(spark, "issuance_id", copies)).collect()}


COPIES = {"a": "licence\nab\nac", "b": "licence\nab\nbc", "c": "licence\nac\nbc", "d": "licence\nown line", "e": "licence"}


def test_shared_lines_that_meet_in_one_copy_name_it(spark):
    got = traced(spark, {"1": "ab\nac", "2": "licence\nab\nac\nother", "3": "licence\nab", "4": "licence\nlicence", "5": "ab\nac\nbc", "6": "ab\nac\nx\ny"}, COPIES)
    assert (got["1"].status, got["1"].issuance_id, got["1"].valid_votes, got["1"].identities) == ("decoded", "a", 2, 1)
    assert (got["2"].status, got["2"].issuance_id, got["2"].support) == ("decoded", "a", 0.75)
    assert (got["3"].status, got["3"].issuance_id, got["3"].identities) == ("partial_payload_evidence", None, 0)
    assert (got["4"].status, got["4"].shared_votes) == ("partial_payload_evidence", 2)
    assert (got["5"].status, got["5"].identities) == ("partial_payload_evidence", 0)  # no copy holds all three
    assert (got["6"].status, got["6"].valid_votes, got["6"].identities) == ("partial_payload_evidence", 2, 1)  # too little support


def test_a_line_of_one_copy_still_decides(spark):
    got = traced(spark, {"1": "own line\nab\nac", "2": "own line\nlicence"}, COPIES)
    assert (got["1"].status, got["1"].valid_votes, got["1"].issuance_id) == ("partial_payload_evidence", 1, None)
    assert got["2"].identities == 1 and got["2"].shared_votes == 1


def test_equal_sets_are_one_and_a_line_of_all_is_one_row(spark):
    copies = {f"c{k}": "everywhere\nalso everywhere\n" + "\n".join(f"pair {min(k, (k + 1) % 40)} {max(k, (k + 1) % 40)}" for k in ([k, (k - 1) % 40])) for k in range(40)}
    holders = T.line_holders(chunks(spark, "issuance_id", copies))
    assert holders.count() == len({line for t in copies.values() for line in t.split("\n")})
    common = holders.filter("holders = 40")
    assert common.count() == 2 and common.select("holder_set").distinct().count() == 1


def test_random_copies_against_brute_force(spark):
    rng = random.Random(4)
    pool = [f"line {k}" for k in range(30)]
    copies = {f"c{k}": "\n".join(rng.sample(pool, rng.randint(5, 20)) + ["licence"]) for k in range(25)}
    suspects = {f"s{k}": "\n".join(rng.choice(list(copies.values())).split("\n")[:rng.randint(1, 20)] + ["new"] * rng.randint(0, 2)) for k in range(60)}
    owners = {}
    for name, text in copies.items():
        for line in text.split("\n"):
            owners.setdefault(line, set()).add(name)
    got = traced(spark, suspects, copies)
    resolved = 0
    for name, text in suspects.items():
        held = [line for line in text.split("\n") if line in owners]
        single = {next(iter(owners[x])) for x in held if len(owners[x]) == 1}
        common = set.intersection(*(owners[x] for x in held)) if held else set()
        row = got[name]
        if not single and len({x for x in held}) and len(common) == 1:
            resolved += 1
            assert (row.identities, row.valid_votes) == (1, len(held))
            assert row.issuance_id == (next(iter(common)) if len(held) >= 2 and len(held) / row.chunks >= 0.6 else None)
        else:
            assert row.identities == len(single)
    assert resolved > 10


def test_no_suspects_and_no_copies(spark):
    none = chunks(spark, "issuance_id", COPIES).limit(0)
    assert T.trace_modified_copy(chunks(spark, "suspect_id", {"1": "ab"}), none).first().status == "payload_not_detected"
    assert T.trace_modified_copy(chunks(spark, "suspect_id", {"1": "ab"}).filter(F.lit(False)), chunks(spark, "issuance_id", COPIES)).collect() == []
