"""Candidate grids of a caller's contract file, against identities packed by the standard library."""

import hashlib
import json
import struct
from itertools import product

from copytrail.functions.ids import double_hex
from copytrail.plans import benchmark as B
from copytrail.plans import contracts as K
from pyspark.sql import functions as F

CONTRACT = {"schema_version": 2, "fixed": {"tiles_per_page": 18, "bit_replication": 3, "payload_codeword_bytes": 39, "other": "kept in the digest only"},
            "coupled_levels": [{"qim_delta": 24.0, "pilot_strength_rms": 1.5}, {"qim_delta": 0.1, "pilot_strength_rms": 3}],
            "sweep": {"tile_size_px": [384, 256], "payload_repetitions": [3, 5]}}


def write(tmp_path, contract):
    path = tmp_path / "grid.json"
    path.write_text(json.dumps(contract, indent=2))
    return path


def test_identities_equal_packed_bytes(spark, tmp_path):
    path = write(tmp_path, CONTRACT)
    digest = hashlib.sha256(path.read_bytes()).digest()
    want = [(K.GRID_TAG + digest + struct.pack(">IddIIII", 2, level["qim_delta"], level["pilot_strength_rms"], tile, 18, times, 3)).hex()
            for level, tile, times in product(CONTRACT["coupled_levels"], (384, 256), (3, 5))]
    rows = sorted(B.read_candidate_grid(spark, str(path)).collect(), key=lambda r: r.ordinal)
    assert [r.candidate_id for r in rows] == want and [r.ordinal for r in rows] == list(range(8))
    # 2 bits per 16 x 16 pixels: 256 pixels hold 512 bits, the codeword needs 936.
    assert all(r.errors == (["capacity"] if r.tile_size_px == 256 else []) for r in rows)


def test_broken_contracts_are_named(spark, tmp_path):
    path = write(tmp_path, {**CONTRACT, "coupled_levels": [CONTRACT["coupled_levels"][0]] * 2 + [{"qim_delta": 1.0}], "sweep": {"tile_size_px": [384], "payload_repetitions": [3]}})
    rows = sorted(B.read_candidate_grid(spark, str(path)).collect(), key=lambda r: r.ordinal)
    assert [r.errors for r in rows] == [["duplicate"], ["duplicate"], ["identity"]]
    (tmp_path / "grid.json").write_text("[]")
    assert B.read_candidate_grid(spark, str(path)).collect() == []


def test_double_hex_is_the_memory_of_a_double(spark):
    values = [0.0, 1.0, 2.0, 0.1, -0.1, 1.5, 3.0, 24.0, 1e300, 1e-300, 2.0 ** 52, 2.0 ** 52 - 0.5, 0.9999999999999999, 1.0000000000000002, 8.0, 1 / 3, 7.999999999999999, 2.0 ** -1022, 1.7976931348623157e308]
    frame = spark.createDataFrame([(v,) for v in values + [float("inf"), float("nan"), None]], "v double")
    got = [r.h for r in frame.select(double_hex(F.col("v")).alias("h")).collect()]
    assert got == [struct.pack(">d", v).hex() for v in values] + [None, None, None]
