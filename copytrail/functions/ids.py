"""Deterministic identifiers and the 23-byte payload frame, all from built-in hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# The domain texts keep ids of different purposes apart. A caller that must reproduce ids issued elsewhere
# passes the texts those were issued with.
CASE_DOMAIN = b"copytrail-case-v1\x00"
IDENTITY_DOMAIN = b"copytrail-identity-v1\x00"


def _bytes(value: bytes) -> Column:
    return F.unhex(F.lit(value.hex()))


def _be(value: Column, width: int) -> Column:
    """Big-endian bytes of a non-negative integer."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), width * 2, "0"))


def row_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\x00", *[p.cast("string") for p in parts]), 256)


def _binding(seed: int, fixture_id: Column, page_index: Column, profile_sha256: Column) -> list[Column]:
    if not 0 <= seed < 2**64:
        raise ValueError("seed must fit an unsigned 64-bit integer")
    return [_bytes(seed.to_bytes(8, "big")), fixture_id.cast("binary"), _bytes(b"\x00"), _be(page_index, 4), F.unhex(profile_sha256)]


def case_seed(seed: int, fixture_id: Column, page_index: Column, profile_sha256: Column, attack_id: Column,
              domain: bytes = CASE_DOMAIN) -> Column:
    """Unsigned 64-bit seed of one case, as a decimal because it does not fit a signed long."""
    material = F.concat(_bytes(domain), *_binding(seed, fixture_id, page_index, profile_sha256), attack_id.cast("binary"))
    return F.conv(F.substring(F.sha2(material, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def _as_uuid(digest: Column, version: int) -> Column:
    """Canonical id text from the first 16 hash bytes, with version and variant bits set."""
    variant = F.substring(F.lit("89ab" * 4), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit(f"-{version}"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def expected_issuance_id(seed: int, fixture_id: Column, page_index: Column, profile_sha256: Column,
                         domain: bytes = IDENTITY_DOMAIN) -> Column:
    """Version-4 style id bound to a page and profile."""
    return _as_uuid(F.sha2(F.concat(_bytes(domain), *_binding(seed, fixture_id, page_index, profile_sha256)), 256), 4)


def name_id(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Version-5 id of a name."""
    return _as_uuid(F.sha1(F.concat(_bytes(namespace.bytes), name.cast("binary"))), 5)


def receipt_id(job_id: Column, attempt: Column, prefix: str = "copytrail-result") -> Column:
    """Id of a job attempt's receipt: the same attempt always gets the same key."""
    return name_id(F.concat_ws(":", F.lit(prefix), job_id.cast("string"), attempt.cast("string")))


# Frame layout: magic, version byte, 16 id bytes, CRC-32, all big-endian (fixed values).
MAGIC = b"SB"
VERSION = 1


def payload_frame(issuance_id: Column) -> Column:
    body = F.unhex(F.concat(F.lit(MAGIC.hex()), F.lit(f"{VERSION:02x}"), F.replace(issuance_id, F.lit("-"), F.lit(""))))
    return F.concat(body, _be(F.crc32(body), 4))


def payload_check(frame: Column) -> Column:
    """(reason, issuance id) of a frame; the first failing check is the reason, null reason means valid."""
    reason = (
        F.when(frame.isNull() | (F.length(frame) != 23), "length")
        .when(F.hex(F.substring(frame, 1, 2)) != MAGIC.hex().upper(), "magic")
        .when(F.hex(F.substring(frame, 3, 1)) != f"{VERSION:02X}", "version")
        .when(F.lpad(F.hex(F.crc32(F.substring(frame, 1, 19))), 8, "0") != F.hex(F.substring(frame, 20, 4)), "crc")
    )
    raw = F.lower(F.hex(F.substring(frame, 4, 16)))
    text = F.concat_ws("-", *[F.substring(raw, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.struct(reason.alias("reason"), F.when(reason.isNull(), text).alias("issuance_id"))


def double_hex(value: Column) -> Column:
    """The 16 hex digits of a finite double as it lies in memory, sign first; null for one that is not finite or subnormal."""
    size = F.when(~F.isnan(value) & (F.abs(value) >= 2.0 ** -1022) & (F.abs(value) < float("inf")), F.abs(value))
    guess = F.floor(F.log2(size)).cast("int")
    # The logarithm may be off by one next to a power of two; scaling by powers of two is exact.
    power = guess + F.when(size / F.pow(F.lit(2.0), guess) >= 2, 1).when(size / F.pow(F.lit(2.0), guess) < 1, -1).otherwise(0)
    fraction = ((size / F.pow(F.lit(2.0), power) - 1) * F.lit(2.0 ** 52)).cast("long")
    bits = F.shiftleft((power + 1023).cast("long"), 52).bitwiseOR(fraction)
    digits = F.lower(F.lpad(F.hex(F.when(value < 0, bits.bitwiseOR(F.lit(-2**63).cast("long"))).otherwise(bits)), 16, "0"))
    return F.when(value == 0, "0" * 16).otherwise(digits)
