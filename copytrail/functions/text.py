"""File names, storage keys and upload rules as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from copytrail import constants as C

CONTENT_TYPES = ("application/pdf", "image/png", "image/jpeg")
UPLOAD_KINDS = {"issuance_input": "issuer", "verification_input": "verifier"}
_UUID = C.UUID_PATTERN.strip("^$")

# The three storage-key shapes (fixed values).
ORPHAN_KEY = rf"^uploads/orphan/(issuance_input|verification_input)/({_UUID})/([0-9a-f]{{32}})\.(bin)$"
PROMOTED_KEY = rf"^inputs/(issuance|verification)/({_UUID})/({_UUID})\.(bin)$"
OUTPUT_KEY = rf"^outputs/(issuance)/({_UUID})/({_UUID})\.(pdf|png)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def codes(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that hold, in order; a rule that is null does not hold."""
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules]), lambda c: c.isNotNull())


def longer(value: Column, most: int) -> Column:
    """Whether a text has more than ``most`` characters; of one with over four bytes for each, none is counted."""
    return F.when(F.octet_length(value) > 4 * most, True).otherwise(F.length(value) > most)


def matches(value: Column, pattern: str) -> Column:
    """Null-safe full match."""
    return F.coalesce(value.rlike(pattern), F.lit(False))


def upload_intent_code(role: Column, kind: Column, content_type: Column, size: Column, sha256: Column) -> Column:
    """First failing rule of an upload request, null when it may proceed."""
    allowed = role == "administrator"
    for name, wanted in UPLOAD_KINDS.items():
        allowed = allowed | ((role == wanted) & (kind == name))
    return (
        F.when(~F.coalesce(allowed, F.lit(False)), "UPLOAD_FORBIDDEN")
        .when(~F.coalesce(kind.isin(*UPLOAD_KINDS), F.lit(False)), "UPLOAD_KIND")
        .when(~F.coalesce(content_type.isin(*CONTENT_TYPES), F.lit(False)), "UPLOAD_CONTENT_TYPE")
        .when(~F.coalesce(size.between(1, C.MAX_BYTES), F.lit(False)), "UPLOAD_SIZE")
        .when(~matches(sha256, C.SHA256_PATTERN), "UPLOAD_SHA256")
    )


def _strip(value: Column) -> Column:
    return F.trim(value, F.lit(" \t\n\x0b\f\r"))


def _stem(name: Column) -> Column:
    """Everything before the last dot; the names may be whole texts, so no pattern that could backtrack over them."""
    return F.substring(name, F.lit(1), F.greatest(F.lit(0), F.length(name) - F.length(F.substring_index(name, ".", -1)) - 1))


def safe_filename(name: Column) -> Column:
    """Display name of an uploaded file: no path, control or reserved characters; empty when nothing safe is left."""
    def shorten(clean: Column) -> Column:
        return F.when(F.length(clean) <= 120, clean).when(
            clean.contains("."), F.concat(F.substring(_stem(clean), 1, 120), F.lit("."), F.substring_index(clean, ".", -1))).otherwise(F.substring(clean, 1, 120))

    last = _strip(F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1))
    clean = F.regexp_replace(_strip(F.regexp_replace(last, r'[\x00-\x1f\x7f"\\/:*?<>|]', "")), r"^(\.\s*)+", "")
    return let(let(clean, shorten), lambda c: F.when(is_download_name(c), c).otherwise(F.lit("")))


def is_download_name(name: Column) -> Column:
    """Whether a name is short, unpadded, not dot-led, and ends in a short alphanumeric extension."""
    return F.coalesce(
        F.length(name).between(1, 180) & ~name.rlike(r'[\x00-\x1f\x7f"\\/:*?<>|]') & ~name.rlike(r"^\.|^\s|\s$")
        & name.rlike(r"(?s)^.+\.[A-Za-z0-9]{1,8}$"), F.lit(False))


@lru_cache
def accent_map() -> tuple[str, str]:
    """Letters whose canonical decomposition is one ASCII letter plus marks, with that letter; built by rule."""
    source, target = ["đ", "Đ"], ["d", "D"]
    for point in range(0x80, 0x3000):
        char = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base.isascii() and base.isalnum():
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def document_slug(name: Column) -> Column:
    """Lower-case ASCII words joined by hyphens, at most 80 characters."""
    source, target = accent_map()
    folded = F.lower(F.regexp_replace(F.translate(name, source, target), r"[^\x00-\x7F]", ""))
    slug = F.regexp_replace(F.regexp_replace(folded, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.regexp_replace(F.substring(slug, 1, 80), r"^-+|-+$", "")


def download_name(issuance_id: Column, source_filename: Column, object_key: Column, prefix: str = "copy") -> Column:
    """File name offered for an issued copy: slug of the original, short reference, and pdf or png."""
    suffix = F.lower(F.regexp_extract(F.coalesce(object_key, F.lit("")), r"\.([^.]*)$", 1))
    extension = F.when(suffix.isin("pdf", "png"), suffix).otherwise("pdf")
    reference = F.concat(F.lit(f"{prefix}-"), F.substring(issuance_id, 1, 8))
    original = _strip(F.coalesce(source_filename, F.lit("")))
    stem = F.when(original.contains("."), _stem(original)).otherwise(original)
    slug = document_slug(stem)
    plain = F.concat(reference, F.lit("."), extension)
    # A slug holds at most 80 letters, digits and hyphens, so putting it in front keeps a valid name valid.
    return let(slug, lambda s: F.when((s != "") & is_download_name(plain), F.concat(s, F.lit("-"), plain)).otherwise(plain))


def parse_storage_key(key: Column) -> Column:
    """Shape, kind, tenant, object id and extension of a controlled key; null for anything else."""
    def parts(shape: str, pattern: str) -> Column:
        at = [F.regexp_extract(key, pattern, n) for n in range(1, 5)]
        return F.when(matches(key, pattern), F.struct(
            F.lit(shape).alias("shape"), F.regexp_replace(at[0], "_input$", "").alias("kind"), at[1].alias("organization_id"),
            at[2].alias("object_id"), at[3].alias("extension")))

    return F.coalesce(parts("orphan", ORPHAN_KEY), parts("promoted", PROMOTED_KEY), parts("output", OUTPUT_KEY))


def key_is_owned(key: Column, category: Column, organization_id: Column, object_id: Column, purpose: Column) -> Column:
    """Whether a key belongs to the row that asks to delete it, for the cleanup category."""
    def test(p: Column) -> Column:
        own = (p["organization_id"] == organization_id)
        same_kind = p["kind"] == purpose
        return (
            F.when(category == "orphan", (p["shape"] == "orphan") & own & same_kind & (p["object_id"] == F.replace(object_id, F.lit("-"), F.lit(""))))
            .when(category.isin("stale_promotion", "issuance_input", "verification_input"),
                  (p["shape"] == "promoted") & own & same_kind & (p["object_id"] == object_id))
            .when(category == "issuance_output", (p["shape"] == "output") & own & (p["object_id"] == object_id))
        )

    return F.coalesce(let(parse_storage_key(key), test), F.lit(False))


def copy_boundary_ok(source: Column, destination: Column) -> Column:
    """Whether a copy goes from an upload to a promoted input of the same tenant and kind."""
    both = F.struct(parse_storage_key(source).alias("a"), parse_storage_key(destination).alias("b"))
    return F.coalesce(let(both, lambda p: (p["a"]["shape"] == "orphan") & (p["b"]["shape"] == "promoted") & (p["a"]["kind"] == p["b"]["kind"])
                          & (p["a"]["organization_id"] == p["b"]["organization_id"])), F.lit(False))


def sniff_kind(content: Column) -> Column:
    """Kind of stored bytes by their first bytes; the declared type is not asked."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpeg").otherwise("pdf")
