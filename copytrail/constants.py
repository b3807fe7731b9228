"""Fixed values shared by the operators."""

# Verdicts of a verification (fixed values).
VERIFIED_INTACT = "VERIFIED_INTACT"
SOURCE_IDENTIFIED_MODIFIED = "SOURCE_IDENTIFIED_MODIFIED"
PARTIAL_EVIDENCE = "PARTIAL_EVIDENCE"
NO_WATERMARK = "NO_WATERMARK"
INVALID_MANIFEST = "INVALID_MANIFEST"
PROCESSING_FAILED = "PROCESSING_FAILED"

# Job states, declared edges and terminal states (fixed values).
JOB_EDGES = {
    "created": ("queued", "cancelled", "failed"),
    "queued": ("processing", "cancelled", "failed", "dead_lettered"),
    "processing": ("succeeded", "failed", "retryable_failed", "cancelled"),
    "retryable_failed": ("queued", "failed", "dead_lettered", "cancelled"),
    "succeeded": (),
    "failed": (),
    "dead_lettered": (),
    "cancelled": (),
}
TERMINAL_STATES = ("succeeded", "failed", "dead_lettered", "cancelled")
MAX_ATTEMPT = 2

# Signing-key lifecycle edges (fixed values).
KEY_EDGES = {"active": ("verify_only", "revoked"), "verify_only": ("revoked",), "revoked": ()}

# Retention windows in hours and kinds kept for ever (fixed values).
RETENTION_HOURS = {"orphan_upload": 24, "issuance_input": 168, "issuance_output": 720, "verification_input": 24}
KEPT_KINDS = ("manifest_metadata", "audit_event")

# Runtime ceilings (fixed values).
MAX_BYTES = 100_000_000
MAX_PAGES = 50
MAX_IMAGE_PIXELS = 40_000_000
MAX_DOCUMENT_PIXELS = 140_000_000
JOB_TIMEOUT_SECONDS = 600
STALE_MINUTES = 15

# Request-rate limits as (requests, seconds) (fixed values).
RATES = {"account": (60, 60), "source_ip": (120, 60), "issuance_job": (10, 3600), "verification_job": (10, 3600)}

# Release gates: attack, smallest decode rate (fixed values).
RATE_GATES = {"jpeg70": ("jpeg-q70", 0.95), "resize075": ("resize-s0p75", 0.95), "crop025": ("crop-f0p25", 0.90)}
MIN_PSNR_DB = 38.0
MIN_SSIM = 0.95
POSITIVE_PAGES = 12

# Voting and integrity thresholds (fixed values).
VOTE_SUPPORT = 0.60
VOTE_QUORUM = 2
REPLICA_QUORUM = 2
BIT_CONFIDENCE = 0.2
COMPRESSION_MISMATCH = 0.10
GEOMETRY_MISMATCH = 0.25
HIGH_CONFIDENCE = 0.85
MIN_REGIONS = 4

SHA256_PATTERN = "^[0-9a-f]{64}$"
UUID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
