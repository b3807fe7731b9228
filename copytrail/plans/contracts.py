"""The benchmark contracts: attack families and candidate sweeps. All values here are fixed values."""

ATTACK_MATRIX = {
    "schema_version": 1,
    "jpeg_quality": [95, 85, 70, 50],
    "crop_fraction": [0.1, 0.25, 0.5],
    "resize_scale": [0.5, 0.75, 1.5],
    "rotation_degrees": [-5, -3, -1, 1, 3, 5],
    "brightness_contrast": [
        {"brightness_factor": 0.85, "contrast_factor": 0.9},
        {"brightness_factor": 1.15, "contrast_factor": 1.0},
        {"brightness_factor": 1.0, "contrast_factor": 1.2},
    ],
    "gaussian_noise_blur": [
        {"noise_sigma": 3.0, "blur_sigma": 0.0},
        {"noise_sigma": 8.0, "blur_sigma": 0.8},
        {"noise_sigma": 15.0, "blur_sigma": 1.2},
    ],
    "screenshot": [
        {"kind": "raster", "width_px": 1920, "height_px": 1080},
        {"kind": "raster", "width_px": 1366, "height_px": 768},
        {"kind": "perspective", "width_px": 1920, "height_px": 1080,
         "corner_offsets": [[0.03, 0.02], [-0.02, 0.04], [-0.03, -0.02], [0.02, -0.03]]},
    ],
    "combined": [
        {"operations": ["jpeg", "crop"], "jpeg_quality": 70, "crop_fraction": 0.25},
        {"operations": ["screenshot", "perspective"], "width_px": 1920, "height_px": 1080,
         "corner_offsets": [[0.03, 0.02], [-0.02, 0.04], [-0.03, -0.02], [0.02, -0.03]]},
    ],
    "tamper": [
        {"kind": "replace_text", "region": {"x": 0.15, "y": 0.15, "width": 0.35, "height": 0.1}},
        {"kind": "cover_region", "region": {"x": 0.55, "y": 0.2, "width": 0.25, "height": 0.2}},
        {"kind": "copy_move", "region": {"x": 0.2, "y": 0.55, "width": 0.2, "height": 0.2}},
        {"kind": "insert_object", "region": {"x": 0.6, "y": 0.6, "width": 0.25, "height": 0.2}},
    ],
}

# Parts of the grids that do not vary; they enter each candidate's digest.
FIXED_V1 = {
    "wavelet": "haar", "wavelet_level": 1, "detail_band": "HL", "transform_dtype": "float64", "dct_block_size": 8,
    "dct_transform": "orthonormal-dct-ii", "midband_pairs": [[[1, 2], [2, 1]], [[2, 3], [3, 2]]],
    "luminance": {"channel_order": "BGR", "standard": "BT.601-full-range", "coefficients": [0.114, 0.587, 0.299]},
    "padding": {"mode": "edge", "edges": ["bottom", "right"], "inverse_crop": "original-shape"},
    "qim_rounding": "ties-to-even",
    "raster": {"input_dtypes": ["uint8", "uint16"], "rounding": "nearest-bt601-floor-ceil-combination",
               "clipping": "original-unsigned-depth"},
    "ecc_parity_symbols": 16, "interleave_depth": 8, "sync_detector": "orb-ransac",
}
FIXED_V2 = {"tiles_per_page": 18, "bit_replication": 3, "bit_confidence_min": 0.60, "pilot_score_min": 0.20}
FIXED_V3 = {
    "qim_delta": 32.0, "pilot_strength_rms": 2.0, "spread_delta": 4.0, "spread_chips_per_bit": 64,
    "saturated_fraction_min": 0.75, "saturation_low": 16, "saturation_high": 239, "tiles_per_page": 18,
    "bit_replication": 3, "bit_confidence_min": 0.6, "pilot_score_min": 0.2, "max_geometry_hypotheses": 8,
    "geometry_ratio_tolerance": 0.001, "crop_retained_scales": [0.8660254037844386], "resize_interpolation": "INTER_CUBIC",
}

# Swept values per grid version; the coupled levels of version 2 vary together.
SWEEPS = {
    1: {"qim_delta": [6.0, 8.0, 10.0, 12.0], "tile_size_px": [256, 384], "tiles_per_page": [12, 18, 24], "payload_repetitions": [3, 5]},
    2: {"level": [{"qim_delta": 24.0, "pilot_strength_rms": 1.5}, {"qim_delta": 32.0, "pilot_strength_rms": 2.0},
                  {"qim_delta": 48.0, "pilot_strength_rms": 3.0}, {"qim_delta": 64.0, "pilot_strength_rms": 4.0}],
        "tile_size_px": [384, 512], "payload_repetitions": [3, 5]},
    3: {"tile_size_px": [384, 512], "payload_repetitions": [3, 5]},
}
FIXED = {1: FIXED_V1, 2: FIXED_V2, 3: FIXED_V3}

PREGATE_ATTACKS = ("identity", "jpeg-q70", "resize-s0p75", "crop-f0p25")
SMOKE_ATTACKS = (
    "jpeg-q70", "crop-f0p25", "resize-s0p75", "rotation-d3", "brightness-contrast-0", "noise-blur-1",
    "screenshot-2-perspective", "combined-0", "tamper-0-replace_text",
)
SOURCE_KINDS = ("clean_pdf", "clean_image", "negative_external", "tamper_ground_truth")
SMOKE_SOURCE = "image-clean-noise"

# First bytes of a version-1 candidate identity (fixed value).
CANDIDATE_TAG = b"SBFP\x01"
# The same for identities that hold their contract file's digest (fixed value).
GRID_TAG = b"SBF2\x01"
