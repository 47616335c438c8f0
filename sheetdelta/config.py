"""Thresholds, lookup domains and patterns shared by the operators."""

from __future__ import annotations

# --- severity (fixed values) ---
UNCHANGED_PERCENT = 0.15
MINOR_PERCENT = 1.0
MODERATE_PERCENT = 5.0
SPARSE_FOREGROUND_RATIO = 0.0005
# (minor, moderate, major) lower bounds per signal
FOREGROUND_BOUNDS = (1.0, 8.0, 20.0)
REGION_BOUNDS_MM2 = (100.0, 2500.0, 10000.0)
ZONE_COUNT_BOUNDS = (1.0, 15.0, 40.0)
LEVELS = ("unchanged", "minor", "moderate", "major")
DISTRIBUTION_ORDER = (
    "MAJOR", "MODERATE", "MINOR", "SIZE_MISMATCH", "ADDED", "REMOVED", "UNCHANGED",
)
LEVEL_SORT_RANK = {
    "UNCHANGED": 0, "MINOR": 1, "MODERATE": 2, "MAJOR": 3,
    "SIZE_MISMATCH": 4, "REMOVED": 5, "ADDED": 6,
}

# --- strictness: name -> (tolerance multiplier, smallest zone area) (fixed values) ---
STRICTNESS = {"strict": (0.65, 80), "normal": (1.0, 180), "loose": (1.6, 360)}

# --- sheet matching (fixed values) ---
MIN_AREA_RATIO = 0.96
MAX_ASPECT_DELTA = 0.015
MIN_SHARED_TOKENS = 20
MIN_CROSS_TEXT = 0.85
MIN_CROSS_VISUAL = 0.90
VISUAL_WEIGHT, TEXT_WEIGHT = 0.72, 0.28
MARK_SAME_BONUS, MARK_DIGITS_BONUS, MARK_CONFLICT_PENALTY = 0.20, 0.08, 0.22
MARK_DIGITS_SIMILARITY = 0.65
SAME_ID_FLOOR = 0.95
GLOBAL_GAIN = 0.20          # weight of a global match is similarity + this
GLOBAL_THRESHOLD = 0.55
ORDERED_LOSS = 0.14         # weight of an ordered match is similarity - this
ORDERED_THRESHOLD = 0.58
QUALITY_GAP_WEIGHT = 0.38
QUALITY_CROSSING_WEIGHT = 0.10
CHOOSE_MARGIN = 0.04

# --- rendering and settings (fixed values) ---
MIN_DPI, MAX_DPI = 72, 1200
MAX_MEGAPIXELS = 40.0
DEFAULT_DPI = 250
DEFAULT_TOLERANCE_PX = 2.0
DEFAULT_STRICTNESS = "normal"
DEFAULT_MERGE_GAP_MM = 0.0
DEFAULT_MERGE_RATIO = 16.0
UI_MERGE_GAP = 5.0

# --- zones (fixed values) ---
MAX_PAGE_AREA_RATIO = 0.25
MIN_FILL_RATIO = 0.01
MAX_CANVAS_PAD_PX = 3
LINE_CENTER_TOLERANCE_MM = 0.35
LINE_MAX_HALF_WIDTH_MM = 1.5
MAX_SHIFT_RATIO = 0.10
# a shift counts when at most this part of the unmatched cells stays unmatched
CLEAR_RESIDUAL_RATIO = 0.9

MM_PER_INCH = 25.4
POINTS_PER_INCH = 72.0
TITLE_BLOCK_MM = (220.0, 90.0)

# --- paper formats, portrait millimetres (fixed values) ---
PAPER_FORMATS = (
    ("A4", 210.0, 297.0),
    ("A3", 297.0, 420.0),
    ("A2", 420.0, 594.0),
    ("A1", 594.0, 841.0),
    ("A0", 841.0, 1189.0),
)
FORMAT_TOLERANCE_MM = 8.0

# --- patterns (fixed values) ---
TOKEN_PATTERN = r"[A-Za-zА-Яа-я0-9]{3,}"
NAME_TOKEN_PATTERN = r"[A-Za-zА-Яа-я0-9]+"
SHEET_RU_PATTERN = r"(?:\bЛИСТ(?:\s*№)?|\bЛ\.)\s*[:№#-]?\s*([A-ZА-Я]{0,3}\d{1,4}[A-ZА-Я]{0,3})"
SHEET_EN_PATTERN = r"\bSHEET\s*[:#-]?\s*([A-Z]{0,3}\d{1,4}[A-Z]{0,3})\b"
SHEET_FRACTION_PATTERN = r"\b(\d{1,3})\s*/\s*(\d{1,3})\b"
DRAWING_ID_PATTERN = r"[A-Z0-9]+(?:-[A-Z0-9]+){4,}-DWG-\d{4,}"
REVISION_WORD_PATTERN = (
    r"(?:^|[^A-Za-zА-Яа-я0-9])"
    r"((?:rev(?:ision)?|r|рев|ревизия|р)[-_ ]*[A-Za-zА-Яа-я]*\d+[A-Za-zА-Яа-я]*)\b"
)
REVISION_TAIL_PATTERN = r"([A-Za-zА-Яа-я]{1,3}\d{1,4}[A-Za-zА-Яа-я]{0,2})$"
LABEL_REVISION_PATTERN = r"(?:^|[-_])(r?[A-Za-zА-Яа-я]\d+)$"

# --- region units and anchors (fixed values) ---
PERCENT_UNITS = ("percent", "%")
RATIO_UNITS = ("ratio", "relative")
PIXEL_UNITS = ("px", "pixel", "pixels")
MM_UNITS = ("mm", "millimeter", "millimeters")
ANCHORS = {
    "top_left": ("top_left", "left_top", "tl"),
    "top_right": ("top_right", "right_top", "tr"),
    "bottom_left": ("bottom_left", "left_bottom", "bl"),
    "bottom_right": ("bottom_right", "right_bottom", "br"),
}
REGION_OVERFLOW_EPS = 0.01

# --- history (fixed values) ---
TRUE_WORDS = ("on", "1", "true", "yes", "да")
RESULT_ALIASES = {
    "ok": "done", "done": "done", "completed": "done",
    "cancelled": "cancelled", "canceled": "cancelled",
    "error": "failed", "failed": "failed",
    "snapshot": "snapshot",
}
HISTORY_CAP = 300
RETAINED_JOBS = 50
RETENTION_DAYS = 30
QUEUED_GRACE_SEC = 60
SIMILAR_RUN_CUT = 0.72
ACTIVE_JOB_STATES = ("queued", "running", "cancelling")

# --- review of zones (fixed values) ---
ZONE_CLASSES = ("real_change", "alignment_or_rendering_noise", "uncertain")
NOISE_WORDS = ("шум", "сдвиг", "антиалиас", "идентич", "без измен", "не является")
UNCERTAIN_WORDS = ("неопредел", "неяс", "нельзя определить", "возможно", "предполож")
CONFIDENCE_PATTERN = r"(?:уверенность|confidence)\s*:\s*(\d{1,3})"
CONFIDENCE_HIGH, CONFIDENCE_LOW, CONFIDENCE_PLAIN = 90, 55, 75
CONFIDENCE_FALLBACK_CAP = 60
SKIP_REASONS = (
    "excluded", "added", "removed", "one_sided", "not_matched", "unchanged", "no_diff",
)
MAX_LABEL_COLON = 115
HIGHLIGHTS_SHOWN = 4
LABELS_SHOWN = 3

# --- token prices, USD per million tokens (fixed values) ---
# period -> (cached input, uncached input, output)
TOKEN_RATES = {"off_peak": (0.007, 0.22, 0.66), "peak": (0.014, 0.44, 1.32)}
CREDIT_FEE_RATE = 0.055
WEEKEND_RULE_START_UTC = "2026-08-22 16:00:00"
WEEKEND_OFFSET_HOURS = 8
PEAK_HOURS_UTC = ((1, 4), (6, 10))

# --- page map file columns (fixed values) ---
PAGE_MAP_COLUMNS = (
    "seq", "a_page", "b_page", "status", "score", "diff_percent", "change_level",
    "bboxes_count", "excluded_regions_count", "diff_strictness", "high_dpi",
    "stroke_tol_px", "bbox_merge_gap_mm", "bbox_merge_max_area_ratio",
    "ignore_line_weight", "ecc_failed", "width_px", "height_px", "pixel_count",
    "diff_area_px", "diff_area_mm2", "diff_foreground_percent", "foreground_px",
    "added_px", "removed_px", "added_area_mm2", "removed_area_mm2",
    "max_region_area_mm2", "foreground_sparse", "elapsed_sec",
)
