"""Schemas of the tables this library reads and writes."""

from __future__ import annotations

BOX = "array<struct<x:bigint,y:bigint,w:bigint,h:bigint>>"

SHEETS = (
    "doc_pair string, rev string, idx bigint, text string, tokens array<string>, thumb array<float>, "
    "width_pt double, height_pt double, sheet_mark string, drawing_id string"
)
WORDS = "doc_pair string, rev string, idx bigint, x0 double, y0 double, x1 double, y1 double, word string"
CELLS = "doc_pair string, seq bigint, rev string, x bigint, y bigint"
GRAY = "doc_pair string, seq bigint, rev string, x bigint, y bigint, v bigint"

DETAIL = (
    "seq bigint, a_page bigint, b_page bigint, pair_dir string, status string, score double, "
    "diff_percent double, change_level string, bboxes_count bigint, excluded_regions_count bigint, "
    "diff_strictness string, high_dpi bigint, effective_dpi double, stroke_tol_px double, "
    "bbox_merge_gap_mm double, bbox_merge_max_area_ratio double, ignore_line_weight boolean, "
    "ecc_failed boolean, alignment_method string, alignment_score double, alignment_improvement double, "
    "alignment_shift_x_px double, alignment_shift_y_px double, alignment_shift_x_mm double, "
    "alignment_shift_y_mm double, alignment_rotation_deg double, alignment_scale_x double, "
    "alignment_scale_y double, width_px bigint, height_px bigint, pixel_count bigint, diff_area_px bigint, "
    "diff_area_mm2 double, diff_foreground_percent double, foreground_px bigint, added_px bigint, "
    "removed_px bigint, added_area_mm2 double, removed_area_mm2 double, max_region_area_mm2 double, "
    "foreground_sparse boolean, elapsed_sec double, drawing_id string, mixed_settings boolean"
)

RUN_SUMMARY = (
    "created_at string, file_a string, file_b string, high_dpi bigint, stroke_tol_px double, "
    "diff_strictness string, bbox_merge_gap_mm double, bbox_merge_max_area_ratio double, "
    "ignore_line_weight boolean, exclude_regions string, pairs string"
)

HISTORY_RECORD = (
    "ts string, result string, job_id string, old_pdf string, new_pdf string, out_dir string, run_dir string, "
    "run_name string, dpi string, stroke_tol string, diff_strictness string, exclude_regions string, "
    "bbox_merge string, bbox_merge_gap string, bbox_merge_max_ratio string, bbox_merge_gap_mm string, "
    "bbox_merge_max_area_ratio string, keep_debug string, keep_debug_images string, ignore_line_weight string"
)

JOB_EVENT = (
    "job_id string, event_id bigint, at timestamp, state string, progress double, message string, operation string, "
    "run_dir string, old_pdf string, new_pdf string"
)
