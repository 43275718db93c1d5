"""Registry of the library's own queries and of the SQL that says the same."""

from . import catalog, overlay, reading, relations, sources, speech, structure, textual  # noqa: F401
from .registry import QUERIES, SQL

#: Counts that DuckDB gives in a wider type than Spark.
COUNTS = {
    "catalog_a4_author_stats": ("done", "reading"),
    "overlay_j15_snapshot_diff": ("n_changed",),
    "overlay_a12_changed_share": ("n_rev",),
    "overlay_a21_warning_ratio": ("n_blank",),
    "overlay_q3_checks": ("n_stray", "n_blank", "n_spaced_dots", "n_hyphens"),
    "overlay_q5_warnings": ("n_emphasis", "n_dialogue"),
    "overlay_r2_maps": ("n",),
    "window_w6_long_runs": ("n",),
    "window_w9_merged_pairs": ("n",),
    "window_w10_seen_before": ("n_front",),
    "structure_a16_heading_kinds": ("n_chapter", "n_numbered", "n_other"),
    "structure_p10_junk_lines": ("n",),
}
for _name, _columns in COUNTS.items():
    _casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _columns)
    SQL[_name] = f"SELECT * REPLACE ({_casts}) FROM ({SQL[_name]})"

__all__ = ["QUERIES", "SQL"]
