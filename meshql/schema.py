"""Logical tables. All are keyed by (subject, hemi), the unit by which meshes are independent."""

KEY = ["subject", "hemi"]

SCHEMAS = {
    "vertices": "subject string, hemi string, surface string, vid long, x double, y double, z double",
    "faces": "subject string, hemi string, fid long, a long, b long, c long",
    "morph": "subject string, hemi string, vid long, value double",
    "cuts": "subject string, hemi string, name string, vid long, ord int",
    "patch": "subject string, hemi string, pid long, vid long, x double, y double, z double, is_border boolean",
    "edges": "subject string, hemi string, u long, v long, n_faces long, len double",
    "adj": "subject string, hemi string, src long, dst long, w double",
    "kring": "subject string, hemi string, src long, dst long, hop int, slot int, dist double",
    "uv": "subject string, hemi string, vid long, u double, v double",
    "snapshots": "subject string, hemi string, step int, phase string, iteration int, j_d double, j_a double, n_flipped int, uv array<struct<u:double,v:double>>, elapsed_s double",
    "run_metrics": "subject string, hemi string, flipped_initial int, flipped_final int, pct_error double, elapsed_s double",
}
