"""Small synthetic corpus with closed-form coordinates: three flat patches, three events, three runs."""

from __future__ import annotations

VOXEL_MM = 0.0096
MM = 1.0 / VOXEL_MM


def vertices(spark):
    rows = []
    for r in range(30):
        for c in range(80):
            ok = not (r >= 26 and c >= 70) and (r, c) != (0, 79)
            rows.append(("pA", r, c, 1000.0 + 20 * c, 2000.0, 3000.0 + 20 * r, ok))
    for p in ("pB", "pC"):
        for r in range(60):
            for c in range(20):
                rows.append((p, r, c, 9000.0, 500.0 + 20 * c, 100.0 + 20 * r, True))
    return spark.createDataFrame(rows, "patch string, row bigint, col bigint, x double, y double, z double, valid boolean")


def corpus_json(wrong_centre=False, wrong_length=False, bad_vertex=False):
    def event(patch, status, a, b, xyz):
        return {"patch": patch, "status": status, "xyz": xyz, "delta_signs": [1],
                "transitions": [{"axis": "row", "rc_a": a, "rc_b": b, "len_a_mm": 2.0, "len_b_mm": 2.0}]}

    return {
        "voxel_mm": VOXEL_MM,
        "events": [
            event("pA", "confirmed", [5, 10], [5, 11] if not bad_vertex else [5, 99], [1210.0 + (3 if wrong_centre else 0), 2000.0, 3100.0]),
            event("pA", "contradicted", [19, 40], [19, 41], [1810.0, 2000.0, 3380.0]),
            event("pC", "unconfirmed", [3, 3], [3, 4], [9000.0, 570.0, 160.0]),
        ],
        "negatives": [
            {"patch": "pA", "status": "confirmed", "axis": "row", "rc0": [20, 0], "rc1": [20, 60], "len_mm": 11.52 + (1 if wrong_length else 0),
             "xyz0": [1000.0, 2000.0, 3400.0], "xyz1": [2200.0, 2000.0, 3400.0]},
            {"patch": "pB", "status": "confirmed", "axis": "col", "rc0": [0, 5], "rc1": [59, 5], "len_mm": 11.33,
             "xyz0": [9000.0, 600.0, 100.0], "xyz1": [9000.0, 600.0, 1280.0]},
            {"patch": "pA", "status": "unconfirmed", "axis": "row", "rc0": [22, 0], "rc1": [22, 60], "len_mm": 11.52, "xyz0": None, "xyz1": None},
        ],
    }


def point_table(spark, rows):
    return spark.createDataFrame(rows, "detector string, patch string, alarm_ord bigint, x double, y double, z double")
