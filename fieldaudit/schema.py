"""Explicit schemas of all inputs.  Field names are those of the published file formats."""

from __future__ import annotations

VERTEX = "patch string, row bigint, col bigint, x double, y double, z double, valid boolean"
TRANSITION = "struct<axis: string, rc_a: array<bigint>, rc_b: array<bigint>, len_a_mm: double, len_b_mm: double>"
EVENT = (
    "struct<patch: string, subset: string, status: string, xyz: array<double>, delta_signs: array<bigint>, "
    f"transitions: array<{TRANSITION}>>"
)
NEGATIVE = (
    "struct<patch: string, status: string, axis: string, rc0: array<bigint>, rc1: array<bigint>, len_mm: double, "
    "xyz0: array<double>, xyz1: array<double>>"
)
SCORING = "struct<match_mm: double, per_patch_cap: bigint, bootstrap: bigint, seed: bigint, fa_dedup_mm: double>"
CORPUS = (
    f"events array<{EVENT}>, negatives array<{NEGATIVE}>, multi_wrap array<struct<patch: string>>, scroll string, frame string, "
    f"voxel_mm double, patch_source struct<bucket: string, prefix: string>, scoring {SCORING}, geometry_sha256 string"
)

# Native detector outputs, one document (or part of one) per patch.
REVIEW = (
    "findings array<struct<code: string, level: string>>, "
    "geometry struct<coherent_normal_steps: struct<candidate_edge_examples: array<struct<rc: array<bigint>>>>>"
)
SIDE = "arrays struct<coherent_normal_step_cells: array<array<bigint>>>"
COLLECTIONS = "collections map<string, struct<points: map<string, struct<p: array<double>, wind_a: double>>>>"
CONTACTS = "transverse_both bigint, contacts array<struct<xyz1: array<double>, xyz2: array<double>>>"
PAIRS = "alarms array<struct<xyz_p: array<double>, xyz_q: array<double>>>"
STEPS = "verdict string, flagged_steps array<struct<xyz: array<double>>>"
EDGES = (
    "pcl_id string, from_point_id string, to_point_id string, P string, R string, from_ij array<double>, to_ij array<double>"
)
AFTER_EDGES = "rel_pcl_id string, from_point_id string, to_point_id string"
STRATA = "results struct<per_event: array<struct<patch: string, xyz: array<double>, abrupt_primary_sf: boolean>>>"
ENTRIES = "name string, alarms string, tool string, mode string, notes string"
