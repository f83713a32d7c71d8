"""Thresholds of the scene rules.  Lengths in metres, angles in degrees."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SceneConfig:
    grid_snap: float = 0.02
    near: float = 1.0
    far: float = 3.0
    touching: float = 0.05
    against: float = 0.30
    parallel_deg: float = 15.0
    facing_deg: float = 25.0
    overlap_area: float = 1e-3
    backing_coverage: float = 0.80
    backing_clearance: float = 0.30
    opaque_height: float = 1.40
    grid_cell: float = 0.05
    corridor: float = 0.60
    corridor_radius: float = 0.30
    seating_radius: float = 1.5
    nightstand: float = 0.6
    desk_chair: float = 0.8
    table_for: float = 0.6
    lamp_of_nightstand: float = 0.4
    command_door: float = 1.0
    door_alignment_deg: float = 20.0
    corner_distance: float = 1.0
    corner_deg: float = 30.0
    center_radius: float = 1.0
    center_occupancy: float = 0.25
    light_distance: float = 3.0
    blocker_height: float = 0.2
    door_blocker_height: float = 0.5
    door_probe: float = 0.20
    backing_sample_distance: float = 0.20
    fixture_cut: float = 0.05
    side_slack: float = 0.5
    ray: float = 30.0
    bounds_pad: float = 0.5
    arc_segments: int = 16
    # quirks of the rule set that may be switched off
    tall_objects_hide_themselves: bool = True
    pairing_falls_through: bool = True
    half_width_is_width: bool = True
    blank_parameters_shift: bool = True
