"""Thresholds of the rules, as frozen dataclasses passed to operators as literals.

Fixed values: they must equal the published defaults for results to agree.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ClassRules:
    person_conf: float = 0.08
    vehicle_conf: float = 0.15
    building_conf: float = 0.15
    boat_conf: float = 0.15
    other_conf: float = 0.15
    person_min_area: float = 10.0
    person_max_area: float = 3500.0
    person_max_aspect: float = 8.0
    vehicle_min_area: float = 250.0
    vehicle_max_area: float = 12000.0
    vehicle_min_aspect: float = 1.05
    vehicle_max_aspect: float = 4.5
    building_min_area: float = 2500.0
    building_min_aspect: float = 0.35
    building_max_aspect: float = 3.0
    boat_min_overlap: float = 0.15
    vote_ratio: float = 0.60
    override_ratio: float = 0.65
    switch_limit: int = 3
    unstable_ratio: float = 0.50


@dataclass(frozen=True)
class FrameRules:
    min_sharpness: float = 20.0
    max_under: float = 0.25
    max_over: float = 0.40
    min_brightness: float = 15.0
    max_sky: float = 0.75
    similarity: float = 0.994
    max_selected: int = 24


@dataclass(frozen=True)
class CloudRules:
    conf: float = 0.50
    voxel: float = 0.02
    sor_k: int = 20
    sor_ratio: float = 2.0
    ror_points: int = 10
    ror_radius: float = 0.08
    cluster_min: int = 10


VEHICLE_CLASSES = ("car", "truck", "bus", "motorcycle", "bicycle")
