"""Defaults of the operators, as keyword-friendly dataclasses."""

from __future__ import annotations

from dataclasses import dataclass

# The pitch in metres, the tagger's grid and the detector's classes.
LENGTH, WIDTH = 105.0, 68.0
GRID_X, GRID_Y = 120.0, 80.0
BOX_DEPTH, BOX_WIDTH = 16.5, 40.32
GOAL_WIDTH = 7.32
BALL, GOALKEEPER, PLAYER, REFEREE = 0, 1, 2, 3


@dataclass(frozen=True)
class Possession:
    max_distance: float = 2.4
    max_share_of_width: float = 0.045
    confirm: int = 4
    release: int = 4
    min_spell: int = 2
    steal: int = 4
    regain: int = 2


@dataclass(frozen=True)
class Events:
    min_pass: float = 3.0
    max_pass: float = 60.0
    max_keeper_pass: float = 85.0
    max_flight: float = 8.0
    long_pass: float = 32.0
    tackle_reach: float = 3.5
    tackle_time: float = 1.2
    carry: float = 4.0
    carry_time: float = 0.4
    shot_range: float = 35.0
    shot_margin: float = 3.5
    shot_speed: float = 7.0
    shot_arrival: float = 14.0
    shot_travel: float = 2.0
    block_range: float = 18.0
    clearance_third: float = 0.34
    clearance_length: float = 22.0
    evidence_floor: float = 0.55
    evidence_reference: float = 0.7
    assist_time: float = 5.0
    assist_reach: float = 6.0
    trim_cosine: float = -0.3
    keeper_tail: float = 0.7


@dataclass(frozen=True)
class Stitch:
    rounds: tuple[float, ...] = (0.6, 1.6, 3.5)
    burst: float = 9.0
    burst_time: float = 0.45
    sustained: float = 3.0
    tolerance: float = 1.8
    horizon: float = 0.45
    window: int = 5
    kit_weight: float = 0.30
    kit_limit: float = 0.55
    ambiguity: float = 0.75
    min_rows: int = 3
    image_share: float = 0.06
    use_image: bool = True


@dataclass(frozen=True)
class Clips:
    lead: float = 6.0
    trail: float = 3.0
    cap: float = 45.0
    most: int = 60
    kinds: tuple[str, ...] = ("Shot", "Goal", "Cross", "Shot Assist", "Tackle")
