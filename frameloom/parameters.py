"""Thresholds of all operators, with the values of the published defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Parameters:
    """One record; ``with_`` gives a changed copy."""

    # The published defaults, which results must agree with.
    # tracking and smoothing
    smoothing_window: int = 12
    flip_streak: int = 3
    flip_gain: float = 0.05
    reassign_iou: float = 0.35
    reassign_gap: int = 4
    track_match_high: float = 0.45
    track_high_iou: float = 0.35
    track_low: float = 0.15
    track_low_iou: float = 0.25
    simple_track_iou: float = 0.25
    frame_stride: int = 1
    # floors for new tracks
    new_track_floor: dict[str, float] = field(default_factory=lambda: {"cookware": 0.35, "dishware": 0.40, "utensil": 0.50, "appliance": 0.45, "hand": 0.30})
    new_track_floor_other: float = 0.28
    # conflicts
    conflict_iou: float = 0.60
    conflict_mask_iou: float = 0.50
    conflict_containment: float = 0.70
    temporal_iou: float = 0.45
    confirmed_overlap_iou: float = 0.75
    cookware_dishware_iou: float = 0.60
    cookware_cluster_iou: float = 0.35
    nms_iou: float = 0.45
    nms_cookware_iou: float = 0.82
    # persistence
    persistence_frames: int = 3
    hand_persistence_frames: int = 5
    persistence_decay: float = 0.92
    persistence_min_confidence: float = 0.18
    persistence_min_stable: int = 2
    confirmed_persistence: int = 2
    hand_confirmed_persistence: int = 4
    stale_confidence: float = 0.16
    cold_start_frames: int = 1
    cold_start_confidence: float = 0.20
    seed_frames: int = 4
    seed_confidence: float = 0.16
    short_frames: int = 1
    short_confidence: float = 0.18
    handheld_frames: int = 6
    handheld_confirmed: int = 4
    # recovery from memory
    memory_min_stable: int = 2
    memory_confidence: float = 0.20
    memory_frames: int = 7
    memory_confirmed: int = 1
    memory_least_area: int = 1
    # hands
    hand_iou: float = 0.01
    hand_distance_scale: float = 1.4
    hand_border_confidence: float = 0.48
    occlusion_tracks: int = 3
    occlusion_iou: float = 0.15
    occlusion_containment: float = 0.40
    occlusion_clear_frames: int = 8
    # memory
    positive_similarity: float = 0.72
    uncertain_similarity: float = 0.78
    delete_similarity: float = 0.85
    neighbours: int = 5
    active_per_label: int = 500
    active_negative: int = 1000

    def with_(self, **changes) -> Parameters:
        return replace(self, **changes)


DEFAULTS = Parameters()
