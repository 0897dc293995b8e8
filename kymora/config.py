"""Thresholds of the monitor's rules: a frozen record with a JSON overlay that ignores keys it doesn't know."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Defaults; durations in seconds, angles in degrees."""

    yaw_limit: float = 35.0
    pitch_down: float = -30.0
    pitch_up: float = 25.0
    eye_closed: float = 0.21
    mouth_open: float = 0.60
    closed_window_s: float = 60.0
    closed_warmup_s: float = 5.0
    dispersion_window_s: float = 15.0
    freeze_s: float = 0.150
    shock_ms2: float = 4.0
    rotation_limit: float = 20.0
    duty_window_s: float = 2.0
    duty_limit: float = 0.25
    window_s: float = 3.0
    stride_s: float = 1.5
    window_frames: int = 90
    fill: float = 0.70
    saccade_on: float = 35.0
    saccade_off: float = 20.0
    dead_x: float = 0.026
    dead_xy: float = 0.030
    head_jump: float = 0.055
    socket_moves: float = 0.75
    degrees_a_unit: float = 22.0
    shake_ms2: float = 1.5
    shake_s: float = 0.5
    prior: float = 0.01
    lock_at: float = 0.999
    lock_s: float = 15.0
    log_odds_cap: float = 12.0
    warn_s: float = 1.5
    warn_high_s: float = 0.5
    hold_s: float = 1.0

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Known keys over the defaults."""
        found = json.loads(text)
        known = {f.name for f in fields(cls)}
        return replace(cls(), **{k: v for k, v in found.items() if k in known})


#: Marker scores by threshold, strictest first; (name, above, steps).
LADDERS = {
    "perclos": (True, ((0.30, 90.0), (0.15, 50.0))),
    "pursuit_fragmentation": (True, ((0.30, 85.0), (0.15, 45.0))),
    "vor_depression": (False, ((0.65, 75.0), (0.78, 35.0))),
    "blink_velocity": (False, ((1.2, 80.0), (1.8, 40.0))),
    "gaze_tunneling": (False, ((0.03, 75.0), (0.06, 35.0))),
    "postural_sway": (True, ((1.8, 70.0), (1.2, 35.0))),
    "jaw_slackness": (True, ((0.35, 70.0), (0.22, 35.0))),
    "sclera_redness": (True, ((1.35, 75.0), (1.15, 35.0))),
}
#: Names of the impaired class.
IMPAIRED = ["impaired", "intoxicated", "alcohol", "drunk", "drowsy", "1", "true", "positive"]
