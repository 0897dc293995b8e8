"""Adaptive low-pass filters of whole landmark arrays: one filter's step on numpy arrays, and the bank of four profiles.

A cutoff rises with speed, in units of the eyes' distance, and falls with oscillation, seen or told, so that shaking is
smoothed and real moves pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from kymora.keys import SECOND
from kymora.operators.folds import Machine

#: Fixed values: (cutoff in Hz, gain of speed, cutoff of the derivative) of each profile.
PROFILES = {"rigid": (0.7, 0.007, 1.0), "eyelid": (2.0, 0.50, 8.0), "iris": (1.0, 0.20, 3.0), "corner": (1.5, 0.35, 1.0), "skull": (1.8, 0.65, 8.0)}


@dataclass(frozen=True)
class Layout:
    """Which points of a face are what; the eyes' points are taken relative to their eye, all others to the skull."""

    skull: tuple[int, ...]
    right_corners: tuple[int, int]
    left_corners: tuple[int, int]
    right_eye: tuple[int, ...] = ()
    left_eye: tuple[int, ...] = ()
    eyelid: tuple[int, ...] = ()
    iris: tuple[int, ...] = ()
    dims: int = 2


def share(cutoff, dt: float):
    """How much of a new value passes at a cutoff."""
    r = 2 * math.pi * cutoff * dt
    return r / (r + 1)


def begin(x: np.ndarray) -> tuple:
    return x, np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)


def advance(state: tuple, x: np.ndarray, dt: float, profile, structural, scale: float, vibration: float) -> tuple:
    """(value, derivative, raw derivative, oscillation) after a value, ``dt`` seconds on."""
    value, slope, raw, osc = state
    cutoff, beta, d_cutoff = profile
    dx = (x - value) / dt
    osc = 0.35 * (dx * raw < 0) + 0.65 * osc
    shaken = np.maximum(osc, min(max(vibration, 0.0), 1.0))
    slope = share(d_cutoff, dt) * dx + (1 - share(d_cutoff, dt)) * slope
    low = cutoff * np.where((shaken > 0.4) & structural, 0.5, 1.0)
    a = share(low + beta * np.maximum(0.05, 1 - 1.5 * shaken) * np.abs(slope) * 100 / max(scale, 1.0), dt)
    return a * x + (1 - a) * value, slope, dx, osc


def filter_bank(layout: Layout, n: int) -> Machine:
    """The bank for faces of ``n`` points; inputs (us, points as one array, vibration): the filtered points.

    Skull and eye corners have filters of their own; what a point is relative to its anchor passes its own profile, and the
    filtered parts are put together again. A face with a missing or non-finite number repeats the last one.
    """
    cutoffs = np.repeat(np.array([PROFILES["rigid"]]), n, axis=0)
    corners = [*layout.right_corners, *layout.left_corners]
    for name, points in (("eyelid", layout.eyelid), ("iris", layout.iris)):
        cutoffs[list(points)] = PROFILES[name]
    cutoffs[corners, :2] = PROFILES["corner"][:2]
    profile = tuple(cutoffs[:, i : i + 1] for i in range(3))
    structural = np.ones((n, 1), bool)
    structural[[*layout.eyelid, *layout.iris]] = False

    def anchors(skull: np.ndarray, pair: np.ndarray) -> np.ndarray:
        out = np.repeat(skull[None, :], n, axis=0)
        out[list(layout.right_eye)], out[list(layout.left_eye)] = skull + pair[0], skull + pair[1]
        return out

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        skull = x[list(layout.skull)].mean(axis=0)
        return skull, np.stack([x[list(c)].mean(axis=0) - skull for c in (layout.right_corners, layout.left_corners)])

    def step(state, row):
        us, flat, vibration = row
        if flat is None or len(flat) != n * layout.dims or not np.isfinite(np.asarray(flat, float)).all():
            return state, (state[1].ravel().tolist() if state else None,)
        x = np.asarray(flat, float).reshape(n, layout.dims)
        skull, pair = parts(x)
        if state is None:
            return (us, x, begin(skull), begin(pair), begin(x - anchors(skull, pair))), (x.ravel().tolist(),)
        last, out, skull_state, pair_state, rest_state = state
        dt = (us - last) / SECOND
        if dt <= 1e-9:
            return state, (out.ravel().tolist(),)
        apart = float(np.hypot(*(x[layout.right_corners[0]] - x[layout.left_corners[0]])[:2]))
        scale, vibration = apart if apart > 5 else 100.0, vibration or 0.0
        pair_state = advance(pair_state, pair, dt, PROFILES["corner"], True, scale, vibration)
        skull_state = advance(skull_state, skull, dt, PROFILES["skull"], True, scale, vibration)
        rest_state = advance(rest_state, x - anchors(skull, pair_state[0]), dt, profile, structural, scale, vibration)
        out = rest_state[0] + anchors(skull_state[0], pair_state[0])
        return (us, out, skull_state, pair_state, rest_state), (out.ravel().tolist(),)

    return Machine(step, None, "filtered array<double>")
