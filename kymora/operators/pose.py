"""Head pose from 2-D points and a 3-D model: Gauss-Newton with damping, started from the last pose."""

from __future__ import annotations

import math

import numpy as np

from kymora.operators.folds import Machine

#: A face's anchors in millimetres (nose tip, chin, eye corners, mouth corners).
MODEL = np.array([(0.0, 0.0, 0.0), (0.0, 63.6, -12.5), (-43.3, -32.7, -26.0), (43.3, -32.7, -26.0), (-28.9, 28.9, -24.1), (28.9, 28.9, -24.1)])


def rotation(v: np.ndarray) -> np.ndarray:
    """Matrix of a rotation vector."""
    angle = float(np.linalg.norm(v))
    if angle < 1e-12:
        return np.eye(3)
    x, y, z = v / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * (k @ k)


def project(pose: np.ndarray, focal: float, centre: tuple[float, float], model: np.ndarray = MODEL) -> np.ndarray:
    p = model @ rotation(pose[:3]).T + pose[3:]
    return focal * p[:, :2] / p[:, 2:] + np.array(centre)


def solve(points: np.ndarray, focal: float, centre: tuple[float, float], guess: np.ndarray | None = None, model: np.ndarray = MODEL) -> np.ndarray | None:
    """(rotation vector, translation) of least reprojection error, or None: points too close, or a face behind the camera."""
    if not np.isfinite(points).all() or np.ptp(points, axis=0).max() < 10:
        return None
    start = guess
    if start is None:
        depth = focal * np.ptp(model[:, 0]) / max(1.0, np.ptp(points[:, 0]))
        middle = (points.mean(axis=0) - np.array(centre)) * depth / focal
        start = np.array([0, 0, 0, middle[0], middle[1], depth], float)
    pose, damp = np.array(start, float), 1e-3
    error = lambda q: (project(q, focal, centre, model) - points).ravel()
    r = error(pose)
    for _ in range(60):
        steps = np.array([1e-6] * 3 + [1e-3] * 3)
        jac = np.stack([(error(pose + np.eye(6)[i] * steps[i]) - r) / steps[i] for i in range(6)], axis=1)
        h = jac.T @ jac
        move = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), -jac.T @ r)
        new = error(pose + move)
        if new @ new < r @ r:
            done = r @ r - new @ new < 1e-12
            pose, r, damp = pose + move, new, damp / 4
            if done:
                break
        else:
            damp *= 8
            if damp > 1e9:
                break
    return pose if np.isfinite(pose).all() and pose[5] > 0 else None


def euler(pose: np.ndarray) -> tuple[float, float, float]:
    """(pitch, yaw, roll) in degrees, seen along the line of sight to the face."""
    m = rotation(pose[:3])
    t = pose[3:]
    if t[2] > 10:
        yaw, pitch = math.atan2(t[0], t[2]), math.atan2(-t[1], math.hypot(t[0], t[2]))
        m = rotation(np.array([-pitch, 0, 0])) @ rotation(np.array([0, -yaw, 0])) @ m
    flat = math.hypot(m[0, 0], m[1, 0])
    return tuple(math.degrees(a) for a in (math.atan2(m[2, 1], m[2, 2]), math.atan2(-m[2, 0], flat), math.atan2(m[1, 0], m[0, 0])))


def regularised_yaw(yaw: float, asymmetry: float) -> float:
    """Blended with the yaw that the face's asymmetry says when they differ by more than 15 degrees."""
    geometric = max(-75.0, min(75.0, 50 * asymmetry))
    return 0.7 * yaw + 0.3 * geometric if abs(yaw - geometric) > 15 else yaw


def tracker(focal: float, centre: tuple[float, float]) -> Machine:
    """Pose per row, started from the row before; input (points: 12 numbers)."""

    def step(state, row):
        points = None if row[0] is None else np.asarray(row[0], float).reshape(-1, 2)
        pose = None if points is None or len(points) != len(MODEL) else solve(points, focal, centre, None if state is None else np.array(state))
        if pose is None:
            return state, (None, None, None, None)
        return tuple(pose.tolist()), (*euler(pose), float(pose[5]))

    return Machine(step, None, "pitch double, yaw double, roll double, depth double")
