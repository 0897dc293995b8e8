"""State machines over a stream: each is one ``step(state, row) -> (state, outputs)``, run by a batch fold or a streaming processor.

The batch fold sorts within hash partitions of the subject and carries the state from one Arrow batch to the next, so a
subject of any length takes no more memory than a batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymora.config import Config
from kymora.keys import SECOND, Stream

Step = Callable[[Any, tuple], tuple[Any, tuple]]


@dataclass(frozen=True)
class Machine:
    """A step, its first state, the names of its outputs and their Spark types."""

    step: Step
    first: tuple
    outputs: str


def _plain(v: Any) -> Any:
    """None for a missing number."""
    return None if v is None or isinstance(v, float) and v != v else v


def _run(frames: Iterator[pd.DataFrame], machine: Machine, subject: list[str], inputs: list[str], keep: list[str]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in machine.outputs.split(", ")]
    now, state = None, machine.first
    for df in frames:
        out = []
        for key, row in zip(df[subject].itertuples(index=False, name=None), df[inputs].itertuples(index=False, name=None)):
            if key != now:
                now, state = key, machine.first
            state, got = machine.step(state, tuple(map(_plain, row)))
            out.append(got)
        yield pd.concat([df[keep].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)


def fold(df: DataFrame, s: Stream, machine: Machine, inputs: list[str], keep: list[str]) -> DataFrame:
    """Runs a machine over each subject's rows in order: ``keep`` columns and the machine's outputs."""
    columns = list(dict.fromkeys([*s.subject, *s.order, *inputs, *keep]))
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep), machine.outputs])
    ordered = df.select(*columns).repartition(*s.subject).sortWithinPartitions(*s.subject, *s.order)
    subject = list(s.subject)
    return ordered.mapInPandas(lambda it: _run(it, machine, subject, inputs, keep), schema)


def restarting(machine: Machine) -> Machine:
    """The machine with one more input, the first: a row where it holds starts anew, as a new segment or a control row does."""

    def step(state, row):
        return machine.step(machine.first if row[0] else state, row[1:])

    return Machine(step, machine.first, machine.outputs)


def ema(alpha: float) -> Machine:
    """y = alpha x + (1 - alpha) y, from the first value on; input (x)."""

    def step(state, row):
        y = row[0] if state is None else alpha * row[0] + (1 - alpha) * state
        return y, (y,)

    return Machine(step, None, "ema double")


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-20.0, min(20.0, x))))


def evidence(cfg: Config = Config()) -> Machine:
    """Sequential evidence with a clipped log-odds sum, a leaky timer and a latch.

    Inputs (us, risk, observed, hard, parked), and, where a table has them, (total, sober, beats, apart, voice): the total
    risk (else the risk), whether the class is SOBER (else a risk under 25), two reflex signs, and the score of slurred
    speech (else none), which counts from a risk of 25 on and is a hard sign itself.
    """
    prior = math.log(cfg.prior / (1 - cfg.prior))

    def rate(risk, sober, beats, apart, voice):
        if risk >= 50:
            out = 1 + 1.5 * (risk - 50) / 50 + (1.0 if beats else 0.0) + (0.5 if apart else 0.0)
        elif risk >= 30:
            out = 0.2 + 0.6 * (risk - 30) / 20
        else:
            out = -1.25 if risk < 12 and sober else -0.40
        return out + (0.35 * voice / 100 if voice is not None and risk >= 25 else 0.0)

    def step(state, row):
        odds, timer, latched, last = state if state else (prior, 0.0, False, None)
        us, risk, observed, hard, parked, total, sober, beats, apart, voice = (*row, None, None, None, None, None)[:10]
        dt = 0.033 if last is None else (us - last) / SECOND
        if parked:
            odds, timer, latched = prior, 0.0, False
        elif not observed:
            if not latched:
                timer = max(0.0, timer - 0.5 * min(max(dt, 1e-4), 1.0))
        else:
            dt = 1e-4 if dt <= 0 else min(dt, 0.25)
            gain = rate(risk, risk < 25 if sober is None else sober, beats, apart, voice)
            sure = hard or beats or apart or voice is not None
            if gain > 0 and not sure and max(risk, total or 0.0) < 48 and sigmoid(odds) > 0.20:
                gain = 0.0
            odds = max(prior - 1, min(cfg.log_odds_cap, odds + gain * dt))
            if latched:
                timer = max(cfg.lock_s, timer)
            elif sigmoid(odds) >= cfg.lock_at:
                timer += dt
                latched = timer >= cfg.lock_s
            else:
                timer = max(0.0, timer - 2 * dt)
        return (odds, timer, latched, us), (odds, sigmoid(odds), timer, latched)

    return Machine(step, None, "log_odds double, posterior double, sustained double, latched boolean")


def debounce(cfg: Config = Config()) -> Machine:
    """Persistent commands; inputs (us, raw 0-2, high, unknown): 2 at once, 1 after a while, none on a sober row, held briefly while unknown."""

    def step(state, row):
        since, active, gate = state if state else (None, False, None)
        us, raw, high, unknown = row
        if raw == 2:
            return (None, False, None), (2,)
        if unknown:
            gate = us if gate is None else gate
            if us - gate <= cfg.hold_s * SECOND:
                return (since, active, gate), (1 if active else 0,)
            return (None, False, gate), (0,)
        if raw == 1:
            since = us if since is None else since
            active = active or us - since >= (cfg.warn_high_s if high else cfg.warn_s) * SECOND
            return (since, active, None), (1 if active else 0,)
        return (None, False, None), (0,)

    return Machine(step, None, "command int")


def parabola(points: list[tuple[float, float]]) -> float:
    """Twice the leading coefficient of the least-squares parabola."""
    import numpy as np

    t = np.array([p[0] for p in points]) - points[-1][0]
    a, *_ = np.linalg.lstsq(np.stack([t * t, t, np.ones_like(t)], axis=1), np.array([p[1] for p in points]), rcond=None)
    return float(2 * a[0])


def wrapped(d: float) -> float:
    """An angle's difference within half a turn."""
    return (d + 180.0) % 360.0 - 180.0


def shock_gate(cfg: Config = Config()) -> Machine:
    """Freezes rows after a jolt; inputs (us, x, y, z in mm, pitch, yaw, roll in degrees), a missing pose being null.

    Positions are smoothed and a parabola over at most five of them, within 150 ms, gives the acceleration. A strong one
    while the head hardly turns starts a freeze of 150 ms, unless one runs or frozen time has its share of the last two
    seconds. More than two missing poses, or half a second without any, start the smoothing anew. A steady shake of half a
    second sets ``shaking``.
    """

    def step(state, row):
        smooth, past, turn, freezes, until, last, missing, shake = state if state else (None, (), None, (), -math.inf, None, 0, (None, None, False))
        us, pos, euler = row[0], row[1:4], row[4:7]
        t = us / SECOND
        freezes = tuple(f for f in freezes if f[1] > t - cfg.duty_window_s)
        frozen = sum(max(0.0, min(b, t) - max(a, t - cfg.duty_window_s)) for a, b in freezes)
        over = frozen / cfg.duty_window_s >= cfg.duty_limit
        if over and t < until:
            until = t
            freezes = (*freezes[:-1], (freezes[-1][0], t)) if freezes else freezes
        accel = 0.0
        if None in pos:
            missing += 1
            if missing > 2 or (last is not None and t - last > 0.5):
                smooth, past, turn = None, (), None
        elif last is None or smooth is None:
            smooth, past, last, missing = pos, (*past, (t, *pos))[-5:], t, 0
            turn = euler if None not in euler else turn
            return (smooth, past, turn, freezes, until, last, missing, shake), (accel, False, over, shake[2])
        elif t - last > 0.5:
            smooth, past, last, missing = pos, ((t, *pos),), t, 0
        else:
            smooth = tuple(0.65 * a + 0.35 * b for a, b in zip(pos, smooth))
            past, missing = (*past, (t, *smooth))[-5:], 0
            while len(past) > 3 and t - past[0][0] > cfg.freeze_s:
                past = past[1:]
            if len(past) >= 3 and past[-1][0] - past[0][0] >= 1e-5:
                accel = math.sqrt(sum(parabola([(p[0], p[i]) for p in past]) ** 2 for i in (1, 2, 3))) / 1000
            speed = 0.0
            if None not in euler:
                speed = 0.0 if turn is None else math.sqrt(sum(wrapped(a - b) ** 2 for a, b in zip(euler, turn))) / max(t - last, 1e-4)
                turn = euler
            still = speed < cfg.rotation_limit
            begun, seen, shaking = shake
            if still and accel >= cfg.shake_ms2:
                begun, seen = t if begun is None else begun, t
                shaking = shaking or t - begun >= cfg.shake_s
            elif seen is not None:
                begun = None if t - seen > 0.25 else begun
                seen, shaking = (None, False) if t - seen > cfg.shake_s else (seen, shaking)
            shake = (begun, seen, shaking)
            if accel > cfg.shock_ms2 and still and t >= until and not over:
                until = t + cfg.freeze_s
                # A freeze that begins where the last ends is one with it.
                touching = freezes and t <= freezes[-1][1]
                freezes = (*freezes[:-1], (freezes[-1][0], until)) if touching else (*freezes, (t, until))
            last = t
        return (smooth, past, turn, freezes, until, last, missing, shake), (accel, t < until and not over, over, shake[2])

    return Machine(step, None, "acceleration double, frozen boolean, capped boolean, shaking boolean")


def one_euro(min_cutoff: float = 1.0, beta: float = 0.007, d_cutoff: float = 1.0, structural: bool = False) -> Machine:
    """A low-pass filter whose cutoff rises with speed and falls with oscillation; inputs (us, x, scale) and, if any, vibration."""

    def alpha(f: float, dt: float) -> float:
        r = 2 * math.pi * f * dt
        return r / (r + 1)

    def step(state, row):
        us, x, scale, vibration = (*row, None)[:4]
        if x is None or not math.isfinite(x):
            return state, (state[0] if state else None,)
        if state is None:
            return (x, 0.0, 0.0, 0.0, us), (x,)
        prev, speed, raw, osc, last = state
        dt = (us - last) / SECOND
        if dt <= 1e-9:
            return state, (prev,)
        dx = (x - prev) / dt
        osc = 0.35 * (dx * raw < 0) + 0.65 * osc
        shaken = max(osc, min(1.0, vibration or 0.0))
        speed = alpha(d_cutoff, dt) * dx + (1 - alpha(d_cutoff, dt)) * speed
        low = min_cutoff * (0.5 if structural and shaken > 0.4 else 1.0)
        a = alpha(low + beta * max(0.05, 1 - 1.5 * shaken) * abs(speed) * 100 / max(scale or 1.0, 1.0), dt)
        y = a * x + (1 - a) * prev
        return (y, speed, dx, osc, us), (y,)

    return Machine(step, None, "filtered double")


def stare(longest_drift: float = 2.5, held: int = 300) -> Machine:
    """Fixation on an anchor; inputs (us, x, y in degrees, broken, upstroke): duration, whether it is a rigid stare, and
    whether an alert driver's steady gaze excuses it. The spread is that of the last ``held`` rows since the anchor."""

    def step(state, row):
        us, x, y, broken, upstroke = row
        if state is None or broken or math.hypot(x - state[1], y - state[2]) > longest_drift:
            return (us, x, y, ((x, y),)), (0.0, False, False)
        start, ax, ay, seen = state
        seen = (*seen, (x, y))[-held:]
        lasts = (us - start) / SECOND
        rigid = excused = False
        if lasts >= 6 and len(seen) >= 15:
            n, mx, my = len(seen), math.fsum(p[0] for p in seen) / len(seen), math.fsum(p[1] for p in seen) / len(seen)
            spread = math.sqrt(math.fsum((p[0] - mx) ** 2 + (p[1] - my) ** 2 for p in seen) / n)
            excused = 0.15 <= spread < 0.8 and (upstroke or 0) >= 1.8
            rigid = spread < 0.8 and not excused
        return (start, ax, ay, seen), (lasts, rigid, excused)

    return Machine(step, None, "duration double, rigid boolean, excused boolean")


def saccade(cfg: Config = Config()) -> Machine:
    """Gaze jumps with hysteresis; inputs (us, x, y, left, right, closed, head_speed, socket_speed, vibration, yaw).

    Dead zones widen with vibration; eyes that part, or a far eye that jumps alone in a turned head, don't count whole; a
    moving head needs a larger jump and its speed is taken off. A blink ends a jump and the first row after it is a new
    anchor, as is one after half a second.
    """

    def step(state, row):
        us, x, y, left, right, closed, head, socket, vibration, yaw = row
        t = us / SECOND
        prev, jumping, ended, blinked = state if state else (None, False, None, False)
        since = lambda: 0.0 if ended is None else (t - ended) * 1000
        now = (t, x, y, left, right)
        if x is None or y is None or not (math.isfinite(x) and math.isfinite(y)):
            return state, (0.0, False, 0.0)
        if prev is None:
            return (now, jumping, ended, blinked), (0.0, False, 0.0)
        dt = t - prev[0]
        if dt <= 1e-6:
            return state, (0.0, jumping, 0.0)
        if dt > 0.5 or closed:
            ended = t if jumping else ended
            return (now, False, ended, blinked or bool(closed and dt <= 0.5)), (0.0, False, since() if dt <= 0.5 else 0.0)
        if blinked:
            return (now, False, ended, False), (0.0, False, since())
        dx, dy = abs(x - prev[1]), abs(y - prev[2])
        jump = dx
        if None not in (left, right, prev[3], prev[4]):
            dl, dr = left - prev[3], right - prev[4]
            if dl * dr < -1e-4:
                jump = 0.0
            elif abs(yaw or 0.0) > 12 and max(abs(dl), abs(dr)) > 2.2 * min(abs(dl), abs(dr)):
                jump = min(abs(dl), abs(dr))
        wide = 1 + 1.2 * vibration if (vibration or 0.0) > 0.2 else 1.0
        head, socket = head or 0.0, socket or 0.0
        if socket > cfg.socket_moves or (head > 15 and socket > 0.30):
            speed = 0.0 if jump < max(cfg.head_jump, cfg.dead_x * wide, 0.085) else max(0.0, jump * cfg.degrees_a_unit / dt - 0.85 * head)
        else:
            speed = 0.0 if jump < cfg.dead_x * wide or math.hypot(dx, dy / 2) < cfg.dead_xy * wide else jump * cfg.degrees_a_unit / dt
        if not jumping:
            jumping = speed > cfg.saccade_on
        elif speed < cfg.saccade_off:
            jumping, ended = False, t
        return (now, jumping, ended, False), (speed, jumping, 0.0 if jumping else since())

    return Machine(step, None, "speed double, jumping boolean, latency_ms double")


def jump_rejection(limit: float = 25.0) -> Machine:
    """Angles whose jump exceeds ``limit`` are rejected once and taken the second time; inputs (yaw, pitch, roll)."""

    def step(state, row):
        if state is None or any(v is None for v in row):
            return (row, 0) if state is None else state, (*(row if state is None else state[0]), False)
        last, misses = state
        jumps = max(abs((a - b + 180) % 360 - 180) for a, b in zip(row, last))
        if jumps > limit and misses == 0:
            return (last, 1), (*last, True)
        return (row, 0), (*row, False)

    return Machine(step, None, "yaw_out double, pitch_out double, roll_out double, rejected boolean")


def roi_tracker() -> Machine:
    """Centre and scale followed by a smoothing that quickens with the jump; inputs (cx, cy, scale)."""

    def step(state, row):
        if any(v is None for v in row):
            return state, state or (None, None, None)
        if state is None:
            return row, row
        a = min(0.85, 0.15 + 0.70 * max(0.0, (math.sqrt((row[0] - state[0]) ** 2 + (row[1] - state[1]) ** 2) - 8) / 30))
        new = (state[0] + a * (row[0] - state[0]), state[1] + a * (row[1] - state[1]), state[2] + 0.15 * (row[2] - state[2]))
        return new, new

    return Machine(step, None, "cx_out double, cy_out double, scale_out double")


def middle(values) -> float:
    """The median of at least one value."""
    ordered = sorted(values)
    return (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2


def vor_gain(digits: int = 4) -> Machine:
    """Eye against head movement; inputs (us, eye, yaw, pitch in degrees, open).

    Steps of the head from 0.45 to 8 degrees give ratios, whose last 30 have the gain as median: 0 where the eye stands
    still in a large one. Smaller steps at 2 to 25 degrees a second feed a slow average. A far pitch holds the gain.
    """

    def step(state, row):
        us, eye, yaw, pitch, is_open = row
        gain, ratios, last = state if state else (1.0, (), None)
        dt = 0.0 if last is None else (us - last[0]) / SECOND
        if abs(pitch or 0.0) <= 12 and last is not None and dt > 1e-6 and is_open and None not in (eye, yaw, *last[1:]):
            moved, turned = eye - last[1], wrapped(yaw - last[2])
            if 0.45 < abs(turned) < 8:
                ratio = max(0.0, min(2.0, -moved / turned)) if abs(moved) > 0.20 else 0.0 if abs(moved) <= 0.15 and abs(turned) > 1.5 else None
                if ratio is not None:
                    ratios = (*ratios, ratio)[-30:]
                    gain = middle(ratios)
            elif 2 <= abs(turned) / dt <= 25 and -moved / turned > 0.05:
                gain = 0.85 * gain + 0.15 * min(2.0, -moved / turned)
        gain = max(0.0, min(2.0, gain))
        return (gain, ratios, (us, eye, yaw)), (round(gain, digits),)

    return Machine(step, None, "gain double")


def slope_of(points) -> float | None:
    """Least-squares slope over three points in time; None if they coincide."""
    mt, my = sum(p[0] for p in points) / 3, sum(p[1] for p in points) / 3
    spread = sum((p[0] - mt) ** 2 for p in points)
    return sum((p[0] - mt) * (p[1] - my) for p in points) / spread if spread > 1e-12 else None


@dataclass(frozen=True)
class Lid:
    """What a blink remembers from row to row."""

    t: float
    ear: float
    points: tuple
    phase: str = "open"
    base: float = 0.28
    warm: int = 0
    frames: int = 0
    glitch: int = 0
    follow: int = 0
    lowest: float = 0.20
    fell: float | None = None
    rose: float | None = None
    closing: float = 0.0
    opening: float = 0.0
    ended: float = 0.0


def blink_phase(threshold: float = 0.21, timeout: int = 8) -> Machine:
    """Four phases of a lid with closing and opening speeds latched at reopening; inputs (us, ear).

    Speeds are slopes over three rows where they agree with the last step, raised for slow frames. A phase that lasts too
    long ends by the threshold; one row that turns back is forgiven; a wide reopening counts at least its chord; two rows
    after it may still raise the speed; four seconds of open eyes relax a slow one.
    """
    most = lambda a, b: b if a is None else max(a, b)

    def reopened(lid: Lid, ear: float, t: float, dt: float, rose: float | None) -> Lid:
        opening = lid.opening
        if rose is not None:
            opening = rose * (1 + min(0.5, 10 * (dt - 0.033))) if 0.038 < dt <= 0.12 and 0 < rose < 1.65 else rose
        if dt >= 0.030 and ear >= 0.82 * lid.base:
            opening = max(opening, min(2.6, (ear - lid.lowest) / max(0.075, min(0.110, 1.6 * dt))))
        closing = lid.closing if lid.fell is None else lid.fell
        return replace(lid, phase="open", frames=0, glitch=0, follow=2, rose=rose, closing=closing, opening=opening, ended=max(lid.ended, t))

    def moved(lid: Lid, ear: float, t: float, dt: float, step_: float, d: float, speed: float) -> Lid:
        """The lid after its phase has seen the row."""
        wide = max(1.18 * threshold, min(0.26, 0.84 * lid.base))
        up = max(speed, abs(d) / dt * (1 + 12 * max(0.0, dt - 0.0167)))
        if lid.phase == "open":
            if lid.follow > 0:
                late = d / dt * (1 + 12 * max(0.0, min(dt, 0.08) - 0.0167)) if d > 0.010 and dt > 1e-4 else 0.0
                lid = replace(lid, follow=lid.follow - 1, opening=min(late, 6.0) if late > lid.opening else lid.opening)
            if 0 < lid.opening < 1.65 and ear >= max(0.24, 0.85 * lid.base) and lid.ended > 0 and t - lid.ended > 4 and dt < 0.25:
                lid = replace(lid, opening=min(1.65, lid.opening + 0.08 * dt))
            if min(d, step_) < -0.010 and ear < min(0.28, 0.95 * lid.base):
                lid = replace(lid, phase="closed" if ear < threshold else "closing", frames=0, glitch=0, follow=0, lowest=ear, fell=speed, rose=None)
            return lid
        if lid.phase == "opening":
            if ear >= wide:
                return reopened(lid, ear, t, dt, most(lid.rose, up) if up > 0.02 else lid.rose)
            if d < -0.010 and ear < threshold:
                return replace(lid, phase="closed", frames=0, glitch=0, follow=0)
            return replace(lid, rose=most(lid.rose, up)) if d > 0 and up > 0.02 else lid
        lid = replace(lid, lowest=min(lid.lowest, ear))
        if lid.phase == "closed":
            if not (d > 0.005 and ear > 0.75 * threshold):
                return lid
            if ear >= wide:
                return reopened(lid, ear, t, dt, up if up > 0.02 else lid.rose)
            return replace(lid, phase="opening", frames=0, glitch=0, rose=up if up > 0.02 else speed)
        fell = most(lid.fell, speed) if speed > 0.02 else lid.fell
        if ear < threshold:
            return replace(lid, phase="closed", frames=0, glitch=0, fell=fell)
        if d < 0:
            return replace(lid, glitch=0, fell=fell)
        if lid.glitch < 1 and d < 0.015:
            return replace(lid, glitch=lid.glitch + 1)
        return replace(lid, phase="open", frames=0, glitch=0, follow=0)

    def step(lid, row):
        us, ear = row
        if ear is None:
            return lid, (lid.phase, lid.closing, lid.opening) if lid else ("open", 0.0, 0.0)
        t = us / SECOND
        if lid is None:
            lid = Lid(t, ear, ((t, ear),))
        elif t - lid.t > 0.5:
            lid = replace(lid, t=t, ear=ear, points=((t, ear),), glitch=0)
        elif t - lid.t > 1e-6:
            dt, d = t - lid.t, ear - lid.ear
            if ear > 1.15 * threshold:
                a = 0.15 if lid.warm < 15 else 0.02
                lid = replace(lid, base=(1 - a) * lid.base + a * ear, warm=lid.warm + 1)
            lid = replace(lid, frames=lid.frames + 1 if lid.phase in ("closing", "opening") else 0)
            if lid.frames > timeout:
                closing, opening = (old if new is None else new for old, new in ((lid.closing, lid.fell), (lid.opening, lid.rose)))
                lid = replace(lid, closing=closing, opening=opening, phase="closed" if ear < threshold else "open", frames=0, glitch=0, follow=0)
            points = (*lid.points, (t, ear))[-3:]
            slope = slope_of(points) if len(points) == 3 else None
            fits = slope is not None and slope * d > 0
            speed = max(abs(slope), abs(d / dt)) if fits else abs(d / dt)
            if 0.040 <= dt <= 0.120:
                speed *= min(1.65, 1 + 12 * (dt - 0.033)) if ear >= 0.22 else min(1.65, 1 + 10 * (dt - 0.035))
            lid = replace(moved(lid, ear, t, dt, d, slope * dt if fits else d, speed), t=t, ear=ear, points=points)
        return lid, (lid.phase, lid.closing, lid.opening)

    return Machine(step, None, "phase string, closing double, opening double")


def locked_baseline(first: int, limit: float, alpha: float, within: float) -> Machine:
    """A baseline: the median of the first values under ``limit``, then a slow average of open rows close to it; inputs (x, open)."""

    def step(state, row):
        base, seen = state if state else (None, ())
        x, is_open = row
        if x is not None:
            if base is None:
                if x < limit:
                    seen = (*seen, x)
                if len(seen) >= first:
                    base, seen = middle(seen), ()
            elif is_open and abs(x - base) <= within * base:
                base = alpha * x + (1 - alpha) * base
        return (base, seen), (base, None if base is None or x is None else x / base - 1)

    return Machine(step, None, "baseline double, delta double")


def brow(threshold: float = 0.21) -> Machine:
    """A brow's height against its own baseline; inputs (ratio, ear): smoothed height, rise, and whether it is raised.

    The baseline is the median of the first fifteen heights and then follows open eyes with a rise under a tenth, fast in
    the first 25 rows and slowly after.
    """

    def step(state, row):
        smooth, base, seen, n = state if state else (None, None, (), 0)
        x, ear = row
        if x is None:
            return (smooth, base, seen, n), (smooth, 0.0, False)
        n, smooth = n + 1, x if smooth is None else 0.80 * smooth + 0.20 * x
        rise = lambda v: (v - base) / max(0.1, abs(base))
        if base is None:
            seen = (*seen, x)
            if len(seen) < 15:
                return (smooth, None, seen, n), (smooth, 0.0, False)
            base, seen = middle(seen), ()
        elif ear is not None and ear >= threshold and rise(x) < 0.10:
            a = 0.15 if n <= 25 else 0.005
            base = (1 - a) * base + a * x
        return (smooth, base, seen, n), (smooth, rise(smooth), rise(smooth) >= 0.12)

    return Machine(step, None, "smooth double, rise double, raised boolean")


def gated_ema(alpha: float, below: float) -> Machine:
    """A noise floor: an average that follows only values under ``below``; input (x)."""

    def step(state, row):
        x = row[0]
        if x is not None and x < below:
            state = x if state is None else alpha * x + (1 - alpha) * state
        return state, (state,)

    return Machine(step, None, "floor double")


def oscillation(alpha: float, limit: float) -> Machine:
    """How often small moves turn back: an average of sign flips between moves under ``limit``; input (x)."""

    def step(state, row):
        x = row[0]
        last, move, osc = state if state else (None, 0.0, 0.0)
        if x is None:
            return state, (osc,)
        d = 0.0 if last is None else x - last
        if abs(d) < limit:
            osc = alpha * (d * move < 0) + (1 - alpha) * osc
        return (x, d, osc), (osc,)

    return Machine(step, None, "oscillation double")


def crop_hysteresis(slack: float = 2.0) -> Machine:
    """Bounds stay as they were while no edge moved by more than ``slack``; inputs (x0, y0, x1, y1)."""

    def step(state, row):
        if any(v is None for v in row):
            return state, state or (None,) * 4
        if state is None or max(abs(a - b) for a, b in zip(row, state)) > slack:
            state = row
        return state, state

    return Machine(step, None, "x0_out double, y0_out double, x1_out double, y1_out double")


def rolling_model(rows: int, every: int, score: Callable[[list[tuple]], float], misses: int = 15) -> Machine:
    """A model over the last ``rows`` valid rows, asked at every ``every``-th once there are that many, its answer held; inputs (valid, …).

    More than ``misses`` invalid rows in a run clear the window.
    """

    def step(state, row):
        window, n, last, lost = state if state else ((), 0, None, 0)
        if not row[0]:
            lost += 1
            return ((), 0, None, lost) if lost > misses else (window, n, last, lost), (None if lost > misses else last,)
        window, n = (*window, row[1:])[-rows:], n + 1
        if len(window) == rows and n % every == 0:
            last = score(list(window))
        return (window, n, last, 0), (last,)

    return Machine(step, None, "probability double")


def group_normalised(df: DataFrame, s: Stream) -> DataFrame:
    """Time as microseconds since the subject's first row."""
    return df.withColumn(s.us, F.col(s.us) - F.min(s.us).over(s.whole()))
