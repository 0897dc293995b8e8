"""Filters, pulse, pixels and pose on signals with known answers."""

import math

import numpy as np

from kymora.functions import gates
from kymora.operators import pixels, pose, pulse


def response(b, a, f, rate):
    z = np.exp(-2j * np.pi * f / rate * np.arange(len(b)))
    return abs((b @ z) / (a @ z))


def test_bandpass_passes_the_band():
    b, a = pulse.butter_bandpass(4, 75, 4000, 16_000)
    for f, want in ((75, math.sqrt(0.5)), (4000, math.sqrt(0.5)), (700, 1.0)):
        assert math.isclose(response(b, a, f, 16_000), want, rel_tol=1e-4)
    assert response(b, a, 10, 16_000) < 0.01 and response(b, a, 7800, 16_000) < 0.01


def test_zero_phase_keeps_the_place():
    b, a = pulse.butter_bandpass(2, 100, 1000, 8000)
    t = np.arange(2000) / 8000
    x = np.sin(2 * np.pi * 400 * t) + 3
    y = pulse.zero_phase(b, a, x)
    assert np.abs(y[400:1600] - np.sin(2 * np.pi * 400 * t)[400:1600]).max() < 0.05
    assert pulse.zero_phase(b, a, x[:5]).tolist() == x[:5].tolist()


def test_pulse_is_found():
    t = np.arange(300) / 30
    ok, bpm, rmssd = pulse.pulse(t, 0.5 + 0.01 * np.sin(2 * np.pi * 1.2 * t) + 0.003 * t)
    assert ok and abs(bpm - 72) < 2.5 and 10 <= rmssd <= 135
    assert pulse.pulse(t[:50], t[:50]) == (False, None, None)
    assert pulse.pulse(t, np.zeros(300)) == (False, None, None)


def test_pixels():
    dark = np.full((48, 64, 3), 30, np.uint8)
    assert pixels.mean_luminance(pixels.lit(dark)) > 30 and pixels.is_monochrome(dark)
    red = dark.copy()
    red[:, :, 2] = 200
    assert not pixels.is_monochrome(red) and pixels.redness(red, (0, 0, 64, 48)) > 5 and pixels.redness(dark, (0, 0, 1, 1)) == 1.0
    rng = np.random.default_rng(0)
    a = rng.random((64, 64))
    assert pixels.shift(a, np.roll(a, (3, -5), axis=(0, 1))) == (-5.0, 3.0)
    half = np.zeros((40, 80, 3), np.uint8)
    half[:, :40], half[:, 40:] = 200, 60
    out = pixels.split_sunlight(half)
    assert out[:, 70:].mean() > 60 and (out[:, :5] == half[:, :5]).all()
    spot = np.full((20, 20, 1), 100, np.uint8)
    spot[:8, :] = 255
    assert pixels.has_glare(spot, (0, 0, 20, 20)) and not pixels.has_glare(dark, (0, 0, 20, 20))
    assert pixels.gamma_lut(1.0).tolist() == list(range(256))


def test_pose_is_recovered():
    truth = np.array([0.1, -0.3, 0.05, 20.0, -10.0, 650.0])
    got = pose.solve(pose.project(truth, 900, (640, 360)), 900, (640, 360))
    assert np.allclose(got, truth, atol=1e-3)
    again = pose.solve(pose.project(truth + 0.01, 900, (640, 360)), 900, (640, 360), got)
    assert np.allclose(again, truth + 0.01, atol=1e-3)
    assert pose.solve(np.zeros((6, 2)), 900, (640, 360)) is None
    assert pose.regularised_yaw(0, 1.0) == 15.0 and pose.regularised_yaw(5, 0.1) == 5


def test_rules_on_names_and_rates():
    assert gates.quadrant(1280, 720) == (256, 72, 1024, 612)
    assert gates.frame_counts(30) == {"microsleep": 15, "yawn": 30} and gates.frame_counts(5) == {"microsleep": 5, "yawn": 10}
    assert gates.kept_columns(["ear_mean", "mar_std", "gaze_x"], ("mar_std",), ("mar", "gaze")) == ["ear_mean", "mar_std"]
