"""Signal kernels on synthetic sounds."""

import io
import math
import wave

import numpy as np
import pytest
from tessella.functions import dsp
from tessella.sources import audio

RATE = 48000


def sine(seconds, amplitude=0.5, f=1000.0):
    return amplitude * np.sin(2 * np.pi * f * np.arange(int(seconds * RATE)) / RATE)


def bursts(places, seconds, seed=None):
    x = np.zeros(int(seconds * RATE))
    for k in places:
        n = RATE // 100
        x[k * RATE // 10 :][:n] = np.random.default_rng(k).normal(size=n) * 0.6
    return x


def test_levels_of_a_sine():
    x = sine(1.0)
    assert abs(dsp.peak_level(x) + 6.02) < 0.2
    assert -13 < dsp.loudness(x, RATE) < -6
    assert abs(dsp.loudness(sine(0.1), RATE) + 9.03) < 0.5  # shorter than a block: RMS
    assert dsp.loudness(sine(1, 0.8), RATE) - dsp.loudness(sine(1, 0.1), RATE) > 10


def test_loudness_of_the_standard_tone():
    # 997 Hz at full scale in one channel is -3.01 LUFS by the standard
    assert abs(dsp.loudness(sine(5, 1.0, 997.0), RATE) + 3.01) < 0.05
    assert abs(dsp.loudness(np.column_stack([sine(5, 1.0, 997.0)] * 2), RATE)) < 0.05
    assert dsp.loudness(np.zeros(RATE), RATE) == pytest.approx(-240, abs=1)


def test_frame_levels_keep_or_drop_the_tail():
    x = np.ones(2500)
    assert len(dsp.frame_levels(x, 1000, keep_tail=False)) == 2
    assert len(dsp.frame_levels(x, 1000, keep_tail=True)) == 3
    assert len(dsp.frame_levels(x[:10], 1000, keep_tail=False)) == 1


def test_crossfade():
    region = np.random.default_rng(0).normal(size=(2000, 2))
    out = dsp.crossfade_loop(region, 200)
    assert out.shape == (1800, 2)
    np.testing.assert_allclose(out[0], region[1800])
    np.testing.assert_allclose(out[-1], region[1799])
    ramp = np.linspace(0, 1, 500)[:, None]
    np.testing.assert_array_equal(dsp.crossfade_loop(ramp, 0), ramp)
    np.testing.assert_allclose(dsp.crossfade_loop(np.ones((100, 1)), 30, "linear"), 1.0)
    assert len(dsp.crossfade_loop(ramp, 9999)) == 250


def test_period_of_a_rhythm_and_of_noise():
    x = bursts(range(1, 18), 2.0)
    levels = dsp.moving_rms(x, 720, 96)
    cycle, strength = dsp.period(levels, 96, RATE)
    assert abs(cycle / RATE - 0.1) < 0.02 and strength > 0.45
    noise = np.random.default_rng(1).normal(size=2 * RATE) * 0.3
    cycle, strength = dsp.period(dsp.moving_rms(noise, 720, 96), 96, RATE)
    assert cycle is None or strength < 0.45


def test_loops():
    found = dsp.suggest_loop(bursts(range(1, 18), 2.0), RATE)
    assert found["periodic"] and 0 <= found["start_s"] < found["end_s"] <= 2 and abs(found["period_ms"] - 100) < 20
    x = bursts(range(1, 15), 4.0)
    free, forced = dsp.suggest_loop(x, RATE), dsp.suggest_loop(x, RATE, 2.5)
    length = lambda r: r["end_s"] - r["start_s"]
    assert length(forced) >= 2.5 > length(free) and not forced["short"]
    noise = np.random.default_rng(3).normal(size=RATE) * 0.3
    capped = dsp.suggest_loop(noise, RATE, 10)
    assert capped["short"] and capped["end_s"] <= 1 and capped["crossfade_ms"] <= length(capped) * 500 + 0.1


def test_zero_snap_and_growth():
    x = sine(0.1, f=100)
    at = dsp.zero_snap(x, 490, RATE)
    assert x[at - 1] <= 0 < x[at]
    assert dsp.stretched(x, (0, 100), RATE, 0.05)[1] >= 2400
    assert dsp.stretched(x, (4000, 4500), RATE, 1.0) == (0, len(x) - 1)


def test_mel_scales_and_windows():
    f = np.array([0.0, 440.0, 999.0, 1000.0, 5000.0])
    for scale in ("htk", "kaldi", "slaney"):
        np.testing.assert_allclose(dsp.mel_to_hz(dsp.hz_to_mel(f, scale), scale), f, atol=1e-6)
    assert float(dsp.hz_to_mel(1000.0, "slaney")) == pytest.approx(15.0)
    np.testing.assert_allclose(dsp.window(8, "hann", periodic=False), np.hanning(8), atol=1e-12)
    np.testing.assert_allclose(dsp.window(8, "hamming"), np.hamming(9)[:-1], atol=1e-12)
    np.testing.assert_array_equal(dsp.window(4, "boxcar"), 1)
    with pytest.raises(ValueError):
        dsp.window(4, "other")
    bank = dsp.mel_bank(513, 64, 50, 14000, 48000, "slaney")
    assert bank.shape == (513, 64) and (bank >= 0).all() and bank.sum(axis=0).min() > 0
    assert dsp.bin_triangles(22050, 1024, 40).shape == (40, 513)
    np.testing.assert_allclose(dsp.power_to_db(np.array([1.0, 0.0]), span=80), [0, -80])


def test_resampling_and_fingerprint():
    x = sine(0.5, f=440)
    y = dsp.resampled(x, RATE, 22050)
    expected = 0.5 * np.sin(2 * np.pi * 440 * np.arange(len(y)) / 22050)
    assert len(y) == math.ceil(len(x) * 22050 / RATE)
    np.testing.assert_allclose(y[200:-200], expected[200:-200], atol=5e-3)
    v = dsp.fingerprint(x, RATE)
    assert v.shape == (48,) and np.isfinite(v).all()
    assert np.linalg.norm(v - dsp.fingerprint(x * 0.99, RATE)) < np.linalg.norm(v - dsp.fingerprint(np.random.default_rng(0).normal(size=RATE), RATE))
    assert dsp.fingerprint(np.zeros(10), RATE).shape == (48,)
    from tessella.sources.stores import MEL_DEFAULTS

    assert dsp.model_mel(sine(1.0), RATE, MEL_DEFAULTS).shape == (1, 1, 1001, 64)


def test_pieces_and_preview():
    x = np.arange(100.0)[:, None]
    assert [len(p) for p in dsp.pieces(x, 10, [(0, 1), (5, 5), (8, 99)])] == [10, 20]
    assert len(dsp.preview(dsp.pieces(x, 10, [(0, 1), (8, 99)]), 10)) == 40
    assert dsp.to_integers(np.array([2.0, -2.0, 0.5]), 16).tolist() == [32767, -32768, 16384]
    assert dsp.normal_peak(np.array([2.0, 1.0])).tolist() == [1.0, 0.5]
    y = np.linspace(-1.5, 1.5, 100)[:, None]
    loop = dsp.preview_clip(y, 10, [(2, 8)], 1000, 8)
    np.testing.assert_array_equal(loop, np.clip(np.rint(dsp.crossfade_loop(y[20:80], 10) * 127), -128, 127))
    assert len(dsp.preview_clip(y, 10, [(0, 1), (2, 2), (8, 9)], 1000)) == 30 and len(dsp.preview_clip(y, 10, [(2, 8)])) == 60


@pytest.mark.parametrize("bits", [16, 24])
def test_wav_round_trip(bits):
    x = np.column_stack([sine(0.2), -sine(0.2, 0.3)])
    content = audio.wav_bytes(x, RATE, bits)
    with wave.open(io.BytesIO(content)) as f:
        assert (f.getnchannels(), f.getframerate(), f.getsampwidth(), f.getnframes()) == (2, RATE, bits // 8, len(x))
    head = audio.wav_header(io.BytesIO(content))
    assert (head["duration"], head["sample_rate"], head["bit_depth"], head["channels"]) == (0.2, RATE, bits, 2)
    y, rate = audio.read_wav(io.BytesIO(content))
    np.testing.assert_allclose(y, x, atol=2.0 ** (1 - bits))
    blocks = [b for b, _ in audio.read_blocks(io.BytesIO(content), 1000)]
    np.testing.assert_array_equal(np.concatenate(blocks), y)


def test_broadcast_description_and_broken_files():
    content = audio.wav_bytes(sine(0.1), RATE)
    text = b"Rain\x01on a roof\0rubbish".ljust(602, b"\0") + b"x"
    chunk = b"bext" + len(text).to_bytes(4, "little") + text + b"\0"
    assert audio.wav_header(io.BytesIO(content[:12] + chunk + content[12:]))["description"] == "Rain on a roof"
    assert audio.wav_header(io.BytesIO(content[:12] + chunk + content[12:]))["duration"] == 0.1
    for broken in (b"", b"RIFF", content[:20], b"x" * 100):
        assert audio.wav_header(io.BytesIO(broken))["duration"] is None


def test_cycle_filters():
    x = np.array([0, 1, 0, 2, 2, 0, 0.5, 0])
    assert dsp.peaks(x).tolist() == [1, 3, 6]
    assert dsp.peaks(x, height=0.8).tolist() == [1, 3]
    assert dsp.peaks(x, distance=3).tolist() == [3, 6]
    assert dsp.peaks(x, prominence=0.8).tolist() == [1, 3]
