"""Resampling, spherical interpolation and causal convolution in NumPy."""

from __future__ import annotations

import math

import numpy as np


def lowpass(up: int, down: int) -> np.ndarray:
    """Kaiser-windowed sinc of a polyphase resampler, gain ``up``."""
    most = max(up, down)
    half = 10 * most
    k = np.arange(-half, half + 1)
    h = np.sinc(k / most) / most * np.kaiser(2 * half + 1, 5.0)
    return h / h.sum() * up


def resample(x: np.ndarray, source: float, target: float, line: bool = True) -> np.ndarray:
    """Polyphase resampling along axis 0, rates rounded half to even.

    With ``line`` a straight line through the two ends is taken out first and put back, so
    that the ends do not bend to zero; else the signal is zero beyond its ends.
    """
    if source <= 0 or target <= 0:
        raise ValueError("a rate must be positive")
    if abs(source - target) < 1e-6 or len(x) < 2:
        return x.astype(np.float64)
    up, down = max(1, int(round(target))), max(1, int(round(source)))
    g = math.gcd(up, down)
    up, down = up // g, down // g
    n, y = len(x), x.reshape(len(x), -1).astype(np.float64)
    m = -(-n * up // down)
    slope = (y[-1] - y[0]) / (n - 1) if line else np.zeros(y.shape[1])
    base = y[0] if line else np.zeros(y.shape[1])
    flat = y - base - np.arange(n)[:, None] * slope
    h = lowpass(up, down)
    half = len(h) // 2
    reach = half // up + 1
    # tap q of output k falls on input i where k * down - i * up = q - half
    centre = np.arange(m) * down
    near = centre // up
    out = np.zeros((m, y.shape[1]))
    for s in range(-reach, reach + 2):
        i = near + s
        q = centre - i * up + half
        ok = (i >= 0) & (i < n) & (q >= 0) & (q < len(h))
        out[ok] += h[q[ok], None] * flat[i[ok]]
    out += base + (np.arange(m) * down / up)[:, None] * slope
    return out.reshape(m, *x.shape[1:])


def quaternions(v: np.ndarray) -> np.ndarray:
    """Rotation vectors [..., 3] to quaternions (w, x, y, z)."""
    angle = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.concatenate([np.cos(angle / 2), v * (0.5 * np.sinc(angle / (2 * np.pi)))], axis=-1)


def rotation_vectors(q: np.ndarray) -> np.ndarray:
    q = np.where(q[..., :1] < 0, -q, q)
    s = np.linalg.norm(q[..., 1:], axis=-1, keepdims=True)
    angle = 2 * np.arctan2(s, q[..., :1])
    return q[..., 1:] * np.where(s < 1e-12, 2.0, angle / np.maximum(s, 1e-12))


def slerp(v: np.ndarray, source: float, target: float, frames: int) -> np.ndarray:
    """Rotation vectors [T, ..., 3] at ``frames`` target times, clamped to the last source time."""
    at = np.minimum(np.arange(frames) / target * source, len(v) - 1)
    low = np.minimum(np.floor(at).astype(int), len(v) - 1)
    high = np.minimum(low + 1, len(v) - 1)
    w = (at - low).reshape(-1, *([1] * (v.ndim - 1)))
    q = quaternions(v.astype(np.float64))
    a, b = q[low], q[high]
    cos = (a * b).sum(axis=-1, keepdims=True)
    b, cos = np.where(cos < 0, -b, b), np.abs(cos)
    angle = np.arccos(np.clip(cos, -1, 1))
    flat = angle < 1e-6
    s = np.where(flat, 1.0, np.sin(angle))
    out = np.where(flat, (1 - w) * a + w * b, (np.sin((1 - w) * angle) * a + np.sin(w * angle) * b) / s)
    return rotation_vectors(out / np.linalg.norm(out, axis=-1, keepdims=True))


def convolve(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray, stride: int = 1, dilation: int = 1, causal: bool = True) -> np.ndarray:
    """1-D convolution of [T, in] by [out, in, k]; causal pads on the left alone."""
    k = kernel.shape[2]
    pad = (k - 1) * dilation - (stride - 1) if causal else (k - 1) * dilation
    left = max(0, pad) if causal else pad // 2
    x = np.pad(x, ((left, 0 if causal else pad - left), (0, 0)))
    n = (len(x) - (k - 1) * dilation - 1) // stride + 1
    out = np.tile(bias.astype(np.float64), (max(n, 0), 1))
    for t in range(k):
        out += x[t * dilation : t * dilation + (n - 1) * stride + 1 : stride] @ kernel[:, :, t].T
    return out


def strides_of(total: int) -> list[int]:
    """Factors of a stride: twos, and what is left."""
    out = []
    while total > 2 and total % 2 == 0:
        out.append(2)
        total //= 2
    return [*out, total]
