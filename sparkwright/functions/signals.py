"""Signal kernels on NumPy arrays, one recording (leads x samples) at a time; operators.kernels applies them to tables."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Share of power in 48-200 Hz above which a lead counts as noisy; order of the twelve leads.
MAX_NOISE = 0.005
LEADS = ["I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"]


def zero_phase(x: np.ndarray, fs: float, low: float | None = None, high: float | None = None, order: int = 2) -> np.ndarray:
    """Forward and backward Butterworth filter: its squared gain applied in the frequency domain to an odd extension."""
    n = x.shape[-1]
    pad = min(n - 1, int(3 * fs))
    ext = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1) if pad > 0 else x
    f = np.fft.rfftfreq(ext.shape[-1], 1 / fs)
    gain = np.ones_like(f)
    if high is not None:
        gain = gain / (1 + (f / high) ** (2 * order))
    if low is not None:
        ratio = np.divide(low, f, out=np.full_like(f, np.inf), where=f > 0)
        gain = gain / (1 + ratio ** (2 * order))
    return np.fft.irfft(np.fft.rfft(ext) * gain, ext.shape[-1])[..., pad : pad + n]


def noisy(x: np.ndarray, fs: float) -> np.ndarray:
    """Whether each lead has too much power between 48 and 200 Hz."""
    hf = zero_phase(x, fs, 48.0, min(200.0, fs / 2 - 1), 4)
    return (hf**2).mean(axis=-1) / ((x**2).mean(axis=-1) + 1e-12) > MAX_NOISE


def running_median(x: np.ndarray, size: int) -> np.ndarray:
    """Median over `size` (odd) samples, with zeros beyond both ends."""
    half = size // 2
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(half, half)])
    # a list in order that follows the window, over all leads in a row; windows that cross two leads are left out
    found = pd.Series(padded.ravel()).rolling(size).median().to_numpy().reshape(padded.shape)
    return found[..., size - 1 :]


def preprocess(x: np.ndarray, fs: float = 500.0, window_ms: float = 600.0) -> tuple[np.ndarray, bool]:
    """High-pass at 0.1 Hz, low-pass at 200 Hz (35 Hz if any lead is noisy), less the running median."""
    y = zero_phase(np.asarray(x, float), fs, low=0.1, order=4)
    clean = not noisy(y, fs).any()
    y = zero_phase(y, fs, high=200.0 if clean else 35.0, order=2)
    return y - running_median(y, int(round(window_ms * fs / 1000)) | 1), clean


def energy(x: np.ndarray) -> np.ndarray:
    return np.sqrt((np.atleast_2d(x) ** 2).sum(axis=0))


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Indices above both neighbours; a flat top counts once, in its middle."""
    step = np.flatnonzero(np.diff(x)) if len(x) > 1 else np.empty(0, int)
    if len(step) < 2:
        return np.empty(0, int)
    rises = np.diff(x)[step] > 0
    tops = np.flatnonzero(rises[:-1] & ~rises[1:])
    return (step[tops] + 1 + step[tops + 1]) // 2


def spaced_from_right(peaks: np.ndarray, least: float) -> np.ndarray:
    """Peaks, kept from the last one backwards, at least so far apart."""
    kept: list[int] = []
    for p in sorted(peaks.tolist(), reverse=True):
        if not kept or kept[-1] - p >= least:
            kept.append(p)
    return np.array(kept[::-1], int)


def r_peaks(envelope: np.ndarray, fs: float, steepness: float = 0.66, spacing_ms: float = 200.0, pacing_ms: float = 11.0) -> np.ndarray:
    """Peaks above 0.3 of the 90th percentile, without narrow spikes and shallow ones, 200 ms apart, three at least."""
    env = zero_phase(envelope, fs, high=min(200.0, fs / 2 - 1))
    raw = local_maxima(env)
    raw = raw[env[raw] >= 0.3 * np.percentile(env, 90)]
    if not len(raw):
        return raw
    slope, reach = np.gradient(env) * fs, int(0.05 * fs)
    steep, wide = np.zeros(len(raw)), np.full(len(raw), np.inf)
    for i, p in enumerate(raw):
        up, down = slope[max(0, p - reach) : p], slope[p : p + reach]
        if len(up) and len(down) and up.max() > 0 > down.min():
            steep[i] = np.sqrt(-up.max() * down.min())
            wide[i] = (p + down.argmin() - max(0, p - reach) - up.argmax()) / fs * 1000
    kept = raw[wide > pacing_ms]
    if not len(kept):
        return kept
    strength = steep[wide > pacing_ms]
    found = spaced_from_right(kept[strength >= (1 - steepness) * strength.max()], spacing_ms * fs / 1000)
    return found if len(found) >= 3 else np.sort(raw[np.argsort(env[raw])[-3:]])


def segments(peaks: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, peak, end) of each inner peak, bounded by the middles to its neighbours."""
    return [((a + b) // 2, b, (b + c) // 2) for a, b, c in zip(peaks, peaks[1:], peaks[2:], strict=False)]


def aligned(beats: list[np.ndarray], centers: list[int]) -> np.ndarray:
    """Beats on one grid with their centers together, missing samples as nan, shifted to correlate best with the median."""
    left = max(centers)
    right = max(b.shape[-1] - c for b, c in zip(beats, centers, strict=True))
    grid = np.full((len(beats), left + right), np.nan)
    for row, b, c in zip(grid, beats, centers, strict=True):
        row[left - c : left - c + len(b)] = b
    middle = np.nan_to_num(np.nanmedian(grid, axis=0))
    near = np.lib.stride_tricks.sliding_window_view(np.pad(middle, 5), len(middle))  # the median, moved -5 to 5 places
    best = (near @ np.nan_to_num(grid).T).argmax(axis=0) - 5
    for i, by in enumerate(best.tolist()):
        grid[i] = shifted(grid[i], by)
    return grid


def shifted(row: np.ndarray, by: int) -> np.ndarray:
    """A row moved to the right (left if negative); what comes in from outside is missing."""
    out = np.full_like(row, np.nan)
    out[max(0, by) : len(row) + min(0, by)] = row[max(0, -by) : len(row) - max(0, by)]
    return out


def average_beat(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """The mean of the inner beats on a common grid."""
    parts = segments(peaks)
    if not parts:
        return np.empty(0)
    return np.nanmean(aligned([x[a:c] for a, _, c in parts], [b - a for a, b, _ in parts]), axis=0)


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shape-preserving piecewise cubic through (x, y), constant beyond the ends."""
    if len(x) < 3:
        return np.interp(at, x, y)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = np.where(d[:-1] * d[1:] > 0, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)
    m = np.concatenate([[d[0]], inner, [d[-1]]])
    at = np.clip(at, x[0], x[-1])
    k = np.clip(np.searchsorted(x, at) - 1, 0, len(h) - 1)
    t = (at - x[k]) / h[k]
    return y[k] * (1 + 2 * t) * (1 - t) ** 2 + m[k] * h[k] * t * (1 - t) ** 2 + y[k + 1] * t**2 * (3 - 2 * t) + m[k + 1] * h[k] * t**2 * (t - 1)


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges of equal bins over the range of each row, as np.histogram takes them."""
    lo, hi = x.min(axis=1), x.max(axis=1)
    lo, hi = np.where(lo == hi, lo - 0.5, lo), np.where(lo == hi, hi + 0.5, hi)
    return np.linspace(lo, hi, bins + 1, axis=1)


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many numbers of each row are in each of its equal bins, the last one closed, as np.histogram counts them."""
    n, rows = edges.shape[1] - 1, np.arange(len(x))[:, None]
    at = ((x - edges[:, :1]) / (edges[:, -1:] - edges[:, :1]) * n).astype(int)
    at[at == n] -= 1
    at[x < edges[rows, at]] -= 1
    at[(x >= edges[rows, at + 1]) & (at != n - 1)] += 1
    return np.bincount((rows * n + at).ravel(), minlength=len(x) * n).reshape(len(x), n)


def anchored_baseline(x: np.ndarray, anchors: np.ndarray, half: int, bins: int = 32) -> np.ndarray:
    """A smooth baseline through the modal value of the samples around each anchor."""
    values = np.empty(len(anchors))
    begin, end = np.maximum(0, np.asarray(anchors) - half), np.minimum(len(x), np.asarray(anchors) + half + 1)
    for size in np.unique(end - begin).tolist():  # windows of one length together; those at the ends may be shorter
        own = np.flatnonzero(end - begin == size)
        near = x[begin[own, None] + np.arange(size)]
        edges = bin_edges(near, bins)
        top = binned(near, edges).argmax(axis=1)
        values[own] = (edges[np.arange(len(own)), top] + edges[np.arange(len(own)), top + 1]) / 2
    return pchip(np.asarray(anchors, float), values, np.arange(len(x), dtype=float))


def savgol(x: np.ndarray, window: int = 5, degree: int = 2) -> np.ndarray:
    """Savitzky-Golay smoothing along the last axis; the ends follow the polynomial of the outermost window."""
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), degree + 1, increasing=True)
    fit = basis @ np.linalg.pinv(basis)
    view = np.lib.stride_tricks.sliding_window_view(x, window, axis=-1)
    return np.concatenate([view[..., 0, :] @ fit[:half].T, view @ fit[half], view[..., -1, :] @ fit[half + 1 :].T], axis=-1)


def extrema(x: np.ndarray, share: float = 0.1) -> list[tuple[float, float, int]]:
    """(place, value, sign) of turning points refined by a parabola, whose prominence against the nearest opposite ones is
    at least `share` of the range; most prominent first, ties by place."""
    slope = np.gradient(x) if len(x) > 2 else np.zeros(len(x))
    turns = np.flatnonzero(np.sign(slope[1:]) * np.sign(slope[:-1]) < 0)
    points = []
    for i in turns:
        k = int(np.clip(i if abs(slope[i]) < abs(slope[i + 1]) else i + 1, 1, len(x) - 2))
        a, b, c = x[k - 1 : k + 2]
        bend = a - 2 * b + c
        off = 0.0 if bend == 0 else float(np.clip(0.5 * (a - c) / bend, -1, 1))
        points.append((k + off, b - 0.25 * (a - c) * off, 1 if slope[i] > 0 else -1))
    span, out = float(np.ptp(x)) if len(x) else 0.0, []
    for j, (place, value, sign) in enumerate(points):
        sides = [p for p in (points[j - 1] if j else None, points[j + 1] if j + 1 < len(points) else None) if p and p[2] != sign]
        depth = min([abs(value - s[1]) for s in sides] or [span])
        if depth >= share * span > 0:
            out.append((-depth, place, value, sign))
    return [(p, v, s) for _, p, v, s in sorted(out)]


def base_scalars(x: np.ndarray, fs: float) -> dict[str, float]:
    """Eleven measures of a window after a line through the means of its ends is taken off."""
    edge = max(1, len(x) // 10)
    y = x - np.linspace(x[:edge].mean(), x[-edge:].mean(), len(x))
    t = np.arange(len(y)) * 1000 / fs
    w = np.abs(y)
    total = w.sum() + 1e-12
    center = (w * t).sum() / total
    top, low = int(y.argmax()), int(y.argmin())
    peak = top if abs(y[top]) >= abs(y[low]) else low
    above = np.flatnonzero(w >= w[peak] / 2)
    noise = np.std(y - savgol(y)) if len(y) >= 5 else 0.0
    return {
        "pos_peak": y[top], "neg_peak": y[low], "pos_time": t[top], "neg_time": t[low], "p2p": y[top] - y[low], "centroid": center,
        "width4s": 4 * np.sqrt((w * (t - center) ** 2).sum() / total), "fwhm": (above[-1] - above[0]) * 1000 / fs, "max_slope": np.abs(np.gradient(y)).max() * fs if len(y) > 1 else 0.0,
        "rms": np.sqrt((y**2).mean()), "snr_db": 10 * np.log10(((y**2).mean() + 1e-12) / (noise**2 + 1e-12)),
    }


def morphology(x: np.ndarray) -> dict[str, float]:
    """Descriptors from the extrema: biphasic ratio, notch depth, number of turns, saddle, polarity, asymmetry, area balance."""
    points = extrema(x)
    highs, lows = [v for _, v, s in points if s > 0], [v for _, v, s in points if s < 0]
    big = max(map(abs, highs + lows), default=0.0)
    both = min(max(highs, default=0.0), -min(lows, default=0.0))
    first_two = sorted(highs, reverse=True)[:2]
    area = x.sum(), np.abs(x).sum() + 1e-12
    k = int(np.abs(x).argmax()) if len(x) else 0
    return {
        "biphasic": max(0.0, both) / (big + 1e-12), "notch": (first_two[1] - max([v for v in lows if v < first_two[1]], default=first_two[1])) if len(first_two) == 2 else 0.0,
        "turns": float(len(points)), "saddle": float(len(highs) >= 2 and len(lows) >= 1), "polarity": float(np.sign(x[k])) if len(x) else 0.0,
        "asymmetry": (2 * k - len(x) + 1) / max(1, len(x)), "balance": area[0] / area[1],
    }


def plane_projection(leads: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude and angle (degrees) of a 2 x n projection of n leads."""
    u, v = matrix @ leads
    return np.hypot(u, v), np.degrees(np.arctan2(v, u))


#: Projections of the limb and of the chest leads to a plane.
LIMB_PLANE = np.array([[1.0, 0.5, -0.5, -1.0, 1.0, 0.0], [0.0, 0.866, 0.866, 0.0, -0.866, -0.866]])
CHEST_PLANE = np.array([[-0.173648, 0.173648, 0.5, 0.866025, 1.0, 0.866025], [-0.984808, -0.984808, -0.866025, -0.5, 0.0, 0.5]])


def plane_angles(x: np.ndarray, peaks: np.ndarray) -> list[tuple[str, str, float]]:
    """Angle at the largest magnitude, mean direction and its dispersion (median of absolute differences, weighted by
    magnitude) in the two planes of twelve leads, over the samples next to the peaks, 20 each way; none without peaks."""
    out = []
    if len(x) < 12 or not len(peaks):
        return out
    near = np.unique(np.clip(peaks[:, None] + np.arange(-20, 21), 0, x.shape[1] - 1))
    gain = np.linalg.norm(LIMB_PLANE, axis=0).mean()
    for plane, matrix, leads in (("XY", LIMB_PLANE, x[:6]), ("XZ", CHEST_PLANE, x[6:12])):
        magnitude, degrees = plane_projection(leads[:, near], matrix / gain)
        weight = magnitude / max(magnitude.sum(), 1e-12)
        mean = np.degrees(np.arctan2((weight * np.sin(np.radians(degrees))).sum(), (weight * np.cos(np.radians(degrees))).sum()))
        off = np.abs((degrees - mean + 180) % 360 - 180)
        order = np.argsort(off)
        spread = off[order][min(len(off) - 1, int(np.searchsorted(np.cumsum(weight[order]), 0.5)))]
        out += [(plane, "peak_angle", float(degrees[magnitude.argmax()])), (plane, "mean_angle", float(mean)), (plane, "angle_dispersion", float(spread))]
    return out


def analytic_envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal of the detrended values."""
    t = np.arange(len(x))
    y = x - np.polyval(np.polyfit(t, x, 1), t)
    f = np.fft.fft(y)
    h = np.zeros(len(y))
    h[0] = 1
    h[1 : (len(y) + 1) // 2] = 2
    if len(y) % 2 == 0:
        h[len(y) // 2] = 1
    return np.abs(np.fft.ifft(f * h))


def modulation(x: np.ndarray) -> dict[str, float]:
    """Depth of the envelope's variation and the lag of its largest autocorrelation."""
    if len(x) < 8:
        return {"depth": 0.0, "period": 0.0}
    env = analytic_envelope(np.asarray(x, float))
    c = env - env.mean()
    acf = np.correlate(c, c, "full")[len(c) - 1 :] / (np.dot(c, c) + 1e-12)
    lags = np.arange(2, len(x) // 2)
    return {"depth": float((env.max() - env.min()) / (env.max() + env.min() + 1e-12)), "period": float(lags[acf[2 : len(x) // 2].argmax()])}


def lomb_scargle(t: np.ndarray, y: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Periodogram of unevenly spaced values (mean taken off)."""
    y = y - y.mean()
    wt = omega[:, None] * t[None]
    tau = np.arctan2(np.sin(2 * wt).sum(axis=1), np.cos(2 * wt).sum(axis=1)) / 2
    c, s = np.cos(wt - tau[:, None]), np.sin(wt - tau[:, None])
    return 0.5 * ((c @ y) ** 2 / ((c**2).sum(axis=1) + 1e-12) + (s @ y) ** 2 / ((s**2).sum(axis=1) + 1e-12))


def band_rhythm(angles: np.ndarray, rr_ms: np.ndarray) -> dict[str, float | None]:
    """Power, dominant period and score of 0.04-0.15 Hz in beat angles, with penalties for few beats and few cycles."""
    none: dict[str, float | None] = {"power": 0.0, "period": None, "score": 0.0}
    t = np.cumsum(rr_ms) / 1000
    n = min(len(t), len(angles))
    if n < 6 or t[-1] - t[0] < 6:
        return none
    length, t = t[-1] - t[0], t[:n] - t[0]
    f = np.linspace(0.02, 0.25, 200)
    band = (f >= 0.04) & (f <= 0.15)
    p = lomb_scargle(t, np.radians(angles[:n]), 2 * np.pi * f)[band]
    period = float(1 / f[band][p.argmax()])
    cycles = float(np.clip((length / period - 1) / 2, 0, 1))
    score = p.max() / (p.mean() + 1e-9) * min(1.0, n / 30) * cycles
    return {"power": round(float(np.trapezoid(p, f[band])), 5), "period": round(period, 2) if cycles >= 0.25 else None, "score": round(float(score), 2)}


def dbscan(points: np.ndarray, eps: float, least: int = 3) -> np.ndarray:
    """Density clusters in order of discovery; -1 is noise."""
    near = ((points[:, None] - points[None]) ** 2).sum(axis=2) <= eps * eps
    core, label, now = near.sum(axis=1) >= least, np.full(len(points), -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = now
                if core[j]:
                    todo += np.flatnonzero(near[j] & (label < 0)).tolist()
        now += 1
    return label


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Labels (clusters in order of first appearance) and the within-cluster sum of squares."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
        new = d.argmin(axis=1)
        if (new == label).all() and _:
            break
        label = new
        centers = np.stack([x[label == j].mean(axis=0) if (label == j).any() else centers[j] for j in range(k)])
    order = {v: i for i, v in enumerate(dict.fromkeys(label.tolist()))}
    return np.array([order[v] for v in label.tolist()]), float(((x - centers[label]) ** 2).sum())


def beat_clusters(x: np.ndarray, most: int = 3, elbow: float = 0.25, seed: int = 0) -> np.ndarray:
    """z-scored k-means with the largest k up to `most` that still cuts the spread by the elbow share."""
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) < 1e-9, 1, x.std(axis=0))
    best, spread = np.zeros(len(z), int), float((z**2).sum())
    for k in range(2, min(most, len(z)) + 1):
        label, inner = kmeans(z, k, seed)
        if spread <= 0 or (spread - inner) / spread < elbow:
            break
        best, spread = label, inner
    return best


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    if len(np.unique(label)) < 2:
        return 0.0
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    s = []
    for i, own in enumerate(label):
        same = (label == own) & (np.arange(len(label)) != i)
        if not same.any():
            s.append(0.0)
            continue
        a, b = d[i, same].mean(), min(d[i, label == o].mean() for o in np.unique(label) if o != own)
        s.append((b - a) / max(a, b, 1e-12))
    return float(np.mean(s))


def best_clusters(x: np.ndarray, most: int = 3, seed: int = 7) -> np.ndarray:
    """Labels of the number of clusters, 2 to `most`, with the best silhouette; one cluster with fewer than three rows."""
    best, score = np.zeros(len(x), int), -1.0
    for k in range(2, min(most, len(x) - 1) + 1) if len(x) >= 3 else ():
        label = kmeans(x, k, seed)[0]
        if 2 <= len(np.unique(label)) < len(x) and (now := silhouette(x, label)) > score:
            best, score = label, now
    return best


def interval_mixture(rr: np.ndarray, most: int = 3, rounds: int = 200) -> dict[str, float]:
    """Gaussian components of intervals by EM, their number by BIC; one if the smallest share is under .2, the means are
    closer than 60 ms, or the silhouette is under .12."""
    best: tuple[float, int, np.ndarray, np.ndarray] | None = None
    for k in range(1, most + 1):
        m, v, w = np.quantile(rr, (np.arange(k) + 0.5) / k), np.full(k, rr.var() + 1e-6), np.full(k, 1 / k)
        for _ in range(rounds):
            p = w * np.exp(-0.5 * (rr[:, None] - m) ** 2 / v) / np.sqrt(2 * np.pi * v) + 1e-300
            r = p / p.sum(axis=1, keepdims=True)
            n = r.sum(axis=0) + 1e-12
            w, m = n / len(rr), (r * rr[:, None]).sum(axis=0) / n
            v = (r * (rr[:, None] - m) ** 2).sum(axis=0) / n + 1e-6
        bic = (3 * k - 1) * np.log(len(rr)) - 2 * np.log(p.sum(axis=1)).sum()
        if best is None or bic < best[0]:
            best = (bic, k, r.argmax(axis=1), np.sort(m))
    _, k, label, means = best
    share = np.bincount(label, minlength=k).min() / len(rr)
    if k > 1 and (share < 0.2 or np.diff(means).min() < 60 or silhouette(rr[:, None], label) < 0.12):
        k, means = 1, np.array([rr.mean()])
    return {"k": float(k), "low": float(means[0]), "high": float(means[-1])}


def line_groups(x: np.ndarray, k: int) -> np.ndarray:
    """Labels, in order of value, of the k groups of numbers with the least sum of squares; on a line groups are intervals, so
    all cuts of the sorted numbers can be tried."""
    order = np.argsort(x, kind="stable")
    v = x[order]
    one, two = np.append(0, np.cumsum(v)), np.append(0, np.cumsum(v * v))
    n = len(v)
    cost = lambda a, b: two[b] - two[a] - (one[b] - one[a]) ** 2 / (b - a)
    cuts = np.arange(1, n)
    if k == 2:
        best = [int(cuts[np.argmin(cost(0, cuts) + cost(cuts, n))])]
    else:
        best, least = [1, 2], np.inf
        for first in range(1, n - 1):
            later = np.arange(first + 1, n)
            total = cost(0, first) + cost(first, later) + cost(later, n)
            if total.min() < least:
                best, least = [first, int(later[total.argmin()])], total.min()
    label = np.empty(n, int)
    label[order] = np.searchsorted(best, np.arange(n), side="right")
    return label


def interval_modes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels, centers and separation (smallest gap of centers over the largest deviation within) of two or three groups,
    whichever are further apart; one group with fewer than six numbers or without any gap."""
    label, centers, apart = np.zeros(len(x), int), np.array([x.mean()]), 0.0
    for k in (2, 3) if len(x) >= 6 else ():
        found = line_groups(x, k)
        groups = [x[found == j] for j in range(k)]
        middle = np.array([g.mean() for g in groups])
        widest = max(g.std() if len(g) > 1 else 1e-6 for g in groups)
        now = float(np.diff(middle).min() / (widest + 1e-9))
        if now > apart:
            label, centers, apart = found, middle, now
    return label, centers, apart


def center_ratio(centers: np.ndarray, tolerance: float = 0.15) -> str | None:
    """FLT2 for two centers that stand as 2:1, FLT3 for three whose ends stand as 3:1."""
    k = len(centers)
    return f"FLT{k}" if k in (2, 3) and abs(centers.max() / centers.min() - k) <= tolerance * k else None


def label_cycle(label: np.ndarray) -> str | None:
    """BIGEM for two labels of which over 80 % of neighbours differ, TRIGEM for three that begin 0, 1, 2, 0, 1, 2."""
    kinds = len(np.unique(label))
    if len(label) < 6:
        return None
    if kinds == 2 and np.mean(label[1:] != label[:-1]) > 0.8:
        return "BIGEM"
    return "TRIGEM" if kinds == 3 and label[:6].tolist() == [0, 1, 2, 0, 1, 2] else None


def periodic_indices(at: np.ndarray) -> str:
    """every_nth if the places are equally far apart, grouped if any are neighbours, else random."""
    gap = np.diff(np.sort(at))
    return "none" if not len(gap) else "every_nth" if len(np.unique(gap)) == 1 else "grouped" if (gap == 1).any() else "random"


def band_quality(x: np.ndarray, fs: float) -> dict[str, float]:
    """Shares of power below 0.33, in 2-20 and in 35-70 Hz, share of clipped and of flat samples."""
    f, p = np.fft.rfftfreq(len(x), 1 / fs), np.abs(np.fft.rfft(x - x.mean())) ** 2
    total = p.sum() + 1e-12
    share = lambda a, b: float(p[(f >= a) & (f < b)].sum() / total)
    lo, hi = x.min(), x.max()
    edge = (x <= lo + 0.005 * (hi - lo)) | (x >= hi - 0.005 * (hi - lo))
    cut = np.flatnonzero(np.diff(np.concatenate([[0], edge.astype(int), [0]])))
    runs = [b - a for a, b in zip(cut[::2], cut[1::2], strict=True) if b - a >= 3]
    win = max(2, int(0.2 * fs))
    pieces = np.lib.stride_tricks.sliding_window_view(x, min(win, len(x)))[:: win // 2]
    flat = pieces.max(axis=1) - pieces.min(axis=1) < 1e-3 * (hi - lo + 1e-12)
    return {"drift": share(0, 0.33), "signal": share(2, 20), "muscle": share(35, 70), "clipped": sum(runs) / len(x), "flat": float(np.mean(flat))}


def aicc(rss: float, n: int, k: int) -> float:
    return n * np.log(rss / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)


def gaussian_sum(t: np.ndarray, parts: list[tuple[float, float, float]]) -> np.ndarray:
    return sum((a * np.exp(-0.5 * ((t - c) / s) ** 2) for a, c, s in parts), np.zeros_like(t, dtype=float))


def fit_gaussians(t: np.ndarray, x: np.ndarray, most: int = 2, rounds: int = 60) -> list[tuple[float, float, float]]:
    """Up to `most` (amplitude, center, sigma) by Gauss-Newton from the largest residual, their number by AICc; the model
    without a component must be beaten by more than 1."""
    best, parts = (aicc(float((x**2).sum()) + 1e-12, len(x), 1) - 1, []), []
    for k in range(1, most + 1):
        rest = x - gaussian_sum(t, parts)
        at = int(np.abs(rest).argmax())
        parts = [*parts, (float(rest[at]), float(t[at]), float(np.ptp(t)) / 12)]
        p, damp = np.array(parts).ravel(), 1e-2
        error = lambda q: x - gaussian_sum(t, q.reshape(-1, 3).tolist())
        for _ in range(rounds):
            r, cols = error(p), []
            for a, c, s in p.reshape(-1, 3):
                g = np.exp(-0.5 * ((t - c) / s) ** 2)
                cols += [g, a * g * (t - c) / s**2, a * g * (t - c) ** 2 / s**3]
            j = np.stack(cols, axis=1)
            h = j.T @ j
            q = p + np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-9), j.T @ r)
            q[2::3] = np.clip(np.abs(q[2::3]), 1e-3, np.ptp(t))
            if (error(q) ** 2).sum() < (r**2).sum():
                p, damp = q, damp / 3
            else:
                damp *= 4
        parts = [tuple(row) for row in p.reshape(-1, 3).tolist()]
        value = aicc(float((error(p) ** 2).sum()) + 1e-12, len(x), 3 * k)
        if value < best[0]:
            best = (value, parts)
    return best[1]


def st_measures(x: np.ndarray, r: int, fs: float) -> dict[str, float]:
    """J point by the end of the steep slope after R, level against the PR segment, slopes at J + 0, 40 and 80 ms."""
    slope = np.abs(np.gradient(x)) * fs
    end = min(len(x) - 1, r + int(0.12 * fs))
    after = np.flatnonzero(slope[r + 1 : end] < 0.1 * (slope[max(0, r - int(0.06 * fs)) : end].max() + 1e-12))
    j = r + 1 + int(after[0]) if len(after) else min(len(x) - 1, r + int(0.04 * fs))
    base = float(np.median(x[max(0, r - int(0.1 * fs)) : max(1, r - int(0.06 * fs))]))
    at = lambda ms: min(len(x) - 1, j + int(ms * fs / 1000))
    out = {"j_index": float(j), "j_level": float(x[j] - base), "st60": float(x[at(60)] - base)}
    for ms in (0, 40, 80):
        a, b = at(ms), at(ms + 40)
        out[f"slope{ms}"] = float((x[b] - x[a]) / max(1, b - a) * fs)
    out["coved"] = float(out["j_level"] >= 0.2 and out["slope0"] < 0 and out["slope40"] <= 0)
    out["saddle"] = float(out["j_level"] >= 0.2 and out["slope0"] < 0 < out["slope80"])
    return out
