"""Small matrices on the driver: logarithm, exponential, means, polar parts, least squares and file forms."""

from __future__ import annotations

import numpy as np


def expm(a: np.ndarray) -> np.ndarray:
    """Exponential by scaling, a Taylor sum and squaring."""
    a = np.asarray(a, float)
    n = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-300)))) + 4)
    x, out, term = a / 2**n, np.eye(len(a)), np.eye(len(a))
    for k in range(1, 18):
        term = term @ x / k
        out = out + term
    for _ in range(n):
        out = out @ out
    return out


def sqrtm(a: np.ndarray) -> np.ndarray:
    """Principal square root by the Denman-Beavers iteration."""
    y, z = np.asarray(a, float), np.eye(len(a))
    for _ in range(60):
        y, z, last = (y + np.linalg.inv(z)) / 2, (z + np.linalg.inv(y)) / 2, y
        if np.abs(y - last).max() < 1e-15 * max(1.0, np.abs(y).max()):
            break
    return y


def logm(a: np.ndarray) -> np.ndarray:
    """Principal logarithm by inverse scaling: square roots until close to one, then the series of atanh."""
    x, n = np.asarray(a, float), 0
    while np.abs(x - np.eye(len(x))).max() > 0.1 and n < 40:
        x, n = sqrtm(x), n + 1
    w = np.linalg.solve(x + np.eye(len(x)), x - np.eye(len(x)))
    w2, term, out = w @ w, w, np.zeros_like(w)
    for k in range(1, 30, 2):
        out = out + term / k
        term = term @ w2
    return 2 * out * 2**n


def half(a: np.ndarray) -> np.ndarray:
    """The transformation that gives a when applied twice."""
    return expm(logm(a) / 2)


def mean(matrices: list[np.ndarray], weights: list[float] | None = None) -> np.ndarray:
    """Log-Euclidean mean."""
    return expm(np.average([logm(m) for m in matrices], axis=0, weights=weights))


def trimmed_mean(matrices: list[np.ndarray], inlier: float = 0.5, rounds: int = 10) -> np.ndarray:
    """Log-Euclidean mean of the matrices closest to the mean, found anew in each round (ties: the earlier one)."""
    keep = max(1, int(np.ceil(len(matrices) * inlier)))
    now = mean(matrices)
    for _ in range(rounds):
        far = [np.linalg.norm(m - now) for m in matrices]
        now = mean([matrices[i] for i in np.argsort(far, kind="stable")[:keep]])
    return now


def rigid_part(a: np.ndarray) -> np.ndarray:
    """Rotation of the polar decomposition, with the same image of the origin."""
    u, _, v = np.linalg.svd(np.asarray(a, float)[:3, :3])
    d = np.diag([1, 1, np.sign(np.linalg.det(u @ v))])
    out = np.array(a, float)
    out[:3, :3] = u @ d @ v
    return out


def demean(matrices: list[np.ndarray]) -> np.ndarray:
    """Inverse of the mean of what the matrices do beyond their rigid parts."""
    return np.linalg.inv(expm(np.mean([logm(np.linalg.inv(rigid_part(m)) @ m) for m in matrices], axis=0)))


def make_affine(angles: list[float], shift: list[float], scale: list[float], shear: list[float]) -> np.ndarray:
    """Rotations about x, y, z (degrees), then shear and scale, then a shift."""
    out = np.eye(4)
    for k, degrees in enumerate(angles):
        c, s, i, j = np.cos(np.radians(degrees)), np.sin(np.radians(degrees)), (k + 1) % 3, (k + 2) % 3
        r = np.eye(4)
        r[[i, i, j, j], [i, j, i, j]] = [c, -s, s, c]
        out = r @ out
    sh = np.eye(4)
    sh[0, 1], sh[0, 2], sh[1, 2] = shear
    out = np.diag([*scale, 1.0]) @ sh @ out
    out[:3, 3] = shift
    return out


def from_flirt(f: np.ndarray, floating_spacing: list[float], floating: np.ndarray, reference_spacing: list[float], reference: np.ndarray) -> np.ndarray:
    """Matrix between scaled voxel spaces to one between world spaces (reference to floating)."""
    sf, sr = np.diag([*floating_spacing, 1.0]), np.diag([*reference_spacing, 1.0])
    return floating @ np.linalg.inv(sf) @ np.linalg.inv(f) @ sr @ np.linalg.inv(reference)


def real_spacing(m: np.ndarray) -> list[float]:
    """Lengths of a voxel-to-world matrix's columns."""
    return np.linalg.norm(np.asarray(m)[:3, :3], axis=0).tolist()


def affine_from_moments(n: float, sx: np.ndarray, sy: np.ndarray, sxx: np.ndarray, sxy: np.ndarray) -> np.ndarray:
    """Least-squares affine that moves points x onto y from sums over pairs: n, x, y, x x', x y'."""
    d = len(sx)
    gram = np.block([[sxx, sx[:, None]], [sx[None, :], np.array([[n]])]])
    right = np.vstack([sxy, sy[None, :]])
    sol = np.linalg.lstsq(gram, right, rcond=None)[0].T
    out = np.eye(4)
    out[:d, :d], out[:d, 3] = sol[:, :d], sol[:, d]
    return out


def rigid_from_moments(n: float, sx: np.ndarray, sy: np.ndarray, sxx: np.ndarray, sxy: np.ndarray) -> np.ndarray:
    """Least-squares rotation and shift (Kabsch), never a reflection."""
    d = len(sx)
    cov = sxy - np.outer(sx, sy) / n
    u, _, vt = np.linalg.svd(cov)
    s = np.eye(d)
    s[-1, -1] = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
    r = vt.T @ s @ u.T
    out = np.eye(4)
    out[:d, :d], out[:d, 3] = r, (sy - r @ sx) / n
    return out


def principal_parts(cov: np.ndarray, count: int) -> np.ndarray:
    """Projection on the leading eigenvectors of a covariance, largest eigenvalue first."""
    w, v = np.linalg.eigh(cov)
    v = v[:, np.argsort(-w)[:count]]
    return v @ v.T
