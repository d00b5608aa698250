"""Grid geometry, rigid transforms with covariance, and their small matrices (numpy, on the driver)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A grid of nx by ny cells of size sx by sy whose corner is at (ox, oy)."""

    nx: int
    ny: int
    sx: float
    sy: float
    ox: float = 0.0
    oy: float = 0.0

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The cell indices of a point (not yet tested against the grid's bounds)."""
        return F.floor((x - self.ox) / self.sx).cast("long"), F.floor((y - self.oy) / self.sy).cast("long")

    def inside(self, xi: Column, yi: Column) -> Column:
        return (xi >= 0) & (xi < self.nx) & (yi >= 0) & (yi < self.ny)

    def centre(self, xi: Column, yi: Column) -> tuple[Column, Column]:
        return (xi + 0.5) * self.sx + self.ox, (yi + 0.5) * self.sy + self.oy

    def rest(self, x: Column, y: Column) -> tuple[Column, Column]:
        """A point's offset within its cell."""
        xi, yi = self.cell(x, y)
        return x - (xi * self.sx + self.ox), y - (yi * self.sy + self.oy)

    def aligned(self, other: GridSpec, shift: tuple[float, float] = (0.0, 0.0), tolerance: float = 1e-6) -> bool:
        """Whether the cells of both grids coincide, the other's frame being shifted against this one's."""
        if abs(self.sx - other.sx) > tolerance or abs(self.sy - other.sy) > tolerance:
            return False
        steps = (other.ox + shift[0] - self.ox) / self.sx, (other.oy + shift[1] - self.oy) / self.sy
        return all(abs(s - round(s)) < tolerance for s in steps)

    def fully_aligned(self, other: GridSpec, shift: tuple[float, float] = (0.0, 0.0)) -> bool:
        """Aligned, of one size, and in one place."""
        same = (self.nx, self.ny) == (other.nx, other.ny)
        return same and self.aligned(other, shift) and abs(other.ox + shift[0] - self.ox) < 1e-6 and abs(other.oy + shift[1] - self.oy) < 1e-6


def rotation(roll: float = 0.0, pitch: float = 0.0, yaw: float = 0.0) -> np.ndarray:
    """About x, then y, then z."""
    (a, b, c), (d, e, f) = np.cos([roll, pitch, yaw]), np.sin([roll, pitch, yaw])
    x = np.array([[1, 0, 0], [0, a, -d], [0, d, a]])
    y = np.array([[b, 0, e], [0, 1, 0], [-e, 0, b]])
    z = np.array([[c, -f, 0], [f, c, 0], [0, 0, 1]])
    return z @ y @ x


def affine(shift: tuple[float, float, float] = (0.0, 0.0, 0.0), turn: np.ndarray | None = None) -> np.ndarray:
    m = np.eye(4)
    m[:3, :3] = np.eye(3) if turn is None else turn
    m[:3, 3] = shift
    return m


def skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


@dataclass(frozen=True)
class Uncertain:
    """A rigid transform with a 6x6 covariance of (rotation, translation), perturbed on the left: exp(r) R, t + dt."""

    m: np.ndarray
    cov: np.ndarray | None = None

    def _jacobians(self, other: Uncertain) -> tuple[np.ndarray, np.ndarray]:
        """Of self * other with respect to either."""
        r, lever = self.m[:3, :3], self.m[:3, :3] @ other.m[:3, 3]
        a, b = np.eye(6), np.zeros((6, 6))
        a[3:, :3] = -skew(lever)
        b[:3, :3] = b[3:, 3:] = r
        return a, b

    def __matmul__(self, other: Uncertain) -> Uncertain:
        m = self.m @ other.m
        if self.cov is None and other.cov is None:
            return Uncertain(m)
        a, b = self._jacobians(other)
        zero = np.zeros((6, 6))
        return Uncertain(m, a @ (zero if self.cov is None else self.cov) @ a.T + b @ (zero if other.cov is None else other.cov) @ b.T)

    def inverse(self) -> Uncertain:
        m = np.linalg.inv(self.m)
        if self.cov is None:
            return Uncertain(m)
        j = np.zeros((6, 6))
        r = m[:3, :3]
        j[:3, :3] = j[3:, 3:] = -r
        j[3:, :3] = -r @ skew(self.m[:3, 3])
        return Uncertain(m, j @ self.cov @ j.T)

    def without_last(self, last: Uncertain) -> Uncertain:
        """The factor a of self = a * last, with the covariance that last did not bring."""
        m = self.m @ np.linalg.inv(last.m)
        if self.cov is None:
            return Uncertain(m)
        a, b = Uncertain(m)._jacobians(last)
        rest = self.cov - (0 if last.cov is None else b @ last.cov @ b.T)
        inv = np.linalg.inv(a)
        return Uncertain(m, inv @ rest @ inv.T)

    def without_first(self, first: Uncertain) -> Uncertain:
        """The factor b of self = first * b, with the covariance that first did not bring."""
        other = Uncertain(np.linalg.inv(first.m) @ self.m)
        if self.cov is None:
            return other
        a, b = first._jacobians(other)
        rest = self.cov - (0 if first.cov is None else a @ first.cov @ a.T)
        inv = np.linalg.inv(b)
        return Uncertain(other.m, inv @ rest @ inv.T)

    def point(self, p: np.ndarray, cov: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """A point and its covariance in the frame that the transform leads to."""
        r = self.m[:3, :3]
        at = r @ p + self.m[:3, 3]
        if self.cov is None and cov is None:
            return at, None
        j = np.hstack([-skew(r @ p), np.eye(3)])
        return at, (0 if self.cov is None else j @ self.cov @ j.T) + (0 if cov is None else r @ cov @ r.T)


def quaternion(turn: np.ndarray) -> np.ndarray:
    """(w, x, y, z) of a rotation matrix: the leading eigenvector of its symmetric 4x4 form."""
    r = turn
    k = np.array([
        [r[0, 0] + r[1, 1] + r[2, 2], r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]],
        [r[2, 1] - r[1, 2], r[0, 0] - r[1, 1] - r[2, 2], r[0, 1] + r[1, 0], r[0, 2] + r[2, 0]],
        [r[0, 2] - r[2, 0], r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], r[1, 2] + r[2, 1]],
        [r[1, 0] - r[0, 1], r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1]],
    ])
    q = np.linalg.eigh(k)[1][:, -1]
    return q if q[0] >= 0 else -q


def axis_angle(turn: np.ndarray) -> np.ndarray:
    q = quaternion(turn)
    n = np.linalg.norm(q[1:])
    return np.zeros(3) if n < 1e-12 else q[1:] / n * 2 * np.arctan2(n, q[0])


def line_cells(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Cells of the straight line between two cells, both included, by stepping along its longer side."""
    n = max(abs(x1 - x0), abs(y1 - y0))
    step = lambda a, b, k: a + (2 * k * (b - a) + n) // (2 * n)
    return [(x0, y0)] if n == 0 else [(step(x0, x1, k), step(y0, y1, k)) for k in range(n + 1)]


def voxel_path(start: np.ndarray, end: np.ndarray, size: float) -> list[tuple[int, int, int]]:
    """Voxels that a ray from start to end passes, in order: one axis step at each boundary that it crosses."""
    d = np.asarray(end, float) - start
    at, last = np.floor(np.asarray(start) / size).astype(int), np.floor(np.asarray(end) / size).astype(int)
    cross = []
    for axis in range(3):
        step = int(np.sign(d[axis]))
        for k in range(abs(int(last[axis] - at[axis]))):
            edge = (at[axis] + (k + 1 if step > 0 else -k)) * size
            cross.append(((edge - start[axis]) / d[axis], axis, step))
    out = [tuple(int(v) for v in at)]
    for _, axis, step in sorted(cross):
        at[axis] += step
        out.append(tuple(int(v) for v in at))
    return out
