"""Affine registration of layers and windows for editing: small, driver-side rules."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def world_affine(scale=(1.0, 1.0), translate=(0.0, 0.0), rotate=None, shear: float = 0.0, affine=None) -> np.ndarray:
    """3 x 3 matrix from pixel (y, x) to world."""
    turn = np.eye(2) if rotate is None else np.asarray(rotate, float)
    local = np.eye(3)
    local[:2, :2] = turn @ np.array([[1.0, shear], [0.0, 1.0]]) @ np.diag(scale)
    local[:2, 2] = translate
    out = (np.eye(3) if affine is None else np.asarray(affine, float)) @ local
    if not np.isfinite(out).all() or not np.allclose(out[2], (0, 0, 1)):
        raise ValueError("the transform leaves the plane")
    return out


def same_registration(a: np.ndarray, b: np.ndarray, height: int, width: int, tolerance: float = 1e-6) -> bool:
    """Whether two transforms agree at the corners, in source pixels."""
    corners = np.array([[0, 0, 1], [0, width, 1], [height, 0, 1], [height, width, 1]], float).T
    moved = np.linalg.solve(a, b @ corners)
    return bool(np.abs(moved[:2] - corners[:2]).max() <= tolerance)


def integer_offset(source: np.ndarray, target: np.ndarray, tolerance: float = 1e-6) -> tuple[int, int]:
    """(dy, dx) that moves source pixels onto target pixels; raises unless it is a shift by whole pixels."""
    move = np.linalg.solve(target, source)
    shift = np.rint(move[:2, 2])
    if not np.allclose(move[:2, :2], np.eye(2), atol=tolerance) or not np.allclose(move[:2, 2], shift, atol=tolerance):
        raise ValueError("layers don't differ by whole pixels")
    return int(shift[0]), int(shift[1])


def crop_affine(matrix: np.ndarray, y0: int, x0: int) -> np.ndarray:
    """Transform of a crop whose origin is (y0, x0) of the layer."""
    move = np.eye(3)
    move[:2, 2] = y0, x0
    return matrix @ move


def pick_pixel(matrix: np.ndarray, world: tuple[float, float]) -> tuple[int, int]:
    """The pixel nearest a world point, halves up."""
    y, x, _ = np.linalg.solve(matrix, np.array([*world, 1.0]))
    return math.floor(y + 0.5), math.floor(x + 0.5)


def cell_at(matrix: np.ndarray, world: tuple[float, float], step_y: float, step_x: float) -> tuple[int, int]:
    """The grid cell that holds a world point."""
    y, x, _ = np.linalg.solve(matrix, np.array([*world, 1.0]))
    return math.floor(y / step_y), math.floor(x / step_x)


@dataclass(frozen=True)
class Window:
    y0: int
    x0: int
    y1: int
    x1: int

    def contains(self, y0: float, x0: float, y1: float, x1: float, margin: float = 0) -> bool:
        return self.y0 + margin <= y0 and self.x0 + margin <= x0 and y1 <= self.y1 - margin and x1 <= self.x1 - margin


def aligned_window(shape: tuple[int, int], center: tuple[float, float], size: int, alignment: int) -> Window:
    """A window of about ``size`` around a centre, inside the layer and on multiples of the alignment."""
    ends = []
    for n, c in zip(shape, center):
        low = max(0, min(int(c - size / 2), n - size)) // alignment * alignment
        ends.append((low, min(n, low + -(-size // alignment) * alignment)))
    return Window(ends[0][0], ends[1][0], ends[0][1], ends[1][1])


#: Screen pixels of a source pixel at which following begins, and below which it ends. Fixed values.
ENTER_PIXELS, EXIT_PIXELS = 0.5, 0.35
STEP, LARGEST, READ_BYTES = 512, 4096, 128 << 20


@dataclass(frozen=True)
class Follow:
    """A square window that follows the view."""

    y0: int
    x0: int
    size: int

    def guards(self, view: tuple[float, float, float, float]) -> bool:
        """Whether a view stays inside the guard band, a tenth of the window or 128 pixels wide."""
        return Window(self.y0, self.x0, self.y0 + self.size, self.x0 + self.size).contains(*view, margin=min(128, self.size / 10))


def follow_window(view: tuple[float, float, float, float], shape: tuple[int, int], pixel_size: float, current: Follow | None = None, bytes_per_pixel: int = 4, requested: int | None = None) -> Follow | None:
    """The square to read for a view of ``pixel_size`` screen pixels a source pixel; None if the view is too wide or empty.

    Its side doubles from 1024 until the view, a border and one step fit, or is the requested one; beyond 4096 or the
    bytes that may be read there is none. The current window stays while its guard band holds the view and it isn't
    over twice too large. A new one begins at a step near the view's centre, so that it holds the view if it can.
    """
    if pixel_size < (ENTER_PIXELS if current is None else EXIT_PIXELS):
        return None
    y0, x0, y1, x1 = view = (max(0, view[0]), max(0, view[1]), min(shape[0], view[2]), min(shape[1], view[3]))
    if y0 >= y1 or x0 >= x1:
        return None
    span = max(y1 - y0, x1 - x0)
    border = 2 * min(128, max(32, span / 10))
    size = requested or max(1024, 1 << math.ceil(math.log2(span + STEP + border)))
    if size > LARGEST or size * size * bytes_per_pixel > READ_BYTES:
        return None
    middle = [math.floor((low + high - size) / 2 / STEP) * STEP for low, high in ((y0, y1), (x0, x1))]
    if requested and span + border > size:  # a wish too small for the view covers its centre
        return Follow(max(0, middle[0]), max(0, middle[1]), size)
    if current is not None and current.guards(view) and current.size <= 2 * size and requested in (None, current.size):
        return current
    start = [max(0, math.ceil((high - size) / STEP) * STEP, min(math.floor(low / STEP) * STEP, m)) for (low, high), m in zip(((y0, y1), (x0, x1)), middle)]
    return Follow(start[0], start[1], size)


def uses_tiles(height: int, width: int, bytes_per_pixel: int, free_bytes: int) -> bool:
    """Whether a layer is edited by tiles: over 100 million pixels, or more than a share of free memory."""
    return height * width > 100_000_000 or 1.5 * height * width * bytes_per_pixel > min(2 << 30, 0.1 * free_bytes)


def box_of_corners(corners: list[tuple[float, float]]) -> tuple[int, int, int, int]:
    """Whole-pixel box of corners, forgiving the last digits."""
    ys, xs = ([round(c[k], 8) for c in corners] for k in (0, 1))
    return math.floor(min(ys)), math.floor(min(xs)), math.ceil(max(ys)), math.ceil(max(xs))
