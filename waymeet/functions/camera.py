"""Camera and plane transforms as columns; matrices are plain nested lists of a calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = Sequence[Sequence[float]]


def apply_matrix(m: Matrix, *v: Column) -> list[Column]:
    """m times the vector v."""
    return [sum((c * F.lit(float(w)) for c, w in zip(v[1:], row[1:], strict=True)), v[0] * F.lit(float(row[0]))) for row in m]


def homogeneous(m: Matrix, x: Column, y: Column, z: Column) -> list[Column]:
    """A 4 x 4 transform of a point: world to camera or back."""
    return apply_matrix(m, x, y, z, F.lit(1.0))[:3]


def homography(m: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    u, v, w = apply_matrix(m, x, y, F.lit(1.0))
    return u / w, v / w


def distort(x: Column, y: Column, k: Sequence[float]) -> tuple[Column, Column]:
    """Lens distortion (k1, k2, p1, p2, k3) of normalised coordinates."""
    k1, k2, p1, p2, k3 = k
    r2 = x * x + y * y
    radial = 1 + r2 * (F.lit(k1) + r2 * (F.lit(k2) + r2 * F.lit(k3)))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def world_to_pixel(x: Column, y: Column, z: Column, extrinsic: Matrix, k: Matrix, lens: Sequence[float]) -> tuple[Column, Column]:
    """Pixel of a world point; extrinsic is 4 x 4 (world to camera), k the 3 x 3 camera matrix."""
    cx, cy, cz = homogeneous(extrinsic, x, y, z)
    u, v = distort(cx / cz, cy / cz, lens)
    px, py, _ = apply_matrix(k, u, v, F.lit(1.0))
    return px, py


def ray_on_plane(origin: Sequence[Column], ray: Sequence[Column], normal: Sequence[Column], point: Sequence[Column]) -> list[Column]:
    """Where a ray meets the plane through point; null where it runs along the plane."""
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    down = dot(ray, normal)
    t = F.when(F.abs(down) > 1e-12, dot([p - o for p, o in zip(point, origin, strict=True)], normal) / down)
    return [o + t * r for o, r in zip(origin, ray, strict=True)]
