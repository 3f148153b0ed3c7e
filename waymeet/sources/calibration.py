"""Camera calibrations and ground meshes: small files, read on the driver and turned into constants or small tables."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.camera import ray_on_plane

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


@dataclass(frozen=True)
class Calibration:
    """A camera: 3 x 3 matrix, lens (k1, k2, p1, p2, k3) and world-to-camera transform."""

    camera: np.ndarray
    lens: tuple[float, ...]
    extrinsic: np.ndarray

    @property
    def position(self) -> np.ndarray:
        """Where the camera is: -R^T t."""
        return -self.extrinsic[:3, :3].T @ self.extrinsic[:3, 3]

    @property
    def projection(self) -> np.ndarray:
        return self.camera @ self.extrinsic[:3]

    def undistort(self, pixels: np.ndarray, rounds: int = 20) -> np.ndarray:
        """Normalised coordinates of pixels (n, 2), by fixed-point iteration."""
        k1, k2, p1, p2, k3 = self.lens
        k = self.camera
        start = (pixels - k[:2, 2]) / np.array([k[0, 0], k[1, 1]])
        out = start.copy()
        for _ in range(rounds):
            x, y = out.T
            r2 = x * x + y * y
            radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
            shift = np.stack([2 * p1 * x * y + p2 * (r2 + 2 * x * x), p1 * (r2 + 2 * y * y) + 2 * p2 * x * y], axis=1)
            out = (start - shift) / radial[:, None]
        return out


def numbers(text: str, tag: str) -> list[float]:
    """All numbers inside an XML element."""
    found = re.search(rf"<{tag}\b[^>]*>(.*?)</{tag}>", text, re.S)
    return [float(x) for x in re.findall(_NUMBER, found[1])] if found else []


def read_config(path: str) -> dict:
    return yaml.safe_load(Path(path).read_text())


def zones(spark: SparkSession, config: dict) -> DataFrame:
    """Detection zones of a configuration: a list of id, name, vertices."""
    rows = [(int(z["id"]), str(z["name"]), [{"x": float(x), "y": float(y)} for x, y in z["vertices"]]) for z in config]
    return spark.createDataFrame(rows, "zone_id int, name string, vertices array<struct<x: double, y: double>>")


def orthonormal(normal: np.ndarray) -> np.ndarray:
    """A right-handed base whose third axis is the normal (rows)."""
    n = normal / np.linalg.norm(normal)
    side = np.eye(3)[int(np.argmin(np.abs(n)))]
    u = side - (side @ n) * n
    u /= np.linalg.norm(u)
    return np.stack([u, np.cross(n, u), n])


def upward(normals: np.ndarray) -> np.ndarray:
    """Normals turned to point up."""
    return np.where(normals[..., 2:] < 0, -normals, normals)


def triangle_planes(points: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a point, the upward unit normal) of every face."""
    a, b, c = (points[faces[:, i]] for i in range(3))
    n = np.cross(b - a, c - a)
    return a, upward(n / np.linalg.norm(n, axis=1, keepdims=True))


def pixel_map(spark: SparkSession, calibration: Calibration, points: np.ndarray, faces: np.ndarray, width: int, height: int) -> DataFrame:
    """(px, py, tri, wx, wy, wz): where the ray of each pixel meets the ground mesh, the nearest triangle it hits.

    Pixels are a Spark range; the mesh has some hundred triangles and travels as one constant table.
    """
    start, normal = triangle_planes(points, faces)
    cal, corners = calibration, points[faces]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            px, py = pdf["id"].to_numpy() % width, pdf["id"].to_numpy() // width
            flat = cal.undistort(np.stack([px, py], axis=1).astype(float))
            ray = np.concatenate([flat, np.ones((len(flat), 1))], axis=1) @ cal.extrinsic[:3, :3]
            best, hit, where = np.full(len(flat), np.inf), np.full(len(flat), -1), np.full((len(flat), 3), -1.0)
            for k in range(len(faces)):
                down = ray @ normal[k]
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = ((start[k] - cal.position) @ normal[k]) / down
                p = cal.position + np.where(np.isfinite(t), t, 0)[:, None] * ray
                a, b, c = corners[k]
                inside = np.ones(len(p), bool)
                for u, v in ((a, b), (b, c), (c, a)):
                    inside &= np.cross(v - u, p - u) @ np.cross(b - a, c - a) >= -1e-9
                ok = inside & (t > 0) & (t < best)
                best[ok], hit[ok], where[ok] = t[ok], k, p[ok]
            yield pd.DataFrame({"px": px, "py": py, "tri": hit.astype("int32"), "wx": where[:, 0], "wy": where[:, 1], "wz": where[:, 2]})

    return spark.range(width * height).mapInPandas(run, "px long, py long, tri int, wx double, wy double, wz double").filter("tri >= 0")


def locate(detections: DataFrame, pixels: DataFrame) -> DataFrame:
    """Detections (px, py rounded) with the world position of their pixel; those off the mesh are gone."""
    return detections.join(pixels, ["px", "py"])


def to_ground(rays: DataFrame, normal: tuple[float, float, float], through: tuple[float, float, float]) -> DataFrame:
    """Rays (ox, oy, oz, rx, ry, rz) met with one plane: gx, gy, gz, null where they run along it."""
    hit = ray_on_plane([F.col(f"o{c}") for c in "xyz"], [F.col(f"r{c}") for c in "xyz"], [F.lit(float(v)) for v in normal], [F.lit(float(v)) for v in through])
    return rays.withColumns(dict(zip(("gx", "gy", "gz"), hit, strict=True)))


def write_zones(path: str, zones: list[dict], *, replace: bool = False) -> list[dict]:
    """Zones (name, vertices) into a YAML configuration: in place of those there, or after them with the next ids. Returns all."""
    given = read_config(path) if Path(path).exists() else {}
    kept = [] if replace else list(given.get("zones") or [])
    first = max((z["id"] for z in kept), default=0) + 1
    kept += [{"id": first + i, "name": z["name"], "vertices": [[float(x), float(y)] for x, y in z["vertices"]]} for i, z in enumerate(zones)]
    Path(path).write_text(yaml.safe_dump(given | {"zones": kept}, sort_keys=False))
    return kept


def axis_rotation(axis: np.ndarray, angle: float) -> np.ndarray:
    """The matrix that turns by angle about an axis."""
    x, y, z = axis / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


def frustum_box(calibration: Calibration, size: tuple[int, int], far: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest world coordinates of what a camera sees down to a depth of `far`, itself included."""
    corners = np.array([[0, 0], [size[0], 0], [0, size[1]], [size[0], size[1]]], float)
    rays = np.concatenate([calibration.undistort(corners), np.ones((4, 1))], axis=1) * far
    world = (rays - calibration.extrinsic[:3, 3]) @ calibration.extrinsic[:3, :3]
    every = np.concatenate([world, calibration.position[None]])
    return every.min(axis=0), every.max(axis=0)
