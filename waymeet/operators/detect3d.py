"""From raw detector rows to boxes in the world."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import angles, boxes
from .interactions import in_zones


def world_boxes(raw: DataFrame, pixels: DataFrame, sizes: DataFrame, *, gain: float, pad: tuple[float, float], size: tuple[int, int]) -> DataFrame:
    """Detections in world coordinates.

    raw: x1 .. y2, conf, class_name, kx, ky (key point), d_len, d_wid, d_hei (log offsets from the class's mean size),
    sin, cos (turn relative to the view). pixels: the pixel map, sizes: mean sizes by class; both are constants of a
    camera and joined on equality. The yaw is the direction of view to the point, in atan2(dx, dy), plus the turn.
    """
    box = boxes.rescale(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), gain, pad, size)
    out = raw.withColumns(dict(zip(("x1", "y1", "x2", "y2"), box, strict=True)))
    out = out.withColumns({"px": F.rint((F.col("kx") - pad[0]) / gain).cast("long"), "py": F.rint((F.col("ky") - pad[1]) / gain).cast("long")})
    out = out.filter(F.col("px").between(0, size[0] - 1) & F.col("py").between(0, size[1] - 1)).join(pixels, ["px", "py"])
    out = out.join(F.broadcast(sizes.select("class_name", *(F.col(c).alias(f"mean_{c}") for c in ("length", "width", "height")))), "class_name")
    yaw = F.atan2(F.col("wx") - F.col("cam_x"), F.col("wy") - F.col("cam_y")) + F.atan2("sin", "cos")
    new = {c: F.col(f"mean_{c}") * F.exp(f"d_{c[:3]}") for c in ("length", "width", "height")}
    return out.withColumns(new | {"yaw": angles.positive(yaw)}).drop("mean_length", "mean_width", "mean_height")


def confident(detections: DataFrame, zones: DataFrame, least: float) -> DataFrame:
    """Detections above a confidence whose key point is inside a zone."""
    return in_zones(detections.filter(F.col("conf") > least), zones, "px", "py")


