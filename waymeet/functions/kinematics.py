"""Motion along ordered rows as window columns.

Every function takes a window partitioned by track and ordered by frame; none needs another shuffle than that window's.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from .angles import TWO_PI, mean_direction


def whole(w: WindowSpec) -> WindowSpec:
    """The window over all rows of the track, in order."""
    from pyspark.sql import Window

    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far(w: WindowSpec) -> WindowSpec:
    from pyspark.sql import Window

    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def displacement(c: Column, w: WindowSpec) -> Column:
    """Change since the row before; 0 on the first."""
    return F.coalesce(c - F.lag(c).over(w), F.lit(0.0))


def step_length(x: Column, y: Column, w: WindowSpec) -> Column:
    dx, dy = displacement(x, w), displacement(y, w)
    return F.sqrt(dx * dx + dy * dy)


def moving_average(c: Column, w: WindowSpec, half: int = 5) -> Column:
    """Centred mean over 2 half + 1 rows; beyond the ends the end value is repeated."""
    near = w.rowsBetween(-half, half)
    at = F.row_number().over(w)
    left = F.greatest(F.lit(0), half + 1 - at)
    right = F.greatest(F.lit(0), at + half - F.count(F.lit(1)).over(whole(w)))
    first, last = F.first(c).over(whole(w)), F.last(c).over(whole(w))
    return (F.sum(c).over(near) + left * first + right * last) / (2 * half + 1)


def direction_average(yaw: Column, w: WindowSpec, half: int = 5) -> Column:
    """Centred circular mean over 2 half + 1 rows, ends repeated."""
    return mean_direction(moving_average(F.sin(yaw), w, half), moving_average(F.cos(yaw), w, half))


def central_velocity(c: Column, w: WindowSpec, dt: float) -> Column:
    """(next - previous) / 2dt; the ends take their neighbour's value."""
    inner = (F.lead(c).over(w) - F.lag(c).over(w)) / (2 * dt)
    nxt = (F.lead(c, 2).over(w) - c) / (2 * dt)
    prev = (c - F.lag(c, 2).over(w)) / (2 * dt)
    return F.when(F.lag(c).over(w).isNull(), nxt).when(F.lead(c).over(w).isNull(), prev).otherwise(inner)


def central_acceleration(c: Column, w: WindowSpec, dt: float) -> Column:
    second = lambda a, b, d: (a - 2 * b + d) / (dt * dt)
    lag, lead = (lambda k: F.lag(c, k).over(w)), (lambda k: F.lead(c, k).over(w))
    return (
        F.when(lag(1).isNull(), second(lead(2), lead(1), c))
        .when(lead(1).isNull(), second(c, lag(1), lag(2)))
        .otherwise(second(lead(1), c, lag(1)))
    )


def gradient(c: Column, w: WindowSpec, spacing: float = 1.0) -> Column:
    """Central differences inside, one-sided at the ends."""
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.when(before.isNull(), after - c).when(after.isNull(), c - before).otherwise((after - before) / 2) / spacing


def held_yaw(yaw: Column, step: Column, w: WindowSpec, least_step: float = 0.1) -> Column:
    """Yaw of the last row that moved by least_step; the track's first yaw before any has."""
    return F.coalesce(F.last(F.when(step >= least_step, yaw), ignorenulls=True).over(so_far(w)), F.first(yaw).over(whole(w)))


def since_last(flag: Column, order: Column, w: WindowSpec) -> Column:
    """Rows since flag last held (0 where it holds); null before it first does."""
    return order - F.max(F.when(flag, order)).over(so_far(w))


def mean_before(c: Column, w: WindowSpec, rows: int = 30) -> Column:
    """Mean of up to `rows` rows before this one; null on the first."""
    return F.avg(c).over(w.rowsBetween(-rows, -1))


def short_way(delta: Column) -> Column:
    """A difference of angles without whole turns."""
    return delta - F.lit(TWO_PI) * F.rint(delta / F.lit(TWO_PI))
