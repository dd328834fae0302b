"""Pose, view and map geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rotation(rx: Column, ry: Column, rz: Column) -> list[list[Column]]:
    """Matrix of extrinsic x, y, z angles in degrees: Rz * Ry * Rx."""
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(F.radians(a)), F.sin(F.radians(a))) for a in (rx, ry, rz))
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def euler(m: list[list[Column]]) -> tuple[Column, Column, Column]:
    """Angles in degrees of a rotation matrix, away from the poles."""
    return F.degrees(F.atan2(m[2][1], m[2][2])), F.degrees(F.asin(_clip(-m[2][0], -1.0, 1.0))), F.degrees(F.atan2(m[1][0], m[0][0]))


def invert(m: list[list[Column]], t: list[Column]) -> tuple[list[list[Column]], list[Column]]:
    """Inverse of a rigid transform."""
    turned = [[m[j][i] for j in range(3)] for i in range(3)]
    return turned, [-(turned[i][0] * t[0] + turned[i][1] * t[1] + turned[i][2] * t[2]) for i in range(3)]


def geodesic(a: list[list[Column]], b: list[list[Column]]) -> Column:
    """Angle in degrees between two rotations."""
    trace = sum((a[i][j] * b[i][j] for i in range(3) for j in range(3)), F.lit(0.0))
    return F.degrees(F.acos(_clip((trace - 1) / 2, -1.0, 1.0)))


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0)))


def wrap_degrees(x: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def closeness(x: Column, middle: float, slope: float) -> Column:
    """Logistic closeness, 1 or 0 beyond an exponent of 60."""
    e = (x - middle) * slope
    return F.when(e > 60, 0.0).when(e < -60, 1.0).otherwise(1 / (1 + F.exp(e)))


def pose_closeness(pos: Column, ang: Column, pos_middle: float = 0.5, pos_slope: float = 10.0, ang_middle: float = 30.0, ang_slope: float = 0.2) -> Column:
    return closeness(pos, pos_middle, pos_slope) * closeness(ang, ang_middle, ang_slope)


def pose_factors(dx: Column, dy: Column, dz: Column, fx: Column, fy: Column) -> dict[str, Column]:
    """Distances, bearing, elevation and alignment of a displacement against a heading."""
    flat = F.sqrt(dx * dx + dy * dy)
    head = F.sqrt(fx * fx + fy * fy)
    return {
        "distance": F.sqrt(dx * dx + dy * dy + dz * dz),
        "horizontal": flat,
        "vertical": F.abs(dz),
        "bearing": F.degrees(F.atan2(dy, dx)),
        "elevation": F.degrees(F.atan2(dz, flat)),
        "alignment": F.when((flat < 1e-9) | (head < 1e-9), 0.0).otherwise((dx * fx + dy * fy) / F.nullif(flat * head, F.lit(0.0))),
    }


def cardinal(deg: Column) -> Column:
    """Index of one of eight directions."""
    return F.pmod(F.floor((F.pmod(deg + 360.0, F.lit(360.0)) + 22.5) / 45), F.lit(8)).cast("int")


def interval_label(value: Column, edges: list[int], unknown: str | None = None) -> Column:
    """Label of the closed integer interval: edges 2, 5 give [0,2], [3,5], [6,+inf]."""
    out, low = F.when(value.isNull(), F.lit(unknown)), 0
    for e in edges:
        out = out.when(value <= e, F.lit(f"[{low},{e}]"))
        low = e + 1
    return out.otherwise(F.lit(f"[{low},+inf]"))


def overlap_ratios(first: Column, second: Column) -> dict[str, Column]:
    """Shares of the intersection in each set and in the union; 0 for empty sets."""
    both = F.size(F.array_intersect(first, second))
    share = lambda n: F.coalesce(F.try_divide(both, n), F.lit(0.0))
    return {"in_first": share(F.size(F.array_distinct(first))), "in_second": share(F.size(F.array_distinct(second))), "iou": share(F.size(F.array_union(first, second)))}


def camera_moves(actions: Column, step: float = 0.5, turn: float = 30.0, snap: float | None = None) -> Column:
    """Planar pose (x, y, heading) after an array of moves from the origin, by a fold."""
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("heading"))

    def move(p: Column, a: Column) -> Column:
        rad = F.radians(p["heading"])
        along = F.when(a == "move_forward", step).when(a == "move_backward", -step).otherwise(0.0)
        aside = F.when(a == "move_right", step).when(a == "move_left", -step).otherwise(0.0)
        x = p["x"] + along * F.cos(rad) + aside * F.sin(rad)
        y = p["y"] + along * F.sin(rad) - aside * F.cos(rad)
        if snap:
            x, y = F.rint(x / snap) * snap, F.rint(y / snap) * snap
        h = p["heading"] + F.when(a == "turn_left", turn).when(a == "turn_right", -turn).otherwise(0.0)
        return F.struct(x.alias("x"), y.alias("y"), wrap_degrees(h).alias("heading"))

    return F.aggregate(actions, start, move)


def projected(x: Column, y: Column, z: Column, depth: Column, focal: float, width: int, height: int, slack: float = 0.1) -> dict[str, Column]:
    """Pixel of a camera-space point and whether it is in view and not hidden by the depth there."""
    u, v = focal * F.try_divide(x, z) + width / 2, focal * F.try_divide(y, z) + height / 2
    inside = (z > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return {"u": u, "v": v, "visible": F.coalesce(inside & (z <= depth + slack), F.lit(False))}


def grid_cell(x: Column, y: Column, size: float, columns: int, rows: int) -> Column:
    """Cell number of a point, clipped to the grid."""
    c = F.greatest(F.lit(0), F.least(F.lit(columns - 1), F.floor(x / size).cast("int")))
    r = F.greatest(F.lit(0), F.least(F.lit(rows - 1), F.floor(y / size).cast("int")))
    return r * columns + c
