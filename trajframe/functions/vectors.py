"""Column functions over vectors: normalisation, relative actions, slices, rotations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def normalise(v: Column, mode: str, stats: dict[str, list[float]], inverse: bool = False, clip: bool = False, eps: float = EPS) -> Column:
    """A vector normalised dimension by dimension. mean_std: (x - mean) / (std + eps), back x std + mean. min_max, quantiles
    (q01, q99), quantile10 (q10, q90): to -1..1, a span of 0 counts as eps. identity: as it is. ``clip`` bounds spans by eps from below and values to the range."""
    keys = {"identity": (), "mean_std": ("mean", "std"), "min_max": ("min", "max"), "quantiles": ("q01", "q99"), "quantile10": ("q10", "q90")}[mode]
    if not keys or not stats:
        return v
    for k in keys:
        if k not in stats:
            raise ValueError(f"{mode} needs {k}")
    lit = [F.array(*(F.lit(float(x)) for x in stats[k])) for k in keys]
    a, b = lambda i: F.get(lit[0], i), lambda i: F.get(lit[1], i)
    if mode == "mean_std":
        sigma = (lambda i: F.greatest(b(i), F.lit(eps))) if clip else (lambda i: b(i) + eps)
        if inverse:
            return F.transform(v, lambda x, i: x * b(i) + a(i))
        return F.transform(v, lambda x, i: (x - a(i)) / sigma(i))
    span = (lambda i: F.greatest(b(i) - a(i), F.lit(eps))) if clip else (lambda i: F.when(b(i) == a(i), eps).otherwise(b(i) - a(i)))
    if inverse:
        return F.transform(v, lambda x, i: (x + 1) / 2 * span(i) + a(i))
    bounded = (lambda x, i: F.least(F.greatest(x, a(i)), b(i))) if clip else (lambda x, i: x)
    return F.transform(v, lambda x, i: 2 * (bounded(x, i) - a(i)) / span(i) - 1)


def joint_mask(names: list[str], absolute: list[str]) -> list[bool]:
    """False for joints whose name equals or contains, in any case, one of ``absolute``."""
    return [not any(a.lower() in n.lower() for a in absolute) for n in names]


def relative(action: Column, state: Column, mask: list[bool], inverse: bool = False) -> Column:
    """Action minus (inverse: plus) the state where the mask holds; dimensions beyond the mask are left alone."""
    on = F.array(*(F.lit(1.0 if m else 0.0) for m in mask))
    sign = 1.0 if inverse else -1.0
    return F.transform(action, lambda x, i: x + sign * F.coalesce(F.get(state, i) * F.get(on, i), F.lit(0.0)))


def pick(v: Column, ranges: str) -> Column:
    """Dimensions "0:6,7:23" of a vector."""
    parts = [tuple(map(int, r.split(":"))) for r in ranges.split(",")]
    return F.concat(*(F.slice(v, a + 1, b - a) for a, b in parts))


def pad_to(v: Column, n: int) -> Column:
    """The vector cut, or filled with zeros, to n dimensions."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)


def assemble(cols: list[str], kind: str = "float") -> Column:
    return F.array(*(F.col(f"`{c}`") for c in cols)).cast(f"array<{kind}>")


def named(v: Column, names: list[str]) -> list[Column]:
    return [F.get(v, F.lit(i)).alias(n) for i, n in enumerate(names)]


def moves(dims: list[Column], eps: float = 1e-3) -> Column:
    """Whether a motion is longer than eps."""
    return F.sqrt(sum((d * d for d in dims), F.lit(0.0))) > eps


def gripper_step(pos: Column, vel: Column, speed: float, low: float, high: float) -> Column:
    return F.least(F.greatest(pos + vel * speed, F.lit(low)), F.lit(high))


def gripper_command(discrete: Column, clip_max: float) -> Column:
    """0 closes, 1 stays, 2 opens."""
    return -(discrete - 1) * clip_max


def gripper_penalty(state: Column, command: Column, penalty: float, most: float = 30.0) -> Column:
    """The penalty where an open gripper is closed or a closed one opened (state over 0.9 or under 0.1 of ``most``)."""
    part = state / most
    return F.when(((part < 0.1) & (command > 0.9)) | ((part > 0.9) & (command < 0.1)), penalty).otherwise(0.0)


def has_nan(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x))


# Rotations: quaternions are (x, y, z, w) arrays.


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value found once. A column that is used twice stands, and is found, twice in the plan, and four times when what uses it is used twice."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def norm(a: Column) -> Column:
    return let(a, lambda a: F.sqrt(dot(a, a)))


def cross(a: Column, b: Column) -> Column:
    g = lambda v, i: F.get(v, F.lit(i))
    of = lambda a, b: F.array(g(a, 1) * g(b, 2) - g(a, 2) * g(b, 1), g(a, 2) * g(b, 0) - g(a, 0) * g(b, 2), g(a, 0) * g(b, 1) - g(a, 1) * g(b, 0))
    return let(a, lambda a: let(b, lambda b: of(a, b)))


def euler_to_quaternion(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Rotations about z, then y, then x (yaw, pitch, roll)."""
    cr, sr, cp, sp, cy, sy = F.cos(roll / 2), F.sin(roll / 2), F.cos(pitch / 2), F.sin(pitch / 2), F.cos(yaw / 2), F.sin(yaw / 2)
    return F.array(sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy)


def geodesic(p: Column, q: Column) -> Column:
    """Angle between two orientations."""
    return 2 * F.acos(F.least(F.greatest(F.abs(dot(p, q)), F.lit(0.0)), F.lit(1.0)))


def quaternion_multiply(p: Column, q: Column) -> Column:
    g = lambda v, i: F.get(v, F.lit(i))
    px, py, pz, pw, qx, qy, qz, qw = *(g(p, i) for i in range(4)), *(g(q, i) for i in range(4))
    return F.array(pw * qx + px * qw + py * qz - pz * qy, pw * qy - px * qz + py * qw + pz * qx, pw * qz + px * qy - py * qx + pz * qw, pw * qw - px * qx - py * qy - pz * qz)


def quaternion_inverse(q: Column) -> Column:
    return F.transform(q, lambda x, i: F.when(i < 3, -x).otherwise(x))


def rotvec_to_quaternion(v: Column) -> Column:
    """Small angles by the series of sin(a / 2) / a."""
    scale = lambda a: F.when(a < 1e-6, 0.5 - a * a / 48).otherwise(F.sin(a / 2) / F.nullif(a, F.lit(0.0)))
    of = lambda v, a: let(scale(a), lambda k: F.concat(F.transform(v, lambda x: x * k), F.array(F.cos(a / 2))))
    return let(v, lambda v: let(norm(v), lambda a: of(v, a)))


def quaternion_to_rotvec(q: Column) -> Column:
    scale = lambda s, w: F.when(s < 1e-7, 2.0 + s * s / 3).otherwise(2 * F.atan2(s, F.abs(w)) / F.nullif(s, F.lit(0.0)))
    scaled = lambda v, w: let(let(norm(v), lambda s: scale(s, w)), lambda k: F.transform(v, lambda x: x * k))
    of = lambda q, w: let(F.transform(F.slice(q, 1, 3), lambda x: F.when(w < 0, -x).otherwise(x)), lambda v: scaled(v, w))
    return let(q, lambda q: let(F.get(q, F.lit(3)), lambda w: of(q, w)))


def quaternion_to_axis_angle(q: Column) -> Column:
    """Axis times angle; no rotation where the axis can't be told (1 - w^2 near 0)."""
    bounded = lambda q: F.least(F.greatest(F.get(q, F.lit(3)), F.lit(-1.0)), F.lit(1.0))
    den = lambda w: F.sqrt(F.greatest(1 - w * w, F.lit(0.0)))
    scaled = lambda x, w, d: F.when(d <= 1e-10, 0.0).otherwise(x * 2 * F.acos(w) / F.nullif(d, F.lit(0.0)))
    of = lambda q, w: let(den(w), lambda d: F.transform(F.slice(q, 1, 3), lambda x: scaled(x, w, d)))
    return let(q, lambda q: let(bounded(q), lambda w: of(q, w)))


def rotate(q: Column, v: Column) -> Column:
    """A vector turned by a quaternion."""
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    twice = lambda u, v: F.transform(cross(u, v), lambda x: 2 * x)
    of = lambda u, w, v: let(twice(u, v), lambda t: plus(plus(v, F.transform(t, lambda x: x * w)), cross(u, t)))
    return let(q, lambda q: let(v, lambda v: let(F.slice(q, 1, 3), lambda u: let(F.get(q, F.lit(3)), lambda w: of(u, w, v)))))


def six_to_columns(v: Column, eps: float = 1e-6) -> Column:
    """The three columns of the rotation whose first two are spanned by a 6-vector (Gram-Schmidt)."""
    unit = lambda a: let(a, lambda a: let(F.greatest(norm(a), F.lit(eps)), lambda n: F.transform(a, lambda k: k / n)))
    second = lambda x, b: let(dot(x, b), lambda d: unit(F.zip_with(b, x, lambda p, q: p - d * q)))
    of = lambda x, b: let(second(x, b), lambda y: F.array(x, y, cross(x, y)))
    return let(v, lambda v: let(unit(F.slice(v, 1, 3)), lambda x: of(x, F.slice(v, 4, 3))))


def columns_to_quaternion(m: Column) -> Column:
    """(x, y, z, w) of a rotation given by its three columns. The largest of the four is found from the diagonal, the others from it."""
    return let(m, _columns_to_quaternion)


def _columns_to_quaternion(m: Column) -> Column:
    c = lambda col, row: F.get(F.get(m, F.lit(col)), F.lit(row))
    d0, d1, d2 = c(0, 0), c(1, 1), c(2, 2)
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0))) / 2
    x, y, z, w = root(1 + d0 - d1 - d2), root(1 - d0 + d1 - d2), root(1 - d0 - d1 + d2), root(1 + d0 + d1 + d2)
    xy, xz, yz = (c(0, 1) + c(1, 0)) / 4, (c(0, 2) + c(2, 0)) / 4, (c(1, 2) + c(2, 1)) / 4
    wx, wy, wz = (c(1, 2) - c(2, 1)) / 4, (c(2, 0) - c(0, 2)) / 4, (c(0, 1) - c(1, 0)) / 4
    most = F.greatest(x, y, z, w)
    return (
        F.when(w == most, F.array(wx / w, wy / w, wz / w, w))
        .when(x == most, F.array(x, xy / x, xz / x, wx / x))
        .when(y == most, F.array(xy / y, y, yz / y, wy / y))
        .otherwise(F.array(xz / z, yz / z, z, wz / z))
    )


def nearest_turn(angle: Column, near: Column) -> Column:
    """The angle of a quaternion about a fixed axis by as many double turns as bring it nearest to ``near``: a quaternion holds its angle but for those."""
    return angle + F.round((near - angle) / (4 * math.pi)) * (4 * math.pi)


def pose_state(position: Column, quaternion: Column, gripper: Column) -> Column:
    return F.concat(position, quaternion_to_axis_angle(quaternion), F.array(gripper))


# Pixels as nested arrays (rows of pixels of channels).


def crop(image: Column, top: int, left: int, height: int, width: int) -> Column:
    return F.transform(F.slice(image, top + 1, height), lambda r: F.slice(r, left + 1, width))


def strided(image: Column, step: int) -> Column:
    every = lambda a: F.filter(a, lambda x, i: i % step == 0)
    return F.transform(every(image), every)


def channels_first(image: Column, n: int = 3) -> Column:
    """Rows of pixels in 0..255 as n planes in 0..1."""

    def plane(c: int) -> Column:
        return F.transform(image, lambda row: F.transform(row, lambda p: F.get(p, F.lit(c)) / 255.0))

    return F.array(*(plane(c) for c in range(n)))


def half_turn(image: Column) -> Column:
    return F.reverse(F.transform(image, lambda r: F.reverse(r)))


# Strings and times.


def clock_to_seconds(text: Column) -> Column:
    p = F.split(text, ":")
    return F.get(p, F.lit(0)).cast("int") * 60 + F.get(p, F.lit(1)).cast("int")


def seconds_to_clock(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)


def seconds_to_frame(seconds: Column, fps: float) -> Column:
    return (seconds * fps).cast("long")


def with_newline(task: Column) -> Column:
    return F.when(task.endswith("\n"), task).otherwise(F.concat(task, F.lit("\n")))


def near_any(times: Column, t: Column, tolerance: float = 1e-6) -> Column:
    """Index (from 0) of the first listed time within the tolerance, else -1."""
    return F.array_position(F.transform(times, lambda x: F.abs(x - t) <= tolerance), F.lit(True)) - 1


TURN = 2 * math.pi
