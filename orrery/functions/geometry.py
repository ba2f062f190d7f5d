"""Vectors, rotations, projections and sampling as column expressions.

A vector is a tuple of three columns and a matrix three tuples of three; rotation matrices act
on row vectors (``v . R``) where a point is brought into a camera's frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 8.881784197001252e-16  # 4 * float epsilon: squared norms below it count as zero
MIST_RANGE = 128.0

Vector = tuple[Column, Column, Column]
Matrix = tuple[Vector, Vector, Vector]


def vector(*names: str) -> Vector:
    return tuple(F.col(n) for n in names)


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    """The vector at length 1; null for a zero vector."""
    length = norm(a)
    return tuple(F.when(length > 0, x / length) for x in a)


def row_times(v: Vector, m: Matrix) -> Vector:
    """``v . M``: the inverse rotation for an orthonormal matrix."""
    return tuple(v[0] * m[0][j] + v[1] * m[1][j] + v[2] * m[2][j] for j in range(3))


def times(m: Matrix, v: Vector) -> Vector:
    return tuple(dot(row, v) for row in m)


def matmul(a: Matrix, b: Matrix) -> Matrix:
    return tuple(row_times(row, b) for row in a)


def rotation(axis: str, degrees: Column) -> Matrix:
    """Rotation about x, y or z."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    one, zero = F.lit(1.0), F.lit(0.0)
    if axis == "x":
        return ((one, zero, zero), (zero, c, -s), (zero, s, c))
    if axis == "y":
        return ((c, zero, s), (zero, one, zero), (-s, zero, c))
    return ((c, -s, zero), (s, c, zero), (zero, zero, one))


def axis_angle(axis: Vector, radians: Column) -> Matrix:
    """Rotation about any axis (Rodrigues)."""
    u = unit(axis)
    c, s = F.cos(radians), F.sin(radians)
    skew = ((F.lit(0.0), -u[2], u[1]), (u[2], F.lit(0.0), -u[0]), (-u[1], u[0], F.lit(0.0)))
    return tuple(tuple((c if i == j else F.lit(0.0)) + (1 - c) * u[i] * u[j] + s * skew[i][j] for j in range(3)) for i in range(3))


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> Matrix:
    """Rotation matrix of a quaternion; the identity where its norm is practically zero."""
    n = w * w + x * x + y * y + z * z
    tiny = n < EPS
    s = 2.0 / n

    def cell(value: Column, identity: float) -> Column:
        return F.when(tiny, F.lit(identity)).otherwise(value)

    return (
        (cell(1 - s * (y * y + z * z), 1.0), cell(s * (x * y - z * w), 0.0), cell(s * (x * z + y * w), 0.0)),
        (cell(s * (x * y + z * w), 0.0), cell(1 - s * (x * x + z * z), 1.0), cell(s * (y * z - x * w), 0.0)),
        (cell(s * (x * z - y * w), 0.0), cell(s * (y * z + x * w), 0.0), cell(1 - s * (x * x + y * y), 1.0)),
    )


def euler_matrix(ax: Column, ay: Column, az: Column) -> Matrix:
    """Rotation matrix of static x-y-z angles in radians: Rz . Ry . Rx."""
    rx, ry, rz = (rotation(axis, F.degrees(a)) for axis, a in zip("xyz", (ax, ay, az), strict=True))
    return matmul(rz, matmul(ry, rx))


def euler_angles(m: Matrix, axes: str = "sxyz") -> Vector:
    """Angles in radians about an axis sequence: ``s`` (static) or ``r`` (rotating) and three axes.

    The sequence is known when the plan is made, so any of the 24 is a plain expression.
    """
    frame, names = axes[0], axes[1:]
    if frame == "r":
        names = names[::-1]
    i, j, last = ("xyz".index(n) for n in names)
    odd = (j - i) % 3 == 2
    k = 3 - i - j
    sign = -1 if odd else 1
    if last == i:  # the first axis comes twice
        size = F.sqrt(m[i][j] * m[i][j] + m[i][k] * m[i][k])
        regular = (F.atan2(m[i][j], m[i][k]), F.atan2(size, m[i][i]), F.atan2(m[j][i], -m[k][i]))
        locked = (F.atan2(-m[j][k], m[j][j]), F.atan2(size, m[i][i]), F.lit(0.0))
    else:
        size = F.sqrt(m[i][i] * m[i][i] + m[j][i] * m[j][i])
        regular = (F.atan2(m[k][j], m[k][k]), F.atan2(-m[k][i], size), F.atan2(m[j][i], m[i][i]))
        locked = (F.atan2(-m[j][k], m[j][j]), F.atan2(-m[k][i], size), F.lit(0.0))
    angles = [F.when(size > EPS, a).otherwise(b) * sign for a, b in zip(regular, locked, strict=True)]
    return tuple(angles[::-1] if frame == "r" else angles)


def depth(mist: Column) -> Column:
    """Metres of a 16-bit depth pixel."""
    return mist * F.lit(MIST_RANGE / 65536)


def in_frame(row: Column, column: Column, height: int, width: int) -> Column:
    """F2."""
    return (row >= 0) & (row < height) & (column >= 0) & (column < width)


def on_stride(row: Column, column: Column, stride: int = 4) -> Column:
    """F3."""
    return (row % stride == 0) & (column % stride == 0)


def depth_agrees(distance: Column, seen: Column, tolerance: float = 0.01, reach: float | None = 6.0) -> Column:
    """a point is where the depth image says, and near enough to be labelled."""
    agrees = F.abs(distance - seen) <= tolerance
    return agrees if reach is None else agrees & (seen <= reach)


def equirect_pixel(v: Vector, height: int, width: int) -> tuple[Column, Column]:
    """Row and column of a direction in a camera's frame in an equirectangular image.

    Image axes swap y and z. Angles are truncated towards zero before half the image is added.
    """
    x, y, z = v[0], v[2], v[1]
    length = F.sqrt(x * x + y * y + z * z)
    x, y, z = x / length, y / length, z / length
    down = -F.asin(y)
    ratio = z / F.cos(down)
    around = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    around = F.when(F.sin(around) * F.cos(down) * x < 0, -around).otherwise(around)
    row = (down * (height / math.pi)).cast("int").cast("double") + height / 2
    column = (around * (width / (2 * math.pi))).cast("int").cast("double") + width / 2
    return row.cast("int"), column.cast("int")


def equirect_point(row: Column, column: Column, height: int, width: int, radius: Column | float = 1.0) -> Vector:
    """The point at a distance that a pixel shows, in the camera's frame."""
    down, around = (row - height / 2) * (math.pi / height), (column - width / 2) * (2 * math.pi / width)
    radius = F.lit(radius) if not isinstance(radius, Column) else radius
    x, y, z = F.sin(around) * F.cos(down), -F.sin(down), F.cos(around) * F.cos(down)
    return x * radius, z * radius, y * radius


def pinhole_pixel(v: Vector, fov: Column, height: int, width: int) -> tuple[Column, Column, Column]:
    """x, y and whether the pixel is in the frame, of a point in a camera's frame.

    Points before the camera have z < 0; a field of view of pi or more has no pinhole image and
    gives nulls.
    """
    valid = (fov < math.pi) & (v[2] != 0)
    tangent = F.tan(fov / 2)
    x = F.when(valid, v[0] * (width / 2) / tangent / v[2] + width / 2).cast("int")
    y = F.when(valid, v[1] * (height / 2) / tangent / v[2] + height / 2).cast("int")
    return x, y, (x >= 0) & (x < width) & (y >= 0) & (y < height) & (v[2] < 0)


def view_parameters(spark, fovs=(75, 90, 105), yaw_step: int = 15, pitches=(-15, 0, 15), sizes=(800,), dedupe_yaw: bool = False) -> DataFrame:
    """The frames that a panorama is cut into (F16): 225 by default, where yaw -180 and 180 both count."""
    yaws = spark.range(-180, 180 if dedupe_yaw else 181, yaw_step).select(F.col("id").cast("int").alias("theta"))
    few = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} int")
    return few("fov", fovs).crossJoin(yaws).crossJoin(few("phi", pitches)).crossJoin(few("size", sizes))


def frame_rays(views: DataFrame) -> DataFrame:
    """Longitude and latitude, in degrees, of every frame pixel (fr, fc) of views (fov, theta, phi, size).

    A pixel's ray in the tangent plane is turned by theta about z and by -phi about the turned y
    axis.
    """
    rows = views.withColumn("fr", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).withColumn("fc", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    half = F.tan(F.radians(F.col("fov") / 2))
    span = F.greatest(F.col("size") - 1, F.lit(1))
    ray = (F.lit(1.0), (F.col("fc") / span * 2 - 1) * half, -(F.col("fr") / span * 2 - 1) * half)
    theta = F.radians("theta")
    turned = times(rotation("z", F.col("theta")), ray)
    x, y, z = times(axis_angle((-F.sin(theta), F.cos(theta), F.lit(0.0)), F.radians(-F.col("phi"))), turned)
    return rows.select("*", F.degrees(F.atan2(y, x)).alias("longitude"), F.degrees(F.asin(z / norm((x, y, z)))).alias("latitude"))


def frame_pixels(views: DataFrame, pano_height: int, pano_width: int) -> DataFrame:
    """The panorama pixel (pr, pc) that every frame pixel (fr, fc) shows, truncated."""
    centre_x, centre_y = (pano_width - 1) / 2, (pano_height - 1) / 2
    pc, pr = F.col("longitude") / 180 * centre_x + centre_x, -F.col("latitude") / 90 * centre_y + centre_y
    return frame_rays(views).withColumn("pr", pr.cast("int")).withColumn("pc", pc.cast("int")).drop("longitude", "latitude")


def midpoint(a: Vector, b: Vector, c: Vector) -> Vector:
    """Centre of a face's bounding box."""
    return tuple((F.least(x, y, z) + F.greatest(x, y, z)) / 2 for x, y, z in zip(a, b, c, strict=True))


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    """F18."""
    return norm(cross(minus(b, a), minus(c, a))) / 2


def hashed_unit(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone (in place of an unseeded generator)."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / F.lit(float(1 << 53))


def sample_face(a: Vector, b: Vector, c: Vector, key: tuple[Column, ...]) -> Vector:
    """A uniform point of a triangle."""
    u, v = F.sqrt(hashed_unit(*key, F.lit(1))), hashed_unit(*key, F.lit(2))
    return tuple((1 - u) * x + u * (1 - v) * y + u * v * z for x, y, z in zip(a, b, c, strict=True))


def truncated(value: Column, scale: int = 1000) -> Column:
    """The join key of a coordinate: truncated towards zero at 1 / scale."""
    return (value * scale).cast("bigint")


def clockwise_angle(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """F21, degrees; null where a vector has no length."""
    size = F.sqrt(a[0] * a[0] + a[1] * a[1]) * F.sqrt(b[0] * b[0] + b[1] * b[1])
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a[0] * b[1] - a[1] * b[0]) / size))
    return F.when(size > 0, -F.degrees(F.asin(sine)))
