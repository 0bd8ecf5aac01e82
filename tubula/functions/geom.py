"""Column functions on coordinates, vectors and affines. A vector is a tuple of three Columns, an affine
an array Column of 16 doubles in row order. Undefined angles are NULL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
#: Vessel classes in the order of their codes: fixed values.
CLASSES = ["other", "AA", "BT", "RCCA", "LCCA", "RSA", "LSA", "RVA", "LVA", "RICA", "LICA", "RECA", "LECA", "BA"]


def vec(prefix: str = "", names: str = "xyz") -> Vec:
    """Columns prefix+x, prefix+y, prefix+z."""
    return tuple(F.col(prefix + n) for n in names)


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def dist(a: Vec, b: Vec) -> Column:
    """Euclidean distance of two points."""
    return norm(sub(a, b))


def scale(a: Vec, k: Column) -> Vec:
    return tuple(c * k for c in a)


def unit(a: Vec, tiny: float = 1e-6) -> Vec:
    """a / |a|, the zero vector if |a| is at most tiny."""
    n = norm(a)
    return tuple(F.when(n > tiny, c / F.nullif(n, F.lit(0.0))).otherwise(0.0) for c in a)


def clamp(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def spherical(a: Vec) -> tuple[Column, Column, Column]:
    """Module, polar angle and azimuth; angles that aren't defined are NULL. Vectors in the plane z = 0
    have polar 0, vectors along z have no azimuth."""
    x, y, z = a
    flat = F.sqrt(x * x + y * y)
    none = (F.abs(x) < 1e-5) & (F.abs(y) < 1e-5)
    polar = F.when(F.abs(z) < 1e-5, F.when((F.abs(x) > 1e-5) | (F.abs(y) > 1e-5), 0.0)).otherwise(F.signum(z) * math.pi / 2 - F.atan(flat / F.nullif(z, F.lit(0.0))))
    azimuth = F.when(~none, F.signum(y) * F.acos(clamp(x / F.nullif(flat, F.lit(0.0)))))
    return norm(a), polar, azimuth


def direction_angles(a: Vec, b: Vec) -> tuple[Column, Column]:
    """Polar angle and azimuth of the unit vector from a to b; (0, 0) for equal points."""
    d = unit(sub(b, a), 0.0)
    rho = F.sqrt(d[0] * d[0] + d[1] * d[1])
    polar = F.when(norm(sub(b, a)) > 0, math.pi / 2 - F.acos(clamp(d[2]))).otherwise(0.0)
    return polar, F.when(rho > 0, F.signum(d[1]) * F.acos(clamp(d[0] / F.nullif(rho, F.lit(0.0))))).otherwise(0.0)


def cosine(u: Column, v: Column) -> Column:
    """Cosine similarity of two arrays of equal length; NULL if one is zero."""
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    return total(u, v) / F.nullif(F.sqrt(total(u, u)) * F.sqrt(total(v, v)), F.lit(0.0))


def to_ras(i: Column, j: Column, k: Column, affine: Column) -> Vec:
    """Point of a voxel index."""
    return tuple(affine[4 * r] * i + affine[4 * r + 1] * j + affine[4 * r + 2] * k + affine[4 * r + 3] for r in range(3))


def to_ijk(p: Vec, affine: Column, how: str = "none") -> Vec:
    """Voxel index of a point by the inverse of the affine; how: none, trunc or round (half to even). Affines along the axes
    take one division an axis: a product of spacings may put a point on a voxel's bound on its other side."""
    m = [[affine[4 * r + c] for c in range(3)] for r in range(3)]
    d = tuple(p[r] - affine[4 * r + 3] for r in range(3))
    cof = [[m[(r + 1) % 3][(c + 1) % 3] * m[(r + 2) % 3][(c + 2) % 3] - m[(r + 1) % 3][(c + 2) % 3] * m[(r + 2) % 3][(c + 1) % 3] for c in range(3)] for r in range(3)]
    det = F.nullif(m[0][0] * cof[0][0] + m[0][1] * cof[0][1] + m[0][2] * cof[0][2], F.lit(0.0))
    axial = reduce(lambda a, b: a & b, (m[r][c] == 0 for r in range(3) for c in range(3) if r != c))
    out = tuple(F.when(axial, F.when(det.isNotNull(), d[r] / m[r][r])).otherwise((cof[0][r] * d[0] + cof[1][r] * d[1] + cof[2][r] * d[2]) / det) for r in range(3))
    if how == "trunc":
        return tuple(F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("int") for c in out)
    return tuple(F.bround(c).cast("int") for c in out) if how == "round" else out


def axis_codes(affine: Column) -> Column:
    """Three letters for the directions of the voxel axes."""
    def letter(c: int) -> Column:
        x, y, z = affine[c], affine[4 + c], affine[8 + c]
        ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
        return (
            F.when((ax >= ay) & (ax >= az), F.when(x >= 0, "R").otherwise("L"))
            .when(ay >= az, F.when(y >= 0, "A").otherwise("P"))
            .otherwise(F.when(z >= 0, "S").otherwise("I"))
        )

    return F.concat(letter(0), letter(1), letter(2))


def lpi_corner(affine: Column, ni: Column, nj: Column) -> Vec:
    """Point of the voxel that lies farthest to the left, back and below: the origin for RAS, with the
    first axis flipped for LAS and the first two for LPS; other orientations are an error."""
    code = axis_codes(affine)
    i = F.when(code.isin("LAS", "LPS"), ni - 1).when(code == "RAS", 0).otherwise(F.raise_error(F.concat(F.lit("orientation "), code)).cast("int"))
    return to_ras(i, F.when(code == "LPS", nj - 1).otherwise(0), F.lit(0), affine)


def voxel_volume(affine: Column) -> Column:
    return F.abs(affine[0] * affine[5] * affine[10])


def si_span(affine: Column, nk: Column) -> Column:
    """Extent from below to above."""
    return F.abs(affine[10]) * nk


def affine_about(matrix: Column, centre: Vec) -> Column:
    """The 3 x 3 matrix (9 values) applied about a centre, as an affine of 16 values."""
    rows = []
    for r in range(3):
        m = [matrix[3 * r + c] for c in range(3)]
        rows += [*m, centre[r] - reduce(lambda a, b: a + b, [m[c] * centre[c] for c in range(3)])]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def flip_indices(i: Column, j: Column, k: Column, ni: Column, nj: Column, code: Column, target: str = "RAS") -> Vec:
    """Voxel indices in the target orientation, for codes that differ from it by flips of the first two axes."""
    return (
        F.when(F.substring(code, 1, 1) == target[0], i).otherwise(ni - 1 - i),
        F.when(F.substring(code, 2, 1) == target[1], j).otherwise(nj - 1 - j),
        k,
    )


def type_code(name: Column) -> Column:
    """Code of a vessel class name, NULL if unknown."""
    return F.nullif(F.array_position(F.array(*map(F.lit, CLASSES)), name), F.lit(0)) - 1


def type_vector(names: Column, high: Column | None = None, counter: Column | None = None) -> Column:
    """One slot for each class: 1 if it is among the names, 1 more if highlighted, 1 less if countered."""
    has = lambda own, n: F.when(F.array_contains(own, n), 1).otherwise(0)

    def slot(n: Column) -> Column:
        out = has(names, n)
        out = out + has(high, n) if high is not None else out
        return out - has(counter, n) if counter is not None else out

    return F.transform(F.array(*map(F.lit, CLASSES)), slot)


def plane_basis(normal: Vec) -> tuple[Vec, Vec]:
    """Two unit vectors that span the plane; the reference axis is x, or y if the normal is near x."""
    n = unit(normal)
    near = F.abs(n[0]) >= 0.9
    axis = (F.when(near, 0.0).otherwise(1.0), F.when(near, 1.0).otherwise(0.0), F.lit(0.0))
    u = unit(cross(n, axis))
    return u, cross(n, u)


def project_2d(p: Vec, origin: Vec, normal: Vec) -> tuple[Column, Column]:
    """Coordinates of a point in the plane's basis."""
    u, v = plane_basis(normal)
    d = sub(p, origin)
    return dot(d, u), dot(d, v)


def sinusoidal(position: Column, size: int) -> Column:
    """Sine and cosine encoding of a position, alternating, ``size`` values."""
    angle = lambda i: position / F.pow(F.lit(10000.0), (i - i % 2) / size)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))
