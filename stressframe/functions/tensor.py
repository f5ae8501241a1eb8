"""Stress, strain and vector algebra as Column expressions, all inside code generation.

A tensor is six Columns (xx, yy, zz, xy, yz, zx), a vector three. NULL stays NULL.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this second deviator invariant a stress counts as hydrostatic; shorter vectors have no direction.
TINY_J2, TINY_LENGTH = 1e-20, 1e-12


class Vector(NamedTuple):
    """Three components."""

    x: Column
    y: Column
    z: Column

    def __add__(self, o: Vector) -> Vector:  # type: ignore[override]
        return Vector(*(a + b for a, b in zip(self, o, strict=True)))

    def __sub__(self, o: Vector) -> Vector:
        return Vector(*(a - b for a, b in zip(self, o, strict=True)))

    def scale(self, k: Column | float) -> Vector:
        return Vector(*(a * k for a in self))

    def divide(self, k: Column | float) -> Vector:
        k = k if isinstance(k, Column) else F.lit(float(k))
        return Vector(*(F.when(k != 0, F.try_divide(a, k)) for a in self))

    def dot(self, o: Vector) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vector) -> Vector:
        return Vector(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def length(self) -> Column:
        return F.sqrt(self.dot(self))

    def normalized(self) -> Vector:
        """Unit vector; zero where the length is next to nothing."""
        n = self.length()
        return Vector(*(F.when(n > TINY_LENGTH, F.try_divide(a, n)).when(n.isNotNull(), 0.0) for a in self))

    def angle(self, o: Vector) -> Column:
        """Degrees between two vectors; NULL where one has no direction."""
        n = self.length() * o.length()
        return F.when(n > TINY_LENGTH, F.degrees(F.acos(clamp(F.try_divide(self.dot(o), n), -1.0, 1.0))))

    def least(self, o: Vector) -> Vector:
        return Vector(*(F.least(a, b) for a, b in zip(self, o, strict=True)))

    def greatest(self, o: Vector) -> Vector:
        return Vector(*(F.greatest(a, b) for a, b in zip(self, o, strict=True)))

    def lerp(self, o: Vector, t: Column | float) -> Vector:
        return Vector(*(a + (b - a) * t for a, b in zip(self, o, strict=True)))


class Tensor(NamedTuple):
    """A symmetric tensor."""

    xx: Column
    yy: Column
    zz: Column
    xy: Column
    yz: Column
    zx: Column

    def __add__(self, o: Tensor) -> Tensor:  # type: ignore[override]
        return Tensor(*(a + b for a, b in zip(self, o, strict=True)))

    def __sub__(self, o: Tensor) -> Tensor:
        return Tensor(*(a - b for a, b in zip(self, o, strict=True)))

    def scale(self, k: Column | float) -> Tensor:
        return Tensor(*(a * k for a in self))

    def is_zero(self, tolerance: float = 1e-12) -> Column:
        return F.greatest(*(F.abs(a) for a in self)) < tolerance

    def mean(self) -> Column:
        return (self.xx + self.yy + self.zz) / 3

    def pressure(self) -> Column:
        return -self.mean()

    def deviator(self) -> Tensor:
        m = self.mean()
        return Tensor(self.xx - m, self.yy - m, self.zz - m, self.xy, self.yz, self.zx)

    def double_dot(self, o: Tensor) -> Column:
        return self.xx * o.xx + self.yy * o.yy + self.zz * o.zz + 2 * (self.xy * o.xy + self.yz * o.yz + self.zx * o.zx)

    def i1(self) -> Column:
        return self.xx + self.yy + self.zz

    def i2(self) -> Column:
        return self.xx * self.yy + self.yy * self.zz + self.zz * self.xx - self.xy * self.xy - self.yz * self.yz - self.zx * self.zx

    def i3(self) -> Column:
        return self.xx * self.yy * self.zz + 2 * self.xy * self.yz * self.zx - self.xx * self.yz * self.yz - self.yy * self.zx * self.zx - self.zz * self.xy * self.xy

    def j2(self) -> Column:
        d = self.deviator()
        return d.double_dot(d) / 2

    def j3(self) -> Column:
        return self.deviator().i3()

    def von_mises(self) -> Column:
        return F.sqrt(3 * self.j2())

    def signed_von_mises(self) -> Column:
        return F.when(self.mean() < 0, -self.von_mises()).otherwise(self.von_mises())

    def principals(self) -> tuple[Column, Column, Column]:
        """Largest, middle and least principal value, by the Lode angle."""
        m, j2 = self.mean(), self.j2()
        cosine = clamp(F.try_divide(self.j3() * (3 * math.sqrt(3) / 2), F.pow(j2, 1.5)), -1.0, 1.0)
        theta, radius = F.acos(cosine) / 3, 2 * F.sqrt(j2 / 3)
        turns = (0.0, -2 * math.pi / 3, 2 * math.pi / 3)
        return tuple(F.when(j2 < TINY_J2, m).otherwise(m + radius * F.cos(theta + t)) for t in turns)  # type: ignore[return-value]

    def max_shear(self) -> Column:
        largest, _, least = self.principals()
        return (largest - least) / 2

    def traction(self, n: Vector) -> Vector:
        return Vector(self.xx * n.x + self.xy * n.y + self.zx * n.z, self.xy * n.x + self.yy * n.y + self.yz * n.z, self.zx * n.x + self.yz * n.y + self.zz * n.z)

    def normal(self, n: Vector) -> Column:
        return self.traction(n).dot(n)

    def shear(self, n: Vector) -> Column:
        t, s = self.traction(n), self.normal(n)
        return F.sqrt(F.greatest(t.dot(t) - s * s, F.lit(0.0)))

    def shear_vector(self, n: Vector) -> Vector:
        return self.traction(n) - n.scale(self.normal(n))

    def rotate(self, ex: Vector, ey: Vector, ez: Vector) -> Tensor:
        """Components along new unit axes."""
        return Tensor(self.normal(ex), self.normal(ey), self.normal(ez), self.traction(ex).dot(ey), self.traction(ey).dot(ez), self.traction(ez).dot(ex))

    def strain_von_mises(self) -> Column:
        """Equivalent strain of tensor (not engineering) shear components."""
        d = self.deviator()
        return F.sqrt(d.double_dot(d) * (2 / 3))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def hydrostatic(p: Column) -> Tensor:
    zero = p * 0
    return Tensor(p, p, p, zero, zero, zero)


def uniaxial(s: Column) -> Tensor:
    zero = s * 0
    return Tensor(s, zero, zero, zero, zero, zero)


def pure_shear(t: Column) -> Tensor:
    zero = t * 0
    return Tensor(zero, zero, zero, t, zero, zero)


def vector(prefix: str, names: tuple[str, str, str] = ("x", "y", "z")) -> Vector:
    """Vector of three columns that share a prefix."""
    return Vector(*(F.col(prefix + n) for n in names))


STRESS = ("sxx", "syy", "szz", "txy", "tyz", "tzx")
STRAIN = ("exx", "eyy", "ezz", "exy", "eyz", "ezx")


def stress() -> Tensor:
    return Tensor(*map(F.col, STRESS))


def strain() -> Tensor:
    return Tensor(*map(F.col, STRAIN))


def with_principals(df: DataFrame, names: tuple[str, ...], p: str) -> DataFrame:
    """``df`` and the largest and least principal values <p>1 and <p>3 and the second invariant <p>j2 of six columns, in steps, so that no expression is built into another many times."""
    held = [F.col(f"`{c}`") for c in df.columns]
    t = Tensor(*(F.col(c) for c in names))
    df = df.select(*held, t.mean().alias("__m"))
    d = Tensor(*(F.col(c) - F.col("__m") if c in names[:3] else F.col(c) for c in names))
    df = df.select(*held, "__m", ((d.xx * d.xx + d.yy * d.yy + d.zz * d.zz) / 2 + d.xy * d.xy + d.yz * d.yz + d.zx * d.zx).alias(f"{p}j2"), d.i3().alias("__j3"))
    m, j2 = F.col("__m"), F.col(f"{p}j2")
    df = df.select(*held, "__m", f"{p}j2", (F.acos(clamp(F.try_divide(F.col("__j3") * (3 * math.sqrt(3) / 2), F.pow(j2, 1.5)), -1.0, 1.0)) / 3).alias("__angle"), (2 * F.sqrt(j2 / 3)).alias("__radius"))
    at = lambda turn: F.when(j2 < TINY_J2, m).otherwise(m + F.col("__radius") * F.cos(F.col("__angle") + turn))
    return df.select(*held, f"{p}j2", at(0.0).alias(f"{p}1"), at(2 * math.pi / 3).alias(f"{p}3"))


def with_face_stress(df: DataFrame) -> DataFrame:
    """``df`` and the normal and shear stress on the unit normal nx, ny, nz, in steps like ``with_principals``."""
    held, n = [F.col(f"`{c}`") for c in df.columns], Vector(F.col("nx"), F.col("ny"), F.col("nz"))
    t = stress().traction(n)
    df = df.select(*held, t.x.alias("__tx"), t.y.alias("__ty"), t.z.alias("__tz"))
    t = Vector(F.col("__tx"), F.col("__ty"), F.col("__tz"))
    df = df.select(*held, t.dot(n).alias("normal"), t.dot(t).alias("__tt"))
    return df.select(*held, "normal", F.when(F.col("normal").isNotNull(), F.sqrt(F.greatest(F.col("__tt") - F.col("normal") * F.col("normal"), F.lit(0.0)))).alias("shear"))
