"""Random fields: densities of the Euler characteristic, intrinsic volumes of boxes, resels."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tails import norm_sf


def hermite(x: Column, n: int) -> Column:
    """The probabilists' Hermite polynomial of degree n."""
    a, b = F.lit(1.0), x
    if n == 0:
        return a
    for k in range(1, n):
        a, b = b, x * b - k * a
    return b


def ec_density(z: Column, k: int) -> Column:
    """Density of the Euler characteristic of a Gaussian field above z in dimension k, lengths in full widths at half maximum."""
    if k == 0:
        return norm_sf(z)
    return (4 * math.log(2)) ** (k / 2) / (2 * math.pi) ** ((k + 1) / 2) * hermite(z, k - 1) * F.exp(-z * z / 2)


def ec_density_t(t: Column, k: int, dof: float) -> Column:
    """As ec_density() for a Student field, in dimensions 1 to 3."""
    base = F.pow(1 + t * t / dof, F.lit((1 - dof) / 2))
    scale = (4 * math.log(2)) ** (k / 2)
    if k == 1:
        return scale / (2 * math.pi) * base
    ratio = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof / 2)
    if k == 2:
        return scale / (2 * math.pi) ** 1.5 * ratio * t * base
    if k == 3:
        return scale / (2 * math.pi) ** 2 * ((dof - 1) / dof * t * t - 1) * base
    raise ValueError("the dimension must be 1, 2 or 3")


def box_volumes(sides: list[float]) -> list[float]:
    """Intrinsic volumes of a box: the elementary symmetric functions of its sides."""
    return [sum(math.prod(c) for c in itertools.combinations(sides, k)) for k in range(len(sides) + 1)]


def ball_volumes(radius: float, dims: int) -> list[float]:
    """Intrinsic volumes of a ball."""
    unit = lambda n: math.pi ** (n / 2) / math.gamma(n / 2 + 1)
    return [math.comb(dims, k) * unit(dims) / unit(dims - k) * radius**k for k in range(dims + 1)]


def expected_ec(z: Column, volumes: list[float]) -> Column:
    """The expected Euler characteristic above z over a region with these intrinsic volumes in resels: an approximate p value of the maximum."""
    return sum((v * ec_density(z, k) for k, v in enumerate(volumes)), F.lit(0.0))


def resel2fwhm(resels: Column, dims: int = 3) -> Column:
    return F.sqrt(F.lit(4 * math.log(2))) * F.pow(F.when(resels > 0, 1 / resels).otherwise(0.0), F.lit(1.0 / dims))


def fwhm2resel(fwhm: Column, dims: int = 3) -> Column:
    return F.when(fwhm > 0, F.pow(math.sqrt(4 * math.log(2)) / fwhm, F.lit(float(dims)))).otherwise(0.0)
