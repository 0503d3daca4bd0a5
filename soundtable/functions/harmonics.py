"""Real SN3D spherical harmonics as tables, computed while the plan is built."""

from __future__ import annotations

import math
from functools import cache

from numpy.polynomial import Legendre, Polynomial


def degree(k: int) -> int:
    return math.isqrt(k)


def order(k: int) -> int:
    return k - degree(k) ** 2 - degree(k)


@cache
def _derivative(l: int, m: int) -> Legendre:
    return Legendre.basis(l).deriv(m) if m else Legendre.basis(l)


def harmonic(k: int, az: float, el: float) -> float:
    """Y of ACN k at azimuth (positive left) and elevation in radians, without the alternating sign."""
    l, m = degree(k), abs(order(k))
    legendre = math.cos(el) ** m * float(_derivative(l, m)(math.sin(el)))
    norm = math.sqrt((2 if m else 1) * math.factorial(l - m) / math.factorial(l + m))
    return norm * legendre * (math.sin(m * az) if order(k) < 0 else math.cos(m * az))


def at_vector(k: int, x: float, y: float, z: float) -> float:
    """Y of ACN k towards right, front, up."""
    return harmonic(k, math.atan2(-x, y), math.atan2(z, math.hypot(x, y)))


def sphere(n: int) -> list[tuple[float, float, float]]:
    """n directions spread evenly along a golden-angle spiral from the zenith down."""
    golden = math.pi * (3 - math.sqrt(5))
    heights = [1 - (2 * i + 1) / n for i in range(n)]
    return [(math.sqrt(1 - z * z) * math.cos(golden * i), math.sqrt(1 - z * z) * math.sin(golden * i), z) for i, z in enumerate(heights)]


#: Azimuth (here positive to the right) and elevation of the speakers of each layout.
LAYOUTS = {
    "5.1": [("L", -30, 0), ("R", 30, 0), ("C", 0, 0), ("Ls", -110, 0), ("Rs", 110, 0)],
    "7.1": [("L", -30, 0), ("R", 30, 0), ("C", 0, 0), ("Lss", -90, 0), ("Rss", 90, 0), ("Lrs", -150, 0), ("Rrs", 150, 0)],
}
LAYOUTS["7.1.4"] = [*LAYOUTS["7.1"], ("Ltf", -45, 45), ("Rtf", 45, 45), ("Ltr", -135, 45), ("Rtr", 135, 45)]
LAYOUTS["9.1.6"] = [*LAYOUTS["7.1"], ("Lw", -60, 0), ("Rw", 60, 0), ("Ltf", -45, 45), ("Rtf", 45, 45), ("Ltm", -90, 45), ("Rtm", 90, 45), ("Ltr", -135, 45), ("Rtr", 135, 45)]


def speakers(layout: str | int) -> list[tuple[str, float, float, float]]:
    """(label, right, front, up) of a named layout, or of so many directions of the sphere."""
    if isinstance(layout, int):
        return [(str(i), *d) for i, d in enumerate(sphere(layout))]
    turned = [(label, math.radians(az), math.radians(el)) for label, az, el in LAYOUTS[layout]]
    return [(label, math.sin(az) * math.cos(el), math.cos(az) * math.cos(el), math.sin(el)) for label, az, el in turned]


def basis(layout: str | int, channels: int) -> list[list[float]]:
    return [[at_vector(k, x, y, z) for k in range(channels)] for _, x, y, z in speakers(layout)]


#: Labels of predicted decodes by azimuth (here positive to the left) and elevation, without the low-frequency speaker.
PREDICTED = {
    "2.0": [("M+030", 30, 0), ("M-030", -30, 0)],
    "5.1": [("M+030", 30, 0), ("M-030", -30, 0), ("M+000", 0, 0), ("M+110", 110, 0), ("M-110", -110, 0)],
    "7.1": [("M+030", 30, 0), ("M-030", -30, 0), ("M+000", 0, 0), ("M+090", 90, 0), ("M-090", -90, 0), ("M+135", 135, 0), ("M-135", -135, 0)],
}
PREDICTED["7.1.4"] = [*PREDICTED["7.1"], ("U+045", 45, 45), ("U-045", -45, 45), ("U+135", 135, 45), ("U-135", -135, 45)]


def predicted_speakers(layout: str) -> list[tuple[str, float, float, float]]:
    """(label, right, front, up) of a layout of predicted decodes."""
    turned = [(label, math.radians(az), math.radians(el)) for label, az, el in PREDICTED[layout]]
    return [(label, -math.sin(az) * math.cos(el), math.cos(az) * math.cos(el), math.sin(el)) for label, az, el in turned]


def legendre_sum(order: int) -> list[float]:
    """Coefficients, constant first, of the sum of the Legendre polynomials up to an order."""
    return [float(c) for c in Legendre([1.0] * (order + 1)).convert(kind=Polynomial).coef]


def legendre_derivative(l: int, m: int) -> list[float]:
    """Coefficients, constant first, of the m-th derivative of the Legendre polynomial of degree l."""
    return [float(c) for c in _derivative(l, m).convert(kind=Polynomial).coef]
