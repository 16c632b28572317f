"""Unit conversions and physical formulas as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units and the reservoir pressure (kPa) that results depend on.
KPA_TO_PSI = 0.145037738
BAR_TO_PSI = 14.5038
M3D_TO_STBD = 6.2898
M3D_TO_SCFD = 35.3147
RESERVOIR_KPA = 63000.0

FACTORS = {"kpa_psi": KPA_TO_PSI, "bar_psi": BAR_TO_PSI, "m3d_stbd": M3D_TO_STBD, "m3d_scfd": M3D_TO_SCFD}


def convert(c: Column, kind: str, inverse: bool = False) -> Column:
    """Multiply (or divide) by the factor of `kind`; an unknown kind is a KeyError."""
    return c / FACTORS[kind] if inverse else c * FACTORS[kind]


def guarded(c: Column, eps: float = 1e-6) -> Column:
    """Zero becomes eps."""
    return F.when(c == 0, eps).otherwise(c)


# Decline curves: productivity index, flowing pressure, reservoir pressure, step -> rate.
def _exponential(pi, pwf, p, tau, d=0.01, **_):
    return F.abs(pi * (p * F.exp(-d * tau) - pwf))


def _arps(pi, pwf, p, tau, d=0.01, b=0.5, **_):
    return F.abs(pi * (p / F.pow(1 + b * d * tau, F.lit(1.0 / b)) - pwf))


def _static(pi, pwf, p, tau, **_):
    return F.abs(pi * (p - pwf))


def _combined(*a, **k):
    return (_exponential(*a, **k) + _arps(*a, **k)) / 2


def _pressure_ensemble(*a, **k):
    return (_exponential(*a, **k) + _static(*a, **k)) / 2


def _weighted(*a, alpha=0.5, **k):
    return alpha * _pressure_ensemble(*a, **k) + (1 - alpha) * _exponential(*a, **k)


def _diffusivity(pi, pwf, p, tau, kappa=0.1, **_):
    return F.abs(pi * (p - pwf) * (1 - F.exp(-kappa * tau)))


DECLINES: dict[str, Callable[..., Column]] = {
    "exponential": _exponential,
    "arps": _arps,
    "static": _static,
    "combined": _combined,
    "pressure_ensemble": _pressure_ensemble,
    "weighted": _weighted,
    "diffusivity": _diffusivity,
}


def decline(name: str, pi: Column, pwf: Column, p: Column, tau: Column, **params: float) -> Column:
    """The named decline curve; an unknown name is a ValueError."""
    if name not in DECLINES:
        raise ValueError(f"unknown decline curve {name}; known: {', '.join(DECLINES)}")
    return DECLINES[name](pi, pwf, p, tau, **params)
