"""Column expressions on single points; inputs and results are doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgelight.constants import EINS_FACTOR, ETOK, KTOE

NAN = float("nan")


def ratio(a: Column, b: Column) -> Column:
    """a / b; a zero divisor gives a bad sample (NaN), not an error."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a / b)


def log_ratio(a: Column, b: Column) -> Column:
    r = ratio(a, b)
    return F.when(r > 0, F.ln(r)).otherwise(F.lit(NAN))


def mu_transmission(i0: Column, it: Column) -> Column:
    return log_ratio(i0, it)


def mu_reference(it: Column, iref: Column) -> Column:
    return log_ratio(it, iref)


def mu_fluorescence(i0: Column, *channels: Column) -> Column:
    if not channels:
        raise ValueError("no fluorescence channels")
    total = channels[0]
    for c in channels[1:]:
        total = total + c
    return ratio(total, i0)


def channel_sum(a: Column, b: Column) -> Column:
    """Sum of two channel arrays; the shorter one stops contributing."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def name_from_path(path: Column) -> Column:
    """File stem; a numeric extension is folded in as stem_NNN."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    stem, ext = F.regexp_extract(base, r"^(.+)\.([^.]*)$", 1), F.regexp_extract(base, r"^(.+)\.([^.]*)$", 2)
    return F.when(stem == "", base).when(F.regexp_like(ext, F.lit("^[0-9]+$")), F.concat_ws("_", stem, ext)).otherwise(stem)


def k_weight(k: Column, chi: Column, w: int) -> Column:
    return chi * F.pow(k, F.lit(float(w)))


def k_of_e(e: Column, e0: Column | float) -> Column:
    d = e - e0
    return F.when(d < 0, F.lit(0.0)).otherwise(F.sqrt(F.abs(d) * F.lit(ETOK)))


def e_of_k(k: Column) -> Column:
    return k * k * F.lit(KTOE)


def signed_k(e: Column, e0: Column | float) -> Column:
    d = e - e0
    return F.signum(d) * F.sqrt(F.lit(ETOK) * F.abs(d))


def arctan_step(e: Column, amp: float, center: float, sigma: float) -> Column:
    sign = -1.0 if sigma < 0 else 1.0
    return F.lit(amp) * (0.5 + F.atan(F.lit(sign) * (e - center) / F.lit(max(1e-30, abs(sigma)))) / math.pi)


def gaussian(x: Column, center: float, sigma: float) -> Column:
    s = max(1e-15, sigma)
    d = (x - center) / s
    return F.exp(-d * d / 2) / F.lit(s * math.sqrt(2 * math.pi))


def lorentzian(x: Column, center: float, sigma: float) -> Column:
    s = max(1e-15, sigma)
    d = (x - center) / s
    return F.lit(1.0) / ((1 + d * d) * F.lit(math.pi * s))


def polar(re: Column, im: Column) -> tuple[Column, Column]:
    return F.hypot(re, im), F.atan2(im, re)


def powder_mass(absorbance: Column, area: Column, mu_rho: Column) -> Column:
    """Milligrams for an absorbance over an area, from a supplied mass attenuation."""
    return ratio(absorbance * area, mu_rho) * 1000


def reduced_mass(masses: Column) -> Column:
    return 1.0 / F.aggregate(masses, F.lit(0.0), lambda s, m: s + 1.0 / F.greatest(F.lit(1.0), m))


def sigma2_einstein(t: Column, theta: Column, mass: Column) -> Column:
    """Einstein mean square displacement at t for temperature theta and reduced mass."""
    x = theta / (2 * t)
    coth = (F.exp(x) + F.exp(-x)) / (F.exp(x) - F.exp(-x))
    return F.lit(EINS_FACTOR) * coth / (theta * F.greatest(mass, F.lit(0.1)))


def fortran_e(x: Column) -> Column:
    """E13.7 with the mantissa in [0.1, 1): a negative number drops its leading zero; zero and non-finite are 0.0000000E+00."""
    a = F.abs(x)
    text = F.format_string("%.6e", a)  # d.dddddde[+-]xx
    digits, power = F.regexp_replace(F.substring_index(text, "e", 1), r"\.", ""), F.substring_index(text, "e", -1).cast("int") + 1
    sign = F.when(power < 0, "-").otherwise("+")
    body = F.concat(F.lit("."), digits, F.lit("E"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    bad = F.isnan(x) | (a == float("inf")) | (x == 0) | x.isNull()
    return F.when(bad, "0.0000000E+00").when(x < 0, F.concat(F.lit("-"), body)).otherwise(F.concat(F.lit("0"), body))
