"""Spectral indices and classifiers as column expressions; bands are digital numbers (reflectance times 10,000)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clip, cos_degrees, divide, linear_scale, ln, log, num, sqrt

SCALE = 10_000.0

#: Upper bounds of the two-band vegetation index and the colours below them; the last colour is for all above (fixed values).
EVI2_RAMP = (
    (-1.1, (0, 0, 0)), (-0.2, (0.75, 0.75, 1)), (-0.1, (0.86, 0.86, 0.86)), (0.0, (1, 1, 0.88)), (0.025, (1, 0.98, 0.8)),
    (0.05, (0.93, 0.91, 0.71)), (0.075, (0.87, 0.85, 0.61)), (0.1, (0.8, 0.78, 0.51)), (0.125, (0.74, 0.72, 0.42)), (0.15, (0.69, 0.76, 0.38)),
    (0.175, (0.64, 0.8, 0.35)), (0.2, (0.57, 0.75, 0.32)), (0.25, (0.5, 0.7, 0.28)), (0.3, (0.44, 0.64, 0.25)), (0.35, (0.38, 0.59, 0.21)),
    (0.4, (0.31, 0.54, 0.18)), (0.45, (0.25, 0.49, 0.14)), (0.5, (0.19, 0.43, 0.11)), (0.55, (0.13, 0.38, 0.07)), (0.6, (0.06, 0.33, 0.04)),
    (None, (0, 0.27, 0)),
)


def dn(band: Column | str) -> Column:
    return num(band) / F.lit(SCALE)


def normalised_difference(a: Column | str, b: Column | str) -> Column:
    a, b = num(a), num(b)
    return divide(a - b, a + b)


def ndvi(nir: Column | str = "B08", red: Column | str = "B04") -> Column:
    return normalised_difference(nir, red)


def nbr(nir: Column | str = "B08", swir: Column | str = "B12") -> Column:
    return normalised_difference(nir, swir)


def pvir2() -> Column:
    return ndvi() + nbr()


def bai() -> Column:
    """Burned area index: 1 / ((0.1 - red)^2 + (0.06 - nir)^2)."""
    return divide(F.lit(1.0), (0.1 - dn("B04")) * (0.1 - dn("B04")) + (0.06 - dn("B08")) * (0.06 - dn("B08")))


def evi() -> Column:
    n, r, b = dn("B08"), dn("B04"), dn("B02")
    return divide(2.5 * (n - r), n + 6 * r - 7.5 * b + 1)


def evi_lai() -> Column:
    return 4.0543 * evi() + 1.7901


def evi2() -> Column:
    n, r = dn("B08"), dn("B04")
    return divide(2.4 * (n - r), n + r + 1)


def evi2_colours() -> dict[str, Column]:
    """red, green and blue of the ramp; nodata falls through to the last colour like any unmet condition."""
    value, out = evi2(), {}
    for i, name in enumerate(("red", "green", "blue")):
        ramp = None
        for bound, colour in EVI2_RAMP[:-1]:
            ramp = (F.when if ramp is None else ramp.when)(value < bound, F.lit(float(colour[i])))
        out[name] = ramp.otherwise(F.lit(float(EVI2_RAMP[-1][1][i])))
    return out


def arvi() -> Column:
    n, r, b = dn("B8A"), dn("B04"), dn("B02")
    g = 0.106 * (r - b)
    return divide((n - r) - g, (n + r) - g)


def bais2() -> Column:
    root = sqrt(divide(dn("B06") * dn("B07") * dn("B8A"), dn("B04")))
    return (1 - root) * (divide(dn("B12") - dn("B8A"), sqrt(dn("B12") + dn("B8A"))) + 1)


def bais2_colours() -> dict[str, Column]:
    """White below 0, blue to green up to 0.5, on to red up to 0.99, magenta above (fixed values); scaled to bytes."""
    v = bais2()
    ramps = {
        "red": (1.0, (0.0, 0.9803921569), (0.9803921569, 1.0), 1.0),
        "green": (1.0, (0.0, 1.0), (1.0, 0.0784313725), 0.0),
        "blue": (1.0, (1.0, 0.0392156863), (0.0392156863, 0.0784313725), 1.0),
    }
    out = {}
    for name, (below, low, high, above) in ramps.items():
        first = low[0] + (low[1] - low[0]) * v / 0.5
        second = high[0] + (high[1] - high[0]) * (v - 0.5) / 0.49
        value = F.when(v < 0, F.lit(below)).when(v < 0.5, first).when(v <= 0.99, second).otherwise(F.lit(above))
        out[name] = linear_scale(value, 0, 1, 0, 255)
    return out


def bsi() -> Column:
    a, b = dn("B11") + dn("B04"), dn("B08") + dn("B02")
    return divide(a - b, a + b)


def barren_soil() -> dict[str, Column]:
    return {"red": 2.5 * bsi(), "green": dn("B08"), "blue": dn("B11")}


def _cloud_terms() -> tuple[Column, Column, Column, Column]:
    """Brightness ratio, green-red difference, thick and thin cloud."""
    ratio = (dn("B03") - 0.175) / F.lit(0.39 - 0.175)
    ndgr = normalised_difference("B03", "B04")
    bright = dn("B11") > 0.1
    return ratio, ndgr, bright & (ratio > 1), bright & (ratio > 0) & (ndgr > 0)


def cloud_bcy() -> dict[str, Column]:
    """Colours of cloud detection by brightness: thick cloud bluish, thin cloud reddish, the rest brightened."""
    ratio, ndgr, thick, thin = _cloud_terms()
    half = {b: 0.5 * clip(dn(b), 0.0, 1.0) for b in ("B02", "B03", "B04")}
    red = F.when(thick, half["B04"]).when(thin, half["B04"] + 5 * sqrt(ratio * ndgr)).otherwise(2.5 * dn("B04"))
    green = F.when(thick | thin, half["B03"]).otherwise(2.5 * dn("B03"))
    blue = F.when(thick, half["B02"] + 0.5 * (ratio - 1)).when(thin, half["B02"]).otherwise(2.5 * dn("B02"))
    return {"red": clip(red, 0.0, 1.0), "green": clip(green, 0.0, 1.0), "blue": clip(blue, 0.0, 1.0)}


#: Where B08 lies between B04 and B11 on the wavelength axis (fixed value).
FAI_SLOPE = 0.17722052470761768


def fai() -> Column:
    return dn("B08") - (dn("B04") + (dn("B11") - dn("B04")) * FAI_SLOPE)


def aquatic_plants() -> dict[str, Column]:
    """Floating plants over water; clouds and land keep natural colours. Scaled to bytes."""
    _, _, thick, thin = _cloud_terms()
    water = normalised_difference("B03", "B08")
    moisture = normalised_difference("B8A", "B11")
    land = (water < 0) & (divide(water - moisture, water + moisture) > 0)
    plain = thick | thin | land
    shown = {"red": ("B04", 8.5 * fai()), "green": ("B03", 5.5 * normalised_difference("B05", "B04")), "blue": ("B02", water)}
    return {k: linear_scale(F.when(plain, 3 * dn(b)).otherwise(v), 0, 1, 0, 255) for k, (b, v) in shown.items()}


def fire_boundary() -> Column:
    c = divide(8.5 * (dn("B12") - dn("B11")), dn("B12") + dn("B11") + 0.25)
    ramp = F.when(c <= -1, F.lit(0.0)).when(c <= 1, 0.46295 * (c + 1)).when(c <= 3, 0.9259 + 0.03705 * (c - 1)).otherwise(F.lit(1.0))
    return linear_scale(ramp, 0, 1, 0, 255)


def wildfire_highlight(threshold: float = -0.25, lift: float = 0.3) -> dict[str, Column]:
    burnt = nbr() < threshold
    roots = {k: sqrt(dn(b)) for k, b in (("red", "B04"), ("green", "B03"), ("blue", "B02"))}
    return {k: F.when(burnt, v + lift).otherwise(v) if k != "blue" else v for k, v in roots.items()}


def ndsi() -> Column:
    return normalised_difference("B03", "B11")


def _bytes(of: dict[str, Column]) -> dict[str, Column]:
    return {k: linear_scale(v, 0, 1, 0, 255) for k, v in of.items()}


def ndsi_snow(threshold: float = 0.42, gain: float = 2.5) -> dict[str, Column]:
    snow = ndsi() > threshold
    shown = {"red": (0.0, "B04"), "green": (0.8, "B03"), "blue": (1.0, "B02")}
    return _bytes({k: F.when(snow, F.lit(v)).otherwise(gain * dn(b)) for k, (v, b) in shown.items()})


def snow_classifier(threshold: float = 0.4, gain: float = 2.5) -> dict[str, Column]:
    snow = ((ndsi() >= threshold) | (F.abs(ndvi() - 0.1) <= 0.025)) & (dn("B03") > 0.3)
    shown = {"red": (1.0, "B04"), "green": (0.8, "B03"), "blue": (0.4, "B02")}
    return _bytes({k: F.when(snow, F.lit(v)).otherwise(gain * dn(b)) for k, (v, b) in shown.items()})


def is_water(mndwi: float = 0.1, ndwi: float = 0.2, swi: float = 0.03) -> Column:
    short = divide(F.lit(1.0), sqrt(dn("B02") - dn("B11")))
    tests = (ndsi() > mndwi, normalised_difference("B03", "B08") > ndwi, short > swi)
    return F.coalesce(tests[0], F.lit(False)) | F.coalesce(tests[1], F.lit(False)) | F.coalesce(tests[2], F.lit(False))


def surface_water(mndwi: float = 0.1, ndwi: float = 0.2, swi: float = 0.03) -> dict[str, Column]:
    water = is_water(mndwi, ndwi, swi)
    shown = {"red": (0.0, "B04"), "green": (0.0, "B03"), "blue": (1.0, "B02")}
    return _bytes({k: F.when(water, F.lit(v)).otherwise(2 * dn(b)) for k, (v, b) in shown.items()})


def psri() -> Column:
    return F.when(dn("B06") > 0, divide(dn("B04") - dn("B02"), dn("B06"))).otherwise(F.lit(1.0))


def psri_ramp() -> Column:
    v = psri()
    return F.when(v <= -0.2, F.lit(0.0)).when(v <= 0.4, 0.9259 / 0.6 * (v + 0.2)).when(v <= 1.0, 0.9259 + 0.0741 / 0.6 * (v - 0.4)).otherwise(F.lit(1.0))


def urban_sar() -> dict[str, Column]:
    return _bytes({"red": F.when(5.5 * num("VH") > 0.5, F.lit(1.0)).otherwise(F.lit(0.0)), "green": num("VV"), "blue": 8 * num("VH")})


def natural_colour() -> dict[str, Column]:
    return {"red": 2.8 * dn("B04") + 0.1 * dn("B05"), "green": 2.8 * dn("B03") + 0.15 * dn("B08"), "blue": 2.8 * dn("B02")}


def lst_celsius(thermal: Column | str = "B10") -> Column:
    """Surface temperature from a thermal band's digital numbers (fixed scale and offset)."""
    return num(thermal) * 0.00341802 + 149.0 - 273.15


def decibel(x: Column | str) -> Column:
    return 10 * log(x, 10)


def kndvi() -> Column:
    """Kernel vegetation index: tanh of the squared index."""
    return F.tanh(ndvi() * ndvi())


def amwi() -> Column:
    """Acid mine water index as a normalised difference of red against blue."""
    return normalised_difference("B04", "B02")


def ndci() -> Column:
    """Chlorophyll difference on water pixels, else nodata."""
    return F.when(normalised_difference("B03", "B08") >= 0, normalised_difference("B05", "B04"))


def sar_ratio() -> Column:
    """30 * VH / VV."""
    return divide(30 * num("VH"), num("VV"))


def sar_level(x: Column | str) -> Column:
    """30 + 10 log10(x)."""
    return 30 + decibel(x)


def ppi(dvi: Column, dvi_max: Column, dvi_soil: Column, zenith_degrees: Column) -> Column:
    """Plant phenology index, 0 to 3: 0 below the soil line, 3 from the largest difference index up."""
    sza = cos_degrees(zenith_degrees)
    dc = F.least(0.0336 + divide(F.lit(0.0477), sza), F.lit(1.0))
    qe = dc + (1 - dc) * divide(F.lit(0.5), sza)
    top = F.least(dvi_max, F.lit(0.8))
    k = divide(F.lit(1.0), 4 * qe) * divide(1 + top, 1 - top)
    raw = -k * ln(divide(top - dvi, top - dvi_soil))
    value = F.when(dvi < dvi_soil, F.lit(0.0)).when(top <= dvi, F.lit(3.0)).otherwise(raw)
    return clip(value, 0.0, 3.0)


