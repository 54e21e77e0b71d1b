"""Scalar expressions: parsing and cleaning, map cells, association and overlap measures, envelope scores, blends, terrain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere's radius of web maps, and the latitude where its square map ends.
EARTH_RADIUS, MAX_MERCATOR_LAT = 6378137.0, 85.05112878


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def number(c: Column) -> Column:
    """A finite double, or null: text that is no number, NaN and infinities are missing."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def blank(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin("", "nan", "null", "undefined")


def valid_lat_lon(lat: Column, lon: Column) -> Column:
    """Numbers within the globe; missing ones are not valid."""
    return F.coalesce(number(lat).between(-90, 90) & number(lon).between(-180, 180), F.lit(False))


def within_uncertainty(unc: Column, scale: float, factor: float) -> Column:
    """False only where the uncertainty is known and larger than scale * factor; a factor of 0 turns the test off."""
    return F.lit(True) if factor <= 0 else F.coalesce(unc <= scale * factor, F.lit(True))


def normal_text(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def slug(c: Column) -> Column:
    """Letters, digits, dots, dashes and underscores; anything else is one underscore, and none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_"), "_+", "_")
    return F.regexp_replace(s, r"^[._]+|[._]+$", "")


def path_part(c: Column) -> Column:
    """A folder name that any file system takes."""
    s = F.trim(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]+', "_"), r"\s+", " "))
    s = F.regexp_replace(s, r"[. ]+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("_")).when(F.upper(s).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("_"), s)).otherwise(s)


def species_label(genus: Column, species: Column) -> Column:
    """The species' name, with the genus before it unless it begins with that."""
    return F.when(F.lower(species).startswith(F.concat(F.lower(genus), F.lit(" "))), species).otherwise(F.concat_ws(" ", genus, species))


def mercator_cell(lon: Column, lat: Column, size: float, px: float = 0.0, py: float = 0.0) -> tuple[Column, Column]:
    """(cx, cy) of a square map grid of `size` metres, moved by a share of a cell."""
    y = F.greatest(F.lit(-MAX_MERCATOR_LAT), F.least(F.lit(MAX_MERCATOR_LAT), lat))
    mx = F.lit(EARTH_RADIUS) * F.radians(lon)
    my = F.lit(EARTH_RADIUS) * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(y) / 2))
    return F.floor((mx - px * size) / size).cast("long"), F.floor((my - py * size) / size).cast("long")


def association(s: Column, a: Column, b: Column, t: Column) -> dict[str, Column]:
    """Measures of two groups that share s of t cells, with a and b cells of their own."""
    s, a, b, t = (x.cast("double") for x in (s, a, b, t))
    lift = (s * t) / (a * b)
    npmi = F.when(s == t, F.lit(0.0)).otherwise(F.log(lift) / -F.log(F.when(s < t, s / t)))
    shrink = s / (s + 5)
    cond = (s + 1) / (a + 2)
    more = F.when(lift > 1, F.log(lift) / (1 + F.log(lift))).otherwise(0.0)
    return {
        "p_b_given_a": s / a,
        "p_a_given_b": s / b,
        "cond": cond,
        "rev": (s + 1) / (b + 2),
        "jaccard": s / (a + b - s),
        "overlap": s / F.least(a, b),
        "lift": lift,
        "npmi": npmi,
        "score": shrink * (0.55 * F.greatest(F.lit(0.0), npmi) + 0.30 * cond + 0.15 * more),
    }


def interval_overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    span = F.greatest(hi1, hi2) - F.least(lo1, lo2)
    return F.when(span <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2)) / F.when(span > 0, span))


def proximity(a: Column, b: Column, span: Column) -> Column:
    return F.when(span <= 0, F.when(a == b, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.when(span > 0, span)))


def close(a: Column, b: Column) -> Column:
    """Equal but for rounding."""
    return F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def trapezoid(x: Column, lo: Column, q25: Column, q75: Column, hi: Column) -> Column:
    """0 outside lo..hi, 1 from q25 to q75, straight between; a range of one value takes what is equal but for rounding."""
    up = (x - lo) / F.when(q25 > lo, q25 - lo)
    down = (hi - x) / F.when(hi > q75, hi - q75)
    inner = F.when((x >= q25) & (x <= q75), 1.0).when(x < q25, up).otherwise(down)
    return F.when(x.isNull(), None).when(hi <= lo, F.when(close(x, lo), 1.0).otherwise(0.0)).when((x < lo) | (x > hi), 0.0).otherwise(inner)


def reliability(x: Column, lo: Column, q25: Column, q75: Column, hi: Column, novelty: float = 1.0) -> Column:
    """1 within lo..hi, falling with the distance beyond, in units of the spread."""
    distance = F.greatest(lo - x, x - hi, F.lit(0.0))
    scale = F.greatest(q75 - q25, 0.1 * (hi - lo), F.lit(1e-12)) * max(0.05, novelty)
    return 1 / (1 + distance / scale)


def sharpened(x: Column, power: float, floor: float) -> Column:
    return floor + (1 - floor) * F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), F.lit(power))


def gate(base: Column, ml: Column, floor: float = 0.35, power: float = 0.5) -> Column:
    return base * sharpened(ml, power, floor)


def mix(base: Column, ml: Column, share: float = 0.3) -> Column:
    return (1 - share) * base + share * ml


def geometric(base: Column, ml: Column, floor: float = 0.35) -> Column:
    return F.sqrt(F.when(base * F.greatest(ml, F.lit(floor)) >= 0, base * F.greatest(ml, F.lit(floor))))


def northness(aspect: Column) -> Column:
    return F.cos(F.radians(aspect))


def eastness(aspect: Column) -> Column:
    return F.sin(F.radians(aspect))


def wetness_index(slope_deg: Column, area: Column) -> Column:
    return F.log((F.greatest(area, F.lit(0.0)) + 1) / F.greatest(F.tan(F.radians(slope_deg)), F.lit(1e-6)))
