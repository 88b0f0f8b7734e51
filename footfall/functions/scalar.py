"""Column expressions: distances, decay, scoring terms and small text helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den, default=None) -> Column:
    """num / den, with ``default`` (NULL) where the denominator is zero or missing."""
    out = F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


def clip(x, lo: float | None = None, hi: float | None = None) -> Column:
    out = _c(x)
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return out if hi is None else F.least(out, F.lit(hi))


def or_default(x, default) -> Column:
    """The value, or ``default`` where it is missing or zero."""
    x = _c(x)
    return F.when(x.isNull() | (x == 0), F.lit(default)).otherwise(x)


def haversine_m(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat = (p2 - p1) / 2
    half_lon = F.radians(_c(lon2) - _c(lon1)) / 2
    chord2 = F.pow(F.sin(half_lat), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), F.lit(2.0))
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.greatest(chord2, F.lit(0.0)), F.lit(1.0))))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2, EARTH_RADIUS_M / 1000)


def unit_xyz(lat, lon) -> Column:
    """Point on the unit sphere as a struct."""
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    return F.struct(
        (F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z")
    )


def chord(metres) -> Column:
    """Straight-line distance on the unit sphere of an arc of ``metres``."""
    return 2 * F.sin(_c(metres) / F.lit(2 * EARTH_RADIUS_M))


def seconds_between(later, earlier) -> Column:
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / F.lit(1_000_000.0)


def age_days(ts, as_of: Column, whole: bool = False) -> Column:
    days = seconds_between(as_of, ts) / F.lit(86400.0)
    return F.floor(days) if whole else days


def decay(age_in_days, lam: float = 0.5) -> Column:
    """exp(-lam x years)."""
    return F.exp(F.lit(-lam) * _c(age_in_days) / F.lit(365.0))


def proximity_exp(metres, scale: float = 30.0) -> Column:
    return F.exp(-_c(metres) / F.lit(scale))


def proximity_linear(metres, radius: float) -> Column:
    return 1 - _c(metres) / F.lit(radius)


def distance_decay(dist_km, range_km) -> Column:
    """Logistic acceptance of a distance given a personal range of at least 2 km; huge ranges give 1."""
    exponent = F.greatest(_c(range_km), F.lit(2.0)) / 2 - _c(dist_km)
    # exp overflows a double above 709, where the share is 1 to full precision.
    grown = F.exp(F.least(exponent, F.lit(700.0)))
    return clip(grown / (1 + grown), 0.0, 1.0)


def drive_minutes(dist_km, offset: float = 2.0, speed_kmh: float = 30.0) -> Column:
    return _c(dist_km) / F.lit(speed_kmh) * 60 + F.lit(offset)


def ride_cost_factor(dist_km, per_minute: float = 1.5, budget: float = 100.0) -> Column:
    return F.greatest(F.lit(0.0), 1 - drive_minutes(dist_km, 5.0) * F.lit(per_minute) / F.lit(budget))


def queue_factor(busyness, tolerance: float = 60.0, floor: float = 0.75) -> Column:
    b = F.coalesce(_c(busyness).cast("double"), F.lit(0.0))
    return F.when(b <= tolerance, F.lit(1.0)).otherwise(F.greatest(F.lit(floor), 1 - (b - tolerance) / 200.0))


def rating_fit(venue_rating, user_rating, scale: float = 5.0) -> Column:
    return 1 - F.least(F.lit(1.0), F.abs(_c(venue_rating) - _c(user_rating)) / F.lit(scale))


def context_score(busyness, venue_rating, user_rating) -> Column:
    return clip(queue_factor(busyness) * rating_fit(venue_rating, user_rating), 0.0, 1.0)


def critic_penalty(tag, user_rating, venue_rating, lam: float = 0.20) -> Column:
    gap = _c(user_rating) - _c(venue_rating)
    return F.when(
        (_c(tag) == "Critic") & (gap > 0), F.greatest(F.lit(0.0), 1 - F.lit(lam) * gap / 2)
    ).otherwise(F.lit(1.0))


def tokens(text, sep: str = ",") -> Column:
    """Trimmed non-empty parts of a separated list; NULL gives an empty array."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), sep)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def token_jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), 0.0)


def ellipsis(text, n: int = 25) -> Column:
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def short_label(name, city, n: int = 25) -> Column:
    """Name cut to ``n`` characters, with the city."""
    return F.concat(ellipsis(name, n), F.lit(" ("), _c(city), F.lit(")"))


def city_token(text) -> Column:
    """The part before the first comma; the whole text when that part is empty."""
    t = F.coalesce(_c(text), F.lit(""))
    first = F.trim(F.element_at(F.split(t, ","), 1))
    return F.when(first != "", first).otherwise(F.trim(t))


def contains_any(text, words) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])


def alias_lookup(text, aliases: dict[str, str]) -> Column:
    """Replace a known alias (case-insensitive) and keep anything else."""
    if not aliases:
        return F.trim(_c(text))
    table = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k.lower().strip(), v.strip())])
    return F.trim(F.coalesce(F.try_element_at(table, F.lower(F.trim(_c(text)))), _c(text)))


def parse_utc(text, offset_minutes=None) -> Column:
    """'Tue Apr 03 18:00:09 +0000 2012' as a timestamp, optionally moved by an offset in minutes."""
    # The weekday name is redundant and Spark refuses it when parsing.
    ts = F.try_to_timestamp(F.substring(_c(text), 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return ts if offset_minutes is None else shift_minutes(ts, offset_minutes)


def shift_minutes(ts, minutes) -> Column:
    return _c(ts) + F.make_dt_interval(mins=_c(minutes).cast("int"))


def parking_flags(text) -> Column:
    """Flags from text like {'garage': False, 'lot': True}; anything unreadable is all false."""
    fixed = F.replace(F.replace(_c(text), F.lit("'"), F.lit('"')), F.lit("True"), F.lit("true"))
    fixed = F.replace(F.replace(fixed, F.lit("False"), F.lit("false")), F.lit("None"), F.lit("null"))
    kinds = ("lot", "garage", "valet", "street")
    parsed = F.from_json(fixed, ", ".join(f"{k} boolean" for k in kinds))
    return F.struct(*[F.coalesce(parsed[k], F.lit(False)).alias(f"parking_{k}") for k in kinds])


def parse_ballot(text, n) -> Column:
    """Zero-based order from a JSON list of 1-based picks: bad and repeated picks go, the rest follow in order."""
    n = _c(n).cast("int")
    raw = F.coalesce(F.from_json(_c(text), "array<string>"), F.array().cast("array<string>"))
    # Only text that is an integer counts as a pick, so "2.0" or "x" drops out.
    picks = F.transform(raw, lambda x: F.when(F.trim(x).rlike(r"^[+-]?\d+$"), x.try_cast("int")))
    valid = F.filter(picks, lambda p: p.isNotNull() & (p >= 1) & (p <= n))
    order = F.transform(F.array_distinct(valid), lambda p: p - 1)
    everything = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(order, F.array_except(everything, order))
