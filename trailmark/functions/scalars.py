"""Scalar expressions over moments, ratings, clips, names and time. Each takes and returns Columns.

Rounding is half-even (`bround`) where ratings and reports are rounded. A null input gives null unless a function says
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors.
MPS_TO_MPH = 2.23694
M_TO_MILES = 1 / 1609.344
M_TO_FEET = 3.28084
# Rating dimensions and vision sources.
VISUAL_DIMS = ("composition", "scenery")
ACTION_DIMS = ("motion", "subject")
SCORE_DIMS = ("composition", "motion", "scenery", "subject")
RUBRIC_DIMS = ("light", "composition", "motion", "scenery", "subject")
VISION_SOURCES = ("gemini", "openai", "local")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x) -> Column:
    return F.lit(float(x))


# --- units and time -------------------------------------------------------------------------------------------------


def mph(mps: Column) -> Column:
    return mps * MPS_TO_MPH


def miles(metres: Column) -> Column:
    return metres * M_TO_MILES


def feet(metres: Column) -> Column:
    return metres * M_TO_FEET


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds; timestamps without a zone are compared as they read."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1e6)


def epoch_seconds(ts: Column) -> Column:
    """Seconds of a timestamp without a zone since 1970 began on the same clock."""
    return seconds_between(F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def relabelled(ts: Column) -> Column:
    """A timestamp read as wall time, its zone dropped and not converted."""
    return ts.cast("timestamp_ntz")


def clock(secs: Column) -> Column:
    """`H:MM:SS` from one hour on, else `M:SS`; fractions are cut."""
    s = secs.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def hours_minutes(secs: Column) -> Column:
    """`H:MM`"""
    s = secs.cast("long")
    return F.format_string("%d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60))


def title_date(ts: Column) -> Column:
    """`JAN 05, 2024`"""
    return F.upper(F.date_format(ts, "MMM dd, yyyy"))


def gradient(rise: Column, run: Column, least: float = 0.5, strict: bool = False) -> Column:
    """Rise over run in percent; 0 on runs below `least` (or equal to it, if strict)."""
    flat = run <= least if strict else run < least
    return F.when(flat, num(0)).otherwise(rise / run * 100)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else num(v)
    return F.greatest(as_col(low), F.least(as_col(high), x))


# --- ratings --------------------------------------------------------------------------------------------------------


def label_on_new_scale(value: Column, version: Column) -> Column:
    """Ratings of scale version 1 (also when missing) are doubled; null stays null."""
    return F.when(F.coalesce(version, F.lit(1)) < 2, value * 2).otherwise(value)


def _mean(rubric: Column, dims: tuple[str, ...]) -> Column:
    present = F.filter(F.array(*[rubric[d].cast("double") for d in dims]), lambda v: v.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, num(0), lambda a, v: a + v) / F.size(present))


def has_rubric(rubric: Column) -> Column:
    return F.coalesce(*[rubric[d] for d in RUBRIC_DIMS]).isNotNull()


def visual_action(visual: Column, action: Column, rubric: Column, label_visual: Column, label_action: Column) -> tuple[Column, Column]:
    """The best available pair: explicit if either is there, else rubric means, else the label's, else 0."""

    def pick(own: Column, dims: tuple[str, ...], nested: Column) -> Column:
        explicit = visual.isNotNull() | action.isNotNull()
        mean = F.bround(F.coalesce(_mean(rubric, dims), num(0)), 0).cast("int")
        return F.when(explicit, F.coalesce(own, F.lit(0))).when(has_rubric(rubric), mean).otherwise(F.coalesce(nested, F.lit(0)))

    return pick(visual, VISUAL_DIMS, label_visual), pick(action, ACTION_DIMS, label_action)


def rubric_score(rubric: Column) -> Column:
    """Mean of the dimensions that count for the score; null if none is there."""
    return _mean(rubric, SCORE_DIMS)


def rubric_total(rubric: Column) -> Column:
    """Sum of all five dimensions, missing ones 0."""
    total = F.lit(0)
    for d in RUBRIC_DIMS:
        total = total + F.coalesce(rubric[d].cast("int"), F.lit(0))
    return total


def hit_anchor(start: Column, end: Column, peak_offset: Column) -> Column:
    """Start plus the clamped share of the length."""
    return start + clamp(F.coalesce(peak_offset, num(0.5)), 0, 1) * (end - start)


def crop_bias(crop_x: Column, clip_type: Column, motion: Column, centred: tuple[str, ...] = ("scenery", "landmark", "transition", "urban")) -> Column:
    """Portrait crop offset in -1..1: none for wide types; beyond 0.3 it shrinks the less motion there is."""
    bias = (F.coalesce(crop_x, F.lit(50)) - 50) / num(50)
    sure = F.greatest(num(0), F.coalesce(motion, F.lit(5)) - num(4)) / 6
    return F.when(F.coalesce(clip_type.isin(*centred), F.lit(False)), num(0)).when(F.abs(bias) > 0.3, bias * (num(0.5) + sure * 0.5)).otherwise(bias)


def must_include(flag: Column, notes: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.lower(notes).rlike("must include|must have"), F.lit(False))


# Least rating of a label that counts, and what it adds; agreement's factors from which mean score on, and without one.
BOOSTED_RATING, LABEL_BOOST = 6, 6
AGREEMENT_FACTORS = ((5.5, 1.0), (4.5, 0.3))
UNRATED_FACTOR = 0.5
# What a kind of label adds, and one that must be included.
TYPE_BONUS = {"incident": 3.0, "landmark": 1.5, "descent": 1.5, "group_riding": 1.0, "action": 1.0}
INCLUDED_BONUS = 100.0
# Fixed values of the telemetry score: watts, mph and beats a point, the most of power and speed, beats from which on they count.
WATTS_A_POINT, MPH_A_POINT, BEATS_A_POINT = 50, 6, 20
MOST_POWER, MOST_SPEED, LEAST_BEATS = 10, 5, 130
# Mph and watts of footage without and with life, and the most that is taken off.
LIFELESS, LIVELY, MOST_PENALTY = (8.0, 30.0), (14.0, 130.0), 4.0
# Thresholds as shares of functional power and of the greatest heart rate.
POWER_SHARE, HEART_SHARE = 1.45, 0.87


def label_boost(sources: Column, visual: Column, action: Column) -> Column:
    rated = F.greatest(F.coalesce(visual, F.lit(0)), F.coalesce(action, F.lit(0))) >= BOOSTED_RATING
    return F.when(F.array_contains(sources, "label") & rated, num(LABEL_BOOST)).otherwise(num(0))


def agreement_boost(sources: Column, score: Column) -> Column:
    """(sources - 1) times 1, 0.3 or 0 by the rubric score, 0.5 without one."""
    factor = F.when(score.isNull(), num(UNRATED_FACTOR))
    for least, share in AGREEMENT_FACTORS:
        factor = factor.when(score >= least, num(share))
    factor = factor.otherwise(num(0))
    return (F.size(sources) - 1) * factor


def rating_adjustment(rating: Column) -> Column:
    """Reviewer rating as a change of score: 1-5 around 3 in twos, 6-10 around 5.5 in ones, else 0."""
    return F.when(rating.between(1, 5), (rating - 3) * num(2)).when(rating > 5, rating - num(5.5)).otherwise(num(0))


def type_bonus(kind: Column, included: Column) -> Column:
    bonus = F.when(included, num(INCLUDED_BONUS))
    for name, points in TYPE_BONUS.items():
        bonus = bonus.when(kind == name, num(points))
    return bonus.otherwise(num(0))


def telemetry_score(power: Column, speed: Column, heart_rate: Column) -> Column:
    """Power up to 10, speed up to 5, heart rate above 130 without a limit; missing or zero metrics give 0."""
    part = lambda metric, value: F.when(F.coalesce(metric, num(0)) != 0, value).otherwise(num(0))
    effort = part(power, F.least(power / WATTS_A_POINT, num(MOST_POWER))) + part(speed, F.least(mph(speed) / MPH_A_POINT, num(MOST_SPEED)))
    return effort + part(heart_rate, F.greatest(num(0), (heart_rate - LEAST_BEATS) / BEATS_A_POINT))


def liveness_penalty(speed_mps: Column, power: Column, low=LIFELESS, high=LIVELY, most: float = MOST_PENALTY) -> Column:
    """Up to `most` for footage that is both slow and without effort; 0 when either is unknown."""
    slow = clamp((num(high[0]) - mph(speed_mps)) / (high[0] - low[0]), 0, 1)
    coast = clamp((num(high[1]) - power) / (high[1] - low[1]), 0, 1)
    return F.when(speed_mps.isNull() | power.isNull(), num(0)).otherwise(num(most) * slow * coast)


def zone(share: Column, uppers: list[float]) -> Column:
    """Index of the first zone whose upper bound the share doesn't exceed; the last takes the rest."""
    found = F.lit(len(uppers) - 1)
    for i in range(len(uppers) - 2, -1, -1):
        found = F.when(share <= uppers[i], i).otherwise(found)
    return found


def thresholds(ftp: Column, max_hr: Column, power: Column | None = None, hr: Column | None = None) -> tuple[Column, Column]:
    """(power, heart rate) thresholds: explicit ones, else 1.45 FTP and 0.87 of the maximum, rounded half-even."""
    none = F.lit(None).cast("int")
    return F.coalesce(none if power is None else power, F.bround(ftp * POWER_SHARE, 0).cast("int")), F.coalesce(none if hr is None else hr, F.bround(max_hr * HEART_SHARE, 0).cast("int"))


# --- names ----------------------------------------------------------------------------------------------------------


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def stable_id(clip: Column, anchor: Column) -> Column:
    return F.concat(stem(clip), F.lit("@"), F.bround(anchor, 0).cast("long").cast("string"))


def chapter(name: Column) -> tuple[Column, Column]:
    """(recording, chapter) of `GXccRRRR`-like stems; else (stem, 0)."""
    s, pattern = stem(name), r"^G[A-Z](\d{2})(\d{4})$"
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 2)).otherwise(s), F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1).cast("int")).otherwise(0)


def proxy_name(name: Column) -> Column:
    """Name of the low-resolution file of a full-resolution one; null if it has none by its name."""
    return F.when(name.rlike(r"^GX.*\.MP4$"), F.regexp_replace(name, r"^GX(.*)\.MP4$", "GL$1.LRV"))


# What a model id is changed by, in this order, to be part of a file name.
NAME_PATTERNS = (("[^A-Za-z0-9._-]+", "-"), ("-{2,}", "-"), ("^[-.]+|[-.]+$", ""))


def sanitised_model(model: Column) -> Column:
    """A model id as part of a file name; a changed one ends in the start of the original's SHA-1."""
    raw = F.trim(F.when(F.coalesce(model, F.lit("")) == "", F.lit("unknown")).otherwise(model))
    s = raw
    for pattern, by in NAME_PATTERNS:
        s = F.regexp_replace(s, pattern, by)
    s = F.when(s == "", "unknown").otherwise(s)
    return F.when(s == raw, s).otherwise(F.concat_ws("_", s, F.substring(F.sha1(raw.cast("binary")), 1, 8)))


def report_name(provider: Column, model: Column) -> Column:
    return F.concat(F.lit("prompt_eval_"), provider, F.lit("_"), sanitised_model(model), F.lit(".json"))


def times_fingerprint(times: Column) -> Column:
    """First 8 hex digits of the SHA-1 of rounded, sorted seconds."""
    text = F.array_join(F.transform(F.array_sort(F.transform(times, lambda t: F.bround(t, 0).cast("long"))), lambda t: t.cast("string")), ",")
    return F.substring(F.sha1(text.cast("binary")), 1, 8)


def geo_key(*values: Column) -> Column:
    """MD5 of coordinates at four decimals."""
    return F.md5(F.concat_ws(",", *[F.format_string("%.4f", v) for v in values]).cast("binary"))


# Fences around a reply, trailing commas, and the pieces that are tried when a whole reply can't be parsed.
OPEN_FENCE, CLOSE_FENCE = r"```(?:json)?\s*", r"```\s*$"
TRAILING_COMMAS = ((r",\s*\}", "}"), (r",\s*\]", "]"))
ANY_ARRAY, FLAT_OBJECT = r"(?s)\[.*\]", r"(?s)\{[^{}]*\}"


def bound(value: Column, use) -> Column:
    """`use(value)`, where `value` is worked out once for a row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parsed_json(text: Column) -> tuple[Column, Column]:
    """(value as JSON text, ok): fences are stripped; failing that, trailing commas; failing that, the first array or
    flat object is taken. A text that holds none parses to an empty object or array, with ok false."""
    both = json_found(text)
    return both["value"], both["ok"]


def json_found(text: Column) -> Column:
    """struct<value, ok> of `parsed_json`, each step worked out once."""

    def found_in(bare: Column) -> Column:
        tidy = bare
        for pattern, by in TRAILING_COMMAS:
            tidy = F.regexp_replace(tidy, pattern, by)
        pieces = [bare, tidy, F.regexp_extract(bare, ANY_ARRAY, 0), F.regexp_extract(bare, FLAT_OBJECT, 0)]
        empty = F.when(F.contains(bare, F.lit("{")), "{}").otherwise("[]")
        found = F.coalesce(*[F.to_json(F.try_parse_json(p)) for p in pieces])
        return bound(found, lambda f: F.struct(F.coalesce(f, empty).alias("value"), f.isNotNull().alias("ok")))

    return bound(F.trim(F.regexp_replace(F.regexp_replace(text, OPEN_FENCE, ""), CLOSE_FENCE, "")), found_in)


#: Parts of names of administrative units (fixed values).
ADMIN = "community board|council district|ward |election district|precinct |historic district"
#: Address keys, finest first (fixed values).
LOCALITY_KEYS = ("quarter", "neighbourhood", "suburb", "city_district", "hamlet", "village", "town", "city")


def is_admin(name: Column) -> Column:
    return (F.coalesce(name, F.lit("")) == "") | F.lower(name).rlike(ADMIN)


def locality(address: Column, display: Column) -> Column:
    """First address part that isn't administrative, else the display name's first part, upper-cased."""
    parts = [F.when(~is_admin(address[k]), F.upper(address[k])) for k in LOCALITY_KEYS]
    shown = F.when(F.coalesce(display, F.lit("")) != "", F.upper(F.trim(F.split_part(display, F.lit(","), F.lit(1)))))
    return F.coalesce(*parts, shown, F.lit("UNKNOWN"))


#: What stands before the name of a place (fixed values).
PLACE_PREFIX = "^(Village|Town|City|Township) of "


def without_prefix(name: Column) -> Column:
    return F.regexp_replace(name, PLACE_PREFIX, "")


def clean_ref(ref: Column) -> Column:
    """A route reference of two parts without its country or state; `I` stays."""
    parts = F.split(F.trim(ref), r"\s+")
    strip = (F.size(parts) == 2) & F.element_at(parts, 1).rlike("^[A-Z]{2}$")
    return F.when(strip, F.element_at(parts, -1)).otherwise(ref)


def stars_from_notes(notes: Column) -> Column:
    """Logarithm of the number in the last "(n stars)"; 0 without one."""
    n = F.regexp_extract(notes, r"\(\s*([0-9.]+)\s*stars\)[^(]*$", 1)
    return F.coalesce(F.log(F.greatest(num(1), n.try_cast("double"))), num(0))


def lockup(override: Column, derived: Column, default: str) -> Column:
    """Override, else what was derived unless unknown or an error, else the default."""
    usable = F.when((derived != "") & (derived != "UNKNOWN") & ~derived.startswith("ERR"), derived)
    return F.coalesce(F.when(override != "", override), usable, F.lit(default))


# --- spans ----------------------------------------------------------------------------------------------------------


def anchored_cut(start: Column, end: Column, anchor: Column, trim: Column, floor: Column | float = 0.0) -> tuple[Column, Column]:
    """(start, length) of a cut around the anchor, within the span; a span below the trim is overrun instead."""
    half, floor = trim / 2, floor if isinstance(floor, Column) else num(floor)
    a, b = F.greatest(start, anchor - half), F.least(end, anchor + half)
    narrow = b - a < trim
    first = F.when(narrow, F.greatest(num(0), anchor - half)).otherwise(a)
    length = F.when(narrow, anchor + half).otherwise(b) - first
    return first, F.when(floor > 0, F.greatest(length, floor)).otherwise(length)


def effective(anchor: Column, user_anchor: Column, start: Column, end: Column, user_span: Column, status: Column) -> tuple[Column, Column, Column, Column]:
    """(anchor, start, end, included) of a moment with the reviewer's changes."""
    return F.coalesce(user_anchor, anchor), F.coalesce(user_span[0], start), F.coalesce(user_span[1], end), F.coalesce(status.isin("approved", "auto"), F.lit(False))


# --- geometry -------------------------------------------------------------------------------------------------------

EARTH_MILES = 3958.8
METRES_PER_DEGREE = 111_320.0


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = F.radians
    h = F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(h))


def local_metres(lat: Column, lon: Column, lat0: Column) -> tuple[Column, Column]:
    """(x, y) on a plane at latitude lat0."""
    return lon * METRES_PER_DEGREE * F.cos(F.radians(lat0)), lat * METRES_PER_DEGREE


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment; to its one point if it has no length."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, clamp(((px - ax) * dx + (py - ay) * dy) / square, 0, 1)).otherwise(num(0))
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))


def crosses_ray(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whether an edge crosses the eastward ray from a point; an odd number of crossings is inside."""
    return ((lat1 > lat) != (lat2 > lat)) & (lon < (lon2 - lon1) * (lat - lat1) / F.when(lat2 == lat1, num(1)).otherwise(lat2 - lat1) + lon1)


def mercator_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    n = float(2**zoom)
    y = (1 - F.asinh(F.tan(F.radians(lat))) / F.lit(3.141592653589793)) / 2 * n
    return ((lon + 180) / 360 * n).cast("int"), y.cast("int")


def padded_box(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column, pad: float = 0.25) -> tuple[Column, Column, Column, Column]:
    """(south, west, north, east) with `pad` miles on each side."""
    lat_pad = pad / 69.0
    lon_pad = num(pad) / (F.greatest(num(0.01), F.cos(F.radians((min_lat + max_lat) / 2))) * 69.0)
    return min_lat - lat_pad, min_lon - lon_pad, max_lat + lat_pad, max_lon + lon_pad
