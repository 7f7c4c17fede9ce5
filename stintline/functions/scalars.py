"""Scalar parsers as Column expressions. Unknown input gives NULL, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The provider's epoch (2000-01-01) in unix microseconds, its mark for an open end, and valid lap times.
PROVIDER_EPOCH_US = 946_684_800_000_000
OPEN_ENDED = 9_223_372_036_854_775_807
LEAST_LAP_US = 1_000_000
PLAUSIBLE_US = 26 * 3_600_000_000

#: Flag kinds by provider code, and codes by label.
FLAG_BY_CODE = {-1: "NOT_STARTED", 0: "NOT_STARTED", 1: "READY", 2: "RED", 3: "SAFETY_CAR", 4: "CODE_60", 5: "FINISH", 6: "GREEN", 7: "FULL_COURSE_YELLOW"}
FLAG_CODE_BY_LABEL = {
    "notstarted": 0,
    "ready": 1,
    "warmupflag": 1,
    "redflag": 2,
    "yellowflag": 3,
    "safetycar": 3,
    "purpleflag": 4,
    "code60": 4,
    "finishflag": 5,
    "greenflag": 6,
    "fullcourseyellow": 7,
    "fcy": 7,
}
#: State literals.
STATE_BY_LITERAL = {"inpit": "IN_PIT", "outlap": "OUT_LAP", "finshd": "FINISHED", "finished": "FINISHED"}
#: Header names of the result table and the columns that they mean.
HEADER_ALIASES = {
    "position": "position_overall",
    "pos": "position_overall",
    "marker": "marker",
    "startnumber": "start_number",
    "startno": "start_number",
    "nr": "start_number",
    "number": "start_number",
    "nbr": "start_number",
    "state": "state",
    "team": "team_name",
    "teamname": "team_name",
    "driver": "current_driver",
    "currentdriver": "current_driver",
    "driverincar": "current_driver",
    "class": "class_name",
    "cls": "class_name",
    "positioninclass": "position_class",
    "pic": "position_class",
    "hole": "gap",
    "gap": "gap",
    "diff": "diff",
    "fastestroundtime": "best_lap",
    "best": "best_lap",
    "lastroundtime": "last_lap",
    "last": "last_lap",
    "laps": "laps",
    "lap": "laps",
    "currentdriverstinttime": "driver_stint",
    "stint": "driver_stint",
    "pittime": "pit_time",
    "lpit": "pit_time",
    "pitstops": "pit_stops",
    "pit": "pit_stops",
    "sectionmarker": "section_marker",
    "section": "section_marker",
    "s": "section_marker",
    "car": "car_name",
    "vehicle": "car_name",
    "speed": "speed",
}
#: Other spellings of track names.
TRACK_NAMES = {
    "автодром игора драйв": "Igora Drive",
    "igora drive (rec)": "Igora Drive",
    "test track": "Тестовая трасса",
    "нижегородское кольцо (nring)": "Нижегородское кольцо",
}


def div(a: Column, b: int) -> Column:
    """Whole part of a division."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def lookup(table: dict, key: Column) -> Column:
    """A small fixed table as a chain of conditions; NULL outside it."""
    out = F.lit(None)
    for k, v in reversed(table.items()):
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def token(text: Column) -> Column:
    """Lower-case letters and digits of a text, nothing else."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def parse_ts_time(x: Column) -> Column:
    """B1: a non-negative ASCII integer, else NULL."""
    return F.when(F.trim(x).rlike("^[0-9]+$"), F.trim(x).try_cast("bigint"))


def is_open_ended(x: Column) -> Column:
    return parse_ts_time(x) == F.lit(OPEN_ENDED)


def provider_to_unix_us(x: Column) -> Column:
    """B2: provider instants to unix microseconds; open ends give NULL."""
    return F.when(x != OPEN_ENDED, x + PROVIDER_EPOCH_US)


def received_at_us(x: Column) -> Column:
    """RFC 3339 with an offset, or an integer; naive times are NULL."""
    zoned = x.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint")).when(zoned, F.unix_micros(F.try_to_timestamp(F.regexp_replace(x, "[Zz]$", "+00:00"))))


def event_ts(x: Column) -> Column:
    """As B1; 0 and open ends are NULL."""
    v = parse_ts_time(x)
    return F.when((v != 0) & (v != OPEN_ENDED), v)


def heat_boundary_ts(x: Column) -> Column:
    v = parse_ts_time(x)
    return F.when(v != 0, v)


def duration_ms(us: Column) -> Column:
    """Floor to milliseconds of a valid lap time."""
    return F.when((us >= LEAST_LAP_US) & (us < OPEN_ENDED), div(us, 1000))


def parse_gap(text: Column) -> Column:
    """struct(kind, completed_laps, time_ms) of a GAP cell."""
    t = F.trim(text)
    laps = r"^--\s*(\d+)\s+laps?\s*--$"
    parts = F.split(t, ":")
    n = F.size(parts)
    whole = lambda i: F.when(F.get(parts, F.lit(i)).rlike(r"^\s*\d+\s*$"), F.trim(F.get(parts, F.lit(i))).try_cast("bigint"))
    last = F.element_at(parts, -1)
    seconds = F.when(last.rlike(r"^\s*\d+(\.\d*)?\s*$|^\s*\.\d+\s*$"), F.trim(last).try_cast("decimal(18,6)"))
    total = (
        F.when(n == 1, seconds)
        .when((n == 2) & (seconds < 60), whole(0) * 60 + seconds)
        .when((n == 3) & (seconds < 60) & (whole(1) < 60), whole(0) * 3600 + whole(1) * 60 + seconds)
    )
    ms = F.round(total * 1000, 0).cast("bigint")
    group = F.lower(t).rlike(laps)
    kind = F.when(t.isNull() | (t == ""), "EMPTY").when(group, "LAP_GROUP").when(ms.isNotNull(), "TIME").otherwise("UNKNOWN")
    return F.struct(
        kind.alias("kind"),
        F.when(group, F.regexp_extract(F.lower(t), laps, 1).try_cast("bigint")).alias("completed_laps"),
        F.when(~F.coalesce(group, F.lit(False)), ms).alias("time_ms"),
    )


def parse_state(text: Column) -> Column:
    """struct(kind, timer, literal) of a STATE cell: E<time> is on track, S<literal> a status."""
    t = F.trim(text)
    head, rest = F.upper(F.substring(t, 1, 1)), F.trim(F.substring(t, 2, F.length(t)))
    timer = F.when(head == "E", event_or_null(rest))
    literal = F.when(head == "E", F.lit(None)).when(head == "S", rest).otherwise(t)
    kind = F.when((head == "E") & timer.isNotNull(), "ON_TRACK").otherwise(F.coalesce(lookup(STATE_BY_LITERAL, token(literal)), F.lit("UNKNOWN")))
    return F.struct(kind.alias("kind"), timer.alias("timer"), literal.alias("literal"))


def event_or_null(x: Column) -> Column:
    v = parse_ts_time(x)
    return F.when(v != OPEN_ENDED, v)


def canonical_flag(x: Column) -> Column:
    """Flag kind of a provider code or label."""
    t = F.trim(x)
    code = F.when(t.rlike("^-?[0-9]+$"), t.try_cast("int")).otherwise(lookup(FLAG_CODE_BY_LABEL, token(t)))
    return F.coalesce(lookup(FLAG_BY_CODE, code), F.lit("UNKNOWN"))


def parse_driver_stint(text: Column) -> Column:
    """struct(kind, value): S start instant, P point in time, L duration."""
    t = F.trim(text)
    value = parse_ts_time(F.substring(t, 2, F.length(t)))
    kind = lookup({"S": "START_TS", "P": "POINT_TS", "L": "DURATION"}, F.upper(F.substring(t, 1, 1)))
    return F.struct(F.coalesce(F.when(value.isNotNull(), kind), F.lit("UNKNOWN")).alias("kind"), F.when(kind.isNotNull(), value).alias("value"))


def pit_duration_ms(text: Column) -> Column:
    """Milliseconds of L<us>."""
    return F.when(F.upper(F.substring(F.trim(text), 1, 1)) == "L", div(parse_ts_time(F.substring(F.trim(text), 2, F.length(text))), 1000))


def pit_entry_ts(text: Column) -> Column:
    """The provider instant of S<ts>."""
    return F.when(F.upper(F.substring(F.trim(text), 1, 1)) == "S", event_ts(F.substring(F.trim(text), 2, F.length(text))))


def canonical_header(name: Column, parameter: Column, caption: Column) -> Column:
    """Canonical key of a header; the caption counts only if the name means nothing."""

    def key(text: Column) -> Column:
        t = token(text)
        known = F.try_element_at(F.create_map(*[F.lit(x) for pair in HEADER_ALIASES.items() for x in pair]), t)
        # fixed values: the forms of a sector's header
        numbered = F.regexp_extract(t, r"^(?:sectortimes?|sector|sect)([1-9][0-9]*)$", 1)
        apart = F.when(t.isin("sectortime", "sectortimes", "sector", "sect") & F.trim(parameter).rlike("^[1-9][0-9]*$"), F.concat(F.lit("sector_"), F.trim(parameter)))
        return F.coalesce(known, F.when(numbered != "", F.concat(F.lit("sector_"), numbered)), apart)

    return F.coalesce(key(name), key(caption))


def norm_key(text: Column) -> Column:
    """Trimmed, lower case, single spaces; empty is NULL."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(text), r"\s+", " ")), F.lit(""))


def speed_kph(mm_s: Column) -> Column:
    """B13."""
    return mm_s * 0.0036


def as_int(x: Column) -> Column:
    """Exact integers only."""
    return F.when(x.rlike("^-?[0-9]+$"), x.try_cast("bigint"))


def as_float(x: Column) -> Column:
    """Finite numbers only."""
    v = x.try_cast("double")
    return F.when(x.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), v)


def as_bool(x: Column) -> Column:
    return F.when(x == "true", True).when(x == "false", False)


def as_text(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def plausible_us(event: Column, received: Column) -> Column:
    """An instant within 26 hours of the receive time."""
    return F.when(F.abs(event - received) <= PLAUSIBLE_US, event)


def fingerprint(*parts: Column) -> Column:
    """Digest of a tuple's text; NULL parts count."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]), 256)


def freshness(age_us: Column, has_gap: Column, flag: Column, lifecycle: Column, has_heat: Column) -> Column:
    """LIVE, STALE or OFFLINE."""
    off = lifecycle.isin("stopped", "aborted") | ~has_heat | (F.coalesce(flag, F.lit("")) == "FINISH") | has_gap | age_us.isNull()
    return F.when(off, "OFFLINE").when(age_us <= 3_000_000, "LIVE").when(age_us <= 10_000_000, "STALE").otherwise("OFFLINE")


def sector_map(text: Column) -> Column:
    """Map of sector_* to milliseconds, valid durations only."""
    raw = F.from_json(text, "map<string,bigint>")
    good = F.map_filter(raw, lambda k, v: k.rlike("^sector_[1-9][0-9]*$") & (v >= LEAST_LAP_US) & (v < OPEN_ENDED))
    return F.transform_values(good, lambda k, v: div(v, 1000))


def object_key_parts(key: Column) -> Column:
    """struct(category, date, slug, filename, season, code) of an object key."""
    parts = F.split(key, "/")
    at = F.array_position(F.transform(parts, lambda p: p.rlike(r"^\d{4}-\d{2}-\d{2}$")), F.lit(True))
    name = F.element_at(parts, -1)
    date = F.when(at > 0, F.get(parts, (at - 1).cast("int"))).otherwise("")
    after = F.when(at > 0, F.get(parts, at.cast("int")))
    slug = F.when(after != name, after).otherwise("")
    code = F.upper(F.regexp_extract(name, r"^([A-Za-z]{2,4})[_\-]", 1))
    return F.struct(F.get(parts, F.lit(0)).alias("category"), date.alias("date"), slug.alias("slug"), name.alias("filename"), F.substring(date, 1, 4).alias("season"), code.alias("code"))


def first_token(text: Column, tokens: list[tuple[str, str]]) -> Column:
    """The name of the first token of an ordered list that a text holds."""
    out = F.lit("")
    for t, name in reversed(tokens):
        out = F.when(F.contains(F.lower(text), F.lit(t)), F.lit(name)).otherwise(out)
    return out


def object_id(key: Column) -> Column:
    """B20."""
    return F.substring(F.sha1(key), 1, 16)


def title(*parts: Column) -> Column:
    """The non-empty parts."""
    return F.concat_ws(" · ", *[F.nullif(p, F.lit("")) for p in parts])


def session_type(has_event: Column, date: Column, race_date: Column, hour: Column, duration_s: Column) -> Column:
    """Fixed values of the recording kinds."""
    return (
        F.when(~has_event, "Трансляция")
        .when(date < race_date, "Тренировка")
        .when(duration_s >= 6000, "Гонка")
        .when(F.coalesce(hour, F.lit(12)) < 12, "Квалификация")
        .otherwise("Трансляция")
    )


def text_key(text: Column) -> Column:
    """Lower-case letters and digits of any script."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def local_date(us: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros(us), zone), "yyyy-MM-dd")


def norm_track(name: Column) -> Column:
    """B23."""
    return F.coalesce(lookup(TRACK_NAMES, F.lower(F.trim(name))), name)


def pace_delta(ours: Column, other: Column) -> Column:
    """Ours less other, both positive."""
    return F.when((ours > 0) & (other > 0), ours - other)


def expected_laps(remaining_s: Column, pace_ms: Column, spread_ms: Column) -> Column:
    """struct(low, high) of laps that still fit."""
    return F.struct(
        F.when(pace_ms > 0, F.floor(remaining_s * 1000 / (pace_ms + F.coalesce(spread_ms, F.lit(0.0))))).alias("low"),
        F.when(pace_ms - F.coalesce(spread_ms, F.lit(0.0)) > 0, F.ceil(remaining_s * 1000 / (pace_ms - F.coalesce(spread_ms, F.lit(0.0))))).alias("high"),
    )


def mixed_gap(laps_a: Column, ms_a: Column, laps_b: Column, ms_b: Column) -> Column:
    """struct(laps, ms) of b less a."""
    return F.struct((laps_b - laps_a).alias("laps"), (ms_b - ms_a).alias("ms"))
