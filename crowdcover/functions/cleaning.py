"""Cleaning rules for the values of known attributes: text in, canonical text or NULL out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label classes, dwelling types, roof types and the wordings they come in.
ENERGY_LABELS = ("A+++++", "A++++", "A+++", "A++", "A+", "A", "B", "C", "D", "E", "F", "G")
DWELLING_TYPES = ("vrijstaand", "twee_onder_een_kap", "hoekwoning", "tussenwoning", "appartement")
DWELLING_WORDS = (
    (r"/\s*rijwoning hoek\s+rijwoning", "hoekwoning"),
    (r"2.?onder.?1|twee.?onder.?([eé]{2}n|1)|semi.?detached|2/1", "twee_onder_een_kap"),
    (r"vrijstaand|detached|free.?standing", "vrijstaand"),
    (r"appartement|apartment|flat|galerij|portiek|maisonnette|etage|bovenwoning|benedenwoning|"
     r"meergezins|multi.?family", "appartement"),
    (r"hoek|end.?of.?terrace|corner", "hoekwoning"),
    (r"tussen|rij|mid.?terrace|terraced|row", "tussenwoning"),
)
ROOF_WORDS = (
    (r"meerdere|multiple", "plat_meerdere"),
    (r"schuin|slanted|pitched|hellend|zadel|schild|mansard", "schuin"),
    (r"plat|flat|horizontal", "plat"),
)
YES = ("true", "1", "ja", "yes", "j", "y", "waar")
NO = ("false", "0", "nee", "no", "n", "onwaar")
# Fixed value: a station that stopped, and the one that took over its area.
SUCCESSORS = {"210": "215"}


def _trim(s: Column) -> Column:
    return F.regexp_replace(s.cast("string"), r"^\s+|\s+$", "")


def _squeeze(s: Column) -> Column:
    return F.upper(F.regexp_replace(s.cast("string"), r"\s+", ""))


def _first_word(s: Column, words) -> Column:
    """The canonical value of the first pattern that occurs; the order of the words matters."""
    found = None
    for pattern, value in words:
        hit = s.rlike(pattern)
        found = F.when(hit, value) if found is None else found.when(hit, value)
    return found


def label(s: Column) -> Column:
    t = F.regexp_replace(_squeeze(s), "^LABEL", "")
    return F.when(t.isin(*ENERGY_LABELS), t)


def dwelling_type(s: Column) -> Column:
    t = F.lower(_trim(s))
    return F.when(t.isin(*DWELLING_TYPES), t).otherwise(_first_word(t, DWELLING_WORDS))


def postcode(s: Column) -> Column:
    t = _squeeze(s)
    return F.when(t.rlike(r"^\d{4}([A-Z]{2})?$"), t)


def postcode4(s: Column) -> Column:
    return F.substring(postcode(s), 1, 4)


def roof(s: Column) -> Column:
    return _first_word(F.lower(_trim(s)), ROOF_WORDS)


def boolean(s: Column) -> Column:
    t = F.lower(_trim(s))
    return F.when(t.isin(*YES), "true").when(t.isin(*NO), "false")


def free_text(s: Column) -> Column:
    return F.nullif(_trim(s), F.lit(""))


def lower_text(s: Column) -> Column:
    return F.nullif(F.lower(_trim(s)), F.lit(""))


def station(s: Column) -> Column:
    """A station number as the population holds it; a stopped one becomes its successor."""
    code = station_as_is(s)
    for old, new in SUCCESSORS.items():
        code = F.when(code == old, new).otherwise(code)
    return code


def station_as_is(s: Column) -> Column:
    """A station number: '260', also from '06260' (the block 6000-6999), '260.0' or ' 260 '."""
    t = _trim(s)
    number = t.try_cast("double").cast("bigint")
    short = F.when((number >= 6000) & (number < 7000), number - 6000).otherwise(number)
    return F.nullif(F.coalesce(short.cast("string"), t), F.lit(""))


# --- address keys -------------------------------------------------------------------------------

def postcode_key(s: Column) -> Column:
    return F.nullif(_squeeze(s), F.lit(""))


def number_key(s: Column) -> Column:
    """A house number; '12.0' counts as 12, anything that is no whole number as unknown."""
    v = s.cast("string").try_cast("double")
    return F.when(v == F.floor(v), v.cast("bigint"))


def part_key(s: Column | None) -> Column:
    if s is None:
        return F.lit("")
    return F.coalesce(F.upper(_trim(s)), F.lit(""))


def padded_id(s: Column, length: int = 16) -> Column:
    t = _trim(s)
    return F.when(F.length(t) < length, F.lpad(t, length, "0")).otherwise(t)


# --- times --------------------------------------------------------------------------------------

# Other ways in which a time without a zone is written.
TIME_FORMATS = ("yyyyMMddHHmm", "yyyyMMdd", "dd-MM-yyyy HH:mm", "dd-MM-yyyy")
ZONED = r"(?i)\d:\d\d(:\d\d)?(\.\d+)?\s*(z|utc|gmt|[+-]\d|[a-z]+/[a-z])"


def utc_time(value: Column) -> Column:
    """A time written in one of several ways. Without a zone it counts as UTC, whatever the zone of
    the session is; a column that holds instants stays as it is."""
    t = _trim(value.cast("string"))
    plain = F.concat(t.try_cast("timestamp_ntz").cast("string"), F.lit("Z")).try_cast("timestamp")
    others = [F.try_to_timestamp(F.concat(t, F.lit("Z")), F.lit(f + "X")) for f in TIME_FORMATS]
    read = F.when(t.rlike(ZONED), t.try_cast("timestamp")).otherwise(F.coalesce(plain, *others))
    # known when the plan is made: a column of times needs no reading
    kind, plain_day = F.typeof(value), F.current_timezone().isin("UTC", "Etc/UTC", "Z")
    as_it_is = (kind == "timestamp") | (kind.isin("timestamp_ntz", "date") & plain_day)
    return F.when(as_it_is, value.try_cast("timestamp")).otherwise(read)


def utc_hour(value: Column) -> Column:
    """The start of the hour in UTC of :func:`utc_time`."""
    seconds = F.unix_seconds(utc_time(value))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(3600)))


def date_of(value: Column) -> Column:
    """A date written as ``yyyyMMdd`` or in ISO form."""
    t = _trim(value)
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyyMMdd")), t.try_cast("timestamp")).cast("date")


# --- numbers as class texts ---------------------------------------------------------------------

def class_text(value: Column, step: int, *, below: int | None = None,
               above: int | None = None) -> Column:
    """A number as the text of its class of ``step`` wide, ``[a - b]``; with open tails
    ``<below`` and ``above=>``. An unknown number gives the empty text."""
    lo = (F.floor(value / step) * step).cast("bigint")
    out = F.format_string("[%d - %d]", lo, lo + step - 1)
    if above is not None:
        out = F.when(lo >= above, f"{above}=>").otherwise(out)
    if below is not None:
        out = F.when(lo < below, f"<{below}").otherwise(out)
    return F.when(value.isNull(), "").otherwise(out)


def margin_text(value: Column, margin: int) -> Column:
    """A number as the class of ``margin`` to either side; empty when unknown."""
    v = value.cast("bigint")
    return F.when(value.isNull(), "").otherwise(F.format_string("%d-%d", v - margin, v + margin))
