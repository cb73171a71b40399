"""Text cleaning: blanks, numbers, dates, slugs. Nothing here ever raises on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talus import vocab

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
_GROUPED = r"^\s*[+-]?\d+(_\d+)+(\.\d+)?\s*$"
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
_HOUR_ONLY = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(Z|[+-]\d{2}:?\d{2})?$"
_BASIC = r"^(\d{8}[T ]\d{2}|\d{4}-\d{2}-\d{2}[T ]\d{4})"
_SOLID = r"[^\s\x1c-\x1f\x85   -     　]"
_WHITESPACE = " \t\n\r\v\f\x1c\x1d\x1e\x1f\x85    　"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """NULL for NULL, empty and whitespace-only text; anything else unchanged."""
    return F.when(c.rlike(_SOLID), c)


def to_double(c: Column) -> Column:
    """Text to double or NULL. Spark's own cast also takes suffixes such as `1d`, hence the guard."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double")).when(
        c.rlike(_GROUPED), F.replace(c, F.lit("_"), F.lit("")).try_cast("double")
    )


def _utc(text: Column) -> Column:
    return text.try_cast("timestamp").cast("timestamp_ntz")


def parse_iso(c: Column) -> Column:
    """ISO 8601 date or date-time, in extended or basic form, to a naive UTC timestamp; anything else NULL. Fractions of a
    second are cut after six digits."""
    return F.get(F.transform(F.array(F.when(c.rlike(_BASIC), _extended(c)).otherwise(c)), _read_iso), F.lit(0))


def _extended(c: Column) -> Column:
    """Basic form (20230712T101112) with its hyphens and colons put in; date and time may each have either form."""
    dated = F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})(?=[T ])", "$1-$2-$3")
    timed = F.regexp_replace(dated, r"^(.{10}[T ]\d{2})(\d{2})(\d{2})(?![\d:])", "$1:$2:$3")
    return F.regexp_replace(timed, r"^(.{10}[T ]\d{2})(\d{2})(?![\d:])", "$1:$2")


def _read_iso(c: Column) -> Column:
    hour_only = F.length(c) < 16
    iso_text = F.when(hour_only, F.regexp_replace(c, _HOUR_ONLY, "$1:00:00$2")).otherwise(F.translate(c, ",", "."))
    return F.when(c.rlike(_ISO), _utc(iso_text))


def parse_date(c: Column) -> Column:
    """First successful reading: ISO 8601, then vocab.DATE_FORMATS in order; otherwise NULL.

    A time-zone suffix is converted to UTC. Day-first wins over month-first, except in the formats
    that carry a clock time.
    """
    # The one-element array lets every format below reuse the stripped text.
    return F.get(F.transform(F.array(strip(c.cast("string"))), _read_date), F.lit(0))


def _read_date(bare: Column) -> Column:
    usable = ~F.lower(bare).isin([*vocab.EMPTY_DATE_WORDS, ""])
    readings = [parse_iso(bare)]
    for shape, pattern in vocab.DATE_FORMATS:
        if pattern is None:
            value = _utc(bare)
        else:
            value = F.try_to_timestamp(bare, F.lit(pattern)).cast("timestamp_ntz")
        readings.append(F.when(bare.rlike(shape), value))
    return F.when(usable, F.coalesce(*readings))


def once(**columns: Column) -> Column:
    """Several computed columns as one generated row.

    The optimizer neither merges a projection into a generator nor pushes a filter below it, so
    costly parsing runs exactly once per row however often its results are used.
    """
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def flag(c: Column, truthy: tuple[str, ...]) -> Column:
    return F.lower(F.trim(c)).isin(*truthy)


def source_slug(name: Column) -> Column:
    """Stable source id from a display name."""
    return F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit("_"))


def file_name(path: Column) -> Column:
    """The last path element; a full path never leaves the library."""
    return F.regexp_extract(path, r"[^/]+$", 0)


def route_intent(question: Column) -> Column:
    """Name of the first matching question pattern; `help` for blank, `unrecognized` otherwise."""
    text = F.trim(F.coalesce(question, F.lit("")))
    intent = F.when(text == "", "help")
    for name, pattern in vocab.INTENT_PATTERNS:
        intent = intent.when(text.rlike(f"(?i){pattern}"), name)
    return intent.otherwise("unrecognized")
