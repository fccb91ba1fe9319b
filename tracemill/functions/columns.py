"""Column helpers: text folding and previews, calendar keys, directories, model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters below U+0250 that fold to one other letter, and what they fold to; a rule, so that both sides of a search agree.
FOLD_FROM = "".join(chr(c) for c in range(0x250) if len(chr(c).lower()) == 1 and chr(c).lower() != chr(c))
FOLD_TO = FOLD_FROM.lower()


def fold(text: Column) -> Column:
    """Letters one to one in lower case, so that lengths and positions stay."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def preview(text: Column, n: int) -> Column:
    """White space collapsed, cut at n characters, then an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` stands in ``text``, overlaps included."""
    quoted = "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in term)
    return F.regexp_count(text, F.lit(f"(?={quoted})")).cast("bigint")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch of a zone-less timestamp that is in UTC, whatever the session's zone."""
    return F.unix_millis(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))


def civil(ts_ms: Column, tz: str) -> Column:
    """The wall clock of an instant in ``tz`` as 'YYYY-MM-DD HH:MM:SS'; null where the time is unknown (0 or less)."""
    utc = F.timestamp_add("MILLISECOND", ts_ms, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.when(ts_ms > 0, F.substring(F.convert_timezone(F.lit("UTC"), F.lit(tz), utc).cast("string"), 1, 19))


def weekday(wall: Column) -> Column:
    """ISO weekday, 1 for Monday, as a string."""
    return (F.weekday(F.substring(wall, 1, 10).cast("date")) + 1).cast("string")


def below(path: Column, base: str) -> Column:
    """Whether a directory is ``base`` or lies under it, by path component."""
    base = base.rstrip("/")
    return F.coalesce((path == (base or "/")) | path.startswith(base + "/"), F.lit(False))


def first_parts(path: Column, base: str, depth: int) -> Column:
    """``base`` and the first ``depth`` components of ``path`` under it."""
    base = base.rstrip("/")
    rest = F.filter(F.split(F.substring(path, len(base) + 1, 1 << 20), "/"), lambda p: p != "")
    return F.concat_ws("/", F.lit(base), F.slice(rest, 1, depth))


def base_name(model: Column) -> Column:
    """A model name without its provider path and its bracketed suffix."""
    return F.regexp_replace(F.regexp_replace(model, "^.*/", ""), r"\[.*\]$", "")


def match_key(model: Column) -> Column:
    """Lower case, with a dot between digits as a dash."""
    return F.lower(F.regexp_replace(model, r"(?<=\d)\.(?=\d)", "-"))


def strip_date(model: Column) -> Column:
    """A name without a trailing date."""
    return F.regexp_replace(model, r"([-@]\d{8}|-\d{4}-\d{2}-\d{2})$", "")


def usd(pico: Column) -> Column:
    """US dollars of a whole number of 1e-12 dollars."""
    return pico.cast("double") / 1e12


def usd_sum(pico: str | Column) -> Column:
    """US dollars of a sum, which is exact up to the one division; null where nothing is priced."""
    return usd(F.sum((F.col(pico) if isinstance(pico, str) else pico).cast("decimal(28,0)")))
