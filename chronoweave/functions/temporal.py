"""Predicates on the two time axes, and relative time phrases.

``valid_*`` is when a statement is true in the world, ``recorded_*`` when it is believed. Intervals are half-open; a
null upper bound is open. No predicate reads the clock: times are arguments.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases and the ISO-8601 durations from and to the reference date (fixed values).
PHRASES = {"last week": "-P7D..P0D", "last month": "-P30D..P0D", "yesterday": "-P1D..P0D", "last quarter": "-P90D..P0D", "last year": "-P365D..P0D"}
_UNITS = {"Y": 365 * 86400, "M": 30 * 86400, "W": 7 * 86400, "D": 86400, "TH": 3600, "TM": 60, "TS": 1}


def _at(t: str | datetime) -> Column:
    return F.lit(t).cast("timestamp")


def _covers(start: str, end: str, t: Column) -> Column:
    return (F.col(start) <= t) & (F.col(end).isNull() | (t < F.col(end)))


def current() -> Column:
    """True now and believed."""
    return F.col("valid_to").isNull() & F.col("recorded_to").isNull()


def still_valid() -> Column:
    """Open on the valid axis, superseded beliefs included."""
    return F.col("valid_to").isNull()


def as_of(t: str | datetime, include_superseded: bool = False) -> Column:
    """True in the world at ``t``: as believed now, or with superseded rows as believed at ``t``."""
    at = _at(t)
    known = _covers("recorded_from", "recorded_to", at) if include_superseded else F.col("recorded_to").isNull()
    return _covers("valid_from", "valid_to", at) & known


def as_known(t: str | datetime) -> Column:
    """Believed at ``t``, whenever it is true."""
    return _covers("recorded_from", "recorded_to", _at(t))


def listed_as_of(t: str | datetime, include_superseded: bool = False) -> Column:
    """The listing's rule: with superseded rows only what was recorded by ``t``, without an end of the belief."""
    at = _at(t)
    known = F.col("recorded_from") <= at if include_superseded else F.col("recorded_to").isNull()
    return _covers("valid_from", "valid_to", at) & known


def overlaps(axis: str, start: str | datetime, end: str | datetime) -> Column:
    """Closed overlap of ``axis`` (valid or recorded) with [start, end]."""
    return (F.col(f"{axis}_from") <= _at(end)) & (F.col(f"{axis}_to").isNull() | (F.col(f"{axis}_to") >= _at(start)))


def seen(as_of_time: str | datetime | None = None, include_superseded: bool = False, valid_during: tuple | None = None, recorded_during: tuple | None = None) -> Column:
    """What a recall may find: true and believed now; with a time what was true then (:func:`as_of`); superseded beliefs too
    if asked for. Both kinds of windows narrow it further. One predicate for all channels, applied before their limits."""
    if as_of_time is not None:
        out = as_of(as_of_time, include_superseded)
    else:
        windows = valid_during is not None or recorded_during is not None
        out = (F.lit(True) if windows else still_valid()) if include_superseded else (F.col("recorded_to").isNull() if windows else current())
    if valid_during is not None:
        out = out & overlaps("valid", *valid_during)
    if recorded_during is not None:
        out = out & overlaps("recorded", *recorded_during)
    return out


def parse_duration(text: str) -> timedelta:
    """An ISO-8601 duration with an optional sign; a month has 30 days, a year 365."""
    whole = re.fullmatch(r"\s*(-?)P((?:\d+[YMWD])*)(?:T((?:\d+[HMS])+))?\s*", text)
    if not whole or not (whole[2] or whole[3]):
        raise ValueError(f"no ISO-8601 duration: {text!r}")
    seconds = sum(int(n) * _UNITS[u] for n, u in re.findall(r"(\d+)([YMWD])", whole[2] or ""))
    seconds += sum(int(n) * _UNITS["T" + u] for n, u in re.findall(r"(\d+)([HMS])", whole[3] or ""))
    return timedelta(seconds=-seconds if whole[1] else seconds)


def window_of(expression: str, reference: datetime) -> tuple[datetime, datetime]:
    """``duration..duration`` relative to ``reference``."""
    first, dots, last = expression.partition("..")
    if not dots or ".." in last:
        raise ValueError(f"not two durations: {expression!r}")
    return reference + parse_duration(first), reference + parse_duration(last)


def phrase_window(phrase: str, reference: datetime, phrases: dict[str, str] | None = None) -> tuple[datetime, datetime] | None:
    """The window of a known phrase, in any case and with stray blanks; None for an unknown one."""
    found = (PHRASES | (phrases or {})).get(phrase.strip().lower())
    return window_of(found, reference) if found else None


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))
