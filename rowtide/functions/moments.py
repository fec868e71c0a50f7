"""Timestamps as an operator types them, and as scripts and reports print them."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, tzinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import BadRequest, Filter

_ZONED = re.compile(r"(\d{4}-\d\d-\d\d)T(\d\d:\d\d:\d\d)(\.\d+)?(Z|[+-]\d\d:?\d\d)")
_WITH_DATE = re.compile(r"(\d{4}-\d\d-\d\d)(?:[ T](\d\d:\d\d)(:\d\d)?)?")
_TIME_ONLY = re.compile(r"(\d\d?:\d\d)(:\d\d)?")


def parse_time(text: str, now: datetime | None = None, local: tzinfo | None = None) -> datetime:
    """A moment, in UTC.

    A zone in the text holds; without one the text means ``local`` time.  A time without
    a date is its most recent occurrence as seen from ``now``: never in the future.
    """
    now = now or datetime.now(UTC)
    local = local or datetime.now().astimezone().tzinfo
    try:
        if m := _ZONED.fullmatch(text):
            zone = "+00:00" if m[4] == "Z" else m[4] if ":" in m[4] else f"{m[4][:3]}:{m[4][3:]}"
            fraction = (m[3] or "")[:7]
            return datetime.fromisoformat(f"{m[1]}T{m[2]}{fraction}{zone}").astimezone(UTC)
        if m := _WITH_DATE.fullmatch(text):
            return datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00'}{m[3] or ''}").replace(tzinfo=local).astimezone(UTC)
        if m := _TIME_ONLY.fullmatch(text):
            here = now.astimezone(local)
            clock = datetime.strptime(f"{m[1]}{m[2] or ':00'}", "%H:%M:%S")
            moment = here.replace(hour=clock.hour, minute=clock.minute, second=clock.second, microsecond=0)
            return (moment - timedelta(days=1) if moment > here else moment).astimezone(UTC)
    except ValueError:
        pass
    raise BadRequest(f"cannot read {text!r} as a timestamp; try 15:04, 2006-01-02 15:04:05 or 2006-01-02T15:04:05+07:00")


def split_list(text: str | None) -> tuple[str, ...]:
    """Comma-separated names, trimmed, blanks left out."""
    return tuple(x.strip() for x in (text or "").split(",") if x.strip())


def whole_number(text: str | None, name: str) -> int:
    """An absent parameter is 0; an unreadable one is refused."""
    if text is None or text == "":
        return 0
    if not re.fullmatch(r"[+-]?\d+", text) or not -(1 << 63) <= int(text) < 1 << 63:
        raise BadRequest(f"{name}: {text!r} is not a number")
    return int(text)


def filter_from(parameters: dict[str, str], now: datetime | None = None, local: tzinfo | None = None) -> Filter:
    """A filter from the parameters ``tables``, ``from`` and ``to``."""
    bounds = {}
    for name in ("from", "to"):
        try:
            bounds[name] = parse_time(parameters[name], now, local) if parameters.get(name) else None
        except BadRequest as e:
            raise BadRequest(f"{name}: {e}") from None
    return Filter(split_list(parameters.get("tables")), bounds["from"], bounds["to"])


def stamp(moment: datetime) -> str:
    """``2006-01-02 15:04:05`` in UTC."""
    return moment.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S")


def rfc3339(moment: datetime) -> str:
    return moment.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def rfc3339_column(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def stamp_column(moment: Column) -> Column:
    return F.concat(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def describe_window(f: Filter) -> str:
    """The bounds in words; nothing for an unbounded window."""
    if f.start and f.end:
        return f"{stamp(f.start)} UTC to {stamp(f.end)} UTC"
    if f.start:
        return f"from {stamp(f.start)} UTC"
    return f"up to {stamp(f.end)} UTC" if f.end else ""


def plural(n: int, noun: str) -> str:
    return f"{n} {noun}" if n == 1 else f"{n} {noun}s"


def duration(seconds: float) -> str:
    """Hours, minutes and whole seconds, as in 1h0m5s."""
    total = round(seconds)
    sign, total = ("-", -total) if total < 0 else ("", total)
    h, m, s = total // 3600, total // 60 % 60, total % 60
    return sign + (f"{h}h{m}m{s}s" if h else f"{m}m{s}s" if m else f"{s}s")
