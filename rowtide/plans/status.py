"""Health of a store as a dictionary and as text."""

from __future__ import annotations

from ..functions.moments import duration, plural, rfc3339, stamp
from .coverage import Report


def as_dict(path: str, r: Report) -> dict:
    """Empty lists stay lists, absent parts are None, times are RFC 3339, durations whole seconds."""
    c = r.coverage
    covered = c.end is not None
    return {
        "store": path,
        "healthy": r.healthy(),
        "verdict": r.verdict(),
        "source": vars(r.binding).copy() if r.binding else None,
        "coverage": {
            "from": rfc3339(c.start) if c.start else None,
            "to": rfc3339(c.end),
            "max_staleness_seconds": int(c.max_staleness.total_seconds()),
            "retention_seconds": int(c.retention.total_seconds()),
        }
        if covered
        else None,
        "stale_seconds": round(r.stale.total_seconds()) if covered else 0,
        "integrity_problems": list(r.problems),
        "gaps": [{"from": rfc3339(g.start), "to": rfc3339(g.end), "reason": g.reason} for g in r.gaps],
        "misses": [{"at": rfc3339(m.moment), "reason": m.reason} for m in r.misses],
    }


def as_text(path: str, r: Report) -> str:
    c = r.coverage
    lines = [f"store:     {path}", f"status:    {r.verdict() or 'OK'}"]
    if r.binding:
        lines.append(f"source:    {r.binding.flavor} {r.binding.server_identity}")
    if c.end:
        lines.append(f"coverage:  {stamp(c.start) if c.start else '?'} to {stamp(c.end)} UTC, {duration(r.stale.total_seconds())} behind")
        lines.append(f"retention: {duration(c.retention.total_seconds()) if c.retention else 'everything is kept'}")
    lines += [f"problem:   {p}" for p in r.problems]
    lines.append(plural(len(r.gaps), "gap"))
    lines += [f"  {stamp(g.start)} to {stamp(g.end)} UTC: {g.reason}" for g in r.gaps]
    lines.append(plural(len(r.misses), "missed change"))
    lines += [f"  {stamp(m.moment)} UTC: {m.reason}" for m in r.misses]
    return "\n".join(lines) + "\n"
