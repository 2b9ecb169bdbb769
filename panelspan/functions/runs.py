"""Run names and path parts."""

from __future__ import annotations

import re
from datetime import datetime, timezone

_STEM = "%Y%m%d-%H%M%S"


def run_stem(now: datetime | None = None) -> str:
    """A UTC stem such as 20240131-235959."""
    return (now or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime(_STEM)


def parse_stem(stem: str) -> datetime:
    return datetime.strptime(stem, _STEM).replace(tzinfo=timezone.utc)


def component(name: str) -> str:
    """The name, if it is a single safe path component."""
    if not name or name in (".", "..") or re.search(r"[/\\\0]", name):
        raise ValueError(f"not a single path component: {name!r}")
    return name
