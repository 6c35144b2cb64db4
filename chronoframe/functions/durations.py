"""Durations of configurations: compounds of Go's units with d and w."""

from __future__ import annotations

import re

#: Units in milliseconds.
UNITS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6, "d": 8.64e7, "w": 6.048e8}
PART = re.compile(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d|w)")


def config_duration(text: str) -> int:
    """Milliseconds of e.g. 1d12h or 500ms. Days and weeks take whole numbers."""
    at, total = 0, 0.0
    while at < len(text):
        found = PART.match(text, at)
        if not found or found[2] in "dw" and "." in found[1]:
            raise ValueError(f"malformed duration {text!r}")
        total += float(found[1]) * UNITS[found[2]]
        at = found.end()
    if not text:
        raise ValueError("empty duration")
    return round(total)
