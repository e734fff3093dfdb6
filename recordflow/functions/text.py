"""Numbers for people to read."""

from __future__ import annotations


def short_number(n: int) -> str:
    """12345 as 12K, 12345678 as 12M."""
    return f"{n // 1_000_000}M" if n >= 1_000_000 else f"{n // 1000}K" if n >= 1000 else str(n)


def size_text(n: int) -> str:
    """Bytes with a binary unit."""
    for unit, size in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= size:
            return f"{n / size:.2f} {unit}"
    return f"{n} B"


def yes_no(x: bool) -> str:
    return "yes" if x else "no"


def ok_bad(x: bool) -> str:
    return "ok" if x else "bad"


def progress(done: int, total: int, width: int = 40) -> str:
    """A bar with a percentage."""
    part = 1.0 if total <= 0 else min(1.0, done / total)
    full = int(part * width)
    return f"[{'#' * full}{'.' * (width - full)}] {part:.0%}"
