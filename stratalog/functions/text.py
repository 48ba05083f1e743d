"""Small text helpers."""

from __future__ import annotations


def human_bytes(n: int) -> str:
    """1536 as '1.5 KiB'."""
    size, units = float(n), ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
    while size >= 1024 and len(units) > 1:
        size /= 1024
        units.pop(0)
    return f"{int(size)} B" if units[0] == "B" else f"{size:.1f} {units[0]}"
