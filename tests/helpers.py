"""Values that several test modules build their rows from."""

from __future__ import annotations

from datetime import date


def month(index: int) -> date:
    """First day of the month ``index`` months after January 2020."""
    return date(2020 + index // 12, index % 12 + 1, 1)
