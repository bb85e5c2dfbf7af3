"""Entry modes."""

from __future__ import annotations

from enum import IntEnum


class Mode(IntEnum):
    GRAY = 0  # loaded in bulk
    WHITE = 1  # added by hand
    BLACK = 2  # removed by hand
    ACTIVE = 3  # gray and white, in queries only
    CUSTOM = 4  # white and black, in queries only
    PATTERN = 5  # selects patterns
    AUTO_EXPANDED = 6
