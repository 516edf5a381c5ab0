"""Small helpers on 64-bit identifiers."""

from __future__ import annotations

import random


def round_mask(nth: int) -> int:
    """A fixed 63-bit pattern per round; ``id XOR mask`` orders ids anew without a table."""
    return random.Random(f"round {nth}").getrandbits(63)
