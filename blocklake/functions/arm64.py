"""Branch addresses of ARM64 code."""

from __future__ import annotations

import numpy as np


def arm64(data: bytes, start: int, encode: bool) -> bytes:
    """Branch (BL) and page (ADRP) addresses of 4-byte instructions, relative to absolute or back, all at once.

    BL keeps 26 bits of the address in words. ADRP keeps 21 bits of the page; only pages within 2**17 of zero,
    as signed numbers, are converted, and the result is cut to that range with its sign.
    """
    n = len(data) // 4
    code = np.frombuffer(data, "<u4", n).astype(np.int64)
    place = (start + 4 * np.arange(n, dtype=np.int64)) & 0xFFFFFFFF
    sign = 1 if encode else -1
    out = code.copy()
    call = code >> 26 == 0x25
    out[call] = 0x94000000 | (code[call] + sign * (place[call] >> 2)) & 0x3FFFFFF
    page = (code >> 29 & 3) | (code >> 5 & 0x7FFFF) << 2
    signed = np.where(page >= 1 << 20, page - (1 << 21), page)
    near = (code & 0x9F000000 == 0x90000000) & (signed >= -(1 << 17)) & (signed < 1 << 17)
    moved = (signed[near] + sign * (place[near] >> 12)) & 0x3FFFF
    moved = np.where(moved >= 1 << 17, moved - (1 << 18), moved) & 0x1FFFFF
    out[near] = code[near] & 0x9000001F | (moved & 3) << 29 | (moved >> 2) << 5
    return out.astype("<u4").tobytes() + data[4 * n :]
