"""Content-defined cuts: a 32-bit polynomial fingerprint that restarts at every cut.

A cut falls behind a byte if at least 32 bytes came since the last cut and the low bits of
the fingerprint are zero.  With ``winlen`` 0 the byte that leaves the window is mixed in
without its weight, so the fingerprint depends on all bytes since the cut and cuts do not
resynchronise after an insertion; with ``winlen`` 32 it is a proper rolling window.
"""

from __future__ import annotations

import numpy as np

#: The polynomial (its leading term is implied), the window, and the mask of a gap of 4096 bytes.
POLYNOMIAL, WINDOW, MASK = 0x45C2B6A1, 32, 0xFFF
_LOW = 0xFFFFFFFF


def append_table() -> list[int]:
    """Of each top byte what it leaves when 32 bits are shifted out."""
    out = []
    for x in range(256):
        for _ in range(32):
            x = (x << 1 & _LOW) ^ (POLYNOMIAL if x >> 31 else 0)
        out.append(x)
    return out


TABLE = append_table()


def leave_table(winlen: int) -> list[int]:
    """Of each byte its weight when it leaves a window of `winlen` bytes."""
    out = []
    for x in range(256):
        for _ in range(winlen - 1):
            x = (x << 8 & _LOW) ^ TABLE[x >> 24]
        out.append(x)
    return out


def next_cut(data: bytes, start: int, mask: int = MASK, leave: list[int] | None = None) -> int:
    """End of the chunk that begins at `start`: the first cut behind it, or the end of the data."""
    n, table = len(data), TABLE
    leave = leave or leave_table(0)
    if n - start < WINDOW:
        return n
    h = 0
    for b in data[start : start + WINDOW]:
        h = (h << 8 & _LOW | b) ^ table[h >> 24]
    i = start + WINDOW
    while h & mask:
        if i >= n:
            return n
        h ^= leave[data[i - WINDOW]]
        h = (h << 8 & _LOW | data[i]) ^ table[h >> 24]
        i += 1
    return i


def ends(data: bytes, mask: int = MASK, winlen: int = 0) -> list[int]:
    """Ends of all chunks of one stream; an empty stream has none."""
    out, at, leave = [], 0, leave_table(winlen)
    while at < len(data):
        at = next_cut(data, at, mask, leave)
        out.append(at)
    return out


def coarse_ends(data: bytes, jump: int, mask: int = MASK, winlen: int = 0) -> list[int]:
    """Ends of coarse chunks: `jump` bytes are skipped, then the first cut ends the chunk."""
    out, at, leave = [], 0, leave_table(winlen)
    while len(data) - at > jump:
        end = next_cut(data, at + jump, mask, leave)
        if end >= len(data):
            break
        out.append(end)
        at = end
    return [*out, len(data)] if data else []


def ends_side_by_side(texts: list[bytes], mask: int = MASK, winlen: int = 0, lanes: int = 24) -> list[list[int]]:
    """`ends` of many streams, byte i of all at once; the few longest are finished one by one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return ends_inside(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes, mask, winlen, lanes)


def ends_inside(body: np.ndarray, offset: np.ndarray, sizes: np.ndarray, mask: int = MASK, winlen: int = 0, lanes: int = 24) -> list[list[int]]:
    """`ends_side_by_side` of streams where they lie in one body of bytes, which is not copied."""
    order = np.argsort(-sizes, kind="stable")
    sizes, offset, order = sizes[order], offset[order], order.tolist()
    table, leave, falling = np.array(TABLE, np.uint32), np.array(leave_table(winlen), np.uint32), -sizes
    h, start = np.zeros(len(order), np.uint32), np.zeros(len(order), np.int64)
    out: list[list[int]] = [[] for _ in order]
    step, m = 0, int((sizes > 0).sum())
    while m >= lanes:
        now = h[:m]
        old = step - start[:m] >= WINDOW
        if step >= WINDOW:
            now ^= np.where(old, leave[body[offset[:m] + step - WINDOW]], np.uint32(0))
        now[:] = (now << np.uint32(8) | body[offset[:m] + step]) ^ table[now >> np.uint32(24)]
        step += 1
        cut = np.flatnonzero(((now & np.uint32(mask)) == 0) & (step - start[:m] >= WINDOW))
        for i in cut.tolist():
            out[order[i]].append(step)
        start[cut], h[cut] = step, 0
        m = int(np.searchsorted(falling, -step, side="left"))
    leave = leave_table(winlen)
    for k, (n, a) in enumerate(zip(sizes.tolist(), offset.tolist(), strict=True)):
        own = out[order[k]]
        at = own[-1] if own else 0
        if k < m:
            text = body[a : a + n].tobytes()
            while at < n:
                at = next_cut(text, at, mask, leave)
                own.append(at)
        if n and (not own or own[-1] < n):
            own.append(n)
    return out
