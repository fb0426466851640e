"""Simple-8b word-aligned integer coding, vectorised with numpy.

A 64-bit word has a selector in its top 4 bits and SELECTORS[selector] = (how many, of how many bits) values below,
the first in the lowest bits. Selector 0 is an escape: the whole next word is one value of more than 60 bits.
Values are cut in blocks of BLOCK; blocks are coded one by one, so that each can be decoded alone from its offset.

A payload, little-endian: b"S8B1", u32 values a block, u64 values, u32 blocks, u32 0, u32 word offsets of
the blocks and of the end, padding to 8 bytes, words.
"""

from __future__ import annotations

import numpy as np

# fixed values of the coding
SELECTORS = ((1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
MAGIC = b"S8B1"
BLOCK = 1024
_COUNT = np.array([c for c, _ in SELECTORS], np.int64)
_HEAD = np.dtype([("magic", "S4"), ("block", "<u4"), ("n", "<u8"), ("blocks", "<u4"), ("zero", "<u4")])


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    out = np.zeros(len(v), np.uint8)
    rest = v.copy()
    while rest.any():
        big = rest >= np.uint64(1 << 16)
        low = np.minimum(rest, np.uint64(0xFFFF)).astype(np.float64)
        out += np.where(big, np.uint8(16), np.frexp(low)[1].astype(np.uint8))
        rest = np.where(big, rest >> np.uint64(16), np.uint64(0))
    return out


def _best(width: np.ndarray) -> np.ndarray:
    """The selector of most values at each place; places past the end count as zeros."""
    n, best = len(width), np.where(width > 60, 0, 15).astype(np.uint8)
    padded = np.concatenate([width, np.zeros(120, np.uint8)])
    top, have = padded, 1  # top[i]: the most bits among `have` values from i
    for s in range(14, 0, -1):
        c, bits = SELECTORS[s]
        while have < c:
            step = min(have, c - have)
            top, have = np.maximum(top[: len(top) - step], top[step:]), have + step
        fits = top[:n] <= bits
        if not fits.any():
            break  # more values of fewer bits fit nowhere either
        best[fits] = s
    return best


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    v = np.ascontiguousarray(values).astype(np.uint64)
    n, blocks = len(v), -(-len(v) // block)
    row = block + 120
    m = np.zeros((blocks, row), np.uint64)
    if n:
        whole = n // block
        m[:whole, :block] = v[: whole * block].reshape(whole, block)
        if whole < blocks:
            m[whole, : n - whole * block] = v[whole * block :]
    flat = m.ravel()
    best = _best(_widths(flat)) if n else np.zeros(0, np.uint8)
    ends = np.minimum(np.arange(1, blocks + 1) * block, n) - np.arange(blocks) * block
    at, live, places, owners = np.zeros(blocks, np.int64), np.arange(blocks), [], []
    base = np.arange(blocks) * row
    while len(live):  # one word of every block that isn't at its end
        p = base[live] + at[live]
        places.append(p)
        owners.append(live)
        at[live] += _COUNT[best[p]]
        live = live[at[live] < ends[live]]
    p = np.concatenate(places) if places else np.zeros(0, np.int64)
    own = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(own, kind="stable")
    p, own = p[order], own[order]
    sel = best[p]
    escaped = sel == 0
    room = np.cumsum(1 + escaped) - 1 - escaped  # where each word goes
    words = np.zeros(len(p) + int(escaped.sum()), np.uint64)
    words[room[escaped] + 1] = flat[p[escaped]]
    for s in range(1, 16):
        if len(k := np.flatnonzero(sel == s)):
            c, bits = SELECTORS[s]
            word = np.full(len(k), np.uint64(s) << np.uint64(60))
            if bits:
                for j in range(c):
                    word |= flat[p[k] + j] << np.uint64(bits * j)
            words[room[k]] = word
    offsets = np.zeros(blocks + 1, np.int64)
    np.add.at(offsets, own + 1, 1 + escaped)
    head = np.array([(MAGIC, block, n, blocks, 0)], _HEAD).tobytes()
    index = np.cumsum(offsets).astype("<u4").tobytes()
    return b"".join((head, index, b"\0" * (-(len(head) + len(index)) % 8), words.astype("<u8").tobytes()))


def _parts(payload: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    head = np.frombuffer(payload, _HEAD, 1)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    blocks = int(head["blocks"])
    offsets = np.frombuffer(payload, "<u4", blocks + 1, _HEAD.itemsize).astype(np.int64)
    at = _HEAD.itemsize + 4 * (blocks + 1)
    return int(head["n"]), int(head["block"]), offsets, np.frombuffer(payload, "<u8", int(offsets[-1]), at + -at % 8)


def _unpack(words: np.ndarray, offsets: np.ndarray, block: int, n: int) -> np.ndarray:
    """Values of the blocks whose words start at offsets (the last offset is the end); n: all values of them."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == 0).any():  # a raw word may look like an escape: those blocks are walked
        for b in np.unique(np.searchsorted(offsets, np.flatnonzero(sel == 0), "right") - 1):
            i = int(offsets[b])
            while i < offsets[b + 1]:
                if sel[i] == 0:
                    raw[i + 1] = True
                    i += 1
                i += 1
    count = np.where(raw, 1, np.where(sel == 0, 0, _COUNT[sel]))
    first = np.cumsum(count) - count
    owner = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    start = np.arange(len(offsets) - 1) * block
    place = first - (first[np.minimum(offsets[:-1], max(len(first) - 1, 0))] - start)[owner] if len(words) else first
    end = np.minimum(start + block, n)[owner]
    out = np.zeros(n, np.uint64)
    k = np.flatnonzero(raw)
    out[place[k]] = words[k]
    for s in range(2, 16):
        if len(k := np.flatnonzero((sel == s) & ~raw)):
            c, bits = SELECTORS[s]
            mask = np.uint64((1 << bits) - 1)
            for j in range(c):
                q = place[k] + j
                inside = q < end[k]
                out[q[inside]] = (words[k[inside]] >> np.uint64(bits * j)) & mask
    return out


def decode(payload: bytes) -> np.ndarray:
    n, block, offsets, words = _parts(payload)
    return _unpack(words, offsets, block, n)


def decode_block(payload: bytes, b: int) -> np.ndarray:
    """The values of one block, read from its offset."""
    n, block, offsets, words = _parts(payload)
    return _unpack(words[offsets[b] : offsets[b + 1]], offsets[b : b + 2] - offsets[b], block, min(block, n - b * block))
