"""GIF's LZW: variable code size from min_bits + 1 to 12, clear code first, end code last."""

from __future__ import annotations

import numpy as np


def min_bits(colours: int) -> int:
    return max(2, (max(colours, 1) - 1).bit_length())


def encode(data: bytes, bits: int = 8) -> bytes:
    """The size grows when the next free code no longer fits; at 4096 codes the table is cleared. A word is its code; a longer one is found by
    code and byte in one number."""
    clear, end = 1 << bits, (1 << bits) + 1
    if data and max(data) >= clear:
        raise ValueError(f"a value above {clear - 1}")
    codes, sizes = [clear], [bits + 1]
    size, table, free, grows = bits + 1, {}, end + 1, 1 << (bits + 1)
    find, code = table.get, -1
    for v in data:
        if code < 0:
            code = v
            continue
        key = code << 8 | v
        longer = find(key)
        if longer is not None:
            code = longer
            continue
        codes.append(code)
        sizes.append(size)
        if free < 4096:
            table[key] = free
            free += 1
            if free > grows and size < 12:
                size += 1
                grows <<= 1
        else:
            codes.append(clear)
            sizes.append(size)
            size, free, grows = bits + 1, end + 1, 1 << (bits + 1)
            table.clear()
        code = v
    if code >= 0:
        codes.append(code)
        sizes.append(size)
        if free == 1 << size and size < 12:  # the reader has added one more by now
            size += 1
    codes.append(end)
    sizes.append(size)
    return _packed_bits(np.array(codes, np.int64), np.array(sizes, np.int64))


def _packed_bits(codes: np.ndarray, sizes: np.ndarray) -> bytes:
    """Codes of 12 bits at most, the lowest bit first."""
    at = np.cumsum(sizes) - sizes
    shifted = codes << (at & 7)
    out = np.zeros(int(at[-1] + sizes[-1] + 7) // 8 + 3, np.int64)
    for k in range(3):
        np.bitwise_or.at(out, (at >> 3) + k, shifted >> (8 * k) & 255)
    return out[: int(at[-1] + sizes[-1] + 7) // 8].astype(np.uint8).tobytes()


def decode(coded: bytes, bits: int = 8) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    out, acc, filled = bytearray(), 0, 0
    size, table, before = bits + 1, [], b""
    for byte in coded:
        acc |= byte << filled
        filled += 8
        while filled >= size:
            code = acc & ((1 << size) - 1)
            acc >>= size
            filled -= size
            if code == clear:
                size, table, before = bits + 1, [bytes([i]) for i in range(clear)] + [b"", b""], b""
                continue
            if code == end:
                return bytes(out)
            if code < len(table):
                word = table[code]
            elif before and code == len(table):
                word = before + before[:1]
            else:
                raise ValueError(f"code {code} isn't in the table")
            out += word
            if before and len(table) < 4096:
                table.append(before + word[:1])
            if len(table) == 1 << size and size < 12:
                size += 1
            before = word
    raise ValueError("no end code")


def sub_blocks(data: bytes) -> list[bytes]:
    """Of 255 bytes at most, each with its length before it, and an empty one."""
    return [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)] + [b"\0"]
