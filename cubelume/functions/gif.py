"""GIF89a bytes: writing, walking, taking apart and putting together; and the bank and stream containers."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from . import lzw


@dataclass
class Frame:
    indices: bytes
    delay: int = 4
    left: int = 0
    top: int = 0
    width: int = 0
    height: int = 0
    palette: list[tuple[int, int, int]] | None = None
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    palette: list[tuple[int, int, int]] | None
    frames: list[Frame] = field(default_factory=list)
    loops: int | None = 0


def _table(palette: list[tuple[int, int, int]]) -> tuple[int, bytes]:
    bits = max(1, (max(len(palette), 2) - 1).bit_length())
    return bits, b"".join(bytes(c) for c in palette) + b"\0\0\0" * ((1 << bits) - len(palette))


def head(width: int, height: int, palette: list | None, loops: int | None = 0) -> bytes:
    bits, table = _table(palette) if palette else (8, b"")
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, (0x80 if palette else 0) | 0x70 | bits - 1, 0, 0) + table
    return out + (b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0" if loops is not None else b"")


def frame_bytes(f: Frame, width: int, height: int, colours: int = 256) -> bytes:
    flags = f.disposal << 2 | (f.transparent is not None)
    out = b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay, f.transparent or 0) + b"\0"
    bits, table = _table(f.palette) if f.palette else (0, b"")
    out += b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.width or width, f.height or height, 0x80 | bits - 1 if f.palette else 0) + table
    n = lzw.min_bits(len(f.palette) if f.palette else colours)
    return out + bytes([n]) + b"".join(lzw.sub_blocks(lzw.encode(f.indices, n)))


def write(g: Gif) -> bytes:
    return head(g.width, g.height, g.palette, g.loops) + b"".join(frame_bytes(f, g.width, g.height, len(g.palette or [])) for f in g.frames) + b"\x3b"


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = bytearray()
    while True:
        n = data[at]
        at += 1
        if not n:
            return bytes(out), at
        if at + n > len(data):
            raise ValueError("a block is cut off")
        out += data[at : at + n]
        at += n


def _colours(data: bytes, at: int, bits: int) -> list[tuple[int, int, int]]:
    if at + (3 << bits) > len(data):
        raise ValueError("a colour table is cut off")
    return [tuple(data[at + 3 * i : at + 3 * i + 3]) for i in range(1 << bits)]


def read(data: bytes, pixels: bool = True) -> Gif:
    """Raises ValueError where the bytes aren't a GIF; without pixels, indices stay coded."""
    try:
        return _read(data, pixels)
    except (IndexError, struct.error) as e:
        raise ValueError("the file is cut off") from e


def _read(data: bytes, pixels: bool) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        palette = _colours(data, at, (flags & 7) + 1)
        at += 3 * len(palette)
    g, control = Gif(width, height, palette, [], None), (0, 0, 0)
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return g
        if kind == 0x21:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == 0xF9:
                control = struct.unpack("<BHB", body[:4])
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0":
                g.loops = struct.unpack_from("<H", body, 12)[0]
        elif kind == 0x2C:
            left, top, w, h, f = struct.unpack_from("<HHHHB", data, at)
            at += 9
            own = None
            if f & 0x80:
                own = _colours(data, at, (f & 7) + 1)
                at += 3 * len(own)
            bits = data[at]
            coded, at = _blocks(data, at + 1)
            indices = lzw.decode(coded, bits) if pixels else coded
            if pixels and len(indices) != w * h:
                raise ValueError(f"a frame has {len(indices)} of {w * h} pixels")
            g.frames.append(Frame(indices, control[1], left, top, w, h, own, control[0] >> 2 & 7, control[2] if control[0] & 1 else None))
            control = (0, 0, 0)
        else:
            raise ValueError(f"no block begins with {kind:#x}")


def report(data: bytes) -> dict:
    """What a validator says of the bytes: valid, the reason if not, and the counts it came to."""
    out = {"valid": False, "reason": None, "width": None, "height": None, "frames": 0, "global_colours": 0, "local_tables": 0, "loops": None, "trailer": data[-1:] == b"\x3b", "bytes": len(data)}
    try:
        g = read(data)
    except ValueError as e:
        return out | {"reason": str(e)}
    if not g.frames:
        return out | {"reason": "no frame"}
    return out | {"valid": True, "width": g.width, "height": g.height, "frames": len(g.frames), "global_colours": len(g.palette or []), "local_tables": sum(f.palette is not None for f in g.frames), "loops": g.loops}


def swapped(data: bytes, palette: list[tuple[int, int, int]]) -> bytes:
    """The same file with another global table of the same size, in place."""
    if not data[10] & 0x80 or len(palette) != 1 << (data[10] & 7) + 1:
        raise ValueError("no global table of that size")
    return data[:13] + b"".join(bytes(c) for c in palette) + data[13 + 3 * len(palette) :]


# ---- palette bank ("CLPB") and frame stream ("CLFS"): our own little-endian containers
def write_bank(palettes: list[list[tuple[int, int, int]]], name: str = "") -> bytes:
    n = name.encode()
    out = [b"CLPB", struct.pack("<BII", 1, len(palettes), len(n)), n]
    for p in palettes:
        out += [struct.pack("<H", len(p)), b"".join(bytes(c) for c in p)]
    return b"".join(out)


def read_bank(data: bytes) -> tuple[str, list[list[tuple[int, int, int]]]]:
    if data[:4] != b"CLPB":
        raise ValueError("not a palette bank")
    version, n, length = struct.unpack_from("<BII", data, 4)
    if version != 1:
        raise ValueError("a palette bank of another version")
    at, name, out = 13 + length, data[13 : 13 + length].decode(), []
    for _ in range(n):
        (k,) = struct.unpack_from("<H", data, at)
        if at + 2 + 3 * k > len(data):
            raise ValueError("the palette bank is cut off")
        out.append([tuple(data[at + 2 + 3 * i : at + 5 + 3 * i]) for i in range(k)])
        at += 2 + 3 * k
    return name, out


def write_stream(width: int, height: int, frames: list[tuple[int, int, bytes]]) -> bytes:
    """frames: palette ref, delay, indices."""
    out = [b"CLFS", struct.pack("<BHHI", 1, width, height, len(frames))]
    for ref, delay, indices in frames:
        coded = lzw.encode(indices, 8)
        out += [struct.pack("<IHI", ref, delay, len(coded)), coded]
    return b"".join(out)


def read_stream(data: bytes) -> tuple[int, int, list[tuple[int, int, bytes]]]:
    if data[:4] != b"CLFS":
        raise ValueError("not a frame stream")
    version, width, height, n = struct.unpack_from("<BHHI", data, 4)
    if version != 1:
        raise ValueError("a frame stream of another version")
    at, out = 13, []
    for _ in range(n):
        ref, delay, length = struct.unpack_from("<IHI", data, at)
        if at + 10 + length > len(data):
            raise ValueError("the frame stream is cut off")
        out.append((ref, delay, lzw.decode(data[at + 10 : at + 10 + length], 8)))
        at += 10 + length
    return width, height, out


def demux(data: bytes) -> tuple[bytes, bytes]:
    """GIF -> bank and stream; a frame without a table of its own refers to the global one."""
    g = read(data)
    palettes, frames = [g.palette] if g.palette else [], []
    for f in g.frames:
        if f.palette is not None:
            palettes.append(f.palette)
        frames.append((len(palettes) - 1 if f.palette is not None else 0, f.delay, f.indices))
    return write_bank(palettes), write_stream(g.width, g.height, frames)


def mux(bank: bytes, stream: bytes) -> bytes:
    """bank and stream -> GIF; the first palette is the global table."""
    _, palettes = read_bank(bank)
    width, height, frames = read_stream(stream)
    if any(ref >= len(palettes) for ref, _, _ in frames):
        raise ValueError("a frame's palette isn't in the bank")
    return write(Gif(width, height, palettes[0] if palettes else None, [Frame(ix, delay, palette=palettes[ref] if ref else None) for ref, delay, ix in frames]))
