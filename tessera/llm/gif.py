"""A small GIF89a codec: LZW streams, palettes, disposal, transparency, timed frames.

``encode`` stores bytes losslessly as the palette indices of greyscale frames;
``decode`` reads any non-interlaced or interlaced GIF and composes its frames.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

WIDTH, ROWS = 192, 4096
#: Pictures declared larger than this count as damaged, so that a few bytes cannot claim a task's memory.
MOST_PIXELS = 1 << 26
_GREY = bytes(v for i in range(256) for v in (i, i, i))


@dataclass
class Frame:
    """A composed picture: (height, width) palette indices of its own image, RGBA canvas and delay."""

    indices: np.ndarray
    canvas: np.ndarray | None
    delay_ms: int
    disposal: int


@lru_cache(maxsize=64)
def _widths(first: int, count: int, depth: int) -> np.ndarray:
    """Bits of the codes first, first + 1, ... after a clear code: the table grows by one a code."""
    top = (1 << depth) + 1 + np.arange(first, first + count)
    return np.clip(np.floor(np.log2(top)).astype(np.int64) + 1, depth + 1, 12)


def lzw_encode(data: bytes, depth: int = 8) -> bytes:
    """GIF LZW: codes of growing width, least significant bit first, a clear code when the table is full."""
    clear, base = 1 << depth, (1 << depth) + 2
    codes, widths = [], []
    pixels, prefix = iter(data), -1
    more = True
    while more:
        table: dict[int, int] = {}
        find, run = table.get, [clear]
        put, free, more = run.append, base, False
        for pixel in pixels:
            key = prefix << 8 | pixel
            code = find(key)
            if code is not None:
                prefix = code
            elif prefix < 0:
                prefix = pixel
            else:
                put(prefix)
                table[key] = free
                prefix = pixel
                free += 1
                if free == 4096:
                    more = True
                    break
        # A clear code is written in the width of the codes before it.
        last = widths[-1][-1] if widths else depth + 1
        if not more:
            run += [prefix, clear + 1] if prefix >= 0 else [clear + 1]
        codes.append(np.array(run, dtype=np.int64))
        widths.append(np.concatenate([[last], _widths(0, len(run) - 1, depth)]))
    c, w = np.concatenate(codes), np.concatenate(widths)
    shifts = np.arange(12)
    return np.packbits((c[:, None] >> shifts & 1).astype(np.uint8)[shifts < w[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, depth: int) -> bytes:
    """The pixels of a GIF LZW stream; stops at the end code or the end of the data.

    Between clear codes the widths are known beforehand, so codes are read in
    bulk. A table entry is the text of an earlier code and the pixel after it,
    which is a stretch of the output: lengths and pixels follow by doubling
    pointers to earlier codes and pixels.
    """
    clear, base = 1 << depth, (1 << depth) + 2
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    bit, limit, out = 0, 8 * len(data), []
    while True:
        parts, first, ended = [], 0, True
        while True:
            w = _widths(first, 4096, depth)
            starts = bit + np.cumsum(w) - w
            w, starts = w[starts + w <= limit], starts[starts + w <= limit]
            if not len(w):
                break
            i = starts >> 3
            codes = (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (starts & 7) & (1 << w) - 1
            marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(marks):
                parts.append(codes[: marks[0]])
                bit = int(starts[marks[0]] + w[marks[0]])
                ended = bool(codes[marks[0]] == clear + 1)
                break
            parts.append(codes)
            bit, first = int(starts[-1] + w[-1]), first + len(w)
        if parts:
            out.append(_expand(np.concatenate(parts), clear, base))
        if ended:
            return b"".join(out)


def _expand(codes: np.ndarray, clear: int, base: int) -> bytes:
    n = len(codes)
    order = np.arange(n)
    root = codes < clear
    back = np.where(root, order, codes - base)
    if (~root & ((back >= order) | (back < 0))).any():
        raise ValueError("broken LZW stream")
    steps, to = (~root).astype(np.int64), back
    while not root[to].all():
        steps, to = steps + steps[to], to[to]
    length = steps + 1
    at = np.cumsum(length) - length
    source = np.arange(int(length.sum())) + np.repeat(at[back] - at, length)
    literal = np.repeat(codes, length)
    fixed = np.repeat(root, length)
    while not fixed[source].all():
        source = source[source]
    return literal[source].astype(np.uint8).tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, delay_cs: int = 10) -> bytes:
    """A GIF whose frames' indices, row by row, are ``payload`` (a positive multiple of WIDTH bytes)."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload must fill whole rows")
    height = min(ROWS, len(payload) // WIDTH)
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), _GREY, b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for at in range(0, len(payload), WIDTH * ROWS):
        piece = payload[at : at + WIDTH * ROWS]
        parts.append(b"!\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay_cs, 0, 0))
        parts.append(b"," + struct.pack("<HHHHB", 0, 0, WIDTH, len(piece) // WIDTH, 0) + b"\x08" + _blocks(lzw_encode(piece)))
    return b"".join(parts) + b";"


def decode(gif: bytes, compose: bool = True) -> list[Frame]:
    """All frames, with palette, transparency and disposal applied to the canvas if ``compose``."""
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", gif[6:13])
    if width * height > MOST_PIXELS:
        raise ValueError("picture too large")
    at = 13
    shared = None
    if flags & 0x80:
        size = 3 << (flags & 7) + 1
        shared, at = gif[at : at + size], at + size
    canvas = np.zeros((height, width, 4), dtype=np.uint8) if compose else None
    frames: list[Frame] = []
    delay, disposal, clear = 0, 0, None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(gif) and gif[at]:
            parts.append(gif[at + 1 : at + 1 + gif[at]])
            at += 1 + gif[at]
        return b"".join(parts), at + 1

    while at < len(gif) and gif[at] != 0x3B:
        mark = gif[at]
        if mark == 0x21:
            label = gif[at + 1]
            data, at = blocks(at + 2)
            if label == 0xF9 and len(data) >= 4:
                bits, delay, key = struct.unpack("<BHB", data[:4])
                disposal, clear = bits >> 2 & 7, key if bits & 1 else None
            continue
        if mark != 0x2C:
            raise ValueError("broken GIF")
        left, top, w, h, bits = struct.unpack("<HHHHB", gif[at + 1 : at + 10])
        if w * h > MOST_PIXELS:
            raise ValueError("picture too large")
        at += 10
        palette = shared
        if bits & 0x80:
            size = 3 << (bits & 7) + 1
            palette, at = gif[at : at + size], at + size
        depth = gif[at]
        data, at = blocks(at + 1)
        pixels = np.frombuffer(lzw_decode(data, depth)[: w * h].ljust(w * h, b"\0"), dtype=np.uint8).reshape(h, w)
        if bits & 0x40:
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(pixels)
            straight[order] = pixels
            pixels = straight
        shown = None
        if canvas is not None:
            before = canvas.copy() if disposal == 3 else None
            colours = np.zeros((256, 4), dtype=np.uint8)
            table = np.frombuffer(palette or _GREY, dtype=np.uint8).reshape(-1, 3)
            colours[: len(table), :3], colours[: len(table), 3] = table, 255
            area = canvas[top : top + h, left : left + w]
            new = pixels[: area.shape[0], : area.shape[1]]
            if clear is None:
                area[...] = colours[new]
            else:
                seen = new != clear
                area[seen] = colours[new[seen]]
            shown = canvas.copy()
            if disposal == 2:
                area[...] = 0
            elif before is not None:
                canvas[...] = before
        frames.append(Frame(pixels, shown, delay * 10, disposal))
        delay, disposal, clear = 0, 0, None
    return frames
