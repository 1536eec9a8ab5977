"""Lossless WebP columns: a decoder for the whole VP8L format, and encoders for payloads and pixels.

``decode`` reads prefix codes (simple, normal and grouped by a meta image), back-references and the
colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms.
``encode_pixels`` writes any of these. Payloads of documents are stored as pictures 16 pixels (64 bytes)
wide and ``TILE_ROWS`` high at most, one file after the other. Each picture is stored in the form that is
estimated to be smallest: literals; literals after the subtract-green or a predictor transform (tried where
copies and the cache save less than a fiftieth); literals, back-references and the colour cache; or a palette with
back-references. ``encode_payloads`` and
``decode_payloads`` handle all pictures of a batch in step, a token of every picture at a time; pictures with
grouped or very long codes, which only other writers make, are read one by one.

Null text: empty, one row of zero bytes. Null doc_id and repeated rows: each row has its result. Ties between
forms: the first of those above. Very long texts: as many pictures as it takes; memory is a few dozen times a
text's size. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import doc_text, pieces

ROW_BYTES, TILE_ROWS = 64, 128
#: Bytes of text whose pictures are handled in step.
TOGETHER = 8_000_000
WIDTH = ROW_BYTES // 4

# Fixed values of the format.
SIGNATURE = 0x2F
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_SYMBOLS, DISTANCE_SYMBOLS = 24, 40
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK = 0xFF000000
#: Short distances: the 120 nearest pixels above and to the left, nearest first.
NEARBY = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        first, end = self.at >> 3, (self.at + n + 7) >> 3
        if end > len(self.data):
            raise ValueError("the picture ends too early")
        value = int.from_bytes(self.data[first:end], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


class Writer:
    def __init__(self) -> None:
        self.value, self.at = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.at + 7) >> 3, "little")


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code with its first bit lowest, length)."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    out, code, last = {}, 0, 0
    for n, s in used:
        code <<= n - last
        last = n
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code += 1
    return out


class Code:
    """A prefix code for reading; one symbol alone takes no bits."""

    def __init__(self, lengths: list[int], single: int | None = None) -> None:
        self.lengths, self.single = lengths, single
        if single is None:
            if sum(2.0**-n for n in lengths if n) != 1:
                raise ValueError("an incomplete prefix code")
            self.longest = max(lengths)
            self.symbols = {(n, c): s for s, (c, n) in canonical(lengths).items()}

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        code = 0
        for n in range(1, self.longest + 1):
            code |= bits.read(1) << (n - 1)
            if (n, code) in self.symbols:
                return self.symbols[n, code]
        raise ValueError("not a code")


@lru_cache(maxsize=64)
def _length_table(of_lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """(symbol, bits) of the code for code lengths, by the next seven bits."""
    used = [s for s, n in enumerate(of_lengths) if n]
    if len(used) == 1:
        return [(used[0], 0)] * 128
    if sum(2.0**-n for n in of_lengths if n) != 1:
        raise ValueError("an incomplete prefix code")
    table = [(0, 0)] * 128
    for s, (code, n) in canonical(list(of_lengths)).items():
        for k in range(code, 128, 1 << n):
            table[k] = (s, n)
    return table


def read_lengths(bits: Bits, size: int) -> tuple[list[int], int | None]:
    """A code's lengths, or its only symbol."""
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= size:
            raise ValueError("a symbol beyond the alphabet")
        if len(set(symbols)) == 1:
            return [], symbols[0]
        return [int(s in symbols) for s in range(size)], None
    of_lengths = [0] * len(LENGTH_ORDER)
    for k in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[k]] = bits.read(3)
    table = _length_table(tuple(of_lengths))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths: list[int] = []
    before = 8
    # At most 14 bits for each length, read from one number.
    start = bits.at
    value = int.from_bytes(bits.data[start >> 3 : (start >> 3) + 2 * size + 8], "little") >> (start & 7)
    while len(lengths) < size and left:
        left -= 1
        s, n = table[value & 127]
        value >>= n
        if s < 16:
            lengths.append(s)
            before = s or before
        else:
            width, least = (2, 3) if s == 16 else (3, 3) if s == 17 else (7, 11)
            lengths += [before if s == 16 else 0] * (least + (value & ((1 << width) - 1)))
            value >>= width
            n += width
        bits.at += n
    if len(lengths) > size:
        raise ValueError("too many code lengths")
    if bits.at > 8 * len(bits.data):
        raise ValueError("the picture ends too early")
    lengths += [0] * (size - len(lengths))
    if size - lengths.count(0) < 2:
        return [], next((s for s, n in enumerate(lengths) if n), 0)
    return lengths, None


def read_code(bits: Bits, size: int) -> Code:
    return Code(*read_lengths(bits, size))


def read_group(bits: Bits, cache_bits: int) -> list[Code]:
    """Codes for green (with lengths and cache), red, blue, alpha, distances."""
    extra = LENGTH_SYMBOLS + (1 << cache_bits if cache_bits else 0)
    return [read_code(bits, n) for n in (256 + extra, 256, 256, 256, DISTANCE_SYMBOLS)]


def _prefixed(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def read_pixels(bits: Bits, width: int, height: int, main: bool, seen: Counter | None = None) -> np.ndarray:
    """The entropy-coded picture as ARGB numbers; ``seen`` counts what it is made of."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_of, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        meta = read_pixels(bits, across, -(-height >> shift), main=False)
        groups_of = ((meta >> 8) & 0xFFFF).tolist()
    groups = [read_group(bits, cache_bits) for _ in range(max(groups_of) + 1 if groups_of else 1)]
    cache = [0] * (1 << cache_bits)
    total, out = width * height, []
    while len(out) < total:
        n = len(out)
        green, red, blue, alpha, distance = groups[groups_of[(n // width >> shift) * across + (n % width >> shift)] if groups_of else 0]
        s = green.read(bits)
        if seen is not None:
            seen["literal" if s < 256 else "reference" if s < 256 + LENGTH_SYMBOLS else "cache"] += 1
        if s < 256:
            r, b = red.read(bits), blue.read(bits)
            new = [alpha.read(bits) << 24 | r << 16 | s << 8 | b]
        elif s < 256 + LENGTH_SYMBOLS:
            length = _prefixed(bits, s - 256)
            far = _prefixed(bits, distance.read(bits))
            if far <= len(NEARBY):
                x, y = NEARBY[far - 1]
                far = max(1, x + y * width)
            else:
                far -= len(NEARBY)
            if far > n or n + length > total:
                raise ValueError("a reference beyond the picture")
            new = [out[n - far + i % far] for i in range(length)]
        else:
            new = [cache[s - 256 - LENGTH_SYMBOLS]]
        out += new
        if cache_bits:
            for p in new:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, np.uint32)


def channels(pixels: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha of ARGB numbers."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)


def numbers(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts.astype(np.uint8)).view("<u4").reshape(parts.shape[:-1])


def predict(mode: int, left, top, right, corner) -> list[int]:
    """A pixel's prediction from its neighbours (lists of four channels); ``right`` is above and to the right."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: min(255, max(0, x))
    simple = {0: [0, 0, 0, 255], 1: left, 2: top, 3: right, 4: corner}
    if mode in simple:
        return simple[mode]
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))  # how far the left one's estimate is off
        by_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if by_left < by_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]
    pairs = {5: (mean(left, right), top), 6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right), 10: (mean(left, corner), mean(top, right))}
    return mean(*pairs[mode]) if mode in pairs else simple[0]


def predicted(pixels: np.ndarray, width: int, modes: np.ndarray, size: int, forward: bool) -> np.ndarray:
    """Adds (or with ``forward`` subtracts) the predictions; modes: one per block of 2**size pixels."""
    if not forward and len(modes) == 1 and modes[0] in (1, 2):
        # The left or the upper pixel everywhere: sums along the rows or columns, which start from the other edge.
        parts = channels(pixels).reshape(-1, width, 4).copy()
        parts[0, 0, 3:] += np.uint8(255)
        edge = parts[0] if modes[0] == 2 else parts[:, 0]
        edge[:] = np.cumsum(edge, axis=0, dtype=np.uint8)
        return numbers(np.cumsum(parts, axis=0 if modes[0] == 2 else 1, dtype=np.uint8).reshape(-1, 4))
    parts = channels(pixels).astype(int).tolist()
    done = parts if forward else []
    out = []
    across = -(-width >> size)
    for n, p in enumerate(parts):
        x, y = n % width, n // width
        if not n:
            guess = [0, 0, 0, 255]
        elif not y:
            guess = done[n - 1]
        elif not x:
            guess = done[n - width]
        else:
            guess = predict(int(modes[(y >> size) * across + (x >> size)]), done[n - 1], done[n - width], done[n - width + 1], done[n - width - 1])
        new = [(a - b if forward else a + b) & 255 for a, b in zip(p, guess, strict=True)]
        out.append(new)
        if not forward:
            done.append(new)
    return numbers(np.array(out, np.uint8).reshape(-1, 4))


def cross_coloured(pixels: np.ndarray, width: int, factors: np.ndarray, size: int, forward: bool) -> np.ndarray:
    """Inverts (or applies) the cross-colour transform; factors: ARGB numbers, one per block."""
    parts = channels(pixels).astype(int)
    n = np.arange(len(pixels))
    at = (n // width >> size) * -(-width >> size) + (n % width >> size)
    by = channels(factors)[at].view(np.int8).astype(int)  # green to red, green to blue, red to blue
    signed = lambda c: c.astype(np.uint8).view(np.int8).astype(int)
    blue, green, red = parts[:, 0], signed(parts[:, 1]), parts[:, 2]
    sign = -1 if forward else 1
    new_red = (red + sign * (by[:, 0] * green >> 5)) & 255
    true_red = signed(red if forward else new_red)
    parts[:, 0] = (blue + sign * ((by[:, 1] * green >> 5) + (by[:, 2] * true_red >> 5))) & 255
    parts[:, 2] = new_red
    return numbers(parts)


def greened(pixels: np.ndarray, forward: bool) -> np.ndarray:
    parts = channels(pixels).copy()
    green = parts[:, 1].copy()
    for c in (0, 2):
        parts[:, c] = parts[:, c] - green if forward else parts[:, c] + green
    return numbers(parts)


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unbundled(pixels: np.ndarray, width: int, table: np.ndarray) -> np.ndarray:
    """Colours of palette numbers, several to a green byte if there are few colours; ``width``: of the picture."""
    bits = bundle_bits(len(table))
    per = 8 >> bits
    green = channels(pixels)[:, 1].astype(int).reshape(-1, -(-width >> bits))
    places = np.stack([(green >> (per * k)) & ((1 << per) - 1) for k in range(1 << bits)], axis=2).reshape(len(green), -1)[:, :width].reshape(-1)
    full = np.zeros(max(256, len(table)), np.uint32)  # numbers beyond the table are transparent black
    full[: len(table)] = table
    return full[places]


def vp8l(data: bytes) -> bytes:
    """The VP8L chunk of a file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    return data[20 : 20 + int.from_bytes(data[16:20], "little")]


def file_size(data: bytes, at: int = 0) -> int:
    return 8 + int.from_bytes(data[at + 4 : at + 8], "little")


class Picture(NamedTuple):
    """A file's head: its size, its transforms in the order of writing, the width that is stored."""

    width: int
    height: int
    steps: list[tuple]
    shown: int


def read_head(bits: Bits) -> Picture:
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless picture")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    steps, shown = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [s[0] for s in steps]:
            raise ValueError("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            steps.append((kind, shown, size, read_pixels(bits, -(-shown >> size), -(-height >> size), main=False)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = numbers(np.cumsum(channels(read_pixels(bits, n, 1, main=False)), axis=0, dtype=np.uint8))
            steps.append((kind, shown, 0, table))
            shown = -(-shown >> bundle_bits(n))
        else:
            steps.append((kind, shown, 0, None))
    return Picture(width, height, steps, shown)


def restored(pixels: np.ndarray, picture: Picture) -> np.ndarray:
    """The stored pixels with all transforms inverted."""
    for kind, across, size, extra in reversed(picture.steps):
        if kind == PREDICTOR:
            pixels = predicted(pixels, across, channels(extra)[:, 1] & 15, size, forward=False)
        elif kind == CROSS_COLOUR:
            pixels = cross_coloured(pixels, across, extra, size, forward=False)
        elif kind == SUBTRACT_GREEN:
            pixels = greened(pixels, forward=False)
        else:
            pixels = unbundled(pixels, across, extra)
    return pixels


def decode(data: bytes, seen: Counter | None = None) -> np.ndarray:
    """The pixels of a lossless WebP file as ARGB numbers, rows by columns; ``seen`` counts what it is made of."""
    bits = Bits(vp8l(data))
    picture = read_head(bits)
    if seen is not None:
        seen.update(("predictor", "cross-colour", "subtract-green", "palette")[step[0]] for step in picture.steps)
    return restored(read_pixels(bits, picture.shown, picture.height, True, seen), picture).reshape(picture.height, picture.width)


# Writing.


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Complete prefix codes with at most ``limit`` bits, one per row of ``counts`` with two symbols at least.

    A code of n bits takes 2**(limit - n) of 2**limit units. Each symbol starts with the power of two
    below its share; units too many are taken from the symbols that lose least, units left are given
    to those that gain most.
    """
    room = 1 << limit
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) * room
    units = np.where(counts > 0, 1 << np.clip(np.floor(np.log2(np.maximum(share, 1))).astype(int), 0, limit - 1), 0)
    rows = np.arange(len(counts))
    ratio = lambda: np.where(counts > 0, share / np.maximum(units, 1), -1)
    while (over := units.sum(axis=1) - room).max(initial=0) > 0:
        order = np.argsort(np.where(units > 1, ratio(), np.inf), axis=1, kind="stable")
        for k in range(order.shape[1]):
            s = order[:, k]
            cut = np.where((over > 0) & (units[rows, s] > 1), units[rows, s] >> 1, 0)
            if k and not cut.any():
                break
            units[rows, s] -= cut
            over = over - cut
    while (left := room - units.sum(axis=1)).max(initial=0) > 0:
        order = np.argsort(-ratio(), axis=1, kind="stable")
        for k in range(order.shape[1]):
            s = order[:, k]
            have = units[rows, s]
            more = np.where((have > 0) & (have <= left), have, 0)
            if k and not left.any():
                break
            units[rows, s] += more
            left = left - more
    return np.where(units > 0, limit - np.log2(np.maximum(units, 1)).astype(int), 0)


#: Lengths of the code for code lengths that all writers here use: complete over 0 to 10, 17 and 18.
FLAT = {s: 3 if s in (7, 8, 17) else 4 for s in (*range(11), 17, 18)}
FLAT_CODE = canonical([FLAT.get(s, 0) for s in range(19)])


def put_code(out: Writer, lengths: np.ndarray, size: int) -> None:
    """A prefix code of ``size`` symbols, as a simple one if it has one symbol (below 256)."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) < 2 and (used[0] if used else 0) < 256:
        out.put(0b101, 3)  # simple, one symbol, of eight bits
        out.put(used[0] if used else 0, 8)
        return
    out.put(0, 1)
    out.put(14 - 4, 4)
    for s in LENGTH_ORDER[:14]:
        out.put(FLAT.get(s, 0), 3)
    out.put(0, 1)
    at, value, n = 0, 0, 0  # gathered in a small number first
    for s in [*used, size]:
        gap = s - at
        while gap:
            run = min(gap, 138)
            if run >= 11:
                token, extra, width = 18, run - 11, 7
            elif run >= 3:
                token, extra, width = 17, run - 3, 3
            else:
                token, extra, width, run = 0, 0, 0, 1
            code, bits = FLAT_CODE[token]
            value |= (code | extra << bits) << n
            n += bits + width
            gap -= run
        if s < size:
            code, bits = FLAT_CODE[int(lengths[s])]
            value |= code << n
            n += bits
        at = s + 1
    out.put(value, n)


def put_header(out: Writer, width: int, height: int) -> None:
    out.put(SIGNATURE, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)


def riff(chunk: bytes) -> bytes:
    padded = chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + padded


def _prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits and extra bits of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    extra = value.bit_length() - 2
    return 2 * extra + 2 + ((value >> extra) & 1), extra, value & ((1 << extra) - 1)


def put_pixels(out: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, matches: bool = False, meta_bits: int = 0) -> None:
    """An entropy-coded picture; ``meta_bits``: every block of 2**meta_bits pixels a side has codes of its own."""
    px = pixels.tolist()
    tokens, cache, seen, n = [], [None] * (1 << cache_bits), {}, 0
    while n < len(px):
        length = 0
        if matches and (far := n - seen.get(tuple(px[n : n + 3]), n)):
            while n + length < len(px) and length < 4096 and px[n + length] == px[n + length - far]:
                length += 1
        if length >= 3:
            tokens.append((n, 256 + _prefix_of(length)[0], _prefix_of(length), far))
        else:
            length = 1
            slot = (CACHE_FACTOR * px[n] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            hit = cache_bits and cache[slot] == px[n]
            tokens.append((n, 256 + LENGTH_SYMBOLS + slot, None, 0) if hit else (n, px[n] >> 8 & 255, px[n], 0))
        for i in range(n, n + length):
            seen[tuple(px[i : i + 3])] = i
            if cache_bits:
                cache[(CACHE_FACTOR * px[i] & 0xFFFFFFFF) >> (32 - cache_bits)] = px[i]
        n += length
    height = len(px) // width
    across = -(-width >> meta_bits) if meta_bits else 1
    group = lambda n: (n // width >> meta_bits) * across + (n % width >> meta_bits) if meta_bits else 0
    n_groups = across * -(-height >> meta_bits) if meta_bits else 1
    sizes = (256 + LENGTH_SYMBOLS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_SYMBOLS)
    counts = [[np.zeros(s, int) for s in sizes] for _ in range(n_groups)]
    plane = lambda far: next((k + 1 for k, (x, y) in enumerate(NEARBY) if x + y * width == far), far + len(NEARBY))
    writes = []
    for n, s, what, far in tokens:
        parts = [(0, s, 0, 0)]
        if isinstance(what, tuple):
            symbol, extra, rest = _prefix_of(plane(far))
            parts = [(0, s, what[1], what[2]), (4, symbol, extra, rest)]
        elif what is not None:
            parts += [(1, what >> 16 & 255, 0, 0), (2, what & 255, 0, 0), (3, what >> 24, 0, 0)]
        for k, symbol, _, _ in parts:
            counts[group(n)][k][symbol] += 1
        writes.append((group(n), parts))
    out.put(cache_bits << 1 | 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        out.put(bool(meta_bits), 1)
        if meta_bits:
            out.put(meta_bits - 2, 3)
            put_pixels(out, np.arange(n_groups, dtype=np.uint32) << 8, across, main=False)
    codes = []
    for per_group in counts:
        codes.append([])
        for c, size in zip(per_group, sizes, strict=True):
            if np.count_nonzero(c) == 1 and c.argmax() >= 256:
                c[0] += 1  # a lone symbol has to fit the simple form
            lengths = code_lengths(c[None], 8)[0] if np.count_nonzero(c) > 1 else (c > 0).astype(int)
            put_code(out, lengths, size)
            codes[-1].append(canonical(lengths.tolist()) if np.count_nonzero(c) > 1 else None)
    for g, parts in writes:
        for k, symbol, extra, rest in parts:
            if codes[g][k]:
                out.put(*codes[g][k][symbol])
            out.put(rest, extra)


class Options(NamedTuple):
    predictor: int | None = None  # a mode for all blocks
    cross: tuple[int, int, int] | None = None  # green to red, green to blue, red to blue
    green: bool = False
    palette: bool = False
    cache_bits: int = 0
    matches: bool = False
    meta_bits: int = 0


def encode_pixels(pixels: np.ndarray, options: Options = Options()) -> bytes:
    """A file from ARGB numbers (rows by columns), with what the options ask for."""
    height, width = pixels.shape
    out, flat, size = Writer(), pixels.reshape(-1).astype(np.uint32), 3
    put_header(out, width, height)
    blocks = lambda: -(-width >> size) * -(-height >> size)
    if options.palette:
        table, places = np.unique(flat, return_inverse=True)
        if len(table) > 256:
            raise ValueError("too many colours for a palette")
        out.put(PALETTE << 1 | 1, 3)
        out.put(len(table) - 1, 8)
        put_pixels(out, numbers(np.diff(channels(table), axis=0, prepend=np.zeros((1, 4), np.uint8))), len(table), main=False)
        bits = bundle_bits(len(table))
        across = -(-width >> bits)
        rows = np.zeros((height, across << bits), np.uint32)
        rows[:, :width] = places.reshape(height, width)
        rows = rows.reshape(height, across, 1 << bits)
        flat = BLACK | sum(rows[:, :, k] << (8 + (8 >> bits) * k) for k in range(1 << bits)).reshape(-1).astype(np.uint32)
        width = across
    if options.predictor is not None:
        modes = np.full(blocks(), options.predictor)
        out.put(PREDICTOR << 1 | 1, 3)
        out.put(size - 2, 3)
        put_pixels(out, (BLACK | modes << 8).astype(np.uint32), -(-width >> size), main=False)
        flat = predicted(flat, width, modes, size, forward=True)
    if options.cross:
        to_red, to_blue, red_to_blue = (x & 255 for x in options.cross)
        factors = np.full(blocks(), BLACK | red_to_blue << 16 | to_blue << 8 | to_red, np.uint32)
        out.put(CROSS_COLOUR << 1 | 1, 3)
        out.put(size - 2, 3)
        put_pixels(out, factors, -(-width >> size), main=False)
        flat = cross_coloured(flat, width, factors, size, forward=True)
    if options.green:
        out.put(SUBTRACT_GREEN << 1 | 1, 3)
        flat = greened(flat, forward=True)
    out.put(0, 1)
    put_pixels(out, flat, width, True, options.cache_bits, options.matches, options.meta_bits)
    return riff(out.bytes())


# Payloads of many documents in step.

#: Longest codes that are written, and read in step: of green, of red, blue and alpha, of distances.
GREEN_LIMIT, LIMIT = 10, 8
CACHE_BITS = 8
GREENS = 256 + LENGTH_SYMBOLS + (1 << CACHE_BITS)
LITERALS, GREENED, BY_LEFT, BY_TOP, MATCHED, COLOURED = range(6)
#: Estimated bits of a code's description for each of its symbols, and of the rest of a file.
SYMBOL_BITS, FILE_BITS, COLOUR_BITS = 5, 240, 40
SHORTEST, LONGEST_MATCH = 3, 4096
#: Transforms are tried where copies and the cache leave more than this share of the literals' bits.
SAVED = 0.98
_NEAR = np.array(NEARBY)


def _reversed(limit: int) -> np.ndarray:
    """All numbers of ``limit`` bits with their bits in reverse."""
    out, n = np.zeros(1 << limit, np.int64), np.arange(1 << limit)
    for k in range(limit):
        out |= (n >> k & 1) << (limit - 1 - k)
    return out


REVERSED = {n: _reversed(n) for n in range(1, GREEN_LIMIT + 1)}


def code_words(lengths: np.ndarray, limit: int) -> np.ndarray:
    """Each symbol's code with its first bit lowest, for complete codes (a row each); a lone symbol's is empty."""
    order = np.argsort(np.where(lengths > 0, lengths, 99) * lengths.shape[1] + np.arange(lengths.shape[1]), axis=1)
    sorted_lengths = np.take_along_axis(lengths, order, 1)
    units = np.where(sorted_lengths > 0, 1 << (limit - np.minimum(sorted_lengths, limit)), 0)
    start = np.cumsum(units, axis=1) - units
    codes = np.zeros_like(lengths)
    np.put_along_axis(codes, order, REVERSED[limit][np.minimum(start, (1 << limit) - 1)], 1)
    return codes


def code_tables(lengths: np.ndarray, limit: int) -> np.ndarray:
    """For each row of lengths and the next ``limit`` bits: the symbol | its length << 16. A lone symbol (length -1) takes no bits."""
    lone = (lengths < 0).any(axis=1)
    units = np.where(lengths > 0, 1 << (limit - np.maximum(lengths, 0)), 0)
    units[lone] = np.where(lengths[lone] < 0, 1 << limit, 0)
    if (units.sum(axis=1) != 1 << limit).any():
        raise ValueError("an incomplete prefix code")
    order = np.argsort(np.where(lengths != 0, lengths, 99) * lengths.shape[1] + np.arange(lengths.shape[1]), axis=1)
    entry = order | np.maximum(np.take_along_axis(lengths, order, 1), 0) << 16
    filled = np.repeat(entry.reshape(-1), np.take_along_axis(units, order, 1).reshape(-1)).reshape(len(lengths), -1)
    return filled[:, REVERSED[limit]].astype(np.uint32)


def lengths_for(counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Code lengths of each row, and the bits that each symbol takes (none if it is alone)."""
    lengths = (counts > 0).astype(int)
    many = lengths.sum(axis=1) > 1
    if many.any():
        lengths[many] = code_lengths(counts[many], limit)
    return lengths, np.where(many[:, None], lengths, 0)


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols, numbers of extra bits and extra bits of lengths or distances."""
    v = values - 1
    extra = np.maximum(np.frexp(np.maximum(v, 1).astype(float))[1] - 2, 0)
    small = v < 4
    return np.where(small, v, 2 * extra + 2 + (v >> extra & 1)), np.where(small, 0, extra), np.where(small, 0, v & ((1 << extra) - 1))


def matches(values: np.ndarray, tile: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of copies that don't overlap; ``last``: whether a pixel ends its tile.

    A pixel looks back to the latest place in its tile where the same three pixels stand; a run of pixels
    with one distance is a copy.
    """
    n, none = len(values), np.zeros(0, np.int64)
    if n < SHORTEST:
        return none, none, none
    tail = last.copy()
    tail[:-1] |= last[1:]
    usable = np.flatnonzero(~tail[: n - 2]) if n > 2 else none
    v = values.astype(np.uint64)
    key = (v[usable] * np.uint64(0x9E3779B97F4A7C15) ^ v[usable + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9) ^ v[usable + 2] * np.uint64(0x27D4EB2F165667C5)
    key = (key ^ tile[usable].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
    order = np.argsort(key, kind="stable")
    a, b = usable[order[:-1]], usable[order[1:]]
    same = (tile[a] == tile[b]) & (values[a] == values[b]) & (values[a + 1] == values[b + 1]) & (values[a + 2] == values[b + 2])
    far = np.zeros(n + 1, np.int64)
    far[b[same]] = (b - a)[same]
    head = np.flatnonzero((far[:-1] > 0) & (far[:-1] != np.concatenate([[0], far[:-2]])))
    if not len(head):
        return none, none, none
    change = np.flatnonzero(far[1:] != far[:-1]) + 1
    end = change[np.searchsorted(change, head, side="right")] + 2  # the last three pixels are copied whole
    # A copy begins where the one before may have ended.
    start = np.maximum(head, np.concatenate([[0], end[:-1]]))
    start = np.where(np.concatenate([[False], tile[head[1:]] == tile[head[:-1]]]), start, head)
    length = np.minimum(end - start, LONGEST_MATCH)
    kept = length >= SHORTEST
    return start[kept], length[kept], far[head][kept]


class Tokens(NamedTuple):
    """What a stream is made of: each token's tile, green symbol, colours if literal, and extra parts if a copy."""

    tile: np.ndarray
    green: np.ndarray
    rest: np.ndarray  # red, blue, alpha
    literal: np.ndarray
    extra: np.ndarray  # of the length: bits and how many
    extra_bits: np.ndarray
    distance: np.ndarray  # symbol, bits and how many
    far: np.ndarray
    far_bits: np.ndarray


def tokens_of(parts: np.ndarray, tile: np.ndarray, width: np.ndarray, copies: tuple | None, cached: np.ndarray | None) -> Tokens:
    """``parts``: red, green, blue, alpha of each pixel; ``width``: of each copy's picture; ``cached``: cache slots of hits, else -1."""
    n = len(parts)
    green, literal = parts[:, 1].astype(np.int64), np.ones(n, bool)
    extra, extra_bits, distance, far, far_bits = (np.zeros(n, np.int64) for _ in range(5))
    kept = np.ones(n, bool)
    if cached is not None:
        hit = cached >= 0
        green[hit], literal[hit] = 256 + LENGTH_SYMBOLS + cached[hit], False
    if copies is not None:
        start, length, back = copies
        step = np.zeros(n + 1, np.int64)
        step[start + 1] += 1
        np.subtract.at(step, start + length, 1)
        kept = np.cumsum(step[:n]) == 0
        symbol, extra_bits[start], extra[start] = prefixes(length)
        green[start], literal[start] = 256 + symbol, False
        distance[start], far_bits[start], far[start] = prefixes(plane_codes(back, width))
    rest = parts[:, [0, 2, 3]]
    return Tokens(*(x[kept] for x in (tile, green, rest, literal, extra, extra_bits, distance, far, far_bits)))


def plane_codes(back: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Distances as they are stored: a number of the nearest pixels, or 120 more."""
    out = back + len(NEARBY)
    for w in np.unique(width).tolist():
        table = np.zeros(8 * w + 16, np.int64)
        for k in range(len(NEARBY), 0, -1):
            x, y = NEARBY[k - 1]
            if x + y * w > 0:
                table[x + y * w] = k
        own = np.flatnonzero((width == w) & (back < len(table)))
        known = table[back[own]]
        out[own[known > 0]] = known[known > 0]
    return out


def bits_of(counts: np.ndarray) -> np.ndarray:
    """Estimated bits of all symbols of a row and of their code."""
    total = counts.sum(axis=1, keepdims=True)
    return (counts * np.log2(np.where(counts > 0, np.maximum(total, 1) / np.maximum(counts, 1), 1))).sum(axis=1) + SYMBOL_BITS * (counts > 0).sum(axis=1)


def histogram(tile: np.ndarray, symbol: np.ndarray, tiles: int, size: int) -> np.ndarray:
    return np.bincount(tile * size + symbol, minlength=tiles * size).reshape(tiles, size)


def stream_counts(t: Tokens, tiles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per tile: counts of green symbols, of red, blue and alpha together, of distances."""
    lit, copy = t.literal, (t.green >= 256) & (t.green < 256 + LENGTH_SYMBOLS)
    three = histogram(np.repeat(t.tile[lit], 3), t.rest[lit].reshape(-1).astype(np.int64), tiles, 256)
    return histogram(t.tile, t.green, tiles, GREENS), three, histogram(t.tile[copy], t.distance[copy], tiles, DISTANCE_SYMBOLS)


def stream_bits(t: Tokens, tiles: int) -> np.ndarray:
    green, rest, distance = stream_counts(t, tiles)
    return bits_of(green) + bits_of(rest) + 2 * SYMBOL_BITS * (rest > 0).sum(axis=1) + bits_of(distance) + np.bincount(t.tile, t.extra_bits + t.far_bits, tiles)


def literal_bits(parts: np.ndarray, tile: np.ndarray, tiles: int) -> np.ndarray:
    """Estimated bits of a picture of literals."""
    rest = histogram(np.repeat(tile, 3), parts[:, [0, 2, 3]].reshape(-1).astype(np.int64), tiles, 256)
    return bits_of(histogram(tile, parts[:, 1].astype(np.int64), tiles, 256)) + bits_of(rest) + 2 * SYMBOL_BITS * (rest > 0).sum(axis=1)


def transformed(parts: np.ndarray, place: np.ndarray) -> dict[int, np.ndarray]:
    """Red, green, blue, alpha of whole tiles after each transform; ``place``: of a pixel in its tile."""
    before, above = np.zeros_like(parts), np.zeros_like(parts)
    before[1:], above[WIDTH:] = parts[:-1], parts[:-WIDTH]
    black = np.array([0, 0, 0, 255], np.uint8)
    origin, left_edge, top = ((x)[:, None] for x in (place == 0, place % WIDTH == 0, place < WIDTH))
    return {
        GREENED: parts - parts[:, [1]] * np.array([1, 0, 1, 0], np.uint8),
        BY_LEFT: parts - np.where(origin, black, np.where(left_edge, above, before)),
        BY_TOP: parts - np.where(origin, black, np.where(top, before, above)),
    }


def tile_tokens(tiles: list[bytes]) -> tuple[Tokens, np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """The tokens of all tiles in order, each tile's form, the colours of those with a palette, and stored widths."""
    n, lens = len(tiles), np.array([len(t) // 4 for t in tiles])
    parts = np.frombuffer(b"".join(tiles), np.uint8).reshape(-1, 4)
    tile, first = np.repeat(np.arange(n), lens), np.cumsum(lens) - lens
    place = np.arange(len(parts)) - first[tile]
    row, column = place // WIDTH, place % WIDTH
    last = np.zeros(len(parts), bool)
    last[first + lens - 1] = True
    values = np.ascontiguousarray(parts).view("<u4")[:, 0].astype(np.int64)

    argb = parts[:, 3].astype(np.int64) << 24 | parts[:, 0].astype(np.int64) << 16 | parts[:, 1].astype(np.int64) << 8 | parts[:, 2]
    slot = (CACHE_FACTOR * argb & 0xFFFFFFFF) >> (32 - CACHE_BITS)
    order = np.argsort(tile * (1 << CACHE_BITS) + slot, kind="stable")
    a, b = order[:-1], order[1:]
    hit = (tile[a] == tile[b]) & (values[a] == values[b])  # equal pixels share a slot
    cached = np.full(len(parts), -1)
    cached[b[hit]] = slot[b[hit]]
    copies = matches(values, tile, last)
    matched = tokens_of(parts, tile, np.full(len(copies[0]), WIDTH), copies, cached)
    cost = np.full((6, n), np.inf)
    cost[LITERALS] = literal_bits(parts, tile, n)
    cost[MATCHED] = stream_bits(matched, n) + CACHE_BITS
    forms = {LITERALS: (parts, np.arange(len(parts)))}
    tried = np.flatnonzero((cost[MATCHED] > SAVED * cost[LITERALS])[tile])
    if len(tried):
        for form, p in transformed(parts[tried], place[tried]).items():
            own = np.unique(tile[tried])
            cost[form, own] = literal_bits(p, np.searchsorted(own, tile[tried]), len(own)) + (FILE_BITS if form != GREENED else 0)
            forms[form] = p, tried
    # Palettes: of tiles with so few colours that a palette could pay.
    order = np.argsort(tile << 32 | values, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = (tile[order[1:]] != tile[order[:-1]]) | (values[order[1:]] != values[order[:-1]])
    colours = np.bincount(tile[order][fresh], minlength=n)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    rank -= (np.cumsum(colours) - colours)[tile]
    few = (colours <= 256) & (2 * colours <= lens)
    palettes: dict[int, np.ndarray] = {}
    widths = np.full(n, WIDTH)
    coloured = None
    if few.any():
        own, bundles = few[tile], np.select([colours <= 2, colours <= 4, colours <= 16], [3, 2, 1], 0)
        bundle = bundles[tile[own]]
        per = 8 >> bundle
        across = WIDTH >> bundle  # the width is a multiple of eight
        packed_lens = np.where(few, lens >> bundles, 0)
        packed_first = np.cumsum(packed_lens) - packed_lens
        at = packed_first[tile[own]] + row[own] * across + (column[own] >> bundle)
        green = np.bincount(at, weights=rank[own] << (per * (column[own] & ((1 << bundle) - 1))), minlength=int(packed_lens.sum())).astype(np.int64)
        packed_tile = np.repeat(np.arange(n), packed_lens)
        packed_last = np.zeros(len(green), bool)
        packed_last[(packed_first + packed_lens - 1)[few]] = True
        four = np.zeros((len(green), 4), np.uint8)
        four[:, 1], four[:, 3] = green, 255
        widths[few] = WIDTH >> bundles[few]
        copies = matches(green, packed_tile, packed_last)
        coloured = tokens_of(four, packed_tile, widths[packed_tile[copies[0]]], copies, None)
        cost[COLOURED] = np.where(few, stream_bits(coloured, n) + FILE_BITS + COLOUR_BITS * colours, np.inf)
    form = np.argmin(cost, axis=0)
    widths[form != COLOURED] = WIDTH
    for k in np.flatnonzero(form == COLOURED).tolist():
        p = np.unique(values[first[k] : first[k] + lens[k]]).astype("<u4").view(np.uint8).reshape(-1, 4).astype(np.uint32)
        palettes[k] = p[:, 3] << 24 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]
    chosen = [tokens_of(p[own], tile[at][own], None, None, None) for f, (p, at) in forms.items() if (own := (form == f)[tile[at]]).any()]
    chosen += [Tokens(*(x[(form == f)[t.tile]] for x in t)) for f, t in ((MATCHED, matched), (COLOURED, coloured)) if t is not None]
    every = Tokens(*(np.concatenate(x) for x in zip(*chosen, strict=True)))
    order = np.argsort(every.tile, kind="stable")
    return Tokens(*(x[order] for x in every)), form, palettes, widths


def put_forms(out: Writer, form: int, height: int, palette: np.ndarray | None) -> None:
    """A file's head: its size and the transform of its form."""
    put_header(out, WIDTH, height)
    if form == GREENED:
        out.put(SUBTRACT_GREEN << 1 | 1, 3)
    elif form in (BY_LEFT, BY_TOP):
        out.put(PREDICTOR << 1 | 1, 3)
        out.put(7, 3)  # one block of 2**9 pixels
        put_pixels(out, np.array([BLACK | (1 if form == BY_LEFT else 2) << 8], np.uint32), 1, main=False)
    elif form == COLOURED:
        out.put(PALETTE << 1 | 1, 3)
        out.put(len(palette) - 1, 8)
        put_pixels(out, numbers(np.diff(channels(palette), axis=0, prepend=np.zeros((1, 4), np.uint8))), len(palette), main=False)
    out.put(0, 1)
    out.put(CACHE_BITS << 1 | 1, 5) if form == MATCHED else out.put(0, 1)
    out.put(0, 1)  # one group


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 64 bytes) as one file after another."""
    size = ROW_BYTES * TILE_ROWS
    tiles = [p[i : i + size] for p in payloads for i in range(0, len(p), size)]
    per = [-(-len(p) // size) for p in payloads]
    t, form, palettes, _ = tile_tokens(tiles)
    n = len(tiles)
    counts = stream_counts(t, n)
    flat = form == COLOURED  # red, blue and alpha are the same everywhere
    counts[1][flat] = 0
    (green, green_bits), (rest, rest_bits), (far, far_bits) = (lengths_for(c, limit) for c, limit in zip(counts, (GREEN_LIMIT, LIMIT, LIMIT), strict=True))
    green_codes, rest_codes, far_codes = code_words(green, GREEN_LIMIT), code_words(rest, LIMIT), code_words(far, LIMIT)
    heads = []
    for k, data in enumerate(tiles):
        out = Writer()
        put_forms(out, form[k], len(data) // ROW_BYTES, palettes.get(k))
        put_code(out, green[k], GREENS if form[k] == MATCHED else 256 + LENGTH_SYMBOLS)
        one = Writer()
        put_code(one, rest[k], 256)
        for channel in range(3):
            if flat[k]:
                out.put(255 << 3 | 0b101 if channel == 2 else 0b101, 11)
            else:
                out.put(one.value, one.at)
        put_code(out, far[k], DISTANCE_SYMBOLS)
        heads.append(out)
    # A token is two numbers: green with a length's extra bits, then the other colours or a distance.
    width, value = np.zeros((len(t.tile), 2), np.int64), np.zeros((len(t.tile), 2), np.int64)
    width[:, 0], value[:, 0] = green_bits[t.tile, t.green], np.where(green_bits[t.tile, t.green] > 0, green_codes[t.tile, t.green], 0)
    value[:, 0] |= t.extra << width[:, 0]
    width[:, 0] += t.extra_bits
    lit = np.flatnonzero(t.literal & ~flat[t.tile])
    for c in range(3):
        own = rest_bits[t.tile[lit], t.rest[lit, c]]
        value[lit, 1] |= np.where(own > 0, rest_codes[t.tile[lit], t.rest[lit, c]], 0) << width[lit, 1]
        width[lit, 1] += own
    copy = np.flatnonzero((t.green >= 256) & (t.green < 256 + LENGTH_SYMBOLS))
    own = far_bits[t.tile[copy], t.distance[copy]]
    value[copy, 1] = np.where(own > 0, far_codes[t.tile[copy], t.distance[copy]], 0) | t.far[copy] << own
    width[copy, 1] = own + t.far_bits[copy]
    value, width, tile = value.reshape(-1).astype(np.uint64), width.reshape(-1), np.repeat(t.tile, 2)
    head = np.array([h.at for h in heads])
    total = head + np.bincount(tile, weights=width, minlength=n).astype(np.int64)
    words = (total + 63) // 32
    base = np.cumsum(words) - words
    ends = np.cumsum(width)
    before = ends - width
    first = np.searchsorted(tile, np.arange(n))
    at = before - before[first][tile] + (base * 32 + head)[tile]
    shifted = value << (at & 31).astype(np.uint64)
    n_words = int(words.sum()) + 1
    # Bits of different codes never overlap, so sums (exact in doubles) stand for unions.
    buffer = np.bincount(at >> 5, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(float), minlength=n_words)
    buffer += np.bincount((at >> 5) + 1, weights=(shifted >> np.uint64(32)).astype(float), minlength=n_words + 1)[:n_words]
    buffer = buffer.astype(np.uint32)
    for h, b in zip(heads, base, strict=True):
        own = np.frombuffer(h.value.to_bytes((h.at + 31) // 32 * 4, "little"), "<u4")
        buffer[b : b + len(own)] |= own
    data = buffer.astype("<u4").tobytes()
    files = [riff(data[4 * b : 4 * b + (m + 7) // 8]) for b, m in zip(base.tolist(), total.tolist(), strict=True)]
    cut = np.cumsum([0, *per])
    return [b"".join(files[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Lane(NamedTuple):
    """A picture whose pixels are read in step with others'."""

    data: bytes
    start: int  # bit of the first token
    picture: Picture
    cache_bits: int
    lengths: list[np.ndarray]  # of green, red, blue, alpha, distances; -1: a lone symbol


def open_lane(data: bytes) -> Lane | None:
    """A picture's head and codes, or nothing if its codes are grouped or too long."""
    bits = Bits(data)
    picture = read_head(bits)
    cache_bits = bits.read(4) if bits.read(1) else 0
    if bits.read(1):
        return None
    found = []
    n_before = before = 0
    for k, size in enumerate((256 + LENGTH_SYMBOLS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_SYMBOLS)):
        start = bits.at
        if k in (2, 3) and start + n_before <= 8 * len(data):
            if bits.read(n_before) == before:  # the same bits are the same code
                found.append(found[-1])
                continue
            bits.at = start
        lengths, single = read_lengths(bits, size)
        n_before, bits.at = bits.at - start, start
        before = bits.read(n_before)
        if single is not None:
            own = np.zeros(size, int)
            own[single] = -1
        else:
            own = np.array(lengths)
        if own.max() > (GREEN_LIMIT if k == 0 else LIMIT):
            return None
        found.append(own)
    return Lane(data, bits.at, picture, cache_bits, found)


def read_in_step(lanes: list[Lane]) -> list[np.ndarray]:
    """The pixels of all lanes: a token of every unfinished one at a time."""
    n = len(lanes)
    tables = []
    for k in range(5):
        lengths = np.zeros((n, max(len(x.lengths[k]) for x in lanes)), np.int64)
        for row, x in zip(lengths, lanes, strict=True):
            row[: len(x.lengths[k])] = x.lengths[k]
        tables.append(code_tables(lengths, GREEN_LIMIT if k == 0 else LIMIT).reshape(-1))
    n_bytes = np.array([len(x.data) for x in lanes])
    data = np.frombuffer(b"".join(x.data for x in lanes) + bytes(16), np.uint8)
    looks = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from any place on
    at = (np.cumsum(n_bytes) - n_bytes) * 8 + np.array([x.start for x in lanes])
    shown, total = np.array([x.picture.shown for x in lanes]), np.array([x.picture.shown * x.picture.height for x in lanes])
    base = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint32)
    cache_bits = np.array([x.cache_bits for x in lanes])
    slots = 1 << int(cache_bits.max())
    cache = np.zeros(n * slots if cache_bits.any() else 1, np.uint32)
    here, stop, who, limit = base.copy(), base + total, np.arange(n), len(looks) - 1

    def remember(lane: np.ndarray, pixels: np.ndarray) -> None:
        bits = cache_bits[lane]
        some = bits > 0
        if some.any():
            slot = (pixels[some].astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> (32 - bits[some]).astype(np.uint64)
            cache[lane[some] * slots + slot.astype(np.int64)] = pixels[some]

    while len(who):
        w = looks[np.minimum(at >> 3, limit)] >> (at & 7).astype(np.uint64)
        look = tables[0][(who << GREEN_LIMIT) + (w & np.uint64((1 << GREEN_LIMIT) - 1)).astype(np.int64)]
        symbol, used = (look & 0xFFFF).astype(np.int64), (look >> 16).astype(np.int64)
        w >>= used.astype(np.uint64)
        step = np.ones(len(who), np.int64)
        lit = np.flatnonzero(symbol < 256)
        if len(lit):
            lane, x = who[lit], w[lit]
            pixels = symbol[lit].astype(np.uint32) << np.uint32(8)
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                look = tables[k][(lane << LIMIT) + (x & np.uint64(255)).astype(np.int64)]
                pixels |= (look & np.uint32(255)) << np.uint32(shift)
                size = look >> np.uint32(16)
                x >>= size.astype(np.uint64)
                used[lit] += size
            out[here[lit]] = pixels
            remember(lane, pixels)
        if len(lit) < len(who):
            kept = np.flatnonzero(symbol >= 256 + LENGTH_SYMBOLS)
            if len(kept):
                lane = who[kept]
                pixels = cache[lane * slots + symbol[kept] - 256 - LENGTH_SYMBOLS]
                out[here[kept]] = pixels
                remember(lane, pixels)
            copy = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTH_SYMBOLS))
            if len(copy):
                lane, x = who[copy], w[copy]
                length, size = _values(symbol[copy] - 256, x)
                x >>= size.astype(np.uint64)
                look = tables[4][(lane << LIMIT) + (x & np.uint64(255)).astype(np.int64)]
                x >>= (look >> np.uint32(16)).astype(np.uint64)
                code, more = _values((look & np.uint32(0xFFFF)).astype(np.int64), x)
                used[copy] += size + (look >> np.uint32(16)).astype(np.int64) + more
                near = code <= len(NEARBY)
                xy = _NEAR[np.where(near, code - 1, 0)]
                far = np.where(near, np.maximum(1, xy[:, 0] + xy[:, 1] * shown[lane]), code - len(NEARBY))
                if (far > here[copy] - base[lane]).any() or (here[copy] + length > stop[copy]).any():
                    raise ValueError("a reference beyond the picture")
                ends = np.cumsum(length)
                i = np.arange(ends[-1]) - np.repeat(ends - length, length)
                into = np.repeat(here[copy], length) + i
                pixels = out[np.repeat(here[copy] - far, length) + i % np.repeat(far, length)]
                out[into] = pixels
                remember(np.repeat(lane, length), pixels)
                step[copy] = length
        at = at + used
        here = here + step
        open_ = here < stop
        if not open_.all():
            at, here, stop, who = at[open_], here[open_], stop[open_], who[open_]
    return [out[a : a + m] for a, m in zip(base.tolist(), total.tolist(), strict=True)]


def _values(symbol: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances of prefix symbols with their extra bits, and how many these are."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    rest = (bits & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + rest + 1), extra


def files_of(stored: bytes) -> list[bytes]:
    """The files of a series."""
    out, at = [], 0
    while at < len(stored):
        step = file_size(stored, at)
        out.append(stored[at : at + step])
        at += step
    return out


def decode_files(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each file as ARGB numbers, rows by columns."""
    lanes = [open_lane(vp8l(f)) for f in files]
    own = [x for x in lanes if x]
    read = iter(read_in_step(own) if own else [])
    return [restored(next(read), x.picture).reshape(x.picture.height, x.picture.width) if x else decode(f) for x, f in zip(lanes, files, strict=True)]


def decode_payloads(stored: list[bytes]) -> list[bytes]:
    """The bytes of each series of files."""
    series = [files_of(data) for data in stored]
    pixels = iter(decode_files([f for files in series for f in files]))
    return [b"".join(channels(next(pixels))[..., [2, 1, 0, 3]].tobytes() for _ in files) for files in series]


def payload(text: str) -> bytes:
    """UTF-8, then zero bytes up to a positive multiple of 64."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\0" * (-len(data) % ROW_BYTES if data else ROW_BYTES)


def feature(data: bytes) -> str:
    """64 bits: which of 64 equal stretches of samples are brighter than the whole."""
    samples = np.frombuffer(data, np.uint8)
    n = len(samples)
    edges = np.arange(64) * n // 64
    means = np.add.reduceat(samples, edges, dtype=np.int64) / np.diff(edges, append=n)
    return f"{int(np.packbits(means > samples.mean()).view('>u8')[0]):016x}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, limit=TOGETHER):
            payloads = [payload(t) for t in part.column("text").to_pylist()]
            n_bytes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()], pa.int64())
            stored = encode_payloads(payloads)
            read = decode_payloads(stored)
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            size = lambda xs: pa.array([len(x) for x in xs], pa.int64())
            tails = pa.array([zlib.crc32(x[-ROW_BYTES:]) for x in read], pa.int64())
            columns = [part.column("doc_id"), n_bytes, size(read), sha(read), tails, size(stored), sha(stored), pa.array([feature(x) for x in read], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return doc_text(docs).mapInArrow(_media, SCHEMA)


def pictures(docs: DataFrame) -> DataFrame:
    """doc_id, media: the stored form itself, for a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                stored = encode_payloads([payload(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(stored, pa.binary())], ["doc_id", "media"])

    return doc_text(docs).mapInArrow(run, "doc_id long, media binary")


def pixel_arrays(media: DataFrame) -> DataFrame:
    """doc_id, picture, width, height, argb of every picture in ``media`` (doc_id, media: a series of files)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "media"):
                series = [files_of(x or b"") for x in part.column("media").to_pylist()]
                read = decode_files([f for files in series for f in files])
                doc_id = [i for i, files in zip(part.column("doc_id").to_pylist(), series, strict=True) for _ in files]
                size = lambda k: pa.array([x.shape[k] for x in read], pa.int32())
                argb = pa.array([x.reshape(-1).astype(np.int64) for x in read], pa.list_(pa.int64()))
                columns = [pa.array(doc_id, pa.int64()), pa.array([k for files in series for k in range(len(files))], pa.int32()), size(1), size(0), argb]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "picture", "width", "height", "argb"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, picture int, width int, height int, argb array<long>")
