"""Lossless WebP (VP8L) in NumPy: a decoder of the whole format, and an encoder of byte payloads.

``decode`` reads any lossless file: prefix codes, back-references, colour cache,
meta prefix codes, and the predictor, cross-colour, subtract-green and palette
transforms. ``encode_many`` writes grey images of many payloads. Every file has
back-references where a passage of ``LEAST_COPY`` samples or more comes again;
grey is stored by the subtract-green transform, payloads of at most 16 values by a
palette whose indices share bytes, and payloads whose residuals to the left or the
upper neighbour have the lower entropy by the predictor transform.
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

#: Fixed values of the format: the order in which code-length code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Symbols of a channel, of backward lengths, and of distances.
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
#: Longest code that the encoder writes.
LONGEST_CODE = 12
#: Shortest and longest copy that the encoder writes.
LEAST_COPY, MOST_COPY = 8, 4096
#: Kinds of transform in the format.
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Lanes below which files are read one by one, and literals between the turns of copies.
FEW_LANES, COPY_TURN = 64, 4
LEFT, TOP = 1, 2  # predictors that the encoder chooses from
MAX_SIDE = 1 << 14
BLACK = np.array([0, 0, 0, 255], np.int32)  # red, green, blue, alpha
CACHE_FACTOR = 0x1E35A7BD


def near_offsets() -> list[tuple[int, int]]:
    """The pixels (x to the left, y up) of the short distance codes: by distance, then the nearer column, left first."""
    around = [(x, 0) for x in range(1, 9)] + [(x, y) for y in range(1, 8) for x in range(-7, 9)]
    return sorted(around, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


NEAR = near_offsets()


class Bits:
    """Bits of a byte string, least significant first; ``windows`` has the eight bytes from each byte on, first those of the head."""

    HEAD = 1024

    def __init__(self, data: bytes):
        self.data, self.position = data, 0
        self.windows = self._windows(data[: self.HEAD + 8])[: self.HEAD]

    @staticmethod
    def _windows(data: bytes) -> list[int]:
        return np.ndarray((len(data) + 8,), "<u8", data + bytes(16), strides=(1,)).tolist()

    def reach(self, ahead: int) -> list[int]:
        """The windows, for at least ``ahead`` bytes more if there are as many."""
        if (self.position >> 3) + ahead >= len(self.windows) < len(self.data) + 8:
            self.windows = self._windows(self.data)
        return self.windows

    def peek(self, n: int) -> int:
        try:
            window = self.windows[self.position >> 3]
        except IndexError:
            window = self.reach(8)[self.position >> 3]
        return (window >> (self.position & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.position += n
        return out


_TURNED = np.zeros(1 << 15, np.int64)  # 15 bits in the other order
for _k in range(15):
    _TURNED |= ((np.arange(1 << 15) >> _k) & 1) << (14 - _k)
_ORDERS = [_TURNED[np.arange(1 << k)] >> (15 - k) for k in range(16)]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical code words of the lengths in each row, bits reversed as they are written."""
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=-1, kind="stable")
    own = np.take_along_axis(lengths, order, -1)
    step = np.where(own > 0, 1 << (15 - own), 0)
    codes = np.zeros(lengths.shape, np.int64)
    np.put_along_axis(codes, order, np.where(own > 0, _TURNED[(np.cumsum(step, axis=-1) - step) & 0x7FFF], 0), -1)
    return codes


class Prefix:
    """One prefix code as a table of symbol << 4 | bits; a code of one symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else None
        if self.only is not None:
            self.bits, self.entries = 0, np.array([self.only << 4])
        else:
            own = lengths[used]
            self.bits = int(own.max()) if len(used) else 0
            by = np.argsort(own, kind="stable")
            entries = np.repeat(used[by] << 4 | own[by], 1 << (self.bits - own[by]))
            if len(entries) != 1 << self.bits or not len(used):
                raise ValueError("broken prefix code")
            self.entries = entries[_ORDERS[self.bits]]

    @functools.cached_property
    def table(self) -> list[int]:
        return self.entries.tolist()

    @staticmethod
    @functools.lru_cache(4096)
    def single(symbol: int) -> Prefix:
        return Prefix(np.arange(symbol + 1) == symbol)

    @staticmethod
    @functools.lru_cache(4096)
    def small(lengths: tuple[int, ...]) -> Prefix:
        return Prefix(np.array(lengths, np.int64))

    def runs(self) -> list[int]:
        """For each window of bits up to three literals that it begins with, in one number.

        From below: four bits for how many bits they take, two for how many they are,
        eight for each. A window that begins with another symbol has this symbol above
        bit 32 instead.
        """
        one = self.entries
        size, symbol = one & 15, one >> 4
        literal = symbol < LITERALS
        out, bits, n = symbol << 6, size.copy(), np.where(literal, 1, 0)
        at = np.arange(len(one))
        going = literal.copy()
        for k in (1, 2):
            following = (at >> bits) & (len(one) - 1)
            going &= literal[following] & (bits + size[following] <= self.bits)
            out += np.where(going, symbol[following] << (6 + 8 * k), 0)
            bits += np.where(going, size[following], 0)
            n += going
        return np.where(literal, out | n << 4 | bits, symbol << 32 | size).tolist()

    def read(self, bits: Bits) -> int:
        found = self.table[bits.peek(self.bits)]
        bits.position += found & 15
        return found >> 4


def read_prefix(bits: Bits, size: int) -> Prefix:
    """One prefix code over ``size`` symbols."""
    head = bits.peek(19)
    if head & 1:  # one symbol or two, the first of one bit or eight
        wide = 8 if head & 4 else 1
        first = head >> 3 & ((1 << wide) - 1)
        bits.position += 3 + wide
        second = bits.read(8) if head & 2 else first
        return Prefix.single(first) if second == first else Prefix.small(tuple(int(k in (first, second)) for k in range(max(first, second) + 1)))
    n = 4 + (head >> 1 & 15)
    bits.position += 5
    v = bits.peek(57)
    bits.position += 3 * n
    own = [0] * 19
    for s in LENGTH_ORDER[:n]:
        own[s] = v & 7
        v >>= 3
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code = Prefix.small(tuple(own))
    windows = bits.reach(2 * size)
    table, mask, p = code.table, (1 << code.bits) - 1, bits.position
    out: list[int] = []
    last = 8
    while len(out) < size and left:
        left -= 1
        v = windows[p >> 3] >> (p & 7)
        found = table[v & mask]
        v >>= found & 15
        p += found & 15
        s = found >> 4
        if s < 16:
            out.append(s)
            last = s or last
        elif s == 16:
            out += [last] * (3 + (v & 3))
            p += 2
        elif s == 17:
            out += [0] * (3 + (v & 7))
            p += 3
        else:
            out += [0] * (11 + (v & 127))
            p += 7
    bits.position = p
    return Prefix(np.array(out[:size], np.int64))


def _value(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _copy_source(code: int, width: int) -> int:
    """How many pixels back a distance code points."""
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _green_image(bits: Bits, green: Prefix, distance: Prefix, width: int, end: int) -> bytearray:
    """The green channel of an image whose other channels are constant, without a cache."""
    windows, p = bits.reach(len(bits.data)), bits.position
    if green.only is not None:
        return bytearray([green.only]) * end  # an image cannot begin with a copy
    table, mask = green.runs(), (1 << green.bits) - 1
    far, far_mask = distance.table, (1 << distance.bits) - 1
    runs: list[int] = []  # literals, as the table has them
    copies: list[tuple[int, int, int]] = []  # literals before it, how far back, how long
    at = copied = 0
    push = runs.append
    while at < end:
        found = table[(windows[p >> 3] >> (p & 7)) & mask]
        p += found & 15
        if found < 1 << 32:
            push(found)
            at += found >> 4 & 3
            continue
        s = (found >> 32) - LITERALS
        v = windows[p >> 3] >> (p & 7)
        length = s + 1
        if s > 3:
            extra = (s - 2) >> 1
            length = ((2 + (s & 1)) << extra) + (v & ((1 << extra) - 1)) + 1
            v >>= extra
            p += extra
        found = far[v & far_mask]
        v >>= found & 15
        p += found & 15
        s = found >> 4
        code = s + 1
        if s > 3:
            extra = (s - 2) >> 1
            code = ((2 + (s & 1)) << extra) + (v & ((1 << extra) - 1)) + 1
            p += extra
        back = code - 120 if code > 120 else _copy_source(code, width)
        if back > at or at + length > end:
            raise ValueError("back-reference outside the image")
        copies.append((at - copied, back, length))
        copied += length
        at += length
    if at > end:  # the last window went on into what follows
        last = runs.pop()
        p -= last & 15
        for k in range((last >> 4 & 3) - (at - end)):
            found = green.table[(windows[p >> 3] >> (p & 7)) & mask]
            p += found & 15
            push(found >> 4 << 6 | 1 << 4)
    bits.position = p
    r = np.array(runs, np.int64)
    three = np.stack([r >> 6, r >> 14, r >> 22], axis=1).astype(np.uint8)
    literals = three[np.arange(3) < (r >> 4 & 3)[:, None]].tobytes()
    out, at = bytearray(), 0
    for to, back, length in copies:
        if to > at:
            out += literals[at:to]
            at = to
        if back >= length:
            out += out[-back : length - back or None]
        else:
            out += (out[-back:] * (length // back + 1))[:length]
    out += literals[at:]
    return out


class _Codes:
    """What stands before the pixels of an entropy-coded image: cache size, and the groups of prefix codes of its blocks."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        self.groups, self.shift = np.zeros((1, 1), np.int64), 0
        if main and bits.read(1):
            self.shift = bits.read(3) + 2
            block = 1 << self.shift
            meta = _entropy_image(bits, -(-width // block), -(-height // block), False)
            self.groups = meta[..., 0].astype(np.int64) << 8 | meta[..., 1]
        sizes = (LITERALS + LENGTHS + (1 << self.cache_bits if self.cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
        self.codes = [[read_prefix(bits, n) for n in sizes] for _ in range(int(self.groups.max()) + 1)]

    @property
    def one_channel(self) -> bool:
        """Only green varies, in one group of codes and without a cache."""
        return len(self.codes) == 1 and not self.cache_bits and all(c.only is not None for c in self.codes[0][1:4])

    def of_green(self, green: np.ndarray, width: int, height: int) -> np.ndarray:
        out = np.empty((width * height, 4), np.uint8)
        out[:, 1] = green
        for channel, code in zip((0, 2, 3), self.codes[0][1:4], strict=True):
            out[:, channel] = code.only
        return out.reshape(height, width, 4)


def _entropy_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels (height, width, rgba) of an entropy-coded image."""
    return _pixels(bits, _Codes(bits, width, height, main), width, height)


def _pixels(bits: Bits, own: _Codes, width: int, height: int) -> np.ndarray:
    end = width * height
    if own.one_channel:
        green, _, _, _, distance = own.codes[0]
        return own.of_green(np.frombuffer(_green_image(bits, green, distance, width, end), np.uint8), width, height)
    cache_bits, shift, codes, groups = own.cache_bits, own.shift, own.codes, own.groups.tolist()
    single = codes[0] if len(codes) == 1 else None
    pixels: list[int] = []  # alpha, red, green, blue in one number
    cache = [0] * (1 << cache_bits)
    cached = 0  # pixels before this one are in the cache
    at = 0
    while at < end:
        green, red, blue, alpha, distance = single or codes[groups[at // width >> shift][at % width >> shift]]
        s = green.read(bits)
        if s < LITERALS:
            r, b = red.read(bits), blue.read(bits)
            pixels.append(alpha.read(bits) << 24 | r << 16 | s << 8 | b)
            at += 1
        elif s < LITERALS + LENGTHS:
            length = _value(bits, s - LITERALS)
            back = _copy_source(_value(bits, distance.read(bits)), width)
            if back > at or at + length > end:
                raise ValueError("back-reference outside the image")
            pixels += (pixels[at - back :] * (length // back + 1))[:length] if back < length else pixels[at - back : at - back + length]
            at += length
        else:
            for p in pixels[cached:at]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached = at
            pixels.append(cache[s - LITERALS - LENGTHS])
            at += 1
    packed = np.array(pixels, np.uint32)
    return np.stack([packed >> 16, packed >> 8, packed, packed >> 24], axis=1).astype(np.uint8).reshape(height, width, 4)


def _predict(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    def mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a + b) >> 1

    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        half = mean(left, top)
        gap = half - top_left
        return np.clip(half + np.sign(gap) * (np.abs(gap) >> 1), 0, 255)
    return BLACK


def inverse_predictor(image: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    """Pixels from residuals; ``modes`` holds the predictor of each block in its green channel."""
    height, width = image.shape[:2]
    out = image.astype(np.int32)
    modes = modes[..., 1] & 15
    out[0, 0] += BLACK
    if (modes == modes.flat[0]).all() and modes.flat[0] in (LEFT, TOP):
        # the first row goes by the left neighbour and the first column by the upper one, whatever the mode
        out[:, 0] = np.cumsum(out[:, 0], axis=0)
        if modes.flat[0] == LEFT:
            return (np.cumsum(out, axis=1) & 255).astype(np.uint8)
        out[0] = np.cumsum(out[0], axis=0)
        out[:, 1:] = np.cumsum(out[:, 1:], axis=0)
        return (out & 255).astype(np.uint8)
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        for x in range(1, width):
            corner = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
            p = _predict(int(modes[y >> size_bits, x >> size_bits]), out[y, x - 1], out[y - 1, x], corner, out[y - 1, x - 1])
            out[y, x] = (out[y, x] + p) & 255
    return out.astype(np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).astype(np.int8).astype(np.int32)


def inverse_cross_colour(image: np.ndarray, factors: np.ndarray, size_bits: int) -> np.ndarray:
    """Red and blue from their residuals to green and red."""
    height, width = image.shape[:2]
    rows, cols = np.arange(height) >> size_bits, np.arange(width) >> size_bits
    f = _signed(factors)[rows][:, cols]
    out = image.astype(np.int32)
    green = _signed(image[..., 1])
    red = (out[..., 0] + (f[..., 2] * green >> 5)) & 255
    out[..., 2] = (out[..., 2] + (f[..., 1] * green >> 5) + (f[..., 0] * _signed(red) >> 5)) & 255
    out[..., 0] = red
    return out.astype(np.uint8)


def inverse_palette(image: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """Colours from indices, several of which share a pixel's green if the palette is small."""
    bits = _bundle_bits(len(palette))
    index = image[..., 1].astype(np.int64)
    if bits:
        each = 8 >> bits
        shifts = np.arange(1 << bits) * each
        index = (index[..., None] >> shifts & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[: len(palette)] = palette
    return full[index]


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _payload(data: bytes) -> bytes:
    """The VP8L chunk of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def _header(data: bytes) -> tuple[Bits, int, int, bool]:
    bits = Bits(_payload(data))
    if bits.read(8) != 0x2F:
        raise ValueError("wrong signature")
    width, height, alpha = bits.read(14) + 1, bits.read(14) + 1, bool(bits.read(1))
    if bits.read(3):
        raise ValueError("unknown version")
    return bits, width, height, alpha


class _File:
    """A file up to its pixels: transforms and codes."""

    def __init__(self, data: bytes):
        self.bits, self.width, self.height, self.alpha = _header(data)
        bits = self.bits
        self.steps, now = [], self.width
        while bits.read(1):
            kind = bits.read(2)
            if any(kind == k for k, *_ in self.steps):
                raise ValueError("transform used twice")
            if kind in (PREDICTOR, CROSS_COLOUR):
                size_bits = bits.read(3) + 2
                block = 1 << size_bits
                self.steps.append((kind, _entropy_image(bits, -(-now // block), -(-self.height // block), False), size_bits))
            elif kind == PALETTE:
                table = _entropy_image(bits, bits.read(8) + 1, 1, False)[0]
                table = np.cumsum(table.astype(np.int64), axis=0).astype(np.uint8)
                self.steps.append((PALETTE, table, now))
                now = -(-now // (1 << _bundle_bits(len(table))))
            else:
                self.steps.append((SUBTRACT_GREEN, None, 0))
        self.coded_width = now
        self.codes = _Codes(bits, now, self.height, True)

    def finished(self, image: np.ndarray) -> np.ndarray:
        """The transforms undone, the last one first."""
        for kind, extra, n in reversed(self.steps):
            if kind == PREDICTOR:
                image = inverse_predictor(image, extra, n)
            elif kind == CROSS_COLOUR:
                image = inverse_cross_colour(image, extra, n)
            elif kind == SUBTRACT_GREEN:
                image = image.copy()
                image[..., 0] += image[..., 1]
                image[..., 2] += image[..., 1]
            else:
                image = inverse_palette(image, extra, n)
        if not self.alpha:
            image[..., 3] = 255
        return image


def decode(data: bytes, seen: set[int] | None = None) -> np.ndarray:
    """The pixels (height, width, rgba) of a lossless WebP file; ``seen`` gets the kinds of its transforms."""
    file = _File(data)
    if seen is not None:
        seen.update(k for k, *_ in file.steps)
    return file.finished(_pixels(file.bits, file.codes, file.coded_width, file.height))


def decode_many(data: list[bytes]) -> list[np.ndarray]:
    """``decode`` of many files. The symbols of those of which only green varies are read in lanes, one of each file a step."""
    files = [_File(d) for d in data]
    lanes = [i for i, f in enumerate(files) if f.codes.one_channel and f.codes.codes[0][0].only is None]
    green = dict(zip(lanes, _green_lanes([_payload(data[i]) for i in lanes], [files[i] for i in lanes]), strict=True))
    out = []
    for i, f in enumerate(files):
        found = green.get(i)
        image = _pixels(f.bits, f.codes, f.coded_width, f.height) if found is None else f.codes.of_green(found, f.coded_width, f.height)
        out.append(f.finished(image))
    return out


#: Extra bits and least value of each prefix symbol of lengths and distances.
_EXTRA = np.array([0 if s < 4 else (s - 2) >> 1 for s in range(DISTANCES)], np.int64)
_LEAST = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(DISTANCES)], np.int64)


def _green_lanes(chunks: list[bytes], files: list[_File]) -> list[np.ndarray | None]:
    """The green channel of each file; None for the few longest ones, which go on alone."""
    out: list[np.ndarray | None] = [None] * len(files)
    if len(files) < FEW_LANES:
        return out
    flat = np.frombuffer(b"".join(chunks) + bytes(1024), np.uint8).astype(np.uint64)
    window = flat[: len(flat) - 7].copy()
    for k in range(1, 8):
        window |= flat[k : len(flat) - 7 + k] << np.uint64(8 * k)
    del flat
    sizes = np.array([len(c) for c in chunks], np.int64)
    codes = [f.codes.codes[0] for f in files]
    table, far = (np.concatenate([c[k].entries.astype(np.uint16) for c in codes]) for k in (0, 4))
    starts = [np.cumsum([0] + [len(c[k].entries) for c in codes])[:-1] for k in (0, 4)]
    masks = [np.array([(1 << c[k].bits) - 1 for c in codes], np.uint64) for k in (0, 4)]
    lane = np.arange(len(files), dtype=np.int32)
    bit = (np.cumsum(sizes) - sizes) * 8 + np.array([f.bits.position for f in files], np.int64)
    end = np.array([f.coded_width * f.height for f in files], np.int64)
    at = np.zeros(len(files), np.int64)
    base, mask, ends = starts[0], masks[0], end
    copy_from = np.uint16(LITERALS << 4)
    start = np.cumsum(end + 1) - (end + 1)  # a place more for what lanes read beyond their end
    pixels, home = np.zeros(int((end + 1).sum()), np.uint8), start
    copies = []
    step = 0
    while len(lane) >= FEW_LANES:
        for _ in range(COPY_TURN):  # a lane that meets a copy waits for its turn
            v = window[bit >> 3] >> (bit & 7).astype(np.uint64)
            found = table[base + (v & mask).astype(np.int64)]
            literal = found < copy_from
            pixels[home + np.minimum(at, ends)] = found >> 4
            bit += (found & 15) * literal
            at += literal
        step += 1
        v = window[bit >> 3] >> (bit & 7).astype(np.uint64)
        found = table[base + (v & mask).astype(np.int64)]
        c = np.flatnonzero(found >= copy_from)
        if len(c):
            found = found[c].astype(np.int64)
            v = v[c] >> (found & 15).astype(np.uint64)
            own, which, took = bit[c], lane[c], found & 15
            s = (found >> 4) - LITERALS
            extra = _EXTRA[s]
            length = _LEAST[s] + (v & ((1 << extra) - 1).astype(np.uint64)).astype(np.int64)
            v >>= extra.astype(np.uint64)
            found = far[starts[1][which] + (v & masks[1][which]).astype(np.int64)].astype(np.int64)
            v >>= (found & 15).astype(np.uint64)
            s = found >> 4
            more = _EXTRA[s]
            copies.append((which, length, _LEAST[s] + (v & ((1 << more) - 1).astype(np.uint64)).astype(np.int64), at[c]))
            bit[c] = own + took + extra + (found & 15) + more
            at[c] += length
        if step % 4 == 0:
            live = at < ends
            if not live.all():
                lane, bit, at, base, mask, ends, home = (x[live] for x in (lane, bit, at, base, mask, ends, home))
    which, length, code, place = (np.concatenate(x) for x in zip(*copies, strict=True)) if copies else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((place, which))
    which, length, code, place = which[order], length[order], code[order], place[order]
    kept = place < end[which]
    which, length, code, place = which[kept], length[kept], code[kept], place[kept]
    width = np.array([f.coded_width for f in files], np.int64)
    near = np.array(NEAR, np.int64)
    short = near[np.minimum(code, len(NEAR)) - 1]
    back = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, short[:, 0] + short[:, 1] * width[which]))
    if (back > place).any() or (place + length > end[which]).any():
        raise ValueError("back-reference outside the image")
    bounds = np.searchsorted(which, np.arange(len(files) + 1)).tolist()
    place, length, back = place.tolist(), length.tolist(), back.tolist()
    whole = np.ones(len(files), bool)
    whole[lane] = False
    for i in np.flatnonzero(whole).tolist():
        own = bytearray(pixels[start[i] : start[i] + end[i]].tobytes())
        for k in range(bounds[i], bounds[i + 1]):
            p, n, b = place[k], length[k], back[k]
            own[p : p + n] = own[p - b : p - b + n] if b >= n else (own[p - b : p] * (n // b + 1))[:n]
        out[i] = np.frombuffer(own, np.uint8)
    return out


def code_lengths(counts: np.ndarray, limit: int = LONGEST_CODE) -> np.ndarray:
    """Huffman code lengths of at most ``limit`` bits; a single symbol gets length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        out[used] = 1
        return out
    weight = counts[used].tolist()
    while True:
        n = len(used)
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        parent = [0] * (2 * n - 1)
        for new in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = new
            heapq.heappush(heap, (a + b, new))
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:n]) <= limit:
            out[used] = depth[:n]
            return out
        weight = [(w + 1) // 2 + max(weight) // (1 << limit) for w in weight]


#: The encoder's code-length code: sixteen symbols of four bits, so it is complete.
_PLAIN = (*range(14), 17, 18)
_PLAIN_CODE = dict(zip(_PLAIN, [int(format(i, "04b")[::-1], 2) for i in range(16)], strict=True))


def _write_prefix(lengths: np.ndarray) -> tuple[int, int]:
    """Bits of a prefix code's description, as an integer, and how many."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) == 1:
        return 1 | 0 << 1 | 1 << 2 | used[0] << 3, 11
    value, n = 0, 1
    value |= (19 - 4) << n
    n += 4
    for s in LENGTH_ORDER:
        value |= (4 if s in _PLAIN_CODE else 0) << n
        n += 3
    n += 1  # all symbols have their length written
    last, size = -1, len(lengths)

    def zeros(run: int) -> None:
        nonlocal value, n
        while run >= 3:
            own = min(run, 138)
            if own >= 11:
                value |= (_PLAIN_CODE[18] | (own - 11) << 4) << n
                n += 11
            else:
                value |= (_PLAIN_CODE[17] | (own - 3) << 4) << n
                n += 7
            run -= own
        for _ in range(run):
            value |= _PLAIN_CODE[0] << n
            n += 4

    for s in used:
        zeros(s - last - 1)
        value |= _PLAIN_CODE[int(lengths[s])] << n
        n += 4
        last = s
    zeros(size - last - 1)
    return value, n


def _riff(chunk: bytes) -> bytes:
    pad = b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + pad


_ONE_BLACK, _ONE_OPAQUE = (_write_prefix(np.eye(LITERALS, dtype=np.int64)[k])[0] for k in (0, 255))


def _residuals(samples: np.ndarray, bounds: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the predictors by the left and by the upper neighbour leave of grey samples."""
    left, top = samples.copy(), samples.copy()
    left[1:] -= samples[:-1]
    for w in np.unique(widths).tolist():
        mine = np.flatnonzero(widths == w)
        rows = np.diff(bounds)[mine] // w
        first = np.repeat(bounds[:-1][mine] - w * (np.cumsum(rows) - rows), rows) + w * np.arange(rows.sum())  # where rows begin
        if len(mine) == len(widths):
            top[w:] -= samples[:-w]
        else:
            at = (first[:, None] + np.arange(w)).ravel()
            top[at] -= samples[np.maximum(at - w, 0)]
        left[first] = samples[first] - samples[np.maximum(first - w, 0)]
        head = (bounds[:-1][mine][:, None] + np.arange(w)).ravel()
        top[head] = samples[head] - samples[np.maximum(head - 1, 0)]
        for plane in (left, top):
            plane[bounds[:-1][mine]] = samples[bounds[:-1][mine]]
    return left, top


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of the samples counted in each row."""
    total = counts.sum(axis=1, keepdims=True)
    share = np.where(counts > 0, counts / np.maximum(total, 1), 1.0)
    return -(counts * np.log2(share)).sum(axis=1)


def find_copies(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of passages that come again within their part of ``flat``, each from where it stood last.

    Parts have the given sizes. From left to right, the first passage that begins
    after the last one's end is taken.
    """
    none = np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    ends = np.repeat(first + sizes, sizes)
    wide = np.concatenate([flat, np.zeros(8, np.uint8)]).astype(np.uint64)
    window = wide[: len(flat)].copy()  # eight bytes from each place on
    for k in range(1, 8):
        window |= wide[k : len(flat) + k] << np.uint64(8 * k)
    valid = np.flatnonzero(np.arange(len(flat)) + LEAST_COPY <= ends)
    part = np.repeat(np.arange(len(sizes)), sizes)[valid]
    key = (window[valid] << np.uint64(24)) | (valid - first[part]).astype(np.uint64)  # five bytes and the place
    at = 0
    for n in np.bincount(part, minlength=len(sizes)).tolist():
        key[at : at + n].sort()
        at += n
    again = np.flatnonzero((key[1:] >> np.uint64(24) == key[:-1] >> np.uint64(24)) & (part[1:] == part[:-1]))
    place = first[part] + (key & np.uint64(0xFFFFFF)).astype(np.int64)
    source = np.full(len(flat), -1, np.int64)
    source[place[again + 1]] = place[again]
    found = np.flatnonzero(source >= 0)
    found = found[window[found] == window[source[found]]]
    if not len(found):
        return none, none, none
    distance = found - source[found]
    place, stop = found + LEAST_COPY, ends[found]
    gap = window[np.minimum(place, len(flat) - 1)] ^ window[place - distance]
    same = np.bitwise_count((gap & (~gap + np.uint64(1))) - np.uint64(1)) >> 3  # equal bytes among the next eight
    least = np.minimum(LEAST_COPY + same, stop - found)
    data = flat.tobytes()
    starts, lengths, back, end = [], [], [], 0
    for i, n, d, to in zip(found.tolist(), least.tolist(), distance.tolist(), stop.tolist(), strict=True):
        if i < end:
            continue
        end = i + n
        if n == LEAST_COPY + 8:
            to = min(to, i + MOST_COPY)
            for step in (256, 32, 8, 1):
                while end + step <= to and data[end : end + step] == data[end - d : end - d + step]:
                    end += step
        starts.append(i)
        lengths.append(end - i)
        back.append(d)
    return np.array(starts, np.int64), np.array(lengths, np.int64), np.array(back, np.int64)


def _prefixed(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols of lengths or distance codes, how many extra bits each has, and these."""
    v = value - 1
    top = np.frexp(np.maximum(v, 1).astype(float))[1] - 1  # place of the highest bit
    extra = np.where(v < 4, 0, top - 1)
    symbol = np.where(v < 4, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1))
    return symbol, extra, v & ((1 << extra) - 1)


def _near_codes(width: int) -> np.ndarray:
    """The least short code of each small distance; 0 if there is none."""
    out = np.zeros(9 + 8 * width + 8, np.int64)
    for code in range(len(NEAR), 0, -1):
        out[_copy_source(code, width)] = code
    return out


class _Writer:
    """Bits of a file's head as one integer."""

    def __init__(self):
        self.value, self.bits = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.bits
        self.bits += bits

    def code(self, lengths: np.ndarray) -> None:
        self.put(*_write_prefix(lengths))

    def small_image(self, pixels: np.ndarray) -> None:
        """An image (n, rgba) without cache, references and meta codes."""
        self.put(0, 1)
        channels = [pixels[:, c].astype(np.int64) for c in (1, 0, 2, 3)]
        codes = []
        for c, size in zip(channels, (LITERALS + LENGTHS, LITERALS, LITERALS, LITERALS), strict=True):
            lengths = code_lengths(np.bincount(c, minlength=size))
            self.code(lengths)
            codes.append((canonical(lengths), np.zeros_like(lengths) if (lengths > 0).sum() == 1 else lengths))
        self.code(np.eye(DISTANCES, dtype=np.int64)[0])
        for pixel in zip(*(c.tolist() for c in channels), strict=True):
            for s, (words, lengths) in zip(pixel, codes, strict=True):
                self.put(int(words[s]) if lengths[s] else 0, int(lengths[s]))


def _plans(samples: np.ndarray, bounds: np.ndarray, widths: np.ndarray) -> tuple[list[bytes], list[int | np.ndarray | None]]:
    """What each image codes: its plane, and the predictor or the palette (or None) that leads back to the samples."""
    n, size = len(bounds) - 1, np.diff(bounds)
    image = np.repeat(np.arange(n), size)
    count = lambda plane: np.bincount(image * LITERALS + plane, minlength=n * LITERALS).reshape(n, LITERALS)
    counts = count(samples)
    planes = [samples, *_residuals(samples, bounds, widths)]
    costs = [_entropy(counts), *(_entropy(count(p)) + 200 for p in planes[1:])]
    best = np.argmin(costs, axis=0)
    values = (counts > 0).sum(axis=1)
    out: list[bytes] = []
    how: list[int | np.ndarray | None] = []
    for i in range(n):
        own = slice(bounds[i], bounds[i + 1])
        if 1 < values[i] <= 16:
            palette = np.flatnonzero(counts[i])
            bits = _bundle_bits(len(palette))
            index = np.searchsorted(palette, samples[own]).reshape(-1, widths[i])
            index = np.pad(index, ((0, 0), (0, -int(widths[i]) % (1 << bits)))).reshape(len(index), -1, 1 << bits)
            out.append((index << np.arange(1 << bits) * (8 >> bits)).sum(axis=2).astype(np.uint8).tobytes())
            how.append(palette)
        else:
            out.append(planes[best[i]][own].tobytes())
            how.append((None, LEFT, TOP)[best[i]])
    return out, how


def encode_many(samples: np.ndarray, bounds: np.ndarray, widths: np.ndarray) -> list[bytes]:
    """Files of grey images; image i is ``samples[bounds[i]:bounds[i+1]]`` in rows of ``widths[i]``."""
    n, height = len(bounds) - 1, np.diff(bounds) // widths
    planes, how = _plans(samples, bounds, widths)
    coded = np.array([len(p) for p in planes], np.int64)
    first = np.cumsum(coded) - coded
    flat = np.frombuffer(b"".join(planes), np.uint8).astype(np.int64)
    begin, length, distance = find_copies(flat.astype(np.uint8), coded)
    of_copy = np.repeat(np.arange(n), coded)[begin]
    each = np.bincount(of_copy, minlength=n)
    rows = np.array([p // h for p, h in zip(coded.tolist(), height.tolist(), strict=True)], np.int64)  # pixels in a coded row
    code = distance + len(NEAR)
    for w in np.unique(rows).tolist():
        near = _near_codes(w)
        own = np.flatnonzero((rows[of_copy] == w) & (distance < len(near)))
        code[own] = np.where(near[distance[own]] > 0, near[distance[own]], code[own])
    length_symbol, length_bits, length_extra = _prefixed(length)
    far_symbol, far_bits, far_extra = _prefixed(code)

    inside = np.zeros(len(flat) + 1, np.int32)
    inside[begin] += 1  # copies do not overlap
    inside[begin + length] -= 1
    literal = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    of_literal = np.repeat(np.arange(n), coded)[literal]
    green = LITERALS + LENGTHS
    counts = np.bincount(np.concatenate([of_literal * green + flat[literal], of_copy * green + LITERALS + length_symbol]), minlength=n * green).reshape(n, green)
    far_counts = np.bincount(of_copy * DISTANCES + far_symbol, minlength=n * DISTANCES).reshape(n, DISTANCES)

    lengths, far_lengths = np.zeros((n, green), np.int64), np.zeros((n, DISTANCES), np.int64)
    heads = []
    for i in range(n):
        head = _Writer()
        head.put(0x2F | (int(widths[i]) - 1) << 8 | (int(height[i]) - 1) << 22, 40)
        if isinstance(how[i], np.ndarray):
            grey = np.diff(how[i], prepend=0)
            head.put(1 | PALETTE << 1 | (len(grey) - 1) << 3, 11)
            head.small_image(np.stack([grey, grey, grey, np.eye(len(grey), dtype=np.int64)[0] * 255], axis=1))
        else:
            if how[i]:
                head.put(1 | PREDICTOR << 1 | 7 << 3, 6)  # blocks of the largest side
                blocks = (-(-int(widths[i]) >> 9) or 1) * (-(-int(height[i]) >> 9) or 1)
                head.small_image(np.tile([0, how[i], 0, 255], (blocks, 1)))
            head.put(1 | SUBTRACT_GREEN << 1, 3)
        head.put(0, 3)  # no other transform, no colour cache, one group of codes
        lengths[i] = code_lengths(counts[i])
        far_lengths[i] = code_lengths(far_counts[i]) if each[i] else np.eye(DISTANCES, dtype=np.int64)[0]
        head.code(lengths[i])
        alpha = _ONE_BLACK if how[i] is not None and not isinstance(how[i], np.ndarray) else _ONE_OPAQUE  # residuals of alpha are 0
        for one in (_ONE_BLACK, _ONE_BLACK, alpha):
            head.put(one, 11)
        head.code(far_lengths[i])
        for table in (lengths, far_lengths):
            if (table[i] > 0).sum() == 1:
                table[i] = 0  # the only symbol takes no bits
        heads.append(head)

    words, far_words = canonical(lengths), canonical(far_lengths)  # no bits, no word
    # the bits of all tokens in order; a copy has two parts, its length and its distance
    cell = of_literal * green + flat[literal]
    near_cell, far_cell = of_copy * green + LITERALS + length_symbol, of_copy * DISTANCES + far_symbol
    far_size = far_lengths.ravel()[far_cell]
    order = np.argsort(np.concatenate([2 * literal, 2 * begin, 2 * begin + 1]), kind="stable")
    bits = np.concatenate([lengths.ravel()[cell], lengths.ravel()[near_cell] + length_bits, far_size + far_bits])[order]
    value = np.concatenate([
        words.ravel()[cell], words.ravel()[near_cell] | length_extra << lengths.ravel()[near_cell],
        far_words.ravel()[far_cell] | far_extra << far_size,
    ])[order]
    owner = np.concatenate([of_literal, of_copy, of_copy])[order]
    total = np.bincount(owner, weights=bits, minlength=n).astype(np.int64)
    head_bits = np.array([h.bits for h in heads], np.int64)
    room = (head_bits + total + 7) // 8 + 6
    base = np.cumsum(room) - room
    before = np.cumsum(bits) - bits
    at = before + (base * 8 + head_bits - (np.cumsum(total) - total))[owner]
    value <<= at & 7
    out = np.zeros(int(room.sum()), np.int64)
    for k in range(5):
        some = np.flatnonzero(value >> (8 * k)) if k else slice(None)
        out += np.bincount((at[some] >> 3) + k, weights=value[some] >> (8 * k) & 255, minlength=len(out)).astype(np.int64)
    done = out.astype(np.uint8)
    files = []
    for i, head in enumerate(heads):
        own = bytearray(done[base[i] : base[i] + (head.bits + int(total[i]) + 7) // 8].tobytes())
        h = head.value.to_bytes((head.bits + 7) // 8, "little")
        own[: len(h) - 1] = h[:-1]
        own[len(h) - 1] |= h[-1]
        files.append(_riff(bytes(own)))
    return files
