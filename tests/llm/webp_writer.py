"""A slow writer of VP8L files for tests: forward transforms, references, cache and meta codes."""

import heapq
import struct

import numpy as np

ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def halves(a, b):
    return [(x + y) // 2 for x, y in zip(a, b)]


def predicted(mode, left, top, right, corner):
    clip = lambda x: max(0, min(255, x))
    near_left = sum(abs(t - c) for t, c in zip(top, corner)) < sum(abs(x - c) for x, c in zip(left, corner))
    half = halves(left, top)
    return [
        [0, 0, 0, 255], left, top, right, corner, halves(halves(left, right), top), halves(left, corner), half, halves(corner, top), halves(top, right),
        halves(halves(left, corner), halves(top, right)), left if near_left else top, [clip(a + b - c) for a, b, c in zip(left, top, corner)],
        [clip(a + int((a - c) / 2)) for a, c in zip(half, corner)],
    ][mode]


def lengths_of(counts, limit=15):
    used = [i for i, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) < 2:
        for i in used or [0]:
            out[i] = 1
        return out
    heap = [(counts[i], i, (i,)) for i in used]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            out[i] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    assert max(out) <= limit
    return out


class Writer:
    def __init__(self, dice):
        self.dice, self.bits = dice, []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]

    def code(self, lengths):
        words, code = {}, 0
        for n in range(1, 16):
            for s, own in enumerate(lengths):
                if own == n:
                    words[s] = [code >> (n - 1 - i) & 1 for i in range(n)]
                    code += 1
            code <<= 1
        if len(words) == 1:
            words = {s: [] for s in words}
        return words

    def prefix(self, counts):
        lengths = lengths_of(counts)
        used = [i for i, n in enumerate(lengths) if n]
        if len(used) <= 2 and max(used) < 256 and all(lengths[i] == 1 for i in used):
            self.put(1, 1)
            self.put(len(used) - 1, 1)
            self.put(int(used[0] > 1), 1)
            self.put(used[0], 8 if used[0] > 1 else 1)
            if len(used) == 2:
                self.put(used[1], 8)
            return self.code(lengths)
        runs, i, last = [], 0, 8
        while i < len(lengths):
            j = i
            while j < len(lengths) and lengths[j] == lengths[i]:
                j += 1
            run, value = j - i, lengths[i]
            if value == 0 and run >= 11:
                run = min(run, 138)
                runs.append((18, run - 11, 7))
            elif value == 0 and run >= 3:
                runs.append((17, run - 3, 3))
            elif value and value == last and run >= 3:
                run = min(run, 6)
                runs.append((16, run - 3, 2))
            else:
                run = 1
                runs.append((value, 0, 0))
                last = value or last
            i += run
        own = lengths_of([sum(r[0] == s for r in runs) for s in range(19)], 7)
        self.put(0, 1)
        self.put(15, 4)
        for s in ORDER:
            self.put(own[s], 3)
        self.put(0, 1)
        words = self.code(own)
        for s, extra, n in runs:
            self.bits += words[s]
            self.put(extra, n)
        return self.code(lengths)

    @staticmethod
    def split(value):
        """Prefix symbol, extra bits and their number of a length or distance code."""
        value -= 1
        if value < 4:
            return value, 0, 0
        high = value.bit_length() - 1
        second = value >> (high - 1) & 1
        return 2 * high + second, value & ((1 << (high - 1)) - 1), high - 1

    def pixels(self, image, cache_bits, main, meta):
        height, width = image.shape[:2]
        flat = [tuple(map(int, p)) for p in image.reshape(-1, 4)]
        self.put(int(cache_bits > 0), 1)
        if cache_bits:
            self.put(cache_bits, 4)
        groups = np.zeros((height, width), int)
        if main:
            self.put(int(meta), 1)
            if meta:
                self.put(0, 3)
                small = np.array([[self.dice.randrange(3) for _ in range(-(-width // 4))] for _ in range(-(-height // 4))])
                small.flat[0] = 2
                code = np.zeros((*small.shape, 4), np.uint8)
                code[..., 1], code[..., 3] = small, 255
                self.pixels(code, 0, False, False)
                groups = small.repeat(4, 0).repeat(4, 1)[:height, :width]
        group = groups.ravel()
        out, at, cache = [], 0, {}
        key = lambda p: (0x1E35A7BD * (p[3] << 24 | p[0] << 16 | p[1] << 8 | p[2]) & 0xFFFFFFFF) >> (32 - cache_bits)
        while at < len(flat):
            length, back = 0, 0
            for d in (1, width, 2 * width + 1, at):
                n = 0
                while 0 < d <= at and at + n < len(flat) and n < 4096 and flat[at + n] == flat[at + n - d]:
                    n += 1
                if n > length:
                    length, back = n, d
            if length >= 3:
                near = {1: 2, width: 1}.get(back, back + 120) if width > 8 else back + 120
                out.append((group[at], "copy", length, near))
            elif cache_bits and cache.get(key(flat[at])) == flat[at]:
                length = 1
                out.append((group[at], "cache", key(flat[at]), 0))
            else:
                length = 1
                out.append((group[at], "pixel", flat[at], 0))
            for p in flat[at : at + length]:
                if cache_bits:
                    cache[key(p)] = p
            at += length
        codes = []
        for g in range(int(group.max()) + 1):
            counts = [[0] * (280 + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
            for own, kind, x, y in out:
                if own == g and kind == "pixel":
                    for k, c in enumerate((1, 0, 2, 3)):
                        counts[k][x[c]] += 1
                elif own == g and kind == "copy":
                    counts[0][256 + self.split(x)[0]] += 1
                    counts[4][self.split(y)[0]] += 1
                elif own == g:
                    counts[0][280 + x] += 1
            codes.append([self.prefix(c) for c in counts])
        for g, kind, x, y in out:
            code = codes[g]
            if kind == "pixel":
                for k, c in enumerate((1, 0, 2, 3)):
                    self.bits += code[k][x[c]]
            elif kind == "copy":
                for k, v, shift in ((0, x, 256), (4, y, 0)):
                    s, extra, n = self.split(v)
                    self.bits += code[k][s + shift]
                    self.put(extra, n)
            else:
                self.bits += code[0][280 + x]

    def image(self, image, kinds, cache_bits, meta):
        height, width = image.shape[:2]
        self.put(0x2F, 8)
        self.put(width - 1, 14)
        self.put(height - 1, 14)
        self.put(1, 1)
        self.put(0, 3)
        now = image.astype(int)
        for kind in kinds:
            self.put(1, 1)
            self.put(kind, 2)
            w = now.shape[1]
            blocks = (-(-height // 4), -(-w // 4), 4)
            if kind == 2:
                now = now.copy()
                now[..., 0] -= now[..., 1]
                now[..., 2] -= now[..., 1]
                now &= 255
            elif kind == 0:
                self.put(0, 3)
                modes = np.zeros(blocks, np.uint8)
                modes[..., 1], modes[..., 3] = [[self.dice.randrange(14) for _ in range(blocks[1])] for _ in range(blocks[0])], 255
                self.pixels(modes, 0, False, False)
                rest = now.copy()
                for y in range(height):
                    for x in range(w):
                        left, top = now[y, x - 1].tolist() if x else None, now[y - 1, x].tolist() if y else None
                        if not y:
                            p = left or [0, 0, 0, 255]
                        elif not x:
                            p = top
                        else:
                            right = now[y - 1, x + 1] if x + 1 < w else now[y, 0]
                            p = predicted(int(modes[y // 4, x // 4, 1]), left, top, right.tolist(), now[y - 1, x - 1].tolist())
                        rest[y, x] = (now[y, x] - p) & 255
                now = rest
            elif kind == 1:
                self.put(0, 3)
                factors = np.array([self.dice.randrange(256) for _ in range(int(np.prod(blocks)))], np.uint8).reshape(blocks)
                self.pixels(factors, 0, False, False)
                signed = lambda v: v - 256 if v > 127 else v
                rest = now.copy()
                for y in range(height):
                    for x in range(w):
                        rb, gb, gr, _ = (signed(int(v)) for v in factors[y // 4, x // 4])
                        r, g, b, _ = (int(v) for v in now[y, x])
                        rest[y, x, 0] = (r - (gr * signed(g) >> 5)) & 255
                        rest[y, x, 2] = (b - (gb * signed(g) >> 5) - (rb * signed(r) >> 5)) & 255
                now = rest
            else:
                table = sorted({tuple(p) for p in now.reshape(-1, 4).tolist()})
                self.put(len(table) - 1, 8)
                deltas = np.diff(np.array([[0] * 4, *table]), axis=0) & 255
                self.pixels(deltas[None].astype(np.uint8), 0, False, False)
                index = np.array([[table.index(tuple(p)) for p in row] for row in now.tolist()])
                each = 1 if len(table) <= 2 else 2 if len(table) <= 4 else 4 if len(table) <= 16 else 8
                per = 8 // each
                packed = np.zeros((height, -(-w // per), 4), int)
                for x in range(w):
                    packed[:, x // per, 1] |= index[:, x] << (each * (x % per))
                packed[..., 3] = 255
                now = packed
        self.put(0, 1)
        self.pixels(now.astype(np.uint8), cache_bits, True, meta)
        self.bits += [0] * (-len(self.bits) % 8)
        chunk = np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        body = b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + b"\0" * (len(chunk) & 1)
        return b"RIFF" + struct.pack("<I", len(body)) + body
