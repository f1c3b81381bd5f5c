"""Lossless WebP: reading and writing of 8-bit RGBA arrays.

The reader takes any VP8L stream: transforms, colour cache, several groups of prefix codes,
back-references. A stream with one group, which the writer makes by default, is
read in array operations: the length of the code at every bit is looked up at once, and only the
hops from one pixel to the next are followed one by one. Copied and cached pixels point at earlier ones.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCE_MAP = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1),
    (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5),
    (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5),
    (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6),
    (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7),
    (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2),
    (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7))
CACHE_FACTOR = 0x1E35A7BD
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
PREDICT, CROSS, GREEN, PALETTE = range(4)

# The writer's own choices.
LONGEST = 12  # bits of a prefix code
MATCH = 4  # pixels of the shortest back-reference
COPY = 4096  # pixels of the longest
SMALL = 64  # pixels of an image that is read one by one
_LENGTH_CODE = {0: 3, **dict.fromkeys((*range(1, LONGEST + 1), 17, 18), 4)}  # code lengths of code lengths


# ---- prefix codes

# The 15-bit numbers with their bits in reverse.
REVERSED = np.zeros(1, np.int64)
for _ in range(15):
    REVERSED = np.concatenate([2 * REVERSED, 2 * REVERSED + 1])


def _sorted(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used symbols by length, then number, and their lengths."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    return used, lengths[used].astype(np.int64)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of given lengths, bits reversed as the stream has them."""
    codes = np.zeros(len(lengths), np.int64)
    used, n = _sorted(lengths)
    share = 1 << (15 - n)
    # A code of n bits, set to the left of 15, is the sum of the shares before it.
    codes[used] = REVERSED[(np.cumsum(share) - share) & 0x7FFF]
    return codes


class Table:
    """Symbol and code length by the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray):
        used, n = _sorted(lengths)
        if len(used) == 1:
            self.bits, self.symbol, self.length = 0, used.astype(np.int16), np.zeros(1, np.uint8)
            return
        self.bits = bits = int(n[-1]) if len(n) else 0
        share = (1 << bits) >> n
        if not len(n) or share.sum() != 1 << bits:
            raise ValueError("incomplete prefix code")
        natural = REVERSED[: 1 << bits] if bits == 15 else REVERSED[np.arange(1 << bits) << (15 - bits)]
        self.symbol = np.repeat(used, share)[natural].astype(np.int16)
        self.length = np.repeat(n, share)[natural].astype(np.uint8)


@lru_cache(64)
def _known(lengths: bytes) -> Table:
    return Table(np.frombuffer(lengths, np.uint8))


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of at most LONGEST bits; a single symbol has length 1."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used]
    while True:
        order = np.argsort(weights, kind="stable")
        # Leaves by weight, then the sums in the order they are made, which is theirs by weight too; of equals the leaf is first.
        n, top = len(used), int(weights.sum()) + 1
        weight = [*weights[order].tolist(), *[top] * (n + 1)]
        leaf, inner = 0, n + 1
        above = [0] * (2 * n)
        for k in range(n + 1, 2 * n):
            if weight[leaf] <= weight[inner]:
                a, leaf = leaf, leaf + 1
            else:
                a, inner = inner, inner + 1
            if weight[leaf] <= weight[inner]:
                b, leaf = leaf, leaf + 1
            else:
                b, inner = inner, inner + 1
            above[a] = above[b] = k
            weight[k] = weight[a] + weight[b]
        depth = [0] * (2 * n)
        for k in range(2 * n - 2, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:n]) <= LONGEST:
            out[used[order]] = depth[:n]
            return out
        weights = weights // 2 + 1


# ---- reading


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0

    def peek(self) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        v = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * (len(self.data) - 8):
            raise ValueError("the stream ends early")
        return v

    def slice(self, at: int, n: int) -> int:
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def symbol(self, t: Table) -> int:
        k = self.peek() & ((1 << t.bits) - 1)
        self.at += int(t.length[k])
        return int(t.symbol[k])


def _read_code(bits: Bits, size: int) -> Table:
    if bits.read(1):
        lengths = np.zeros(size, np.uint8)
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return _known(lengths.tobytes())
    own = bytearray(19)
    for k in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[k]] = bits.read(3)
    t = _known(bytes(own))
    symbol, length, mask = t.symbol.tolist(), t.length.tolist(), (1 << t.bits) - 1
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    found: list[int] = []
    last, held, have, at = 8, 0, 0, bits.at
    while len(found) < size and left:
        left -= 1
        if have < 32:
            # 48 bits or more in hand.
            have, k = 56, at >> 3
            held = int.from_bytes(bits.data[k : k + 8], "little") >> (at & 7)
        s = symbol[held & mask]
        n = length[held & mask]
        if s < 16:
            found.append(s)
            last = s or last
        else:
            more = (2, 3, 7)[s - 16]
            run = (11 if s == 18 else 3) + (held >> n & (1 << more) - 1)
            found += [last if s == 16 else 0] * run
            n += more
        held >>= n
        have -= n
        at += n
    bits.at = at
    bits.read(0)
    if len(found) > size:
        raise ValueError("too many code lengths")
    return _known(bytes(found) + bytes(size - len(found)))


def _read_codes(bits: Bits, sizes: tuple[int, ...]) -> list[Table]:
    """The five codes of a group. Codes are often written alike: equal bits for equal sizes are read once."""
    out: list[Table] = []
    start = end = size = 0
    for n in sizes:
        if n == size and bits.slice(bits.at, end - start) == bits.slice(start, end - start):
            bits.at += end - start
            bits.read(0)
            out.append(out[-1])
            continue
        start, size = bits.at, n
        out.append(_read_code(bits, n))
        end = bits.at
    return out


def _extra(code: int) -> tuple[int, int]:
    """Extra bits and base value of a length or distance prefix."""
    if code < 4:
        return 0, code + 1
    n = (code - 2) >> 1
    return n, ((2 + (code & 1)) << n) + 1


_EXTRA = np.array([_extra(k) for k in range(DISTANCES)], np.int64)


def _distance(code: int, width: int) -> int:
    if code > len(DISTANCE_MAP):
        return code - len(DISTANCE_MAP)
    x, y = DISTANCE_MAP[code - 1]
    return max(1, x + y * width)


def _copy(out: np.ndarray, at: int, back: int, n: int) -> None:
    if back > at or at + n > len(out):
        raise ValueError("a back-reference leaves the image")
    while n > 0:
        k = min(n, back)
        out[at : at + k] = out[at - back : at - back + k]
        at, n, back = at + k, n - k, back + k


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, meta, step = 1, None, 0
    if main and bits.read(1):
        step = bits.read(3) + 2
        across = -(-width >> step)
        meta = (_read_pixels(bits, across, -(-height >> step), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [_read_codes(bits, sizes) for _ in range(groups)]
    out = np.zeros(width * height, np.uint32)
    if groups == 1 and len(out) > SMALL:
        if cache_bits:
            _read_array(bits, codes[0], width, out, cache_bits)
        else:
            _read_array(bits, codes[0], width, out)
        return out
    cache = np.zeros(1 << cache_bits, np.uint32)
    at = cached = 0
    total = len(out)

    def fill() -> None:
        nonlocal cached
        new = out[cached:at]
        cache[(new * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)] = new
        cached = at

    while at < total:
        group = codes[0]
        if meta is not None:
            group = codes[int(meta[(at // width >> step) * across + (at % width >> step)])]
        s = bits.symbol(group[0])
        if s < LITERALS:
            red, blue, alpha = (bits.symbol(group[k]) for k in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < LITERALS + LENGTHS:
            n, base = _extra(s - LITERALS)
            length = base + bits.read(n)
            n, base = _extra(bits.symbol(group[4]))
            _copy(out, at, _distance(base + bits.read(n), width), length)
            at += length
        else:
            fill()
            out[at] = cache[s - LITERALS - LENGTHS]
            at += 1
    return out


def _read_array(bits: Bits, codes: list[Table], width: int, out: np.ndarray, cache_bits: int = 0) -> None:
    """The pixels of a stream with one group of codes."""
    first, total = bits.at >> 3, len(out)
    # No pixel takes more than 64 bits.
    raw = np.frombuffer(bits.data, np.uint8)[first : first + 8 * total + 8].astype(np.uint32)
    word = raw.copy()
    for k in (1, 2, 3):
        word[:-k] |= raw[k:] << np.uint32(8 * k)
    window = np.empty((len(raw), 8), np.int32)
    for k in range(8):
        window[:, k] = (word >> np.uint32(k)) & np.uint32(0x7FFF)
    window = window.ravel()[bits.at & 7 :]
    n = len(window)
    place = np.arange(n, dtype=np.int32)
    ends: dict[int, np.ndarray] = {}

    def after(t: Table) -> np.ndarray:
        if id(t) not in ends:
            ends[id(t)] = np.minimum(place + t.length.take(window & ((1 << t.bits) - 1)), n - 1) if t.bits else place
        return ends[id(t)]

    green, red, blue, alpha, far = codes
    p1 = after(green)
    if green is red is blue is alpha:
        p2 = p1.take(p1)
        p3, p4 = p2.take(p1), p2.take(p2)
    else:
        p2 = after(red).take(p1)
        p3 = after(blue).take(p2)
        p4 = after(alpha).take(p3)
    count = sym = None
    if int(green.symbol.max()) >= LITERALS:
        # What a back-reference would take at each bit where its symbol could stand; a cached pixel takes its symbol only.
        sym = green.symbol.take(window & ((1 << green.bits) - 1))
        p4 = np.where(sym >= LITERALS + LENGTHS, p1, p4)
        ref = np.flatnonzero((sym >= LITERALS) & (sym < LITERALS + LENGTHS))
    if sym is not None and len(ref):
        extra, base = _EXTRA[sym[ref] - LITERALS].T
        at = p1[ref]
        length = base + (window[at] & ((1 << extra) - 1))
        at = np.minimum(at + extra, n - 1)
        code = far.symbol[window[at] & ((1 << far.bits) - 1)]
        at = after(far)[at]
        extra, base = _EXTRA[code].T
        # Up to 18 extra bits: more than one window holds.
        low, high = window[at] & ((1 << np.minimum(extra, 15)) - 1), window[np.minimum(at + 15, n - 1)] & ((1 << np.maximum(extra - 15, 0)) - 1)
        back = base + low + (high << 15)
        p4[ref] = np.minimum(at + extra, n - 1)
        count = np.ones(n, np.int32)
        count[ref] = length
        distance = np.zeros(n, np.int64)
        distance[ref] = back
    hop, p = memoryview(np.ascontiguousarray(p4)), 0
    spots: list[int] = []
    add = spots.append
    if count is None:
        for _ in range(total):
            add(p)
            p = hop[p]
    else:
        size, done = memoryview(count), 0
        while done < total:
            add(p)
            done += size[p]
            p = hop[p]
        if done > total:
            raise ValueError("a back-reference leaves the image")
    spot = np.array(spots, np.int64)
    used = 8 * (len(bits.data) - 8) - bits.at
    if p > used:
        raise ValueError("the stream ends early")
    bits.at += p

    def value(t: Table, at: np.ndarray) -> np.ndarray:
        return t.symbol[window[at] & ((1 << t.bits) - 1)].astype(np.uint32)

    def pixel(lit: np.ndarray) -> np.ndarray:
        return value(alpha, p3[lit]) << 24 | value(red, p1[lit]) << 16 | value(green, lit) << 8 | value(blue, p2[lit])

    if sym is None:
        out[:] = pixel(spot)
        return
    kind = sym[spot]
    starts = np.arange(total) if count is None else np.cumsum(count[spot]) - count[spot]
    literal = kind < LITERALS
    out[starts[literal]] = pixel(spot[literal])
    copies = np.flatnonzero(~literal & (kind < LITERALS + LENGTHS)).tolist()
    cached = kind >= LITERALS + LENGTHS
    if not cached.any():
        for k in copies:
            at = spots[k]
            _copy(out, int(starts[k]), _distance(int(distance[at]), width), int(count[at]))
        return
    # The earlier pixel that each one repeats; the last place is a colour that was never cached, 0.
    source = np.arange(total + 1)
    slot = (out * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
    slot[starts[cached]] = (kind[cached] - (LITERALS + LENGTHS)).astype(np.uint32)
    for k in copies:
        at = spots[k]
        _copy(source[:-1], int(starts[k]), _distance(int(distance[at]), width), int(count[at]))
    slot = slot[source[:-1]]
    order = np.argsort(slot, kind="stable")
    before = np.full(total, total)
    same = slot[order[1:]] == slot[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    source[starts[cached]] = before[starts[cached]]
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    out[:] = np.append(out, np.uint32(0))[source[:-1]]


def _planes(argb: np.ndarray) -> np.ndarray:
    """ARGB numbers to signed planes alpha, red, green, blue."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)]).astype(np.int32)


def _numbers(planes: np.ndarray) -> np.ndarray:
    p = (planes & 255).astype(np.uint32)
    return p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]


def _predicted(mode: int, left, top, right, corner):
    """The prediction of one or many pixels from their neighbours (planes first)."""
    if mode == 1:
        return left
    if mode in (2, 3, 4):
        return (top, right, corner)[mode - 2]
    if mode == 5:
        return (((left + right) >> 1) + top) >> 1
    if mode in (6, 7):
        return (left + (corner, top)[mode - 6]) >> 1
    if mode in (8, 9):
        return (top + (corner, right)[mode - 8]) >> 1
    if mode == 10:
        return (((left + corner) >> 1) + ((top + right) >> 1)) >> 1
    if mode == 11:
        nearer = np.abs(top - corner).sum(axis=0) < np.abs(left - corner).sum(axis=0)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = (left + top) >> 1
        half = mean - corner
        return np.clip(mean + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255)
    black = np.zeros_like(left)
    black[0] = 255
    return black


def _modes(modes: np.ndarray, step: int, width: int, height: int) -> np.ndarray:
    """The predictor of each pixel; the first row and column have their own."""
    across = -(-width >> step)
    m = modes.reshape(-1, across)[np.arange(height)[:, None] >> step, np.arange(width)[None, :] >> step].copy()
    m[m > 13] = 0
    m[:, 0], m[0, :] = 2, 1
    m[0, 0] = 0
    return m


def _unpredict(argb: np.ndarray, modes: np.ndarray, step: int, width: int, height: int) -> np.ndarray:
    p = _planes(argb).reshape(4, height, width)
    if (modes == 1).all():
        # The first column adds up downwards, then each row to the right.
        p[0, 0, 0] += 255
        p[:, :, 0] = np.cumsum(p[:, :, 0], axis=1)
        return _numbers(np.cumsum(p, axis=2, dtype=np.int32).reshape(4, -1))
    m = _modes(modes, step, width, height)
    flat = p.reshape(4, -1)
    p[:, 0] = np.cumsum(p[:, 0], axis=1)
    p[0, 0] += 255
    p &= 255
    for y in range(1, height):
        base, row, x = y * width, m[y], 0
        while x < width:
            mode, end = int(row[x]), x + 1
            while end < width and row[end] == mode:
                end += 1
            k = np.arange(base + x, base + end)
            if mode in (0, 2, 4, 8) or mode in (3, 9):
                stop = end
                # The pixel right above the last one of a row is the first of the row itself, already read.
                flat[:, k] = (flat[:, k] + _predicted(mode, flat[:, k], flat[:, k - width], flat[:, k - width + 1], flat[:, k - width - 1])) & 255
                x = stop
            elif mode == 1:
                flat[:, k] = (flat[:, k[0] - 1 : k[0]] + np.cumsum(flat[:, k], axis=1)) & 255
                x = end
            else:
                for i in k.tolist():
                    flat[:, i] = (flat[:, i] + _predicted(mode, flat[:, i - 1], flat[:, i - width], flat[:, i - width + 1], flat[:, i - width - 1])) & 255
                x = end
    return _numbers(flat)


def _cross(argb: np.ndarray, elements: np.ndarray, step: int, width: int, height: int, sign: int) -> np.ndarray:
    """Add (sign 1) or take off (-1) what other colours tell about red and blue."""
    across = -(-width >> step)
    e = elements.reshape(-1, across)[np.arange(height)[:, None] >> step, np.arange(width)[None, :] >> step].ravel()
    alpha, red, green, blue = _planes(argb)
    _, red_to_blue, green_to_blue, green_to_red = (x.astype(np.int8).astype(np.int32) for x in _planes(e))

    def part(t: np.ndarray, colour: np.ndarray) -> np.ndarray:
        return (t * (colour & 255).astype(np.int8).astype(np.int32)) >> 5

    new_red = red + sign * part(green_to_red, green)
    real_red = new_red if sign > 0 else red
    blue = blue + sign * (part(green_to_blue, green) + part(red_to_blue, real_red))
    return _numbers(np.stack([alpha, new_red, green, blue]))


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file as an array (height, width, 4) of red, green, blue, alpha."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image in the file")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1) // 2 * 2
    size = struct.unpack_from("<I", data, at + 4)[0]
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    has_alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [s[0] for s in steps]:
            raise ValueError("a transform occurs twice")
        if kind in (PREDICT, CROSS):
            step = bits.read(3) + 2
            steps.append((kind, w, step, _read_pixels(bits, -(-w >> step), -(-height >> step), False)))
        elif kind == PALETTE:
            colours = _planes(_read_pixels(bits, bits.read(8) + 1, 1, False))
            colours = _numbers(np.cumsum(colours, axis=1))
            shift = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            steps.append((kind, w, shift, colours))
            w = -(-w >> shift)
        else:
            steps.append((kind, w, 0, None))
    argb = _read_pixels(bits, w, height, True)
    for kind, w, step, more in reversed(steps):
        if kind == PREDICT:
            argb = _unpredict(argb, ((more >> np.uint32(8)) & np.uint32(255)).astype(np.int64), step, w, height)
        elif kind == CROSS:
            argb = _cross(argb, more, step, w, height, 1)
        elif kind == GREEN:
            a, r, g, b = _planes(argb)
            argb = _numbers(np.stack([a, r + g, g, b + g]))
        else:
            green = ((argb >> np.uint32(8)) & np.uint32(255)).reshape(height, -1)
            x, depth = np.arange(w), 8 >> step
            index = (green[:, x >> step] >> ((x & ((1 << step) - 1)) * depth).astype(np.uint32)) & np.uint32((1 << depth) - 1)
            argb = np.append(more, np.zeros(256, np.uint32))[index].ravel()
    if not has_alpha:
        argb = argb | np.uint32(0xFF000000)
    a, r, g, b = _planes(argb)
    return np.stack([r, g, b, a], axis=1).astype(np.uint8).reshape(height, width, 4)


# ---- writing


class Out:
    """Short fields of a stream, lowest bit first."""

    def __init__(self) -> None:
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def _length_header() -> tuple[np.ndarray, list[int], int, int]:
    own = np.zeros(19, np.uint8)
    for s, n in _LENGTH_CODE.items():
        own[s] = n
    n = 1 + max(k for k, s in enumerate(CODE_LENGTH_ORDER) if own[s])
    value = (n - 4) << 1
    for k, s in enumerate(CODE_LENGTH_ORDER[:n]):
        value |= int(own[s]) << (5 + 3 * k)
    return own, canonical(own).tolist(), value, 5 + 3 * n + 1


_OWN, _OWN_CODES, _HEADER, _HEADER_BITS = _length_header()


def _code_field(lengths: np.ndarray) -> tuple[int, int]:
    """A prefix code as the stream has it: value and bits."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 1 and (not used or used[0] < 256):
        s = used[0] if used else 0
        return 0b01 | (s > 1) << 2 | s << 3, 11 if s > 1 else 4
    value, size, at = _HEADER, _HEADER_BITS, 0
    own, codes = _OWN.tolist(), _OWN_CODES
    for s, n in zip([*used, len(lengths)], [*lengths[used].tolist(), 0], strict=True):
        gap = s - at
        while gap:
            run = min(gap, 138)
            kind, more, width = (0, 0, 0) if run < 3 else (17, run - 3, 3) if run < 11 else (18, run - 11, 7)
            run = run if kind else 1
            value |= (codes[kind] | more << own[kind]) << size
            size += own[kind] + width
            gap -= run
        if n:
            value |= codes[n] << size
            size += own[n]
        at = s + 1
    return value, size


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and their value of lengths or distances (1 or more)."""
    code = np.searchsorted(_EXTRA[:, 1], values, side="right") - 1
    return code, _EXTRA[code, 0], values - _EXTRA[code, 1]


def _matches(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references (at, distance, pixels): to the last place where the next four pixels occurred."""
    n = len(argb) - MATCH + 1
    if n < 2:
        return []
    p = argb.astype(np.uint64)
    key = ((p[:n] << np.uint64(32) | p[1 : n + 1]) * np.uint64(0x9E3779B97F4A7C15)) ^ ((p[2 : n + 2] << np.uint64(32) | p[3 : n + 3]) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return []
    later, before = order[1:][same], order[:-1][same]
    rank = np.argsort(later)
    found, free = [], 0
    for i, j in zip(later[rank].tolist(), before[rank].tolist(), strict=True):
        if i < free:
            continue
        a, b = argb[i : i + COPY], argb[j : j + COPY]
        differ = np.flatnonzero(a != b[: len(a)])
        length = int(differ[0]) if len(differ) else len(a)
        if length >= MATCH:
            found.append((i, i - j, length))
            free = i + length
    return found


def _put_pixels(out: Out, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, groups: bool = False) -> bytes | None:
    """An entropy-coded image. The main one ends the stream, so its pixels are returned as bytes."""
    out.put(1 | cache_bits << 1, 5) if cache_bits else out.put(0, 1)
    if main:
        out.put(int(groups), 1)
        if groups:
            # Two groups in a checked pattern, for readers' tests.
            out.put(0, 3)
            across, down = -(-width >> 2), -(-(len(argb) // width) >> 2)
            pattern = ((np.arange(down)[:, None] + np.arange(across)) % 2).astype(np.uint32).ravel() << np.uint32(8)
            _put_pixels(out, pattern, across, False)
    a, r, g, b = _planes(argb)
    kind = np.zeros(len(argb), np.int8)  # 0 literal, 1 start of a copy, 2 inside one, 3 cached
    refs = np.array(_matches(argb), np.int64).reshape(-1, 3)
    for at, _, n in refs.tolist():
        kind[at + 1 : at + n] = 2
    kind[refs[:, 0]] = 1
    cached = np.zeros(len(argb), np.int64)
    if cache_bits:
        # A colour is cached where the pixel before it in its slot has it too.
        slot = (argb * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
        order = np.argsort(slot, kind="stable")
        again = order[1:][(slot[order[1:]] == slot[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])]
        again = again[kind[again] == 0]
        kind[again], cached[again] = 3, slot[again]
    literal = kind == 0
    length_code, length_bits, length_more = _prefix(refs[:, 2])
    far_code, far_bits, far_more = _prefix(refs[:, 1] + len(DISTANCE_MAP))
    size = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    counts = np.bincount(np.concatenate([r[literal], b[literal], a[literal]]), minlength=256)
    green_counts = np.bincount(g[literal], minlength=size)
    if len(refs) or cache_bits:
        green_counts = green_counts + np.bincount(np.concatenate([LITERALS + length_code, LITERALS + LENGTHS + cached[kind == 3]]), minlength=size)
        lengths = code_lengths(counts)
        green_lengths = code_lengths(green_counts)
    else:
        lengths = code_lengths(counts + green_counts[:256])
        green_lengths = np.append(lengths, np.zeros(size - 256, np.uint8))
    far_lengths = code_lengths(np.bincount(far_code, minlength=DISTANCES))
    first, other, far = _code_field(green_lengths), _code_field(lengths), _code_field(far_lengths)
    for _ in range(1 + (len(pattern) > 1) if groups else 1):
        for field in (first, other, other, other, far):
            out.put(*field)

    def bare(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # A code of one symbol takes no bits.
        n = x.astype(np.int64) if (x > 0).sum() > 1 else np.zeros(len(x), np.int64)
        return canonical(x).astype(np.uint64), n

    (gc, gn), (c, n), (fc, fn) = bare(green_lengths), bare(lengths), bare(far_lengths)
    word, bits = np.zeros(len(argb), np.uint64), np.zeros(len(argb), np.int64)

    def push(where: np.ndarray, value: np.ndarray, width_: np.ndarray) -> None:
        word[where] |= (value << bits[where].astype(np.uint64)) * (width_ > 0)
        bits[where] += width_

    symbol = g.astype(np.int64)
    symbol[refs[:, 0]] = LITERALS + length_code
    symbol[kind == 3] = LITERALS + LENGTHS + cached[kind == 3]
    token = np.flatnonzero(kind != 2)
    push(token, gc[symbol[token]], gn[symbol[token]])
    at = np.flatnonzero(literal)
    for plane in (r, b, a):
        push(at, c[plane[at]], n[plane[at]])
    for value, width_ in ((length_more.astype(np.uint64), length_bits), (fc[far_code], fn[far_code]), (far_more.astype(np.uint64), far_bits)):
        push(refs[:, 0], value, width_)
    keep = bits > 0
    word, bits = word[keep], bits[keep]
    if not main:
        for v, k in zip(word.tolist(), bits.tolist(), strict=True):
            out.put(v, k)
        return None
    start = out.size + np.cumsum(bits) - bits
    total = int(out.size + bits.sum())
    words = np.zeros(total // 64 + 2, np.uint64)
    head = out.value.to_bytes(len(words) * 8 if out.size > 64 * len(words) else -(-out.size // 8) or 1, "little")
    flat = words.view(np.uint8)
    flat[: len(head)] = np.frombuffer(head, np.uint8)
    if len(word):
        cell, shift = start >> 6, (start & 63).astype(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        words[cell[first]] |= np.bitwise_or.reduceat(word << shift, first)
        last = np.append(first[1:], len(cell)) - 1
        spill = np.where(shift[last] > 0, word[last] >> ((np.uint64(64) - shift[last]) & np.uint64(63)), np.uint64(0))
        words[cell[last] + 1] |= spill
    return flat[: -(-total // 8)].tobytes()


@lru_cache(256)
def _even(value: int, n: int, width: int) -> tuple[int, int]:
    """An image of one colour, as those of the transforms are: value and bits."""
    out = Out()
    _put_pixels(out, np.full(n, value, np.uint32), width, False)
    return out.value, out.size


def encode(pixels: np.ndarray, *, predictor: int | None = None, cross: int | None = None, green: bool = False, palette: bool = False, cache_bits: int = 0, groups: bool = False) -> bytes:
    """Write (height, width, 4) red, green, blue, alpha as a lossless WebP file.

    ``predictor`` is a mode for all blocks, ``cross`` an element for all blocks; transforms apply in
    the order of the arguments.
    """
    height, width = pixels.shape[:2]
    if not 1 <= width <= 1 << 14 or not 1 <= height <= 1 << 14:
        raise ValueError("a side has 1 to 16384 pixels")
    r, g, b, a = pixels.reshape(-1, 4).T.astype(np.int32)
    argb = _numbers(np.stack([a, r, g, b]))
    out = Out()
    out.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    if palette:
        colours, index = np.unique(argb, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        out.put(1 | PALETTE << 1 | (len(colours) - 1) << 3, 11)
        planes = _planes(colours)
        _put_pixels(out, _numbers(np.diff(planes, axis=1, prepend=0)), len(colours), False)
        shift = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        short = -(-width >> shift)
        wide = np.zeros((height, short << shift), np.uint32)
        wide[:, :width] = index.reshape(height, width)
        depth = 8 >> shift
        packed = sum(wide[:, k :: 1 << shift] << np.uint32(k * depth) for k in range(1 << shift))
        argb, width = (packed << np.uint32(8) | np.uint32(0xFF000000)).ravel(), short
    if predictor is not None:
        out.put(1 | PREDICT << 1 | 2 << 3, 6)
        across, down = -(-width >> 4), -(-height >> 4)
        modes = np.full(across * down, predictor, np.int64)
        out.put(*_even(predictor << 8, len(modes), across))
        m = _modes(modes, 4, width, height).ravel()
        flat = np.pad(_planes(argb), ((0, 0), (width + 1, 1)))
        k = np.arange(len(argb)) + width + 1
        guess = np.zeros((4, len(argb)), np.int32)
        for mode in np.unique(m).tolist():
            here = m == mode
            kk = k[here]
            guess[:, here] = _predicted(mode, flat[:, kk - 1], flat[:, kk - width], flat[:, kk - width + 1], flat[:, kk - width - 1])
        argb = _numbers(_planes(argb) - guess)
    if cross is not None:
        out.put(1 | CROSS << 1 | 2 << 3, 6)
        across, down = -(-width >> 4), -(-height >> 4)
        elements = np.full(across * down, cross | 0xFF000000, np.uint32)
        out.put(*_even(cross | 0xFF000000, len(elements), across))
        argb = _cross(argb, elements, 4, width, height, -1)
    if green:
        out.put(1 | GREEN << 1, 3)
        a, r, g, b = _planes(argb)
        argb = _numbers(np.stack([a, r - g, g, b - g]))
    out.put(0, 1)
    body = _put_pixels(out, argb, width, True, cache_bits, groups)
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
