"""Lossless WebP (VP8L): a decoder for any still image, and a writer and reader of many grey tiles side by side.

``decode`` reads prefix codes (simple and normal, with meta codes), back-references and the colour
cache, and inverts predictor, cross-colour, subtract-green and palette transforms, one symbol after another.

``encode_tiles`` writes grey images, a byte a pixel: the subtract-green transform leaves red and blue at zero, back-references repeat earlier bytes, and prefix
codes are fit to each tile. Where samples of a tile promise that a predictor, a palette of at most 16 greys (several pixels a byte) or a colour cache makes it smaller, ``smaller_form``
writes it that way too, and the shorter file stays. (A grey image has no use for cross-colour: subtract-green leaves nothing of red and blue.) ``decode_tiles`` reads any number of such tiles side by side in numpy, a symbol of every tile a step, and then follows all back-references
at once; a file of another form goes to ``decode``. Matches, codes, bits and pixels of all tiles are handled together, so Python's loops run over symbols and not over bytes.
"""

from __future__ import annotations

import struct

import numpy as np

# ---- fixed values of the format

CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
#: The 120 near distances: points above and to the left, by distance, then by |x|, the right one first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return (int.from_bytes(self.data[a : a + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the image ends early")
        value = self.peek(n)
        self.at += n
        return value


class Code:
    """A canonical prefix code, read through a table as wide as its longest length."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if len(used) == 1:
            self.width, self.table = 0, [(used[0][1], 0)]
            return
        self.width = max((n for n, _ in used), default=0)
        if sum(1 << (self.width - n) for n, _ in used) != 1 << self.width:
            raise ValueError("a prefix code isn't complete")
        self.table = [(0, 0)] * (1 << self.width)
        code = last = 0
        for n, s in sorted(used):
            code <<= n - last
            last = n
            turned = int(format(code, f"0{n}b")[::-1], 2)
            for i in range(turned, 1 << self.width, 1 << n):
                self.table[i] = (s, n)
            code += 1

    def read(self, bits: Bits) -> int:
        s, n = self.table[bits.peek(self.width)]
        bits.at += n
        if bits.at > bits.size:
            raise ValueError("the image ends early")
        return s


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        value, n = (before, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3) if s == 17 else 11 + bits.read(7))
        if at + n > alphabet:
            raise ValueError("code lengths run past the alphabet")
        lengths[at : at + n] = [value] * n
        at += n
    return Code(lengths)


def _extended(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def read_pixels(bits: Bits, width: int, height: int, outer: bool) -> np.ndarray:
    """ARGB values (height, width) of an entropy-coded image. Only the outer one may have meta codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else None
    meta, meta_bits, groups = None, 0, 1
    if outer and bits.read(1):
        meta_bits = 2 + bits.read(3)
        meta = ((read_pixels(bits, _blocks(width, meta_bits), _blocks(height, meta_bits), False) >> 8) & 0xFFFF).astype(np.int64)
        groups = int(meta.max()) + 1
    sizes = (256 + 24 + len(cache or ()), 256, 256, 256, 40)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    out, n, total = [0] * (width * height), 0, width * height
    x = y = cached = 0
    while n < total:
        c = codes[meta[y >> meta_bits, x >> meta_bits]] if meta is not None else codes[0]
        s = c[GREEN].read(bits)
        if s < 256:
            r, b, a = c[RED].read(bits), c[BLUE].read(bits), c[ALPHA].read(bits)
            out[n] = a << 24 | r << 16 | s << 8 | b
            count = 1
        elif s < 280:
            count = _extended(bits, s - 256)
            far = _extended(bits, c[DISTANCE].read(bits))
            if far > 120:
                far -= 120
            else:
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            if far > n or n + count > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(n, n + count):
                out[i] = out[i - far]
        else:
            while cached < n:
                cache[(HASH * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out[n] = cache[s - 280]
            count = 1
        n += count
        x += count
        while x >= width:
            x -= width
            y += 1
    return np.array(out, np.uint32).reshape(height, width)


# ---- inverse transforms


def _channels(argb: int) -> tuple[int, int, int, int]:
    return argb >> 24, (argb >> 16) & 255, (argb >> 8) & 255, argb & 255


def _mean(a, b):
    return tuple((x + y) >> 1 for x, y in zip(a, b))


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _closer(left, top, corner):
    toward_left = sum(abs(t - c) for t, c in zip(top, corner))
    toward_top = sum(abs(a - c) for a, c in zip(left, corner))
    return left if toward_left < toward_top else top


PREDICT = (
    lambda L, T, TR, TL: (255, 0, 0, 0), lambda L, T, TR, TL: L, lambda L, T, TR, TL: T, lambda L, T, TR, TL: TR, lambda L, T, TR, TL: TL,
    lambda L, T, TR, TL: _mean(_mean(L, TR), T), lambda L, T, TR, TL: _mean(L, TL), lambda L, T, TR, TL: _mean(L, T), lambda L, T, TR, TL: _mean(TL, T),
    lambda L, T, TR, TL: _mean(T, TR), lambda L, T, TR, TL: _mean(_mean(L, TL), _mean(T, TR)), lambda L, T, TR, TL: _closer(L, T, TL),
    lambda L, T, TR, TL: tuple(_clamp(a + b - c) for a, b, c in zip(L, T, TL)),
    lambda L, T, TR, TL: tuple(_clamp(m + int((m - c) / 2)) for m, c in zip(_mean(L, T), TL)),
)


def predicted(rows: list[list[tuple]], x: int, y: int, mode: int) -> tuple:
    """What the predictor says of pixel (x, y), given the pixels before it."""
    if y == 0:
        return rows[0][x - 1] if x else (255, 0, 0, 0)
    if x == 0:
        return rows[y - 1][0]
    right = rows[y - 1][x + 1] if x + 1 < len(rows[y - 1]) else rows[y][0]
    return PREDICT[mode](rows[y][x - 1], rows[y - 1][x], right, rows[y - 1][x - 1])


def undo_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    rows: list[list[tuple]] = []
    for y in range(height):
        row: list[tuple] = []
        rows.append(row)
        for x in range(width):
            mode = int(modes[y >> bits, x >> bits] >> 8) & 15
            p = predicted(rows, x, y, mode if mode < 14 else 0)
            row.append(tuple((a + b) & 255 for a, b in zip(_channels(int(argb[y, x])), p)))
    v = np.array(rows, np.uint32)
    return v[..., 0] << 24 | v[..., 1] << 16 | v[..., 2] << 8 | v[..., 3]


def _signed(a: np.ndarray) -> np.ndarray:
    return (a & 255).astype(np.uint8).view(np.int8).astype(np.int32)


def undo_cross_colour(argb: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    f = np.repeat(np.repeat(factors, 1 << bits, 0), 1 << bits, 1)[:height, :width]
    green_red, green_blue, red_blue = _signed(f), _signed(f >> 8), _signed(f >> 16)
    green, red, blue = _signed(argb >> 8), (argb >> 16 & 255).astype(np.int32), (argb & 255).astype(np.int32)
    red = (red + (green_red * green >> 5)) & 255
    blue = (blue + (green_blue * green >> 5) + (red_blue * _signed(red) >> 5)) & 255
    return (argb & 0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def undo_green(argb: np.ndarray) -> np.ndarray:
    green = argb >> 8 & 255
    return (argb & 0xFF00FF00) | (((argb >> 16) + green) & 255) << 16 | ((argb + green) & 255)


def undo_palette(argb: np.ndarray, palette: np.ndarray, bits: int, width: int) -> np.ndarray:
    index = argb >> 8 & 255
    if bits:
        each = 8 >> bits
        parts = [index >> (each * i) & ((1 << each) - 1) for i in range(1 << bits)]
        index = np.stack(parts, -1).reshape(len(index), -1)[:, :width]
    full = np.zeros(256, np.uint32)  # indices past the palette are transparent black
    full[: len(palette)] = palette
    return full[index]


def payload(data: bytes) -> bytes:
    """The VP8L stream of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("this is no WebP file")
    at, end = 12, 8 + struct.unpack("<I", data[4:8])[0]
    while at + 8 <= end:
        kind, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if kind == b"VP8L":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("the file has no lossless image")


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) bytes R, G, B, A of a lossless WebP file."""
    bits = Bits(payload(data))
    if bits.read(8) != 0x2F:
        raise ValueError("the signature of a lossless image is missing")
    full, height = bits.read(14) + 1, bits.read(14) + 1
    alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    width, undo = full, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = 2 + bits.read(3)
            undo.append((kind, read_pixels(bits, _blocks(width, size), _blocks(height, size), False), size, width))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = read_pixels(bits, n, 1, False)[0]
            parts = np.stack([steps >> s & 255 for s in (24, 16, 8, 0)]).cumsum(1) & 255
            colours = (parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]).astype(np.uint32)
            size = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, colours, size, width))
            width = _blocks(width, size)
        else:
            undo.append((kind, None, 0, width))
    argb = read_pixels(bits, width, height, True)
    for kind, with_, size, wide in reversed(undo):
        if kind == PREDICTOR:
            argb = undo_predictor(argb, with_, size)
        elif kind == CROSS_COLOUR:
            argb = undo_cross_colour(argb, with_, size)
        elif kind == SUBTRACT_GREEN:
            argb = undo_green(argb)
        else:
            argb = undo_palette(argb, with_, size, wide)
    out = np.stack([argb >> s & 255 for s in (16, 8, 0, 24)], -1).astype(np.uint8)
    if not alpha:
        out[..., 3] = 255
    return out


# ---- grey tiles

#: A row is 192 pixels; a tile has up to TILE_ROWS rows, so that the parts of a long text are read side by side.
WIDTH, TILE_ROWS = 192, 64
ROW_BYTES = WIDTH
#: Longest code of the writer, its shortest match and the longest one (the format's limit), and distances from which a match of the least length doesn't pay.
LONGEST, LEAST, MOST, NEAR_ENOUGH = 11, 4, 4096, 512
#: The writer's code of code lengths (a choice; any complete code would do): bits of each length.
LENGTH_BITS = {0: 1, **dict.fromkeys((4, 5, 6, 7, 8), 4), **dict.fromkeys((1, 2, 3, 9, 10, 11), 5)}
_GREENS, _DISTANCES = 280, 40


def _turned(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2) if n else 0


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, first bit lowest; bits)."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - last
        last = n
        out[s] = (_turned(code, n), n)
        code += 1
    return out


_LENGTH_CODE = _canonical(LENGTH_BITS)
_REVERSED = np.array([_turned(i, LONGEST) for i in range(1 << LONGEST)])


def _bits_of(value: int, n: int) -> list[int]:
    return [value >> i & 1 for i in range(n)]


def _normal_code() -> list[int]:
    """The head of a normal code whose lengths follow under LENGTH_BITS, one for each symbol."""
    out = [0, *_bits_of(15, 4)]
    for s in CODE_LENGTH_ORDER:
        out += _bits_of(LENGTH_BITS.get(s, 0), 3)
    return [*out, 0]


def _one_symbol(s: int) -> list[int]:
    return [1, 0, 1, *_bits_of(s, 8)]


#: Signature, width, height (of each tile), no alpha, version; a subtract-green transform and no other; no colour cache; no meta codes. Then the green code.
_FRONT = [*_bits_of(0x2F, 8), *_bits_of(WIDTH - 1, 14), *([0] * 14), 0, 0, 0, 0, 1, *_bits_of(SUBTRACT_GREEN, 2), 0, 0, 0, *_normal_code()]
#: Between green's lengths and those of distances: red, blue, alpha.
_MIDDLE = [*_one_symbol(0), *_one_symbol(0), *_one_symbol(255), *_normal_code()]
_HEIGHT_AT = 22


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their number) of lengths or distances of at least 1."""
    x = value.astype(np.int64) - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    n = np.maximum(high - 1, 0)
    symbol = np.where(x < 4, x, 2 * high + ((x >> n) & 1))
    n = np.where(x < 4, 0, n)
    return symbol, x & ((1 << n) - 1), n


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths (at most LONGEST) of a complete code for each row of counts, of which two at least are above 0: rounded-up information contents, then, as
    long as codes are left over, the most frequent symbols that can be are shortened."""
    total = counts.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        n = np.ceil(np.log2(total / counts))
    n = np.where(counts > 0, np.clip(n, 1, LONGEST), 0).astype(np.int64)
    share = np.where(n > 0, 1 << (LONGEST - n), 0)
    left = (1 << LONGEST) - share.sum(1)
    order = np.argsort(-counts, axis=1, kind="stable")
    while (left < 0).any():  # clipped to LONGEST: the rarest of the shorter codes grow
        for r in np.flatnonzero(left < 0):
            for s in order[r][::-1]:
                if 0 < n[r, s] < LONGEST and left[r] < 0:
                    left[r] += 1 << (LONGEST - n[r, s] - 1)
                    n[r, s] += 1
    ranked = np.take_along_axis(n, order, 1)
    while len(open_ := np.flatnonzero(left > 0)):
        rest, own = left[open_], ranked[open_]
        for length in range(2, LONGEST + 1):
            cost = 1 << (LONGEST - length)
            if rest.max() < cost:
                continue
            here = own == length
            nth = np.cumsum(here, 1)
            take = here & (nth <= (rest // cost)[:, None])
            rest = rest - cost * take.sum(1)
            own = own - take
        left[open_], ranked[open_] = rest, own
    np.put_along_axis(n, order, ranked, 1)
    return n


def _codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, first bit lowest, of each row of lengths."""
    key = np.where(lengths > 0, lengths, LONGEST + 1)
    order = np.argsort(key, axis=1, kind="stable")
    ranked = np.take_along_axis(key, order, 1)
    share = np.where(ranked <= LONGEST, 1 << np.maximum(LONGEST - ranked, 0), 0)
    start = np.cumsum(share, 1) - share
    out = np.zeros_like(lengths)
    np.put_along_axis(out, order, _REVERSED[np.minimum(start, (1 << LONGEST) - 1)], 1)
    return out


def _runs(distance: np.ndarray, span: int) -> np.ndarray:
    """Lengths of matches of which each holds ``span`` bytes: neighbours at the same distance are one match."""
    n = len(distance)
    on = np.zeros(n, bool)
    on[:-1] = (distance[1:] == distance[:-1]) & (distance[1:] > 0)
    ends = np.where(on, n, np.arange(n, dtype=np.int32)).astype(np.int32)
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    return np.where(distance > 0, np.minimum(ends - np.arange(n, dtype=np.int32) + span, MOST), 0).astype(np.int32)


def _matches(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, distance) of a match of each byte: with the last earlier place of its tile (which begins at ``first`` and ends at ``last``) that has the same LEAST or
    the same 7 bytes, whichever is longer."""
    n = len(data)
    wide = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.as_strided(wide, (n, 8), (1, 1)).copy().view("<u8").ravel()
    at = np.arange(n, dtype=np.uint64)
    place = np.arange(n, dtype=np.int32)
    length, distance = None, None
    for span in (7, LEAST):
        if span == LEAST:
            v = words << np.uint64(32)  # the bytes themselves, then the place
        else:
            v = (words << np.uint64(64 - 8 * span)) * np.uint64(0x9E3779B97F4A7C15)
            v &= ~np.uint64(0xFFFFFFFF)
        v |= at
        v.sort()
        pos = v.astype(np.uint32).view(np.int32)
        same = (v[1:] ^ v[:-1]) < np.uint64(1 << 32)
        i, j = pos[1:][same], pos[:-1][same]
        d = np.zeros(n, np.int32)
        d[i] = i - j
        d[(place - d < first) | (place + span > last)] = 0
        if span > LEAST:  # digests may clash
            some = np.flatnonzero(d)
            d[some[((words[some] ^ words[some - d[some]]) << np.uint64(64 - 8 * span)) != 0]] = 0
        own = _runs(d, span)
        if length is None:
            length, distance = own, d
        else:
            better = own > length
            length, distance = np.where(better, own, length), np.where(better, d, distance)
    return length, distance


def _tokens(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths (0: a literal) and distances of the symbols that write the bytes, from left to right; a match waits if the next byte has a longer one."""
    n = len(data)
    length, distance = _matches(data, first, last)
    length[(length == LEAST) & (distance > NEAR_ENOUGH)] = 0
    length[np.r_[length[1:] > length[:-1], False]] = 0
    # from each byte to behind the next match, so that the loop runs over matches only
    place = np.arange(n, dtype=np.int32)
    upcoming = np.minimum.accumulate(np.where(length > 0, place, n)[::-1])[::-1]
    behind = np.append(place + length, n)[np.minimum(upcoming, n)].tolist()
    went, at = [], 0
    add = went.append
    while at < n:
        add(at)
        at = behind[at]
    starts = upcoming[went]
    starts = starts[starts < n]
    edges = np.zeros(n + 1, np.int8)
    edges[starts] += 1
    edges[starts + length[starts]] -= 1  # matches lie apart, so no place is meant twice
    symbols = np.cumsum(edges[:n], dtype=np.int8) == 0
    symbols[starts] = True
    places = np.flatnonzero(symbols)
    taken = np.zeros(n, bool)
    taken[starts] = True
    return places, np.where(taken[places], length[places], 0).astype(np.int64), distance[places].astype(np.int64)


def encode_tiles(data: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """WebP files of consecutive tiles: data holds their bytes (ROW_BYTES a row), rows how many rows each has."""
    tiles, size = len(rows), rows * ROW_BYTES
    ends = np.cumsum(size)
    at, length, distance = _tokens(data, np.repeat(ends - size, size).astype(np.int32), np.repeat(ends, size).astype(np.int32))
    tile = np.repeat(np.arange(tiles), np.diff(np.r_[0, np.searchsorted(at, ends)]))
    match = np.flatnonzero(length)
    green, far = data[at].astype(np.int64), np.zeros(len(match), np.int64)
    symbol, extra, n_extra = prefix_of(length[match])
    green[match] = 256 + symbol
    far, far_extra, n_far = prefix_of(distance[match] + 120)
    counts = np.bincount(tile * _GREENS + green, minlength=tiles * _GREENS).reshape(tiles, _GREENS)
    far_counts = np.bincount(tile[match] * _DISTANCES + far, minlength=tiles * _DISTANCES).reshape(tiles, _DISTANCES)
    greys = (counts[:, :256] > 0).sum(1)  # each byte of a tile is a literal once at least
    lengths, far_lengths = code_lengths(_two(counts)), code_lengths(_two(far_counts))  # a code has two symbols at least
    codes, far_codes = _codes(lengths), _codes(far_lengths)

    # entries of bits: for each tile its header, then one entry a literal and two a match
    head, head_n = _header(rows, lengths, far_lengths)
    first_n = lengths[tile, green]
    first = codes[tile, green]
    first[match] |= extra << first_n[match]
    first_n = first_n.copy()
    first_n[match] += n_extra
    second_n = far_lengths[tile[match], far]
    second = far_codes[tile[match], far] | far_extra << second_n
    second_n = second_n + n_far
    # a tile's entries stand together: its header's, then those of its symbols
    n_head = head.shape[1]
    is_match = length > 0
    begins = np.cumsum(is_match) - is_match + np.arange(len(at)) + n_head * (tile + 1)
    total = len(at) + len(match) + n_head * tiles
    value, wide = np.empty(total, np.uint64), np.empty(total, np.int64)
    value[begins], wide[begins] = first, first_n
    value[begins[match] + 1], wide[begins[match] + 1] = second, second_n
    per_tile = np.bincount(tile, minlength=tiles) + np.bincount(tile[match], minlength=tiles) + n_head
    opens = np.cumsum(per_tile) - per_tile
    heads = opens[:, None] + np.arange(n_head)
    value[heads], wide[heads] = head, head_n
    of = np.repeat(np.arange(tiles), per_tile)
    bits = np.add.reduceat(wide, opens)
    words = bits // 32 + 2
    start = np.cumsum(words) - words
    before = np.cumsum(bits) - bits
    bit = np.cumsum(wide) - wide - before[of] + 32 * start[of]
    out = np.zeros(int(words.sum()) + 1, np.uint32)
    word = bit >> 5
    shifted = value << (bit & 31).astype(np.uint64)
    firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[firsts]] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), firsts).astype(np.uint32)  # the bits of neighbours lie apart, so sums are unions
    out[word[firsts] + 1] += np.add.reduceat(shifted >> np.uint64(32), firsts).astype(np.uint32)
    whole, files = out.tobytes(), []
    for a, k in zip((4 * start).tolist(), ((bits + 7) // 8).tolist()):
        files.append(_file(whole[a : a + k]))
    large = bits - head_n.sum(1) >= LONGER
    for i, mode, cache in promising(data, rows, greys):
        if large[i]:
            files[i] = min([files[i], *smaller_form(data[ends[i] - size[i] : ends[i]], mode, cache)], key=len)
    return files


def _file(stream: bytes) -> bytes:
    k, pad = len(stream), len(stream) & 1
    return b"RIFF" + struct.pack("<I", 12 + k + pad) + b"WEBPVP8L" + struct.pack("<I", k) + stream + b"\0" * pad


# ---- forms of a tile that few texts need: predictor, palette, colour cache

#: Predictors that are tried, each for a whole tile; the bits of caches that are tried; the rows of a tile that tell which; the most greys of a packed palette.
MODES, CACHES, TOLD_BY, PACKED = (1, 2, 4, 7, 11, 12), (1, 4), 2, 16
#: Bits that another form has to save by the rows that tell (its header is longer).
WORTH = 100
#: About the bits by which another header is longer; a tile whose symbols take fewer stays as it is.
LONGER = 400
_N_LOG_N = np.arange(TOLD_BY * WIDTH + 1) * np.log2(np.maximum(np.arange(TOLD_BY * WIDTH + 1), 1))


def _guess(mode: int, left, top, corner):
    """PREDICT for grey pixels."""
    if mode == 7:
        return (left + top) >> 1
    if mode == 11:
        return np.where(abs(top - corner) < abs(left - corner), left, top)
    return {1: left, 2: top, 4: corner}[mode] if mode != 12 else np.clip(left + top - corner, 0, 255)


def residuals(image: np.ndarray, mode: int) -> np.ndarray:
    """What a predictor leaves of grey pixels (height, width)."""
    v = image.astype(np.int16)
    p = np.zeros_like(v)
    p[0, 1:], p[1:, 0] = v[0, :-1], v[:-1, 0]
    p[1:, 1:] = _guess(mode, v[1:, :-1], v[:-1, 1:], v[:-1, :-1])
    return (v - p).astype(np.uint8)


def slots(cache: int, alpha: int) -> np.ndarray:
    """The place of each green in a colour cache of so many bits."""
    colour = (np.int64(alpha) << 24) + (np.arange(256) << 8)
    return ((HASH * colour & 0xFFFFFFFF) >> (32 - cache)).astype(np.int64)


def cache_hits(data: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether the last byte before with the same slot is the same byte."""
    order = np.argsort(slot, kind="stable")
    by, byte = slot[order], data[order]
    hit = np.zeros(len(data), bool)
    hit[order[1:]] = (by[1:] == by[:-1]) & (byte[1:] == byte[:-1])
    return hit


def _information(tile: np.ndarray, symbol: np.ndarray, tiles: int, symbols: int = 256) -> np.ndarray:
    """Bits of each tile's symbols by their frequencies."""
    c = np.bincount(tile * symbols + symbol, minlength=tiles * symbols).reshape(tiles, symbols)
    return _N_LOG_N.take(c.sum(1)) - _N_LOG_N.take(c).sum(1)


def promising(data: np.ndarray, rows: np.ndarray, greys: np.ndarray) -> list[tuple[int, int, int]]:
    """(tile, predictor or 0, bits of a colour cache or 0) of the tiles for which another form may pay; 0 and 0 where only a palette may."""
    tiles, first = len(rows), np.cumsum(rows) - rows
    told = np.unique((first[:, None] + rows[:, None] * (2 * np.arange(TOLD_BY) + 1) // (2 * TOLD_BY)).ravel())
    of = np.searchsorted(first, told, "right") - 1
    image = data.reshape(-1, WIDTH).astype(np.int16)
    own = image[told][:, 1:]
    left, tile = image[told][:, :-1], np.repeat(of, WIDTH - 1)
    inner = (told > first[of])[:, None]
    above = image[np.maximum(told - 1, 0)]
    top, corner = np.where(inner, above[:, 1:], left), np.where(inner, above[:, :-1], left)
    part = np.bincount(of, minlength=tiles) / rows
    plain = _information(tile, own.ravel(), tiles)
    best, mode = plain - WORTH * part, np.zeros(tiles, np.int64)
    for m in MODES:
        bits = _information(tile, (own - np.where(inner, _guess(m, left, top, corner), left)).astype(np.uint8).ravel(), tiles)
        mode, best = np.where(bits < best, m, mode), np.minimum(bits, best)
    best, cache = plain - WORTH * part, np.zeros(tiles, np.int64)
    flat = own.astype(np.uint8).ravel()
    for b in CACHES:
        slot = slots(b, 255)[flat]
        key = (tile << b) + slot
        hit = cache_hits(flat, key.astype(np.uint16) if tiles << b < 65536 else key)
        bits = _information(tile, np.where(hit, 256 + slot, flat), tiles, 256 + (1 << b))
        cache, best = np.where(bits < best, b, cache), np.minimum(bits, best)
    some = np.flatnonzero((greys <= PACKED) | (mode > 0) | (cache > 0))
    return list(zip(some.tolist(), mode[some].tolist(), cache[some].tolist()))


def smaller_form(data: np.ndarray, mode: int, cache: int) -> list[bytes]:
    """WebP files of one tile with the predictor, with the colour cache and, of at most PACKED greys, with a palette."""
    image, out = data.reshape(-1, WIDTH), []
    front = [*_bits_of(0x2F, 8), *_bits_of(WIDTH - 1, 14), *_bits_of(len(image) - 1, 14), 0, 0, 0, 0, 1, *_bits_of(SUBTRACT_GREEN, 2)]
    one = _one_symbol(0)
    if mode:  # one block holds the tile
        modes = [0, *_one_symbol(mode), *one, *one, *_one_symbol(255), *one]
        out.append(_stream([*front, 1, *_bits_of(PREDICTOR, 2), *_bits_of(7, 3), *modes, 0], residuals(image, mode).ravel(), 0, 0))
    if cache:
        out.append(_stream([*front, 0], data, 255, cache))
    colours = np.unique(data)
    if len(colours) <= PACKED:
        index = np.searchsorted(colours, image).astype(np.uint8)
        bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        each = 8 >> bits
        packed = sum(index[:, i :: 1 << bits] << np.uint8(each * i) for i in range(1 << bits))
        steps = np.diff(colours, prepend=0).astype(np.int64)  # alpha steps from 255 by 0, by a code of two symbols
        lengths = code_lengths(_two(np.bincount(steps, minlength=_GREENS)[None]))
        alpha = np.r_[1, np.zeros(len(steps) - 1, np.int64)]
        own = _codes(lengths)[0, steps] | alpha << lengths[0, steps]
        head = _ints([*front, 1, *_bits_of(PALETTE, 2), *_bits_of(len(colours) - 1, 8), 0])
        tail = _ints([*one, *one, 1, 1, 1, *_bits_of(0, 8), *_bits_of(255, 8), *one])
        head = [np.concatenate(x) for x in zip(head, _normal(lengths[0]), tail, (own, lengths[0, steps] + 1), _ints([0]))]
        out.append(_stream(head, packed.ravel(), 255, 0))
    return [_file(x) for x in out]


def _ints(bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(bits, np.int64), np.ones(len(bits), np.int64)


def _two(counts: np.ndarray) -> np.ndarray:
    """Counts of which two at least are above 0 in each row."""
    few = (counts > 0).sum(1) < 2
    counts[few, 0] += 1
    counts[few, 1] += 1
    return counts


def _normal(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries that write a normal code."""
    table = np.array([_LENGTH_CODE.get(s, (0, 0)) for s in range(LONGEST + 1)])
    return tuple(np.concatenate(x) for x in zip(_ints(_normal_code()), (table[lengths, 0], table[lengths, 1])))


def _stream(head, green: np.ndarray, alpha: int, cache: int) -> bytes:
    """A VP8L stream: entries up to the transforms' end (or their bits), then the pixels (alpha, 0, green, 0) under a colour cache of so many bits."""
    n = len(green)
    at, length, far = _tokens(green, np.zeros(n, np.int32), np.full(n, n, np.int32))
    symbol, literal = green[at].astype(np.int64), length == 0
    if cache:
        slot = slots(cache, alpha)[green]
        hit = literal & cache_hits(green, slot)[at]
        symbol[hit] = _GREENS + slot[at[hit]]
    match = np.flatnonzero(~literal)
    kind, extra, n_extra = prefix_of(length[match])
    symbol[match] = 256 + kind
    far, far_extra, n_far = prefix_of(far[match] + 120)
    counts = np.bincount(symbol, minlength=_GREENS + (1 << cache if cache else 0))[None]
    far_counts = np.bincount(far, minlength=_DISTANCES)[None]
    lengths, far_lengths = code_lengths(_two(counts))[0], code_lengths(_two(far_counts))[0]
    codes, far_codes = _codes(lengths[None])[0], _codes(far_lengths[None])[0]
    value, wide = np.zeros((len(at), 2), np.int64), np.zeros((len(at), 2), np.int64)
    value[:, 0], wide[:, 0] = codes[symbol], lengths[symbol]
    value[match, 0] |= extra << wide[match, 0]
    wide[match, 0] += n_extra
    value[match, 1], wide[match, 1] = far_codes[far] | far_extra << far_lengths[far], far_lengths[far] + n_far
    one = _one_symbol(0)
    parts = [
        _ints(head) if isinstance(head, list) and isinstance(head[0], int) else head, _ints([1, *_bits_of(cache, 4), 0] if cache else [0, 0]), _normal(lengths), _ints([*one, *one, *_one_symbol(alpha)]), _normal(far_lengths),
        (value.ravel(), wide.ravel()),
    ]
    value, wide = (np.concatenate(x) for x in zip(*parts))
    start = np.cumsum(wide) - wide
    bits = np.repeat(value, wide) >> (np.arange(int(wide.sum())) - np.repeat(start, wide)) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _packed(bits: list[int]) -> list[tuple[int, int]]:
    """Entries of at most 24 bits."""
    return [(sum(b << i for i, b in enumerate(bits[a : a + 24])), len(bits[a : a + 24])) for a in range(0, len(bits), 24)]


def _header(rows: np.ndarray, lengths: np.ndarray, far_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and bits of the entries of the tiles' headers, a row a tile."""
    tiles = len(rows)
    table = np.zeros((LONGEST + 1, 2), np.int64)
    for s, (code, n) in _LENGTH_CODE.items():
        table[s] = code, n
    columns = []
    for part in ([*_FRONT[:_HEIGHT_AT]], None, [*_FRONT[_HEIGHT_AT + 14 :]], lengths, _MIDDLE, far_lengths):
        if part is None:
            columns.append((rows[:, None] - 1, np.full((tiles, 1), 14)))
        elif isinstance(part, list):
            entries = np.array(_packed(part), np.int64)
            columns.append((np.broadcast_to(entries[:, 0], (tiles, len(entries))), np.broadcast_to(entries[:, 1], (tiles, len(entries)))))
        else:
            columns.append((table[part, 0], table[part, 1]))
    value, n = (np.concatenate([c[i] for c in columns], 1) for i in (0, 1))
    return value, n


def split_files(stored: bytes) -> list[bytes]:
    """The WebP files that stand one after another."""
    out, at = [], 0
    while at < len(stored):
        n = 8 + struct.unpack("<I", stored[at + 4 : at + 8])[0]
        out.append(stored[at : at + n])
        at += n
    return out


def decode_tiles(files: list[bytes], most_lanes: int = 4096) -> list[bytes]:
    """Bytes of the pixels (grey: the green ones) of each file; what the writer has written is read side by side."""
    out: list = [None] * len(files)
    streams = [payload(f) for f in files]
    order = sorted(range(len(files)), key=lambda i: -len(streams[i]))  # long ones together, so that few lanes run idle
    for a in range(0, len(order), most_lanes):
        some = order[a : a + most_lanes]
        for i, tile in zip(some, _read([streams[i] for i in some])):
            out[i] = decode(files[i])[..., 1].tobytes() if tile is None else tile
    return out


def _read(streams: list[bytes]) -> list[bytes | None]:
    words = np.array([len(s) // 4 + 3 for s in streams])
    start = 32 * (np.cumsum(words) - words)
    buffer = np.frombuffer(b"".join(s.ljust(4 * w, b"\0") for s, w in zip(streams, words.tolist())), "<u4")
    pairs = buffer.astype(np.uint64)
    pairs = np.r_[pairs, np.zeros(2, np.uint64)]
    pairs = pairs[:-1] | pairs[1:] << np.uint64(32)
    end = start + 8 * np.array([len(s) for s in streams])

    def peek(p: np.ndarray) -> np.ndarray:
        """At least 32 bits from each place."""
        return pairs.take(p >> 5, mode="clip") >> (p & 31).view(np.uint64)

    def same(p: np.ndarray, bits: list[int], skip: range = range(0)) -> np.ndarray:
        ok = np.ones(len(p), bool)
        for a in range(0, len(bits), 24):
            part = bits[a : a + 24]
            mask = sum(1 << i for i in range(len(part)) if a + i not in skip)
            ok &= (peek(p + a) & np.uint64(mask)) == np.uint64(sum(b << i for i, b in enumerate(part)) & mask)
        return ok

    p = start.copy()
    ok = same(p, _FRONT, range(_HEIGHT_AT, _HEIGHT_AT + 14))
    rows = (peek(p + _HEIGHT_AT) & np.uint64((1 << 14) - 1)).astype(np.int64) + 1
    p += len(_FRONT)
    lengths, p = _read_lengths(peek, p, _GREENS)
    ok &= same(p, _MIDDLE)
    p += len(_MIDDLE)
    far_lengths, p = _read_lengths(peek, p, _DISTANCES)
    for n in (lengths, far_lengths):
        ok &= np.where(n > 0, 1 << np.maximum(LONGEST - n, 0), 0).sum(1) == 1 << LONGEST
    out: list = [None] * len(streams)
    some = np.flatnonzero(ok & (p <= end))
    if len(some):
        for i, tile in zip(some.tolist(), _read_symbols(peek, p[some], end[some], rows[some] * WIDTH, lengths[some], far_lengths[some])):
            out[i] = tile
    return out


def _read_lengths(peek, p: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths (tile, symbol) written under LENGTH_BITS from each place, and the places behind them."""
    table = np.zeros((32, 2), np.int64)
    for s, (code, n) in _LENGTH_CODE.items():
        table[[x for x in range(32) if x & ((1 << n) - 1) == code]] = s, n
    out = np.empty((symbols, len(p)), np.int64)
    for s in range(symbols):
        found = table[(peek(p) & np.uint64(31)).astype(np.int64)]
        out[s] = found[:, 0]
        p = p + found[:, 1]
    return np.ascontiguousarray(out.T), p


def _tables(lengths: np.ndarray) -> np.ndarray:
    """(tile, next LONGEST bits) -> symbol * 16 + bits, flat."""
    key = np.where(lengths > 0, lengths, LONGEST + 1)
    order = np.argsort(key, axis=1, kind="stable")
    ranked = np.take_along_axis(key, order, 1)
    share = np.where(ranked <= LONGEST, 1 << np.maximum(LONGEST - ranked, 0), 0)
    flat = np.repeat((order * 16 + ranked).ravel(), share.ravel()).astype(np.int32)  # complete codes fill each row
    return flat.reshape(len(lengths), 1 << LONGEST)[:, _REVERSED].ravel()


#: Of each prefix symbol: bits that follow, and the least value.
_EXTRA = np.array([0 if s < 4 else (s - 2) >> 1 for s in range(_DISTANCES)])
_BASE = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(_DISTANCES)])
_EXTRA_MASK = ((1 << _EXTRA) - 1).astype(np.uint64)


def _read_symbols(peek, start: np.ndarray, end: np.ndarray, pixels: np.ndarray, lengths: np.ndarray, far_lengths: np.ndarray) -> list[bytes]:
    """Bytes of tiles from their first symbols on, one symbol of every tile a step; then all back-references at once."""
    greens, fars = _tables(lengths), _tables(far_lengths)
    mask, copies = np.uint64((1 << LONGEST) - 1), 256 * 16
    lane, p, left, limit = np.arange(len(start)), start.copy(), pixels.astype(np.int64), end
    row = lane << LONGEST
    lanes, symbols, matches = [], [], []  # of each step; matches: (places among all symbols, counts, distances)
    total = 0
    while len(lane):
        x = peek(p)
        found = greens.take(row + (x & mask).view(np.int64))
        used = found & 15
        p += used
        left -= 1
        m = np.flatnonzero(found >= copies)
        if len(m):
            s = (found[m] >> 4) - 256
            bits = x[m] >> used[m].astype(np.uint64)
            count = _BASE.take(s) + (bits & _EXTRA_MASK.take(s)).view(np.int64)
            q = p[m] + _EXTRA.take(s)
            x = peek(q)
            far = fars.take(row[m] + (x & mask).view(np.int64))
            used = far & 15
            s = far >> 4
            d = _BASE.take(s) + ((x >> used.astype(np.uint64)) & _EXTRA_MASK.take(s)).view(np.int64)
            p[m] = q + used + _EXTRA.take(s)
            left[m] -= count - 1
            matches.append((total + m, count, d))
        lanes.append(lane)
        symbols.append(found)
        total += len(lane)
        if left.min() <= 0:
            if left.min() < 0 or (p > limit).any():
                raise ValueError("the image ends early")
            open_ = left > 0
            lane, p, left, limit = lane[open_], p[open_], left[open_], limit[open_]
            row = lane << LONGEST
    lane, symbol = np.concatenate(lanes), np.concatenate(symbols)
    lanes = symbols = None
    count, far = np.ones(total, np.int32), np.zeros(total, np.int32)
    if matches:
        at, n, d = (np.concatenate(c) for c in zip(*matches))
        near = d <= 120
        if near.any():  # the writer makes none of these
            d[near] = [max(1, NEAR[v - 1][0] + NEAR[v - 1][1] * WIDTH) for v in d[near]]
            d[~near] -= 120
        else:
            d -= 120
        count[at], far[at] = n, d
    by = np.argsort(lane.astype(np.int16), kind="stable")  # no more lanes than that
    symbol, count, far = (symbol[by] >> 4).astype(np.uint8), count[by], far[by]
    source = np.arange(int(count.sum()), dtype=np.int32)
    value = np.repeat(symbol, count)
    distance = np.repeat(far, count)
    todo = np.flatnonzero(distance).astype(np.int32)
    source[todo] -= distance[todo]
    begins = np.repeat((np.cumsum(pixels) - pixels).astype(np.int32), pixels)
    if (source < begins).any():
        raise ValueError("a back-reference leaves the image")
    here = source[todo]
    while len(todo):  # halves the way to a literal each time
        nearer = source[here]
        moved = nearer != here
        todo, here = todo[moved], nearer[moved]
        source[todo] = here
    value = value[source].tobytes()
    ends = np.cumsum(pixels).tolist()
    return [value[e - k : e] for e, k in zip(ends, pixels.tolist())]
