"""Baseline JPEG in numpy: marker parsing, Huffman decoding of many scans side by side, and a writer of coefficients.

Decoding runs over lanes. A lane is the data between two restart markers (or a
whole scan), and all lanes of a batch of images advance one Huffman symbol a
step, so the work per step is a few array operations however many images there
are. Coefficients stay in zigzag order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Lanes that advance together; bounds the memory of a step.
LANES = 1 << 14


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) by symbol for the canonical Huffman code with these bits for each symbol."""
    codes, bits, code, last = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=np.int64), 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        codes[symbol], bits[symbol], last = code, n, n
        code += 1
    if code > (1 << last) - 1:
        raise ValueError("the code uses its all-ones word")
    return codes, bits


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(n == i for n in lengths.values()) for i in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + bytes(order))


def _segment(marker: int, body: bytes) -> bytes:
    return b"\xff" + bytes([marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _skewed(order: list[int], rest: list[int], rest_bits: int) -> dict[int, int]:
    """1, 2, 3, ... bits for the symbols of ``order``, the same number for all others."""
    return {s: i + 1 for i, s in enumerate(order)} | {s: rest_bits for s in rest}


#: Codes of the writer: short for the sizes of letters as coefficients (6 and 7 bits), long for the rest.
DC_BITS = _skewed([7, 6, 5, 8], [0, 1, 2, 3, 4, 9, 10, 11], 8)
AC_BITS = _skewed([0x07, 0x06, 0x05, 0x08, 0x00, 0x04, 0xF0], [r << 4 | s for r in range(16) for s in range(1, 11) if r << 4 | s not in (7, 6, 5, 8, 4)], 15)


def entropy_code(blocks: np.ndarray, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code each of ``blocks[n, 64]`` (uint8 coefficients) as a restart interval of its own.

    Returns the bytes, each interval followed by the marker RST ``restart % 8``,
    and where each interval ends, its marker included.
    """
    n = len(blocks)
    (dc_code, dc_bits), (ac_code, ac_bits) = canonical(DC_BITS), canonical(AC_BITS)
    size = np.zeros(256, dtype=np.int64)
    size[1:] = np.floor(np.log2(np.arange(1, 256))).astype(np.int64) + 1
    values = blocks.astype(np.uint64)
    sizes = size[blocks]
    # One cell a coefficient, one for the end of the block, and one that fills the last byte with ones.
    code, bits = np.zeros((n, 66), dtype=np.uint64), np.zeros((n, 66), dtype=np.int64)
    code[:, 0] = dc_code[sizes[:, 0]] << sizes[:, 0].astype(np.uint64) | values[:, 0]
    bits[:, 0] = dc_bits[sizes[:, 0]] + sizes[:, 0]
    set_at = np.where(blocks > 0, np.arange(64), 0)
    set_at[:, 0] = 0
    last = np.maximum.accumulate(set_at, axis=1)
    run = np.arange(1, 64) - last[:, :-1] - 1
    long, symbol = run >> 4, (run & 15) << 4 | sizes[:, 1:]
    here = blocks[:, 1:] > 0
    code[:, 1:64] = np.where(here, ac_code[symbol] << sizes[:, 1:].astype(np.uint64) | values[:, 1:], 0)
    bits[:, 1:64] = np.where(here, ac_bits[symbol] + sizes[:, 1:], 0)
    for zeros in np.flatnonzero((long * here).any(axis=0)):
        # Runs of 16 zeros go in front of the coefficient's own code; at most three, all in one cell.
        for _ in range(3):
            more = here[:, zeros] & (long[:, zeros] > 0)
            code[:, zeros + 1] |= np.where(more, ac_code[0xF0] << bits[:, zeros + 1].astype(np.uint64), 0)
            bits[:, zeros + 1] += np.where(more, ac_bits[0xF0], 0)
            long[:, zeros] -= 1
    short = last[:, 63] < 63
    code[:, 64], bits[:, 64] = np.where(short, ac_code[0], 0), np.where(short, ac_bits[0], 0)
    bits[:, 65] = -bits.sum(axis=1) % 8
    code[:, 65] = (np.uint64(1) << bits[:, 65].astype(np.uint64)) - np.uint64(1)
    size_of = bits.sum(axis=1) // 8
    end = np.cumsum(bits.reshape(-1))
    start = end - bits.reshape(-1)
    full = np.flatnonzero(bits.reshape(-1))
    start, wide, code = start[full], bits.reshape(-1)[full], code.reshape(-1)[full]
    words = np.zeros((int(end[-1]) >> 6) + 2, dtype=np.uint64)
    word, room = start >> 6, 64 - (start & 63) - wide
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    plain = words.astype(">u8").view(np.uint8)[: int(size_of.sum())]
    stuffed = plain == 0xFF
    lane = np.repeat(np.arange(n), size_of)
    at = np.arange(len(plain)) + np.cumsum(stuffed) - stuffed + 2 * lane
    out = np.zeros(len(plain) + int(stuffed.sum()) + 2 * n, dtype=np.uint8)
    out[at] = plain
    ends = at[np.cumsum(size_of) - 1] + 1 + stuffed[np.cumsum(size_of) - 1] + 2
    out[ends - 2], out[ends - 1] = 0xFF, 0xD0 + restart % 8
    return out, ends


def image(width: int, height: int, scan: bytes, comment: bytes) -> bytes:
    """A grey baseline image of 8 x 8 blocks whose ``scan`` has a restart interval for each block; all quantisers are 1."""
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    head = b"\xff\xd8" + _segment(0xFE, comment) + _segment(0xDB, bytes(1) + b"\1" * 64) + _segment(0xC0, frame)
    head += _dht(0, DC_BITS) + _dht(0x10, AC_BITS) + _segment(0xDD, (1).to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    return head + scan + b"\xff\xd9"


@dataclass
class Component:
    id: int
    across: int
    down: int
    quantiser: int
    dc: bytes = b""
    ac: bytes = b""


@dataclass
class Frame:
    """What an image's markers say, and its scan."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    interval: int = 0
    scan: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint8))

    @property
    def units(self) -> tuple[int, int]:
        """Minimum coded units across and down."""
        h, v = (1, 1) if len(self.components) == 1 else (max(c.across for c in self.components), max(c.down for c in self.components))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def order(self) -> list[int]:
        """The component of each block of a unit."""
        if len(self.components) == 1:
            return [0]
        return [i for i, c in enumerate(self.components) for _ in range(c.across * c.down)]


def parse(data: bytes) -> Frame:
    """Read the markers of a baseline image up to the end of its scan; ValueError for anything else."""
    out, at, tables = Frame(), 2, {}
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xFF:
            at += 1
            continue
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            out.comments.append(body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quantisers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif marker == 0xDD:
            out.interval = int.from_bytes(body, "big")
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("not 8 bits a sample")
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("not a baseline image")
        elif marker == 0xDA:
            if body[0] != len(out.components):
                raise ValueError("several scans")
            for c, i in zip(out.components, range(1, 1 + 2 * body[0], 2)):
                c.dc, c.ac = tables[body[i + 1] >> 4], tables[0x10 | body[i + 1] & 15]
            rest = np.frombuffer(data, dtype=np.uint8, offset=at)
            mark = np.flatnonzero(rest[:-1] == 0xFF)
            after = rest[mark + 1]
            ends = mark[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
            out.scan = rest[: ends[0] if len(ends) else len(rest)]
            return out
    raise ValueError("no scan")


def lookup(table: bytes) -> np.ndarray:
    """bits << 8 | symbol for each 16-bit window that a code begins; 0 where none does."""
    out, at, code, symbols = np.zeros(1 << 16, dtype=np.int64), 0, 0, table[16:]
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            low = code << (16 - n)
            out[low : low + (1 << (16 - n))] = n << 8 | symbols[at]
            at, code = at + 1, code + 1
        code <<= 1
    return out


def _lanes(frame: Frame) -> tuple[np.ndarray, np.ndarray]:
    """The scan without markers and stuffing, and where each restart interval begins in it."""
    scan = frame.scan
    mark = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[mark + 1]
    restarts = mark[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(scan), dtype=bool)
    keep[mark[after == 0] + 1] = False
    keep[restarts] = keep[restarts + 1] = False
    before = np.cumsum(keep)
    return scan[keep], np.concatenate(([0], before[restarts]))


def decode(frames: list[Frame]) -> list[np.ndarray]:
    """[blocks, 64]: the quantised coefficients of each image in the order of its scan, zigzag order within a block."""
    tables: dict[bytes, int] = {}
    streams, begins, lane_image, lane_first, lane_blocks, sizes = [], [], [], [], [], []
    at = 0
    for i, f in enumerate(frames):
        units, order = f.units[0] * f.units[1], f.order
        data, starts = _lanes(f)
        step = f.interval or units
        lanes = -(-units // step)
        if len(starts) < lanes:
            raise ValueError("restart intervals are missing")
        first = np.arange(lanes) * step
        streams.append(data)
        begins.append(starts[:lanes] + at)
        lane_image.append(np.full(lanes, i))
        lane_first.append(first * len(order))
        lane_blocks.append((np.minimum(units, first + step) - first) * len(order))
        sizes.append(units * len(order))
        at += len(data)
        for c in f.components:
            tables.setdefault(c.dc, len(tables))
            tables.setdefault(c.ac, len(tables))
    base = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros((base[-1], 64), dtype=np.int16)
    stream = np.concatenate([*streams, np.zeros(8, np.uint8)])
    codes = np.concatenate([lookup(t) for t in tables])
    longest = max(len(f.order) for f in frames)
    pad = lambda x: x + [0] * (longest - len(x))
    part = np.array([pad(f.order) for f in frames])
    dc = np.array([pad([tables[f.components[c].dc] for c in f.order]) for f in frames])
    ac = np.array([pad([tables[f.components[c].ac] for c in f.order]) for f in frames])
    per = np.array([len(f.order) for f in frames])
    image_of, first, blocks, begin = (np.concatenate(x) for x in (lane_image, lane_first, lane_blocks, begins))
    ends = np.append(begin[1:], at)
    for a in range(0, len(begin), LANES):
        s = slice(a, a + LANES)
        data = stream[begin[a] : ends[min(a + LANES, len(ends)) - 1] + 8]
        _decode_lanes(data, (begin[s] - begin[a]) * 8, (ends[s] - begin[a]) * 8, base[image_of[s]] + first[s], blocks[s], per[image_of[s]], part[image_of[s]], dc[image_of[s]], ac[image_of[s]], codes, out)
    return [out[i:j] for i, j in zip(base, base[1:])]


def _decode_lanes(data, bit, end, target, left, per, part, dc, ac, codes, out) -> None:
    """Advance all lanes by one symbol a step until each has its blocks."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(data)
    # Five bytes from each byte on: a code of 16 bits and a value of up to 16 at any of 8 bit offsets.
    window = padded[:n] << np.uint64(32) | padded[1 : n + 1] << np.uint64(24) | padded[2 : n + 2] << np.uint64(16) | padded[3 : n + 3] << np.uint64(8) | padded[4 : n + 4]
    window = window.astype(np.int64)
    flat, lane = out.reshape(-1), np.arange(len(bit))
    bit, left, k, nth = bit.copy(), left.copy(), np.zeros(len(bit), dtype=np.int64), np.zeros(len(bit), dtype=np.int64)
    place, low = target * 64, (1 << 40) - 1
    before = np.zeros((len(bit), part.max() + 1), dtype=np.int64)
    dc_now, ac_now = dc[:, 0] << 16, ac[:, 0] << 16
    single = part.shape[1] == 1
    while len(bit):
        seen = (window[bit >> 3] << (bit & 7)) & low
        opens = k == 0
        found = codes[np.where(opens, dc_now, ac_now) + (seen >> 24)]
        used, symbol = found >> 8, found & 255
        size = np.where(opens, symbol, symbol & 15)
        value = (seen >> (40 - used - size)) & ((1 << size) - 1)
        value = np.where((value << 1) >> size == 0, value - (1 << size) + 1, value)
        bit = bit + used + size
        if not used.all() or (bit > end).any():
            raise ValueError("a scan holds no valid code")
        if opens.any():
            own = np.flatnonzero(opens)
            c = part[own, nth[own]] if not single else np.zeros(len(own), dtype=np.int64)
            before[own, c] += value[own]
            flat[place[own]] = before[own, c]
        skip = np.where(opens, 0, symbol >> 4)
        at = k + skip
        writes = np.flatnonzero(~opens & (size > 0) & (at < 64))
        flat[place[writes] + at[writes]] = value[writes]
        k = np.where(~opens & (symbol == 0), 64, at + 1)
        full = k >= 64
        if full.any():
            own = np.flatnonzero(full)
            k[own] = 0
            left[own] -= 1
            place[own] += 64
            if not single:
                nth[own] = (nth[own] + 1) % per[own]
                dc_now, ac_now = (t[np.arange(len(nth)), nth] << 16 for t in (dc, ac))
            if (left[own] == 0).any():
                live = left > 0
                bit, end, left, k, nth, place, per, part, dc, ac, before, dc_now, ac_now = (x[live] for x in (bit, end, left, k, nth, place, per, part, dc, ac, before, dc_now, ac_now))


def thumbnail(frame: Frame, coefficients: np.ndarray) -> np.ndarray:
    """The luminance image at an eighth of its size, 0 to 255, from the DC coefficients alone."""
    y = frame.components[0]
    across, down = frame.units
    h, v = (1, 1) if len(frame.components) == 1 else (y.across, y.down)
    own = np.flatnonzero(np.array(frame.order) == 0)
    dc = coefficients[:, 0].reshape(across * down, -1)[:, own].astype(np.int64)
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    grey = np.clip(np.round(grid * int(frame.quantisers[y.quantiser][0]) / 8 + 128), 0, 255).astype(np.uint8)
    return grey[: -(-frame.height // 8), : -(-frame.width // 8)]


def chunks(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of consecutive items whose sizes sum to at most ``most``, or of one larger item."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))
