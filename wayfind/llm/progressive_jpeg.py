"""Progressive JPEG (spectral selection and successive approximation) for many images at once.

Entropy-coded data is read in lockstep: every restart interval of every image in a batch
is a lane, and one numpy step reads one symbol in all lanes. Scans accumulate into
coefficient arrays; an integer-valued inverse transform makes samples, chroma is
repeated to full resolution, and pixels are RGB.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: the zigzag order of an 8 by 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))

#: (components, first and last coefficient, high and low bit) of each scan that is written.
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 1), ((1,), 1, 5, 0, 1), ((2,), 1, 5, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0),
    ((0,), 1, 5, 1, 0), ((1,), 1, 5, 1, 0), ((2,), 1, 5, 1, 0),
    ((0,), 6, 63, 0, 0), ((1,), 6, 63, 0, 0), ((2,), 6, 63, 0, 0),
)
#: Blocks of a 16 by 16 unit: four of luma, one of each chroma.
SAMPLING = ((2, 2), (1, 1), (1, 1))

#: Code lengths of the symbols that text makes often; the others get LONG_CODE bits.
SHORT_CODES = {0x07: 2, 0x06: 3, 0x05: 3, 0x08: 4, 0x00: 4, 0x17: 5, 0x04: 5, 0x16: 6, 0x15: 6, 0x03: 6, 0x01: 7, 0x02: 7, 0x18: 7}
LONG_CODE = 12
AC_LENGTHS = {run * 16 + size: LONG_CODE for run in range(16) for size in range(11)} | SHORT_CODES
DC_LENGTHS = {size: 4 for size in range(12)}


def _canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as the file holds it, and each symbol's code and length."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(1 for s in order if lengths[s] == n) for n in range(1, 17))
    code, size, at, before = np.zeros(256, np.uint64), np.zeros(256, np.int64), 0, 0
    for s in order:
        at <<= lengths[s] - before
        code[s], size[s], before = at, lengths[s], lengths[s]
        at += 1
    return counts + bytes(order), code, size


DC_TABLE, DC_CODE, DC_SIZE = _canonical(DC_LENGTHS)
AC_TABLE, AC_CODE, AC_SIZE = _canonical(AC_LENGTHS)


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: 256 * code length + symbol; 0 where no code fits."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n * 256 + table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _bits_of(values: np.ndarray) -> np.ndarray:
    """The bit length of each magnitude."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64) * (values > 0)


def _magnitude(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Category and extra bits of signed values."""
    size = _bits_of(np.abs(values))
    return size, np.where(values < 0, values + (np.int64(1) << size) - 1, values).astype(np.uint64)


def _words() -> tuple[np.ndarray, np.ndarray]:
    """For run * 2048 + value + 1024: the symbol's code with the value's extra bits, and their number."""
    value = np.arange(-1024, 1024)
    size, extra = _magnitude(value)
    size = np.minimum(size, 10)
    symbol = np.arange(16)[:, None] * 16 + size
    return ((AC_CODE[symbol] << size.astype(np.uint64)) | extra).ravel(), (AC_SIZE[symbol] + size).ravel()


_AC_WORD, _AC_BITS = _words()


def _join(code: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: int, last: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of at most 25 bits, ordered by lane, as bytes with stuffing and restart markers; where each lane begins."""
    per_lane = np.bincount(lane, bits, lanes).astype(np.int64)
    length = (per_lane + 7) // 8
    begin = np.cumsum(length) - length
    ahead = np.cumsum(bits) - bits
    lane_first = np.cumsum(per_lane) - per_lane
    at = begin[lane] * 8 + ahead - lane_first[lane]
    total = int(length.sum())
    # the bits of a code lie in one or two words of 32; bits of different codes never overlap, so sums join them
    spread = code << (np.uint64(64) - bits.view(np.uint64) - (at & 31).view(np.uint64))
    words, at = total // 4 + 2, at >> 5
    out = np.bincount(at, spread >> np.uint64(32), words)
    out += np.bincount(at + 1, spread & np.uint64(0xFFFFFFFF), words)
    out = out.astype(">u4").view(np.uint8)
    body = out[:total]
    full = length > 0
    ends = (begin + length - 1)[full]
    body[ends] |= ((1 << (8 * length - per_lane)[full]) - 1).astype(np.uint8)
    grow = 1 + (body == 255).astype(np.int64)
    np.add.at(grow, ends, np.where(last[full], 0, 2))
    to = np.cumsum(grow) - grow
    made = np.zeros(int(grow.sum()), np.uint8)
    made[to] = body
    mark = ends[~last[full]]
    where = to[mark] + grow[mark] - 2
    made[where] = 255
    made[where + 1] = 0xD0 + number[full][~last[full]] % 8
    lane_begin = np.append(to, len(made))[np.minimum(begin, total)]
    return made, np.append(lane_begin, len(made))


def _dc_scan(dc: np.ndarray, low: int, refine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the first coefficients, (units, 6) in the order of a unit, each unit a lane."""
    units = len(dc)
    lane = np.repeat(np.arange(units), dc.shape[1])
    if refine:
        return ((dc >> low) & 1).ravel().astype(np.uint64), np.ones(dc.size, np.int64), lane
    value = dc >> low
    change = value.copy()
    change[:, 1:4] -= value[:, 0:3]  # the four luma blocks follow one another
    size, extra = _magnitude(change.ravel())
    return (DC_CODE[size] << size.astype(np.uint64)) | extra, DC_SIZE[size] + size, lane


def _ac_scan(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a band of coefficients, each block a lane."""
    value = np.where(band < 0, -(-band >> low), band >> low) if low else band
    flat = np.flatnonzero(value)
    width = band.shape[1]
    row = flat // width
    col = flat - row * width
    run = np.empty(len(row), np.int64)
    run[:1], run[1:] = col[:1], flat[1:] - flat[:-1] - 1
    new = np.flatnonzero(row[1:] != row[:-1]) + 1
    run[new] = col[new]
    pick = ((run & 15) << 11) + value.ravel()[flat] + 1024
    code, bits, lane = _AC_WORD[pick], _AC_BITS[pick], row
    per_row = np.bincount(row, minlength=len(band))
    after = np.cumsum(per_row)
    final = np.full(len(band), -1)
    final[row] = col
    short = np.flatnonzero(final < band.shape[1] - 1)
    skips = np.flatnonzero(run > 15)
    if len(skips) or len(short):
        times = run[skips] // 16
        at = np.concatenate([np.repeat(skips, times), after[short]])
        what = np.concatenate([np.full(int(times.sum()), 0xF0), np.zeros(len(short), np.int64)])
        whose = np.concatenate([np.repeat(row[skips], times), short])
        # a block's end comes before the next block's skips at the same place
        order = np.lexsort((whose, at))
        at, what, whose = at[order], what[order], whose[order]
        code, bits, lane = np.insert(code, at, AC_CODE[what]), np.insert(bits, at, AC_SIZE[what]), np.insert(lane, at, whose)
    return code, bits, lane


def _ac_refinement(band: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes that add one bit to a band of a few coefficients, each block a lane; two codes a block."""
    n = len(band)
    if band.shape[1] > 5:
        raise ValueError("bands of more than five coefficients are not refined by this writer")
    size = np.abs(band.astype(np.int64)) >> low
    bits, count = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    held, held_count, run = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def put(mask, code, length):
        bits[mask] = (bits[mask] << length.astype(np.uint64)) | code
        count[mask] += length

    for k in range(band.shape[1]):
        old, new = size[:, k] > 1, size[:, k] == 1
        held[old] = (held[old] << np.uint64(1)) | (size[old, k] & 1).astype(np.uint64)
        held_count[old] += 1
        symbol = run[new] * 16 + 1
        sign = (band[new, k] > 0).astype(np.uint64)
        put(new, (AC_CODE[symbol] << np.uint64(1)) | sign, AC_SIZE[symbol] + 1)
        put(new, held[new], held_count[new])
        held[new], held_count[new], run[new] = 0, 0, 0
        run[size[:, k] == 0] += 1
    left = (run > 0) | (held_count > 0)
    put(left, np.full(int(left.sum()), AC_CODE[0]), np.full(int(left.sum()), AC_SIZE[0]))
    put(left, held[left], held_count[left])
    low_bits = np.minimum(count, 24)
    code = np.stack([bits >> low_bits.astype(np.uint64), bits & ((np.uint64(1) << low_bits.astype(np.uint64)) - np.uint64(1))], axis=1).ravel()
    return code, np.stack([count - low_bits, low_bits], axis=1).ravel(), np.repeat(np.arange(n), 2)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


_TABLES = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\x00" + DC_TABLE) + _segment(0xC4, b"\x10" + AC_TABLE) + _segment(0xDD, b"\0\1")
_SOS = [_segment(0xDA, bytes([len(c)]) + b"".join(bytes([i + 1, 0]) for i in c) + bytes([a, z, h * 16 + low])) for c, a, z, h, low in SCRIPT]


def _units_of(luma: np.ndarray, wide: np.ndarray, units: np.ndarray) -> np.ndarray:
    """For each unit of all images the indices of its four luma blocks."""
    image = np.repeat(np.arange(len(units)), units)
    first = np.repeat(np.cumsum(units) - units, units)
    own = np.arange(int(units.sum())) - first
    w = wide[image]
    corner = 4 * first + (own // w) * 4 * w + (own % w) * 2
    return np.stack([corner, corner + 1, corner + 2 * w, corner + 2 * w + 1], axis=1)


def encode(blocks: list[np.ndarray], wide: np.ndarray, high: np.ndarray, notes: list[bytes]) -> list[bytes]:
    """Files of images of wide by high units, from the coefficients of all images by component.

    blocks: for luma and both chromas, (all blocks in raster order, 64 in zigzag order).
    """
    units = wide * high
    unit = _units_of(blocks[0], wide, units)
    parts = []
    for comps, first, last, up, low in SCRIPT:
        if first == 0:
            per_image = units
            dc = np.concatenate([blocks[0][:, 0].astype(np.int64)[unit], blocks[1][:, :1].astype(np.int64), blocks[2][:, :1].astype(np.int64)], axis=1)
            code, bits, lane = _dc_scan(dc, low, bool(up))
        else:
            per_image = units * (4 if comps[0] == 0 else 1)
            band = blocks[comps[0]][:, first : last + 1]
            code, bits, lane = (_ac_refinement if up else _ac_scan)(band, low)
        lanes = int(per_image.sum())
        ends = np.cumsum(per_image)
        last_lane = np.zeros(lanes, bool)
        last_lane[ends - 1] = True
        number = np.arange(lanes) - np.repeat(ends - per_image, per_image)
        data, begin = _join(code, bits, lane, lanes, last_lane, number)
        cuts = np.append(begin[ends - per_image], len(data)).tolist()
        parts.append((data.tobytes(), cuts))
    files = []
    for i in range(len(units)):
        frame = struct.pack(">BHHB", 8, int(high[i]) * 16, int(wide[i]) * 16, 3) + b"".join(bytes([c + 1, h * 16 + v, 0]) for c, (h, v) in enumerate(SAMPLING))
        scans = [x for sos, (data, cuts) in zip(_SOS, parts, strict=True) for x in (sos, data[cuts[i] : cuts[i + 1]])]
        files.append(b"".join([b"\xff\xd8", _segment(0xFE, notes[i]), _TABLES, _segment(0xC2, frame), *scans, b"\xff\xd9"]))
    return files


@dataclass
class _Image:
    """What the segments of one file say."""

    width: int = 0
    height: int = 0
    sampling: tuple = ()
    note: bytes = b""
    script: list = field(default_factory=list)  # (components, first, last, high, low, restart interval, tables)
    ranges: list = field(default_factory=list)
    quant: tuple = ()


def _parse(raw: bytes, base: int, markers: np.ndarray) -> _Image:
    """Read the segments of one file; markers: where in all files a marker ends entropy-coded data."""
    image, at, restart, tables, quants, comps = _Image(), 2, 0, {}, {}, []
    while True:
        kind = raw[at + 1]
        if kind == 0xD9:
            break
        size = (raw[at + 2] << 8) | raw[at + 3]
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xFE:
            image.note = body
        elif kind == 0xDD:
            restart = (body[0] << 8) | body[1]
        elif kind == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("only 8-bit quantisation tables are read")
                quants[body[0] & 15], body = body[1:65], body[65:]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif kind == 0xC2:
            image.height, image.width = struct.unpack(">HH", body[1:5])
            comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            image.sampling = tuple((h, v) for _, h, v, _ in comps)
        elif kind == 0xDA:
            n = body[0]
            chosen = tuple(next(k for k, c in enumerate(comps) if c[0] == body[1 + 2 * i]) for i in range(n))
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            use = tuple(tables.get(body[2 + 2 * i] >> 4 if first == 0 else 16 + (body[2 + 2 * i] & 15)) for i in range(n))
            image.script.append((chosen, first, last, bits >> 4, bits & 15, restart, use))
            end = int(markers[np.searchsorted(markers, base + at)])
            image.ranges.append((base + at, end))
            at = end - base
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("not a progressive Huffman file")
    image.quant = tuple(quants[c[3]] for c in comps)
    return image


class _Lanes:
    """Bit readers over all restart intervals of one scan in several images."""

    def __init__(self, buf: np.ndarray, ranges: np.ndarray):
        size = ranges[:, 1] - ranges[:, 0]
        ends = np.cumsum(size)
        data = buf[np.arange(int(ends[-1])) + np.repeat(ranges[:, 0] - (ends - size), size)]
        full = np.flatnonzero(data == 255)
        follow = data[np.minimum(full + 1, len(data) - 1)]
        keep = np.ones(len(data), bool)
        keep[(full + 1)[follow == 0]] = False
        marks = full[(follow >= 0xD0) & (follow <= 0xD7)]
        keep[marks] = False
        keep[marks + 1] = False
        begins = np.concatenate([ends - size, marks + 2])
        begins.sort(kind="stable")
        kept = np.concatenate([[0], np.cumsum(keep)])
        self.per_image = np.diff(np.searchsorted(begins, np.append(ends - size, len(data) + 1)))
        self.pos = kept[begins] * 8
        tight = np.concatenate([data[keep], np.zeros(16, np.uint8)]).astype(np.uint64)
        n = len(tight) - 8
        half = (tight[: n + 4] << np.uint64(24)) | (tight[1 : n + 5] << np.uint64(16)) | (tight[2 : n + 6] << np.uint64(8)) | tight[3 : n + 7]
        self.words = (half[:n] << np.uint64(32)) | half[4 : n + 4]

    def ahead(self, lanes: np.ndarray) -> np.ndarray:
        """The next bits of lanes, at the top of 64."""
        pos = self.pos[lanes]
        return self.words[pos >> 3] << (pos & 7).astype(np.uint64)

    def symbol(self, lanes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next symbol of lanes, the bits after it at the top of 64, and how many it took."""
        ahead = self.ahead(lanes)
        entry = table[(ahead >> np.uint64(48)).astype(np.int64)]
        used = entry >> 8
        return entry & 255, ahead << used.astype(np.uint64), used


def _top(word: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first count bits (0 to 16) as a number."""
    return ((word >> np.uint64(48)).astype(np.int64)) >> (16 - count)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


def _read_dc(reader: _Lanes, coef: list[np.ndarray], order, low: int, refine: bool, tables) -> None:
    """order: for each unit within a lane, (lanes that have it, [(component, block of each)])."""
    before = [np.zeros(len(reader.pos), np.int64) for _ in coef]
    for lanes, blocks in order:
        for comp, block in blocks:
            if refine:
                bit = (reader.ahead(lanes) >> np.uint64(63)).astype(np.int64)
                coef[comp][block, 0] |= (bit << low).astype(coef[comp].dtype)
                reader.pos[lanes] += 1
                continue
            size, rest, used = reader.symbol(lanes, tables[comp])
            before[comp][lanes] += _signed(_top(rest, size), size)
            coef[comp][block, 0] = before[comp][lanes] << low
            reader.pos[lanes] += used + size


def _read_ac(reader: _Lanes, coef: np.ndarray, order, first: int, last: int, low: int, table: np.ndarray) -> None:
    ended = np.zeros(len(reader.pos), np.int64)
    flat, words = coef.reshape(-1), reader.words
    for lanes, [(_, block)] in order:
        skip = ended[lanes] > 0
        if skip.any():
            ended[lanes[skip]] -= 1
            lanes, block = lanes[~skip], block[~skip]
        pos, stop, k = reader.pos[lanes], block * 64 + last, block * 64 + first
        while len(lanes):
            ahead = words[pos >> 3] << (pos & 7).view(np.uint64)
            entry = table[(ahead >> np.uint64(48)).view(np.int64)]
            used, run, size = entry >> 8, (entry >> 4) & 15, entry & 15
            end = (size == 0) & (run < 15)
            ends = end.any()
            take = np.where(end, run, size) if ends else size
            extra = ((ahead << used.view(np.uint64)) >> np.uint64(48)).view(np.int64) >> (16 - take)
            pos = pos + (used + take)
            k = k + run
            full = (1 << size) - 1
            value = (extra - full * (1 - (extra >> np.maximum(size - 1, 0)))) << low
            if ends or not size.all():
                put = size > 0
                flat[k[put]] = value[put]
            else:
                flat[k] = value
            k = k + 1
            over = k > stop
            if ends:
                over |= end
                ended[lanes[end]] = (1 << run[end]) + extra[end] - 1
            if over.any():
                reader.pos[lanes[over]] = pos[over]
                go = ~over
                lanes, stop, k, pos = lanes[go], stop[go], k[go], pos[go]


def _refine_ac(reader: _Lanes, coef: np.ndarray, order, first: int, last: int, low: int, table: np.ndarray) -> None:
    ended = np.zeros(len(reader.pos), np.int64)
    for lanes, [(_, block)] in order:
        pending, run, value = np.zeros(len(lanes), bool), np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        for k in range(first, last + 1):
            ask = np.flatnonzero(~pending & (ended[lanes] == 0))
            if len(ask):
                symbol, rest, used = reader.symbol(lanes[ask], table)
                r, s = symbol >> 4, symbol & 15
                end = (s == 0) & (r < 15)
                take = np.where(end, r, s)
                extra = _top(rest, take)
                reader.pos[lanes[ask]] += used + take
                ended[lanes[ask[end]]] = (1 << r[end]) + extra[end]
                go = ask[~end]
                pending[go], run[go] = True, r[~end]
                value[go] = np.where(s[~end] > 0, np.where(extra[~end] > 0, 1, -1), 0) << low
            now = coef[block, k].astype(np.int64)
            old = np.flatnonzero(now != 0)
            if len(old):
                bit = (reader.ahead(lanes[old]) >> np.uint64(63)).astype(np.int64)
                reader.pos[lanes[old]] += 1
                coef[block[old], k] += (np.sign(now[old]) * (bit << low)).astype(coef.dtype)
            zero = pending & (now == 0)
            put = zero & (run == 0)
            coef[block[put], k] = value[put]
            pending[put] = False
            run[zero & ~put] -= 1
        over = lanes[ended[lanes] > 0]
        ended[over] -= 1


@dataclass
class Decoded:
    """One image: its note, coefficients by component (blocks, 64 in zigzag order), and shape."""

    note: bytes
    coefficients: list[np.ndarray]
    width: int
    height: int
    sampling: tuple
    quant: tuple


def _ceil(a, b):
    return -(-a // b)


def _decode_alike(buf: np.ndarray, images: list[_Image]) -> list[Decoded]:
    """Images with one script, sampling and set of tables."""
    sampling, n = images[0].sampling, len(images)
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    width, height = np.array([i.width for i in images]), np.array([i.height for i in images])
    mw, mh = _ceil(width, 8 * hmax), _ceil(height, 8 * vmax)
    total = [mw * h * mh * v for h, v in sampling]
    base = [np.cumsum(t) - t for t in total]
    coef = [np.zeros((int(t.sum()), 64), np.int16) for t in total]
    tables: dict[bytes, np.ndarray] = {}
    for s, (comps, first, last, high, low, restart, used) in enumerate(images[0].script):
        reader = _Lanes(buf, np.array([i.ranges[s] for i in images]))
        image = np.repeat(np.arange(n), reader.per_image)
        lane_no = np.arange(len(image)) - np.repeat(np.cumsum(reader.per_image) - reader.per_image, reader.per_image)
        if len(comps) > 1:
            across, count = mw, mw * mh
        else:
            h, v = sampling[comps[0]]
            across = _ceil(_ceil(width * h, hmax), 8)
            count = across * _ceil(_ceil(height * v, vmax), 8)
        step = restart if restart else int(count.max())
        left = np.minimum(step, count[image] - lane_no * step)
        order = []
        for j in range(int(left.max()) if len(left) else 0):
            lanes = np.flatnonzero(left > j)
            im = image[lanes]
            at = lane_no[lanes] * step + j
            y, x = at // across[im], at % across[im]
            if len(comps) > 1:
                blocks = [(c, base[c][im] + (y * sampling[c][1] + dv) * mw[im] * sampling[c][0] + x * sampling[c][0] + dh) for c in comps for dv in range(sampling[c][1]) for dh in range(sampling[c][0])]
            else:
                c = comps[0]
                blocks = [(c, base[c][im] + y * mw[im] * sampling[c][0] + x)]
            order.append((lanes, blocks))
        found = {c: tables.setdefault(t, _lookup(t)) if t is not None else None for c, t in zip(comps, used, strict=True)}
        if first == 0:
            _read_dc(reader, coef, order, low, high > 0, found)
        elif high:
            _refine_ac(reader, coef[comps[0]], order, first, last, low, found[comps[0]])
        else:
            _read_ac(reader, coef[comps[0]], order, first, last, low, found[comps[0]])
    return [
        Decoded(i.note, [coef[c][base[c][k] : base[c][k] + total[c][k]] for c in range(len(sampling))], i.width, i.height, sampling, i.quant)
        for k, i in enumerate(images)
    ]


def decode(files: list[bytes]) -> list[Decoded]:
    """Coefficients of progressive files, many at once."""
    buf = np.frombuffer(b"".join(files), np.uint8)
    full = np.flatnonzero(buf[:-1] == 255)
    follow = buf[full + 1]
    markers = full[(follow != 0) & (follow != 255) & ((follow < 0xD0) | (follow > 0xD7))]
    alike: dict[tuple, list[int]] = {}
    images, base = [], 0
    for k, raw in enumerate(files):
        image = _parse(raw, base, markers)
        images.append(image)
        alike.setdefault((image.sampling, tuple(image.script)), []).append(k)
        base += len(raw)
    out: list[Decoded | None] = [None] * len(files)
    for members in alike.values():
        for k, one in zip(members, _decode_alike(buf, [images[k] for k in members]), strict=True):
            out[k] = one
    return out


_SHIFT = 13
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
#: Coefficient in zigzag order to sample: whole numbers, so that sums are exact in any order.
_INVERSE = np.rint(np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG] * (1 << _SHIFT))


def samples(coefficients: np.ndarray, quant: bytes) -> np.ndarray:
    """Blocks of 8 by 8 samples, 0 to 255."""
    flat = (coefficients.astype(np.float64) * np.frombuffer(quant, np.uint8)) @ _INVERSE
    return np.clip(np.floor(flat / (1 << _SHIFT) + 0.5) + 128, 0, 255).astype(np.uint8)


def rgb(image: Decoded, blocks: list[np.ndarray] | None = None) -> np.ndarray:
    """(height, width, 3): chroma is repeated to full resolution and turned to RGB in whole numbers."""
    blocks = blocks or [samples(c, q) for c, q in zip(image.coefficients, image.quant, strict=True)]
    hmax, vmax = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
    mw, mh = _ceil(image.width, 8 * hmax), _ceil(image.height, 8 * vmax)
    planes = []
    for block, (h, v) in zip(blocks, image.sampling, strict=True):
        plane = block.reshape(mh * v, mw * h, 8, 8).transpose(0, 2, 1, 3).reshape(mh * v * 8, mw * h * 8)
        if h < hmax:
            plane = np.repeat(plane, hmax // h, axis=1)
        if v < vmax:
            plane = np.repeat(plane, vmax // v, axis=0)
        planes.append(plane[: image.height, : image.width].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((image.height, image.width, 3), np.uint8)
    # fixed values of the colour transform, times 65536
    for k, value in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
        out[:, :, k] = np.clip(y + ((value + 32768) >> 16), 0, 255)
    return out
