r"""Media columns: payloads in baseline JPEGs, read back as luminance thumbnails.

The reader parses any baseline JPEG (SOF0, 8 bits, Huffman): markers, quantisation and
Huffman tables, restart intervals, scans of one or more components. It Huffman-decodes the
scans and rebuilds, without inverse transforms, the DC-only luminance thumbnail: one
sample for each 8 x 8 block. Restart segments are independent, so all segments of a
batch of images are decoded in step, one symbol of each at a time, in numpy.

The writer stores a payload as such a thumbnail. Each byte is the DC coefficient of one
block (quantiser 8, so the thumbnail's sample is the byte itself) with no AC coefficients;
rows of 576 blocks are restart segments. A payload of more rows than an image can have is a
sequence of images. So payloads come back without loss by decoding alone.

Defined results: a null text counts as empty and gives one row of padding; a text of any length
is stored whole, as several images if need be; equal texts and repeated rows give equal media; an
empty table gives no row; other columns, whatever their names, are ignored; media that are no
baseline JPEG raise ValueError; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import batch, documents, mapped, small_batches

#: Samples of a row, which payloads are padded to a multiple of.
ROW = 576
#: Rows of one image: 65,535 lines are the most that a JPEG has.
MOST_ROWS = 65535 // 8
#: Segments that are decoded in step, at most.
LANES = 4096

# Fixed values of the format (ITU-T T.81): the typical luminance DC code lengths and the zigzag's use of them.
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = bytes(range(12))
#: One AC code of one bit: end of block.
AC_LENGTHS, AC_SYMBOLS = (1, *[0] * 15), b"\x00"


def _codes(lengths, symbols) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) of a canonical Huffman table."""
    out, code, at = [], 0, 0
    for bits, many in enumerate(lengths, 1):
        for _ in range(many):
            out.append((symbols[at], code, bits))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(lengths, symbols) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, bits in _codes(lengths, symbols):
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(width: int, height: int) -> bytes:
    dc = bytes([0x00, *DC_LENGTHS]) + DC_SYMBOLS
    ac = bytes([0x10, *AC_LENGTHS]) + AC_SYMBOLS
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0, *[8] * 64]))
        + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, dc + ac)
        + _segment(0xDD, struct.pack(">H", ROW))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


_DC = np.array([(code, bits) for _, code, bits in _codes(DC_LENGTHS, DC_SYMBOLS)], np.int64)


def _category(v: np.ndarray) -> np.ndarray:
    """Bits of a coefficient's size."""
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def write_rows(samples: np.ndarray) -> list[bytes]:
    """Each row of samples as the bytes of one restart segment."""
    v = samples.astype(np.int64) - 128
    d = np.diff(v, axis=1, prepend=0)
    cat = _category(d)
    extra = np.where(d < 0, d + (1 << cat) - 1, d)
    # Huffman code, size bits, and the one-bit end of block (0)
    bits = (((_DC[cat, 0] << cat) | extra) << 1).ravel()
    n = _DC[cat, 1] + cat + 1
    ends = n.cumsum(1)
    length = -(-ends[:, -1] // 8)
    start = np.r_[0, length.cumsum()]
    at = ((ends - n) + 8 * start[:-1, None]).ravel()
    n = n.ravel()
    out = np.zeros(int(start[-1]) + 4, np.int64)
    window = bits << (32 - n - at % 8)
    for k in range(4):
        out += np.bincount(at // 8 + k, (window >> (24 - 8 * k)) & 255, len(out)).astype(np.int64)
    pad = (-ends[:, -1]) % 8
    out[start[1:] - 1] |= (1 << pad) - 1
    raw = out.astype(np.uint8).tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def write_jpeg(payload: bytes) -> bytes:
    """The payload, a positive multiple of ROW bytes, as one or more baseline JPEGs."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"a payload has a positive multiple of {ROW} bytes")
    rows, out = np.frombuffer(payload, np.uint8).reshape(-1, ROW), []
    for top in range(0, len(rows), MOST_ROWS):
        part = rows[top : top + MOST_ROWS]
        out.append(_header(ROW * 8, len(part) * 8))
        segments = [x for k in range(0, len(part), 512) for x in write_rows(part[k : k + 512])]
        out += [x for k, s in enumerate(segments) for x in ((s, bytes([0xFF, 0xD0 + k % 8])) if k < len(segments) - 1 else (s,))]
        out.append(b"\xff\xd9")
    return b"".join(out)


class Image:
    """What the markers of one baseline JPEG say, and its scan's segments."""

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        self.quant, self.huffman, self.interval, self.parts = {}, {}, 0, []
        frame = None
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                raise ValueError("no scan")
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    many = sum(body[1:17])
                    self.huffman[body[0]] = (tuple(body[1:17]), bytes(body[17 : 17 + many]))
                    body = body[17 + many :]
            elif marker == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xC0:
                bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                frame = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
                if bits != 8 or not self.width or not self.height:
                    raise ValueError("no baseline frame")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("no baseline frame")
            elif marker == 0xDA:
                break
        if frame is None:
            raise ValueError("a scan before its frame")
        names = [body[1 + 2 * k] for k in range(body[0])]
        tables = [body[2 + 2 * k] for k in range(body[0])]
        first = next(iter(frame))
        if first not in names or (len(names) != len(frame) and len(names) > 1):
            raise ValueError("the first scan has no luminance")
        widest, tallest = max(x[0] for x in frame.values()), max(x[1] for x in frame.values())
        h, v, self.q = frame[first]
        single = len(names) == 1
        self.step = self.quant[self.q]
        #: Component of each block of an MCU, with its tables and whether it is luminance.
        self.blocks = []
        for k, name in enumerate(names):
            a, b, _ = frame[name]
            self.blocks += [(k, tables[k] >> 4, 16 | tables[k] & 15, name == first)] * (1 if single else a * b)
        lines, columns = -(-self.height * v // (8 * tallest)), -(-self.width * h // (8 * widest))
        if single:
            self.across, self.down, self.h, self.v = columns, lines, 1, 1
        else:
            self.across, self.down, self.h, self.v = -(-self.width // (8 * widest)), -(-self.height // (8 * tallest)), h, v
        self.lines, self.columns = lines, columns
        # entropy-coded data: up to a marker that is no restart
        end = at
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                raise ValueError("no end of scan")
            code = data[end + 1]
            if code == 0:
                end += 2
            elif 0xD0 <= code <= 0xD7:
                self.parts.append((at, end))
                end += 2
                at = end
            else:
                self.parts.append((at, end))
                break
        total, per = self.across * self.down, self.interval or self.across * self.down
        self.mcus = [min(per, total - k) for k in range(0, total, per)]
        if len(self.mcus) != len(self.parts):
            raise ValueError("restart markers are missing")
        self.end = data.find(b"\xff\xd9", end) + 2

    def plan(self) -> tuple:
        """Images of equal plans are decoded together."""
        return tuple(self.blocks), tuple(sorted(self.huffman.items()))


def _decode(plan: tuple, parts: list[bytes], mcus: list[int]) -> np.ndarray:
    """DC values of luminance blocks of some segments, in step; a row for each segment."""
    blocks, tables = plan
    tables = dict(tables)
    ahead = {k: _lookup(*v) for k, v in tables.items()}
    for _, dc, ac, _ in blocks:
        if dc not in ahead or ac not in ahead:
            raise ValueError("a Huffman table is missing")
    size = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(p + b"\xff" * 8 for p in parts), np.uint8).astype(np.int64)
    base = np.r_[0, (size + 8).cumsum()[:-1]]
    # the 32 bits from each byte on
    word = np.zeros(len(data), np.int64)
    for k in range(4):
        word[: len(data) - k] |= data[k:] << (24 - 8 * k)
    at, last = base * 8, (base + size) * 8
    light = sum(b[3] for b in blocks)
    most = max(mcus)
    out = np.zeros((len(parts), most * light), np.int32)
    before = np.zeros((len(parts), 1 + max(b[0] for b in blocks)), np.int64)
    left = np.array(mcus)

    def take(table, at):
        """Symbol, and the place after its code."""
        found = table[(word[at >> 3] >> (16 - (at & 7))) & 65535]
        if not found.all():
            raise ValueError("a code that no table has")
        return found & 255, at + (found >> 8)

    for m in range(most):
        rows = slice(None) if m < left.min() else np.flatnonzero(left > m)
        here = at[rows]
        place = m * light
        for k, dc, ac, luminance in blocks:
            n, here = take(ahead[dc], here)
            value = (word[here >> 3] << (here & 7) & 0xFFFFFFFF) >> (32 - n)
            value = np.where(value < (1 << n) >> 1, value - (1 << n) + 1, value)
            here = here + n
            before[rows, k] += value
            if luminance:
                out[rows, place] = before[rows, k]
                place += 1
            # AC coefficients are passed over: run << 4 | bits, 0 ends the block
            symbol, here = take(ahead[ac], here)
            coded = np.where(symbol == 0, 64, 1 + (symbol >> 4) + 1)
            here = here + (symbol & 15)
            while (more := np.flatnonzero(coded < 64)).size:
                symbol, now = take(ahead[ac], here[more])
                here[more] = now + (symbol & 15)
                coded[more] = np.where(symbol == 0, 64, coded[more] + (symbol >> 4) + 1)
        at[rows] = here
    if (at > last).any():
        raise ValueError("a segment ends early")
    return out


def read_thumbnails(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each value the images in it: width, height and the luminance thumbnail."""
    images: list[list[Image]] = []
    for data in media:
        at, own = 0, []
        while at < len(data):
            own.append(Image(data, at))
            at = own[-1].end
        images.append(own)
    work: dict[tuple, list[tuple[int, int, int]]] = {}
    for i, own in enumerate(images):
        for j, image in enumerate(own):
            work.setdefault(image.plan(), []).extend((i, j, k) for k in range(len(image.parts)))
    decoded: dict[tuple[int, int], list] = {}
    for plan, lanes in work.items():
        for begin in range(0, len(lanes), LANES):
            some = lanes[begin : begin + LANES]
            parts = [media[i][slice(*images[i][j].parts[k])].replace(b"\xff\x00", b"\xff") for i, j, k in some]
            mcus = [images[i][j].mcus[k] for i, j, k in some]
            light = sum(b[3] for b in plan[0])
            for (i, j, k), row, n in zip(some, _decode(plan, parts, mcus), mcus, strict=True):
                decoded.setdefault((i, j), []).append((k, row[: n * light]))
    out = []
    for i, own in enumerate(images):
        mine = []
        for j, x in enumerate(own):
            dc = np.concatenate([row for _, row in sorted(decoded[i, j], key=lambda r: r[0])])
            grid = dc.reshape(x.down, x.across, x.v, x.h).transpose(0, 2, 1, 3).reshape(x.down * x.v, x.across * x.h)
            light = np.clip((grid[: x.lines, : x.columns] * x.step + 4) // 8 + 128, 0, 255).astype(np.uint8)
            mine.append((x.width, x.height, light))
        out.append(mine)
    return out


def average_hash(light: np.ndarray) -> str:
    """64 bits, as hexadecimal: which of 8 x 8 areas of the thumbnail are lighter than the mean."""
    rows = np.linspace(0, light.shape[0], 9).astype(int)[:-1] if light.shape[0] >= 8 else np.arange(8) * light.shape[0] // 8
    columns = np.linspace(0, light.shape[1], 9).astype(int)[:-1] if light.shape[1] >= 8 else np.arange(8) * light.shape[1] // 8
    x = light.astype(np.int64)
    if light.shape[0] >= 8:
        x = np.add.reduceat(x, rows, 0) * 1000 // np.diff(np.r_[rows, light.shape[0]])[:, None]
    else:
        x = x[rows] * 1000
    x = np.add.reduceat(x, columns, 1) // np.diff(np.r_[columns, light.shape[1]]) if light.shape[1] >= 8 else x[:, columns]
    return f"{int(''.join('1' if b else '0' for b in (x > x.mean()).ravel()), 2):016x}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % ROW if raw else ROW)


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as JPEG."""
    small_batches(docs.sparkSession)

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        for b in batches:
            made = [payload_of(t) for t in b.column(1).to_pylist()]
            yield batch(schema, doc_id=b.column(0), n_bytes=[n for n, _ in made], media=[write_jpeg(p) for _, p in made])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(rows, run, "doc_id long, n_bytes long, media binary", "media")


def read_features(media: DataFrame) -> DataFrame:
    """Features of the ``media`` column, from its bytes: dimensions, thumbnail and its hashes."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("feature", pa.string())])
        for b in batches:
            stored = b.column(2).to_pylist()
            rows = []
            for data, images in zip(stored, read_thumbnails(stored), strict=True):
                payload = b"".join(light.tobytes() for _, _, light in images)
                feature = ";".join(f"{w}x{h}:{average_hash(light)}" for w, h, light in images)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), images[0][0], sum(x[1] for x in images), feature))
            columns = list(map(list, zip(*rows, strict=True))) if rows else [[]] * 8
            yield batch(schema, doc_id=b.column(0), n_bytes=b.column(1), **dict(zip(schema.names[2:], columns, strict=True)))

    return mapped(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, feature string", "media")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_features(store_texts(documents(spark, sf_dir)))
