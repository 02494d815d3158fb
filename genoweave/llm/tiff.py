"""TIFF media columns: a binary column of TIFF files becomes one row per page.

The reader walks the chain of image directories (either byte order), decodes strips or tiles that are stored plain, as
PackBits, LZW or deflate, undoes the horizontal or floating-point predictor, and joins chunky or planar samples.

Defined results: null or empty media give no page rows; a file that can't be read gives one row with its error and no
pixels, and pages before a broken one are kept; a directory that points back ends the walk; page size is
bounded by ``MAX_PAGE_BYTES``, beyond which the page has an error; repeated rows are decoded as often as they occur; the input's
other columns are kept unless they have the name of a page column, which then takes their place.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format: tags, compression codes, bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
CODECS = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
OLD_DEFLATE = 32946
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}

MAX_PAGE_BYTES = 1 << 30
#: Bytes of pixels or media that an Arrow batch gathers before it is passed on.
BATCH_BYTES = 4 << 20

PAGE_FIELDS = [
    ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()),
    ("codec", pa.string()), ("predictor", pa.int32()), ("pixels", pa.binary()), ("error", pa.string()),
]
_SPARK = {pa.int32(): T.IntegerType(), pa.string(): T.StringType(), pa.binary(): T.BinaryType()}


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(row: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(row)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and row[j] == row[i]:
            j += 1
        if j - i >= 3:
            out += bytes((257 - (j - i), row[i]))
        else:
            while j < n and j - i < 128 and not (j + 2 < n and row[j] == row[j + 1] == row[j + 2]):
                j += 1
            out += bytes((j - i - 1,)) + row[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; the width grows one code early."""
    out, table, width, held, bits, last = [], [], 9, 0, 0, b""
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            table, width, last = fresh.copy(), 9, b""
            continue
        if code == 257:
            break
        if not table:
            raise ValueError("LZW data doesn't begin with a clear code")
        if not last:
            word = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out.append(word)
        last = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(256, 9)
    table, width, word = {bytes((i,)): i for i in range(256)}, 9, b""
    following = 258
    for byte in data:
        longer = word + bytes((byte,))
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = following
        following += 1
        if following >= (1 << width):
            width += 1
        if following >= 4094:
            put(256, min(width, 12))
            table, width, following = {bytes((i,)): i for i in range(256)}, 9, 258
        word = bytes((byte,))
    if word:
        put(table[word], width)
        following += 1
        if following >= (1 << width) and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def _inflate(data: bytes, compression: int) -> bytes:
    if compression == CODECS["none"]:
        return data
    if compression in (CODECS["deflate"], OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == CODECS["lzw"]:
        return lzw_decode(data)
    if compression == CODECS["packbits"]:
        return unpack_bits(data)
    raise ValueError(f"compression {compression} isn't supported")


def _segment(data: bytes, tags: dict, rows: int, width: int, samples: int, order: str) -> np.ndarray:
    """A strip or tile as an array of rows x width x samples, predictor undone."""
    size = tags["bytes"]
    raw = _inflate(data, tags["compression"])
    need = rows * width * samples * size
    if len(raw) < need:
        raise ValueError("a strip or tile is short")
    predictor = tags["predictor"]
    if predictor == 3:
        parts = np.frombuffer(raw, np.uint8, need).reshape(rows, width * size * samples).copy()
        parts = np.cumsum(parts.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        return np.ascontiguousarray(parts[:, ::-1].transpose(0, 2, 1)).view(f"<u{size}").reshape(rows, width, samples)
    out = np.frombuffer(raw, f"{order}u{size}", need // size).reshape(rows, width, samples).astype(f"<u{size}", copy=False)
    return np.cumsum(out, axis=1, dtype=out.dtype) if predictor == 2 else out


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    found = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in FIELD:
            continue
        one = struct.calcsize("=" + FIELD[kind])
        where = at + 2 + 12 * k + 8
        if one * count > 4:
            (where,) = struct.unpack_from(order + "I", data, where)
        if where + one * count > len(data):
            raise ValueError("a field lies outside the file")
        found[tag] = list(struct.unpack_from(f"{order}{count}{FIELD[kind]}", data, where))
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return found, following


def _page(data: bytes, fields: dict[int, list], order: str) -> tuple:
    one = lambda tag, default=None: fields.get(tag, [default])[0]
    width, height, samples, planar = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(PLANAR, 1)
    bits = fields.get(BITS, [1])
    if not width or not height or bits[0] not in (8, 16, 32, 64) or len({*bits}) > 1:
        raise ValueError("size or bits aren't supported")
    if width * height * samples * bits[0] // 8 > MAX_PAGE_BYTES:
        raise ValueError("the page is too large")
    tags = {"compression": one(COMPRESSION, 1), "predictor": one(PREDICTOR, 1), "bytes": bits[0] // 8}
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    tiled = TILE_OFFSETS in fields
    high, wide = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    offsets, counts = (fields[TILE_OFFSETS], fields[TILE_COUNTS]) if tiled else (fields[STRIP_OFFSETS], fields[STRIP_COUNTS])
    down, across = -(-height // high), -(-width // wide)
    if len(offsets) < planes * down * across or len(counts) < len(offsets):
        raise ValueError("strips or tiles are missing")
    image = np.empty((height, width, samples), f"<u{tags['bytes']}")
    for k in range(planes * down * across):
        plane, (y, x) = k // (down * across), divmod(k % (down * across), across)
        rows = high if tiled else min(high, height - y * high)
        if offsets[k] + counts[k] > len(data):
            raise ValueError("a strip or tile lies outside the file")
        part = _segment(data[offsets[k] : offsets[k] + counts[k]], tags, rows, wide, each, order)
        target = image[y * high : y * high + rows, x * wide : x * wide + wide, plane : plane + each]
        target[...] = part[: target.shape[0], : target.shape[1]]
    name = {v: k for k, v in CODECS.items()}.get(tags["compression"], "deflate")
    return width, height, samples, bits[0], name, tags["predictor"], image.tobytes(), None


def walk(data: bytes | None) -> Iterator[tuple]:
    """(page, width, height, samples, bits, codec, predictor, pixels, error) of each page; samples little-endian."""
    page, seen = 0, set()
    if not data:
        return
    try:
        order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
        if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise ValueError("not a TIFF file")
        (at,) = struct.unpack_from(order + "I", data, 4)
        while at and at not in seen:
            seen.add(at)
            fields, at = _directory(data, at, order)
            yield page, *_page(data, fields, order)
            page += 1
    except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as e:
        yield page, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


def encode(pages: list[np.ndarray], codec: str = "deflate", predictor: int = 1, rows: int = 16, tile: int = 0, order: str = "<", level: int = 1) -> bytes:
    """Arrays of height x width x samples (8 or 16 bits) as one TIFF file; tile > 0 stores square tiles of that side."""
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    press = {"none": bytes, "deflate": lambda b: zlib.compress(b, level), "lzw": lzw_encode}
    for image in pages:
        high, wide, samples = image.shape
        offsets, counts = [], []
        for y in range(0, high, tile or rows):
            for x in range(0, wide, tile or wide):
                part = image[y : y + (tile or rows), x : x + (tile or wide)]
                if tile:
                    part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                part = part.astype(part.dtype.newbyteorder(order))
                packed = b"".join(pack_bits(r.tobytes()) for r in part) if codec == "packbits" else press[codec](part.tobytes())
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed
        where, sizes = (TILE_OFFSETS, TILE_COUNTS) if tile else (STRIP_OFFSETS, STRIP_COUNTS)
        fields = {WIDTH: [wide], HEIGHT: [high], BITS: [8 * image.itemsize] * samples, COMPRESSION: [CODECS[codec]], PHOTOMETRIC: [1], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [predictor], where: offsets, sizes: counts}
        fields |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile]} if tile else {ROWS_PER_STRIP: [rows]}
        body, longer = [], {}
        for tag, values in sorted(fields.items()):
            if len(values) > 1:
                longer[tag] = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
            body.append(struct.pack(order + "HHII", tag, 4, len(values), longer.get(tag, values[0])))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(body)) + b"".join(body)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH_BYTES; weight: the place of the large column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[weight] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def tiff_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page: df's other columns, then PAGE_FIELDS. A file's pages stay together and in order."""
    own = {n for n, _ in PAGE_FIELDS}
    others = [c for c in df.columns if c != media and c not in own]
    source = df.select(*others, media)
    schema = T.StructType([source.schema[c] for c in others] + [T.StructField(n, _SPARK[t]) for n, t in PAGE_FIELDS])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pa.schema([batch.schema.field(i) for i in range(len(others))])
            full = pa.schema([*kept, *(pa.field(n, t) for n, t in PAGE_FIELDS)])
            files = batch.column(len(others))

            def rows(files=files):
                for i, data in enumerate(files):
                    for page in walk(data.as_py()):
                        yield (i, *page)

            flat = pa.schema([pa.field("i", pa.int64()), *(pa.field(n, t) for n, t in PAGE_FIELDS)])
            for part in _batches(rows(), flat, 8):
                at = part.column(0)
                yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(len(others))] + part.columns[1:], schema=full)

    return source.mapInArrow(pages, schema)


#: The form in which op2 stores a text: rows of 576 samples, pages of 64 rows, strips of 16, deflate with the horizontal predictor.
ROW, PAGE_ROWS, STRIP_ROWS, CODEC, DIFFERENCING = 576, 64, 16, "deflate", 2


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded bytes and the payload: UTF-8 and bytes 255 up to a positive multiple of ROW."""
    data = (text or "").encode()
    return len(data), data + b"\xff" * (max(1, -(-len(data) // ROW)) * ROW - len(data))


def store_text(text: str | None) -> tuple[int, bytes]:
    n, payload = payload_of(text)
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW, 1)
    return n, encode([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], CODEC, DIFFERENCING, STRIP_ROWS)


def stored_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a TIFF file."""
    source = docs.select("doc_id", "text")
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def store(batches):
        for batch in batches:
            ids = batch.column(0)
            flat = pa.schema([pa.field("i", pa.int64()), pa.field("n_bytes", pa.int64()), pa.field("media", pa.binary())])
            full = pa.schema([batch.schema.field(0), *list(flat)[1:]])
            for part in _batches(((i, *store_text(t.as_py())) for i, t in enumerate(batch.column(1))), flat, 2):
                yield pa.RecordBatch.from_arrays([ids.take(part.column(0)), *part.columns[1:]], schema=full)

    return source.mapInArrow(store, schema)


class _File:
    """What is gathered of one file while its pages pass."""

    def __init__(self, head: list):
        self.head, self.sha, self.size, self.tail, self.pages, self.high, self.edges = head, hashlib.sha256(), 0, b"", 0, 0, 0
        self.counts, self.error = np.zeros(256, np.int64), None

    def add(self, width, height, pixels: bytes | None, error: str | None) -> None:
        if error:
            self.error = error
            return
        image = np.frombuffer(pixels, np.uint8).reshape(height, width)
        self.sha.update(pixels)
        self.size += len(pixels)
        self.tail = (self.tail + pixels[-32:])[-32:]
        self.pages, self.high = self.pages + 1, self.high + height
        self.counts += np.bincount(image.ravel(), minlength=256)
        self.edges += int(np.abs(np.diff(image.astype(np.int16), axis=1)).sum())

    def row(self) -> tuple:
        values, n = np.arange(256), max(1, self.size)
        mean = float((self.counts * values).sum()) / n
        spread = max(0.0, float((self.counts * values * values).sum()) / n - mean * mean) ** 0.5
        share = self.counts[self.counts > 0] / n
        entropy = float(-(share * np.log2(share)).sum()) + 0.0
        bins = ",".join(map(str, self.counts.reshape(16, 16).sum(axis=1)))
        feature = f"pages={self.pages};rows={self.high};mean={mean:.3f};sd={spread:.3f};entropy={entropy:.3f};edges={self.edges / n:.3f};bins={bins}" if not self.error else f"error={self.error}"
        return (*self.head[:2], self.size, self.sha.hexdigest(), zlib.crc32(self.tail), *self.head[2:], feature)


def features(pages: DataFrame) -> DataFrame:
    """tiff_pages' rows of stored texts -> one row per file. A file's pages are neighbours, so nothing is shuffled."""
    source = pages.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "width", "height", "pixels", "error")
    kind = source.schema["doc_id"]
    schema = T.StructType([kind, *(T.StructField(n, t) for n, t in (
        ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
        ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())))])

    def gather(batches):
        held, done, ids = None, [], pa.null()

        def flush():
            arrays = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (ids, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            ids = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[4] == 0:
                    if held:
                        done.append(held.row())
                    held = _File(list(row[:4]))
                held.add(row[5], row[6], row[7], row[8])
            if len(done) >= 1000:
                yield flush()
                done = []
        if held:
            done.append(held.row())
        if done:
            yield flush()

    return source.mapInArrow(gather, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """One row per document: sizes and digests of its text stored as TIFF and read back, and features of the pixels."""
    stored = stored_texts(docs).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return features(tiff_pages(stored))
