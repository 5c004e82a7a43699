"""Media columns: TIFF files as binary columns, one row per page (image directory).

The reader walks the chain of image directories in either byte order, takes strips or tiles,
decodes none, PackBits, LZW or deflate, undoes the horizontal predictor, and gives each page's
samples row by row.  The writer makes 8-bit grey pages of strips or tiles.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from maqta.llm.common import pieces, table, tidy

WIDTH = 64
STRIP_ROWS = 1024
PAGE_ROWS = 1 << 14
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes of each field type.
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
FIELD_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I"}


class TiffError(ValueError):
    """The bytes are no TIFF that this reader knows."""


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples_per_pixel: int
    bits: int
    compression: int
    samples: bytes


def unpackbits(data: bytes, most: int) -> bytes:
    """The first ``most`` bytes, as with all decoders here."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < most:
        c = data[i]
        i += 1
        if c < 128:
            out += data[i : i + c + 1]
            i += c + 1
        elif c > 128:
            out += data[i : i + 1] * (257 - c)
            i += 1
    return bytes(out[:most])


def packbits(data: bytes) -> bytes:
    """Equal bytes in threes or more as runs, all others literally, at most 128 a packet."""
    if not data:
        return b""
    a = np.frombuffer(data, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    lengths = np.diff(np.append(starts, len(a)))
    long = lengths > 2
    out, i = bytearray(), 0

    def literally(end: int) -> None:
        nonlocal i
        while i < end:
            j = min(i + 128, end)
            out.append(j - i - 1)
            out.extend(data[i:j])
            i = j

    for start, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
        literally(start)
        while n > 2:
            m = min(n, 128)
            out += bytes((257 - m, data[start]))
            n, i = n - m, i + m
    literally(len(data))
    return bytes(out)


#: TIFF's LZW: codes of 9 to 12 bits, most significant bit first.  The width of a code follows from its place since the last clear.
CLEAR, END, FIRST_WORD, MOST_WORDS = 256, 257, 258, 4094
SINGLE = [bytes((i,)) for i in range(256)] + [b"", b""]


def code_widths(n: int) -> np.ndarray:
    """Widths of the first ``n`` codes after a clear."""
    return np.searchsorted([512 - FIRST_WORD, 1024 - FIRST_WORD, 2048 - FIRST_WORD], np.arange(n), side="right") + 9


WIDTHS = code_widths(MOST_WORDS + 2)
ENDS = np.cumsum(WIDTHS)


def codes_of(data: np.ndarray, bit: int, since: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes from ``bit`` on, and the bits at which they end, as if no clear came; the first is the ``since``-th after one.

    ``data``: the bytes and three of filling.
    """
    if since < len(WIDTHS):
        widths, ends = WIDTHS[since:], ENDS[since:] - (ENDS[since - 1] if since else 0)
    else:
        widths, ends = np.full(len(WIDTHS), 12), np.arange(1, len(WIDTHS) + 1) * 12
    n = int(np.searchsorted(ends, 8 * (len(data) - 3) - bit, side="right"))
    widths, ends = widths[:n], ends[:n] + bit
    at = ends - widths
    byte = at >> 3
    three = data[byte].astype(np.int32) << 16 | data[byte + 1].astype(np.int32) << 8 | data[byte + 2]
    return three >> (24 - widths - (at & 7)) & (1 << widths) - 1, ends


def unlzw(data: bytes, most: int) -> bytes:
    """The first ``most`` bytes; codes are cut out many at a time, up to the next clear."""
    filled = np.frombuffer(data + b"\0\0\0", np.uint8)
    out, total, bit, since = [], 0, 0, 0
    words, old = list(SINGLE), b""
    while total < most:
        codes, ends = codes_of(filled, bit, since)
        if not len(codes):
            break
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if len(stops) else len(codes)
        n = len(words)
        for code in codes[:stop].tolist():
            if code < n:
                word = words[code]
            elif code == n and old:
                word = old + old[:1]
            else:
                raise TiffError("LZW code out of range")
            if old and n < 4096:
                words.append(old + word[:1])
                n += 1
            out.append(word)
            total += len(word)
            if total >= most:
                break
            old = word
        if stop < len(codes):
            if codes[stop] == END:
                break
            bit, since, words, old = int(ends[stop]), 0, list(SINGLE), b""
        else:
            bit, since = int(ends[-1]), since + len(codes)
    return b"".join(out)[:most]


def lzw(data: bytes) -> bytes:
    codes, runs, begun = [CLEAR], [1], 1
    words: dict[int, int] = {}
    find, put, next_code, word = words.get, codes.append, FIRST_WORD, -1
    for byte in data:
        if word < 0:
            word = byte
            continue
        key = word << 8 | byte
        longer = find(key)
        if longer is not None:
            word = longer
            continue
        put(word)
        words[key] = next_code
        next_code += 1
        word = byte
        if next_code == MOST_WORDS:
            put(word)
            put(CLEAR)
            runs.append(len(codes) - begun)
            words.clear()
            next_code, word, begun = FIRST_WORD, -1, len(codes)
    if word >= 0:
        put(word)
    put(END)
    runs.append(len(codes) - begun)
    widths = np.concatenate([WIDTHS[:n] for n in runs])
    bits = np.unpackbits((np.array(codes) << 16 - widths).astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16) < widths[:, None]]).tobytes()


def undeflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most) if most else b""


DECODE = {NONE: lambda b, most: b[:most], PACKBITS: unpackbits, LZW: unlzw, DEFLATE: undeflate, OLD_DEFLATE: undeflate}
#: Bytes of samples that a page may have.
MOST_SAMPLES = 1 << 30
ENCODE = {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 1)}


def encode_tiff(payload: bytes, width: int = WIDTH, compression: int | tuple[int, ...] = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, page_rows: int = PAGE_ROWS, tile: int | None = None) -> bytes:
    """A little-endian grey TIFF of ``payload`` (a positive multiple of ``width``), a page per ``page_rows`` rows.

    ``tile``: pages are square tiles of that side (16 or a multiple), filled up with 0, in place of strips.  Several
    compressions take turns page by page.
    """
    if not payload or len(payload) % width:
        raise TiffError(f"the payload must be a positive multiple of {width} bytes")
    kinds = compression if isinstance(compression, tuple) else (compression,)
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for number, top in enumerate(range(0, len(rows), page_rows)):
        page, kind = rows[top : top + page_rows], kinds[number % len(kinds)]
        if tile:
            high, across = -(-len(page) // tile), -(-width // tile)
            full = np.zeros((high * tile, across * tile), np.uint8)
            full[: len(page), :width] = page
            blocks = list(full.reshape(high, tile, across, tile).transpose(0, 2, 1, 3).reshape(-1, tile, tile))
        else:
            blocks = [page[i : i + strip_rows] for i in range(0, len(page), strip_rows)]
        if predictor == 2:
            blocks = [np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1) for b in blocks]
        parts, places = [ENCODE[kind](b.tobytes()) for b in blocks], []
        for s in parts:
            places.append(len(out))
            out += s + b"\0" * (len(s) & 1)
        n, arrays = len(parts), len(out)
        if n > 1:
            out += struct.pack(f"<{2 * n}I", *places, *map(len, parts))
        first, second = (arrays, arrays + 4 * n) if n > 1 else (places[0], len(parts[0]))
        tags = [(254, 4, 1, 2 if len(rows) > page_rows else 0), (256, 4, 1, width), (257, 4, 1, len(page)), (258, 3, 1, 8), (259, 3, 1, kind), (262, 3, 1, 1)]
        tags += [] if tile else [(273, 4, n, first)]
        tags += [(277, 3, 1, 1)] + ([] if tile else [(278, 4, 1, strip_rows), (279, 4, n, second)]) + [(317, 3, 1, predictor)]
        tags += [(322, 4, 1, tile), (323, 4, 1, tile), (324, 4, n, first), (325, 4, n, second)] if tile else []
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF, in the order of its image directories."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None or len(data) < 8:
        raise TiffError("no TIFF header")
    at, number, seen = struct.unpack_from(order + "I", data, 4)[0], 0, set()
    while at:
        if at in seen or at + 2 > len(data):
            raise TiffError("bad chain of image directories")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
            if kind not in FIELD_CODE:
                continue
            place = at + 10 + 12 * i
            if FIELD_BYTES[kind] * count > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = struct.unpack_from(f"{order}{count}{FIELD_CODE[kind]}", data, place)
        yield _page(data, tags, number, order)
        number += 1
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _page(data: bytes, tags: dict[int, tuple], number: int, order: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, per, bits = one(256, 0), one(257, 0), one(277, 1), one(258, 1)
    compression, predictor = one(259, NONE), one(317, 1)
    if bits != 8 or compression not in DECODE or predictor not in (1, 2) or one(284, 1) != 1:
        raise TiffError(f"not supported: {bits} bits, compression {compression}, predictor {predictor}")
    tiled = 322 in tags
    w, h = (tags[322][0], tags[323][0]) if tiled else (width, min(one(278, height), height))
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    if min(width, height, per, w, h) < 1 or per > 16:
        raise TiffError(f"bad size: {width} x {height} of {per} samples in parts of {w} x {h}")
    across, down = -(-width // w), -(-height // h)
    if width * height * per > MOST_SAMPLES or w * h * per > MOST_SAMPLES:
        raise TiffError(f"a page of {width} x {height} is more than {MOST_SAMPLES} samples")
    if len(places) != across * down or len(sizes) != across * down:
        raise TiffError(f"{len(places)} parts where {across * down} are due")
    # No code of these compressions stands for more than some thousand bytes, so a file cannot be asked for much more than it holds.
    if sum(sizes) > len(data) * len(sizes) or width * height * per > 4096 * (sum(min(s, len(data)) for s in sizes) + len(sizes)):
        raise TiffError(f"{width} x {height} samples cannot stand in {len(data)} bytes")
    out = np.zeros((height, width * per), np.uint8)
    for i, (p, s) in enumerate(zip(places, sizes, strict=True)):
        if p + s > len(data):
            raise TiffError("a part lies outside the file")
        top, left = i // across * h, i % across * w
        rows = h if tiled else min(h, height - top)
        block = np.frombuffer(DECODE[compression](data[p : p + s], rows * w * per), np.uint8)
        if len(block) < rows * w * per:
            raise TiffError("a part is cut short")
        block = block.reshape(rows, w, per)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        part = block.reshape(rows, w * per)[: height - top, : (width - left) * per]
        out[top : top + len(part), left * per : left * per + part.shape[1]] = part
    return Page(number, width, height, per, bits, compression, out.tobytes())


def tiff_pages(df: DataFrame, content: str, key: str) -> DataFrame:
    """One row per page: key, page, width, height, samples_per_pixel, compression, samples, error.

    Null content gives no row; bytes that are no known TIFF, or whose pages are larger than the file can hold, give one row with
    ``error``; the others' ``error`` is null.  Keys may repeat; an empty table gives an empty result.
    """

    def run(batches):
        schema = None
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                data = data.as_py()
                if data is None:
                    continue
                try:
                    rows = [(p.number, p.width, p.height, p.samples_per_pixel, p.compression, p.samples, None) for p in read_pages(data)]
                except (struct.error, zlib.error, ValueError, ArithmeticError, LookupError, TypeError, MemoryError) as e:
                    rows = [(None,) * 6 + (f"{type(e).__name__}: {e}",)]
                for row in rows:
                    for c, v in zip(cols, (k.as_py(), *row), strict=True):
                        c.append(v)
            schema = schema or pa.schema([("key", batch.schema.field(0).type), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples_per_pixel", pa.int32()), ("compression", pa.int32()), ("samples", pa.binary()), ("error", pa.string())])
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, content).mapInArrow(tidy(run), f"key {kind}, page int, width int, height int, samples_per_pixel int, compression int, samples binary, error string")


def padded(raw: bytes, unit: int = WIDTH) -> bytes:
    """``raw`` with bytes 0 up to a positive multiple of ``unit``."""
    return raw + b"\0" * (-len(raw) % unit if raw else unit)


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, mean step between neighbours, and a 16-bin histogram."""
    a = np.frombuffer(samples, np.uint8)
    counts = np.bincount(a, minlength=256)
    share = counts[counts > 0] / len(a)
    values = np.arange(256)
    mean = float(counts @ values) / len(a)
    var = float(counts @ (values - mean) ** 2) / len(a)
    step = float(np.abs(np.diff(a.astype(np.int16))).mean()) if len(a) > 1 else 0.0
    bins = (counts.reshape(16, 16).sum(1) * 255 + len(a) - 1) // len(a)
    return f"{mean:.4f};{var**0.5:.4f};{float(-(share * np.log2(share)).sum()):.4f};{step:.4f};" + "".join(f"{b:02x}" for b in bins)


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


#: Compressions in the order in which a file's pages take turns; a payload's checksum says which comes first.
KINDS = (DEFLATE, PACKBITS, LZW)
TILE = 32


def store(payload: bytes) -> bytes:
    """A payload as a TIFF: strips or tiles and the first page's compression by its checksum, so equal payloads give equal files."""
    turn = zlib.crc32(payload)
    kinds = tuple(KINDS[(turn + k) % len(KINDS)] for k in range(len(KINDS)))
    return encode_tiff(payload, compression=kinds, tile=TILE if turn // len(KINDS) % 2 else None)


def text_media(docs: DataFrame) -> DataFrame:
    """Stores every text (null: empty) as a TIFF, reads the file back page by page, and describes what it read.

    Every row of ``docs`` (doc_id, text) gives one row, repeated ones too; equal texts give equal values.  A long text has a page for each
    ``PAGE_ROWS`` rows.  An empty table gives an empty result; columns besides doc_id and text are ignored.
    """

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows = []
                for text in batch.column(1):
                    raw = (text.as_py() or "").encode()
                    media = store(padded(raw))
                    back = b"".join(p.samples for p in read_pages(media))
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch([batch.column(0).cast(pa.int64()), *cols], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), MEDIA_SCHEMA)


def op7_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
