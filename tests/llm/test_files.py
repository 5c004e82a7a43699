"""WARC and TIFF round trips."""

import gzip
import hashlib
import io
import random
import zlib

import pytest
from pyarrow import fs as pafs

from maqta.llm import tiff, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 40
    rows = [(5, "http://a/1", big), (3, None, big), (9, "http://a/2", "x\r\n\r\nWARC/1.1\r\n"), (7, "http://a/3", None), (8, "u\n v", ""), (10, "b", "small"), (11, "b", "small"), (12, "c", "y" * 300_000), (3, "twin", big)]
    got = warc.warc_round_trip(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, u, h in rows if i == r["page_id"])
        raw = (html or "").encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == hashlib.sha256(raw).hexdigest()
        again = html == big and r["page_id"] != 3
        assert r["record_type"] == ("revisit" if again else "response") and r["refers_to"] == (3 if again else None)
        assert r["payload"] == (b"" if again else raw)
    assert warc.warc_round_trip(pages(spark, []).limit(0)).count() == 0


def test_normalised_archives_are_members(tmp_path):
    records = [warc.warc_record("response", str(i), f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), len(p)) for i, p in enumerate([b"", b"abc\r\n\r\n", random.Random(1).randbytes(3_000_000), b"z"])]
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"".join(records)))
    files = pafs.LocalFileSystem()
    n = warc.normalise_archive(files, str(tmp_path / "a.gz"), str(tmp_path / "b.gz"), str(tmp_path / "b.idx"))
    assert n == 4
    data = (tmp_path / "b.gz").read_bytes()
    assert gzip.decompress(data) == b"".join(records)
    got = list(warc.read_records(files, str(tmp_path / "b.gz"), str(tmp_path / "b.idx")))
    assert [p for _, p in got] == [r.split(b"\r\n\r\n", 1)[1][:-4] for r in records]


@pytest.mark.parametrize("cut", [5, 60, -3])
def test_broken_archives_are_errors(cut):
    record = warc.warc_record("response", "1", "u", b"abcdef", "d", 6)
    with pytest.raises((warc.WarcError, KeyError)):
        list(warc.split_records(iter([record[:cut]])))


@pytest.mark.parametrize("length", ["", "x", "-4", "²"])
def test_bad_content_lengths_are_errors(length):
    with pytest.raises(warc.WarcError):
        list(warc.split_records(iter([f"WARC/1.1\r\nContent-Length: {length}\r\n\r\nabcd\r\n\r\n".encode()])))


def test_archives_cut_after_a_whole_record_are_errors():
    records = b"".join(warc.warc_record("response", str(i), "u", random.Random(i).randbytes(5000), "d", 5000) for i in range(3))
    data = gzip.compress(records)
    with pytest.raises(warc.WarcError):
        list(warc.inflate(io.BytesIO(data[:-9])))
    assert b"".join(warc.inflate(io.BytesIO(data))) == records


def test_revisits_are_held_against_their_response(spark):
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    good = [(1, "", 200, "aa", "response", None, None), (2, "", 200, "aa", "revisit", 1, None), (3, "", 200, "aa", "revisit", 1, None)]
    assert warc.with_originals(spark.createDataFrame(good, schema)).count() == 3
    for bad in [(4, "", 200, "bb", "revisit", 1, None), (4, "", 201, "aa", "revisit", 1, None), (4, "", 200, "aa", "revisit", 9, None)]:
        with pytest.raises(Exception, match="no response has the payload"):
            warc.with_originals(spark.createDataFrame([*good, bad], schema)).collect()


def test_several_gzip_members_are_one_stream():
    data = gzip.compress(b"ab") + gzip.compress(b"cd" * 2_000_000)
    assert b"".join(warc.inflate(io.BytesIO(data))) == b"ab" + b"cd" * 2_000_000


@pytest.mark.parametrize("compression", list(tiff.ENCODE))
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    rng = random.Random(compression)
    for n in (64, 64 * 3, 64 * 700):
        payload = b"".join(rng.choice([rng.randbytes(64), b"a" * 64, b"ab" * 32]) for _ in range(n // 64))
        data = tiff.encode_tiff(payload, compression=compression, predictor=predictor, strip_rows=50, page_rows=300)
        found = list(tiff.read_pages(data))
        assert b"".join(p.samples for p in found) == payload and len(found) == -(-n // 64 // 300)


@pytest.mark.parametrize("predictor", [1, 2])
def test_tiles_and_compressions_by_turns(predictor):
    rng = random.Random(predictor)
    for n in (1, 5, 40, 700):
        payload = b"".join(rng.choice([rng.randbytes(64), b"a" * 64, b"ab" * 32]) for _ in range(n))
        data = tiff.encode_tiff(payload, compression=tiff.KINDS, predictor=predictor, page_rows=100, tile=32)
        found = list(tiff.read_pages(data))
        assert b"".join(p.samples for p in found) == payload
        assert [p.compression for p in found] == [tiff.KINDS[k % 3] for k in range(-(-n // 100))]


def test_codecs_round_trip():
    rng = random.Random(3)
    for n in (0, 1, 2, 127, 128, 129, 300, 20_000):
        for data in (rng.randbytes(n), b"x" * n, bytes(rng.choice(b"abc") for _ in range(n))):
            assert tiff.unpackbits(tiff.packbits(data), n) == data and tiff.unlzw(tiff.lzw(data), n) == data
            assert tiff.unpackbits(tiff.packbits(data), n // 2) == data[: n // 2] == tiff.unlzw(tiff.lzw(data), n // 2)


def plain_lzw_codes(data):
    """Codes of an LZW stream and their widths, read bit by bit."""
    bits, at, since, codes = "".join(f"{b:08b}" for b in data), 0, 0, []
    while not codes or codes[-1] != 257:
        width = 9 if since < 254 else 10 if since < 766 else 11 if since < 1790 else 12
        codes.append(int(bits[at : at + width], 2))
        at, since = at + width, 0 if codes[-1] == 256 else since + 1
    assert len(bits) - at < 8
    return codes


def test_lzw_by_the_bit():
    rng = random.Random(5)
    for data in (b"", b"a", b"a" * 9000, bytes(range(256)) * 3, rng.randbytes(12_000), rng.randbytes(3836), rng.randbytes(3837), rng.randbytes(3838)):
        words, old, out = {i: bytes((i,)) for i in range(256)}, b"", b""
        for code in plain_lzw_codes(tiff.lzw(data)):
            if code == 256:
                words, old = {i: bytes((i,)) for i in range(256)}, b""
            elif code != 257:
                word = words[code] if code in words else old + old[:1]
                if old:
                    words[len(words) + 2] = old + word[:1]
                old, out = word, out + word
        assert out == data
        assert tiff.unlzw(tiff.lzw(data), len(data)) == data


def test_lzw_without_clears():
    """A full table stays as it is; codes go on with 12 bits."""
    data = random.Random(6).randbytes(9000)
    bits = "".join(f"{b:0{int(w)}b}" for b, w in zip([256, *data, 257], [9, *tiff.WIDTHS, *[12] * 9000], strict=False))
    packed = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    assert tiff.unlzw(packed, len(data)) == data


def test_packbits_runs():
    for n in (1, 2, 3, 127, 128, 129, 130, 131, 255, 256, 257, 258, 300):
        for data in (b"x" * n, b"ab" + b"x" * n + b"cd", bytes(range(200)) + b"x" * n + b"y" * 3):
            assert tiff.unpackbits(tiff.packbits(data), len(data)) == data
    assert tiff.packbits(b"") == b"" and tiff.packbits(b"x" * 300) == bytes((129, 120, 129, 120, 213, 120))


def test_tiles_and_big_endian():
    import struct

    width, height, w, h = 40, 20, 16, 16
    rows = [[(7 * x + 3 * y) % 256 for x in range(width)] for y in range(height)]
    tiles = []
    for top in range(0, height, h):
        for left in range(0, width, w):
            tiles.append(zlib.compress(b"".join(bytes(rows[y][x] if y < height and x < width else 0 for x in range(left, left + w)) for y in range(top, top + h))))
    out, places = bytearray(b"MM\0*\0\0\0\0"), []
    for t in tiles:
        places.append(len(out))
        out += t
    at = len(out)
    out += struct.pack(f">{len(tiles)}I", *places) + struct.pack(f">{len(tiles)}I", *map(len, tiles))
    struct.pack_into(">I", out, 4, len(out))
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 8 << 16), (259, 3, 1, 8 << 16), (322, 4, 1, w), (323, 4, 1, h), (324, 4, len(tiles), at), (325, 4, len(tiles), at + 4 * len(tiles))]
    out += struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0\0\0\0"
    (page,) = tiff.read_pages(bytes(out))
    assert page.samples == b"".join(map(bytes, rows)) and (page.width, page.height) == (width, height)


def test_pages_table(spark):
    good = tiff.encode_tiff(b"abcd" * 16 * 5, page_rows=2)
    df = spark.createDataFrame([(1, good), (2, None), (3, b"junk"), (4, good[:40])], "k long, content binary")
    rows = tiff.tiff_pages(df, "content", "k").orderBy("key", "page").collect()
    assert [(r["key"], r["page"]) for r in rows if r["error"] is None] == [(1, 0), (1, 1), (1, 2)]
    assert {r["key"] for r in rows if r["error"]} == {3, 4}


def tiff_of(*tags, body=b""):
    """A little-endian TIFF of one image directory, ``body`` standing behind the header."""
    import struct

    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0"


def test_bad_files_give_error_rows_and_no_memory(spark):
    strip = [(258, 3, 1, 8), (273, 4, 1, 8), (279, 4, 1, 2)]
    bad = {
        "no width": tiff_of((257, 4, 1, 4), *strip, body=b"ab"),
        "tile of width 0": tiff_of((256, 4, 1, 4), (257, 4, 1, 4), (258, 3, 1, 8), (322, 4, 1, 0), (323, 4, 1, 16), (324, 4, 1, 8), (325, 4, 1, 2), body=b"ab"),
        "too large": tiff_of((256, 4, 1, 2_000_000_000), (257, 4, 1, 2_000_000), *strip, body=b"ab"),
        "large for its file": tiff_of((256, 4, 1, 30_000), (257, 4, 1, 30_000), *strip, body=b"ab"),
        "strip outside": tiff_of((256, 4, 1, 1), (257, 4, 1, 2), (258, 3, 1, 8), (273, 4, 1, 8000), (279, 4, 1, 2), body=b"ab"),
        "strip too short": tiff_of((256, 4, 1, 3), (257, 4, 1, 1), *strip, body=b"ab"),
        "chain": tiff_of(*strip)[:-4] + b"\x08\0\0\0",
        "lzw": tiff_of((256, 4, 1, 2), (257, 4, 1, 1), (259, 3, 1, 5), *strip, body=b"\xff\xff"),
    }
    good = tiff_of((256, 4, 1, 1), (257, 4, 1, 2), *strip, body=b"ab")
    rows = tiff.tiff_pages(spark.createDataFrame([*bad.items(), ("good", good)], "k string, content binary"), "content", "k").collect()
    assert {r["key"] for r in rows if r["error"]} == set(bad) and len(rows) == len(bad) + 1
    assert [bytes(r["samples"]) for r in rows if r["error"] is None] == [b"ab"]


def brute_feature(samples):
    import math

    n = len(samples)
    mean = sum(samples) / n
    count = {v: samples.count(v) for v in set(samples)}
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    steps = [abs(a - b) for a, b in zip(samples, samples[1:])]
    bins = [sum(c for v, c in count.items() if v // 16 == k) for k in range(16)]
    head = (mean, math.sqrt(sum((x - mean) ** 2 for x in samples) / n), entropy, sum(steps) / len(steps))
    return ";".join(f"{x + 0.0:.4f}" for x in head) + ";" + "".join(f"{-(-255 * b // n):02x}" for b in bins)


def test_text_media_features_and_files(spark):
    rng = random.Random(5)
    texts = ["", "a", "héllo wörld " * 9] + ["".join(rng.choice("abc déß\n") for _ in range(rng.randint(1, 900))) for _ in range(25)]
    rows = tiff.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kinds, layouts = set(), set()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        media = tiff.store(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert [float(x) for x in r["feature"].split(";")[:4]] == pytest.approx([float(x) for x in brute_feature(payload).split(";")[:4]], abs=2e-4)
        assert r["feature"].split(";")[4] == brute_feature(payload).split(";")[4]
        kinds |= {p.compression for p in tiff.read_pages(media)}
        layouts.add(b"\x42\x01" in media)  # the tag of a tile's width
    assert kinds == set(tiff.KINDS) and layouts == {True, False}


def test_text_media(spark):
    texts = {1: "abc", 2: None, 3: "", 4: "é" * 64, 5: "long " * 300_000, 6: "abc", 7: "x" * 64}
    got = {r["doc_id"]: r for r in tiff.text_media(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        raw = (t or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert tuple(got[1])[1:] == tuple(got[6])[1:]
