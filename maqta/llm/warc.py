"""WARC archives: writer, monolithic-gzip normaliser with a sidecar offset index, and reader.

Three steps, each a map over partitions whose rows are small manifests; the archives themselves
are files in the folder that driver and executors share.

1. ``write_archives``: records go to archives that are one gzip stream each.
2. ``normalise``: each such stream is inflated once, front to back; every record is written again
   as a gzip member of its own, and a sidecar index gets a line per record with its offset.
3. ``read_archives``: records are read back by their index lines.

A task that is run again writes files of new names; the manifest names only those of the run
that counted, so lost executors leave unread files at worst.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maqta.llm.common import drop_written, new_path, partitions, salted, table, tidy, written

LEAST_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


class WarcError(ValueError):
    """The bytes are no WARC record."""


def warc_record(kind: str, record_id: str, target: str, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One record; revisits carry no payload but the digest and size of the one they repeat."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join(target.split())}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError(f"no WARC version line: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in bounded pieces; a member that is cut short is an error."""
    d, begun = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            begun = True
            out = d.decompress(data, CHUNK)
            if out:
                yield out
            data = d.unconsumed_tail
            if d.eof:
                data, d, begun = d.unused_data, zlib.decompressobj(31), False
    while begun and not d.eof:  # what the last piece left inside
        out = d.decompress(d.unconsumed_tail, CHUNK)
        if not out:
            raise WarcError("the archive ends inside a gzip member")
        yield out


def split_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record bytes) of each record of an inflated stream."""
    held = bytearray()
    done = False

    def fill() -> bool:
        nonlocal done
        piece = next(parts, None)
        if piece is None:
            done = True
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                if held.strip():
                    raise WarcError("the archive ends inside a record head")
                return
        fields = parse_head(bytes(held[:end]))
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            raise WarcError(f"bad Content-Length {length!r}")
        size = end + 4 + int(length) + 4
        while len(held) < size:
            if not fill():
                raise WarcError("the archive ends inside a record")
        yield fields, bytes(held[:size])
        del held[:size]


def normalise_archive(files: pafs.FileSystem, source: str, to: str, index: str) -> int:
    """Rewrites a whole-file gzip stream as one member per record, and its offset index; counts records."""
    n, offset = 0, 0
    with files.open_input_stream(source, compression=None) as stream, files.open_output_stream(to, compression=None) as out, files.open_output_stream(index, compression=None) as side:
        for fields, record in split_records(inflate(stream)):
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = c.compress(record) + c.flush()
            out.write(member)
            side.write((json.dumps({"offset": offset, "length": len(member), "type": fields["warc-type"], "id": fields["warc-record-id"], "uri": fields.get("warc-target-uri", ""), "digest": fields.get("warc-payload-digest", "")}, ensure_ascii=False) + "\n").encode())
            offset += len(member)
            n += 1
    return n


def read_records(files: pafs.FileSystem, path: str, index: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of each record that the index names, read by offset."""
    with files.open_input_stream(index, compression=None) as side:
        entries = [json.loads(x) for x in side.read().decode().splitlines() if x]
    with files.open_input_file(path) as f:
        for e in entries:
            f.seek(e["offset"])
            record = zlib.decompress(f.read(e["length"]), 31)
            end = record.index(b"\r\n\r\n")
            fields = parse_head(record[:end])
            yield fields, record[end + 4 : end + 4 + int(fields["content-length"])]


def with_records(pages: DataFrame, page_id: str = "page_id", html: Column | None = None) -> DataFrame:
    """pages as records: page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to."""
    payload = F.coalesce(F.encode(F.col("html") if html is None else html, "UTF-8"), F.lit(b""))
    base = pages.select(F.col(page_id).alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload"))
    base = base.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))
    groups = base.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # Stored, so that a small table of groups meets the payloads where they are; a large one meets each group in eight tasks.
    groups = written(groups.where("n > 1").select("payload_digest", "first_id"), "warc-groups")
    base = salted(base, groups, "payload_digest", F.monotonically_increasing_id(), how="left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return base.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records as whole-file gzip archives; gives the manifest: path, records."""

    def run(batches):
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        done, out, c, path, n, size = [], None, None, "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(c.flush())
                out.close()
                done.append((path, n))
                out = None

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, c = files.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                revisit = r["record_type"] == "revisit"
                ident = "" if r["page_id"] is None else str(r["page_id"])
                rec = warc_record(r["record_type"], ident, r["url"], b"" if revisit else r["payload"], r["payload_digest"], r["payload_bytes"], str(r["refers_to"]) if revisit else None)
                out.write(c.compress(rec))
                n, size = n + 1, size + len(rec)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.record_batch([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    return written(records.mapInArrow(tidy(run), "path string, records long"), "warc-written")


def _by_archive(manifest: DataFrame) -> DataFrame:
    """A manifest is a row per archive, so it is dealt out to a task per archive or so."""
    return manifest.repartition(partitions(manifest.sparkSession), "path")


def normalise(manifest: DataFrame, folder: str, drop_source: bool = True) -> DataFrame:
    """Normalises each archive of a manifest; gives path, index_path, records of the new ones.

    The source streams are deleted once the whole manifest of new archives is stored.
    """

    def run(batches):
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = []
            for source in batch.column(0).to_pylist():
                stem = source.removesuffix(".warc.gz") + "-" + uuid.uuid4().hex[:8]
                rows.append((f"{stem}.rec.warc.gz", f"{stem}.idx", normalise_archive(files, source, f"{stem}.rec.warc.gz", f"{stem}.idx")))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["path", "index_path", "records"])

    out = written(_by_archive(manifest).mapInArrow(tidy(run), "path string, index_path string, records long"), "warc-normal")
    if drop_source:

        def drop(batches):
            files, _ = pafs.FileSystem.from_uri(folder)
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    if files.get_file_info(path).type == pafs.FileType.File:
                        files.delete_file(path)
                yield batch.slice(0, 0)

        _by_archive(manifest).select("path").mapInArrow(drop, "path string").count()
        drop_written(manifest)
    return out


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of normalised archives; responses' digest and size come from the payload read, revisits' from their heads.

    A response whose payload does not have the digest of its header is an error.
    """

    def ident(text: str) -> int | None:
        inner = text[len("<urn:page:") : -1]
        return int(inner) if inner else None

    def run(batches):
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for f, payload in read_records(files, path, index):
                    stated = f["warc-payload-digest"].removeprefix("sha256:")
                    if f["warc-type"] == "response":
                        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                        if digest != stated:
                            raise WarcError(f"payload of {f['warc-record-id']} differs from its digest")
                    else:
                        digest, size = stated, int(f["x-payload-length"])
                    rows.append((ident(f["warc-record-id"]), f.get("warc-target-uri", ""), size, digest, f["warc-type"], ident(f["warc-refers-to"]) if "warc-refers-to" in f else None, payload if payloads else None))
                    held += len(payload)
                    if held > 1 << 24:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows(rows)

    return _by_archive(manifest).select("path", "index_path").mapInArrow(tidy(run), READ_SCHEMA)


def with_originals(read: DataFrame) -> DataFrame:
    """``read`` with the digest and size of revisits taken from the response that they refer to, which must be the ones they state."""
    read = written(read, "warc-read")
    revisits = read.where("record_type = 'revisit'")
    originals = read.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("digest"))
    wanted = revisits.select("refers_to").distinct()
    originals = written(originals.join(wanted, "refers_to", "left_semi").dropDuplicates(["refers_to", "digest"]), "warc-originals")
    found = salted(revisits.withColumn("_to", F.struct("refers_to", "payload_digest")), originals.withColumn("_to", F.struct("refers_to", F.col("digest").alias("payload_digest"))).drop("refers_to"), "_to", F.monotonically_increasing_id(), how="left").drop("_to")
    wrong = F.raise_error(F.concat(F.lit("no response has the payload of the revisit of page "), F.col("page_id").cast("string")))
    same = F.col("size").eqNullSafe(F.col("payload_bytes"))
    found = found.withColumn("payload_bytes", F.when(same, F.col("size")).otherwise(wrong.cast("long"))).withColumn("payload_digest", F.col("digest"))
    return read.where("record_type <> 'revisit'").unionByName(found.select(*read.columns))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def warc_round_trip(pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Pages through archives and back: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Null html is an empty payload; null urls are empty.  Of equal payloads of ``LEAST_REVISIT``
    bytes or more, rows with the smallest page_id (all of them, if it repeats) are responses and
    the rest revisits, whose digest and size are those of the response read back.  Payloads of any length are stored whole.
    An empty table gives no archive and an empty result.  Columns besides page_id, url and html are ignored.
    """
    folder = new_path(pages.sparkSession, "warc")
    whole = write_archives(with_records(pages), folder)
    return with_originals(read_archives(normalise(whole, folder), folder, payloads))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS m FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM m THEN m END AS refers_to FROM f
"""
