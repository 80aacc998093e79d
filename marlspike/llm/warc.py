"""WARC archives as a table of chunks.

A payload leaves the scan as rows (record, chunk number, bytes) of at most CHUNK bytes; these are what is shuffled, sorted by
record and chunk number. The archive is written and read chunk by chunk with running SHA-1 digests, so that no worker
holds a whole oversized record. Archives are gzip files with one member per record; each task writes files of its own (a
fresh name per attempt) into the shared folder, and the manifest, a Parquet table, names the files of the attempts that
Spark committed.

Of records with equal payloads of at least min_bytes, that with the largest key is a response and the others are revisits;
this is decided from a light table of keys, digests and lengths alone.

Cases: a null payload is empty; every row has a record, rows with equal key and payload are told apart by a row number in
the record id; a null key counts as the smallest and stays null; any string is a key, kept exactly; a key with several
payloads has a record for each; other columns of pages are left out, whatever their names; an empty table gives no
archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.llm.common import fresh_path, map_arrow, table

CHUNK = 1 << 20
#: An archive is closed beyond this many bytes.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 18
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

MANIFEST = "path string, records long, bytes long"
CHUNKS = "key string, url string, record_type string, refers_to string, declared_digest string, chunk long, data binary, payload_bytes long, payload_digest string, last boolean"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _capture(key: str = "key") -> Column:
    """One name for key and digest."""
    return F.concat_ws(":", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n")), "digest")


def verdicts(light: DataFrame, min_bytes: int = 0) -> DataFrame:
    """capture, several (rows with that key and payload), and for revisits winner, several_winner; from rows (key, digest,
    bytes). Captures that stand once and have no larger key are left out."""
    each = light.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("several"), F.max("bytes").alias("bytes"))
    largest = each.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max(F.struct(F.col("key").alias("winner"), F.col("several").alias("several_winner"))).alias("most"), F.count(F.lit(1)).alias("keys"))
    named = each.join(largest.where("keys > 1").select("digest", "most.*", F.lit(True).alias("shared")), "digest", "left")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("key").eqNullSafe(F.col("winner"))
    return named.select(_capture().alias("capture"), "several", revisit.alias("revisit"), "winner", "several_winner").where("revisit or several > 1")


def chunked(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table: a row for each chunk, in order, of each row of pages, whose chunks stand in one partition."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload")).withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    verdict = verdicts(rows.select("key", "digest", "bytes"), min_bytes)
    last = F.greatest(F.ceil(F.col("bytes") / F.lit(chunk)).cast("long") - 1, F.lit(0))
    numbered = rows.withColumns({"row": F.monotonically_increasing_id(), "last_chunk": last}).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_chunk"))))
    data = F.substring(F.col("payload"), (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk))
    pieces = numbered.select("key", "url", "digest", "bytes", "row", "chunk", data.alias("data"), (F.col("chunk") == F.col("last_chunk")).alias("last"), _capture().alias("capture"))
    # a revisit is its first chunk's row, without data
    joined = pieces.join(verdict, "capture", "left").where(~F.coalesce("revisit", F.lit(False)) | (F.col("chunk") == 0))
    revisit = F.coalesce("revisit", F.lit(False))
    out = joined.select(
        "capture", F.col("key").cast("string").alias("key"), "url", "digest", "bytes", "row", (F.coalesce("several", F.lit(1)) > 1).alias("repeated"),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(revisit, F.col("winner").cast("string")).alias("refers_to"), (F.coalesce("several_winner", F.lit(1)) > 1).alias("refers_to_repeated"),
        "chunk", F.when(~revisit, F.col("data")).alias("data"), (F.col("last") | revisit).alias("last"),
    )
    return out.sortWithinPartitions("capture", "row", "chunk").drop("capture")


def _record_id(key: str | None, digest: str, row: int | None = None) -> str:
    return f"urn:page:{'' if key is None else 'k' + quote(key, safe='')}:{digest}" + ("" if row is None else f":{row}")


def _head(row: dict) -> bytes:
    digest = _base32(bytes.fromhex(row["digest"]))
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_record_id(row['key'], digest, row['row'] if row['repeated'] else None)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["url"]:
        lines.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {row['bytes']}"]
    if row["key"] is not None:
        lines.append("X-Key: " + quote(row["key"], safe=""))
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if not row["refers_to_repeated"]:
            lines.append(f"WARC-Refers-To: <{_record_id(row['refers_to'], digest)}>")
        if row["refers_to"] is not None:
            lines.append("X-Refers-To-Key: " + quote(row["refers_to"], safe=""))
    body = len(HTTP_HEAD) + (row["bytes"] if row["record_type"] == "response" else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {body}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + HTTP_HEAD


def write_archives(chunks: DataFrame, folder: str, level: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the chunked record table as .warc.gz files below folder (any URI that pyarrow opens); the manifest of the files."""

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = packer = digest = None
        path, records, size = "", 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                if row["chunk"] == 0:
                    if out and size >= archive_bytes:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})
                        out = None
                    if not out:
                        path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(path, compression=None)
                    packer, digest = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                    data = packer.compress(_head(row))
                    size += len(data)
                    out.write(data)
                if row["record_type"] == "response" and row["data"]:
                    digest.update(row["data"])
                    data = packer.compress(row["data"])
                    size += len(data)
                    out.write(data)
                if row["last"]:
                    if row["record_type"] == "response" and digest.hexdigest() != row["digest"]:
                        raise ValueError(f"payload of {row['key']} changed while it was written")
                    data = packer.compress(b"\r\n\r\n") + packer.flush()
                    size += len(data)
                    out.write(data)
                    records += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

    return table(map_arrow(chunks, run, MANIFEST), "warc-manifest")


def _members(stream) -> Iterator[bytes | None]:
    """The inflated bytes of a gzip file in pieces; None ends a member."""
    inflate = zlib.decompressobj(31)
    rest = b""
    while True:
        data = rest or stream.read(READ_BYTES)
        rest = b""
        if not data:
            return
        piece = inflate.decompress(data, CHUNK)
        if piece:
            yield piece
        rest = inflate.unconsumed_tail
        if inflate.eof:
            yield None
            rest = inflate.unused_data
            inflate = zlib.decompressobj(31)


def _field(fields: dict[str, str], name: str) -> str | None:
    return unquote(fields[name]) if name in fields else None


def _records(stream, chunk: int) -> Iterator[dict]:
    """The chunk rows of an archive, in order."""
    head, fields, left, skip = b"", None, 0, b""
    number, total, digest, data = 0, 0, None, bytearray()
    for piece in _members(stream):
        if piece is None:
            if fields is None or left:
                raise ValueError("a record ends before its length")
            revisit = fields["warc-type"] == "revisit"
            declared = fields["warc-payload-digest"].removeprefix("sha1:")
            final = declared if revisit else _base32(digest.digest())
            common = {"key": _field(fields, "x-key"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": _field(fields, "x-refers-to-key"), "declared_digest": declared}
            yield common | {"chunk": number, "data": bytes(data), "payload_bytes": int(fields["x-payload-length"]) if revisit else total, "payload_digest": final, "last": True}
            head, fields, left = b"", None, 0
            continue
        if fields is None:
            head += piece
            end = head.find(b"\r\n\r\n")
            if end < 0:
                continue
            fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head[:end].decode().split("\r\n")[1:])}
            piece, head = head[end + 4 :], b""
            left, skip = int(fields["content-length"]), b""
            number, total, digest, data = 0, 0, hashlib.sha1(), bytearray()
            in_http = True
        piece = piece[:left]
        left -= len(piece)
        if in_http:
            skip += piece
            end = skip.find(b"\r\n\r\n")
            if end < 0:
                continue
            piece, skip, in_http = skip[end + 4 :], b"", False
        digest.update(piece)
        total += len(piece)
        data += piece
        while len(data) > chunk:
            yield {"key": _field(fields, "x-key"), "url": None, "record_type": fields["warc-type"], "refers_to": None, "declared_digest": None, "chunk": number, "data": bytes(data[:chunk]), "payload_bytes": total, "payload_digest": _base32(digest.digest()), "last": False}
            del data[:chunk]
            number += 1


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, chunk: int = CHUNK, partitions: int | None = None) -> DataFrame:
    """The chunked record table of the archives in the manifest: each row has the bytes and digest of the payload so far."""
    schema = spark.createDataFrame([], CHUNKS).schema
    names = schema.names
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for row in _records(stream, chunk):
                        rows.append(row)
                        size += len(row["data"])
                        if size >= 4 * chunk or len(rows) >= 1024:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names=names)

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(manifest.select("path").repartition(n, "path"), run, schema)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes every row as a record; the manifest and the folder."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return write_archives(chunked(pages, key, url, payload, min_bytes), folder), folder
