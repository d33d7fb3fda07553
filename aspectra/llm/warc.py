"""WARC archives: write, normalise to one gzip member per record, index, read back.

``write_archives`` streams each partition's records into one monolithic gzip file, the form
in which archives often arrive: nothing in it can be read without inflating all before it.
``normalise`` inflates each such stream once, in bounded chunks, rewrites every record as
a gzip member of its own and writes a sidecar index (one line per record: offset,
compressed length, record id). ``read_archives`` then seeks by the index.

Among records with equal payloads of at least ``min_revisit`` bytes the one with the smallest
id is a response and the others are revisits of it, which carry no payload but name its
digest and length. Equality is that of the SHA-256 digests.

Defined cases: a null payload is empty; a row without an id is always a response, and so is
each row that shares the smallest id; empty tables give no archives; a record is held in
memory one at a time; other columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.llm.common import shuffles_freed, slices, stash
from aspectra.llm.shared_files import new_file, open_random, open_stream
from aspectra.session import scratch_path

CHUNK = 1 << 20
GZIP = 31  # zlib's window bits for a gzip wrapper
MANIFEST = "part long, path string, n_records long, bytes long"
DATE = "1970-01-01T00:00:00Z"


def classify(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None, min_revisit: int = 100) -> DataFrame:
    """id, url, payload, n_bytes, digest, record_type, refers_to of every row.

    Only (digest, id) pairs are shuffled to find equal payloads, with partial minima first,
    and only the revisits, keyed by their own id, are joined back to the payloads."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    url = F.col(url_col) if url_col else F.lit(None)
    base = pages.select(F.col(id_col).cast("long").alias("id"), url.cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    keyed = base.where(F.col("n_bytes") >= min_revisit).select("id", "digest")
    first = keyed.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = keyed.join(first.drop("copies"), "digest").where("id > refers_to").distinct()
    out = base.join(later, ["id", "digest"], "left")
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    return out.withColumn("record_type", kind).select("id", "url", "payload", "n_bytes", "digest", "record_type", "refers_to")


def record_id(page_id: int | None) -> str:
    return "none" if page_id is None else f"urn:page:{page_id}"


def record(page_id, url, payload, n_bytes, digest, kind, refers_to) -> bytes:
    body = b"" if kind == "revisit" else payload
    head = [
        b"WARC/1.1",
        f"WARC-Type: {kind}".encode(),
        f"WARC-Record-ID: <{record_id(page_id)}>".encode(),
        f"WARC-Date: {DATE}".encode(),
        f"WARC-Payload-Digest: sha256:{digest}".encode(),
        f"X-Payload-Length: {n_bytes}".encode(),
        b"Content-Type: application/octet-stream",
        f"Content-Length: {len(body)}".encode(),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + " ".join(url.split()).encode())
    if kind == "revisit":
        head.append(f"WARC-Refers-To: <{record_id(refers_to)}>".encode())
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def write_archives(records: DataFrame, root: str) -> DataFrame:
    """One monolithic gzip file per partition; returns the stashed manifest."""

    def write(batches):
        out, n, size = None, 0, 0
        for b in slices(batches, 256):
            if out is None:
                part = TaskContext.get().partitionId()
                path, out = new_file(root, f"raw-{part:06d}", ".warc.gz")
                z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            for row in zip(*(c.to_pylist() for c in b.columns)):
                n += 1
                if packed := z.compress(record(*row)):
                    size += out.write(packed)
        if out is not None:
            size += out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_records": [n], "bytes": [size]})

    return stash(records.mapInArrow(write, MANIFEST), "warc-raw")[0]


def inflate(stream):
    """Chunks of the inflated bytes of a whole-file stream, of one member or many."""
    z, fed = zlib.decompressobj(GZIP), False
    while data := stream.read(CHUNK):
        while data:
            fed = True
            yield z.decompress(data, CHUNK)
            data = z.unconsumed_tail or z.unused_data
            if z.eof:
                z, fed = zlib.decompressobj(GZIP), False
    if fed:
        yield z.flush()
        if not z.eof:
            raise ValueError("the gzip stream is cut off")


def records_of(chunks):
    """Whole records of a WARC stream, one at a time."""
    held = bytearray()
    need = -1
    for c in chunks:
        held += c
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held:
        raise ValueError("the last record is cut off")


def one_row_a_task(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The manifest, one file per task (it has one row per file)."""
    rows = [(r["part"], r["path"]) for r in manifest.orderBy("part").select("part", "path").collect()]
    if not rows:
        return spark.createDataFrame([], "part long, path string")
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "part long, path string")


def normalise(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """Rewrite monolithic archives, a member per record, with an index beside each."""

    def rewrite(batches):
        for b in batches:
            for part, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                target, out = new_file(root, f"pages-{part:06d}", ".warc.gz")
                label = target.rpartition("/")[2].removesuffix(".warc.gz")
                index_path, index = new_file(root, label, ".idx")
                at = n = 0
                with open_stream(path) as stream:
                    for rec in records_of(inflate(stream)):
                        z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = z.compress(rec) + z.flush()
                        name = headers(rec[: rec.find(b"\r\n\r\n")])["warc-record-id"]
                        out.write(member)
                        index.write(f"{at}\t{len(member)}\t{name}\n".encode())
                        at += len(member)
                        n += 1
                out.close()
                index.close()
                row = {"part": [part], "path": [target], "index": [index_path], "n_records": [n], "bytes": [at]}
                yield pa.RecordBatch.from_pydict(row)

    schema = "part long, path string, index string, n_records long, bytes long"
    return stash(one_row_a_task(spark, manifest).mapInArrow(rewrite, schema), "warc-pages")[0]


def read_index(uri: str) -> list[tuple[int, int, str]]:
    with open_stream(uri) as f:
        lines = f.read().decode().splitlines()
    return [(int(a), int(n), name) for a, n, name in (x.split("\t") for x in lines)]


def read_member(file, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    rec = zlib.decompress(file.read_at(length, offset), GZIP)
    end = rec.find(b"\r\n\r\n")
    head = headers(rec[:end])
    return head, rec[end + 4 : end + 4 + int(head["content-length"])]


def page_of(name: str | None) -> int | None:
    tail = (name or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, pages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record by its index entry: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest (computed from the payload read back; a revisit's are its headers'), payload."""
    import hashlib

    rows = [(r["path"], r["index"]) for r in pages.orderBy("part").select("path", "index").collect()]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), "path string, idx string") if rows else spark.createDataFrame([], "path string, idx string")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def read(batches):
        for b in batches:
            for path, idx in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open_random(path) as f:
                    held: list[tuple] = []
                    size = 0
                    for offset, length, name in read_index(idx):
                        head, body = read_member(f, offset, length)
                        kind = head["warc-type"]
                        n, digest = len(body), hashlib.sha256(body).hexdigest()
                        if kind == "revisit":
                            n, digest = int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                        refers = page_of(head.get("warc-refers-to"))
                        held.append((page_of(name), head.get("warc-target-uri"), kind, refers, n, digest, body if with_payload else None))
                        size += len(body)
                        if size > 8 * CHUNK or len(held) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return df.mapInArrow(read, schema)


def archive(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", min_revisit: int = 100, root: str | None = None, with_payload: bool = False) -> DataFrame:
    """Write, normalise, index and read back all rows."""
    spark = pages.sparkSession
    root = root or scratch_path(spark, "warc")
    with shuffles_freed(spark):
        raw = write_archives(classify(pages, id_col, payload_col, url_col, min_revisit), f"{root}/raw")
    return read_archives(spark, normalise(spark, raw, f"{root}/pages"), with_payload)
