"""Sharded WARC writer and reader.

Records are range-sorted by page_id, in ranges that follow from the counted ids
alone, so the same pages give the same files however they are partitioned; each task writes its range as one or more
gzip-per-record files, starting a new file once the compressed size of the
current one reaches the limit.  Headers (type, ids, lengths, block and payload
digests) are made anew from the payload.  Records whose payload of at least 1000
bytes equals that of a record with a larger page_id are revisits of it.

Every file is written under a temporary name of its task attempt and renamed to
its range and shard at its end (an attempt that comes again writes the same
bytes); a manifest row (path, bytes, records, digest of the file) is what commits
it.  The manifest is a Parquet table written by Spark's own commit
protocol, so files of lost or repeated attempts are never named by it.

Paths go through pyarrow's file systems: any store that all executors share.

Defined cases: null html is an empty payload, null url the target
``urn:page:<id>``; equal large payloads with the same page_id (repeated rows):
one row of them is the response, the others revisit it; null page_id sorts
first, is written with an empty id and never refers; an empty table writes no
file and reads back no row; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.common import table, work_folder
from tapeworks.llm.registry import query
from tapeworks.plans.series import Series

ROLL_BYTES = 16 << 20
PART_BYTES = 16 << 20  # of payload that a range of ids should have
SLICE_IDS = 8192  # ids that a task counts along
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"  # records carry no crawl time
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "path string, n_bytes bigint, n_records bigint, first_id bigint, last_id bigint, sha1 string"


def open_path(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def b32(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """One gzip member."""
    pid = "" if page_id is None else str(page_id)
    head = HTTP % len(payload)
    revisit = refers is not None
    block = head if revisit else head + payload
    payload_sha1 = hashlib.sha1(payload).digest()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{pid}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri_of(url, pid)}",
        f"WARC-Payload-Digest: {b32(payload_sha1)}",
        f"WARC-Block-Digest: {b32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-ID: {pid}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers}')}>",
            f"X-Refers-To-Page-ID: {refers}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def uri_of(url: str | None, pid: str) -> str:
    """A header value has one line and no spaces."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:page:{pid}"


def keyed(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Rows of two kinds for the writer: pages with their payload, and for each
    page whose large payload is shared a small note (page_id, digest, last) that
    sorts before it.  Payloads are shuffled once, by range; what is grouped and
    joined is digests."""
    p = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    )
    digests = p.where(F.octet_length("payload") >= min_bytes).select("page_id", F.unhex(F.sha2("payload", 256)).alias("digest")).where("page_id IS NOT NULL")
    shared = digests.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    notes = digests.distinct().join(shared, "digest").select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("digest").alias("payload"), "last")
    return notes.union(p.select("page_id", F.lit(1), "url", "payload", F.lit(None).cast("bigint")))


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of the writer in sorted ranges of page_id with about ``PART_BYTES``
    of payload each.  The ranges come from counts of the ids, not from a sample,
    so any partitioning of the same pages gives the same shards."""
    own = rows.where("kind = 1")
    total = own.agg(F.sum(F.octet_length("payload")).alias("b")).first()["b"] or 0
    n = max(1, -(-total // PART_BYTES))
    cells = own.where("page_id IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("_c")).withColumn("_all", F.lit(0))
    counted = Series.of(cells, ["_all"], ["page_id"], max_rows=SLICE_IDS, block_rows=SLICE_IDS).totals(_t=F.sum("_c")).running(_cum=("sum", "_c")).df
    starts = counted.groupBy(F.floor((F.col("_cum") - F.col("_c")) * n / F.col("_t")).alias("k")).agg(F.min("page_id").alias("lo"))
    # at most n starts, cut into about sqrt(n) lists, so that a lookup is short
    m = max(1, round(n**0.5))
    lists = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("s"), F.lit(1)) - 1) / m).cast("int")), lambda g: F.slice("s", g * m + 1, m))
    bounds = starts.agg(F.sort_array(F.collect_list("lo")).alias("s")).select(lists.alias("_lists"))
    group = F.greatest(F.size(F.filter("_lists", lambda b: F.get(b, F.lit(0)) <= F.col("page_id"))) - 1, F.lit(0))
    inside = F.size(F.filter(F.get("_lists", group), lambda b: b <= F.col("page_id"))) - 1
    part = F.when(F.col("page_id").isNull(), 0).otherwise(F.greatest(group * m + inside, F.lit(0)))
    placed = rows.join(F.broadcast(bounds), F.lit(True)).withColumn("_part", part.cast("int")).drop("_lists")
    return placed.repartitionById(n, "_part").drop("_part").sortWithinPartitions("page_id", "kind", "payload", "url")


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` below ``folder`` and return the manifest."""
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_path(f"{folder}/data")
        store.create_dir(root, recursive=True)
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), f"{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        shard = n_bytes = n = 0
        first = last = None
        sha, out, temp = None, None, ""
        shared: dict[bytes, int] = {}  # of the page_id at hand: digest, largest page_id that has it
        owner = None
        answered: tuple = ()

        def close() -> pa.RecordBatch:
            nonlocal shard, out
            out.close()
            name = f"{root}/part-{part:05d}-{shard:05d}.warc.gz"
            if store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_file(name)  # of an attempt that was lost, with the same bytes
            store.move(temp, name)
            shard, out = shard + 1, None
            row = [[f"{folder}/data/{name.rsplit('/', 1)[1]}"], [n_bytes], [n], [first], [last], [sha.hexdigest()]]
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["path", "n_bytes", "n_records", "first_id", "last_id", "sha1"])

        try:
            for b in batches:
                for pid, kind, url, payload, to in zip(*(b.column(i).to_pylist() for i in range(5))):
                    if pid != owner:
                        owner, shared = pid, {}
                    if kind == 0:
                        shared[payload] = to
                        continue
                    refers = None
                    if shared and len(payload) >= min_bytes and (digest := hashlib.sha256(payload).digest()) in shared:
                        if shared[digest] == pid:  # the response; a row that repeats it revisits it
                            if answered == (pid, digest):
                                refers = pid
                            answered = (pid, digest)
                        else:
                            refers = shared[digest]
                    data = record(pid, url, payload, refers)
                    if out is None:
                        temp = f"{root}/.tmp-{part:05d}-{shard:05d}-{attempt}"
                        out, sha, n_bytes, n, first = store.open_output_stream(temp, compression=None), hashlib.sha1(), 0, 0, pid
                    out.write(data)
                    sha.update(data)
                    n_bytes, n, last = n_bytes + len(data), n + 1, pid
                    if n_bytes >= roll_bytes:
                        yield close()
            if out is not None:
                yield close()
        finally:
            if out is not None:
                out.close()

    ready = dealt(keyed(pages, min_bytes))
    ready.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one at a time."""
    with store.open_input_stream(path, compression=None) as f:
        unpack, out = zlib.decompressobj(31), []
        data = f.read(1 << 20)
        while data:
            out.append(unpack.decompress(data))
            if unpack.eof:
                yield b"".join(out)
                data, unpack, out = unpack.unused_data, zlib.decompressobj(31), []
            else:
                data = b""
            data = data or f.read(1 << 20)
        if out:
            raise OSError(f"{path} ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if b32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
        raise OSError(f"block digest of {fields['WARC-Record-ID']} differs")
    return fields, block


def read(manifest: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (bare
    hex SHA-1 of the full payload), payload (null for revisits)."""
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, local = open_path(path)
                rows, size, total = [], 0, 0
                for raw in members(store, local):
                    f, block = parse(raw)
                    kind = f["WARC-Type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    digest = base64.b32decode(f["WARC-Payload-Digest"][5:])
                    if payload is not None and hashlib.sha1(payload).digest() != digest:
                        raise OSError(f"payload digest of {f['WARC-Record-ID']} differs")
                    rows.append((int(f["X-Page-ID"]) if f["X-Page-ID"] else None, f["WARC-Target-URI"], kind, int(f["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in f else None, int(f["X-Payload-Length"]), digest.hex(), payload))
                    size, total = size + len(raw), total + 1
                    if size >= 4 << 20:
                        yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if total != count:
                    raise OSError(f"{path} has {total} records, its manifest {count}")
                if rows:
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    files = manifest.select("path", "n_records")
    return files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2), "path").mapInArrow(run, schema)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read(write(pages, work_folder(spark, "warc")))


SQL = """
SELECT page_id, octet_length(p) AS payload_bytes, sha1(p) AS payload_digest,
  CASE WHEN octet_length(p) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(p) >= 1000 AND page_id < last THEN last END AS refers_to
FROM (SELECT page_id, encode(coalesce(html, '')) AS p, max(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS last FROM pages)
"""


@query("op10_warc", SQL)
def op10_warc(spark, sf):
    back = archive(spark, table(spark, sf, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
