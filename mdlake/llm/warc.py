"""WARC archives and their globally ordered index.

Pages are written as records of gzip-compressed WARC files in the shared
folder, one gzip member a record, each file of a bounded size; then the
archives are read back. Of pages with equal payloads one is a ``response``
record and the others ``revisit`` it. Reading an archive gives a run: its
captures, sorted by URL key and timestamp. Runs are merged externally: they
are dealt to ranges of the key, and in each range a loser tree merges the
slices of all runs, so that the ranges together are the capture history of
all archives in order. A shuffle may deliver a run in pieces; each ascending
stretch counts as a run, so nothing is sorted again.

A file is named by its task attempt and known only by the index rows of the
attempt that was committed, so lost executors and repeated tasks leave files
that nothing reads. Ranges are of (URL key, timestamp, identifier): a host or
URL with a third of all captures is split.

Defined cases: a null payload is empty; payloads below ``min_bytes`` are never
revisited; rows that repeat both identifier and payload are alike: all are
responses if theirs is the smallest identifier; a null identifier refers to
the smallest other one, or is a response; a null URL has an empty key and
comes back as null; control characters and spaces of a URL come back
percent-encoded; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdlake.llm._shared import salted_join, scratch_path, written
from mdlake.llm.bloom import flagged

#: Compressed bytes after which a new archive is begun.
ARCHIVE_BYTES = 64 << 20
#: Archives that one task reads, where there are more than cores.
TASK_ARCHIVES = 16
#: Captures that one task merges, about.
RANGE_ROWS = 200_000
#: Fixed value of the format: the profile of a revisit that names the same payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:mdlake:page:"

_INDEX = "archive string, record_offset long, record_bytes long"
_RUN = (
    "page_id string, url string, url_key string, captured string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to string, archive string, record_offset long, record_bytes long"
)


def _qualified(spark, path: str) -> str:
    """``path`` with the scheme of its file system, as pyarrow reads it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub(r"\Afile:/+", "file:///", full)


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, captured: str, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC record: an HTTP response, or a revisit with its headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{quote(page_id or '', safe='')}>",
        f"WARC-Date: {captured}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    if revisit:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{_ID}{quote(refers_to or '', safe='')}>"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; digest and size are those of the
    payload itself, or for a revisit those it declares."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and base32_digest(payload) != declared:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} has another digest")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]) if revisit else len(payload)
    name = lambda v: unquote(v[1:-1].removeprefix(_ID)) or None
    return {
        "page_id": name(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "captured": fields["WARC-Date"],
        "payload_bytes": size,
        "payload_digest": declared,
        "record_type": fields["WARC-Type"],
        "refers_to": name(fields["WARC-Refers-To"]) if revisit else None,
    }


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query, in lower case."""
    rest = (url or "").partition("://")[2]
    if not rest:
        return ""
    host, slash, path = re.match(r"([^/?#]*)([/?]?)([^#]*)", rest).groups()
    return f"{','.join(reversed(host.lower().split('.')))}){slash}{path.lower()}"


def members(chunks: Iterator[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, length, record)`` of each gzip member of a file, read in pieces."""
    start, length, out, gz = 0, 0, [], zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            out.append(gz.decompress(chunk))
            if not gz.eof:
                length += len(chunk)
                break
            length += len(chunk) - len(gz.unused_data)
            yield start, length, b"".join(out)
            chunk = gz.unused_data
            start, length, out, gz = start + length, 0, [], zlib.decompressobj(31)
    if length:
        raise ValueError("the archive ends within a record")


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                page_id, url, captured, html, digest, refers_to, revisit = (c[i].as_py() for c in batch.columns)
                if out is None:
                    name, at = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(name, compression=None)
                payload = (html or "").encode("utf-8")
                b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = packer.compress(record(page_id, url, captured, payload, b32, refers_to, revisit)) + packer.flush()
                out.write(raw)
                rows.append((name, at, len(raw)))
                at += len(raw)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())], names=["archive", "record_offset", "record_bytes"])
        if out is not None:
            out.close()

    return write


def _reader(folder: str):
    names = [f.strip().split(" ")[0] for f in _RUN.split(",")]
    kinds = [pa.int64() if f.strip().endswith(" long") else pa.string() for f in _RUN.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                run = []
                with fs.open_input_stream(name, compression=None) as f:
                    for offset, length, raw in members(iter(lambda f=f: f.read(1 << 20), b"")):
                        r = parse(raw)
                        run.append(r | {"url_key": url_key(r["url"]), "archive": name.rpartition("/")[2], "record_offset": offset, "record_bytes": length})
                run.sort(key=_order)
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in run], t) for n, t in zip(names, kinds, strict=True)], names=names)

    return read


def _order(r: dict) -> tuple:
    return r["url_key"], r["captured"], r["page_id"] or "", r["archive"], r["record_offset"]


def loser_tree(runs: list[list]) -> Iterator[tuple[int, int]]:
    """Merge sorted runs: yields ``(run, place in it)`` in order.

    A node holds the loser of the match below it and the root the winner, so
    each step replays one path of about log2(k) comparisons.
    """
    k = len(runs)
    at = [0] * k
    tree = [-1] * k  # 0: the winner; 1 .. k - 1: losers

    def beats(a: int, b: int) -> bool:
        """Run ``a`` comes before ``b``: exhausted runs last, equal keys by the run's number."""
        if at[a] >= len(runs[a]):
            return False
        if at[b] >= len(runs[b]):
            return True
        x, y = runs[a][at[a]], runs[b][at[b]]
        return x < y or (x == y and a < b)

    for leaf in range(k):
        winner, node = leaf, (leaf + k) // 2
        while node > 0:
            if tree[node] < 0:
                tree[node] = winner
                break
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        else:
            tree[0] = winner
    while k and at[tree[0]] < len(runs[tree[0]]):
        winner = tree[0]
        yield winner, at[winner]
        at[winner] += 1
        node = (winner + k) // 2
        while node > 0:
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of a range: the ascending stretches of its rows, of one archive each."""
    batches = list(batches)
    if not batches or not sum(b.num_rows for b in batches):
        return
    table = pa.Table.from_batches(batches)
    names = table["archive"].to_pylist()
    keys = [
        (key, when, page or "", name, offset)
        for key, when, page, name, offset in zip(*(table[c].to_pylist() for c in ("url_key", "captured", "page_id", "archive", "record_offset")), strict=True)
    ]
    begins = [i for i, n in enumerate(names) if not i or n != names[i - 1] or keys[i] < keys[i - 1]]
    ends = [*begins[1:], len(names)]
    runs = [keys[a:b] for a, b in zip(begins, ends, strict=True)]
    merged = table.take(pa.array([begins[run] + i for run, i in loser_tree(runs)], pa.int64()))
    part = TaskContext.get().partitionId()
    merged = merged.append_column("range_no", pa.array([part] * len(keys), pa.int32()))
    yield from merged.append_column("range_place", pa.array(range(len(keys)), pa.int64())).to_batches()


def write_archives(pages: DataFrame, captured: Column, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write the archives: their folder, and ``archive, record_offset,
    record_bytes`` of each record that was committed."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(page_id).alias("id"),
        F.col(url).alias("url"),
        F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        F.col(payload).alias("html"),
        F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary")).alias("digest"),
        (F.coalesce(F.octet_length(payload), F.lit(0)) >= min_bytes).alias("large"),
    )
    # Only payloads that repeat are joined with their first page, the hot ones salted; the others aren't shuffled.
    first = rows.where("large").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "repeated")
    rows = flagged(rows, F.col("digest"), first, "digest", "hit")
    hits = salted_join(rows.where("hit").withColumn("spread", F.xxhash64("id", "url")), first, "digest", "spread").drop("spread")
    alone = rows.where(~F.col("hit")).withColumn("first", F.lit(None).cast(pages.schema[page_id].dataType))
    joined = alone.unionByName(hits)
    revisit = F.coalesce(F.col("large") & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    ready = joined.select(
        F.col("id").cast("string").alias("id"), "url", F.coalesce("captured", F.lit("1970-01-01T00:00:00Z")).alias("captured"), "html", "digest",
        F.when(revisit, F.col("first")).cast("string").alias("refers_to"), revisit.alias("revisit"),
    )
    folder = _qualified(spark, scratch_path(spark, "archives"))
    return folder, written(ready.mapInArrow(_writer(folder), _INDEX), "index")


def read_archives(folder: str, index: DataFrame) -> DataFrame:
    """The captures of the archives, each archive's as a sorted run.

    An archive is a short row and much work, so that a shuffle's size says
    nothing: they are dealt evenly to tasks of at most ``TASK_ARCHIVES``.
    """
    archives = written(index.select("archive").distinct(), "archives")
    n = archives.count()
    tasks = max(1, min(n, max(index.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ARCHIVES))))
    return written(archives.repartition(tasks).mapInArrow(_reader(folder), _RUN), "runs")


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures with ``capture_order``, their place in the global order of
    URL key, timestamp and identifier, from 0."""
    spark = runs.sparkSession
    ranges = max(2, spark.sparkContext.defaultParallelism, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", F.coalesce("page_id", F.lit("")), "archive", "record_offset")
    merged = written(dealt.mapInArrow(_merge, _RUN + ", range_no int, range_place long"), "merged")
    # One row a range.
    sizes = {r["range_no"]: r["n"] for r in merged.groupBy("range_no").agg(F.count("*").alias("n")).collect()}
    before, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    offsets = spark.createDataFrame(rows, "range_no int, before long")
    return merged.join(F.broadcast(offsets), "range_no").withColumn("capture_order", F.col("before") + F.col("range_place")).drop("range_no", "range_place", "before")


def archive_and_index(pages: DataFrame, captured: Column, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives, read them back and merge their index."""
    kind = pages.schema[page_id].dataType
    folder, index = write_archives(pages, captured, page_id, url, payload, min_bytes)
    merged = merge_runs(read_archives(folder, index))
    return merged.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}).withColumnRenamed("page_id", page_id)
