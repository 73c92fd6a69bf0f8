"""WARC archives, index first.

Each task writes gzipped records, one member per record, into archives of its own below the shared folder, and returns
an index row per record: file, offset, length, URL, digest. The index table is written last and names only files of tasks
that ended well, so a task that is lost and run again leaves a file that nothing refers to. Reading selects index rows,
sorts them by place, joins neighbouring byte ranges into large reads and decodes the records from those.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, lookup, table, work_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # pages carry no date; a fixed one keeps archives equal when a task runs again
INDEX = "file string, offset long, length long, page_id long, url string, digest string, payload_bytes long"
GAP, READ = 1 << 16, 8 << 20
#: A reading task has at most the first many bytes, and no fewer than the second where there are cores to spare.
TASK_MOST, TASK_LEAST = 256 << 20, 1 << 20


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the HTTP header of its page (with the payload's length) but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """type, page_id, url, digest, refers_to, payload_bytes and payload (None for revisits) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
    number = lambda s: int(s[len("<urn:page:") : -1]) if s and s != record_id(None) else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "record_type": fields["WARC-Type"], "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": number(fields.get("WARC-Refers-To", "")), "payload_bytes": size, "payload": None if revisit else payload,
    }


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """Local, HDFS and object-store folders, by their URI."""
    return pafs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, max_file_bytes: int = 1 << 30, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row and return the written index.

    Of rows with equal payloads of at least min_revisit_bytes the one with the smallest id is a response, the others
    revisit it (rows that repeat the smallest id too are responses). A null payload is empty, a null URL too. A null id
    ranks last. Other columns are not stored. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or work_path(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha1"))
    copied = table(rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copied-payloads")
    hot = table(hot_keys(copied, ["sha1"], weight=F.col("n")), "hot-payloads")
    joined = lookup(rows, copied.select("sha1", "first"), ["sha1"], hot)
    size = F.octet_length("html")
    revisit = F.col("first").isNotNull() & (size >= min_revisit_bytes) & ~F.col("first").eqNullSafe(F.col("page_id"))
    ready = joined.select("page_id", "url", "sha1", size.cast("long").alias("size"), F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"), F.when(~revisit, F.col("html")).alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        fs.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for rb in batches:
            index: list[list] = [[] for _ in range(7)]
            for page, url, sha1, n, refers, again, text in zip(*(rb.column(i) for i in range(7))):
                if out is None or at >= max_file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                raw = record(page.as_py(), url.as_py(), (text.as_py() or "").encode(), n.as_py(), digest, refers.as_py(), again.as_py())
                z = zlib.compressobj(1, wbits=31)
                raw = z.compress(raw) + z.flush()
                out.write(raw)
                for x, v in zip(index, (name, at, len(raw), page.as_py(), url.as_py(), digest, n.as_py())):
                    x.append(v)
                at += len(raw)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(index, kinds)], ["file", "offset", "length", "page_id", "url", "digest", "payload_bytes"])
        if out is not None:
            out.close()

    index = table(ready.mapInArrow(write, INDEX), "warc-index")
    return index.withColumn("folder", F.lit(folder))


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of index rows (all, or a selection): page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, and with payloads=True the payload (null for revisits). Digests of payloads are checked. Rows are dealt by
    ranges of blocks of a file, over as many tasks as their bytes ask for; reads join ranges with gaps below 64 KB, up to 8 MB."""
    cols = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    names = [c.split(" ")[0] for c in cols.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, int, int]] = []

        def fetch() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            folder, name, start, _ = held[0]
            fs, path = _filesystem(folder)
            with fs.open_input_file(f"{path}/{name}") as f:
                data = f.read_at(held[-1][2] + held[-1][3] - start, start)
            out: list[list] = [[] for _ in names]
            for _, _, at, n in held:
                r = parse(zlib.decompress(data[at - start : at - start + n], wbits=31))
                if r["payload"] is not None and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != r["digest"]:
                    raise ValueError(f"damaged record at {at} in {name}")
                for x, v in zip(out, (r["page_id"], r["url"], r["payload_bytes"], r["digest"], r["record_type"], r["refers_to"], r["payload"])):
                    x.append(v)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)

        for rb in batches:
            for row in zip(*(rb.column(i).to_pylist() for i in range(4))):
                if held and (row[:2] != held[-1][:2] or row[2] > held[-1][2] + held[-1][3] + GAP or row[2] + row[3] - held[0][2] > READ):
                    yield from fetch()
                held.append(row)
        yield from fetch()

    places = index.select("folder", "file", "offset", "length").withColumn("part", F.floor(F.col("offset") / READ))
    total = index.agg(F.sum("length")).first()[0] or 0  # one number; the index itself is too small to tell the work
    n = read_tasks(total, index.sparkSession.sparkContext.defaultParallelism)
    dealt = places.repartitionByRange(n, "folder", "file", "part").sortWithinPartitions("folder", "file", "offset").select("folder", "file", "offset", "length")
    return dealt.mapInArrow(read, cols)


def read_tasks(total: int, cores: int) -> int:
    return max(1, -(-total // TASK_MOST), min(2 * cores, total // TASK_LEAST))
