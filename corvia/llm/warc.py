"""WARC archives with an index that is made first and read first.

Writing: a record per page. Of records with equal payloads, the one with the
largest page id is a response; the others are revisits, which refer to it and
keep its HTTP headers (so the length of the full payload) without the payload.
Each partition writes one archive, and a row of the index for every record:
file, offset, length, URL and digest.

Reading: records are selected in the index alone; the selected rows are sorted
by file and offset, ranges that nearly touch are coalesced, and each coalesced
range is fetched by one ranged read.

Defined results: null html is an empty payload, null urls are empty; null page
ids precede all others (such a page is only a response if no equal payload has an
id); rows with the same largest id and payload are all responses. Columns other
than the three are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import F, T, shared_dir, sliced, stored
from .token_shards import _file_system

GAP = 64 << 10  # bytes between ranges that are still read at once
RANGE = 8 << 20  # largest coalesced read
TASK_BYTES = 64 << 20  # of records for each reading task
PREFIX = "urn:page:"
EOL = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _name(page_id) -> str:
    return f"<{PREFIX}{'' if page_id is None else page_id}>"


def _page(name: str):
    own = name[1 + len(PREFIX) : -1]
    return int(own) if own else None


def record_bytes(page_id, url: str, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record with its two closing line ends."""
    http = EOL.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        # what a URL can't hold is percent-encoded, so that no header line breaks
        f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("ascii") + EOL + EOL + block + EOL + EOL


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("ascii").split("\r\n"))}


def parse_record(data: bytes) -> dict:
    """A record's fields; checks lengths, closing line ends and the digest."""
    version, _, rest = data.partition(EOL)
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC record")
    raw, _, rest = rest.partition(EOL + EOL)
    head = _headers(raw)
    n = int(head["content-length"])
    block = rest[:n]
    if len(block) < n or rest[n:] != EOL + EOL:
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(EOL + EOL)
    full = int(_headers(http.partition(EOL)[2])["content-length"])
    digest = head["warc-payload-digest"].partition(":")[2]
    kind = head["warc-type"]
    if kind == "response" and (len(payload) != full or payload_digest(payload) != digest):
        raise ValueError("payload and digest differ")
    refers = head.get("warc-refers-to")
    return {
        "page_id": _page(head["warc-record-id"]),
        "url": head["warc-target-uri"],
        "payload_bytes": full,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page(refers) if refers else None,
        "payload": payload if kind == "response" else None,
    }


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives; return the index, which is stored beside them."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha1("html"))
    # copies meet in partial sums; only payloads that occur again are kept
    again = rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("target")).where("n > 1")
    again = stored(again.select("key", "target"), "warc-copies")
    # both sides are dealt by the join itself, so that a payload with very many copies can be split
    tagged = rows.join(again, "key", "left").drop("key")

    def write(batches):
        part = TaskContext.get().partitionId()
        attempt = TaskContext.get().taskAttemptId()
        store, root = _file_system(folder)
        store.create_dir(f"{root}/archives", recursive=True)
        # the index names the file of the attempt that wrote it, so that a second run of a
        # task, whose rows may come in another order, can't part the two
        name = f"part-{part:06d}-{attempt}.warc"
        stream, at = None, 0
        index = []
        for batch in batches:
            for piece in sliced(batch):
                for page, url, html, target in zip(*(piece.column(k).to_pylist() for k in range(4))):
                    revisit = target is not None and page != target
                    payload = html.encode("utf-8")
                    data = record_bytes(page, url, payload, target, revisit)
                    if stream is None:
                        stream = store.open_output_stream(f"{root}/archives/{name}")
                    stream.write(data)
                    index.append((page, url, name, at, len(data), payload_digest(payload), "revisit" if revisit else "response"))
                    at += len(data)
        if stream is None:
            return
        stream.close()
        for block in range(0, len(index), 10_000):
            cols = list(zip(*index[block : block + 10_000]))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=INDEX.names)

    tagged.select("page_id", "url", "html", "target").mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(begin, end, numbers of the ranges inside) for ranges sorted by offset."""
    out: list[list] = []
    for k, (at, n) in enumerate(ranges):
        if out and at - out[-1][1] <= GAP and at + n - out[-1][0] <= max(RANGE, n):
            out[-1][1] = max(out[-1][1], at + n)
            out[-1][2].append(k)
        else:
            out.append([at, at + n, [k]])
    return [tuple(x) for x in out]


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """RECORD rows (and the payload) of the index's rows, by ranged reads."""
    schema = T.StructType([*RECORD.fields, T.StructField("payload", T.BinaryType())]) if with_payload else RECORD

    def read(batches):
        store, root = _file_system(folder)
        for batch in batches:
            names, offsets, lengths = (batch.column(k).to_pylist() for k in range(3))
            begin = 0
            while begin < len(names):
                end = begin
                while end < len(names) and names[end] == names[begin]:
                    end += 1
                with store.open_input_file(f"{root}/archives/{names[begin]}") as f:
                    for lo, hi, inside in coalesced(list(zip(offsets[begin:end], lengths[begin:end]))):
                        data = f.read_at(hi - lo, lo)
                        rows = []
                        for k in inside:
                            at = offsets[begin + k] - lo
                            rows.append(parse_record(data[at : at + lengths[begin + k]]))
                        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(schema.names, kinds)], names=schema.names)
                begin = end

    # neighbours in a file meet in one task, and a large file's records are shared by
    # several: tasks by the bytes to be read, not by those of the index
    chosen = index.select("file", "offset", "length")
    total = chosen.agg(F.sum("length")).first()[0] or 0
    chosen = chosen.repartitionByRange(-(-total // TASK_BYTES) or 1, "file", "offset").sortWithinPartitions("file", "offset")
    return chosen.mapInArrow(read, schema)


def archive_and_read(pages: DataFrame, **options) -> DataFrame:
    folder = shared_dir(pages.sparkSession, "warc")
    index = write_archives(pages, folder, **options)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
