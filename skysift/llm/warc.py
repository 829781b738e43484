"""WARC archives, index first.

Records are written as gzip members, one after another, so any record can be read by its byte range; the written index has
``file, offset, length, url, digest, page_id, record_type`` for each.  Reading starts from the index: rows are selected
there, sorted by file and offset, and neighbouring ranges are read together.

Of pages with equal payloads the one with the largest ``page_id`` is the response; the others are revisits that refer to it.
Smaller payloads than ``least`` bytes are always responses.

Defined results: null html is the empty payload; a null url is left out of the record; control characters and blanks in
urls are percent-encoded; pages without id are responses; rows that repeat both id and payload are all of the same type;
an empty table gives no files; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.lineage import shared_folder
from skysift.llm import files
from skysift.llm.common import materialize, utf8, with_long

INDEX = "file string, offset long, length long, url string, digest string, page_id string, record_type string"
RECORDS = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
FILE_BYTES = 1 << 29


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def clean_url(url: str) -> str:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], utf8(url)).decode("utf-8", "surrogatepass")


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record, not compressed.  A revisit has no payload; two extension fields keep its page and payload size."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {clean_url(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []),
        *([f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {len(payload)}"] if revisit else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return utf8("\r\n".join(head)) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def with_targets(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: null for responses.

    Only digests and ids are grouped (combined before the shuffle); the html moves once, by page.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("sha1"))
    able = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "sha1")
    heads = able.groupBy("sha1").agg(F.max("page_id").alias("head"), F.min("page_id").alias("tail")).where("tail < head").select("sha1", "head")
    revisits = able.join(heads, "sha1").where("page_id < head").distinct()
    revisits = revisits.select(F.col("page_id").alias("own_id"), F.col("sha1").alias("own_sha1"), F.col("head").alias("refers_to"))
    return rows.join(revisits, (F.col("page_id") == F.col("own_id")) & (F.col("sha1") == F.col("own_sha1")), "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages; returns the written index."""
    folder = folder or shared_folder(pages.sparkSession, "warc")

    names = ["page_id", "refers_to"]

    def run(batches):
        part, out, name, at = TaskContext.get().partitionId(), None, None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers in zip(*(batch[c] for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = files.new_name(folder, part, ".warc.gz"), 0
                        out = files.create(name)
                    payload = utf8(html)
                    member = gzip.compress(record(page_id, url, payload, refers, date), 6, mtime=0)
                    out.write(member)
                    rows.append((name, at, len(member), url, digest(payload), page_id, "response" if refers is None else "revisit"))
                    at += len(member)
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    # Ids are strings in Python: beside a null, pandas would turn longs into doubles and lose digits above 2^53.
    rows = with_targets(pages, least)
    rows = rows.withColumns({n: F.col(n).cast("string") for n in names})
    return materialize(with_long(rows.mapInPandas(run, INDEX), "page_id"), "warc-index")


def ranges(rows: list[tuple[str, int, int]], gap: int, most: int):
    """Coalesce sorted ``file, offset, length``: (file, from, to, how many rows), no hole over ``gap``, at most about ``most`` bytes."""
    out: list[list] = []
    for name, offset, length in rows:
        last = out[-1] if out else None
        if last and last[0] == name and 0 <= offset - last[2] <= gap and offset + length - last[1] <= most:
            last[2], last[3] = offset + length, last[3] + 1
        else:
            out.append([name, offset, offset + length, 1])
    return out


def read_records(selected: DataFrame, gap: int = 1 << 16, most: int = 1 << 23, stretch: int = 1 << 26) -> DataFrame:
    """Read the records of the selected index rows: their fields, and size and digest of the full payload.

    Stretches of a file are dealt to tasks, so one large archive is read by many.  The digest of a response is computed from
    the payload that was read; a revisit states those of the payload that it refers to.
    """

    def run(batches):
        for batch in batches:
            rows = list(zip(batch["file"], batch["offset"], batch["length"], strict=True))
            out, at = [], 0
            for name, low, high, n in ranges(rows, gap, most):
                data = memoryview(files.read(name, int(low), int(high - low)))
                for _, offset, length in rows[at : at + n]:
                    fields, payload = parse(zlib.decompress(data[offset - low : offset - low + length], 31))
                    revisit = fields["WARC-Type"] == "revisit"
                    out.append((
                        fields.get("X-Page"),
                        fields.get("WARC-Target-URI"),
                        int(fields["X-Payload-Length"]) if revisit else len(payload),
                        fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else digest(payload),
                        fields["WARC-Type"],
                        fields["X-Refers-To-Page"] if revisit else None,
                    ))
                at += n
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RECORDS.split(", ")])

    place = (F.col("offset") / stretch).cast("long")
    rows = selected.select("file", "offset", "length")
    size = rows.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // stretch))  # rows stand for bytes elsewhere
    return rows.repartition(tasks, "file", place).sortWithinPartitions("file", "offset").mapInPandas(run, RECORDS).transform(with_long, "page_id", "refers_to")
