"""WARC archives with an index, written first and read by coalesced ranges.

Writing gives one gzip member for each record and, at once, an index row with
the file, offset, length, URL and digest of the record. Reading starts from any
selection of index rows: they are sorted by file and offset, neighbouring
ranges join into one read, and the records are cut out of it.

Of records with equal payloads the one with the smallest page_id holds the
payload (response); the others refer to it (revisit).
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_groups, materialise, new_path, tidy
from corpusloom.llm.tokenids import open_fs

#: Ranges with smaller gaps are read at once, up to MOST_READ bytes; a reading unit is STRIDE bytes of a file.
GAP, MOST_READ, STRIDE = 64 << 10, 8 << 20, 32 << 20
LEVEL = 2
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
# Fixed values of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, payload_bytes long, record_type string, refers_to long"


def _record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}{salt}')}>"


def _clean_uri(url: str | None, page_id: int | None) -> str:
    """The URL with what would break a header line escaped; a URN if there is none."""
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, salt: str = "", single: bool = True, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record, uncompressed. The fields X-Page-Id and so on are extensions, which readers skip.

    `salt` sets the ids of records apart that share a page_id; a revisit names its response's id (an
    optional field) only where that page_id is of a `single` record.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, salt)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean_uri(url, page_id)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", *([f"WARC-Refers-To: {_record_id(refers_to)}"] if single else []), f"X-Refers-To-Page-Id: {refers_to}"]
    head += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one uncompressed record; field names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in lines[1:]))
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in http.decode("latin-1").split("\r\n")[1:])), payload


def write(pages: DataFrame, min_bytes: int = 0, level: int = LEVEL, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for each row of pages; returns the index (columns INDEX).

    The payload is html in UTF-8, empty for a null. Payloads under min_bytes are always responses. A null
    url is written as urn:page:<id>. Rows of a null page_id are responses and referred to by nothing; rows
    that repeat page_id and payload are each a response, if theirs is the smallest page_id. An empty table
    gives an empty index. A task writes files of its own name and only those of tasks that succeeded
    are in the index, so retried and lost tasks do no harm.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload"))
    digests = materialise(p.where(F.col("page_id").isNotNull()).select("page_id", "sha", (F.octet_length("payload") >= min_bytes).alias("counts")), "digests")
    repeated = digests.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1").select("page_id", F.lit(False).alias("alone"))
    first = digests.where("counts").groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("sha", "first")
    first = first.join(repeated.select(F.col("page_id").alias("first"), F.col("alone").alias("single")), "first", "left")
    again = digests.where("counts").join(first, "sha").where("page_id <> first").select("page_id", "sha", F.col("first").alias("refers_to"), F.coalesce("single", F.lit(True)).alias("single")).distinct()
    # one row for each id and digest that is a revisit or not alone; the rest of the rows join nothing
    notes = digests.join(repeated, "page_id").select("page_id", "sha", "alone").distinct().join(again, ["page_id", "sha"], "full")
    # only ids meet the payloads, so no digest's rows gather in one place
    again = materialise(notes.select(F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), "refers_to", "alone", "single"), "revisits")
    decided = p.join(again, (p["page_id"] == again["r_id"]) & (p["sha"] == again["r_sha"]), "left").select("page_id", "url", "payload", "sha", "refers_to", (F.col("page_id").isNotNull() & F.coalesce("alone", F.lit(True))).alias("alone"), F.coalesce("single", F.lit(True)).alias("single"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, at = TaskContext.get(), None, 0
        uri = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                pid, link, payload, sha, refers, alone, single = (batch.column(k)[i] for k in range(7))
                pid, link, payload, refers = pid.as_py(), link.as_py(), payload.as_buffer().to_pybytes(), refers.as_py()
                salt = "" if alone.as_py() else f"@{uri}:{at}"
                digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = press.compress(record(pid, link, payload, digest, refers, salt, single.as_py())) + press.flush()
                if out is None:
                    where, path = open_fs(uri)
                    where.create_dir(os.path.dirname(path), recursive=True)
                    out = where.open_output_stream(path, compression=None)
                out.write(raw)
                rows.append((pid, link, uri, at, len(raw), digest, len(payload), "response" if refers is None else "revisit", refers))
                at += len(raw)
            if rows:
                names = [x.split()[0] for x in INDEX.split(", ")]
                kinds = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if out is not None:
            out.close()

    index = materialise(decided.mapInArrow(tidy(run), INDEX), "warc-index")
    return index


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = MOST_READ) -> list[tuple[int, int, int, int]]:
    """Joins ranges in ascending order: (first record, end record, offset, length) of each read."""
    out: list[tuple[int, int, int, int]] = []
    for i, (o, n) in enumerate(zip(offsets, lengths)):
        if out and o - (out[-1][2] + out[-1][3]) <= gap and o + n - out[-1][2] <= most:
            a, _, start, size = out[-1]
            out[-1] = (a, i + 1, start, max(size, o + n - start))
        else:
            out.append((i, i + 1, o, n))
    return out


def read(selected: DataFrame, payload: bool = False) -> DataFrame:
    """Read the records of some index rows: page_id, payload_bytes, payload_digest, record_type, refers_to,
    url (as written) and, if asked for, payload (null for a revisit).

    The digest of each response is computed anew and must be the record's. Reads are dealt by file and
    stretch of STRIDE bytes and go in the order of the offsets.
    """
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payload
    names = [x.split()[0] for x in columns.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in columns.split(", ")]

    def run(group: pa.Table) -> list[pa.RecordBatch]:
        group = group.sort_by([("file", "ascending"), ("offset", "ascending")])
        file, offsets, lengths = group["file"].to_pylist(), group["offset"].to_pylist(), group["length"].to_pylist()
        out: list[pa.RecordBatch] = []
        for name in dict.fromkeys(file):
            mine = [i for i, f in enumerate(file) if f == name]
            where, path = open_fs(name)
            with where.open_input_file(path) as source:
                for a, b, start, size in ranges([offsets[i] for i in mine], [lengths[i] for i in mine]):
                    raw, rows = source.read_at(size, start), []
                    for i in mine[a:b]:
                        at = offsets[i] - start
                        fields, http, body = parse(zlib.decompress(raw[at : at + lengths[i]], 31))
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        kind = fields["warc-type"]
                        if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"{name} at {offsets[i]}: the payload is not what its digest says")
                        number = lambda k: int(fields[k]) if k in fields else None
                        row = (number("x-page-id"), int(http["content-length"]), digest, kind, number("x-refers-to-page-id"), fields["warc-target-uri"])
                        rows.append(row + ((body if kind == "response" else None,) if payload else ()))
                    out.append(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names))
        return out

    units = selected.select(F.xxhash64("file", F.floor(F.col("offset") / STRIDE)).alias("unit"), "file", "offset", "length")
    return map_groups(units, "unit", run, columns)
