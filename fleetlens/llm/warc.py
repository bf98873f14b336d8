"""WARC archives of pages, written by Spark and read back along their boundary chains (operator 8)."""

from __future__ import annotations

import gzip
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm._scratch import freed_shuffles, new_path, stored

#: Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
DATE = "2024-01-01T00:00:00Z"


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000, records_a_file: int = 4096, file_bytes: int = 64 << 20) -> None:
    """Writes a record for each row below path, as gzip files of at most records_a_file records and about file_bytes of payload.

    Of rows with equal payloads (the html in UTF-8) of at least revisit_bytes bytes, the one with the largest id is a response
    and the others are revisits that name it; smaller payloads are all responses. Which digests repeat is found by a partial
    aggregation; only these go into the join, which Spark broadcasts if their stored size allows, so payloads are not shuffled
    and a payload that a third of all pages has costs a row. Records are ended by the writer's line separator, and so a file is
    written in one stream. Rows are written by classes of payload size, each a factor of eight; a class has as few records in a
    file as its largest payloads ask for, so a file stays within file_bytes (or is one record), whatever sizes the pages have.

    Null html is an empty payload. A null url gives an empty target; control characters and spaces in urls, which a header
    must not hold, are percent-encoded, all else of a url stays as it is. Rows with a null id revisit like others but are never named; rows that share the largest id are all responses. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html"))
    twice = rows.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.max("key").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("digest", "keeper")
    twice = stored(twice, "payloads")
    rows = rows.join(twice, "digest", "left")
    again = F.col("keeper").isNotNull() & ~F.col("key").eqNullSafe(F.col("keeper"))
    target = F.col("url")
    for code in (*range(0x21), 0x7F):
        target = F.replace(target, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    target = F.when(F.col("url").rlike(r"[\x00-\x20\x7F]"), target).otherwise(F.col("url"))
    block = F.when(again, F.lit("")).otherwise(F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit(END), F.col("html")))
    record = F.concat(
        F.lit(MAGIC.decode() + "WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce("id", F.lit("null")), F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), target,
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("keeper").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    usual = max(1, file_bytes // records_a_file)
    grade = F.when(F.col("bytes") <= usual, 0).otherwise(F.ceil(F.log2(F.col("bytes") / usual) / 3).cast("int"))
    grades = [r[0] for r in pages.select(F.coalesce(F.octet_length(html_col), F.lit(0)).alias("bytes")).select(grade.alias("grade")).distinct().collect()]  # a dozen at most
    for g in sorted(grades) or [0]:
        with freed_shuffles(pages.sparkSession):
            rows.where(grade == g).select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, records_a_file >> 3 * g)).text(f"{path}/size-{g}")


_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*(.*)")
_LENGTH = re.compile(rb"\r\n(?i:content-length):[ \t]*([0-9]{1,18})[ \t]*(?=\r\n)")
_END = END.encode()


def candidates(data: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, successor, end of the head, end of the block) of all that looks like a whole record, in payloads too.

    Linear in the data, whatever a payload holds: heads that end at one place are searched once for their length.
    """
    out, at, head, length = [], data.find(MAGIC), -1, None
    while at >= 0:
        if head < at:
            head = data.find(_END, at)
            if head < 0:
                break
            length = None
            for length in _LENGTH.finditer(data, at, head + 2):  # the last counts
                pass
        if length and length.start() >= at:
            end = head + 4 + int(length[1])
            if data[end : end + 4] == _END:
                out.append((at, end + 4, head, end))
        at = data.find(MAGIC, at + 1)
    return out


def fields(data: bytes, offset: int, head: int) -> dict[str, str]:
    """Names (lower-case) and values in a record's head."""
    lines = data[offset + len(MAGIC) : head].split(b"\r\n")
    return {m[1].decode("latin-1").lower(): m[2].decode("utf-8", "replace").strip() for line in lines if (m := _FIELD.fullmatch(line))}


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which records (offsets rising) lie on the chain from the file's start, by pointer jumping."""
    n = len(offset)
    jump = np.minimum(np.searchsorted(offset, successor), n)
    known = np.append(offset, -1)
    jump = np.append(np.where(known[jump] == successor, jump, n), n)
    on = np.append(offset == 0, False)
    for _ in range(n.bit_length()):
        on[jump[on]] = True
        jump = jump[jump]
    return on[:n]


READ = "file string, offset long, successor long, type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, payload binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below path (plain or gzip): READ, a row each.

    A task finds in its file all candidates, that is anything from a magic string to a length that fits, each with the offset at
    which it would be followed; a payload may well hold such text. These are linked offset to successor, and pointer jumping from
    offset 0 keeps what can be reached, in log2(records) steps. Only then are heads and payloads of the kept records read, so
    text in a payload is never parsed and costs linear time at most. A chain that breaks, as in a file cut short, ends there.
    payload_digest is computed from the payload of a response, and taken from the header of a revisit; digest_ok compares it
    with the header. A revisit's length that is no number counts as 0. record_id and refers_to are without brackets. Files must
    be below 2 GB, and a task holds one; write_warc() makes them far smaller. No files, no rows. Nothing is shuffled.
    """

    def parse(batches):
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = raw.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                found = candidates(data)
                on = reachable(np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64))
                rows = {c.split()[0]: [] for c in READ.split(", ")}
                for i in np.flatnonzero(on):
                    at, after, head, end = found[i]
                    f = fields(data, at, head)
                    kind = f.get("warc-type", "")
                    cut = data.find(_END, head + 4, end)
                    payload = data[cut + 4 : end] if kind == "response" and cut >= 0 else b""
                    named = f.get("warc-payload-digest", "").removeprefix("sha1:")
                    own = hashlib.sha1(payload).hexdigest() if kind == "response" else named
                    said = f.get("x-payload-length", "")
                    length = len(payload) if kind == "response" else int(said) if re.fullmatch("[0-9]{1,18}", said) else 0
                    values = (name, at, after, kind, f.get("warc-record-id", "").strip("<>"), f.get("warc-target-uri"), f.get("warc-refers-to", "").strip("<>") or None, own, length, own == named, payload if with_payload else None)
                    for c, v in zip(rows, values, strict=True):
                        rows[c].append(v)
                kinds = {"offset": pa.int64(), "successor": pa.int64(), "payload_bytes": pa.int64(), "digest_ok": pa.bool_(), "payload": pa.binary()}
                yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.string())) for c, v in rows.items()})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(parse, READ)


def archived(pages: DataFrame, path: str | None = None, with_payload: bool = False, **options) -> DataFrame:
    """Writes pages as archives (below path, or in the cluster's shared folder) and reads them back."""
    path = path or new_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path, with_payload)


def archived_digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record that was read back."""
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1)
    return archived(pages).select(
        F.nullif(number("record_id"), F.lit("")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.nullif(number(F.coalesce("refers_to", F.lit(""))), F.lit("")).cast("long").alias("refers_to")
    )


ORACLE = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as d, octet_length(encode(coalesce(html, ''))) as n from pages),
k as (select d, max(page_id) as keeper from p where n >= 1000 group by d having count(*) > 1)
select page_id, n as payload_bytes, p.d as payload_digest,
  case when keeper is null or page_id = keeper then 'response' else 'revisit' end as record_type,
  case when keeper is null or page_id = keeper then null else keeper end as refers_to
from p left join k on p.d = k.d
"""
