"""WARC archives: records with revisits for equal payloads, and a salvage reader that survives damage."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .common import cut, drop_path, new_path, read

#: Payloads of at least so many bytes are stored once.
SHARED_BYTES = 100
#: Date of all records written, so that reruns write the same bytes.
DATE = "1970-01-01T00:00:00Z"
#: Pages of over LONG bytes are written apart. A file holds so many of the others, and so many bytes of long ones, or one page;
#: so a file, which a task reads at a time, has 128 MB at most, or one page.
LONG, FILE_RECORDS, FILE_BYTES = 1 << 15, 4_000, 1 << 27
#: In front of one record in so many (by a hash of page_id) the query's archives have a torn copy, as a writer leaves it that was stopped.
TORN = 64
#: Up to so many revisits (under 150 bytes each) are broadcast to the pages; beyond it they join by a shuffle of the pages.
BROADCAST_REVISITS = 50_000
#: Bytes of a member that are decompressed at a time.
PIECE = 1 << 16
END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r?\n")
_GZIP = b"\x1f\x8b\x08"
_HEADER = re.compile(rb"([!#$%&'*+\-.^_`|~0-9A-Za-z]+):[ \t]*([^\r\n]*)\r?\n")


@dataclass
class Record:
    """A record that passed its checks: headers with lower-case names, the block, and where it was (start, end)."""

    headers: dict[str, str]
    block: bytes
    start: int
    end: int

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head, in records that have one."""
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(END)[2]
        return self.block


@dataclass
class Gap:
    """Bytes [start, end) that belong to no valid record, and what failed at their start."""

    start: int
    end: int
    reason: str


class Bad(ValueError):
    pass


def encode(headers: dict[str, str], block: bytes, member: bool = False) -> bytes:
    """One record; with member as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {**headers, "Content-Length": str(len(block))}.items())
    out = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + END
    if not member:
        return out
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(out) + packer.flush()


def parse_record(data: bytes, at: int) -> Record:
    """The record that starts at `at`, or Bad: version line, headers, length, end mark and payload digest are checked."""
    version = _VERSION.match(data, at)
    if not version:
        raise Bad("no version line")
    headers: dict[str, str] = {}
    pos = version.end()
    while m := _HEADER.match(data, pos):
        if b"WARC/" in m[2] and _VERSION.search(data, m.start(2), m.end()):
            raise Bad("torn header")  # the next record's version line ends it
        headers.setdefault(m[1].decode("ascii").lower(), m[2].decode("utf-8", "replace").strip())
        pos = m.end()
    blank = 2 if data[pos : pos + 2] == b"\r\n" else 1 if data[pos : pos + 1] == b"\n" else 0
    if not blank:
        raise Bad("broken header")
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Bad("no valid length")
    begin = pos + blank
    end = begin + int(length)
    if end > len(data):
        raise Bad("truncated block")
    if data[end : end + 4] != END:
        raise Bad("no end mark")
    found = Record(headers, data[begin:end], at, end + 4)
    digest = headers.get("warc-payload-digest", "")
    if digest.startswith("sha256:") and headers.get("warc-type") != "revisit" and hashlib.sha256(found.payload).hexdigest() != digest[7:].lower():
        raise Bad("digest differs")
    return found


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at `at` holds, where it ends, and what failed ('' if nothing did).

    Of a broken member it is what comes out before the failure, and the end is where that was met.
    """
    reader = zlib.decompressobj(31)
    out = []
    step = PIECE
    while at < len(data):
        before = reader.copy() if step > 1 else None
        try:
            out.append(reader.decompress(data[at : at + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(out), at, f"broken member: {e}"
            reader, step = before, max(1, step // 16)  # again in smaller steps, so that what comes before the failure is kept
            continue
        at = min(len(data), at + step)
        if reader.eof:
            return b"".join(out), at - len(reader.unused_data), ""
    return b"".join([*out, reader.flush()]), at, "truncated member"


class _Marks:
    """Where the next version line and the next gzip member may start. Each is searched once for each place found, so that all searches together read the bytes once."""

    def __init__(self, data: bytes, members: bool):
        self.data, self.members = data, members
        self.line = self.member = -1

    def next(self, at: int, plain: int) -> int:
        """The next mark at `at` or later, of a version line only from `plain` on; or the end."""
        if self.line < max(at, plain):
            found = _VERSION.search(self.data, max(at, plain))
            self.line = found.start() if found else len(self.data)
        if self.member < at:
            place = self.data.find(_GZIP, at) if self.members else -1
            self.member = place if place >= 0 else len(self.data)
        return min(self.line, self.member)


def salvage(data: bytes, members: bool = True) -> Iterator[Record | Gap]:
    """All valid records of an archive, plain or (with `members`) in gzip members of any number of records, and the gaps between them.

    Where a check fails, the search goes on one byte later for the next version line or member; what lies between is one gap,
    with the reason of its first failure. Records and gaps inside a member carry the member's place, the gaps' reasons their
    place in the plain bytes. Of a member that is truncated or broken, what comes out before the failure is read in the same
    way; its bytes are a gap as well, and are searched for the start of a further member, but not for plain records again.
    """
    at, plain_from, gap, reason = 0, 0, None, ""
    marks = _Marks(data, members)
    while at < len(data):
        got: list[Record | Gap] = []
        failed = ""
        if members and data.startswith(_GZIP, at):
            plain, after, failed = _member(data, at)
            parts = list(salvage(plain, members=not failed))
            if failed and parts and isinstance(parts[-1], Gap) and parts[-1].end == len(plain):
                parts.pop()  # the record that the failure cut
            if not failed and parts and not any(isinstance(p, Record) for p in parts):
                gap, reason = (at, f"in member: {parts[0].reason}") if gap is None else (gap, reason)
                at = after
                continue
            for p in parts:
                got.append(Record(p.headers, p.block, at, after) if isinstance(p, Record) else Gap(at, after, f"in member, {p.start} to {p.end}: {p.reason}"))
            if failed and not any(isinstance(p, Record) for p in parts):
                got = []
        else:
            try:
                got.append(parse_record(data, at))
                after = got[0].end
            except Bad as e:
                failed, after = str(e), 0
        if got and gap is not None:
            yield Gap(gap, at, reason)
            gap = None
        yield from got
        if failed:
            gap, reason = (at, failed) if gap is None else (gap, reason)
            plain_from = max(plain_from, after)
            at = marks.next(at + 1, plain_from)
            continue
        if gap is not None:  # an empty member
            yield Gap(gap, at, reason)
            gap = None
        at = after
    if gap is not None:
        yield Gap(gap, len(data), reason)


@pandas_udf(StringType())
def _uri(url: pd.Series) -> pd.Series:
    """The url as a header value: white space, controls and other than ASCII percent-encoded."""
    return url.map(lambda u: None if u is None else quote(u, safe="!#$%&'()*+,/:;=?@[]~"))


def records(pages: DataFrame) -> DataFrame:
    """A record per page: page_id, record_type, refers_to, payload_bytes, payload_digest and record, its text without the end mark."""
    html = F.coalesce("html", F.lit(""))
    kept = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    first = kept.filter(F.col("payload_bytes") >= SHARED_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    first = first.filter("_n > 1").drop("_n")
    narrow = kept.filter(F.col("payload_bytes") >= SHARED_BYTES).select("page_id", "payload_digest").join(first, "payload_digest")
    again = narrow.filter("page_id <> _first").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("_first").alias("refers_to")).distinct()
    again = cut(again)
    again = F.broadcast(again) if again.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS else again
    marked = kept.join(again, (kept["page_id"] == again["_page"]) & (kept["payload_digest"] == again["_digest"]), "left").drop("_page", "_digest")
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(F.lit("")))

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))

    number = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), number, F.lit(">"))),
        line("WARC-Target-URI", _uri("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    return marked.select("page_id", kind.alias("record_type"), "refers_to", "payload_bytes", "payload_digest", F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, path: str, file_records: int = FILE_RECORDS, torn: int = 0) -> None:
    """Write the pages' records as plain WARC files under path, in whatever store Spark writes to.

    Spark's text writer puts its line separator after each row; as the end mark of a record, it makes the file a WARC. The
    html isn't shuffled for finding equal payloads: digests and ids are. maxRecordsPerFile bounds the files of a task; pages
    of over LONG bytes, of any length, have files of their own, so many to one as fit FILE_BYTES. With `torn`, one record in
    so many follows a torn copy of itself, its first half: damage for the reader to pass by.
    """
    made = records(pages)
    text = F.col("record")
    if torn:
        half = F.substr("record", F.lit(1), (F.length("record") / 2).cast("int"))
        text = F.when(F.pmod(F.xxhash64("page_id"), F.lit(torn)) == 0, F.concat(half, text)).otherwise(text)
    out = made.select(text.alias("record"), "payload_bytes")
    longest = pages.agg(F.max(F.octet_length("html")).alias("n")).first()["n"] or 0

    def write(part: DataFrame, name: str, most: int) -> None:
        part.select("record").write.option("lineSep", END.decode()).option("maxRecordsPerFile", most).option("compression", "none").text(f"{path}/{name}")

    write(out.filter(F.col("payload_bytes") <= LONG), "short", file_records)
    if longest > LONG:
        write(out.filter(F.col("payload_bytes") > LONG), "long", max(1, min(file_records, FILE_BYTES // (2 * longest))))


def read_archives(spark: SparkSession, path: str, keep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of all archives under path, one pass for both. Gaps are the quarantine log: file, start, end, reason.

    The pass is written to the path `keep`, or to a new one in the shared folder, records and log beside each other, so both
    outlive the archives and are read as often as one likes. An archive is one cell while it is read, which Spark bounds at
    2 GB; larger ones are to be cut before.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "start", "end", "reason"]

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = []
                for r in salvage(content):
                    if isinstance(r, Gap):
                        rows.append((None,) * 6 + (path, r.start, r.end, r.reason))
                        continue
                    again = r.headers.get("warc-type") == "revisit"
                    length = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", r.block.partition(END)[0])
                    size = int(length[1]) if again and length else len(r.payload)
                    digest = r.headers.get("warc-payload-digest", "").removeprefix("sha256:").lower() if again else hashlib.sha256(r.payload).hexdigest()
                    rows.append((_id(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), size, digest, r.headers.get("warc-type", ""), _id(r.headers.get("warc-refers-to")), None, None, None, None))
                yield pd.DataFrame(rows, columns=names).astype(dict.fromkeys(("page_id", "payload_bytes", "refers_to", "start", "end"), "Int64"))

    kind = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, start long, end long, reason string"
    keep = keep or new_path(spark, "salvaged")
    files.mapInPandas(run, kind).withColumn("part", F.when(F.col("reason").isNull(), "records").otherwise("quarantine")).write.partitionBy("part").parquet(keep)
    back = spark.read.schema(kind + ", part string").parquet(keep)
    return back.filter("part = 'records'").select(*names[:6]), back.filter("part = 'quarantine'").select(*names[6:])


def _id(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(found[1]) if found else None


def round_trip(pages: DataFrame, torn: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine log): write the pages to archives in the shared folder, read them back, delete the archives.

    Null html is an empty payload; null urls have no target line; a null page_id comes back as null, and is a response since
    it isn't the smallest but refers to nothing. Rows that share page_id and payload are all responses. Payloads of any length
    that a cell can hold pass. Extra columns are ignored, no rows give no rows. With `torn` the archives are damaged in places
    (write_archives); the records are all the same, and the damage is in the log.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, torn=torn)
    out = read_archives(spark, path)
    drop_path(spark, path)
    return out


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back, _ = round_trip(read(spark, sf_dir, "pages"), TORN)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
