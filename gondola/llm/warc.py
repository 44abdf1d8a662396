"""WARC archives of web pages, and the capture history merged from their indexes.

``write_archives`` writes one WARC record a page with Spark's text writer: each task
writes gzip archives of a bounded number of records into a shared folder. A record ends
with two line ends, which are the writer's line separator, so the files are plain WARC.
``read_records`` reads them back as a stream in each task and joins what belongs to a
record by its Content-Length, so a payload may contain anything, the version line included.

``capture_runs`` indexes each archive as one run, sorted by URL key and time, and
``capture_history`` merges the runs: key ranges are dealt out to tasks, and a loser tree
merges the runs' parts of a range, so the whole comes out in one global order.

Of pages with equal payloads of at least ``least_revisit`` bytes the largest key is a
``response`` and the others are ``revisit`` records without payload that refer to it.
Rows that share that key are all responses; a null key counts as less than any other, and
where all keys of a payload are null, all are responses. Smaller payloads are always
responses. A null html counts as empty, a null URL as ``urn:page:<key>``. Rows with one
key have one record id. An empty table gives no record. Extra columns are ignored.
Payloads of any length are written whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.functions.lineage import cut_lineage

VERSION = "WARC/1.1"
LEAST_REVISIT = 1000
RECORDS_PER_ARCHIVE = 10_000
ROWS_PER_MERGE = 100_000
FIRST_CAPTURE = 1_577_836_800  # the default capture time is so many seconds, and one a page
#: Profile of a revisit record, and the response's HTTP head.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _iso(seconds: Column) -> Column:
    """Seconds since 1970 as an ISO time in UTC, whatever the session's time zone."""
    def two(value: Column) -> Column:
        return F.lpad(F.floor(value).cast("string"), 2, "0")

    rest = F.pmod(seconds, F.lit(86_400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int"))
    return F.concat(day.cast("string"), F.lit("T"), two(rest / 3600), F.lit(":"),
                    two(rest % 3600 / 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id",
                   url_column: str = "url", html_column: str = "html",
                   captured: Column | None = None, least_revisit: int = LEAST_REVISIT) -> None:
    """Write every page to ``folder``; ``captured`` is the capture time in seconds."""
    key = F.col(id_column).cast("long")
    when = captured if captured is not None else F.lit(FIRST_CAPTURE) + F.coalesce(key, F.lit(0))
    rows = pages.select(
        key.alias("page_id"), F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"),
        when.cast("long").alias("captured"),
    ).withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Payloads met more than once; only their digests and keys are shuffled here.
    repeated = rows.where(F.col("bytes") >= least_revisit).groupBy("digest").agg(
        F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(repeated, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    end = F.lit("\r\n")

    def identity(of: str) -> Column:
        return F.concat(F.lit("urn:page:"), F.coalesce(F.col(of).cast("string"), F.lit("none")))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, end)

    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]+", "%20"), identity("page_id"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(
        F.lit(HTTP_HEAD), F.col("bytes").cast("string"), F.lit("\r\n\r\n"), F.col("html")))
    record = F.concat(
        F.lit(VERSION), end,
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", F.concat(F.lit("<"), identity("page_id"), F.lit(">"))),
        field("WARC-Date", _iso(F.col("captured"))),
        field("WARC-Target-URI", uri),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            field("WARC-Profile", F.lit(SAME_PAYLOAD)),
            field("WARC-Refers-To", F.concat(F.lit("<"), identity("first_id"), F.lit(">"))),
        )).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), field("X-Page-ID", F.col("page_id").cast("string")))
        .otherwise(F.lit("")),
        field("X-Payload-Length", F.col("bytes").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        end, block)
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(folder)


def _records(fragments: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, int, dict, bytes]]:
    """Archive, offset, header and block of each record.

    A fragment is what lies between two version lines of an archive; a record whose block
    has that line inside takes as many fragments as its length asks for.
    """
    line = VERSION.encode() + b"\r\n"
    archive, offset, held, wanted = None, 0, [], 0
    size = 0
    for name, fragment in fragments:
        if name != archive:
            if held:
                raise ValueError(f"{archive} ends inside a record")
            archive, offset = name, -len(line)  # before the first version line lies nothing
        if not held:
            head_end = fragment.find(b"\r\n\r\n")
            if head_end < 0:
                if fragment:
                    raise ValueError(f"{archive}: no record at {offset}")
                offset += len(line)
                continue
            header = dict(x.split(": ", 1) for x in fragment[:head_end].decode().split("\r\n"))
            wanted = head_end + 4 + int(header["Content-Length"]) + 4
            held, size = [fragment], len(fragment)
        else:
            held += [line, fragment]
            size += len(line) + len(fragment)
        if size >= wanted:
            whole = held[0] if len(held) == 1 else b"".join(held)
            if size != wanted or whole[-4:] != b"\r\n\r\n":
                raise ValueError(f"{archive}: a record at {offset} has another length than it says")
            yield archive, offset, header, whole[head_end + 4:-4]
            offset += len(line) + size
            held = []
    if held:
        raise ValueError(f"{archive} ends inside a record")


def _fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Archives cut at version lines; gzip files are read whole by one task, in order."""
    return spark.read.option("lineSep", VERSION + "\r\n").text(folder).select(
        F.col("_metadata.file_path").alias("archive"), F.col("value").cast("binary").alias("value"))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, dict, bytes]]:
    return _records((name, value or b"") for batch in batches for name, value in zip(
        batch.column("archive").to_pylist(), batch.column("value").to_pylist()))


def _payload(header: dict, block: bytes) -> bytes:
    return block.split(b"\r\n\r\n", 1)[1] if header["WARC-Type"] == "response" else b""


def _number(value: str | None) -> int | None:
    return int(value) if value is not None else None


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record: ``archive``, ``offset`` (of the version line, uncompressed),
    ``record_type``, ``url``, ``date``, ``page_id``, ``payload_digest``, ``payload``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive, offset, header, block in _stream(batches):
            yield pa.RecordBatch.from_pylist([{
                "archive": archive, "offset": offset, "record_type": header["WARC-Type"],
                "url": header["WARC-Target-URI"], "date": header["WARC-Date"],
                "page_id": _number(header.get("X-Page-ID")),
                "payload_digest": header["WARC-Payload-Digest"].removeprefix("sha1:"),
                "payload": _payload(header, block)}], schema=kind)

    kind = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()),
                      ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()),
                      ("payload_digest", pa.string()), ("payload", pa.binary())])
    return _fragments(spark, folder).mapInArrow(run, (
        "archive string, offset long, record_type string, url string, date string, "
        "page_id long, payload_digest string, payload binary"))


def url_key(url: str) -> str:
    """The URL with its host names in reverse order, for sorting by site."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    host = host.removeprefix("www.")
    place = ",".join(reversed(host.split(".")))
    if port and port not in (80, 443):
        place += f":{port}"
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


RUN = ("run string, seq long, url_key string, captured string, offset long, page_id long, "
       "payload_bytes long, payload_digest string, record_type string, refers_to long")
RUN_KIND = pa.schema([
    ("run", pa.string()), ("seq", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()),
    ("offset", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def capture_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One index row a record; each archive is a run, ``seq`` its sorted order.

    Payloads are read and hashed; a response that differs from its own header raises.
    """
    def index(archive: str, rows: list[dict]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r["url_key"], r["captured"], r["offset"]))
        for k, row in enumerate(rows):
            row |= {"run": archive, "seq": k}
        return pa.RecordBatch.from_pylist(rows, schema=RUN_KIND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for archive, offset, header, block in _stream(batches):
            if archive != now and rows:
                yield index(now, rows)
                rows = []
            now = archive
            size = int(header["X-Payload-Length"])
            digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
            if header["WARC-Type"] == "response":
                payload = _payload(header, block)
                if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"{archive}: the payload at {offset} is not what was written")
            refers = header.get("WARC-Refers-To")
            rows.append({
                "url_key": url_key(header["WARC-Target-URI"]), "captured": header["WARC-Date"],
                "offset": offset, "page_id": _number(header.get("X-Page-ID")),
                "payload_bytes": size, "payload_digest": digest,
                "record_type": header["WARC-Type"],
                "refers_to": int(refers.strip("<>").rsplit(":", 1)[1]) if refers else None})
        if rows:
            yield index(now, rows)

    return _fragments(spark, folder).mapInArrow(run, RUN)


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of the match below it, so
    the next least item costs one match a level."""

    def __init__(self, runs: list[Iterator], key):
        self.key = key
        self.runs = runs
        self.leaves = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads = [self._next(k) for k in range(self.leaves)]
        self.loser = [0] * self.leaves
        self.winner = self._play(1)

    def _next(self, k: int):
        item = next(self.runs[k], None) if k < len(self.runs) else None
        return (1,) if item is None else (0, self.key(item), k, item)

    def _play(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self.heads[a][:3] <= self.heads[b][:3] else (b, a)
        self.loser[node] = lost
        return won

    def __iter__(self):
        while self.heads[self.winner][0] == 0:
            k = self.winner
            yield self.heads[k][3]
            self.heads[k] = self._next(k)
            node = (k + self.leaves) >> 1
            while node:
                if self.heads[self.loser[node]][:3] < self.heads[k][:3]:
                    k, self.loser[node] = self.loser[node], k
                node >>= 1
            self.winner = k


def capture_history(runs: DataFrame, rows_per_merge: int = ROWS_PER_MERGE) -> DataFrame:
    """All rows of ``runs`` ordered by URL key and time, over all partitions in turn."""
    runs = cut_lineage(runs)
    tasks = max(1, -(-runs.count() // rows_per_merge))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[dict]] = {}
        for batch in batches:  # by run, then in the run's own order
            for row in batch.to_pylist():
                parts.setdefault(row["run"], []).append(row)
        merged, tree = [], LoserTree([iter(p) for _, p in sorted(parts.items())],
                                     lambda r: (r["url_key"], r["captured"]))
        for row in tree:
            merged.append(row)
            if len(merged) == 10_000:
                yield pa.RecordBatch.from_pylist(merged, schema=RUN_KIND)
                merged = []
        if merged:
            yield pa.RecordBatch.from_pylist(merged, schema=RUN_KIND)

    return runs.repartitionByRange(tasks, "url_key", "captured", "run", "seq").sortWithinPartitions(
        "run", "seq").mapInArrow(merge, RUN)


def archived_pages(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """Write the pages, read the archives back, and give the merged history a page:
    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""
    write_archives(pages, folder, **columns)
    return capture_history(capture_runs(pages.sparkSession, folder)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")
