"""WARC archives with deduplicated payloads, and their capture index.

Writing: equal payloads are found by digest (grouped before the shuffle; adaptive execution splits a
hot digest in the join), and each row becomes one WARC/1.1 record, written through Spark's text
writer, so that archives lie in any store that Spark reaches and a lost executor costs one task.

Reading: archives are cut at the version line by Spark's reader and put together by content length.
Each archive gives a locally sorted run of index entries. The runs are dealt by key ranges, and in
each range a loser tree merges the parts of all runs, so the whole is one globally ordered capture
history; the key ends with the record's place, so one URL with very many captures is split as well.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import fresh_path, parts_for

VERSION = "WARC/1.1\r\n"
URN = "urn:page:"
EPOCH = "2024-01-01T00:00:00Z"  # capture time of page 0; page n was captured n seconds later
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS_A_PART = 50_000
# The digits of conv() to base 32, and the base-32 alphabet of RFC 4648.
_CONV, _RFC = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = "url_key string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, record_bytes long"
KEY = ["url_key", "captured", "page_id", "archive", "offset"]


def payload_digest(payload: Column) -> Column:
    """Base-32 SHA-1 of the UTF-8 bytes: five hex digits are four base-32 digits."""
    digits = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _CONV, _RFC)


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, digest, refers_to)``; ``refers_to`` is null for responses."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", payload_digest(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    heads = rows.groupBy("digest").agg(F.max("page_id").alias("head"))
    first = (F.col("payload_bytes") < least_bytes) | F.col("page_id").eqNullSafe(F.col("head"))
    return rows.join(heads, "digest").select("page_id", "url", "payload", "payload_bytes", "digest", F.when(~first, F.col("head")).alias("refers_to"))


def record(url: Column, payload: Column) -> Column:
    """The record without version line's split mark and without its last line break, which the writer adds."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    again = F.col("refers_to").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, payload))
    clean = url
    for bad, code in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A")):
        clean = F.replace(clean, F.lit(bad), F.lit(code))
    seconds = F.coalesce(F.col("page_id"), F.lit(0)) + F.unix_seconds(F.lit(EPOCH).cast("timestamp"))
    return F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{URN}"), number, F.lit(">"))),
        line("WARC-Target-URI", clean),
        line("WARC-Date", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", F.concat(F.lit(f"<{URN}"), F.col("refers_to").cast("string"), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block, F.lit("\r\n"),
    )


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """One WARC record per row into gzip archives under ``path``.

    Null payloads are empty; null URLs are empty; a null id is left out of the record's name; repeated
    rows give repeated records; an empty table gives an archive without records.
    """
    rows = decide(pages, **columns)
    rows.select(record(F.col("url"), F.col("payload")).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Sort-friendly form: the host's labels from the top level down, then path and query."""
    try:
        parts = urlsplit(url.lower())
        host, rest = parts.netloc, parts.path + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        return url
    return f"{','.join(reversed(host.removeprefix('www.').split('.')))}){rest or '/'}"


def _parse(archive: str, offset: int, data: bytes) -> tuple | None:
    """The index entry of a whole record (without version line); None while its block is not complete."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark:
        return None
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n") if ": " in x)
    length = int(fields["Content-Length"])
    if len(rest) < length + 4:
        return None
    number = lambda x: int(x) if (x := x.removeprefix(f"<{URN}").removesuffix(">")) else None
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        seen = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (seen, len(payload)) != (digest, size):
            raise ValueError(f"{archive} at {offset}: the payload does not match its digest and length")
    return (
        url_key(fields.get("WARC-Target-URI", "")), fields["WARC-Date"], number(fields["WARC-Record-ID"]), fields["WARC-Type"],
        number(fields.get("WARC-Refers-To", "")), size, digest, archive, offset, len(VERSION) + len(data),
    )


def _entries(rows: Iterator[tuple[str, str]]) -> Iterator[tuple]:
    """Index entries from the pieces between version lines; a payload may hold the version line itself."""
    mark, at = VERSION.encode(), {}
    archive, held = None, b""
    for name, value in rows:
        piece = value.encode()
        if name != archive:
            if held:
                raise ValueError(f"{archive} ends within a record")
            archive, at[name], held = name, 0, b""
            if not piece:
                continue  # what stands before the first version line
        held = held + mark + piece if held else piece
        entry = _parse(archive, at[archive], held)
        if entry:
            yield entry
            at[archive] += len(mark) + len(held)
            held = b""
    if held:
        raise ValueError(f"{archive} ends within a record")


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    names, types = zip(*(x.split() for x in INDEX.split(", ")))
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types)], list(names))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    pieces = ((n, v) for b in batches for n, v in zip(b.column(0).to_pylist(), b.column(1)) for v in (v.as_py(),))
    for entry in _entries(pieces):
        held.append(entry)
        if len(held) >= 8192:
            yield _as_batch(held)
            held = []
    yield _as_batch(held)


def sorted_runs(spark: SparkSession, archives: str, runs: str) -> DataFrame:
    """Write each reading task's index entries as one sorted run; the runs, with ``run``, are returned."""
    lines = spark.read.option("lineSep", VERSION).text(archives).select(F.col("_metadata.file_path").alias("archive"), "value")
    index = lines.mapInArrow(_index, INDEX).withColumn("run", F.spark_partition_id()).sortWithinPartitions(*KEY)
    index.write.parquet(runs)
    return spark.read.parquet(runs)


class LoserTree:
    """k-way merge: each inner node keeps the loser of its match, the winner stands on top."""

    def __init__(self, sources: list[Iterator], key):
        self.sources, self.key, self.k = sources, key, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (self.key(x), a) < (self.key(y), b))

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.losers[node] < 0:  # first round: wait for the other side
                self.losers[node] = i
                return
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        while self.k and self.heads[top := self.losers[0]] is not None:
            yield self.heads[top]
            self.heads[top] = next(self.sources[top], None)
            self._replay(top)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[tuple, list[tuple]] = {}
    turn: dict[int, int] = {}
    for batch in batches:
        *cols, run = [c.to_pylist() for c in batch.columns]
        for row, r in zip(zip(*cols), run):
            part = runs.setdefault((r, turn.setdefault(r, 0)), [])
            if part and _order(row) < _order(part[-1]):  # a run read in two parts
                turn[r] += 1
                part = runs.setdefault((r, turn[r]), [])
            part.append(row)
    out: list[tuple] = []
    for row in LoserTree([iter(runs[k]) for k in sorted(runs)], _order):
        out.append(row)
        if len(out) >= 8192:
            yield _as_batch(out)
            out = []
    yield _as_batch(out)


def capture_history(runs: DataFrame, n_rows: int) -> DataFrame:
    """All index entries in global order of URL key, capture time and page."""
    keys = [F.col(k).asc_nulls_first() for k in KEY]
    return runs.select(*(x.split()[0] for x in INDEX.split(", ")), "run").repartitionByRange(parts_for(n_rows, ROWS_A_PART, 8), *keys).mapInArrow(_merge, INDEX)


def archive_and_read(pages: DataFrame, **columns) -> DataFrame:
    """Write the archives to the shared folder, read them back and return the capture history."""
    spark = pages.sparkSession
    archives, runs = fresh_path(spark, "warc"), fresh_path(spark, "runs")
    write_archives(pages, archives, **columns)
    found = sorted_runs(spark, archives, runs)
    return capture_history(found, found.count())
