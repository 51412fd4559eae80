"""WARC archives of pages, and an external merge of their sorted capture runs by URL key and time."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partita.llm.common import shared_path, stored

#: Every record ends with this; the text writer puts it after each row.
_END = "\r\n\r\n"
_EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """A sortable form of a URL: host labels turned round, lower case, query parameters in order."""
    try:
        parts = urlsplit((url or "").strip().lower())
    except ValueError:
        return (url or "").strip().lower()
    host = ",".join(reversed((parts.hostname or "").split(".")))
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{host}){parts.path or '/'}" + (f"?{query}" if query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _record(kind: str, page_id, url: str | None, stamp: str, digest: str, size: int, refers_to, body: str) -> str:
    uri = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {stamp}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = body if kind == "response" else ""
    return "\r\n".join([*head, f"Content-Length: {len(body.encode('utf-8', 'surrogatepass'))}"]) + "\r\n\r\n" + body


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with (payload, sha, refers_to): of equal payloads of at least `min_bytes` the largest page_id is the response.

    Digests are grouped before pages move; only digests that occur twice come back to the pages.
    """
    named = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("sha", F.sha1(F.encode("payload", "UTF-8")))
    small = F.octet_length("payload") < min_bytes
    firsts = named.filter(~small).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("sha", "first")
    other = ~small & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return named.join(firsts, "sha", "left").select("page_id", "url", "payload", "sha", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_each: int = 2000) -> None:
    """One WARC record per row of pages, in plain archives of at most `records_each` records below path: offsets are places in the file.

    Spark's own writer stores the records, so the folder may be in any store that Spark reaches. Pages carry no
    time: a page's id counts seconds from a fixed day.
    """

    def run(batches):
        for b in batches:
            out = []
            for page_id, url, payload, sha, refers_to in b.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                stamp = (_EPOCH + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")
                digest = base64.b32encode(bytes.fromhex(sha)).decode("ascii")
                kind = "response" if refers_to is None else "revisit"
                size = len(payload.encode("utf-8", "surrogatepass"))
                out.append(_record(kind, page_id, url if isinstance(url, str) else None, stamp, digest, size, refers_to, payload))
            yield pd.DataFrame({"value": out})

    rows = decide(pages, min_bytes).mapInPandas(run, "value string")
    rows.write.option("lineSep", _END).option("compression", "none").option("maxRecordsPerFile", records_each).text(path)


def read_records(raw: bytes):
    """(headers, payload, offset, length) of each record of an archive."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while at < len(raw):
        head = raw.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in raw[at:head].decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
        body = head + 4
        end = body + int(fields["Content-Length"])
        yield fields, raw[body:end], at, end - at
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"no record end at byte {end}")
        at = end + 4


_CAPTURE = "url_key string, captured_at string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"


def capture_runs(archives: DataFrame) -> DataFrame:
    """One row per record of archives (path, content), each archive's rows a run sorted by URL key, time and page.

    A response's length and digest are taken from the bytes read back; a digest that differs from its header's is an error.
    """

    def number(text: str) -> int | None:
        digits = re.fullmatch(r"<urn:page:(-?\d+)>", text)
        return int(digits[1]) if digits else None

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = []
                for f, payload, at, size in read_records(content):
                    said = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(f["X-Payload-Length"])
                    if f["WARC-Type"] == "response" and (payload_digest(payload) != said or len(payload) != n):
                        raise ValueError(f"{path}: the record at {at} is damaged")
                    uri = f.get("WARC-Target-URI", "")
                    rows.append((url_key(uri), f["WARC-Date"], number(f["WARC-Record-ID"]), uri, f["WARC-Type"], number(f.get("WARC-Refers-To", "")), n, said, path, at, size))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[9]))
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _CAPTURE.split(", ")])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return archives.select("path", "content").mapInPandas(run, _CAPTURE)


class LoserTree:
    """k sorted runs merged: inner nodes hold the losers, so a step replays one path from leaf to root."""

    def __init__(self, runs: list) -> None:
        self.runs, self.k = [iter(r) for r in runs], max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = winner
                return
            if self._before(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.heads[top := self.tree[0]] is not None:
            yield self.heads[top][1]
            self.heads[top] = next(self.runs[top], None)
            self._play(top)


def merge_runs(runs: DataFrame, rows_each: int = 50_000) -> DataFrame:
    """The captures with their position (from 0) in one global order of URL key, time and page, and seen.

    The key range is cut into parts of about `rows_each` rows (time and page are part of the key, so a URL with a
    third of all captures is cut too); a part gets its segment of every run and merges them with a loser tree.
    seen counts a URL's captures from 1 within the part.
    """
    rows = runs.count()
    parts = max(1, -(-rows // rows_each))
    order = ["url_key", "captured_at", "page_id"]
    names = runs.columns

    def run(batches):
        segments: dict[str, list] = {}
        for b in batches:
            for row in b.itertuples(index=False):
                key = (row.url_key, row.captured_at, not pd.isna(row.page_id), 0 if pd.isna(row.page_id) else row.page_id, row.archive, row.offset)
                segments.setdefault(row.archive, []).append((key, tuple(row)))
        merged, seen, last = [], 0, None
        for place, row in enumerate(LoserTree([segments[k] for k in sorted(segments)])):
            seen = seen + 1 if row[1] == last else 1
            last = row[1]
            merged.append((*row, place, seen))
        frame = pd.DataFrame(merged, columns=["part", *names, "place", "seen"])
        yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    # a shuffle brings a run's blocks in any order: Spark puts each run's segment together again
    cut = runs.repartitionByRange(parts, *order).sortWithinPartitions("archive", *order, "offset").select(F.spark_partition_id().alias("part"), *names)
    merged = stored(cut.mapInPandas(run, f"part int, {_CAPTURE}, place long, seen long"), "merged")
    sizes = merged.groupBy("part").agg(F.count("*").alias("n"))  # one row per part
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return merged.join(sizes.select("part", before.alias("base")), "part").withColumn("position", F.col("base") + F.col("place")).drop("base", "part", "place")


def capture_history(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives pages (page_id, url, html) and returns the merged index of what was read back, one row per page.

    A null html is an empty payload, a null url an empty one. Equal payloads share a response, the row with the
    largest page_id; rows that repeat that page_id are responses too. Of payloads whose page_ids are all null every
    record is a response. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    write_archives(pages, folder, min_bytes)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return merge_runs(stored(capture_runs(archives), "captures"))
