"""WARC archives with deduplicated payloads, and the merge of their index into capture histories.

*Writing.* One record per page. Of equal payloads the record of the smallest page id is a ``response``, the others are
``revisit`` records that name it; payloads below ``least`` bytes are always responses. Records are written with Spark's own
text writer, whose line end is the blank line that ends a WARC record, so any file system and lost executors are its matter.
Files hold at most ``records`` records each.

*Index.* Every task that reads archives back sorts the captures of its files by URL key, timestamp and record: a local run.
Runs are cut at sampled borders, and every range merges its pieces of all runs with a loser tree: ranges in order are the
global order of all captures. A border may fall inside one URL's captures, so a URL with very many of them is no bottleneck.

Defined cases: a null html is an empty payload; a null or odd url is written percent-encoded and its key is its text; equal
pages with one id are separate captures, all of them responses if the id is the smallest; pages with a null id sort before
all others, are responses and are never referred to; an empty table gives no archive records and no captures.
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
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, stored

RECORDS = 2000
#: Captures that a range of the merge takes, about.
RANGE = 50_000
END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexadecimal: Column) -> Column:
    """Base32 of a SHA-1 given as 40 hexadecimal digits: five of them are four letters."""
    parts = [F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    letters = [F.substring(F.lit(ALPHABET), F.shiftright(p, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for p in parts for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, least: int) -> DataFrame:
    """``page_id`` and the WARC ``record`` (without its closing blank line) of every page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    sized = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).alias("size"), F.sha1(F.encode(html, "utf-8")).alias("sha1"),
    )
    first = sized.filter(F.col("size") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Only payloads that occur more than once need a look-up; stored, so that a payload of very many pages can be split.
    first = stored(first.filter("n > 1").select(F.col("sha1").alias("of"), "first"))
    joined = sized.join(first, sized["sha1"] == first["of"], "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))
    urn = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    when = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 28))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.replace(F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    common = [
        F.lit("\r\nWARC-Record-ID: "), urn, F.lit("\r\nWARC-Date: "), when, F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1")),
    ]
    response = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response"), *common, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END), F.col("html"),
    )
    pointer = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: revisit"), *common, F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
        F.format_string("<urn:page:%d>", "first"), F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"), F.lit("\r\nContent-Length: 0" + END),
    )
    return joined.select("page_id", F.when(revisit, pointer).otherwise(response).alias("record"))


def write(pages: DataFrame, folder: str, least: int = 0, per_file: int = RECORDS) -> None:
    """Archives of all pages below ``folder``, gzip-compressed."""
    (
        records(pages, least).select("record").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file)
        .text(folder)
    )


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of every record of an archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:head].decode("utf-8").split("\r\n")[1:])
        at = head + 4 + int(fields["Content-Length"])
        yield fields, data[head + 4 : at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        at += 4


def number(urn: str | None) -> int | None:
    inner = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def url_key(url: str) -> str:
    """Host labels from the right, then the path: captures of a domain sort together."""
    rest = url.partition("://")[2] or url
    host, slash, path = rest.partition("/")
    name, colon, port = host.lower().partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + slash + path


CAPTURE = "key string, stamp string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
NAMES = [x.split()[0] for x in CAPTURE.split(", ")]
KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def place(row: tuple) -> tuple:
    """Order of captures: URL key, timestamp, page id (none first), digest."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[5]


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Captures read back from archives; ``run`` numbers the task's locally sorted run and ``seq`` the place in it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, piece = TaskContext.get().partitionId() << 20, 0
        for batch in batches:
            for content in batch.column(0):
                captures = []
                for fields, payload in parse(zlib.decompress(content.as_py(), wbits=47)):
                    kind, url = fields["WARC-Type"], fields["WARC-Target-URI"].replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
                        size = len(payload)
                    else:
                        size = int(fields["X-Payload-Length"])
                    captures.append((url_key(url), fields["WARC-Date"], number(fields["WARC-Record-ID"]), url, size, stated, kind, number(fields.get("WARC-Refers-To"))))
                captures.sort(key=place)
                made = [pa.array(c, k) for c, k in zip(list(zip(*captures, strict=True)) or [()] * 8, KINDS, strict=True)]
                n = len(captures)
                yield pa.RecordBatch.from_arrays([*made, pa.array([run + piece] * n, pa.int64()), pa.array(range(n), pa.int64())], [*NAMES, "run", "seq"])
                piece += 1

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(work, f"{CAPTURE}, run long, seq long")


class LoserTree:
    """K-way merge: inner nodes keep the losers of their matches, so the next winner costs one match per level."""

    def __init__(self, sources: list[list[tuple]]) -> None:
        self.sources = sources
        self.at = [0] * len(sources)
        self.k = len(sources)
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, one: int, other: int) -> bool:
        a = self.sources[one][self.at[one]][0] if self.at[one] < len(self.sources[one]) else None
        b = self.sources[other][self.at[other]][0] if self.at[other] < len(self.sources[other]) else None
        return b is None and a is not None or a is not None and (a, one) < (b, other)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            rival = self.tree[node]
            if rival == -1:
                self.tree[node] = winner
                return
            if self._less(rival, winner):
                self.tree[node], winner = winner, rival
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            winner = self.tree[0]
            if self.at[winner] >= len(self.sources[winner]):
                return
            yield self.sources[winner][self.at[winner]]
            self.at[winner] += 1
            self._play(winner)


def histories(captures: DataFrame, per_range: int = RANGE) -> DataFrame:
    """All captures in global order: ``range`` numbers follow one another, ``position`` counts inside a range."""
    captures = stored(captures)
    ranges = max(1, -(-captures.count() // per_range))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces.setdefault(row[8], []).append((row[9], row[:8]))
        sources = [[(place(r), r) for _, r in sorted(pieces[run])] for run in sorted(pieces)]
        merged = [row for _, row in LoserTree(sources)]
        made = [pa.array(c, k) for c, k in zip(list(zip(*merged, strict=True)) or [()] * 8, KINDS, strict=True)]
        n = len(merged)
        number_of = pa.array([TaskContext.get().partitionId()] * n, pa.int32())
        yield pa.RecordBatch.from_arrays([number_of, pa.array(range(n), pa.int64()), *made], ["range", "position", *NAMES])

    dealt = captures.repartitionByRange(ranges, "key", "stamp", "page_id")
    return dealt.mapInArrow(merge, f"range int, position long, {CAPTURE}")


def archive(pages: DataFrame, least: int = 0, per_file: int = RECORDS, per_range: int = RANGE) -> DataFrame:
    """Writes archives of ``pages`` to the shared folder and returns their capture histories."""
    spark = pages.sparkSession
    folder = os.path.join(ensure_checkpoint_dir(spark), f"warc-{uuid.uuid4().hex}")
    write(pages, folder, least, per_file)
    return histories(runs(spark, folder), per_range)
