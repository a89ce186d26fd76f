"""URL filter: host and path rules in a sorted array of digests.

A rule is a host and a path prefix in one string (``example.org/es/``); it fits its host and all subdomains if the path
starts with the rule's. The longest rule that fits wins (of equally long ones that with the longer host); a url that none
fits gets the default verdict.

The list is written once as a file of sorted 64-bit XXH64 digests with the rules' strings, handed to every executor with
``SparkContext.addFile`` and memory-mapped by each task. A url's candidates are its host's suffixes at label borders, each
with the path prefixes of those lengths that rules have; they are looked up by a vectorised binary search, and the stored
string must equal the candidate, so colliding digests do no harm. Lists beyond ``max_bytes`` are not sent to executors: the
same candidates are joined with the list.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; an empty url table gives no
rows; an empty list gives every url the default; repeated rows are judged separately.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of rule strings up to which the list is sent to all executors.
MAX_BYTES = 256 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def normal(rule: str) -> str:
    """The rule with its host's A-Z lower-cased."""
    name, slash, rest = rule.partition("/")
    return name.translate(str.maketrans(UPPER, LOWER)) + slash + rest


def digest(text: str | bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def encode(rules: list[tuple[str, str]], key=digest) -> bytes:
    """File content: count, size of the strings, digests in ascending order, offsets, verdict lengths, strings.

    Of a rule listed with several verdicts the last in code-point order counts (block before allow).
    """
    items = sorted((key(r.encode()), r.encode(), v.encode()) for r, v in dict(sorted((normal(r), v) for r, v in rules)).items())
    offsets = np.cumsum([0, *(len(r) + len(v) for _, r, v in items)]).astype("<i8")
    split = np.array([len(r) for _, r, _ in items], "<i8")
    blob = b"".join(r + v for _, r, v in items)
    digests = np.array([k for k, _, _ in items], "<u8")
    return struct.pack("<qq", len(items), len(blob)) + digests.tobytes() + offsets.tobytes() + split.tobytes() + blob


class DigestArray:
    """A memory-mapped rule list."""

    def __init__(self, file: str, key=digest) -> None:
        raw = np.memmap(file, np.uint8, "r")
        n, size = struct.unpack("<qq", raw[:16].tobytes())
        self.digests = raw[16 : 16 + 8 * n].view("<u8")
        self.offsets = raw[16 + 8 * n : 24 + 16 * n].view("<i8")
        self.split = raw[24 + 16 * n : 24 + 24 * n].view("<i8")
        self.blob = raw[24 + 24 * n : 24 + 24 * n + size]
        self.key = key

    def stored(self, i: int) -> tuple[bytes, bytes]:
        whole = self.blob[self.offsets[i] : self.offsets[i + 1]].tobytes()
        return whole[: self.split[i]], whole[self.split[i] :]

    def find(self, texts: list[bytes]) -> np.ndarray:
        """Place of each text in the list, or -1; equal digests are told apart by the stored strings."""
        wanted = np.fromiter(map(self.key, texts), np.uint64, len(texts))
        place = np.searchsorted(self.digests, wanted)
        found = np.full(len(texts), -1, np.int64)
        todo = np.flatnonzero((place < len(self.digests)) & (self.digests[np.minimum(place, len(self.digests) - 1)] == wanted)) if len(self.digests) else []
        for i in todo:
            at = int(place[i])
            while at < len(self.digests) and self.digests[at] == wanted[i]:
                if self.stored(at)[0] == texts[i]:
                    found[i] = at
                    break
                at += 1
        return found


def suffixes(name: str) -> list[str]:
    """The host and its parents, longest first."""
    labels = name.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def candidates(name: str, route: str, lengths: list[int]) -> list[str]:
    """Every rule that could fit, the best first."""
    heads = [route[:n] for n in lengths if n <= len(route)]
    return sorted((s + h for s in suffixes(name) for h in heads), key=len, reverse=True)


def judge(
    urls: DataFrame, rules: list[tuple[str, str]] | DataFrame, key: str = "page_id", url: str = "url", default: str = "allow",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``key, host, path, rule, verdict`` per row; ``rules`` are (rule, verdict) pairs or a frame of these columns."""
    spark = urls.sparkSession
    split = urls.select(F.col(key), host(F.col(url).cast("string")).alias("host"), path(F.col(url).cast("string")).alias("path"))
    if isinstance(rules, DataFrame):
        if (rules.agg(F.sum(F.octet_length("rule"))).first()[0] or 0) > max_bytes:
            return judge_by_join(split, rules, key, default)
        rules = [(r["rule"], r["verdict"]) for r in rules.collect()]
    content = encode(rules)
    lengths = sorted({len(normal(r)) - len(normal(r).partition("/")[0]) for r, _ in rules}, reverse=True)
    name = f"url-rules-{xxhash.xxh3_128_hexdigest(content)}.bin"
    if not any(file.endswith(name) for file in spark.sparkContext.listFiles):  # one list is sent once per session
        staged = os.path.join(tempfile.mkdtemp(), name)
        with open(staged, "wb") as file:
            file.write(content)
        spark.sparkContext.addFile(staged)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = DigestArray(SparkFiles.get(name))
        for batch in batches:
            options = [candidates(h, p, lengths) if h else [] for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            flat = [c.encode() for own in options for c in own]
            places = known.find(flat)
            rule, verdict, at = [], [], 0
            for own in options:
                hits = places[at : at + len(own)]
                at += len(own)
                best = hits[hits >= 0][:1]
                text, said = known.stored(int(best[0])) if len(best) else (None, default.encode())
                rule.append(text and text.decode())
                verdict.append(said.decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names)

    names = [key, "host", "path", "rule", "verdict"]
    return split.mapInArrow(work, f"`{key}` {split.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string")


def judge_by_join(split: DataFrame, rules: DataFrame, key: str, default: str) -> DataFrame:
    """The same verdicts by an equi-join of distinct (host, path prefix) candidates with a list of any size."""
    own = rules.select(F.concat(F.translate(F.regexp_extract("rule", "^[^/]*", 0), UPPER, LOWER), F.regexp_extract("rule", "/(?s:.*)$", 0)).alias("rule"), "verdict")
    own = own.groupBy("rule").agg(F.max("verdict").alias("verdict"))
    lengths = [r[0] for r in own.select(F.length(F.regexp_extract("rule", "/(?s:.*)$", 0)).alias("n")).distinct().collect()]
    labels = F.split("host", "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda h: h.isNotNull())
    addresses = split.select("host", "path").distinct()
    pairs = addresses.filter("host <> ''").select("host", "path", F.explode(parents).alias("parent"))
    pairs = pairs.withColumn("head", F.explode(heads)).select("host", "path", F.concat("parent", "head").alias("rule"), F.length("parent").alias("n"))
    best = pairs.join(own, "rule").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "n")).alias("best"))
    return split.join(best, ["host", "path"], "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
