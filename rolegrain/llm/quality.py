"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words (hashed to ``BUCKETS``, weighted by their counts and scaled to length one) and one bin
for each statistic of its structure and for the length its metadata states. The machine has a weight per feature and a
vector of ``RANK`` numbers per feature for the interactions of all pairs; the sum over pairs is half of (the square of the
sum less the sum of the squares), so a document is scored in time linear in its features.

It is fitted on the driver by adaptive stochastic gradient descent over a bounded sample of labelled rows, drawn evenly over
the labels and weighted back to their shares; executors turn sampled texts into features. Bins are quantiles of the sample.

Defined cases: null and empty texts have the statistics of an empty text and are scored like any other; without labels every
score is 0.5; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import restored, shielded
from .hashing import SpanHash, lean, lists, pieces

BUCKETS, RANK, BINS = 1 << 13, 8, 10
#: Labelled rows that are drawn for training, about.
SAMPLE = 6_000
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.05, 1e-5
#: Steps that a small sample takes at least.
STEPS = 300
STATISTICS = [
    "bytes", "words", "word_length", "upper", "digits", "symbols", "beyond_ascii", "lines", "line_length", "repeated_words",
    "distinct_words", "top_word", "repeated_lines", "closed_words", "stated_length",
]
UPPER, DIGIT, SYMBOL, GAP = (np.array([f(chr(b)) for b in range(256)]) for f in (
    lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: "!" <= c <= "~" and not c.isalnum(), lambda c: c in " \t\n\v\f\r",
))


class Reader:
    """Features of texts, a bounded group of pieces at a time."""

    def __init__(self) -> None:
        self.hash = SpanHash(5)

    def __call__(self, texts: list[bytes], stated: list[float]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Per text its word buckets with their weights, and a row of statistics."""
        sums = np.zeros((len(texts), 11))
        hashes: list[list[np.ndarray]] = [[] for _ in texts]
        lines: list[list[np.ndarray]] = [[] for _ in texts]
        for owners, parts in pieces(texts, 1 << 20):
            data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
            size = np.array([len(p) for p in parts])
            first = np.cumsum(size + 1) - size - 1
            owner = np.array(owners)
            totals = self.hash.sums(data)
            gap = GAP[data]
            edge = np.flatnonzero(np.diff(gap, prepend=True))
            begin, end = edge[::2], edge[1::2]
            of = np.searchsorted(first, begin, "right") - 1
            word = self.hash.spans(totals, begin, end)
            last = data[end - 1]
            closed = SYMBOL[last] & (last != 46) & (last != 44)
            breaks = np.flatnonzero(data == 10)
            line = self.hash.spans(totals, np.concatenate([[0], breaks[:-1] + 1]), breaks)
            line_of = np.searchsorted(first, breaks, "right") - 1
            again = np.concatenate([[False], (word[1:] == word[:-1]) & (of[1:] == of[:-1])])
            kinds = [UPPER[data], DIGIT[data], SYMBOL[data], data >= 128]
            columns = [size, np.bincount(of, minlength=len(parts)), np.bincount(of, end - begin, len(parts)), *(np.add.reduceat(k, first, dtype=np.int64) for k in kinds),
                       np.bincount(line_of, minlength=len(parts)), np.bincount(of, again, len(parts)), np.bincount(of, closed, len(parts))]
            np.add.at(sums, (owner[:, None], np.arange(10)), np.stack(columns, axis=1))
            for number, words_, lines_ in zip(owners, np.split(word, np.searchsorted(of, np.arange(1, len(parts)))), np.split(line, np.searchsorted(line_of, np.arange(1, len(parts)))), strict=True):
                hashes[number].append(words_)
                lines[number].append(lines_)
        features, rows = [], []
        for i, (total, state) in enumerate(zip(sums, stated, strict=True)):
            size, count, letters, upper, digits, symbols, beyond, breaks, again, closed = total[:10]
            own = np.concatenate(hashes[i]) if hashes[i] else np.zeros(0, np.uint64)
            bucket, number = np.unique((own >> np.uint64(51)).astype(np.int32), return_counts=True)
            length = np.sqrt((number.astype(float) ** 2).sum()) or 1.0
            features.append((bucket, (number / length).astype(np.float32)))
            distinct, often = np.unique(own, return_counts=True)
            line = np.concatenate(lines[i]) if lines[i] else np.zeros(0, np.uint64)
            n, m = max(1.0, size), max(1.0, count)
            rows.append((
                size, count, letters / m, upper / n, digits / n, symbols / n, beyond / n, breaks, size / max(1.0, breaks), again / m, len(distinct) / m,
                often.max(initial=0) / m, 1 - len(np.unique(line)) / max(1, len(line)), closed / m, state,
            ))
        return features, np.array(rows).reshape(len(texts), len(STATISTICS))


class Machine:
    """Weights ``w``, interaction vectors ``v`` and the bins' borders; a document is its words and one bin per statistic."""

    def __init__(self, borders: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.borders, self.bias, self.w, self.v = borders, bias, w, v

    def places(self, statistics: np.ndarray) -> np.ndarray:
        """Feature numbers of the statistics' bins."""
        bins = np.stack([np.searchsorted(b, column, "right") for b, column in zip(self.borders, statistics.T, strict=True)], axis=1)
        return BUCKETS + np.arange(len(self.borders)) * BINS + bins

    def scores(self, features: list[tuple[np.ndarray, np.ndarray]], statistics: np.ndarray) -> np.ndarray:
        out = np.empty(len(features))
        for i, ((bucket, weight), place) in enumerate(zip(features, self.places(statistics), strict=True)):
            at, x = np.concatenate([bucket, place]), np.concatenate([weight, np.ones(len(place), np.float32)])
            xv = x[:, None] * self.v[at]
            out[i] = self.bias + x @ self.w[at] + 0.5 * (xv.sum(axis=0) ** 2 - (xv**2).sum(axis=0)).sum()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(features: list[tuple[np.ndarray, np.ndarray]], statistics: np.ndarray, labels: np.ndarray, weights: np.ndarray, seed: int = 3) -> Machine:
    borders = np.stack([np.quantile(c, np.arange(1, BINS) / BINS) for c in statistics.T])
    rng = np.random.default_rng(seed)
    width = BUCKETS + len(STATISTICS) * BINS
    machine = Machine(borders, 0.0, np.zeros(width, np.float32), rng.normal(0, 0.01, (width, RANK)).astype(np.float32))
    place = machine.places(statistics)
    past_w, past_v, past_b = np.full(width, 1e-6, np.float32), np.full((width, RANK), 1e-6, np.float32), 1e-6
    order = np.arange(len(labels))
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(order))))):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            which = order[at : at + BATCH]
            x = np.zeros((len(which), width), np.float32)
            for i, r in enumerate(which):
                x[i, features[r][0]] = features[r][1]
            x[np.arange(len(which))[:, None], place[which]] = 1
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used]
            v = machine.v[used]
            xv, squares = x @ v, x * x
            logit = machine.bias + x @ machine.w[used] + 0.5 * (xv**2 - squares @ (v * v)).sum(axis=1)
            error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[which]) * weights[which] / len(which)).astype(np.float32)
            dw = x.T @ error + DECAY * machine.w[used]
            dv = x.T @ (error[:, None] * xv) - (squares.T @ error)[:, None] * v + DECAY * v
            past_w[used] += dw * dw
            past_v[used] += dv * dv
            past_b += float(error.sum()) ** 2
            machine.w[used] -= RATE * dw / np.sqrt(past_w[used])
            machine.v[used] -= RATE * dv / np.sqrt(past_v[used])
            machine.bias -= RATE * float(error.sum()) / past_b**0.5
    return machine


def stated_length(docs: DataFrame) -> Column:
    """The length that the metadata states; -1 where there is none."""
    return (F.coalesce(F.col("n_chars").cast("double"), F.lit(-1.0)) if "n_chars" in docs.columns else F.lit(-1.0)).alias("stated_length")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", sample: int = SAMPLE) -> Machine | None:
    """A machine of the labelled rows that ``usable`` admits; draws about ``sample`` of them, evenly over the labels."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(usable & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return None
    share = {k: min(1.0, sample / 2 / n) for k, n in sizes.items()}
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < F.when(F.col("label") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)) * (1 << 30))
    # About ``sample`` narrow rows: safe to broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), stated_length(docs)).join(F.broadcast(drawn), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for batch in batches:
            features, statistics = read([(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(2)], batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b for b, _ in features], pa.list_(pa.int32())), pa.array([w for _, w in features], pa.list_(pa.float32())),
                 pa.array(list(statistics), pa.list_(pa.float64()))],
                ["doc_id", "label", "buckets", "weights", "statistics"],
            )

    table = texts.select("doc_id", "label", "text", "stated_length").mapInArrow(
        lean(work), "doc_id long, label int, buckets array<int>, weights array<float>, statistics array<double>",
    ).toArrow()
    if not table.num_rows:
        return None
    known, statistics = table["label"].to_numpy(), np.stack(lists(table["statistics"]))
    bags = list(zip(lists(table["buckets"]), lists(table["weights"]), strict=True))
    ids = table["doc_id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], known[i], statistics[i].tolist()))
    back = np.array([1 / share[x] for x in known[order].tolist()])
    return train([bags[i] for i in order], statistics[order], known[order], back / back.mean())


def score(docs: DataFrame, machine: Machine | None, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``score``, the chance of label 1, and ``predicted``."""
    fields = [docs.schema[c] for c in keep]
    text = keep.index("text") if "text" in keep else len(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        for batch in batches:
            value = np.full(batch.num_rows, 0.5)
            if machine is not None and batch.num_rows:
                texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(text)]
                value = machine.scores(*read(texts, batch.column(batch.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(fields)], pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [*keep, "score", "predicted"],
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double, predicted int"])
    texts = [] if "text" in keep else [F.col("text").cast("string")]
    return docs.select(*keep, *texts, stated_length(docs)).mapInArrow(lean(work), schema)


def keep_good(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """The rows of ``docs`` that are predicted to have label 1."""
    needed = ["text", "n_chars"]
    safe = shielded(docs, needed)
    return restored(score(safe, machine, safe.columns).filter("predicted = 1"), docs, needed)
