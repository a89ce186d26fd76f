"""Language identification by averaged subword embeddings and a linear softmax.

A text is lower-cased and everything but letters becomes a space; its subwords are the 2 to 4 byte strings inside words, with
the spaces beside them, hashed to ``BUCKETS`` buckets. The text's vector is the average of its subwords' embeddings, and a
linear softmax over it gives the language. Embeddings and softmax are trained together on the driver by stochastic gradient
descent over a bounded sample; executors turn sampled texts into bucket counts, so the driver's share is bounded by rows and
buckets. A temperature fitted on a held-out part of the sample calibrates the scores, and the least score above which at
least ``PRECISION`` of that part is right is the threshold of rejection.

For prediction the product of embeddings and softmax is folded into one score per bucket and language, so a text is the
average of table rows; whole texts are read, in pieces.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled row every text is ``und``;
repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import lists, pieces

BUCKETS, WIDTH = 1 << 14, 16
ORDERS = (2, 3, 4)
#: Labelled rows that are drawn for training, about.
SAMPLE = 6_000
EPOCHS, BATCH, RATE = 10, 32, 2.0
#: Steps that a small sample takes at least.
STEPS = 800
#: An average spreads a text's gradient over its subwords; the rate of the embeddings makes up for it.
SPREAD = 200.0
PRECISION = 0.99
SPACE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def subwords(data: np.ndarray) -> list[np.ndarray]:
    """Per order the bucket of every subword; those across words fall to the last bucket."""
    codes = data.astype(np.uint32)
    gap = data == 32
    out = []
    for n in ORDERS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        code = np.full(count, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            code = code * np.uint32(0x01000193) ^ codes[i : i + count]
        code *= np.uint32(0x85EBCA6B)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0xC2B2AE35)
        bucket = (code >> np.uint32(18)).astype(np.int32)
        inner = gap[:count] & gap[1 : 1 + count] if n == 2 else gap[1 : 1 + count].copy()
        for i in range(2, n - 1):
            inner |= gap[i : i + count]
        bucket[inner] = BUCKETS
        out.append(bucket)
    return out


def plain(text: str | None) -> bytes:
    """Lower-case letters and spaces of a text."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(SPACE)


def by_piece(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Owners, starts and subword buckets of bounded groups of pieces."""
    for owners, parts in pieces(texts, 1 << 20):
        data = np.frombuffer(b" " + b"  ".join(parts) + b" ", np.uint8)
        starts = np.cumsum([0] + [len(p) + 2 for p in parts[:-1]])
        yield np.array(owners), starts, subwords(data)


def counts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and their counts per text."""
    found: list[dict[int, int]] = [{} for _ in texts]
    for owners, starts, orders in by_piece(texts):
        for bucket in orders:
            cuts = np.searchsorted(np.arange(len(bucket)), starts[1:])
            for owner, part in zip(owners.tolist(), np.split(bucket, cuts), strict=True):
                for b, n in zip(*(x.tolist() for x in np.unique(part[part < BUCKETS], return_counts=True)), strict=True):
                    found[owner][b] = found[owner].get(b, 0) + n
    return [(np.array(sorted(f), np.int32), np.array([f[b] for b in sorted(f)], np.float32)) for f in found]


class Model:
    """Folded scores per bucket (the last row for subwords that do not count), bias, temperature, threshold."""

    def __init__(self, names: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float) -> None:
        self.names, self.table, self.bias, self.temperature, self.threshold = names, table, bias, temperature, threshold

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probabilities per text and language."""
        total = np.zeros((len(texts), len(self.names)))
        number = np.zeros(len(texts))
        for owners, starts, orders in by_piece(texts):
            for bucket in orders:
                inside = starts[starts < len(bucket)]
                own = owners[: len(inside)]
                for c in range(len(self.names)):
                    np.add.at(total[:, c], own, np.add.reduceat(self.table[c][bucket], inside, dtype=np.float64))
                np.add.at(number, own, np.add.reduceat(bucket < BUCKETS, inside, dtype=np.int64))
        return softmax((total / np.maximum(number, 1)[:, None] + self.bias) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 3) -> Model:
    """Stochastic gradient descent over average vectors; every fifth row is kept for calibration."""
    names = sorted(set(labels))
    goal = np.array([names.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(names)), np.float32), np.zeros(len(names), np.float32)

    def dense(which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), BUCKETS), np.float32)
        for i, r in enumerate(which):
            out[i, rows[r][0]] = rows[r][1] / max(1.0, rows[r][1].sum())
        return out

    order = rng.permutation(len(rows))
    tuning, fitting = (order[::5], order[np.arange(len(order)) % 5 > 0]) if len(order) >= 20 else (order, order)
    batches = -(-len(fitting) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        rng.shuffle(fitting)
        for at in range(0, len(fitting), BATCH):
            which = fitting[at : at + BATCH]
            x = dense(which)
            hidden = x @ table
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(which)), goal[which]] -= 1
            error = (error / len(which)).astype(np.float32)
            rate = np.float32(RATE * (1 - step / steps))
            back = error @ weights.T
            weights -= rate * hidden.T @ error
            bias -= rate * np.float32(0.1) * error.sum(axis=0)
            table -= rate * np.float32(SPREAD) * (x.T @ back)
            step += 1
    logits = np.concatenate([dense(tuning[a : a + 256]) @ table @ weights + bias for a in range(0, len(tuning), 256)]).astype(float)
    temperature = min((t / 20 for t in range(2, 101)), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(tuning)), goal[tuning]] + 1e-12).sum())
    chance = softmax(logits / temperature)
    best, right = chance.max(axis=1), chance.argmax(axis=1) == goal[tuning]
    falling = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[falling]) >= PRECISION * np.arange(1, len(falling) + 1))
    threshold = float(best[falling[good[-1]]]) if len(good) else 1.0
    folded = np.concatenate([(table @ weights).T, np.zeros((len(names), 1))], axis=1).astype(np.float32)
    return Model(names, folded, bias.astype(float), temperature, threshold)


def fit(docs: DataFrame, usable: Column, label: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of the labelled rows that ``usable`` admits; draws about ``sample`` of them, evenly over the labels."""
    rows = docs.filter(usable & F.col(label).isNotNull())
    sizes = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if not sizes:
        return None
    each = sample / len(sizes)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, each / n))]), F.col(label))
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = counts([plain(x.as_py()) for x in batch.column(2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b for b, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.float32()))],
                ["doc_id", "label", "buckets", "counts"],
            )

    table = drawn.select(F.col("doc_id").cast("long"), F.col(label).cast("string"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, label string, buckets array<int>, counts array<float>",
    ).toArrow()
    names, bags = table["label"].to_pylist(), list(zip(lists(table["buckets"]), lists(table["counts"]), strict=True))
    order = sorted(range(len(names)), key=lambda i: (table["doc_id"][i].as_py() or 0, names[i], bags[i][0].tobytes()))
    return train([bags[i] for i in order], [names[i] for i in order])


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` (calibrated) and ``rejected`` (score below the fitted threshold)."""
    fields = [docs.schema[c] for c in keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(fields))
            name, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            if model is not None:
                chosen, data = [], []
                for i in range(batch.num_rows):
                    text = texts[i].as_py()
                    if has_letter(text):
                        chosen.append(i)
                        data.append(plain(text))
                if chosen:
                    chance = model.scores(data)
                    for i, best, value in zip(chosen, chance.argmax(axis=1).tolist(), chance.max(axis=1).tolist(), strict=True):
                        name[i], score[i] = model.names[best], value
            least = 2.0 if model is None else model.threshold
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(fields)], pa.array(name), pa.array(score), pa.array([s < least for s in score])], [*keep, "lang_pred", "score", "rejected"],
            )

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string, score double, rejected boolean"])
    return docs.select(*keep, F.col("text").cast("string")).mapInArrow(work, schema)
