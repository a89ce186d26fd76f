"""Exact search for the largest inner products with M-trees, best node first.

Vectors become integers, ``floor(scale * x)``, so scores are exact. Rows are dealt to cells by their nearest pivot (a bounded
sample of rows), and a cell beyond ``TREE_BYTES`` is divided into blocks by hash; every block is one M-tree. Its nodes are
pages of routing rows with their covering radius and their distance to the parent's routing row. With ``c`` at a known inner
product ``s`` to the query ``q``, every row within ``r`` of ``c`` scores at most ``s + |q| r`` (Cauchy-Schwarz), and so does
everything below a child at distance ``d`` from ``c`` score at most ``s + |q| (d + r)``, which needs no computation at the
child. Nodes are opened in the order of their bounds until no bound reaches the ``k``-th best score.

On Spark a query first searches the cell with the best bound. The ``k``-th score found there is a threshold for the second
step, in which the query goes to every other cell whose bound reaches it: cells that cannot hold a result are never
visited, and the search is exact whatever the data. A tree's rows stream into its task first, its queries after them, batch
by batch; a tree asked by more than ``ASKED`` queries is served by several tasks.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; a vector is compared with
those of its own width; rows are told apart by id and vector, equal rows of one id are one row, and a query's other rows with
its id are candidates; a row without an id is a candidate, last among ties; integers and scores beyond a long end at its range;
an empty table gives no rows. Only the two named columns are read, so columns of any other name do not clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

#: Pivots at most, rows per pivot while there are fewer, and bytes of all pivots.
PIVOTS, CELL, PIVOT_BYTES = 1024, 2048, 8 << 20
#: Bytes of the rows of one tree, and queries that one task answers with it.
TREE_BYTES, ASKED = 32 << 20, 65_536
#: Rows of a leaf page and routing rows of an inner page.
PAGE, FAN = 256, 8
#: Squared length from which doubles would not be exact; such vectors are scored with Python integers, without bounds.
LARGE = float(1 << 51)
#: Cells beside those of the pivots: rows of a width without pivots, and large rows.
OTHER, HUGE = -1, -2
_END = np.iinfo(np.int64).max


def sound(vector: Column) -> Column:
    """Finite numbers only, at least one."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def whole(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id, v``: the distinct usable rows with their vectors as integers."""
    own = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(sound(F.col("v")))
    return own.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).distinct()


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column, all of one width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squares(rows: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(axis=1)


def distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Euclidean distances to one row; exact before the root, as all products are integers below 2**53."""
    return np.sqrt(np.maximum(squares(rows) + centre @ centre - 2 * (rows @ centre), 0))


class MTree:
    """Pages of a metric tree over integer rows held as doubles."""

    def __init__(self, rows: np.ndarray) -> None:
        # A page: centres of its entries, their distances to the page's own routing row, radii, and pages below (None: rows).
        self.pages: list[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]] = []
        self.root = rows[0]
        open_ = [(np.arange(len(rows)), self.root, None, 0)]
        while open_:
            items, centre, above, slot = open_.pop()
            if above is not None:
                self.pages[above][3][slot] = len(self.pages)
            own = rows[items]
            if len(items) <= PAGE:
                self.pages.append((own, distances(own, centre), None, items))
                continue
            parts = self.divide(own, centre)
            centres = np.stack([own[c] for _, c in parts])
            radii = np.array([distances(own[p], own[c]).max() for p, c in parts])
            page = len(self.pages)
            self.pages.append((centres, distances(centres, centre), radii, np.zeros(len(parts), np.int64)))
            open_ += [(items[p], own[c], page, i) for i, (p, c) in enumerate(parts)]

    @staticmethod
    def divide(own: np.ndarray, centre: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Up to ``FAN`` parts, each with the place of its routing row; shells around ``centre`` where rows hardly differ."""
        pivots = np.unique(np.linspace(0, len(own) - 1, FAN).astype(int))
        nearest = np.stack([distances(own, own[p]) for p in pivots]).argmin(axis=0)
        parts = [(np.flatnonzero(nearest == i), int(p)) for i, p in enumerate(pivots)]
        parts = [(p, c) for p, c in parts if len(p)]
        if max(len(p) for p, _ in parts) > 0.9 * len(own):
            shells = np.array_split(np.argsort(distances(own, centre), kind="stable"), FAN)
            parts = [(s, int(s[len(s) // 2])) for s in shells]
        return parts

    def search(self, query: np.ndarray, keys: tuple[np.ndarray, np.ndarray], skip: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the ``k`` best rows of at least ``floor``; ``keys`` (last first) break ties."""
        norm = float(np.sqrt(query @ query)) * (1 + 1e-9)
        best, scores = np.zeros(0, np.int64), np.zeros(0)
        heap = [(-np.inf, 0, float(self.root @ query))]
        while heap:
            bound, number, s = heapq.heappop(heap)
            if -bound < floor:
                break
            entries, apart, radii, below = self.pages[number]
            # Bounds from stored distances alone; what they exclude is not computed.
            reach = s + norm * (apart if radii is None else apart + radii) + 1e-9 * abs(s)
            use = np.flatnonzero(reach >= floor)
            if not len(use):
                continue
            found = (entries if len(use) == len(entries) else entries[use]) @ query
            if radii is not None:
                bounds = found + norm * radii[use] + 1e-9 * np.abs(found)
                for i in np.flatnonzero(bounds >= floor).tolist():
                    heapq.heappush(heap, (-float(bounds[i]), int(below[use[i]]), float(found[i])))
                continue
            good = np.flatnonzero((found >= floor) & (below[use] != skip))
            if len(good):
                best, scores = np.concatenate([best, below[use[good]]]), np.concatenate([scores, found[good]])
                order = np.lexsort((keys[0][best], keys[1][best], -scores))[:k]
                best, scores = best[order], scores[order]
                if len(best) == k:
                    floor = max(floor, float(scores[-1]))
        return best, scores


def exact(rows: np.ndarray, query: np.ndarray, keys: tuple[np.ndarray, np.ndarray], skip: int, k: int) -> tuple[list[int], list[int]]:
    """The same with Python integers, for vectors of any length."""
    asked = [int(x) for x in query]
    scored = sorted((-sum(int(a) * b for a, b in zip(row, asked, strict=True)), bool(keys[1][i]), int(keys[0][i]), i) for i, row in enumerate(rows) if i != skip)[:k]
    return [i for *_, i in scored], [max(-_END - 1, min(_END, -s)) for s, *_ in scored]


class Tree:
    """One block's rows; its M-tree is built when the first query arrives."""

    def __init__(self, ids: list[pa.Array], rows: list[np.ndarray]) -> None:
        joined = pa.concat_arrays(ids)
        self.unnamed = np.asarray(joined.is_null())
        self.ids = joined.fill_null(_END).to_numpy()
        self.whole = np.concatenate(rows)
        self.rows = self.whole.astype(float)
        self.large = bool(squares(self.rows).max() >= LARGE)
        self.tree = None if self.large else MTree(self.rows)
        self.order = np.argsort(self.ids, kind="stable")

    def answer(self, query_id: int | None, query: np.ndarray, k: int, floor: float) -> tuple[list[int | None], list[int]]:
        keys = (self.ids, self.unnamed)
        value = _END if query_id is None else query_id
        low, high = (np.searchsorted(self.ids, value, side, sorter=self.order) for side in ("left", "right"))
        skip = next((int(i) for i in self.order[low:high] if self.unnamed[i] == (query_id is None) and (self.whole[i] == query).all()), -1)
        asked = query.astype(float)
        if self.large or asked @ asked >= LARGE:
            best, scores = exact(self.whole, query, keys, skip, k)
        else:
            found, values = self.tree.search(asked, keys, skip, k, floor)
            best, scores = found.tolist(), values.astype(np.int64).tolist()
        return [None if self.unnamed[i] else int(self.ids[i]) for i in best], scores


def seek(rows: DataFrame, asked: DataFrame, k: int, served: int = ASKED) -> DataFrame:
    """``query_id, mark, vec_id, score``: the best of every tree for the queries sent to it.

    ``rows``: ``id, v, width, cell, block``; ``asked``: the same with ``mark`` and ``floor``.
    """
    place = ["width", "cell", "block"]
    loads = asked.groupBy(*place).agg(F.ceil(F.count("*") / served).cast("int").alias("copies"))
    trees = rows.join(loads, place).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    queries = asked.join(loads, place).withColumn("copy", F.pmod("mark", "copies").cast("int"))
    trees = trees.select(*place, "copy", F.lit(0).alias("kind"), "id", "v", F.lit(0).cast("long").alias("mark"), F.lit(0.0).alias("floor"))
    queries = queries.select(*place, "copy", F.lit(1).alias("kind"), "id", "v", "mark", "floor")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, tree = None, [], [], None
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
            cuts = np.flatnonzero((np.diff(marks, axis=0) != 0).any(axis=1)) + 1
            out: list[tuple[int | None, int, int | None, int]] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                key, kind = tuple(marks[a, :4].tolist()), marks[a, 4]
                if key != now:
                    now, ids, held, tree = key, [], [], None
                part = batch.slice(a, b - a)
                vectors = matrix(part.column(6))
                if kind == 0:
                    ids.append(part.column(5))
                    held.append(vectors)
                    continue
                if tree is None:
                    tree, ids, held = Tree(ids, held), [], []
                for name, query, mark, floor in zip(part.column(5).to_pylist(), vectors, part.column(7).to_pylist(), part.column(8).to_pylist(), strict=True):
                    out += [(name, mark, i, s) for i, s in zip(*tree.answer(name, query, k, floor), strict=True)]
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "mark", "vec_id", "score"])

    ordered = trees.union(queries).repartition(*place, "copy").sortWithinPartitions(*place, "copy", "kind")
    return ordered.mapInArrow(work, "query_id long, mark long, vec_id long, score long")


def by_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, row numbers and integer matrix of the rows of every width."""
    vectors = batch.column(column)
    sizes = np.asarray(pc.list_value_length(vectors))
    for width in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == width)
        yield width, rows, matrix(vectors.take(pa.array(rows)))


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256,
    cell: int = CELL, tree_bytes: int = TREE_BYTES, served: int = ASKED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` with the largest inner product, for every row of ``queries``."""
    rows = stored(whole(vectors, key, vector, scale))
    mark = F.xxhash64("id", "v")
    wanted = stored(whole(queries, key, vector, scale).withColumn("mark", mark).withColumn("width", F.size("v")))
    known = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    widest = known["width"] or 1
    # Pivots: a sample by hash, so that every run takes the same; their number and bytes are bounded.
    most = max(1, min(PIVOTS, known["n"] // cell, PIVOT_BYTES // (8 * widest)))
    sample = rows.withColumn("mark", mark).orderBy("mark", "id").limit(most).select("v").toArrow().column("v").to_pylist()
    pivots: dict[int, np.ndarray] = {}
    for width in sorted({len(v) for v in sample}):
        own = np.unique(np.array([v for v in sample if len(v) == width], float), axis=0)
        own = own[squares(own) < LARGE]
        if len(own):
            pivots[width] = own
    first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist(), strict=False))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, apart = np.full(batch.num_rows, OTHER), np.zeros(batch.num_rows)
            for width, places, values in by_width(batch, 1):
                own = values.astype(float)
                long_ = squares(own)
                if width in pivots:
                    centres = pivots[width]
                    far = np.maximum(long_[:, None] + squares(centres) - 2 * (own @ centres.T), 0)
                    near = far.argmin(axis=1)
                    cells[places], apart[places] = near + first[width], np.sqrt(far[np.arange(len(near)), near])
                huge = places[long_ >= LARGE]
                cells[huge], apart[huge] = HUGE, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(apart)], ["id", "v", "cell", "apart"])

    dealt = stored(rows.mapInArrow(deal, "id long, v array<long>, cell int, apart double").withColumn("width", F.size("v")))
    per_tree = max(PAGE, tree_bytes // (8 * widest))
    cells = stored(dealt.groupBy("width", "cell").agg(F.max("apart").alias("radius"), F.ceil(F.count("*") / per_tree).cast("int").alias("blocks")))
    placed = dealt.join(cells, ["width", "cell"]).select("id", "v", "width", "cell", F.pmod(F.xxhash64("id", "v"), "blocks").cast("int").alias("block"))
    # Radii of the pivots' cells: as many rows as pivots at most.
    radii = {r["cell"]: r["radius"] for r in cells.filter("cell >= 0").select("cell", "radius").collect()}

    def aims(every: bool):
        """Cells a query is sent to: the most promising one, or all others whose bound reaches its floor."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                floors = batch.column(3).to_numpy()
                row: list[np.ndarray] = []
                cell: list[np.ndarray] = []
                for width, places, values in by_width(batch, 1):
                    asked = values.astype(float)
                    small = squares(asked) < LARGE
                    near = np.zeros((len(places), 0), bool)
                    numbers = np.zeros(0, np.int64)
                    if width in pivots:
                        numbers = np.arange(len(pivots[width])) + first[width]
                        reach = np.array([radii.get(int(c), -np.inf) for c in numbers])
                        inner = asked @ pivots[width].T
                        bound = inner + np.sqrt(squares(asked))[:, None] * reach * (1 + 1e-9) + 1e-9 * np.abs(inner)
                        choice = bound.argmax(axis=1)
                        near = np.zeros_like(bound, bool)
                        near[np.flatnonzero(small), choice[small]] = True
                        if every:
                            near = ~near & (~small[:, None] | (bound >= floors[places, None]))
                    at, c = np.nonzero(near)
                    row.append(places[at])
                    cell.append(numbers[c])
                    if every:
                        row += [places, places]
                        cell += [np.full(len(places), OTHER), np.full(len(places), HUGE)]
                picked = batch.take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.concatenate(cell), pa.int32())], ["id", "v", "mark", "floor", "cell"])

        return work

    def ask(frame: DataFrame, every: bool) -> DataFrame:
        aimed = frame.select("id", "v", "mark", "floor").mapInArrow(aims(every), "id long, v array<long>, mark long, floor double, cell int").withColumn("width", F.size("v"))
        sent = aimed.join(cells.select("width", "cell", "blocks"), ["width", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return stored(seek(placed, stored(sent.select("id", "v", "mark", "floor", "width", "cell", "block")), k, served))

    ranked = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    lowest = float("-inf")
    near = ask(wanted.withColumn("floor", F.lit(lowest)), False)
    floors = near.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k).select(F.col("query_id").alias("id_"), F.col("mark").alias("mark_"), F.col("score").cast("double").alias("kth"))
    same = wanted["id"].eqNullSafe(F.col("id_")) & (wanted["mark"] == F.col("mark_"))
    raised = wanted.join(floors, same, "left").withColumn("floor", F.coalesce("kth", F.lit(lowest)))
    found = near.union(ask(raised, True))
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
