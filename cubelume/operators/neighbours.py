"""The k nearest vectors of all vectors, or of some that ask, exact, by blocks, pivots and the triangle inequality.

Each vector belongs to the cell of its nearest pivot, and a cell's rows are packed into blocks of bounded size, a row a block. Blocks that ask meet all blocks, and a task holds the
k best so far of those that ask: their k-th is a bound. A block is passed over for those that are farther from its pivot than that bound and its radius; for the others, cosines
by one matrix product in single precision are held against the least one that may meet the bound (one number a row, as a piece's vectors are alike in size), less the product's
error: one comparison a pair. The few that are left are scored in full. The score L2 x (2 - cosine) is never less than L2, so that bounds of L2 hold for it too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import kept

#: Pivots at most; each vector is compared with all of them.
PIVOTS = 1024
#: Rows of a block, about (twice that by chance at most), and its numbers.
BLOCK, NUMBERS = 8192, 1 << 19
#: Blocks that a task holds beside those that ask.
HELD = 16
#: Numbers of a piece of a matrix of cosines, and its columns; their sizes are within a share of each other. Squares of smaller sizes than TINY aren't held in full.
PIECE, COLUMNS, ALIKE, TINY = 1 << 19, 2048, 1.1, 1e-140
FOUND = "query long, neighbour long, score double"
PACKED = "cell int, ids binary, x binary"
_SLACK = 1e-9


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """L2 of all rows of x and of y, from differences (no cancellation), some rows at a time."""
    out = np.empty((len(x), len(y)))
    step = max(1, 4_000_000 // max(1, y.size))
    for i in range(0, len(x), step):
        out[i : i + step] = np.sqrt(((x[i : i + step, None] - y[None]) ** 2).sum(2))
    return out


def _unit(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows over their sizes, in single precision; a zero vector stays."""
    return (x / np.where(size > 0, size, 1)[:, None]).astype(np.float32)


def _rounded(s: np.ndarray, digits: int) -> np.ndarray:
    """Halves go up, as in SQL."""
    t = s * 10.0**digits
    whole = np.floor(t)
    return (whole + (t - whole >= 0.5)) / 10.0**digits


def _scores(x: np.ndarray, y: np.ndarray, blend: bool, digits: int) -> np.ndarray:
    """Of each row of x and the same row of y, in full."""
    far = np.sqrt(((x - y) ** 2).sum(1))
    if blend:
        sizes = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
        far *= 2 - np.divide((x * y).sum(1), sizes, out=np.zeros_like(far), where=sizes > 0)
    return _rounded(far, digits)


def _least_cosine(own: np.ndarray, low: float, high: float, bound: np.ndarray, blend: bool) -> np.ndarray:
    """The least cosine with which a vector of a size of low to high may score the bound against one of a size of its own; from below. The score falls as
    the cosine rises, and for one cosine the size nearest to own x cosine has the least."""

    def may(c: np.ndarray) -> np.ndarray:
        size = np.clip(own * c, low, high)
        gap = np.maximum(np.abs(own - size) - 1e-13 * (own + size), 0)
        least = gap * gap + 2 * own * size * (1 - c)
        return (least * (2 - c) ** 2 if blend else least) <= bound * bound

    below, above = np.full(len(own), -1.0), np.full(len(own), 1.0)
    for _ in range(22):
        middle = (below + above) / 2
        found = may(middle)
        below, above = np.where(found, below, middle), np.where(found, middle, above)
    return np.where(may(np.ones(len(own))) | (below < 0.99), below, np.inf)


def _slices(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of sorted sizes: pieces of COLUMNS at most, in which sizes are within ALIKE of each other."""
    i = 0
    while i < len(size):
        j = int(np.searchsorted(size, size[i] * ALIKE if size[i] > TINY else TINY if size[i] > 0 else 0, "right"))
        j = min(j, i + COLUMNS)
        yield i, j
        i = j


class _Best:
    """The k best so far of some that ask; ties by id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, blend: bool, digits: int):
        self.ids, self.x, self.k, self.blend, self.digits = ids, x, k, blend, digits
        self.size = np.sqrt((x * x).sum(1))
        self.unit = _unit(x, self.size)
        self.unsure = float((x.shape[1] + 8) * np.finfo(np.float32).eps)  # of a cosine by products
        self.score, self.neighbour = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def _bound(self, rows: np.ndarray) -> np.ndarray:
        return self.score[rows, -1] * (1 + _SLACK) + _SLACK + 10.0**-self.digits

    def meet(self, ids: np.ndarray, y: np.ndarray, pivot: np.ndarray, radius: float) -> None:
        """A block."""
        rows = np.flatnonzero(_far(self.x, pivot[None])[:, 0] - radius <= self._bound(np.arange(len(self.ids))))
        if not len(rows):
            return
        size = np.sqrt((y * y).sum(1))
        order = np.argsort(size, kind="stable")
        ids, y, size = ids[order], y[order], size[order]
        unit = _unit(y, size)
        often = int(np.unique(ids, return_counts=True)[1].max())
        for i, j in _slices(size):
            least = self._cosines(rows, size[i], size[j - 1], self._bound(rows))
            turned = np.ascontiguousarray(unit[i:j].T)
            step = max(1, PIECE // (j - i))
            for at in range(0, len(rows), step):
                self._piece(rows[at : at + step], least[at : at + step], ids[i:j], y[i:j], turned, size[i], size[j - 1], often)

    def _cosines(self, rows: np.ndarray, low: float, high: float, bound: np.ndarray) -> np.ndarray:
        """What a product in single precision has at least where the bound may be met; of sizes whose squares aren't held, nothing is known."""
        own = self.size[rows]
        known = np.isfinite(bound) & ((own == 0) | (own > TINY)) & ((high == 0) | (low > TINY))
        out = np.full(len(rows), -np.inf)
        out[known] = _least_cosine(own[known], low, high, bound[known], self.blend) - self.unsure
        return out

    def _piece(self, at: np.ndarray, least: np.ndarray, ids: np.ndarray, y: np.ndarray, turned: np.ndarray, low: float, high: float, often: int) -> None:
        cosines = self.unit[at] @ turned
        open_ = np.flatnonzero(np.isinf(self.score[at, -1]))
        if len(open_) and len(ids) >= self.k + often and low > TINY:
            # as many as the bound needs have this cosine, those of the same id apart, and score no more than with it at either size
            kth = np.partition(cosines[open_], len(ids) - self.k - often, 1)[:, len(ids) - self.k - often] - self.unsure
            own = self.size[at[open_]]
            far = np.sqrt(np.max([(own - b) ** 2 + 2 * own * b * (1 - kth) for b in (low, high)], 0)) * ((2 - kth) if self.blend else 1)
            least[open_] = self._cosines(at[open_], low, high, far * (1 + _SLACK) + _SLACK + 10.0**-self.digits)
        down = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
        row, column = np.divmod(np.flatnonzero(cosines >= down[:, None]), len(ids))
        for i in range(0, len(row), 100_000):
            r, c = row[i : i + 100_000], column[i : i + 100_000]
            others = self.ids[at[r]] != ids[c]
            r, c = r[others], c[others]
            self._keep(at[r], _scores(self.x[at[r]], y[c], self.blend, self.digits), ids[c])

    def _keep(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        some = np.unique(row)
        row = np.concatenate([row, np.repeat(some, self.k)])
        score, ids = np.concatenate([score, self.score[some].ravel()]), np.concatenate([ids, self.neighbour[some].ravel()])
        order = np.lexsort((ids, score, row))
        row = row[order]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        first = order[(start[:, None] + np.arange(self.k)).ravel()]  # each row has k at least: those so far
        self.score[some], self.neighbour[some] = score[first].reshape(-1, self.k), ids[first].reshape(-1, self.k)

    def found(self) -> Iterator[pa.RecordBatch]:
        row, column = np.nonzero(self.score < np.inf)
        for i in range(0, len(row), 50_000):
            r, c = row[i : i + 50_000], column[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[r]), pa.array(self.neighbour[r, c]), pa.array(self.score[r, c])], ["query", "neighbour", "score"])


def _few_of_equals(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of rows, in order of id: of equal vectors only as many as a query's neighbours and itself."""
    if not len(ids):
        return np.zeros(0, np.int64)
    same = np.unique(x + 0.0, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    new = np.r_[True, s[1:] != s[:-1]]
    copy = np.maximum.accumulate(np.where(new | np.r_[True, i[1:] != i[:-1]], np.arange(len(s)), 0))
    often = int((np.arange(len(s)) - copy).max()) + 1  # rows of one id and one vector
    place = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return np.sort(order[place < k + often])


def _sound(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """id, e of the vectors that take part; how many, and their length."""
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150))
    v = v.where(F.col("id").isNotNull() & F.coalesce(F.col("e").isNotNull() & (F.size("e") > 0) & sound, F.lit(False)))
    common = v.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (v, 0, 0) if common is None else (v.where(F.size("e") == common.d), common["count"], common.d)


def _neighbours(v: DataFrame, n: int, d: int, k: int, blend: bool, digits: int, asks: str | None) -> DataFrame:
    """The k nearest of the rows of v (id, e) of which `asks` holds (all if None)."""
    spark = v.sparkSession
    size = max(1, min(BLOCK, NUMBERS // d))
    pivots = np.array([r.e for r in v.orderBy(F.xxhash64("id"), "id").select("e").limit(min(PIVOTS, 1 + n * 2 // size)).collect()])  # PIVOTS at most
    turned, sizes = pivots.T, (pivots * pivots).sum(1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("e"), d) if b.num_rows else np.zeros((0, d))
            cell = (sizes[None] - 2 * (x @ turned)).argmin(1)
            away = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("e"), pa.array(cell.astype(np.int32)), pa.array(away)], ["id", "e", "cell", "away"])

    rows = kept(v.mapInArrow(dealt, "id long, e array<double>, cell int, away double"), "knn-cells")
    radius = np.zeros(len(pivots))
    blocks = np.ones(len(pivots), np.int64)
    for c in rows.groupBy("cell").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / size).alias("blocks")).collect():  # a row a pivot
        radius[c.cell], blocks[c.cell] = c.radius, c.blocks
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(blocks.sum()))

    def packed(df: DataFrame, n_blocks: np.ndarray, most: int | None) -> DataFrame:
        """PACKED: a row a block, of equal vectors `most` and itself if that is stated."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, ids, x = None, [], []

            def block() -> pa.RecordBatch:
                i, e = np.concatenate(ids), np.concatenate(x)
                few = _few_of_equals(i, e, most) if most is not None else np.arange(len(i))
                return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([i[few].tobytes()], pa.binary()), pa.array([e[few].tobytes()], pa.binary())], ["cell", "ids", "x"])

            for b in batches:
                if not b.num_rows:
                    continue
                at = np.stack([b.column(c).to_numpy() for c in ("cell", "block")], 1)
                i, e = b.column("id").to_numpy(), _matrix(b.column("e"), d)
                edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
                for m, j in zip(edges, edges[1:], strict=False):
                    if key != tuple(at[m]):
                        if key is not None:
                            yield block()
                        key, ids, x = tuple(at[m]), [], []
                    ids.append(i[m:j])
                    x.append(e[m:j])
            if key is not None:
                yield block()

        of = F.element_at(F.array(*[F.lit(int(b)) for b in n_blocks]), F.col("cell") + 1)
        dealt_rows = df.select("id", "e", "cell", F.pmod(F.xxhash64("id"), of).cast("int").alias("block"))
        return dealt_rows.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "id").mapInArrow(pack, PACKED)

    held = kept(packed(rows, blocks, k), "knn-blocks")
    if asks is None:
        asking = kept(packed(rows, blocks, None), "knn-asking")
    else:
        some = rows.where(asks)
        asking = kept(packed(some.withColumn("cell", F.lit(0)), np.array([1 + some.count() // size]), None), "knn-asking")
    n_asking, n_held = asking.count(), held.count()
    cores = spark.sparkContext.defaultParallelism
    left = asking.select(F.col("ids").alias("asks"), F.col("x").alias("q")).repartition(max(1, min(n_asking, 512)))
    right = held.repartition(max(1, min(n_held, max(-(-n_held // HELD), -(-3 * cores // max(1, n_asking))))))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that one which asks meets come one after another."""
        key, best = None, None
        for b in batches:
            for i in range(b.num_rows):
                asker = b.column("asks")[i].as_py(), b.column("q")[i].as_py()
                if key != asker:
                    if best is not None:
                        yield from best.found()
                    key = asker
                    best = _Best(np.frombuffer(key[0], np.int64), np.frombuffer(key[1], np.float64).reshape(-1, d), k, blend, digits)
                cell = b.column("cell")[i].as_py()
                best.meet(np.frombuffer(b.column("ids")[i].as_buffer(), np.int64), np.frombuffer(b.column("x")[i].as_buffer(), np.float64).reshape(-1, d), pivots[cell], radius[cell])
        if best is not None:
            yield from best.found()

    met = left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(compared, FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "neighbour"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def all_neighbours(vectors: DataFrame, k: int, blend: bool = True) -> DataFrame:
    """vectors (vec_id, embedding) -> query, neighbour, score, rank: for each vector its k of least L2 x (2 - cosine), or L2; ties by id.

    Defined results: vectors that are null, empty or hold null or non-finite components, and rows without vec_id, are neither queries nor
    neighbours; a vector isn't its own neighbour, nor is another of its vec_id; of vectors of different lengths only those of the commonest take part
    (the shorter of equally many); the cosine of a zero vector is 0."""
    return knn(vectors, None, k, blend)


def knn(vectors: DataFrame, asks: str | None, k: int, blend: bool = True, digits: int = 9) -> DataFrame:
    """The same for the vectors whose id is so (a condition on id), against all; scores are rounded to `digits` before they are ranked."""
    v, n, d = _sound(vectors)
    if not n:
        return vectors.sparkSession.createDataFrame([], FOUND + ", rank int")
    return _neighbours(v, n, d, k, blend, digits, asks)
