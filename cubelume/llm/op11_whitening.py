"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers (64ths, rounded down). The fit list is each distinct vector of whole numbers once; n, the sums S and the
scatter about the nearest whole centre are summed in tasks as exact integers (in digits of DIGIT bits, so that products of digits are exact in
matrix products of doubles), and n n V = n Y'Y - s s' is exact too: no order of tasks changes a bit of it. What reaches the driver is a
matrix of the dimension, whatever the number of vectors. There a Cholesky factor with diagonal pivots is taken in extended precision, and one-sided Jacobi
rotates the columns of the factor itself until they are orthogonal: squared norms are the eigenvalues, normalised columns the components.
Rows are then projected where they are.

Defined results: rows whose vector is null, empty or holds null or non-finite entries (or entries whose 64ths don't fit a long) are dropped;
of vectors of different lengths those of `dim` entries are taken, by default the length that most rows have (the shorter of equally many);
repeated rows each give their own rows, but are fitted once; components of no variance don't exist, so that a single distinct vector, or an empty
table, gives no rows; deviation is null where it doesn't fit a long (deviation_wide holds it, up to 38 digits); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, ready, table, written

COMPONENTS, GRAIN = 16, 64
#: Bits of a digit of an entry in products (2^12 times 10^12 vectors fit a long), and in sums.
DIGIT, SUM_DIGIT = 12, 21
ROWS = 20_000
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, deviation_wide decimal(38,0)"


def digits(v: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """Signed digits of whole numbers, lowest first: v = sum of digit_i * 2^(bits i)."""
    out, half = [], 1 << (bits - 1)
    for _ in range(count - 1):
        low = ((v + half) & ((1 << bits) - 1)) - half
        out.append(low)
        v = (v - low) >> bits
    return [*out, v]


def _count(largest: int, bits: int) -> int:
    """Digits that whole numbers up to the largest need."""
    return 1 + int(largest).bit_length() // bits


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L (as many columns as the rank) and perm with a[perm][:, perm] = L L'."""
    a, d = a.copy(), len(a)
    perm, low = np.arange(d), np.zeros_like(a)
    least = d * 8 * np.finfo(a.dtype).eps * a.diagonal()  # of each row by its own variance: rows of small spread count, too
    for k in range(d):
        left = np.where(a.diagonal()[k:] > least[perm[k:]], a.diagonal()[k:], 0)
        j = k + int(np.argmax(left))
        if left[j - k] <= 0:
            return low[:, :k], perm
        if j != k:
            a[[k, j]], low[[k, j]] = a[[j, k]], low[[j, k]]
            a[:, [k, j]] = a[:, [j, k]]
            perm[[k, j]] = perm[[j, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1 :, k] = a[k + 1 :, k] / low[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low, perm


def jacobi(columns: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns rotated in pairs until they are orthogonal; a round turns disjoint pairs at once."""
    x = columns.copy()
    r = x.shape[1]
    seats = np.arange(r + r % 2)
    tolerance = np.finfo(x.dtype).eps * max(4, np.sqrt(r))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            pairs = (p < r) & (q < r)
            p, q = p[pairs], q[pairs]
            a, b = x[:, p], x[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            off = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if off.any():
                turned = True
                z = (beta - alpha) / np.where(off, 2 * gamma, 1)
                t = np.where(off, np.where(z >= 0, 1, -1) / (np.abs(z) + np.sqrt(1 + z * z)), 0)
                c = 1 / np.sqrt(1 + t * t)
                x[:, p], x[:, q] = c * a - c * t * b, c * t * a + c * b
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    return x


def components_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above zero, falling, and their unit eigenvectors in columns (the largest entry of each is positive)."""
    low, perm = pivoted_cholesky(v)
    if not low.shape[1]:
        return np.zeros(0, v.dtype), np.zeros((len(v), 0), v.dtype)
    x = jacobi(low)
    e = (x * x).sum(0)
    order = np.argsort(-e, kind="stable")
    e, u = e[order], np.empty_like(x)
    u[perm] = x[:, order] / np.sqrt(e)
    return e, u * np.where(u[np.abs(u).argmax(0), np.arange(len(e))] < 0, -1, 1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _added(df: DataFrame, part, d: int, kind: str) -> dict[int, np.ndarray]:
    """part(matrix) -> {key: array}, summed over all vectors of df: in the tasks first, then by key."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                for k, v in part(_matrix(b.column(0).slice(i, ROWS), d)).items():
                    total[k] = total[k] + v if k in total else v
        yield batch(total)

    def batch(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        kind_of = pa.int64() if kind == "long" else pa.float64()
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(kind_of))], ["k", "v"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("k").to_pylist(), b.column("v"), strict=True):
                v = v.values.to_numpy()
                total[k] = total[k] + v if k in total else v
        yield batch(total)

    schema = f"k int, v array<{kind}>"
    rows = df.mapInArrow(partial, schema).repartition("k").mapInArrow(whole, schema).collect()
    return {r.k: np.array(r.v, np.int64 if kind == "long" else np.float64) for r in rows}


def whiten(vectors: DataFrame, components: int = COMPONENTS, dim: int | None = None) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide."""
    spark = ready(vectors.sparkSession)
    v = vectors.select(col(vectors, "vec_id").cast("long").alias("vec_id"), col(vectors, "embedding").cast("array<double>").alias("e"))
    fits = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 55)))
    v = v.where(F.coalesce(F.col("e").isNotNull() & (F.size("e") > 0) & fits, F.lit(False)))
    if dim is None:
        most = v.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = most.d if most else 1
    d, out = dim, OUT.replace("deviation_wide", "identity_error double, deviation_wide")
    v = v.where(F.size("e") == d).select("vec_id", F.transform("e", lambda c: F.floor(c * GRAIN)).alias("x"))  # the same as with 1 000 000 added: only differences count
    fit = written(v.select("x").distinct(), "whitening-fit")
    n, least, largest = fit.agg(F.count("*"), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if n < 2:
        return spark.createDataFrame([], out)
    limbs = _count(max(abs(least), abs(largest)), SUM_DIGIT)
    found = _added(fit, lambda x: {i: y.sum(0) for i, y in enumerate(digits(x, SUM_DIGIT, limbs))}, d, "long")
    sums = sum(found[i].astype(object) << (SUM_DIGIT * i) for i in range(limbs))
    centre = np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64)
    limbs = _count(largest - least + 1, DIGIT)

    def products(x: np.ndarray) -> dict[int, np.ndarray]:
        y = [p.astype(np.float64) for p in digits(x - centre, DIGIT, limbs)]
        return {(a * limbs + b) * d + i: row for a in range(limbs) for b in range(a, limbs) for i, row in enumerate((y[a].T @ y[b]).astype(np.int64))}

    found = _added(fit, products, d, "long")
    scatter = np.zeros((d, d), object)
    for a in range(limbs):
        for b in range(a, limbs):
            m = np.array([found[(a * limbs + b) * d + i] for i in range(d)]).astype(object) << (DIGIT * (a + b))
            scatter = scatter + m if a == b else scatter + m + m.T
    s = np.array([int(x) - n * int(c) for x, c in zip(sums, centre, strict=True)], object)
    exact = n * scatter - np.outer(s, s)
    cov = np.array([np.longdouble(str(x)) for x in exact.ravel()]).reshape(d, d) / n / n
    e, u = components_of(cov)
    k = min(components, len(e))
    if not k:
        return spark.createDataFrame([], out)
    share, project = (e[:k] / cov.trace()).astype(np.float64), (u[:, :k] / np.sqrt(e[:k])).astype(np.float64)
    wide = n * (largest - least + 1)  # no entry of n x - S is larger
    small = wide < 1 << 62 and d * wide * wide < 1 << 62

    def offsets(x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        y = x - centre
        return y * n - s.astype(np.int64) if wide < 1 << 62 else y.astype(object) * n - s

    def whitened(x: np.ndarray) -> np.ndarray:
        return (offsets(x) / n).astype(np.float64) @ project

    def spread(x: np.ndarray) -> dict[int, np.ndarray]:
        w = whitened(x)
        return dict(enumerate(w.T @ w)) | {k: w.sum(0)}

    found = _added(fit, spread, d, "double")
    mean = found[k] / n
    error = float(np.round(np.abs(np.array([found[i] for i in range(k)]) / n - np.outer(mean, mean) - np.eye(k)).max(), 9))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(1, k + 1, dtype=np.int32)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                x = _matrix(b.column("x").slice(i, ROWS), d)
                far = offsets(x)
                exact_far = (far * far).sum(1) if small else (far.astype(object) ** 2).sum(1)
                far_long = pa.array(exact_far) if small else pa.array([int(f) if f < 1 << 63 else None for f in exact_far], pa.int64())
                far_wide = pa.array([int(f) if f < 10**38 else None for f in exact_far], pa.decimal128(38, 0))
                m, rows = len(x), pa.array(np.repeat(np.arange(len(x)), k))
                columns = [b.column("vec_id").slice(i, ROWS).take(rows), pa.array(np.tile(numbers, m)), pa.array(np.full(m * k, n)), far_long.take(rows), pa.array(whitened(x).ravel()), pa.array(np.tile(share, m)), far_wide.take(rows)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "deviation_wide"])

    rows = v.mapInArrow(projected, OUT)
    return rows.select("vec_id", "component", "n", "deviation", "whitened", "explained", F.lit(error).alias("identity_error"), "deviation_wide")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


SQL: dict[str, str] = {}
QUERIES = {"op11_whitening": op11_whitening}
