"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Each entry c of a vector becomes the integer x = floor(1024 c) + 100000, so sums are exact. Spark gives the count n and the sums S
of each dimension (partial sums before the shuffle), then the scatter of the centred rows: every task adds the outer products of
its rows' n x - S (exact integers) into one d x d matrix, and those are added up by cell. Only that matrix reaches the driver:
its size follows the dimension, never the number of rows.

On the driver, a Cholesky factorisation with full pivoting gives the scatter as L L^T with L lower triangular and of the scatter's
rank. One-sided (Hestenes) Jacobi rotates pairs of L's columns until all are orthogonal; the rotated columns' squared norms are the
scatter's eigenvalues and the columns divided by their norms its eigenvectors. Rotations run as a round-robin tournament, each
round turning d/2 disjoint pairs at once. The covariance is the scatter over n^3 (rows were scaled by n).

Rows are then projected in Spark, one column expression each, and the whitened values' covariance is measured over all rows.

Defined results: rows whose vector is null, holds a null, NaN or infinite entry, or has another length than the dimension (the most
common length of the others, of equal counts the largest) are dropped; an empty table or a dimension of 0 gives no rows. Components
run from 1 to the smallest of `components`, the dimension and the scatter's rank: a direction of eigenvalue 0 cannot be whitened.
Each component's sign makes its entry of largest magnitude positive (the first of equals), the same for every row. Repeated rows
count as often as they occur. deviation is null if it exceeds a long. Other columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
_TINY = 1e-13


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # unit eigenvectors, one a row
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)


def fixed_points(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x) for every usable row: x as longs, rows of the most common length only."""
    vec = F.col(column)
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    usable = embeddings.where(vec.isNotNull() & finite).select(
        F.col("vec_id"), F.transform(vec, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).alias("x"),
    )
    lengths = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return usable.where(F.lit(False))
    return usable.where(F.size("x") == lengths[0]["d"])


def _scatter(x: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Sum over rows of (n x - S)(n x - S)^T: one matrix a task, added up by cell."""
    d, s = len(sums), np.array(sums, np.int64)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            rows = batch.column(0)
            if len(rows):
                flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                centred = (n * flat.reshape(len(rows), d) - s).astype(np.float64)
                total += centred.T @ centred
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "v": total.ravel()})

    cells = x.select("x").mapInArrow(gram, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((d, d))
    for cell in cells:
        out[cell["i"], cell["j"]] = cell["v"]
    return out


def pivoted_cholesky(a: np.ndarray, tolerance: float = _TINY) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L^T, L lower triangular with as many columns as a's numerical rank."""
    a = np.array(a, dtype=np.float64)
    d = len(a)
    order = np.arange(d)
    low = np.zeros((d, d))
    top = max(float(np.max(np.diag(a))) if d else 0.0, 0.0)
    rank = 0
    for k in range(d):
        rest = np.diag(a)[k:]
        p = k + int(np.argmax(rest))
        if rest[p - k] <= tolerance * top or top == 0.0:
            break
        a[[k, p]] = a[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        low[[k, p]] = low[[p, k]]
        order[[k, p]] = order[[p, k]]
        pivot = np.sqrt(a[k, k])
        low[k, k] = pivot
        low[k + 1:, k] = a[k + 1:, k] / pivot
        a[k + 1:, k + 1:] -= np.outer(low[k + 1:, k], low[k + 1:, k])
        rank = k + 1
    return low[:, :rank], order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor's columns rotated in pairs until they are orthogonal to double precision."""
    a = np.array(factor, dtype=np.float64)
    r = a.shape[1]
    if r < 2:
        return a
    players = list(range(r)) + ([-1] if r % 2 else [])
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = [(p, q) for p, q in zip(players[:half], players[half:][::-1]) if p >= 0 and q >= 0]
            p, q = np.array([min(x) for x in pairs]), np.array([max(x) for x in pairs])
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            big = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if big.any():
                turned = True
                zeta = np.where(big, (beta - alpha) / np.where(big, 2 * gamma, 1.0), 0.0)
                t = np.where(big, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
            players = [players[0], players[-1], *players[1:-1]]
        if not turned:
            break
    return a


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as rows) of a symmetric positive semidefinite matrix, values falling, zero directions left out."""
    low, order = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(low)
    norms = np.sqrt((turned * turned).sum(0))
    keep = norms > 0
    values, vectors = norms[keep] ** 2, np.zeros((int(keep.sum()), len(scatter)))
    vectors[:, order] = (turned[:, keep] / norms[keep]).T
    rank = np.argsort(-values, kind="stable")
    values, vectors = values[rank], vectors[rank]
    signs = np.sign(vectors[np.arange(len(vectors)), np.argmax(np.abs(vectors), axis=1)])
    return values, vectors * signs[:, None]


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening:
    """n, S and the leading components of the covariance of the rows of `fixed_points`."""
    stats = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()
    if not stats:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    stats = sorted(stats, key=lambda r: r["i"])
    n, sums = int(stats[0]["n"]), [int(r["s"]) for r in stats]
    scatter = _scatter(x, n, sums)
    values, vectors = eigen(scatter)
    scale = float(n) ** 3
    trace = float(np.trace(scatter)) / scale
    keep = values / scale > _TINY * max(trace, 0.0) if trace > 0 else np.zeros(len(values), bool)
    return Whitening(n, sums, values[keep][:components] / scale, vectors[keep][:components], trace)


def _dot(centred: Column, vector: np.ndarray) -> Column:
    weights = F.array(*[F.lit(float(v)) for v in vector])
    return F.aggregate(F.zip_with(centred, weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, v: acc + v)


def projected(x: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, n, deviation, and w: the row's whitened value on each component, in order."""
    sums = F.array(*[F.lit(s).cast("long") for s in model.sums])
    centred = F.zip_with(F.col("x"), sums, lambda a, s: a * F.lit(model.n).cast("long") - s)
    square = F.aggregate(centred, F.lit(0).cast("decimal(38,0)"), lambda acc, v: acc + v.cast("decimal(38,0)") * v.cast("decimal(38,0)"))
    w = F.array(*[_dot(centred, vector) / F.lit(model.n * float(np.sqrt(value))) for value, vector in zip(model.values, model.vectors)])
    return x.select(
        "vec_id", F.lit(model.n).cast("long").alias("n"), square.alias("__square"), (w if len(model.values) else F.array().cast("array<double>")).alias("w"),
    ).select("vec_id", "n", F.expr("try_cast(__square AS BIGINT)").alias("deviation"), "w")


def whitened(x: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained: a row for each row of `fixed_points` and component."""
    shares = F.array(*[F.lit(float(value / model.trace)) for value in model.values]) if len(model.values) else F.array().cast("array<double>")
    return projected(x, model).select(
        "vec_id", "n", "deviation", F.posexplode(F.arrays_zip(F.col("w").alias("w"), shares.alias("e"))).alias("__k", "__part"),
    ).select(
        "vec_id", (F.col("__k") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("__part.w").alias("whitened"), F.col("__part.e").alias("explained"),
    )


def identity_error(x: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened values' covariance (divisor n, centred) minus the identity; 0 without components."""
    k = len(model.values)
    if not k or not model.n:
        return 0.0
    w = projected(x, model).select([F.col("w")[i].alias(f"w{i}") for i in range(k)])
    got = w.agg(
        *[F.sum(f"w{i}").alias(f"s{i}") for i in range(k)],
        *[F.sum(F.col(f"w{i}") * F.col(f"w{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)],
    ).first()
    n, worst = model.n, 0.0
    for i in range(k):
        for j in range(i, k):
            cov = got[f"p{i}_{j}"] / n - (got[f"s{i}"] / n) * (got[f"s{j}"] / n)
            worst = max(worst, abs(cov - (1.0 if i == j else 0.0)))
    return worst


def report(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The query's rows: `whitened` over a written copy of the usable rows, with identity_error as one more column."""
    from gavelspark.llm.shared import written

    x = written(fixed_points(embeddings, column))
    model = fit(x, components)
    return whitened(x, model).withColumn("identity_error", F.lit(identity_error(x, model)))
