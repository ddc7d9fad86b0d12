"""Whitening of embeddings by spectrum slicing.

Spark works out exact sums and centred second moments; the driver sees one matrix whose size is the square of a vector's length.
How many eigenvalues of the covariance exceed a number is read from the signs of the pivots of an LDL' factorization of the covariance
less that number on its diagonal (Sylvester's law of inertia). Halving an interval by such counts isolates the k-th eigenvalue, Rayleigh
quotient iteration then converges to it cubically, and two more counts certify that it is the k-th.
"""

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.shared import kept

_ALPHA = (1 + math.sqrt(17)) / 8
#: Larger entries would not fit into 64 bits with room for a sum of two.
MOST = 2.0**51
_LOW = 2**31


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are larger than `shift`: the positive pivots of LDL' of what is left when
    `shift` is taken off the diagonal. Pivots are single or pairs (Bunch and Kaufman), so that none is too small."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, count = len(a), 0, 0

    def swap(i, j):
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        pair = False
        if k + 1 < n:
            column = np.abs(a[k + 1 :, k])
            r = int(column.argmax()) + k + 1
            most = column[r - k - 1]
            if abs(a[k, k]) < _ALPHA * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                if abs(a[k, k]) * row.max() < _ALPHA * most * most:
                    if abs(a[r, r]) >= _ALPHA * row.max():
                        swap(k, r)
                    else:
                        swap(k + 1, r)
                        pair = True
        if pair:  # its determinant is negative: one eigenvalue on either side
            left = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= left @ np.linalg.inv(a[k : k + 2, k : k + 2]) @ left.T
            count, k = count + 1, k + 2
        else:
            if a[k, k] != 0:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k] / a[k, k], a[k + 1 :, k])
            count, k = count + (a[k, k] > 0), k + 1
    return int(count)


def _solved(matrix: np.ndarray, shift: float, b: np.ndarray, step: float) -> np.ndarray:
    """A unit vector along the inverse of (matrix - shift) times b; a shift that is an eigenvalue is moved by a step."""
    for move in (0.0, step, -2 * step):
        try:
            x = np.linalg.solve(matrix - (shift + move) * np.eye(len(matrix)), b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all() and np.linalg.norm(x) > 0:
            return x / np.linalg.norm(x)
    return b


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance in falling order, `most` at most, and their unit vectors as columns.

    Eigenvalues that are zero to working precision are left out. Equal eigenvalues get vectors at right angles. The largest entry of each
    vector is positive."""
    d = len(matrix)
    trace = float(np.trace(matrix))
    if not d or trace <= 0:
        return np.zeros(0), np.zeros((d, 0))
    step = 8 * d * np.finfo(float).eps * trace
    counts = {0.0: d, trace + step: 0}

    def count(shift):
        if shift not in counts:
            counts[shift] = above(matrix, shift)
        return counts[shift]

    values: list[float] = []
    vectors = np.zeros((d, 0))
    random = np.random.default_rng(7)
    for k in range(1, min(most, d) + 1):
        if count(step) < k:
            break
        while True:
            low = max(s for s, c in counts.items() if c >= k)
            high = min(s for s, c in counts.items() if c < k and s > low)
            close = high - low <= step
            if not close and (counts[low] != k or counts[high] != k - 1):
                count((low + high) / 2)
                continue
            x = random.standard_normal(d)
            rho = (low + high) / 2
            done = False
            for turn in range(60):
                x = x - vectors @ (vectors.T @ x)
                x = _solved(matrix, rho, x / np.linalg.norm(x), step)
                x = x - vectors @ (vectors.T @ x)
                x /= np.linalg.norm(x)
                quotient = float(x @ matrix @ x)
                if turn >= 2 or low < quotient < high:
                    rho = quotient
                if done:
                    break
                done = np.linalg.norm(matrix @ x - quotient * x) <= step  # one more turn takes the vector to full precision
            if close or (low - step < quotient < high + step and count(quotient + step) < k <= count(quotient - step)):
                break
            count((low + high) / 2)  # it went to another eigenvalue: halve once more
        values.append(quotient)
        vectors = np.column_stack([vectors, x if x[np.abs(x).argmax()] > 0 else -x])
    return np.array(values), vectors


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum in each dimension."""

    def run(batches):
        n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            n, low, high = n + len(x), low + (x % _LOW).sum(0), high + (x // _LOW).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(low), pa.array(high)], names=["i", "n", "low", "high"])

    parts = rows.select("x").mapInArrow(run, "i int, n long, low long, high long")
    total = F.sum(F.col("high").cast("decimal(38,0)") * _LOW + F.col("low"))
    found = sorted(parts.groupBy("i").agg(F.sum("n"), total).collect())
    return found[0][1], [int(row[2]) for row in found]


def _moments(rows: DataFrame, d: int, middle: np.ndarray) -> np.ndarray:
    """Sums of products of the entries less `middle`, in one matrix. Each task adds up its own vectors first."""

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - middle
            total += x.T.astype(float) @ x.astype(float)
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "value"])

    parts = rows.select("x").mapInArrow(run, "i int, j int, value double")
    out = np.zeros((d, d))
    for i, j, value in parts.groupBy("i", "j").agg(F.sum("value")).collect():
        out[i, j] = out[j, i] = value
    return out


def _projected(rows: DataFrame, n: int, d: int, middle: np.ndarray, rest: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(key, deviation, w): exact squared deviation times n squared, and the whitened coordinates."""

    def run(batches):
        scaled = vectors / np.sqrt(values)
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - middle
            far = (int(np.abs(x).max(initial=0)) * n + int(np.abs(rest).max(initial=0))) ** 2 * d
            if far < 2**62:
                squares = pa.array(((n * x - rest) ** 2).sum(1)).cast(pa.decimal128(38, 0))
            else:
                exact = ((n * x.astype(object) - rest.astype(object)) ** 2).sum(1)
                squares = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            w = (x - rest / n) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch["key"], squares, lists], names=["key", "deviation", "w"])

    return rows.select("key", "x").mapInArrow(run, "key long, deviation decimal(38,0), w array<double>")


def whitened(df: DataFrame, key: str, vector: str, components: int = 8) -> DataFrame:
    """One row per vector and leading component: key, component (from 1), n (vectors in all), deviation, whitened, explained, identity_error.

    An entry c counts as x = floor(1024 c) + 100000. With S the sums of x over all n vectors, deviation is the exact sum of (n x - S)^2 over
    the entries, whitened is x - S/n on the component over the root of its eigenvalue, explained the eigenvalue's share of the variance,
    and identity_error the largest entry of the covariance of `whitened` less the identity.

    Vectors that are null or have null, NaN, infinite or enormous (2^51 and more) entries go, and so do those of another length than most
    (of lengths equally common the longest stays). Repeated rows count as often as they are there; ties between eigenvalues are split in any way.
    Directions without variance have no component: fewer rows come back then, none for one vector or an empty table. A deviation of over
    38 digits is null. Other columns are not read. Only sums and a matrix of moments, the square of a vector's length, reach the driver.
    """
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    vectors = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    vectors = kept(vectors.where(fine).select("key", F.transform("v", lambda c: F.floor(c * 1024) + 100000).alias("x")))
    empty = df.sparkSession.createDataFrame([], "key long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return empty
    d = lengths[0]
    rows = vectors.where(F.size("x") == d)
    n, sums = _sums(rows, d)
    middle = np.array([round(s / n) for s in sums], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, middle)], object)
    moments = _moments(rows, d, middle)
    whole = np.array([[int(v) for v in row] for row in moments], object)
    covariance = ((n * whole - np.outer(rest, rest)) / (n * n)).astype(float)  # exact up to the last division while moments stay below 2^53
    values, axes = leading(covariance, components)
    if not len(values):
        return empty
    done = kept(_projected(rows, n, d, middle, rest.astype(np.int64), values, axes))
    size = range(len(values))
    means = done.agg(*[F.avg(F.col("w")[i]) for i in size]).first()
    products = [F.avg((F.col("w")[i] - means[i]) * (F.col("w")[j] - means[j])) for i in size for j in size if i <= j]
    off = [float(i == j) for i in size for j in size if i <= j]
    error = max(abs(found - one) for found, one in zip(done.agg(*products).first(), off))
    shares = F.array(*[F.lit(float(v / np.trace(covariance))) for v in values])
    spread = done.select("key", "deviation", F.posexplode("w").alias("at", "whitened"))
    return spread.select(
        "key", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
