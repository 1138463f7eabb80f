"""Whitening of embeddings by slicing the spectrum of their covariance.

Vectors are whole numbers, so their sums and centred second moments are added up exactly: numpy multiplies a batch, Spark
adds the batches, and what reaches the driver is one dimensions x dimensions matrix. There the count of negative pivots of
the LDL^T factors of V - s I tells how many eigenvalues lie below s. Halving by these counts cuts out an interval for each
of the leading eigenvalues; Rayleigh quotient iteration converges in it, and two more counts certify which eigenvalue was
met. The projection is again batch by batch with the workers.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import staged

EPS = float(np.finfo(float).eps)
#: Whole numbers up to this are exact as doubles, so are sums of products that stay below it.
EXACT = float(1 << 53)


def inertia(a: np.ndarray) -> tuple[int, int]:
    """How many eigenvalues of a symmetric matrix are negative and how many zero: the signs of the pivots of its LDL^T
    factors (Sylvester), with symmetric pivoting by blocks of one or two rows (Bunch and Kaufman)."""
    a = np.array(a, dtype=float)
    n, k, negative, zero = len(a), 0, 0, 0
    alpha = (1 + 17**0.5) / 8
    while k < n:
        step, swap, own = 1, k, abs(a[k, k])
        if k + 1 < n:
            column = np.abs(a[k + 1 :, k])
            r = k + 1 + int(np.argmax(column))
            most = abs(a[r, k])
            if own < alpha * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                if own * row.max() < alpha * most * most:
                    step, swap = (1, r) if abs(a[r, r]) >= alpha * row.max() else (2, r)
            if max(own, most) == 0:
                zero, k = zero + 1, k + 1
                continue
        elif own == 0:
            return negative, zero + 1
        at = k + step - 1
        if swap != at:
            a[[at, swap]] = a[[swap, at]]
            a[:, [at, swap]] = a[:, [swap, at]]
        if step == 1:
            negative += a[k, k] < 0
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k] / a[k, k], a[k, k + 1 :])
        else:
            negative += 1  # such a block is indefinite
            rest = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(a[k : k + 2, k : k + 2], rest.T)
        k += step
    return int(negative), zero


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Eigenvalues nearer to each other than rounding can tell get orthonormal vectors of their common space.
    """
    v = np.asarray(v, dtype=float)
    n, counts = len(v), {}
    k = min(k, n)
    norm = float(np.abs(v).sum(1).max(initial=0.0))
    if not norm:
        return np.zeros(k), np.eye(n, k)
    least, slack = norm * 4 * EPS, norm * 8 * EPS * n

    def above(s: float) -> int:
        if s not in counts:
            negative, zero = inertia(v - s * np.eye(n))
            counts[s] = n - negative - zero
        return counts[s]

    def halved(i: int, low: float, high: float, alone: bool) -> tuple[float, float]:
        """Smaller bounds of eigenvalue i; alone: until no other eigenvalue is between them."""
        first = True
        while high - low > least and (first or alone and not (above(low) == i and above(high) == i - 1)):
            mid, first = (low + high) / 2, False
            low, high = (mid, high) if above(mid) >= i else (low, mid)
        return low, high

    values, vectors = np.zeros(k), np.zeros((n, k))
    for i in range(1, k + 1):
        known = [s for s in counts if counts[s] >= i]
        low = max(known, default=-norm - slack)
        high = min([s for s in counts if counts[s] < i], default=norm + slack)
        low, high = halved(i, low, high, True)
        found = vectors[:, : i - 1]
        while True:
            value, vector = _rayleigh(v, (low + high) / 2, found, norm, i)
            if low - slack <= value <= high + slack and above(value + slack) < i <= above(value - slack):
                break
            if high - low <= least:
                raise ArithmeticError(f"the counts do not certify eigenvalue {i}")
            low, high = halved(i, low, high, False)
        values[i - 1], vectors[:, i - 1] = value, vector
    return values, vectors


def _rayleigh(v: np.ndarray, shift: float, found: np.ndarray, norm: float, seed: int) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from two steps of inverse iteration at `shift`, orthogonal to the vectors found before."""
    n = len(v)
    x = np.random.default_rng(seed).standard_normal(n)

    def unit(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - found @ (found.T @ x)
            x = x / np.linalg.norm(x)
        return x

    def solve(s: float) -> np.ndarray:
        for nudge in (0, 1, -2, 4):
            try:
                y = np.linalg.solve(v - (s + nudge * EPS * norm) * np.eye(n), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and y.any():
                return y
        return x

    x = unit(x)
    for _ in range(2):
        x = unit(solve(shift))
    last = np.inf
    for _ in range(40):
        value = float(x @ v @ x)
        off = float(np.linalg.norm(v @ x - value * x))
        if off <= EPS * norm or off >= last / 2 and off <= 64 * EPS * norm:
            break
        last = off
        x = unit(solve(value))
    return float(x @ v @ x), x


def quantised(df: DataFrame, vector_col: str, scale: int, offset: int, *more: str) -> DataFrame:
    """(more, x array<long>): x[i] = floor(scale * c) + offset of the double c. Rows whose vector is null or holds null or
    non-finite entries are left out; shorter vectors are filled up with c = 0 to the length of the longest. Entries beyond
    2^61 / scale count as that."""
    c = F.col(vector_col).cast("array<double>")
    fine = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    most = float(1 << 61)
    whole = F.transform(c, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(-most)), F.lit(most))).cast("long") + F.lit(offset).cast("long"))
    rows = df.filter(F.col(vector_col).isNotNull() & fine)
    width = rows.agg(F.max(F.size(vector_col)), F.min(F.size(vector_col))).first()
    if width[0] != width[1]:
        whole = F.concat(whole, F.array_repeat(F.lit(offset).cast("long"), F.lit(width[0]) - F.size(whole)))
    return rows.select(*more, whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows x dimensions."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b of whole numbers, exact: by doubles where these hold every sum, else by Python's whole numbers."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(len(a), 1)
    if most < EXACT:
        return (a.T.astype(float) @ b.astype(float)).astype(np.int64).astype(object)
    return a.T.astype(object) @ b.astype(object)


def _added(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[tuple[int, int], object]:
    """The sum over all rows of the matrix that `part` gives for a batch of them; no batch: an empty dict."""
    exact = kind != "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_matrix(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape)
            v = pa.array([decimal.Decimal(int(x)) for x in total.ravel()], pa.decimal128(38, 0)) if exact else pa.array(total.ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), v], ["i", "j", "v"])

    sums = fit.select("x").mapInArrow(run, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): int(r["v"]) if exact else r["v"] for r in sums.collect()}


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error), a row per vector and component.

    Vectors become whole numbers x (see `quantised`). The fit takes each distinct x once: n vectors, per-dimension sums S,
    covariance V with divisor n. deviation: the sum over dimensions of (n x - S)^2, exact, null where a long cannot hold
    it. whitened: (x - S / n) projected on the component's unit eigenvector, over the root of its eigenvalue. explained:
    eigenvalue over the trace of V. identity_error: the largest absolute entry of the covariance of `whitened` over the
    fit, minus the identity. A component without variance (an eigenvalue that is zero but for rounding) has a null
    whitened, explained 0 and no part in identity_error; such are all of a table that repeats one vector. Vectors of fewer
    dimensions than `components` have a component for each. Null and repeated ids keep a row each; an empty table and
    vectors without entries give no rows.
    """
    fit = staged(quantised(df, vector_col, scale, offset).distinct(), "fit")
    sums = _added(fit, lambda x: np.concatenate([_product(x, np.ones((len(x), 1), np.int64)), np.array([[len(x)]], object)]), "decimal(38,0)")
    dims = len(sums) - 1
    n, total = (sums[dims, 0], [sums[i, 0] for i in range(dims)]) if sums else (0, [])
    # distances from the whole number next to the mean are small, their products exact; what is left of the mean comes off after
    centre = [(2 * s + n) // (2 * n) for s in total]
    left = [s - n * c for s, c in zip(total, centre, strict=True)]
    at = np.array(centre, np.int64)
    moments = _added(fit, lambda x: _product(x - at, x - at), "decimal(38,0)") if dims > 0 else {}
    v = np.array([[(n * moments[i, j] - left[i] * left[j]) / (n * n) for j in range(dims)] for i in range(dims)]) if moments else np.zeros((0, 0))
    values, vectors = leading(v, components) if moments else (np.zeros(0), np.zeros((0, 0)))
    trace = float(np.trace(v))
    some = values > dims * EPS * trace
    onto = vectors[:, some] / np.sqrt(values[some])
    rest = np.array([x / n for x in left])

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - at).astype(float) - rest) @ onto

    def second(x: np.ndarray) -> np.ndarray:
        z = projected(x)
        return np.vstack([z.T @ z, z.sum(0)])

    error, k = 0.0, int(some.sum())
    if k:
        found = _added(fit, second, "double")
        mean = np.array([found[k, j] for j in range(k)]) / n
        covariance = np.array([[found[i, j] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
        error = float(np.abs(covariance - np.eye(k)).max())
    explained = np.where(some, values / trace, 0.0) if trace else np.zeros(len(values))

    def deviations(x: np.ndarray) -> list[int | None]:
        d = x - at
        if float(n) ** 2 * (np.abs(d).astype(float) + 1).max(initial=0) ** 2 * max(dims, 1) < 2**62:
            q = n * d - np.array(left, np.int64)
            return (q * q).sum(1).tolist()
        exact = (sum((n * int(c) - s) ** 2 for c, s in zip(row, left, strict=True)) for row in d)
        return [q if q < 1 << 63 else None for q in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = len(values)
        for batch in batches:
            if not batch.num_rows or not each:
                continue
            x = _matrix(batch.column(1))
            z, there = np.zeros((len(x), each)), np.tile(some, len(x))
            z[:, some] = projected(x)
            rows = pa.array(np.repeat(np.arange(len(x)), each))
            columns = [
                batch.column(0).take(rows), pa.array(np.tile(np.arange(1, each + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), n)),
                pa.array(deviations(x), pa.int64()).take(rows), pa.array(z.ravel(), mask=~there), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = df.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return quantised(df, vector_col, scale, offset, id_col).mapInArrow(run, out)
