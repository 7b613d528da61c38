"""Whitening of embeddings by exact covariances, which variances of dimensions and of their sums give (polarisation)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT; entries from MOST / SCALE on have no neighbours that differ by one, and count as not finite.
SCALE, SHIFT, MOST = 64, 1_000_000, 2**53
#: Rows of a block, and the low bits of a partial sum that are summed apart from the high ones.
ROWS, LOW = 4096, 40


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns: rows n, an integer ``centre`` near each mean, ``rest`` (the sum of x - centre), unit ``components``
    (one a row, by falling ``eigenvalues``), the share of variance ``explained`` by each, and ``identity_error``."""

    n: int
    centre: tuple[int, ...]
    rest: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None

    @property
    def projection(self) -> np.ndarray:
        """Components over the roots of their eigenvalues; those without variance have no root and are NaN."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.components / np.where(self.eigenvalues > 0, np.sqrt(self.eigenvalues), np.nan)[:, None]


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that can be used, and the vectors' length.

    Vectors that are null, or hold null or non-finite entries (or entries beyond 2^47), are dropped, and so are those that lack entries
    or have more than most have: the length that most of the others have is taken, the larger of several.
    """
    v = F.col(vector_col).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= MOST / SCALE)
    clean = table.select(table[id_col].alias("vec_id"), v.alias("vector")).filter(F.col("vector").isNotNull() & ~F.exists("vector", bad))
    sizes = clean.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.agg(F.max(F.struct("rows", "size")).alias("top")).first()["top"]
    size = most["size"] if most else 0
    return clean.filter(F.size("vector") == size), size


def integers(batch: pa.RecordBatch, size: int, centre: tuple[int, ...]) -> Iterator[np.ndarray]:
    """x - centre of the batch's vectors, in blocks of ``ROWS`` rows."""
    flat = batch.column(batch.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False)
    for at in range(0, batch.num_rows, ROWS):
        block = flat[at * size : (at + ROWS) * size].reshape(-1, size)
        yield np.floor(SCALE * block).astype(np.int64) + (SHIFT - np.array(centre, np.int64))


def totals(vectors: DataFrame, size: int, centre: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """The exact sums over all rows of what ``part`` gives for blocks of them: a vector of integers, as long for each block.

    A task sends its own sums only; Spark adds them up by their place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for y in integers(batch, size, centre):
                found = part(y).astype(object)
                total = found if total is None else total + found
        if total is not None:
            high, low = [Decimal(v >> LOW) for v in total], [v & (1 << LOW) - 1 for v in total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(low)), pa.int32()), pa.array(high, pa.decimal128(38, 0)), pa.array(low, pa.int64())], names=["place", "high", "low"])

    parts = vectors.mapInArrow(run, "place int, high decimal(38,0), low bigint")
    rows = parts.groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return [(int(r["high"]) << LOW) + r["low"] for r in sorted(rows, key=lambda r: r["place"])]


def squares(y: np.ndarray) -> np.ndarray:
    """Sums of squares of each dimension, then of each sum of two: (0, 1), (0, 2) ... (1, 2) ...; exact, whatever the size."""
    if len(y) and len(y) * (2 * int(np.abs(y).max())) ** 2 >= 2**63:
        y = y.astype(object)
    sums = [(y * y).sum(axis=0)]
    for i in range(y.shape[1] - 1):
        pair = y[:, i, None] + y[:, i + 1 :]
        sums.append((pair * pair).sum(axis=0))
    return np.concatenate(sums)


def covariance(n: int, rest: list[int], sums: list[int]) -> np.ndarray:
    """Covariances, divisor n, of integers less a centre: their sums ``rest`` and what ``squares`` gives, each rounded once.

    n * n times the variance of v is n * sum(v * v) - sum(v)^2; twice a covariance is the variance of the sum of two less both variances.
    """
    size = len(rest)
    own = [n * q - r * r for q, r in zip(sums, rest, strict=False)]
    out, at = np.empty((size, size)), size
    for i in range(size):
        out[i, i] = own[i] / (n * n)
        for j in range(i + 1, size):
            both = n * sums[at] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n * n)
            at += 1
    return out


def fit(vectors: DataFrame, size: int, most: int = 32) -> Whitening | None:
    """Whitening by all vectors, with ``most`` components at the most; None where there are none.

    Three passes over the vectors, each of which sends a task's sums (of dimensions, pairs of dimensions or pairs of
    components) and no rows: sums; squares less an integer next to each mean, for every dimension and sum of two
    dimensions; and what the whitened values' covariance lacks of the identity.  The driver holds size * size numbers.

    Each component's largest entry is positive.  Components whose eigenvalue is nothing but rounding have eigenvalue 0.
    """
    if not size:
        return None
    first = totals(vectors, size, (0,) * size, lambda x: np.append((x.astype(object) if len(x) and len(x) * int(np.abs(x).max()) >= 2**63 else x).sum(axis=0), len(x)))
    if not first:
        return None
    n = first.pop()
    centre = tuple(s // n for s in first)
    rest = tuple(s - n * c for s, c in zip(first, centre, strict=True))
    v = covariance(n, list(rest), totals(vectors, size, centre, squares))
    eigenvalues, columns = np.linalg.eigh(v)
    eigenvalues, components = eigenvalues[::-1][:most].copy(), columns.T[::-1][:most].copy()
    components *= np.where(components[np.arange(len(components)), np.abs(components).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    eigenvalues[eigenvalues <= size * np.finfo(float).eps * max(eigenvalues[0], 0)] = 0
    trace = float(np.trace(v))
    explained = eigenvalues / trace if trace > 0 else np.zeros(len(eigenvalues))
    out = Whitening(n, centre, rest, components, eigenvalues, explained, None)
    used = int((eigenvalues > 0).sum())
    if not used:
        return out
    fraction, upper, projection = np.array([r / n for r in rest]), np.triu_indices(used), out.projection[:used]

    def products(y: np.ndarray) -> np.ndarray:
        w = (y - fraction) @ projection.T
        return np.array([int(x) for x in np.rint(np.append((w.T @ w)[upper], w.sum(axis=0)) * 2.0**LOW)], object)

    got = np.array([x / n / 2**LOW for x in totals(vectors, size, centre, products)])
    mean = got[len(upper[0]) :]
    error = got[: len(upper[0])] - mean[upper[0]] * mean[upper[1]] - (upper[0] == upper[1])
    return Whitening(n, centre, rest, components, eigenvalues, explained, float(np.abs(error).max()))


def whiten_embeddings(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """One row per usable vector (see ``usable``) and component, up to ``most``: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    x is floor(64 * entry) + 1000000, S its sums, n the usable rows.  deviation is the exact sum of (n * x - S)^2 over the dimensions, null
    where it is beyond a long.  whitened is x - S / n projected on the component, over the root of its eigenvalue.
    explained is the component's share of the variance.  identity_error, one value, is the largest absolute entry of the
    whitened values' covariance less the identity.  All vectors are the fit list (see ``fit``).

    Components without variance (of equal vectors, or of dimensions that depend on others) have whitened null and explained 0, and
    are no part of identity_error, which is null where none has any.  Vectors without entries give no rows.  Null and repeated ids are treated like
    others.  Only the id and the vector are read, so other columns' names do no harm.  An empty table gives an empty result.
    A task holds one Arrow batch of vectors; nothing is shuffled but the sums.
    """
    vectors, size = usable(table, id_col, vector_col)
    model = fit(vectors, size, most)
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    n, rest, k = model.n, np.array(model.rest, object), len(model.eigenvalues)
    fraction, projection = np.array([r / n for r in model.rest]), model.projection

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            for at, y in zip(range(0, batch.num_rows, ROWS), integers(batch, size, model.centre), strict=True):
                small = size * (n * (int(np.abs(y).max()) + 1)) ** 2 < 2**63
                scaled = n * y - rest.astype(np.int64) if small else n * y.astype(object) - rest
                far = (scaled * scaled).sum(axis=1)
                deviation = pa.array(far if small else [d if d < 2**63 else None for d in far], pa.int64())
                rows = np.repeat(np.arange(len(y)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(y)).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(len(rows), n)),
                        deviation.take(pa.array(rows)), pa.array(((y - fraction) @ projection.T).ravel(), from_pandas=True), pa.array(np.tile(model.explained, len(y))),
                        pa.array([model.identity_error] * len(rows), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.mapInArrow(apply, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
