"""Embedding whitening: principal components by hierarchical SVD merging.

Every partition of the distinct vectors is reduced to its count, exact sums, and all singular values and right singular
vectors of its centred rows.  Two such summaries become one by stacking their scaled vectors, appending one row that
corrects for the difference of the means, and decomposing that stack again.  No dimension is cut, so the last summary
has the singular values of the whole centred table.  Merges are grouped jobs over summaries, sixteen at a time, until
one is left; the driver sees that one alone, at most d x d numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column

#: Summaries that one task merges.
FAN = 16
#: Rows that are decomposed at a time.
BLOCK = 4096
#: Eigenvalues below this share of the largest one count as zero.
ZERO = 1e-12
_NUMBER = pa.decimal128(38, 0)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n; of whole numbers the numerators are exact."""
    if x.dtype == np.float64:
        return x - sums / n
    big = int(np.abs(x).max(initial=0)) * n + max((abs(int(s)) for s in sums), default=0)
    return (x * n - sums.astype(np.int64)) / n if big < 1 << 62 else ((x.astype(object) * n - sums) / n).astype(np.float64)


@dataclass
class Summary:
    """``n`` rows of one width: their sums, and the singular values and right singular vectors of the centred rows."""

    n: int
    sums: np.ndarray
    s: np.ndarray
    v: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Summary:
        """The summary of rows of doubles, or of whole numbers, whose sums are exact Python numbers."""
        whole = x.dtype != np.float64
        sums = x.astype(object).sum(0) if whole and int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62 else x.sum(0)
        sums = np.array([int(a) for a in sums], object) if whole else sums
        return Summary(len(x), sums, *decompose(_centred(x, len(x), sums)))

    def merge(self, other: Summary) -> Summary:
        """Both summaries in one: scaled vectors and a mean-correction row, decomposed again."""
        gap = (self.sums * other.n - other.sums * self.n).astype(np.float64) / np.sqrt(float(self.n) * other.n * (self.n + other.n))
        stack = np.concatenate([self.s[:, None] * self.v, other.s[:, None] * other.v, gap[None, :]])
        return Summary(self.n + other.n, self.sums + other.sums, *decompose(stack))


def decompose(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values, falling, and right singular vectors."""
    tall = np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows
    _, s, v = np.linalg.svd(tall, full_matrices=False)
    return s, v


@dataclass
class Model:
    """Components of vectors of one width: row i of ``axes`` is that of the (i + 1)th largest eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @staticmethod
    def of(whole: Summary, components: int) -> Model:
        d, values = len(whole.sums), np.zeros(len(whole.sums))
        axes = np.zeros((d, d))
        values[: len(whole.s)], axes[: len(whole.s)] = whole.s**2 / whole.n, whole.v
        axes = axes[:components]
        at = np.abs(axes).argmax(1) if d else np.zeros(0, int)  # a sign that does not hang on the order of merges
        signs = np.where(axes[np.arange(len(axes)), at] < 0, -1.0, 1.0) if d else np.zeros(0)
        return Model(whole.n, whole.sums, values[:components], axes * signs[:, None], float(values.sum()))

    @property
    def live(self) -> np.ndarray:
        """Components of more than no variance."""
        return self.values > ZERO * self.values.max(initial=0.0)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components over the square roots of their eigenvalues; 0 for a component without variance."""
        return _centred(x, self.n, self.sums) @ self.axes.T * np.where(self.live, 1 / np.sqrt(np.where(self.live, self.values, 1.0)), 0.0)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n x - sums)^2, exact."""
        big = int(np.abs(x).max(initial=0)) * self.n + max((abs(int(s)) for s in self.sums), default=0)
        if big**2 * max(1, x.shape[1]) < 1 << 63:
            gaps = x * self.n - self.sums.astype(np.int64)
            return pa.array((gaps * gaps).sum(1), pa.int64()).cast(_NUMBER)
        gaps = x.astype(object) * self.n - self.sums
        return pa.array([Decimal(int(g)) for g in (gaps * gaps).sum(1)], _NUMBER)


def _blocks(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the array, matrix) for each width among the lists of numbers."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    widths = np.diff(lists.offsets.to_numpy())
    for d in np.unique(widths):
        at = np.flatnonzero(widths == d)
        yield at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _to_rows(summaries: dict[int, Summary], part: int, exact: bool) -> pa.RecordBatch:
    listed = lambda arrays, kind: pa.array([list(a) for a in arrays], pa.list_(kind))
    own = list(summaries.items())
    sums = [[Decimal(a) for a in x.sums] if exact else x.sums for _, x in own]
    columns = [pa.array([d for d, _ in own], pa.int64()), pa.array([part] * len(own), pa.int64()), pa.array([x.n for _, x in own], pa.int64())]
    columns += [listed(sums, _NUMBER if exact else pa.float64()), listed([x.s for _, x in own], pa.float64()), listed([x.v.ravel() for _, x in own], pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["d", "part", "n", "sums", "s", "v"])


def _from_row(d: int, n: int, sums: list, s: list, v: list) -> Summary:
    whole = bool(sums) and isinstance(sums[0], Decimal)
    return Summary(n, np.array([int(a) for a in sums], object) if whole else np.array(sums, np.float64), np.array(s), np.array(v).reshape(len(s), d))


def _schema(exact: bool) -> str:
    return f"d bigint, part bigint, n bigint, sums array<{'decimal(38,0)' if exact else 'double'}>, s array<double>, v array<double>"


def summaries(vectors: DataFrame, scratch: Scratch, name: str, exact: bool) -> dict[int, Summary]:
    """The summary of the single array column of ``vectors`` for each width of its lists, merged on the executors."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Summary] = {}
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                for i in range(0, len(x), BLOCK):
                    own = Summary.of(x[i : i + BLOCK])
                    found[x.shape[1]] = found[x.shape[1]].merge(own) if x.shape[1] in found else own
        yield _to_rows(found, TaskContext.get().partitionId(), exact)

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        d = key[0].as_py()
        own = [_from_row(d, r["n"], r["sums"], r["s"], r["v"]) for r in rows.sort_by("part").to_pylist()]
        return pa.Table.from_batches([_to_rows({d: reduce(Summary.merge, own)}, key[1].as_py(), exact)])

    parts, level = scratch.save(vectors.mapInArrow(reduced, _schema(exact)), f"{name}-0"), 0
    while parts.groupBy("d").count().where("count > 1").limit(1).count():
        level += 1
        groups = parts.withColumn("part", F.floor(F.col("part") / FAN))
        parts = scratch.save(groups.groupBy("d", "part").applyInArrow(merged, _schema(exact)), f"{name}-{level}")
        scratch.drop(f"{name}-{level - 1}")
    out = {r["d"]: _from_row(r["d"], r["n"], r["sums"], r["s"], r["v"]) for r in parts.collect()}
    scratch.drop(f"{name}-{level}")
    return out


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def on_grid(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, y): the rows whose vectors are finite, each entry c as the whole number floor(scale * c)."""
    vector = column(vec_col).cast("array<double>")
    return vectors.where(finite(vector)).select(column(id_col).alias("id"), F.transform(vector, lambda c: F.floor(c * F.lit(float(scale)))).alias("y"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16, scale: int = 64) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of each finite vector and leading component.

    Entries are taken to the grid floor(scale * c).  The components are those of the covariance, with divisor n, of the
    n distinct grid vectors, so repeated vectors weigh no more than others; a constant that is added to all entries
    changes nothing.  ``deviation`` is the sum over dimensions of (n x - S)^2, S being the sums of the distinct vectors, as
    decimal(38,0); ``explained`` the component's share of the variance; ``identity_error`` the largest entry by which the
    covariance of the whitened distinct vectors, summed up anew from them, differs from the identity.

    Null vectors, and those with null or non-finite entries, have no rows.  Rows that repeat each return.  Vectors
    of another width form a space of their own; empty ones have no component.  A component without variance has a null
    ``whitened`` and does not count in ``identity_error``.  Eigenvalues that tie may take any basis.  Entries from
    2**57 on count as the largest whole number.  An empty table gives none.  Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = on_grid(vectors, id_col, vec_col, scale)
    fitted = scratch.save(rows.select("y").distinct(), "distinct")
    models = {d: Model.of(s, components) for d, s in summaries(fitted, scratch, "summary", True).items() if d}

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                if x.shape[1]:
                    w = models[x.shape[1]].whiten(x)
                    # the width goes before, so that models of different widths stay apart
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(x), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], ["d", "w"])

    seen = fitted.mapInArrow(projected, "d bigint, w array<double>")
    errors = {}
    for d, model in models.items():
        own = summaries(seen.where(F.col("d") == d).select("w"), scratch, f"check-{d}", False) if model.live.any() else {}
        for s in own.values():
            cov = (s.v.T * s.s**2) @ s.v / s.n
            errors[d] = float(np.abs(cov - np.eye(len(cov)))[np.ix_(model.live, model.live)].max())
    scratch.drop("distinct")

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _blocks(batch.column(1)):
                if not x.shape[1]:
                    continue
                model = models[x.shape[1]]
                k = len(model.values)
                repeat = pa.array(np.repeat(np.arange(len(x)), k))
                live = np.tile(model.live, len(x))
                share = model.values / model.trace if model.trace else np.zeros(k)
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column(0).take(repeat),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, model.n)),
                        model.deviations(x).take(repeat),
                        pa.array(model.whiten(x).ravel(), mask=~live),
                        pa.array(np.tile(share, len(x))),
                        pa.array(np.full(len(x) * k, errors.get(x.shape[1], np.nan)), mask=np.full(len(x) * k, x.shape[1] not in errors)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(applied, f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
