"""Whitening of embeddings on an exact scatter matrix: residues modulo several primes, summed by matrix products and put together by Chinese remainders."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 20  # residues lie within 2 ** 19 of 0, so that 2 ** 14 products add up below 2 ** 53: doubles hold them exactly
BLOCK = 1 << 14
BAND = 64  # rows of the matrix that travel together


def primes(bound: int) -> list[int]:
    """The largest primes below 2 ** BITS, as many as tell apart all numbers within ``bound`` of 0."""
    found: list[int] = []
    p = 1 << BITS
    while prod(found) <= 2 * bound:
        p -= 1
        if all(p % d for d in range(2, isqrt(p) + 1)):
            found.append(p)
    return found


def remaindered(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The numbers (Python's, of any size) nearest to 0 that have these residues."""
    whole, total = prod(moduli), 0
    for r, p in zip(residues, moduli, strict=True):
        rest = whole // p
        total = total + r.astype(object) * (rest * pow(rest, -1, p))
    total = total % whole
    return np.where(total > whole // 2, total - whole, total)


def scatter(x: np.ndarray, p: int) -> np.ndarray:
    """Sums of products of the columns of ``x`` with a column of ones beside them, modulo ``p``."""
    d = x.shape[1] + 1
    total = np.zeros((d, d), np.int64)
    for at in range(0, len(x), BLOCK):
        r = np.ones((len(x[at : at + BLOCK]), d))
        rest = x[at : at + BLOCK] % p
        r[:, :-1] = np.where(rest > p // 2, rest - p, rest)
        total += np.rint(r.T @ r).astype(np.int64) % p
    return total % p


class Model:
    """Mean and principal components of vectors of one length, from their count, sums and sums of products, all exact."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray, most: int):
        self.n, self.sums = n, sums
        centred = n * products - np.outer(sums, sums)  # n ** 2 times the covariance, exact
        square = n * n
        covariance = np.array([[int(c) / square for c in row] for row in centred], np.float64)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:most]
        least = values.max(initial=0.0) * len(values) * np.finfo(np.float64).eps
        order = order[values[order] > least]  # a direction in which nothing varies cannot be scaled to 1
        self.values, self.vectors = values[order], vectors[:, order]
        self.trace = sum(int(c) for c in np.diag(centred)) / square if len(centred) else 0.0

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as 64-bit numbers where they fit, else as Python's."""
        most = max(map(abs, self.sums.tolist()), default=0) + self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        return self.n * x - self.sums.astype(np.int64) if most < 1 << 62 else self.n * x.astype(object) - self.sums

    def deviations(self, apart: np.ndarray) -> list[int]:
        most = max(abs(int(apart.max(initial=0))), abs(int(apart.min(initial=0))))
        exact = apart if apart.dtype != object and most * most * apart.shape[1] < 1 << 63 else apart.astype(object)
        return [int(s) for s in (exact * exact).sum(axis=1)]

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        return (apart / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def grid(column: pa.Array, d: int) -> np.ndarray:
    """Arrays of ``d`` numbers as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), d)


def of_length(batch: pa.RecordBatch, at: str) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of the rows of each length."""
    sizes = np.array(batch.column(at).value_lengths().to_pylist(), np.int64)
    for d in np.unique(sizes).tolist():
        yield d, np.flatnonzero(sizes == d)


def fit(distinct: DataFrame, most: int) -> dict[int, Model]:
    """A ``Model`` of the vectors (``x``) of each length.

    Every task adds up one matrix for each prime; matrices travel in bands of rows and are summed band by band, as they come, modulo their primes.  Primes are as
    many as the largest possible sum needs.  What comes to one task is the matrix of a length, whatever the number of vectors, and to the driver its ``most`` first components.
    """
    sizes = distinct.agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("x").cast("decimal(20)"), -F.array_min("x").cast("decimal(20)"))).alias("most")).first()
    if not sizes["n"]:
        return {}
    moduli = primes(sizes["n"] * max(1, int(sizes["most"])) ** 2)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, at in of_length(batch, "x"):
                x = grid(batch.column("x").take(pa.array(at)), d)
                for i, p in enumerate(moduli):
                    new = scatter(x, p)
                    totals[d, i] = (totals[d, i] + new) % p if (d, i) in totals else new
        for (d, i), total in totals.items():
            for band in range(0, d + 1, BAND):
                raw = total[band : band + BAND].astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([band], pa.int64()), pa.array([i], pa.int64()), pa.array([raw], pa.binary())], names=["d", "band", "prime", "raw"])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, totals = None, [np.zeros(0, np.int64)] * len(moduli)

        def done() -> pa.RecordBatch:
            whole = remaindered(totals, moduli)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([pickle.dumps(whole.tolist())], pa.binary())], names=["d", "band", "numbers"])

        for batch in batches:
            for d, band, i, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, band) != key:
                    if key is not None:
                        yield done()
                    key, totals = (d, band), [np.zeros(len(raw) // 8, np.int64) for _ in moduli]
                totals[i] = (totals[i] + np.frombuffer(raw, "<i8")) % moduli[i]
        if key is not None:
            yield done()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.sorted_groups(batches, ["d"]):
            d = part["d"][0].as_py()
            numbers = np.array([v for raw in part["numbers"].to_pylist() for v in pickle.loads(raw)], object).reshape(d + 1, d + 1)
            model = Model(numbers[d, d], numbers[d, :d], numbers[:d, :d], most)
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([pickle.dumps(model)], pa.binary())], names=["d", "model"])

    partial = distinct.select("x").mapInArrow(add, "d long, band long, prime long, raw binary")
    bands = partial.repartition("d", "band").sortWithinPartitions("d", "band").mapInArrow(sum_up, "d long, band long, numbers binary")
    models = bands.repartition("d").sortWithinPartitions("d", "band").mapInArrow(solve, "d long, model binary")
    return {r["d"]: pickle.loads(r["model"]) for r in models.collect()}


def whiten(vectors: DataFrame, most: int = 4, scale: int = 256) -> DataFrame:
    """Every vector's first ``most`` whitened components, fitted on the distinct vectors of whole numbers floor(``scale`` * entry).

    ``vectors`` has ``vec_id`` and ``embedding``.  Rows whose vector is null, empty or holds null or non-finite entries have no result; vectors of
    another length have a fit of their own (a model of a length is sent to all tasks: six numbers an entry, whatever the number of vectors).  Copies weigh as one in
    the fit, and each row has its result; null vec_ids stay null.  Entries beyond 64 bits count as the largest number there is.  Directions in which the
    fit's vectors do not vary have no component, so that a single vector has no rows.  An empty table gives an empty result; other columns are ignored.

    Returns ``vec_id``, ``component``, ``n``, ``deviation`` (null where it goes beyond 64 bits), ``whitened``, ``explained``, ``identity_error`` and ``deviation_digits``, the deviation in decimal.
    """
    spark = vectors.sparkSession
    entries = F.col("embedding").cast("array<double>")
    usable = F.coalesce((F.size(entries) > 0) & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entries, lambda c: F.floor(F.lit(float(scale)) * c)).alias("x"))
    distinct = common.stash(rows.select("x").distinct(), "vectors")
    sent = spark.sparkContext.broadcast(fit(distinct, most))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at in of_length(batch, "x"):
                model, part = sent.value[d], batch.take(pa.array(at))
                k = len(model.values)
                if not k:
                    continue
                apart = model.apart(grid(part.column("x"), d))
                value, deviation = model.whitened(apart), model.deviations(apart)
                m = len(at)
                long = [s if s < 1 << 63 else None for s in deviation]
                arrays = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array([s for s in long for _ in range(k)], pa.int64()), pa.array(value.ravel()), pa.array(np.tile(model.values / model.trace, m)),
                    pa.array([str(s) for s in deviation for _ in range(k)]), pa.array(np.full(m * k, d, np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "deviation_digits", "d"])

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at in of_length(batch, "x"):
                model = sent.value[d]
                value = model.whitened(model.apart(grid(batch.column("x").take(pa.array(at)), d)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int64)), pa.array(value.tolist(), pa.list_(pa.float64()))], names=["d", "w"])

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, deviation_digits string, d long"
    out = rows.mapInArrow(project, schema)
    white = distinct.mapInArrow(centred, "d long, w array<double>")
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    w = [F.get("w", F.lit(i)) for i in range(most)]
    away = [F.abs(F.covar_pop(w[i], w[j]) - (1.0 if i == j else 0.0)) for i, j in pairs]
    # a component that a fit does not have is null in all its rows, and so is its covariance
    errors = white.groupBy("d").agg(F.array_max(F.array(*away)).alias("identity_error"))
    found = {r["d"]: r["identity_error"] for r in errors.collect()}
    told = F.create_map(*(F.lit(v) for pair in found.items() for v in pair)) if found else F.lit(None).cast("map<bigint,double>")
    return out.withColumn("identity_error", told[F.col("d")]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits")
