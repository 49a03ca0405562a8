"""Operator 12: whitening of embeddings by exact integer products.

Entries become integers x = floor(256 c).  Integers are cut into limbs of 16 bits, so a float64 BLAS product of two limb
matrices of up to 2**20 rows is exact; limb products are put together as big integers.  Tasks give n, the sums S and the
products X'X of their vectors exactly, states are added exactly in any order, and the centred covariance
(n X'X - SS') / n**2 is exact before anything is rounded.  Its eigenvectors come from the float64 decomposition, made
orthonormal in big integers; the covariance in their basis, again an exact product of limbs, is then diagonalised by Jacobi
rotations in extended precision, so small eigenvalues keep their digits beside large ones.

Defined results: rows whose vector is null, or holds null or non-finite entries, are left out; entries beyond 64 bits become
the nearest long; vectors of each length are fitted on their own; each distinct vector counts once in the fit; repeated rows
are all kept; a direction without variance can't be whitened, so there are as many components as the fit list's
rank, four at most (none for a single vector); ``deviation`` is null beyond a long, ``deviation_text`` is always exact; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm._common import Scratch, arrow_schema, small_batches

LIMB, COMPONENTS, ROWS = 16, 4, 1 << 20
STATE = "dim int, n long, width int, sums binary, products binary"
SPREAD = "dim int, n long, means array<double>, products array<double>"
WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string, dim int"


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Float64 matrices L with x = sum of L[k] * 2**(16 k): the last one signed, the others from 0 to 65535.  ``x`` holds
    longs or big integers."""
    if not x.size:
        return [x.astype(np.float64)]
    most = max(int(x.max()), -1 - int(x.min()))
    count = most.bit_length() // LIMB + 1
    return [((x >> (LIMB * k)) & 0xFFFF if k < count - 1 else x >> (LIMB * k)).astype(np.float64) for k in range(count)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact matrix product, as big integers."""
    out = np.zeros((a.shape[0], b.shape[1]), object)
    for first in range(0, max(1, a.shape[1]), ROWS):
        held: dict[int, np.ndarray] = {}  # a thousand products of 2**52 fit in a long
        right = limbs(b[first : first + ROWS])
        for i, x in enumerate(limbs(a[:, first : first + ROWS])):
            for j, y in enumerate(right):
                held[i + j] = held.get(i + j, 0) + (x @ y).astype(np.int64)
        for k, v in held.items():
            out += v.astype(object) << (LIMB * k)
    return out


def pack(values: np.ndarray, width: int) -> bytes:
    return b"".join([int(v).to_bytes(width, "little", signed=True) for v in values.reshape(-1)])


def unpack(raw: bytes, width: int, *shape: int) -> np.ndarray:
    out = np.empty(len(raw) // width, object)
    out[:] = [int.from_bytes(raw[k : k + width], "little", signed=True) for k in range(0, len(raw), width)]
    return out.reshape(*shape)


class Moments:
    """n, sums and products of vectors of one length.  Limb products of the batches are added as longs, which hold 2**26
    rows, before they are put together."""

    def __init__(self, dim: int):
        self.dim, self.n, self.rows = dim, 0, 0
        self.sums, self.products = np.zeros(dim, object), np.zeros((dim, dim), object)
        self.held: dict[int, np.ndarray] = {}
        self.lines: dict[int, np.ndarray] = {}

    def add(self, x: np.ndarray) -> None:
        parts = limbs(x)
        for i, a in enumerate(parts):
            self.lines[i] = self.lines.get(i, 0) + a.sum(axis=0).astype(np.int64)
            for j, b in enumerate(parts):
                self.held[i + j] = self.held.get(i + j, 0) + (a.T @ b).astype(np.int64)
        self.n += len(x)
        self.rows += len(x)
        if self.rows >= 1 << 26:
            self.join()

    def join(self) -> None:
        for k, v in self.lines.items():
            self.sums = self.sums + (v.astype(object) << (LIMB * k))
        for k, v in self.held.items():
            self.products = self.products + (v.astype(object) << (LIMB * k))
        self.rows, self.held, self.lines = 0, {}, {}

    def merge(self, n: int, sums: np.ndarray, products: np.ndarray) -> None:
        self.n, self.sums, self.products = self.n + n, self.sums + sums, self.products + products

    def row(self) -> dict:
        self.join()
        width = max([int(v).bit_length() for v in [*self.sums, *self.products.reshape(-1)]], default=0) // 8 + 1
        return {"dim": self.dim, "n": self.n, "width": width, "sums": pack(self.sums, width), "products": pack(self.products, width)}

    @staticmethod
    def of(row: dict) -> tuple[int, np.ndarray, np.ndarray]:
        dim, width = row["dim"], row["width"]
        return row["n"], unpack(row["sums"], width, dim), unpack(row["products"], width, dim, dim)


def rank(matrix: np.ndarray) -> int:
    """The rank of an integer matrix, by elimination modulo a prime (which could only be too small, and hardly ever is)."""
    prime = 2_147_483_629
    m = (matrix % prime).astype(np.int64)
    found = 0
    for column in range(m.shape[1]):
        at = np.flatnonzero(m[found:, column])
        if not len(at):
            continue
        m[[found, found + at[0]]] = m[[found + at[0], found]]
        m[found] = m[found] * pow(int(m[found, column]), -1, prime) % prime
        below = m[found + 1 :]
        below -= below[:, column : column + 1] * m[found] % prime
        below %= prime
        found += 1
    return found


def jacobi(a: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors (columns) of a nearly diagonal symmetric matrix ``a`` in the basis ``v``, in extended
    precision: rotations until every entry is small beside its two diagonal ones."""
    small = np.finfo(np.longdouble).eps
    for _ in range(60):
        d = np.abs(np.diag(a))
        i, j = np.nonzero(np.triu(np.abs(a) > small * np.sqrt(np.outer(d, d)) + np.finfo(np.longdouble).tiny, 1))
        if not len(i):
            break
        for p, q in zip(i.tolist(), j.tolist()):
            if a[p, q] == 0:
                continue
            theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
            t = (1 if theta >= 0 else -1) / (abs(theta) + np.hypot(np.longdouble(1), theta))
            c = 1 / np.hypot(np.longdouble(1), t)
            s = t * c
            turn = np.array([[c, s], [-s, c]], np.longdouble)
            a[:, [p, q]] = a[:, [p, q]] @ turn
            a[[p, q]] = turn.T @ a[[p, q]]
            a[p, q] = a[q, p] = 0
            v[:, [p, q]] = v[:, [p, q]] @ turn
    return np.diag(a), v


class Whitening:
    """n, S, and the leading components with their eigenvalues, of one fit list."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray, most: int = COMPONENTS):
        self.n, self.sums, self.dim = n, sums, len(sums)
        self.squares = int((sums * sums).sum()) if self.dim else 0
        scaled = n * products - np.outer(sums, sums)  # n**2 times the covariance
        trace = int(np.trace(scaled)) if self.dim else 0
        self.count = min(most, rank(scaled)) if trace else 0
        self.vectors = np.zeros((self.dim, 0), np.longdouble)
        self.values = self.explained = np.zeros(0, np.longdouble)
        if not self.count:
            return
        drop = max(0, trace.bit_length() - 900)  # what float64 can't hold is only left out of the first guess
        guess = np.linalg.eigh((scaled >> drop).astype(np.float64))[1][:, ::-1]
        bits = 78
        basis = np.array([[int(v) for v in row] for row in np.ldexp(guess, 62)], object) << (bits - 62)
        for _ in range(2):  # orthonormal to the last bit
            basis = product(basis, np.eye(self.dim, dtype=object) * (3 << bits) - (product(basis.T, basis) >> bits)) >> (bits + 1)
        turned = product(product(basis.T, scaled), basis)
        down = max(0, trace.bit_length() - 1000)
        top = trace >> down
        a = np.array([[wide(int(v), 2 * bits + down) for v in row] for row in turned], np.longdouble) / wide(top, 0)
        a = (a + a.T) / 2
        v = np.array([[wide(int(v), bits) for v in row] for row in basis], np.longdouble)
        values, vectors = jacobi(a, v)
        order = np.argsort(-values, kind="stable")[: self.count]
        vectors, values = vectors[:, order], values[order]
        vectors /= np.sqrt((vectors * vectors).sum(axis=0))
        vectors *= np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1, 1)
        self.vectors, self.explained = vectors, values
        self.values = values * (wide(trace, 0) / wide(n, 0) / wide(n, 0))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where they can't overflow, else big integers."""
        most = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(int(s)) for s in self.sums)
        if most < 1 << 62:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x).astype(np.longdouble) / self.n) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum of squares of n x - S: longs where they can't overflow, else big integers."""
        y = self.centred(x)
        if y.dtype != object and self.dim * int(np.abs(y).max()) ** 2 < 1 << 63:
            return np.einsum("ij,ij->i", y, y)
        parts, square = limbs(x), np.zeros(len(x), object)
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                square += np.einsum("ij,ij->i", a, b).astype(np.int64).astype(object) << (LIMB * (i + j))
        return self.n * self.n * square - 2 * self.n * product(x, self.sums[:, None])[:, 0] + self.squares


def wide(value: int, shift: int) -> np.longdouble:
    """value / 2**shift with the 64 leading bits of value."""
    drop = max(0, value.bit_length() - 64)
    high = value >> drop
    return np.ldexp(np.longdouble(high >> 32) * (1 << 32) + np.longdouble(high & 0xFFFFFFFF), drop - shift)


def matrices(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors, by length, of an Arrow column of lists without nulls."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, edges = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        yield at, flat[edges[at][:, None] + np.arange(dim)]


def _moments():
    schema = arrow_schema(STATE)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own: dict[int, Moments] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                own.setdefault(x.shape[1], Moments(x.shape[1])).add(x)
        for state in own.values():
            yield pa.RecordBatch.from_pylist([state.row()], schema)

    return run


def _merged():
    schema = arrow_schema(STATE)

    def run(table):
        import pyarrow as pa

        own = Moments(table["dim"][0].as_py())
        for k in range(table.num_rows):
            own.merge(*Moments.of(table.slice(k, 1).to_pylist()[0]))
        return pa.Table.from_pylist([own.row()], schema)

    return run


def fit(vectors: DataFrame, scratch: Scratch) -> dict[int, Whitening]:
    """The whitening of each length of the distinct vectors ``x``.  States are added in two steps, so that no task holds more
    than about the root of their number, and one row per length comes to the driver."""
    states = scratch.stage(vectors.select("x").mapInArrow(_moments(), STATE).withColumn("part", F.spark_partition_id()), "states")
    groups = max(1, int(states.count() ** 0.5))
    some = states.groupBy("dim", F.pmod("part", F.lit(groups)).alias("g")).applyInArrow(_merged(), STATE)
    rows = some.groupBy("dim").applyInArrow(_merged(), STATE).collect()
    scratch.drop("states")
    return {r.dim: Whitening(*Moments.of(r.asDict())) for r in rows}


def _spread(fits: dict[int, Whitening]):
    schema = arrow_schema(SPREAD)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own: dict[int, tuple] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                z = fits[x.shape[1]].project(x)
                mean = z.mean(axis=0)
                own[x.shape[1]] = pooled(own.get(x.shape[1]), (len(z), mean, (z - mean).T @ (z - mean)))
        for dim, (n, mean, square) in own.items():
            yield pa.RecordBatch.from_pylist([{"dim": dim, "n": n, "means": mean.astype(float).tolist(), "products": square.reshape(-1).astype(float).tolist()}], schema)

    return run


def pooled(a: tuple | None, b: tuple) -> tuple:
    """Size, means and centred products of two lots together."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _pooled():
    schema = arrow_schema(SPREAD)

    def run(table):
        import pyarrow as pa

        own, dim = None, table["dim"][0].as_py()
        for row in table.to_pylist():
            mean = np.array(row["means"], np.longdouble)
            own = pooled(own, (row["n"], mean, np.array(row["products"], np.longdouble).reshape(len(mean), len(mean))))
        return pa.Table.from_pylist([{"dim": dim, "n": own[0], "means": own[1].astype(float).tolist(), "products": own[2].reshape(-1).astype(float).tolist()}], schema)

    return run


def identity_errors(vectors: DataFrame, fits: dict[int, Whitening], scratch: Scratch) -> dict[int, float]:
    """For each length the largest entry of the whitened fit list's covariance minus the identity."""
    states = scratch.stage(vectors.select("x").mapInArrow(_spread(fits), SPREAD).withColumn("part", F.spark_partition_id()), "spread")
    groups = max(1, int(states.count() ** 0.5))
    some = states.groupBy("dim", F.pmod("part", F.lit(groups)).alias("g")).applyInArrow(_pooled(), SPREAD)
    found = {}
    for r in some.groupBy("dim").applyInArrow(_pooled(), SPREAD).collect():  # one row per length
        k = len(r.means)
        found[r.dim] = float(np.abs(np.array(r.products).reshape(k, k) / r.n - np.eye(k)).max()) if k else 0.0
    return found


def _whitened(fits: dict[int, Whitening], errors: dict[int, float]):
    schema = arrow_schema(WHITE)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, x in matrices(batch.column(1)):
                own = fits[x.shape[1]]
                k = own.count
                if not k:
                    continue
                away = own.deviation(x).tolist()
                text = [str(v) for v in away for _ in range(k)]
                fits_long = [v if v < 1 << 63 else None for v in away for _ in range(k)]
                rows = len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(rows, own.n)),
                        pa.array(fits_long, pa.int64()),
                        pa.array(own.project(x).astype(np.float64).reshape(-1)),
                        pa.array(np.tile(own.explained.astype(np.float64), len(x))),
                        pa.array(np.full(rows, errors[own.dim])),
                        pa.array(text),
                        pa.array(np.full(rows, own.dim, np.int32)),
                    ],
                    schema=schema,
                )

    return run


def whiten(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Rows of ``WHITE`` for each vector and component.  Only distinct vectors are shuffled, once."""
    spark = small_batches(embeddings.sparkSession)
    scratch = Scratch(spark, "whitening")
    entry = lambda c: F.coalesce(c.cast("double"), F.lit(float("nan")))
    usable = F.col(vector).isNotNull() & F.forall(vector, lambda c: ~F.isnan(entry(c)) & (F.abs(entry(c)) < F.lit(float("inf"))))
    rows = embeddings.where(usable).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda c: F.floor(F.lit(256.0) * c.cast("double"))).alias("x"))
    distinct = scratch.stage(rows.select("x").distinct(), "distinct")
    fits = fit(distinct, scratch)
    errors = identity_errors(distinct, fits, scratch)
    scratch.drop("distinct")
    return rows.mapInArrow(_whitened(fits, errors), WHITE)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
