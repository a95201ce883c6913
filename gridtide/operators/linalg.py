"""Linear algebra over distributed rows: Gram tables, block products, eigenbases, projections.

A matrix is a table of rows, one ARRAY over the short axis each; the long axis is the rows and stays distributed. A Gram
matrix up to `MAX_WIDTH` wide is decomposed in one task; beyond, `wide_eigenbasis` iterates a subspace with QR trees and keeps
every factor as a table of slabs. Products meet block by block: a group holds one tile of rows and one slab of the summed
axis, never all weights. Arrays are added in Arrow, in the order of their keys, so a task holds one sum at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridtide.session import materialize

MAX_WIDTH = 8192
FLUSH_BYTES = 64 << 20
# A batch of 10,000 tiles comes to a task at once: 80 MB of them, or one row of a wide matrix each.
TILE_ENTRIES = 1 << 10
#: Entries of the summed axis in one block, rows in one tile of a wide matrix, partial sums that one group adds up.
SLAB, TILE_ROWS, FAN = 1024, 2048, 64
# Fixed value: singular values below this share of the largest count as zero.
RELATIVE_TOLERANCE = 1e-3
DOUBLES = T.ArrayType(T.DoubleType())


def key_schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys)


def _fields(df: DataFrame, names: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([df.schema[n] for n in names] + [T.StructField(n, t) for n, t in more])


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over as many tasks as a shuffle has, before a function takes them group by group. What groups cost
    shows in their number; the runtime would merge tasks by their bytes until thousands of small groups share one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# --- arrays in Arrow ------------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    lists = column.combine_chunks()
    return np.asarray(lists.flatten()).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0)))


def sum_arrays(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Element-wise sum of equal-length arrays per key.

    Rows come sorted by key, so a task adds them as they pass and holds one open sum.
    """
    types = _fields(rows, keys, (column, DOUBLES))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(types)
        open_key, open_sum = None, None

        def packed(done: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _ in done], schema.field(i).type) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, _lists([s for _, s in done]).cast(schema.field(len(keys)).type)], schema=schema)

        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            lists = batch.column(column)
            values, ends = np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            done, start = [], 0
            while start < len(names):
                stop = start + 1
                while stop < len(names) and names[stop] == names[start]:
                    stop += 1
                part = values[ends[start] : ends[stop]].reshape(stop - start, -1).sum(axis=0)
                if open_sum is not None and open_key == names[start]:
                    open_sum = open_sum + part
                else:
                    if open_sum is not None:
                        done.append((open_key, open_sum))
                    open_key, open_sum = names[start], part
                start = stop
            if done:
                yield packed(done)
        if open_sum is not None:
            yield packed([(open_key, open_sum)])

    sorted_rows = rows.select(*keys, column).repartition(*keys).sortWithinPartitions(*keys)
    return sorted_rows.mapInArrow(add, types)


def tree_sum(parts: DataFrame, keys: list[str], column: str, source: str) -> DataFrame:
    """`sum_arrays` up a tree: the parts of `FAN` sources first, so that no key is summed in one long run."""
    near = sum_arrays(parts.withColumn("_group", F.floor(F.col(source) / FAN)), [*keys, "_group"], column)
    return sum_arrays(near, keys, column)


# --- Gram matrices --------------------------------------------------------------------------------


def _tile_rows(width: int) -> int:
    return max(1, TILE_ENTRIES // max(1, width))


def gram(rows: DataFrame, keys: list[str], left: str = "vec", right: str = "vec") -> DataFrame:
    """(keys, i, row): row i of the sum over `rows` of outer(left, right), per key.

    Every partition sums its own outer products and gives each matrix once, as tiles of bounded size that are added up a
    tree over the partitions. No entry becomes a row.
    """
    names = list(keys)
    values = lambda key: key if isinstance(key, tuple) else (key,)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        source = TaskContext.get().partitionId()

        def flush(which: list):
            for key in which:
                g = sums.pop(key)
                step = _tile_rows(g.shape[1])
                starts = list(range(0, len(g), step))
                tiles = [g[i : i + step].ravel() for i in starts]
                yield pd.DataFrame({**{n: [v] * len(tiles) for n, v in zip(names, values(key))}, "i": starts, "width": g.shape[1], "source": source, "tile": tiles})

        for batch in batches:
            for key, part in batch.groupby(names, sort=False):
                a = np.stack(part["a"].to_list())
                if max(a.shape[1], len(part["b"].iloc[0])) > MAX_WIDTH:
                    raise ValueError(
                        f"short axis of {a.shape[1]} exceeds {MAX_WIDTH}: put the longer axis in the rows or give a rank"
                    )
                g = a.T @ (a if left == right else np.stack(part["b"].to_list()))
                if key not in sums and sum(m.nbytes for m in sums.values()) + g.nbytes > FLUSH_BYTES:
                    yield from flush(list(sums))
                sums[key] = sums[key] + g if key in sums else g
        yield from flush(list(sums))

    schema = f"{key_schema(rows, names)}, i int, width int, source int, tile array<double>"
    parts = rows.select(*names, F.col(left).alias("a"), F.col(right).alias("b")).mapInPandas(partial, schema)
    tiles = tree_sum(parts, [*names, "i", "width"], "tile", "source")
    cut = F.expr("transform(sequence(0, size(tile) div width - 1), k -> struct(cast(i + k as int) as i, slice(tile, k * width + 1, width) as row))")
    return tiles.select(*names, F.explode(cut).alias("r")).select(*names, "r.i", "r.row")


def gram_entries(rows: DataFrame, keys: list[str]) -> DataFrame:
    return gram(rows, keys).select(*keys, "i", F.posexplode("row").alias("j", "g"))


def square(part: pd.DataFrame) -> np.ndarray:
    return np.stack(part.sort_values("i")["row"].to_list())


def _upright(vectors: np.ndarray) -> np.ndarray:
    """Columns with their entry of largest magnitude positive."""
    if not vectors.size:
        return vectors
    return vectors * np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])


def leading_eigenpairs(g: np.ndarray, rank: int | None, tolerance: float):
    """(all eigenvalues, descending and >= 0; leading singular values; their vectors)."""
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    usable = int(np.sum(values > tolerance**2 * values[0])) if values[0] > 0 else 0
    r = usable if rank is None else min(rank, usable)
    return values, np.sqrt(values[:r]), _upright(vectors[:, :r])


def eigenbasis(
    grams: DataFrame, keys: list[str], rank: int | None = None, tolerance: float = RELATIVE_TOLERANCE
) -> DataFrame:
    """(keys, mode, s, share, n_values, v): leading singular values, their share of the total
    and their vectors over the short axis, one small decomposition per key."""
    names = list(keys)

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        values, s, v = leading_eigenpairs(square(part), rank, tolerance)
        out = pd.DataFrame(
            {"mode": np.arange(len(s)), "s": s, "share": values[: len(s)] / values.sum(),
             "n_values": len(values), "v": list(v.T)}
        )
        for n, value in zip(names, key):
            out[n] = value
        return out

    schema = f"{key_schema(grams, names)}, mode int, s double, share double, n_values int, v array<double>"
    return dealt(grams, *names).groupBy(*names).applyInPandas(solve, schema)


# --- block products -------------------------------------------------------------------------------


def _slabs(column: str) -> Column:
    """(slab, part): an array cut into slabs of the summed axis."""
    return F.explode(F.expr(
        f"transform(sequence(0, (size({column}) - 1) div {SLAB}),"
        f" s -> struct(cast(s as int) as slab, slice({column}, s * {SLAB} + 1, {SLAB}) as part))"
    ))


def block_product(
    left: DataFrame, right: DataFrame, on: list[str], tile: list[str], ids: list[str], whole: bool = False, places: DataFrame | None = None
) -> DataFrame:
    """(on, ids, coef): per left row the sums over slabs of its part times every mode's part.

    left is (on, tile, ids, slab, part), right (on, mode, slab, part). A group is one tile of rows and one slab of
    the modes; its partial products are added as arrays. `whole` says that there is one slab only; `places` are the
    tiles (on, tile), if they are known more cheaply than from `left`.
    """
    spread = right.join(left.select(*on, *tile).distinct() if places is None else places, on)
    # Columns of their own: both sides of a cogroup may stem from one table.
    spread = spread.select(*[F.col(c).alias(c) for c in spread.columns])
    keys, types = [*on, *tile, "slab"], _fields(left, [*on, *ids], ("coef", DOUBLES))

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = to_arrow_schema(types)
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        weights = _matrix(b["part"])[np.argsort(b["mode"].to_numpy())]
        product = _matrix(a["part"]) @ weights.T
        return pa.table([*[a[n] for n in (*on, *ids)], _lists(list(product))], names=schema.names).cast(schema)

    parts = dealt(left, *keys).groupBy(*keys).cogroup(dealt(spread, *keys).groupBy(*keys)).applyInArrow(multiply, types)
    return parts if whole else sum_arrays(parts, [*on, *ids], "coef")


def project(
    rows: DataFrame, on: list[str], tile: list[Column], ids: list[str], weights: DataFrame, vec: str = "vec", whole: bool = False
) -> DataFrame:
    """(on, ids, coef): the dot of every row's `vec` with every weight row (on, mode, w), modes ascending.

    Rows are tiled by `tile` and cut into slabs; with `whole`, arrays are short enough to stay in one piece.
    """
    tiles = [c.alias(f"_tile{i}") for i, c in enumerate(tile)]
    names = [f"_tile{i}" for i in range(len(tile))]
    cut = lambda column: F.explode(F.array(F.struct(F.lit(0).alias("slab"), F.col(column).alias("part")))) if whole else _slabs(column)
    left = rows.select(*on, *tiles, *ids, cut(vec).alias("_s")).select(*on, *names, *ids, "_s.slab", "_s.part")
    right = weights.select(*on, "mode", cut("w").alias("_s")).select(*on, "mode", "_s.slab", "_s.part")
    return block_product(left, right, on, names, ids, whole)


# --- QR trees -------------------------------------------------------------------------------------


def triangles(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, r, width, n): per key the triangular factor of its rows' arrays, row by row in `r`, and their number.

    QR per partition, then up a tree of `FAN` factors each: R^T R is the Gram matrix, but its condition is not squared.
    """
    types = T.StructType([
        rows.schema[key], T.StructField("source", T.IntegerType()), T.StructField("r", DOUBLES),
        T.StructField("width", T.IntegerType()), T.StructField("n", T.LongType()),
    ])

    def fold(old: np.ndarray | None, new: np.ndarray) -> np.ndarray:
        return np.linalg.qr(new if old is None else np.vstack((old, new)), mode="r")

    def packed(factors: dict, counts: dict, source: int) -> pa.RecordBatch:
        schema, names = to_arrow_schema(types), list(factors)
        columns = [pa.array(names, schema.field(0).type), pa.array([source] * len(names), pa.int32()), _lists([factors[k].ravel() for k in names]).cast(schema.field(2).type)]
        columns += [pa.array([factors[k].shape[1] for k in names], pa.int32()), pa.array([counts[k] for k in names], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, counts, source = {}, {}, TaskContext.get().partitionId()
        for batch in batches:
            codes = batch.column(key).dictionary_encode(null_encoding="encode")
            order = np.argsort(codes.indices.to_numpy(), kind="stable")
            sizes = np.bincount(codes.indices.to_numpy(), minlength=len(codes.dictionary))
            for name, some in zip(codes.dictionary.to_pylist(), np.split(order, np.cumsum(sizes)[:-1]), strict=True):
                own = _matrix(pa.chunked_array([batch.column(column).take(pa.array(some))]))
                factors[name] = fold(factors.get(name), own)
                counts[name] = counts.get(name, 0) + len(own)
            if sum(f.nbytes for f in factors.values()) > FLUSH_BYTES:
                yield packed(factors, counts, source)
                factors, counts = {}, {}
        yield packed(factors, counts, source)

    def join(table: pa.Table) -> pa.Table:
        found = None
        for r, width in zip(table["r"].to_pylist(), table["width"].to_pylist(), strict=True):
            found = fold(found, np.asarray(r).reshape(-1, width))
        name = table[key][0].as_py()
        return pa.Table.from_batches([packed({name: found}, {name: sum(table["n"].to_pylist())}, 0)])

    near = rows.select(key, column).mapInArrow(leaves, types).withColumn("_group", F.floor(F.col("source") / FAN))
    joined = dealt(near, key, "_group").groupBy(key, "_group").applyInArrow(join, types)
    joined = dealt(joined, key).groupBy(key).applyInArrow(join, types)
    return joined.select(key, "r", "width", "n")


def triangle_of(r: list, width: int) -> np.ndarray:
    return np.asarray(r).reshape(-1, width)


# --- wide matrices --------------------------------------------------------------------------------


def _triangle(rows: DataFrame, key: str, column: str) -> dict:
    """The triangular factors on the driver: one square matrix per key, as wide as the arrays, for a handful of keys."""
    return {r[key]: triangle_of(r.r, r.width) for r in triangles(rows, key, column).collect()}


class _Wide:
    """Rows cut into tiles and slabs, with the products of a subspace iteration as tables.

    A basis is (key, slab, v): the slab's rows of a matrix as wide as the subspace, one behind the other.
    """

    def __init__(self, rows: DataFrame, key: str) -> None:
        self.key, self.type = key, rows.schema[key]
        numbered = rows.select(key, F.monotonically_increasing_id().alias("id"), "vec")
        cut = numbered.select(key, "id", F.floor(F.col("id") / TILE_ROWS).alias("tile"), _slabs("vec").alias("s"))
        self.a = materialize(cut.select(key, "tile", "id", "s.slab", "s.part"), "wide")
        self.tiles = materialize(self.a.select(key, "tile").distinct(), "tiles")
        self.slabs = materialize(self.a.groupBy(key, "slab").agg(F.max(F.size("part")).alias("size")), "slabs")
        sums = self.a.groupBy(key).agg(F.sum(F.expr("aggregate(part, 0D, (s, x) -> s + x * x)")).alias("total"), F.count_if(F.col("slab") == 0).alias("n_rows"))
        widths = self.slabs.groupBy(key).agg(F.sum("size").alias("width"))
        #: Per key the sum of squares, the width and the number of rows.
        self.facts = {r[key]: (r.total, r.width, r.n_rows) for r in sums.join(widths, key).collect()}

    def _schema(self, *more: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([self.type, *[T.StructField(n, t) for n, t in more]])

    def start(self, columns: dict) -> DataFrame:
        """A seeded random basis of so many columns per key."""
        key = self.key

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(batch.column(key).to_pylist(), batch.column("slab").to_pylist(), batch.column("size").to_pylist(), strict=True)
                drawn = [np.random.default_rng(slab).normal(size=size * columns[name]) for name, slab, size in rows]
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("slab"), _lists(drawn)], names=[key, "slab", "v"])

        return self.slabs.mapInArrow(draw, self._schema(("slab", T.IntegerType()), ("v", DOUBLES)))

    def forward(self, basis: DataFrame) -> DataFrame:
        """(key, tile, id, y): the rows times the basis."""
        keys, types = [self.key, "tile", "slab"], self._schema(("tile", T.LongType()), ("id", T.LongType()), ("y", DOUBLES))
        names = [self.key, "tile", "id"]

        def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
            schema = to_arrow_schema(types)
            if not a.num_rows or not b.num_rows:
                return schema.empty_table()
            part = _matrix(a["part"])
            y = part @ _matrix(b["v"]).reshape(part.shape[1], -1)
            return pa.table([*[a[n] for n in names], _lists(list(y))], names=schema.names).cast(schema)

        spread = basis.join(self.tiles, self.key)
        parts = dealt(self.a, *keys).groupBy(*keys).cogroup(dealt(spread, *keys).groupBy(*keys)).applyInArrow(multiply, types)
        return sum_arrays(parts, names, "y")

    def backward(self, product: DataFrame) -> DataFrame:
        """(key, slab, v): the transposed rows times a table (key, tile, id, y)."""
        keys = [self.key, "tile", "slab"]
        types = self._schema(("slab", T.IntegerType()), ("source", T.LongType()), ("v", DOUBLES))
        name = self.key

        def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
            schema = to_arrow_schema(types)
            if not a.num_rows or not b.num_rows:
                return schema.empty_table()
            a, b = a.sort_by("id"), b.sort_by("id")
            z = _matrix(a["part"]).T @ _matrix(b["y"])
            one = [a[name][:1], a["slab"][:1], a["tile"][:1], _lists([z.ravel()])]
            return pa.table(one, names=schema.names).cast(schema)

        spread = product.join(self.slabs.select(self.key, "slab"), self.key)
        parts = dealt(self.a, *keys).groupBy(*keys).cogroup(dealt(spread, *keys).groupBy(*keys)).applyInArrow(multiply, types)
        return tree_sum(parts, [self.key, "slab"], "v", "source")

    def turned(self, basis: DataFrame, turns: dict) -> DataFrame:
        """The basis times one small matrix per key."""
        key = self.key

        def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column(key).to_pylist()
                new = [(np.asarray(v).reshape(-1, len(turns[n])) @ turns[n]).ravel() for n, v in zip(names, batch.column("v").to_numpy(zero_copy_only=False), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("slab"), _lists(new)], names=[key, "slab", "v"])

        return basis.select(key, "slab", "v").mapInArrow(turn, self._schema(("slab", T.IntegerType()), ("v", DOUBLES)))

    def triangle(self, basis: DataFrame, columns: dict) -> dict:
        """The triangular factors of a basis, from its rows."""
        key = self.key

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, v in zip(batch.column(key).to_pylist(), batch.column("v").to_numpy(zero_copy_only=False), strict=True):
                    matrix = np.asarray(v).reshape(-1, columns[name])
                    r = np.linalg.qr(matrix, mode="r")
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(r), batch.schema.field(key).type), _lists(list(r))], names=[key, "y"])

        return _triangle(basis.mapInArrow(rows, self._schema(("y", DOUBLES))), key, "y")

    def orthonormal(self, basis: DataFrame, columns: dict) -> tuple[DataFrame, dict]:
        """A basis of the same space with orthonormal columns; columns that depend on others go."""
        for _ in range(2):
            turns = {}
            for name, r in self.triangle(basis, columns).items():
                sizes = np.linalg.norm(r, axis=0)
                sizes[sizes == 0] = 1.0
                _, s, w = np.linalg.svd(r / sizes, full_matrices=False)
                keep = s > 1e-13 * s[0]
                keep[0] = True  # a basis of zeros keeps one of them
                turns[name] = (w.T[:, keep] / np.where(s > 0, s, 1.0)[keep]) / sizes[:, None]
            basis = materialize(self.turned(basis, turns), "basis")
            columns = {n: t.shape[1] for n, t in turns.items()}
        return basis, columns


def wide_eigenbasis(
    rows: DataFrame, key: str, rank: int, tolerance: float = RELATIVE_TOLERANCE, extra: int = 10, rounds: int = 40, settled: float = 1e-12
) -> DataFrame:
    """`eigenbasis` of matrices whose short axis is too wide to square in a task, all keys at once.

    Subspace iteration: a basis of `rank` and `extra` columns is multiplied by the rows and back, and made orthonormal by
    the triangular factor of a QR tree, until the leading singular values settle or `rounds` are over. The basis lies in
    slabs, each round is written, and the driver sees square matrices as wide as the basis only, a handful of fits at a
    time. Directions of nearly equal singular values at the edge of the rank may mix with those beyond it.
    """
    schema = f"{key_schema(rows, [key])}, mode int, s double, share double, n_values int, v array<double>"
    wide = _Wide(rows, key)
    columns = {k: min(rank + extra, width, n) for k, (_, width, n) in wide.facts.items()}
    if not columns:
        return rows.sparkSession.createDataFrame([], schema)
    basis, columns = wide.orthonormal(wide.start(columns), columns)
    before: dict = {}
    for _ in range(rounds):
        product = materialize(wide.forward(basis), "product")
        turns, values = {}, {}
        for name, r in _triangle(product, key, "y").items():
            _, s, w = np.linalg.svd(r)
            turns[name], values[name] = w.T, s
        still = [n for n, s in values.items() if n not in before or np.any(np.abs(s[:rank] - before[n][: len(s[:rank])]) > settled * s[0])]
        if not still:
            break
        before = values
        basis, columns = wide.orthonormal(wide.backward(product), columns)
    leading = {n: int(np.sum(s[:rank] > tolerance * s[0])) if s[0] > 0 else 0 for n, s in values.items()}
    turned = wide.turned(basis, {n: w[:, : leading[n]] for n, w in turns.items()})
    shapes = T.StructType([wide.type, T.StructField("mode", T.IntegerType()), T.StructField("slab", T.IntegerType()), T.StructField("part", DOUBLES)])

    def by_mode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, slab, v in zip(batch.column(key).to_pylist(), batch.column("slab").to_pylist(), batch.column("v").to_numpy(zero_copy_only=False), strict=True):
                n = leading[name]
                if n:
                    parts = list(np.asarray(v).reshape(-1, n).T)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, batch.schema.field(key).type), pa.array(range(n), pa.int32()), pa.array([slab] * n, pa.int32()), _lists(parts)], names=[key, "mode", "slab", "part"])

    whole = turned.mapInArrow(by_mode, shapes).groupBy(key, "mode").agg(F.array_sort(F.collect_list(F.struct("slab", "part"))).alias("p"))
    facts = rows.sparkSession.createDataFrame(
        [(n, i, float(s[i]), float(s[i] ** 2 / wide.facts[n][0]), int(wide.facts[n][1])) for n, s in values.items() for i in range(leading[n])],
        f"{key_schema(rows, [key])}, mode int, s double, share double, n_values int",
    )
    found = facts.join(whole.select(key, "mode", F.flatten("p.part").alias("v")), [key, "mode"])
    signed = found.withColumn("sign", F.expr("case when array_max(v) >= -array_min(v) then 1D else -1D end"))
    upright = signed.withColumn("v", F.expr("transform(v, x -> x * sign)"))
    return materialize(upright.select(key, "mode", "s", "share", "n_values", "v"), "factors")

