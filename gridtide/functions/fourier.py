"""Discrete Fourier transforms of keyed rows.

Short series are packed into one array each and transformed in Arrow batches. A series longer than
`limit` is never gathered: a chirp transform turns it into power-of-two transforms, and those split
into two rounds of short ones, each round grouped by residue (about the root of the length).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from gridtide.functions.batches import map_stacks

DIRECT_LIMIT = 1 << 18
# Spelled as types: a DDL string needs a running session, which a worker has not.
ARRAYS = T.StructType([T.StructField(part, T.ArrayType(T.DoubleType())) for part in ("re", "im")])


def _turned(batches: Iterator[tuple[pd.Series, pd.Series]], transform) -> Iterator[pd.DataFrame]:
    for re, im in batches:
        out = pd.DataFrame(index=re.index, columns=["re", "im"], dtype=object)
        whole = pd.Series([np.asarray(a) + 1j * np.asarray(b) for a, b in zip(re, im)], index=re.index)
        z = map_stacks(whole, lambda rows: transform(rows, axis=1))
        out["re"], out["im"] = z.map(np.real), z.map(np.imag)
        yield out


@pandas_udf(ARRAYS)
def _fft(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    yield from _turned(batches, np.fft.fft)


@pandas_udf(ARRAYS)
def _ifft(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    yield from _turned(batches, np.fft.ifft)


def _short(rows: DataFrame, keys: list[str], transform) -> DataFrame:
    packed = rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("t", "re", "im"))).alias("p")
    )
    done = packed.withColumn("z", transform(F.col("p.re"), F.col("p.im")))
    return done.select(*keys, F.posexplode(F.arrays_zip("z.re", "z.im")).alias("k", "v")).select(
        *keys, "k", F.col("v.re").alias("re"), F.col("v.im").alias("im")
    )


def split_fft(rows: DataFrame, keys: list[str], inverse: bool = False) -> DataFrame:
    """Transform of rows (keys, m, t, re, im), m = 2^p per key, absent rows 0; returns (.., k, ..).

    With m = m1 * m2, t = r + m1 q and k = s + m2 u: short transforms over q for every r, a twist
    by r s / m, short transforms over r for every s. No task sees more than max(m1, m2) points.
    """
    turn = _ifft if inverse else _fft
    half = F.floor(F.round(F.log2("m")) / 2)
    cut = rows.withColumn("m1", F.pow(F.lit(2.0), half).cast("long")).withColumn(
        "m2", (F.col("m") / F.col("m1")).cast("long")
    )
    index = lambda entries, size: F.expr(
        f"transform(sequence(0L, {size} - 1), i -> element_at({entries}, i))"
    )

    def packed(df, group, position, size):
        entries = F.map_from_entries(
            F.collect_list(F.struct(F.col(position), F.struct("re", "im")))
        )
        grouped = df.groupBy(*keys, "m", "m1", "m2", group).agg(entries.alias("e"))
        return grouped.withColumn("a", index("e", size)).select(
            *keys, "m", "m1", "m2", group,
            F.expr("transform(a, v -> coalesce(v.re, 0D))").alias("re"),
            F.expr("transform(a, v -> coalesce(v.im, 0D))").alias("im"),
        )

    first = packed(
        cut.withColumn("r", F.expr("t % m1")).withColumn("q", F.expr("t div m1")), "r", "q", "m2"
    )
    spread = first.withColumn("z", turn("re", "im")).select(
        *keys, "m", "m1", "m2", "r", F.posexplode(F.arrays_zip("z.re", "z.im")).alias("s", "v")
    )
    sign = 1.0 if inverse else -1.0
    angle = sign * 2 * np.pi * F.expr("(r * s) % m") / F.col("m")
    twisted = spread.select(
        *keys, "m", "m1", "m2", "r", F.col("s").cast("long").alias("s"),
        (F.col("v.re") * F.cos(angle) - F.col("v.im") * F.sin(angle)).alias("re"),
        (F.col("v.re") * F.sin(angle) + F.col("v.im") * F.cos(angle)).alias("im"),
    )
    second = packed(twisted, "s", "r", "m1").withColumn("z", turn("re", "im"))
    return second.select(
        *keys, "m", "m2", "s", F.posexplode(F.arrays_zip("z.re", "z.im")).alias("u", "v")
    ).select(
        *keys, "m", (F.col("s") + F.col("m2") * F.col("u")).alias("k"),
        F.col("v.re").alias("re"), F.col("v.im").alias("im"),
    )


def _times(re, im, c, s):
    return (F.col(re) * c - F.col(im) * s), (F.col(re) * s + F.col(im) * c)


def long_dft(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Transform of rows (keys, n, t, re, im) of any length n, by chirps and `split_fft`."""
    m = F.pow(F.lit(2.0), F.ceil(F.log2(2 * F.col("n") - 1))).cast("long")
    chirp = np.pi * F.expr("(cast(t as bigint) * t) % (2 * n)") / F.col("n")
    re, im = _times("re", "im", F.cos(chirp), -F.sin(chirp))
    a = rows.select(*keys, m.alias("m"), F.col("t").cast("long").alias("t"), re.alias("re"), im.alias("im"))
    sizes = rows.select(*keys, "n").distinct()
    steps = sizes.withColumn("m", m).withColumn("t", F.explode(F.expr("sequence(0L, n - 1L)")))
    b = steps.withColumn(
        "at", F.explode(F.expr("array_distinct(array(t, (m - t) % m))"))
    ).select(*keys, "m", F.col("at").alias("t"), F.cos(chirp).alias("re"), F.sin(chirp).alias("im"))
    fa = split_fft(a, keys)
    fb = split_fft(b, keys).withColumnsRenamed({"re": "bre", "im": "bim"})
    product = fa.join(fb, [*keys, "m", "k"]).select(
        *keys, "m", F.col("k").alias("t"),
        (F.col("re") * F.col("bre") - F.col("im") * F.col("bim")).alias("re"),
        (F.col("re") * F.col("bim") + F.col("im") * F.col("bre")).alias("im"),
    )
    back = split_fft(product, keys, inverse=True).join(sizes, keys).filter("k < n")
    turn = np.pi * F.expr("(k * k) % (2 * n)") / F.col("n")
    re, im = _times("re", "im", F.cos(turn), -F.sin(turn))
    return back.select(*keys, F.col("k").cast("int").alias("k"), re.alias("re"), im.alias("im"))


def at_most(column: str, longest: int) -> Column:
    """True; a row beyond the caller's bound fails the job."""
    said = F.concat(F.lit(f"{column} exceeds the bound of {longest}: "), F.col(column).cast("string"))
    return F.when(F.col(column) <= longest, F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))


def dft(rows: DataFrame, keys: list[str], limit: int = DIRECT_LIMIT, longest: int | None = None):
    """(keys, k, re, im) of rows (keys, n, t, re, im); n is each key's length.

    `longest` is a known bound on n, and a longer key fails the job; without it one small aggregation looks the lengths up.
    """
    if longest is None:
        longest = rows.agg(F.max("n").alias("n")).first().n or 0
    else:
        rows = rows.filter(at_most("n", longest))
    if longest <= limit:
        return _short(rows, keys, _fft)
    short = _short(rows.filter(F.col("n") <= limit), keys, _fft)
    return short.unionByName(long_dft(rows.filter(F.col("n") > limit), keys))
