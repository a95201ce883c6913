"""Operator 8: links between texts of similar word n-gram sets by PartEnum signatures, and their components.

A text's set holds its distinct n-word shingles. Two sets of sizes s <= t with Jaccard similarity at least g lie within
Hamming distance (1 - g) / (1 + g) * (s + t). Sizes fall into levels, each with a bound k on the distance of the pairs whose
larger set is in it; a set signs its own level and those that its possible larger partners are in. In a level the shingles
are dealt by hash to n1 parts of n2 cells; a part whose share of the distance is at most k2 has n2 - k2 cells in common, so
every choice of n2 - k2 cells of every part gives a signature, and similar sets share one.

Cells may be nearly empty, and their signatures common to many texts. Each level with many parts has E more parts than the
distance needs, so at least E + 1 parts qualify, and each set leaves out the E / 2 parts that say least about it: a pair can lose
at most E of its qualifying parts, and still shares a signature. No signature is left out for being common.

Equal sets are one class from the start. Signatures are dealt to buckets by their hash and move as packed arrays: 32 bits of
each and 32 bits of its class; what either has in common by chance is sorted out by the next step. Classes that share a
signature form a group, and groups of the same members are one. A group's classes are compared by sketches, the parities of
the numbers of shingles in a power of two of cells: two sets differ in at least as many shingles as their sketches in bits,
so no link is lost. Classes whose sketches are near enough, directly or by way of others, form a cluster, found by star
steps. A cluster of at most `BLOCK` classes is compared in one task, which counts the exact similarity of a class with all
those that aren't yet in its component, so copies of one text cost one comparison each. A larger cluster is first compared
with its class in most groups; what isn't linked to that one meets all of the cluster in blocks of bounded size. Tasks give
links that join components, never all pairs of a group.

Shingles are compared by 64-bit hashes of the hashes of their words. Null texts and texts without words have an empty set,
size 0, and are linked with nothing. Rows with a null key have a null component and link nothing. Rows with the same key
count as one text each, linked by nothing else than their texts. Only the two named columns are read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.llm.common import Bytes, map_steps, maybe_in, mix, stored
from gridtide.llm.components import connected

BLOCK, ASKING = 1024, 512
SIZE_STEP = 1.4
# Shingles whose signatures make a bucket; most cells of a sketch; rows and words of sketches that are compared at once.
DEALT, CELLS, HELD, WORDS = 1 << 20, 1 << 15, 1 << 16, 1 << 20


def word_bytes() -> np.ndarray:
    """Bytes of words: all but blank and the controls from tab to carriage return."""
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return inside


def shingle_sets(column, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; of a shorter text, its whole sequence is the one shingle."""
    words = Bytes(column, word_bytes())
    h, first = words.hash, words.first
    out = []
    rolled = np.zeros(0, np.uint64)
    if len(h) >= n:
        rolled = mix(h[: len(h) - n + 1])
        for k in range(1, n):
            rolled = mix(rolled ^ h[k : len(h) - n + 1 + k]) + np.uint64(k)
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            whole = mix(h[a : a + 1])
            for k in range(a + 1, b):
                whole = mix(whole ^ h[k : k + 1]) + np.uint64(k - a)
            out.append(mix(whole + np.uint64(0xABCDEF)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=4096)
def level_of(size: int) -> tuple[int, int]:
    """(level, its largest size); levels grow by `SIZE_STEP`."""
    low, level = 1, 0
    while True:
        high = max(low, int(low * SIZE_STEP))
        if size <= high:
            return level, high
        low, level = high + 1, level + 1


@lru_cache(maxsize=65536)
def levels_to_sign(size: int, permille: int) -> tuple[tuple[int, int], ...]:
    """Levels of all sizes from `size` to that of its largest possible partner."""
    most, found, s = size * 1000 // permille, [], size
    while s <= most:
        found.append(level_of(s))
        s = found[-1][1] + 1
    return tuple(found)


@lru_cache(maxsize=4096)
def parameters(high: int, permille: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, parts each set may leave out) for a level whose largest size is `high`."""
    k = 2 * high * (1000 - permille) // (1000 + permille)
    if k < 4:
        return (1, *((1, 0), (3, 1), (5, 2), (6, 3))[k], 0)
    # Small sets of low similarity have few shingles per part: larger parts, more choices of cells.
    n2, k2 = (5, 2) if k <= 20 and permille < 900 else (2, 1) if k > 16 and permille >= 900 else (3, 1)
    needed = k // (k2 + 1) + 1
    spare = needed // 10
    return needed + 2 * spare, n2, k2, spare


def signatures(hashes: np.ndarray, permille: int) -> np.ndarray:
    """All signatures of one set."""
    found = []
    for level, high in levels_to_sign(len(hashes), permille):
        n1, n2, k2, left_out = parameters(high, permille)
        salted = mix(hashes ^ np.uint64(0x5851F42D4C957F2D * (level + 1) & 0xFFFFFFFFFFFFFFFF))
        part, cell = (salted >> np.uint64(33)) % np.uint64(n1), (salted & np.uint64(0xFFFF)) % np.uint64(n2)
        place = (part * np.uint64(n2) + cell).astype(np.int64)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, place, mix(salted))
        sums = sums.reshape(n1, n2)
        kept = np.arange(n1)
        if left_out:
            # The weakest parts are those whose poorest choice of cells has the fewest shingles.
            filled = np.sort(np.bincount(place, minlength=n1 * n2).reshape(n1, n2), axis=1)[:, : n2 - k2].sum(1)
            kept = np.sort(np.argsort(filled, kind="stable")[left_out:])
        for t, cells in enumerate(combinations(range(n2), n2 - k2)):
            code = np.zeros(len(kept), np.uint64)
            for c in cells:
                code = mix(code ^ sums[kept, c]) + np.uint64(c + 1)
            found.append(mix(code + (kept.astype(np.uint64) << np.uint64(20)) + np.uint64((level << 8) + t)))
    return np.concatenate(found)


def _sums(sets: list[np.ndarray]) -> list[np.ndarray]:
    """128 bits of each set."""
    ends = np.cumsum([0, *map(len, sets)])
    whole = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(whole ^ np.uint64(x))))) for x in (1, 2)]
    return [np.diff(s[ends]).view(np.int64) for s in sums]


SAME = ["low", "high", "n_shingles"]


def _class() -> Column:
    return F.xxhash64(*SAME).alias("class")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in the cells, as 64-bit words; there are at least as many cells as shingles, up to `CELLS`."""
    cells = min(CELLS, max(64, 1 << (len(hashes) - 1).bit_length()))
    at = (mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _hashed(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, n_shingles, low, high, sketch) per row: the set's size, 128 bits of it, its sketch."""
    kind = docs.schema[key].dataType.simpleString()

    def do(rows):
        sets = shingle_sets(rows.column(text), n)
        low, high = _sums(sets)
        sketches = [sketch(s).tobytes() if len(s) else None for s in sets]
        return {key: rows.column(key), "n_shingles": [len(s) for s in sets], "low": low, "high": high, "sketch": sketches}

    schema = f"{key} {kind}, n_shingles bigint, low bigint, high bigint, sketch binary"
    return map_steps(docs.select(key, text), text, schema, lambda: do)


def _texts(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(class, body) per row."""

    def do(rows):
        sets = shingle_sets(rows.column(text), n)
        low, high = _sums(sets)
        return {"low": low, "high": high, "n_shingles": [len(s) for s in sets], "body": rows.column(text)}

    named = map_steps(docs.select(text), text, "low bigint, high bigint, n_shingles bigint, body string", lambda: do)
    return named.select(_class(), "body")


def _groups(docs: DataFrame, text: str, n: int, permille: int, buckets: int) -> DataFrame:
    """(grp, owner): 32 bits of the classes that share a signature; of groups with the same members there is one."""
    small = np.uint64(0xFFFFFFFF)

    def deal(rows):
        sets = shingle_sets(rows.column(text), n)
        low, high = _sums(sets)
        # One text of each class of the slice.
        _, first = np.unique(np.column_stack((low, high)), axis=0, return_index=True)
        first = [i for i in first if len(sets[i])]
        found = [signatures(sets[i], permille) for i in first]
        sign = np.concatenate([np.zeros(0, np.uint64), *found])
        owner = np.repeat((low.view(np.uint64)[first] & small).astype(np.uint32), [len(x) for x in found])
        bucket = ((sign >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket, sign, owner = bucket[order], sign[order].astype(np.uint32), owner[order]
        edge = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1, append=-1)) if len(bucket) else np.zeros(1, np.int64)
        cut = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        return {"bucket": bucket[edge[:-1]], "signs": [sign[a:b].tobytes() for a, b in cut], "owners": [owner[a:b].tobytes() for a, b in cut]}

    def group(batches):
        import pyarrow as pa

        def flush(signs, owners):
            sign, owner = (np.frombuffer(b"".join(x), np.uint32).astype(np.uint64) for x in (signs, owners))
            both = np.unique(sign << np.uint64(32) | owner)
            edge = np.flatnonzero(np.diff(both >> np.uint64(32), prepend=~both[:1], append=~both[-1:]))
            size = np.diff(edge)
            owner, size = (both & small)[np.repeat(size > 1, size)], size[size > 1]
            if len(size):
                name = mix(np.add.reduceat(mix(owner), np.cumsum(size) - size) ^ size.astype(np.uint64))
                _, one = np.unique(name, return_index=True)
                chosen = np.repeat(np.isin(np.arange(len(size)), one), size)
                columns = [np.repeat(name, size)[chosen].view(np.int64), owner[chosen].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["grp", "owner"])

        held, signs, owners = None, [], []
        for batch in batches:
            for bucket, sign, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != held and signs:
                    yield from flush(signs, owners)
                    signs, owners = [], []
                held = bucket
                signs.append(sign)
                owners.append(owner)
        if signs:
            yield from flush(signs, owners)

    packed = map_steps(docs.select(text), text, "bucket bigint, signs binary, owners binary", lambda: deal)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(group, "grp bigint, owner bigint").distinct()


class _Sketches:
    """Sketches of different lengths, and the numbers of bits in which they differ."""

    def __init__(self, raw: list[bytes]) -> None:
        self.words = np.array([len(x) // 8 for x in raw])
        self.begin = np.cumsum(self.words) - self.words
        self.flat = np.frombuffer(b"".join(raw), np.uint64)

    def _folded(self, rows: np.ndarray, words: int, to: int) -> np.ndarray:
        # A cell of a shorter sketch is the sum of those with the same lowest bits.
        found = self.flat[self.begin[rows][:, None] + np.arange(words)]
        return found if words == to else np.bitwise_xor.reduce(found.reshape(len(rows), -1, to), axis=1)

    def far(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        kinds, kind = np.unique(np.column_stack((self.words[i], self.words[j])), axis=0, return_inverse=True)
        for k, (u, v) in enumerate(kinds.tolist()):
            at, step = np.flatnonzero(kind == k), max(1, WORDS // max(u, v))
            for a in range(0, len(at), step):
                some = at[a : a + step]
                apart = self._folded(i[some], u, min(u, v)) ^ self._folded(j[some], v, min(u, v))
                out[some] = np.bitwise_count(apart).sum(1, dtype=np.int64)
        return out


def near_rows(group: np.ndarray, size: np.ndarray, raw: list[bytes], permille: int) -> list[tuple[int, int]]:
    """Pairs of rows that join all rows of a group that may be linked, by their sketches; a group's rows are in a row."""
    sketches, n = _Sketches(raw), len(group)
    first, last = np.searchsorted(group, group), np.searchsorted(group, group, side="right")
    label, joins = np.arange(n), []

    def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = 1000 * a >= permille * b
        ok[ok] = (1000 + permille) * sketches.far(i[ok], j[ok]) <= (1000 - permille) * (a + b)[ok]
        return ok

    i, d = np.flatnonzero(np.arange(n) + 1 < last), 1
    while len(i):
        open_ = i[label[i] != label[i + d]]
        near = open_[may(open_, open_ + d)]
        if d == 1:  # neighbours join in runs
            joined = np.zeros(n, bool)
            joined[near + 1] = True
            label = np.maximum.accumulate(np.where(joined, 0, np.arange(n)))
            joins += [(x, x + 1) for x in near.tolist()]
        else:
            for x in near.tolist():
                if label[x] != label[x + d]:
                    own = label[first[x] : last[x]]
                    own[own == label[x + d]] = label[x]
                    joins.append((x, x + d))
        d += 1
        i = i[i + d < last[i]]
    return joins


def _sieved(groups: DataFrame, classes: DataFrame, permille: int) -> DataFrame:
    """(a, b): pairs of classes that join those of a group that may be linked."""

    def run(batches):
        import pyarrow as pa

        def flush(table):
            group, name, size = (table.column(c).to_numpy() for c in ("grp", "class", "n_shingles"))
            joins = near_rows(group, size, table.column("sketch").to_pylist(), permille)
            a, b = np.array(joins, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(name[a]), pa.array(name[b])], names=["a", "b"])

        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held else pa.Table.from_batches([batch])
            if held.num_rows >= HELD:
                # Whole groups only: the last one may go on.
                group = held.column("grp").to_numpy()
                whole = int(np.searchsorted(group, group[-1]))
                if whole:
                    yield flush(held[:whole])
                    held = held[whole:]
        if held:
            yield flush(held)

    known = classes.select("owner", "class", "n_shingles", "sketch")
    dealt = groups.join(known, "owner").select("grp", "class", "n_shingles", "sketch").repartition("grp").sortWithinPartitions("grp", "class")
    return dealt.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


class _Sets:
    """Some sets with their elements numbered, for counting what one set has in common with all of them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(x) for x in sets])
        self.begin = np.cumsum(self.size) - self.size
        values, self.number = np.unique(np.concatenate(sets), return_inverse=True)
        self.marked = np.zeros(len(values), bool)

    def linked(self, i: int, others: np.ndarray, permille: int) -> np.ndarray:
        """Which of `others` set i is linked with."""
        own = self.number[self.begin[i] : self.begin[i] + self.size[i]]
        self.marked[own] = True
        size = self.size[others]
        at = np.repeat(self.begin[others] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        both = np.add.reduceat(self.marked[self.number[at]].astype(np.int64), np.cumsum(size) - size)
        self.marked[own] = False
        return 1000 * both >= permille * (size + self.size[i] - both)


def _components(sets: list[np.ndarray], permille: int, asking: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Labels after each set of `asking` has met all sets that bear another label, and the links that joined labels."""
    own, joins = _Sets(sets), []
    for i in asking:
        others = np.flatnonzero(label != label[i])
        # Only sizes within the ratio can be linked.
        size = own.size[others]
        others = others[(1000 * size >= permille * own.size[i]) & (1000 * own.size[i] >= permille * size)]
        if len(others):
            for j in others[own.linked(i, others, permille)]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    joins.append((int(i), int(j)))
    return label, joins


def _small_clusters(members: DataFrame, n: int, permille: int) -> DataFrame:
    """(class, component) for clusters of at most `BLOCK` classes; each is whole in one task, its rows in a row."""

    def run(batches):
        import pyarrow as pa

        def flush(classes, texts):
            sets = shingle_sets(pa.array(texts, pa.large_string()), n)
            label, _ = _components(sets, permille, np.arange(len(sets)), np.arange(len(sets)))
            names = np.array(classes, np.int64)
            least = np.full(len(sets), np.iinfo(np.int64).max)
            np.minimum.at(least, label, names)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(least[label])], names=["class", "component"])

        held, classes, texts = None, [], []
        for batch in batches:
            for cluster, name, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cluster != held and classes:
                    yield flush(classes, texts)
                    classes, texts = [], []
                held = cluster
                classes.append(name)
                texts.append(body)
        if classes:
            yield flush(classes, texts)

    dealt = members.select("cluster", "class", "body").repartition("cluster").sortWithinPartitions("cluster", "class")
    return dealt.mapInArrow(run, "class bigint, component bigint")


def _large_links(members: DataFrame, degree: DataFrame, n: int, permille: int) -> DataFrame:
    """Links (a, b) that join all components of clusters of more than `BLOCK` classes."""
    import pyarrow as pa

    def hashed(rows):
        return {"cluster": rows.column("cluster"), "class": rows.column("class"), "hashes": [s.tobytes() for s in shingle_sets(rows.column("body"), n)]}

    members = stored(map_steps(members, "body", "cluster bigint, class bigint, hashes binary", lambda: hashed), "members")
    # The class that is in most groups stands in the middle of its cluster, and most others are linked to it.
    weighed = members.join(degree, "class")
    middle = weighed.groupBy("cluster").agg(F.max_by(F.struct("class", "hashes"), F.struct("degree", "class")).alias("middle"))
    beside = members.join(middle.select("cluster", F.col("middle.class").alias("pivot"), F.col("middle.hashes").alias("pivot_set")), "cluster")

    def meet(batches):
        for batch in batches:
            near = []
            for raw, pivot in zip(batch.column("hashes"), batch.column("pivot_set"), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (raw, pivot))
                both = int(np.isin(u, v, assume_unique=True).sum())
                near.append(1000 * both >= permille * (len(u) + len(v) - both))
            kept = [batch.column(c) for c in ("cluster", "class", "pivot", "hashes")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(near, pa.bool_())], names=["cluster", "class", "pivot", "hashes", "near"])

    met = stored(beside.mapInArrow(meet, "cluster bigint, class bigint, pivot bigint, hashes binary, near boolean"), "met")
    sizes = met.groupBy("cluster").agg(F.count("*").alias("all"), F.sum(F.when(F.col("near"), 0).otherwise(1)).alias("far"))
    sizes = stored(sizes.where("far > 0").select("cluster", F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil(F.col("far") / ASKING).alias("asks")), "sizes")
    dealt = met.join(sizes, "cluster")
    spread = F.pmod(F.xxhash64("class"), F.col("blocks")), F.pmod(F.xxhash64("class", F.lit(1)), F.col("asks"))
    far, every = F.expr("explode(sequence(0L, blocks - 1))"), F.expr("explode(sequence(0L, asks - 1))")
    asked = dealt.select("cluster", "class", "hashes", "near", spread[0].alias("block"), every.alias("ask"))
    asking = dealt.where(~F.col("near")).select("cluster", "class", "hashes", spread[1].alias("ask"), far.alias("block"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        first, second = left.column("class").to_pylist(), right.column("class").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in left.column("hashes").to_pylist() + right.column("hashes").to_pylist()]
        names, label = first + second, np.arange(len(sets))
        # Copies of one class on both sides bear one label, and so do all that are linked to the middle.
        place = {name: i for i, name in enumerate(first)}
        for j, (name, near) in enumerate(zip(second, right.column("near").to_pylist(), strict=True)):
            label[len(first) + j] = place.get(name, -1 if near else len(first) + j)
        _, joins = _components(sets, permille, np.arange(len(first)), label) if first and second else (None, [])
        return pa.table({"a": pa.array([names[i] for i, _ in joins], pa.int64()), "b": pa.array([names[j] for _, j in joins], pa.int64())})

    keys = ["cluster", "block", "ask"]
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])
    found = asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(compare, "a bigint, b bigint")
    return found.unionByName(met.where("near and class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b")))


def join(docs: DataFrame, n: int = 3, permille: int = 900, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) per row of `docs`; a component's id is its smallest key.

    Two texts are linked when their sets' Jaccard similarity is at least `permille` thousandths.
    """
    rows = stored(_hashed(docs, key, text, n), "sets").withColumnRenamed(key, "id").withColumn("class", _class())
    filled = rows.where("n_shingles > 0 and id is not null")
    owner = F.col("low").bitwiseAND(F.lit(0xFFFFFFFF)).alias("owner")
    classes = filled.select("class", "id", owner, "n_shingles", "sketch").groupBy("class").agg(F.min("id").alias("least"), *(F.first(c).alias(c) for c in ("owner", "n_shingles", "sketch")))
    classes = stored(classes, "classes")
    shingles = filled.agg(F.sum("n_shingles")).first()[0] or 0
    groups = stored(_groups(docs.where(F.col(key).isNotNull()), text, n, permille, shingles // DEALT + 1), "groups")
    near = stored(_sieved(groups, classes, permille), "near")
    clusters = stored(connected(near).select(F.col("node").alias("class"), F.col("component").alias("cluster")), "clusters")
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    # The texts of the classes in clusters, one of each: that of its smallest key, read again.
    wanted = stored(classes.join(clusters.select("class"), "class", "left_semi").select(F.col("least").alias(key)).distinct(), "wanted")
    likely = maybe_in(docs.select(key, text), wanted, key).where("maybe").drop("maybe")
    texts = _texts(likely.join(wanted, key, "left_semi"), text, n).groupBy("class").agg(F.first("body").alias("body"))
    members = stored(texts.join(clusters.join(size, "cluster"), "class"), "members")
    component = _small_clusters(members.where(f"size <= {BLOCK}"), n, permille)
    if not size.where(f"size > {BLOCK}").isEmpty():
        degree = groups.join(classes.select("owner", "class"), "owner").groupBy("class").agg(F.count("*").alias("degree"))
        links = stored(_large_links(members.where(f"size > {BLOCK}").drop("size"), degree, n, permille), "links")
        component = component.unionByName(connected(links).select(F.col("node").alias("class"), "component"))
    component = stored(component, "component")
    # A component's name is the smallest key of all its rows.
    named = classes.select("class", "least").join(component, "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    member = stored(named.join(names, "component").select("class", "component_id"), "components")
    joined = rows.select("id", "n_shingles", "class").join(member, "class", "left")
    own = F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    return joined.select(F.col("id").alias(key), "n_shingles", own.alias("component_id"))
