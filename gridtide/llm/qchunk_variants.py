"""Operator 13: spelling variants grouped by asymmetric q-chunks.

Words are maximal runs of `LETTERS`, A-Z lower-cased. Two words are near if exactly one inserted, deleted or replaced code
point lies between them. Of a pair, the shorter word (of equal ones the smaller) contributes two disjoint chunks, its
halves; the other contributes its positional grams of the halves' lengths. One edit leaves one half as it is, at its place
or one further on, so the pair meets in a join on (chunk, place, length) with a shift of at most one: grams at other places
can't meet a chunk and aren't made. Every candidate is verified by its edit distance.

Many words share a half, so groups of a chunk may be large. A group of more than `CROWD` candidate pairs is not joined: the
same rule is applied to what the chunk leaves open, whose halves are two chunks again, until the groups are small or one
code point is open (then nearly every candidate is near, and an alphabet bounds their number). Each pair is taken in
one window only: the one where its first difference lies. Every level is a few joins over the vocabulary's table; their
number grows with the logarithm of the longest word.

Null and empty texts have no words. Repeated rows count as often as they stand there, a null key counts as empty text. Only
the two columns named are read, so others may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.llm.common import stored

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Candidate pairs of one group that are compared at once; more of them are split further.
CROWD = 1024
WINDOW = ("size", "lo", "hi")


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = 31, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): the words of at least `min_length` code points that occur at least `min_count` times.

    Of a run whose crc32 with its document's key is divisible by `noise`, one code point is left out.
    """
    run = F.col("run")
    # Runs of ASCII alone have as many bytes as signs; for them `lower` is the same and quicker.
    lowered = F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))
    mark = F.crc32(F.concat(F.coalesce(F.col("key"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    place = (F.col("mark") % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), place), F.substr(run, place + 2))
    runs = docs.select(F.col(key).cast("string").alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    marked = runs.withColumn("run", lowered).withColumn("mark", mark)
    made = marked.select(F.when(F.col("mark") % noise == 0, shorter).otherwise(run).alias("word"))
    return made.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _chunk() -> Column:
    """What a word has before and behind its open window; words that agree in it share a number."""
    shift = F.char_length("word") - F.col("size")
    before, behind = F.substring("word", F.lit(1), F.col("lo")), F.substr(F.col("word"), F.col("hi") + 1 + shift)
    return F.xxhash64("size", "lo", "hi", before, behind)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first half of its window open, so that the second is the chunk, and the other way round."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    parts = F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))
    # A window of one code point stays whole.
    halves = F.explode(F.when(F.col("hi") - F.col("lo") > 1, parts).otherwise(F.array(F.struct("lo", "hi"))))
    return rows.select("word", "n", "chunks", "size", halves.alias("w")).select("word", "n", "chunks", "size", "w.lo", "w.hi").withColumn("chunk", _chunk())


def _roles(words: DataFrame, min_length: int) -> DataFrame:
    """Each word as the one that gives chunks, and as the one that gives grams for words as long and one shorter."""
    length = F.char_length("word")
    roles = F.array(F.struct(F.lit(True).alias("chunks"), length.alias("size")), F.struct(F.lit(False).alias("chunks"), length.alias("size")), F.struct(F.lit(False).alias("chunks"), (length - 1).alias("size")))
    rows = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.chunks", "r.size")
    return rows.where(F.col("size") >= min_length).select("*", F.lit(0).alias("lo"), F.col("size").alias("hi"))


def near_pairs(words: DataFrame, min_length: int = 1, crowd: int = CROWD) -> DataFrame:
    """(a, n_a, b, n_b): every unordered pair of near words once; `words` is (word, n), its words distinct."""
    found, rows = None, _halves(_roles(words, min_length))
    while True:
        rows = stored(rows, "chunks")
        sizes = rows.groupBy("chunk").agg(F.count_if("chunks").alias("left"), F.count_if(~F.col("chunks")).alias("right"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        groups = stored(sizes.where("left > 0 and right > 0").select("chunk", ((F.col("left") * F.col("right") > crowd) & (F.col("open") > 1)).alias("crowded")), "groups")
        pairs = _join(rows.join(groups.where("not crowded").select("chunk"), "chunk", "left_semi"))
        found = pairs if found is None else found.unionByName(pairs)
        crowded = groups.where("crowded").select("chunk")
        if crowded.isEmpty():
            return found
        rows = _halves(rows.join(crowded, "chunk", "left_semi"))


def _join(rows: DataFrame) -> DataFrame:
    """Chunks against grams, with the exact comparison of what meets."""
    left = rows.where("chunks").select("chunk", *WINDOW, F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = rows.where("not chunks").select("chunk", F.col("word").alias("b"), F.col("n").alias("n_b"))
    span = F.col("hi") - F.col("lo")
    met = left.join(right, "chunk").where((F.char_length("b") > F.char_length("a")) | (F.col("a") < F.col("b")))
    # The first difference lies in this window; behind the last code point it belongs to the last window.
    here = (F.substring("a", F.lit(1), F.col("lo")) == F.substring("b", F.lit(1), F.col("lo"))) & (
        (F.col("hi") == F.col("size")) | (F.substring("a", F.col("lo") + 1, span) != F.substring("b", F.col("lo") + 1, span))
    )
    return met.where(here & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def group(words: DataFrame, ratio: int = 10, min_length: int = 1) -> DataFrame:
    """(word, n, n_near, form, form_n, root): a word's form is its commonest near word, if `ratio` times as frequent or more.

    Of equally frequent near words the first in code-point order is taken. Forms grow by `ratio` from step to step, so there
    is no circle; roots are found by doubling the steps taken.
    """
    pairs = near_pairs(words, min_length)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p")).select("p.*")
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("bigint").alias("near_n"))
    commoner = F.when(F.col("near_n") >= ratio * F.col("n"), F.struct((-F.col("near_n")).alias("rank"), "near"))
    facts = both.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), F.min(commoner).alias("best"))
    rows = stored(facts.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.rank")).alias("form_n")), "forms")
    roots = _roots(rows.where("form is not null").select("word", F.col("form").alias("root")))
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(steps: DataFrame) -> DataFrame:
    steps = stored(steps, "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("far"))
        longer = stored(steps.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return steps
