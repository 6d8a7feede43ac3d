"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is expected the same number of times: its source's
target by its source's size.  The whole part is copied outright.  The fractional parts
are rounded in two steps.  Rows of one source, doc_id and size are one unit, whose
rows share its copies.  First each class of documents of like size gets a whole
number of copies, from the largest down, and the words that a class takes too many or too
few are spread over the smaller ones.  Then the documents of a class are rounded by the
pivotal method: the probability held over from the units before meets the next
unit's, and mass moves at random from one to the other until one of the two is 0
or 1; the order of the units and the coins come from independent hashes.  This is done in blocks, then for the blocks' residuals in blocks again, and
so on, a tree whose top is 0 or 1.

DataFrame functions only.  Defined cases: a null source comes last by code point; a null
text has no words; a source without words takes nothing; repeated rows have copies
of their own; an empty table gives no rows; very long texts are units like any other;
other columns, whatever their names, are kept by `mixed_documents` and left out by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casframe.llm.common import cut, join_by_count, whole_rows

WEIGHTS = (5, 2, 1)
#: Words taken of all words, and the most that a source or document is repeated.
SHARE, MOST = 1.5, 2.0
#: Units that are rounded together, and the seed of the random numbers.
BLOCK, SEED = 64, 11
#: Sizes of a class lie within a factor of e ** (1 / CLASSES_PER_E).
CLASSES_PER_E = 8


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """The sources with rank, from 0, by code point and null last; ranks are counted within ranges of the order."""
    order = F.col("source").asc_nulls_last()
    parted = cut(sources.repartitionByRange(max(1, sources.sparkSession.sparkContext.defaultParallelism), order).withColumn("part", F.spark_partition_id()))
    starts, at = [], 0
    for r in sorted(parted.groupBy("part").count().collect()):  # one row for each range
        starts.append((r["part"], at))
        at += r["count"]
    first = F.broadcast(sources.sparkSession.createDataFrame(starts, "part int, first long"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parted.withColumn("rank", within).join(first, "part").withColumn("rank", F.col("rank") + F.col("first")).drop("part", "first")


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size and target of every source of (source, size).

    Sources above their cap get it and the others share what is left, again and again until
    none is above; each round is one sum over the sources.
    """
    sources = ranked(units.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    rows = cut(sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    everything = float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("weight")
        n, caps, left = rows.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not left:
            break
        level, capped = (everything - caps) / left, n
    return rows.select("source", "source_size", F.least("cap", F.lit(float(level or 0.0)) * F.col("weight")).alias("target"))


def uniform(*columns: Column | str) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(SEED)), 11).cast("double") / F.lit(float(1 << 53))


#: Over items (p, u, coin) in order: ones has the places of those rounded to 1, c and p the residual.
_PIVOT = """
aggregate(sequence(0, size(items) - 1),
  named_struct('c', -1, 'p', 0D, 'ones', cast(array() AS array<int>)),
  (s, i) -> CASE
    WHEN items[i].p <= 1e-12 THEN s
    WHEN s.p <= 1e-12 THEN named_struct('c', i, 'p', items[i].p, 'ones', s.ones)
    WHEN s.p + items[i].p < 1 - 1e-12 THEN named_struct('c', IF(items[i].coin * (s.p + items[i].p) < s.p, s.c, i), 'p', s.p + items[i].p, 'ones', s.ones)
    WHEN items[i].coin * (2 - s.p - items[i].p) < 1 - items[i].p THEN named_struct('c', i, 'p', greatest(s.p + items[i].p - 1, 0D), 'ones', array_append(s.ones, s.c))
    ELSE named_struct('c', s.c, 'p', greatest(s.p + items[i].p - 1, 0D), 'ones', array_append(s.ones, i))
  END)
"""


def _round(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("r", F.expr(_PIVOT))


def _won(blocks: DataFrame, residual: Column) -> DataFrame:
    """The items of each block with whether they were rounded to 1; residual: whether the block's residual was."""
    won = F.transform("items", lambda x, i: F.struct(x.alias("item"), (F.array_contains("r.ones", i) | (residual & (F.col("r.c") == i))).alias("won")))
    return blocks.select("source", F.explode(won).alias("e")).select("source", "e.item.*", "e.won")


def class_copies(units: DataFrame, targets: DataFrame) -> DataFrame:
    """s, k, n, copies: the number of documents of source s and class k, and how many of them get a further copy.

    copies is a random rounding of the class's share, less what the larger classes are off
    by, in words, spread over all words not yet decided.
    """
    classes = units.groupBy("source", "class").agg(F.sum("m").alias("n"), F.sum(F.col("size") * F.col("m")).alias("words"))
    item = F.struct((-F.col("class")).alias("order"), F.col("class").alias("k"), "n", "words", uniform("source", "class", F.lit(-1)).alias("u"))
    rows = classes.groupBy("source").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("s"))).withColumn("part", F.col("rate") - F.floor("rate"))

    def step(s: Column, x: Column) -> Column:
        rate = F.when(s["left"] > 0, F.col("part") - s["off"] / s["left"]).otherwise(F.col("part"))
        share = x["n"] * F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate))
        copies = F.least(x["n"], (F.floor(share) + (x["u"] < share - F.floor(share)).cast("int")).cast("long"))
        return F.struct(
            (s["off"] + (copies - x["n"] * F.col("part")) * (x["words"] / x["n"])).alias("off"),
            (s["left"] - x["words"]).alias("left"),
            F.array_append(s["done"], F.struct(x["k"].alias("k"), x["n"].alias("n"), copies.alias("copies"))).alias("done"),
        )

    start = F.struct(F.lit(0.0).alias("off"), F.col("source_size").alias("left"), F.array().cast("array<struct<k:int,n:bigint,copies:bigint>>").alias("done"))
    return rows.select("s", "source_size", "target", "rate", F.explode(F.aggregate("items", start, step)["done"]).alias("e")).select("s", "source_size", "target", "rate", "e.*")


def rounded(units: DataFrame, classes: DataFrame) -> DataFrame:
    """units (source, class, key, size, m) with their class's columns and more: how many of their m rows get a further copy.

    A unit of m rows is certain of the whole part of what its rows expect; the rest is rounded.
    """
    classes = classes.withColumn("class", F.col("k"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    name = lambda source: F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    rows = join_by_count(units.withColumn("__source", name(F.col("source"))), classes.withColumn("__source", name(F.col("s"))).drop("s", "k"), ["__source", "class"], "n", total)
    expected = F.col("m") * F.col("copies") / F.col("n")
    sure = F.floor(expected + 1e-9)
    place = (F.xxhash64("key", "size", F.lit(SEED)), uniform("key", "size", F.lit(0)), uniform("key", "size", F.lit(1)))
    item = F.struct(F.greatest(expected - sure, F.lit(0.0)).alias("p"), place[1].alias("u"), place[2].alias("coin"), "key", "size", "m", sure.alias("sure"), "source_size", "target", "rate")
    first = rows.select("source", "class", F.pmod(place[0], F.ceil(F.col("n") / BLOCK)).alias("block"), item.alias("item"))
    levels = [cut(_round(first.groupBy("source", "class", "block").agg(F.array_sort(F.collect_list("item")).alias("items"))))]
    most = classes.agg(F.max(F.ceil(F.col("n") / BLOCK))).first()[0] or 1
    while most > 1:
        number = ("source", "class", "block")
        item = F.struct(F.col("r.p").alias("p"), uniform(*number, F.lit(2 * len(levels))).alias("u"), uniform(*number, F.lit(2 * len(levels) + 1)).alias("coin"), "class", "block")
        above = levels[-1].where("r.c >= 0").select("source", "class", F.floor(F.col("block") / BLOCK).alias("block"), item.alias("item")).groupBy("source", "class", "block")
        levels.append(cut(_round(above.agg(F.array_sort(F.collect_list("item")).alias("items")))))
        most = -(-most // BLOCK)
    # Down again.  A class has whole copies, so what is left at its top is 0 or 1 but for the last digits.
    won = _won(levels[-1], F.col("r.p") > 0.5)
    for blocks in levels[-2::-1]:
        hit = won.where("won").select(F.col("source").alias("s"), F.col("class").alias("k"), F.col("block").alias("b"))
        joined = blocks.join(hit, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k")) & (F.col("block") == F.col("b")), "left")
        won = _won(joined, F.col("b").isNotNull())
    return won.withColumn("more", (F.col("sure") + F.col("won").cast("int")).cast("long"))


def units_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and m, the number of such rows."""
    return cut(docs.select("doc_id", "source", n_words().alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")))


#: Rows of one unit that are listed at a time.
_LISTED = 4096


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and copies."""
    units = units_of(docs)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    targets = source_targets(units.select("source", (F.col("size") * F.col("m")).alias("size")), weights, share, most).withColumnRenamed("source", "s").withColumn("rate", rate)
    rows = units.select("source", F.floor(F.log(F.col("size") + 1) * CLASSES_PER_E).cast("int").alias("class"), F.col("doc_id").alias("key"), "size", "m")
    found = rounded(rows, cut(class_copies(rows, targets)))
    # A row for each of a unit's rows; the first ones get the further copies.
    found = found.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"), F.lit(_LISTED).cast("long"))))
    found = found.withColumn("nth", F.explode(F.sequence(F.col("from"), F.least(F.col("m"), F.col("from") + _LISTED - 1))))
    copies = (F.floor("rate") + (F.col("nth") <= F.col("more")).cast("int")).cast("long")
    return found.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, with its columns.

    Rows of one doc_id and size share the copies of these: each row takes those of its own rank, which
    for rows that do repeat is found within their partition of the join.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    copies = cut(verdicts.withColumn("__key", key).groupBy("__key").agg(F.sum("copies").alias("__sum"), F.count("*").alias("__rows")))
    rows = docs.select(whole_rows(docs).alias("__whole"), "doc_id", n_words().alias("size")).select("__whole", key.alias("__key"))
    rows = join_by_count(rows, copies, ["__key"], "__rows", copies.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]).where("__sum > 0")
    single = rows.where("__rows = 1").select("__whole", "__sum")
    rank = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0))) - 1
    repeated = rows.where("__rows > 1").withColumn("__rank", rank)
    repeated = repeated.select("__whole", (F.floor(F.col("__sum") / F.col("__rows")) + (F.col("__rank") < F.pmod("__sum", "__rows")).cast("int")).alias("__sum"))
    rows = single.unionByName(repeated).where("__sum > 0")
    return rows.select("__whole", F.explode(F.sequence(F.lit(1), F.col("__sum").cast("int")))).select("__whole.*")
