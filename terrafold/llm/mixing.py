"""Operator 7: mixing sources to target weights, in DataFrame functions alone.

Every row gets a hash-random key. A source is sorted by ranges of the key, sums over ranges are carried forward, and the
source is cut where its running number of words reaches what its budget leaves after whole epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, fresh

#: Weights by a source's place in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST = 3
#: A source's keys fall into 16 ** RANGE_DIGITS ranges, each summed and sorted on its own.
RANGE_DIGITS = 3
SEED = "mix"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def random_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """The hash of doc_id, or of the text where there is none, so that rows without an id spread too."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.md5(F.concat(F.lit(seed + ":"), own).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (src, source_size; one row a source) with target and budget.

    The sources share the total of all sizes by weight. One that would get more than `most` times its size gets that,
    and the rest is shared anew. In ascending order of most * size / weight, a source is held at its most when its share
    of what the sources before it leave reaches that. The table has a row a source, so its windows are small.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy("src")) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    w = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    w = w.withColumn("total", F.sum("source_size").over(every).cast("double"))
    w = w.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("held", F.col("cap") <= F.col("left") * F.col("weight") / F.sum("weight").over(after))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("held"), F.col("cap"))).over(every), F.lit(0.0))
    free = F.sum(F.when(~F.col("held"), F.col("weight"))).over(every)
    target = F.when(F.col("held"), F.col("cap")).otherwise(rest * F.col("weight") / free)
    return w.select("src", "source_size", target.alias("target")).withColumn("budget", F.floor("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; with carry, the whole row as `row` too.

    taken counts the words that the mix takes of the row: its size in each whole epoch, and in the last epoch what lies
    before the cut, so a source's taken words add up to the floor of its target. Nulls: a null text has no words, a null
    source is a source, the key of a null doc_id comes from the text. Equal keys are ordered by doc_id, size and, with carry, text;
    repeated rows are taken one after another. An empty table gives an empty one.
    """
    key = random_key(F.col("doc_id"), F.col("text"), seed)
    rows = docs.select(
        "doc_id", size_of(F.col("text")).alias("size"), source_key(F.col("source")).alias("src"), key.alias("key"), F.substring(key, 1, RANGE_DIGITS).alias("range"),
        *([F.struct(*docs.columns).alias("row")] if carry else []),
    )
    narrow = rows if carry else checkpointed(rows)
    ranges = checkpointed((rows.drop("row") if carry else narrow).groupBy("src", "range").agg(F.sum("size").alias("in_range")))
    plan = targets(ranges.groupBy("src").agg(F.sum("in_range").alias("source_size")), weights, most)
    offset = F.sum("in_range").over(Window.partitionBy("src").orderBy("range")) - F.col("in_range")
    starts = ranges.select("src", "range", offset.alias("offset")).join(plan, "src")
    order = ["key", "doc_id", "size", *(["row.text"] if carry else [])]
    within = Window.partitionBy("src", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = narrow.withColumn("upto", F.sum("size").over(within)).join(starts, ["src", "range"])
    start = F.col("offset") + F.col("upto") - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("budget") - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"), *(["row"] if carry else []))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of the mix with the columns of docs: a row for each whole epoch and, where a source is cut inside a
    document, one more with its first words. Rows without a word are never taken."""
    got = mixed(docs, weights, most, seed, carry=True)
    times = F.ceil(F.col("taken") / F.when(F.col("size") > 0, F.col("size"))).cast("int")
    got = got.where(F.col("taken") > 0).withColumn("turn", F.explode(F.sequence(F.lit(1), times)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("turn") - 1) * F.col("size")).cast("int")
    text = F.col("row.text")
    lead = F.when(F.regexp_like(text, F.lit(r"\A[\x20\x09-\x0D]")), 1).otherwise(0)
    parts = F.split(text, r"[\x20\x09-\x0D]+", words + lead + 1)
    left = F.length(text) - F.length(F.element_at(parts, -1))
    start = F.regexp_replace(F.substring(text, F.lit(1), left), r"[\x20\x09-\x0D]+\z", "")
    cut = F.when(words < F.col("size"), start).otherwise(text)
    name = {c: F.col("row").getField(c) for c in docs.columns}
    return got.select(*[(cut if c == "text" else name[c]).alias(c) for c in docs.columns])
