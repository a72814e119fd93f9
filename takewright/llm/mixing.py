"""Mixing sources to target weights by capped water-filling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Column, epochs: int, share: float = 1.0) -> DataFrame:
    """Add ``target`` to a table (source, ord, source_size): what each source gives to a mix of ``share`` times all sizes.

    A source gets its weight's part, but ``epochs`` times its size at most; what it cannot take goes to the others by weight,
    until none is above.  That fixed point is found in one ordered pass: sources reach their caps in the order of cap / weight,
    so those before the first that stays below are at their caps, and the rest divide what is left.  The table has one row per
    source, whatever the number of documents, and these rows alone meet in one task.
    """
    everywhere = Window.orderBy("fills_at", "ord")
    before = everywhere.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = sizes.withColumn("weight", weights.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    x = x.withColumn("fills_at", F.col("cap").cast("double") / F.col("weight"))
    x = x.withColumn("total", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    x = x.withColumn("left", F.col("total") * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    x = x.withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    x = x.withColumn("below", F.col("left") * F.col("weight") / F.col("left_weight") < F.col("cap"))
    first = F.min(F.when(F.col("below"), F.struct("fills_at", "ord", "left", "left_weight"))).over(whole)
    x = x.withColumn("first", first)
    rest = F.struct("fills_at", "ord") >= F.struct(F.col("first.fills_at"), F.col("first.ord"))
    return x.withColumn("target", F.when(rest, F.col("first.left") * F.col("weight") / F.col("first.left_weight")).otherwise(F.col("cap").cast("double")))


def order_key(seed: int) -> Column:
    """The seeded order of documents: hex digits by doc_id, equal for rows of one doc_id."""
    return F.md5(F.concat(F.lit(f"mix:{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def narrow(docs: DataFrame, seed: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), order_key(seed).alias("key"))
    return common.stash(rows, "sizes")


def planned(rows: DataFrame, pattern: tuple[int, ...], epochs: int, share: float, bucket_rows: int = 1 << 20) -> DataFrame:
    """One row per source: ``source_size``, ``target``, ``whole`` repetitions, and ``last``: documents up to this key are taken once more.

    Keys are summed in buckets of their first digits, so many that a bucket has about ``bucket_rows`` rows at most; only the bucket in which the
    fraction ends is put in order.
    """
    n, digits = rows.count(), 3
    while 16**digits * bucket_rows < n:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    buckets = common.stash(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sources = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = sources.withColumn("ord", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    weight = F.element_at(F.array(*map(F.lit, pattern)), ((F.col("ord") - 1) % len(pattern) + 1).cast("int"))
    sources = targets(sources, weight, epochs, share)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(ratio)).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = common.stash(sources.select("source", "source_size", "target", "whole", "extra"), "sources")

    of_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("words").over(of_source), F.lit(0)))
    over = buckets.alias("b").join(few(sources).alias("s"), F.expr("b.source <=> s.source and before + words > extra"))
    cut = common.stash(over.groupBy("b.source").agg(F.min(F.struct("bucket", "before", "extra")).alias("x")).select("source", "x.*"), "cut")
    inside = rows.alias("r").join(few(cut).alias("c"), F.expr("r.source <=> c.source and r.bucket = c.bucket")).select("r.source", "key", "size", "before", "extra")
    upto = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(upto)).where("upto <= extra").groupBy("source").agg(F.max("key").alias("last"))
    # a bucket's digits alone come before all keys in it; without a cut all are taken, and no key begins with g
    last = F.coalesce("i.last", "c.bucket", F.lit("g")).alias("last")
    ended = sources.alias("s").join(cut.alias("c"), F.expr("s.source <=> c.source"), "left").join(inside.alias("i"), F.expr("s.source <=> i.source"), "left")
    return common.stash(ended.select("s.source", "source_size", "target", "whole", last), "plan")


def few(table: DataFrame) -> DataFrame:
    """To be sent to every task where it has no more rows than ``common.BROADCAST_ROWS``; a larger one is joined as any other."""
    return F.broadcast(table) if table.count() <= common.BROADCAST_ROWS else table


def mix(docs: DataFrame, pattern: tuple[int, ...] = (5, 2, 1), epochs: int = 3, share: float = 1.0, seed: int = 0) -> DataFrame:
    """How often a mix takes each document: ``size``, ``source_size``, ``target``, ``repeats`` and ``taken`` (= size x repeats).

    Sources in code-point order, null last, weigh ``pattern``, repeating.  With r = target / source_size, every document is taken
    floor(r) times, and once more those that come first in a seeded order until they fill the fraction, so that a source's taken
    words miss its target by less than one document.  The order is that of md5(seed, doc_id); rows of one doc_id go together,
    or where their size would go beyond the target, not at all.  Documents meet the plan, of one row per source, where they lie: they are not shuffled.
    Null doc_id and null text are values like others (size 0); an empty table gives an empty result; other columns are ignored.
    """
    rows = narrow(docs, seed)
    plan = planned(rows, pattern, epochs, share)
    known = rows.alias("r").join(few(plan).alias("p"), F.expr("r.source <=> p.source"))
    repeats = F.col("whole") + (F.col("key") <= F.col("last")).cast("long")
    return known.select("doc_id", "r.source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))


def sample(docs: DataFrame, pattern: tuple[int, ...] = (5, 2, 1), epochs: int = 3, share: float = 1.0, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as ``mix`` takes it."""
    plan = few(planned(narrow(docs, seed), pattern, epochs, share))
    source, whole, last, times = (common.fresh(docs, f"mix_{x}") for x in ("source", "whole", "last", "times"))
    joined = docs.join(plan.select(F.col("source").alias(source), F.col("whole").alias(whole), F.col("last").alias(last)), F.col("source").cast("string").eqNullSafe(F.col(source)))
    repeats = F.col(whole) + (order_key(seed) <= F.col(last)).cast("long")
    return joined.withColumn(times, F.explode(F.array_repeat(F.lit(0), repeats.cast("int")))).select(*map(common.named, docs.columns))
