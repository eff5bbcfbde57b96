"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. DataFrame functions only.

The mix is a number of equal blocks: of BLOCK words, or of an eighth of the smallest target where that is less. Blocks
go to sources by the highest quotients target / (2 k - 1), and a source's blocks to its shards in the same way, so every
shard has an integer quota before anything is selected; the last block of a shard that has no more words is partial. A
shard is a seeded deal of its source's documents, about SHARD words of them; laid end to end in seeded order they are
a stream, of which the shard takes its quota of blocks from the start, going round again where the quota exceeds it.
Equal rows are one row with a number, so they are no load on one task; documents without words are in no shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millcheck.llm.common import WORD, cut

#: Words of a block at most, and blocks of the smallest target at least.
BLOCK, FINE = 64, 8
SHARD = 1_000_000
SEED = "mix-1"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target for each distinct source of sizes (source, size).

    Weights repeat over the sources by code point, null last. Raising one level for all, target = level * weight, until
    the targets share `share` of all sizes, each stopping at cap times its source, is the fixed point of resharing.
    A source stops earlier the lower its cap per weight, so the level comes from sums over that order. The windows
    without a key see a row per distinct source, never documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (nth % len(weights) + 1).cast("int"))
    s = by_source.select("source", "source_size", w.alias("w")).withColumn("top", cap * F.col("source_size"))
    order = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    upto, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(upto), F.lit(0.0))) / F.sum("w").over(rest)
    s = s.withColumn("level", level)
    # the first source in the order that does not stop gives the level; after it the sums fall
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("top"), F.col("level"))).over(everything))
    target = F.coalesce(F.least("top", F.col("level") * F.col("w")), F.col("top"))
    return s.select("source", "source_size", target.alias("target"))


def apportion(votes: DataFrame, group: list[str], seats: str, limit: str | None = None) -> DataFrame:
    """Adds quota (long): Sainte-Lague seats of each row of votes (columns v, tie, and group), n = the group's `seats`.

    Dividing by T / (n - rows / 2) gives no more than n seats in all, by T / (n + rows / 2) no fewer. What lies
    between is about two quotients a row, whatever n is: only these are made and ranked. limit: a column with the most
    seats a row may have; then seats over it are dealt again to rows that have room, lowest tie first.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy()
    x = votes.withColumn("t_", F.sum("v").over(g)).withColumn("c_", F.count("*").over(g))
    n = F.col(seats)
    seats_at = lambda rows: F.coalesce(F.floor(F.try_divide(F.col("v") * F.greatest(n + rows, F.lit(0.0)), F.col("t_")) + 0.5), F.lit(0)).cast("long")
    x = x.withColumn("lo_", F.greatest(seats_at(-F.col("c_") / 2 - 1), F.lit(0))).withColumn("hi_", F.when(F.col("v") > 0, seats_at(F.col("c_") / 2 + 1)).otherwise(0))
    x = x.withColumn("left_", n - F.sum("lo_").over(g))
    quotients = x.where("hi_ > lo_").select(*group, "tie", "v", "left_", F.explode(F.sequence(F.col("lo_") + 1, F.col("hi_"))).alias("k_"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy((F.col("v") / (2 * F.col("k_") - 1)).desc(), "tie"))
    won = quotients.withColumn("r_", rank).where("r_ <= left_").groupBy(*group, "tie").agg(F.count("*").alias("won_"))
    keys = [*group, "tie"]
    match = [F.col(f"x.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    on = match[0]
    for m in match[1:]:
        on = on & m
    x = x.alias("x").join(won.alias("w"), on, "left").select("x.*", (F.col("lo_") + F.coalesce("won_", F.lit(0))).alias("quota"))
    if limit:
        x = x.withColumn("over_", F.sum(F.greatest(F.col("quota") - F.col(limit), F.lit(0))).over(g))
        x = x.withColumn("room_", F.greatest(F.col(limit) - F.col("quota"), F.lit(0)))
        before = F.coalesce(F.sum("room_").over(Window.partitionBy(*group).orderBy("tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        more = F.greatest(F.least(F.col("room_"), F.col("over_") - before), F.lit(0))
        x = x.withColumn("quota", F.least(F.col("quota"), F.col(limit)) + more)
    return x.drop("t_", "c_", "lo_", "hi_", "left_", "over_", "room_")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, shard: int = SHARD, seed: str = SEED) -> DataFrame:
    """A row per row of docs: id_col, source, size, source_size, target, taken.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, a null id is dealt
    like an id. Repeated rows are rows of their own; which of equal rows is taken more changes nothing in the result.
    Other columns are not looked at; an empty table gives an empty result. taken is at most cap times size.
    """
    text = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null"))
    digest = F.md5(F.concat_ws(" ", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text))
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), digest.alias("order_"))
    # the texts are read once; all that follows needs their sizes only
    sizes = cut(sizes.groupBy("id", "source", "size", "order_").agg(F.count("*").alias("n")))
    targets = source_targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, cap)
    # equal blocks to sources
    every = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    votes = targets.withColumn("v", F.col("target")).withColumn("tie", F.coalesce("source", F.lit("\U0010ffff")))
    votes = votes.withColumn("block", F.greatest(F.least(F.floor(least / FINE), F.lit(block)), F.lit(1)).cast("long"))
    votes = votes.withColumn("all_", F.floor(F.sum("target").over(every) / F.col("block") + 0.5))
    quotas = apportion(votes, [], "all_").select("source", "source_size", "target", "block", F.col("quota").alias("blocks"), F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1)).alias("shards"))
    same = F.col("d.source").eqNullSafe(F.col("q.source"))
    dealt = sizes.alias("d").join(quotas.alias("q"), same).select("d.id", "d.source", "d.size", "d.order_", "d.n", "q.source_size", "q.target", "q.block", "q.blocks", "q.shards")
    empty = dealt.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    dealt = dealt.where("size > 0").withColumn("shard", F.conv(F.substring("order_", 1, 8), 16, 10).cast("long") % F.col("shards"))
    # equal blocks of a source to its shards
    per_shard = dealt.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("shard_size"), F.max("blocks").alias("blocks"), F.max("block").alias("block"))
    per_shard = per_shard.withColumn("v", F.col("shard_size").cast("double")).withColumn("tie", F.col("shard")).withColumn("most", F.ceil(cap * F.col("shard_size") / F.col("block")))
    per_shard = apportion(per_shard, ["source"], "blocks", "most")
    words = F.least(F.col("quota") * F.col("block"), F.floor(cap * F.col("shard_size"))).cast("long")
    per_shard = per_shard.select("source", "shard", "shard_size", words.alias("words"))
    on = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.shard") == F.col("s.shard"))
    x = dealt.alias("d").join(per_shard.alias("s"), on).select("d.*", "s.shard_size", "s.words")
    stream = Window.partitionBy("source", "shard").orderBy("order_", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("before", F.sum(F.col("size") * F.col("n")).over(stream) - F.col("size") * F.col("n"))
    rounds = F.floor(F.col("words") / F.col("shard_size")).cast("long")
    x = x.withColumn("rounds", rounds).withColumn("part", F.col("words") - F.col("rounds") * F.col("shard_size") - F.col("before"))
    part = F.greatest(F.least(F.col("part") - F.col("i") * F.col("size"), F.col("size")), F.lit(0))
    x = x.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("taken", (F.col("rounds") * F.col("size") + part).cast("long"))
    empty = empty.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    out = [F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken"]
    return x.select(*out).union(empty.select(*out))
