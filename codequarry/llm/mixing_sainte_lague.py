"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Sources get targets in words by weight; no target is above ``ceiling`` times its
source's size, and what is above is shared again by weight.  Targets are cut into
blocks of equal size.  The blocks are seats: they go to sources by the highest
quotients target / (2k + 1), and each source's seats go to its shards by the
highest quotients of shard sizes, which gives every shard an integer quota.
Documents of a shard stand in seeded order; a quota of all blocks is a whole
pass, and the rest is a run of blocks from a seeded start, around the end.  A
document is cut only where a run begins or ends.

Shards hold about ``rows_per_shard`` documents, so that a source with a third of
all rows is spread like the others, and a source has at most ``most_shards``
(beyond that shards grow; a shard's running sum spills to disk).  Only tables of
sources and shards are ever ranked as a whole.

Defined results: null text has size 0 and takes nothing; null is a source of its
own, last in order; sources with no words have target 0; repeated rows are
separate documents, and rows without a number are told apart by their place;
``mixed_texts`` gives one row for each copy, and a cut part is the text between
its first and last word with white space and line breaks as they were; an empty
table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import SPACE_CLASS, WORD_PATTERN, fresh, materialise, numbered

#: A table of sources up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000


def seeded(seed: int, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def _number(md5: Column) -> Column:
    return F.conv(F.substring(md5, 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Adds rank, weight and target to (source, rows, source_size).

    With sources in order of ceiling / weight, the water level after k capped
    ones rises while they are rightly capped and falls from then on, so that the
    highest level is the one at which nothing is above its ceiling.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    full = ranked.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = full.withColumn("level_here", left / heavy).withColumn("level", F.max("level_here").over(every))
    return level.withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).drop("level", "level_here", "cap")


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str, order: str) -> DataFrame:
    """Adds ``quota``: the seats of each party by highest quotients votes / (2k + 1).

    Rounding the exact shares gives all but a few seats; the rest, at most one
    for every two parties, is given or taken by comparing the quotients next in
    line, of which each party shows as many as its share of the rest could need.
    """
    whole = Window.partitionBy(*[F.col(g) for g in group]) if group else Window.partitionBy(F.lit(0))
    part = F.col(votes) / F.sum(votes).over(whole)
    based = parties.withColumn("__part", F.when(F.sum(votes).over(whole) > 0, part).otherwise(0.0))
    based = based.withColumn("__base", F.floor(F.col(seats) * F.col("__part") + 0.5).cast("long"))
    live = F.max(F.col("__part")).over(whole) > 0
    based = based.withColumn("__rest", F.when(live, F.col(seats) - F.sum("__base").over(whole)).otherwise(0))
    shown = F.ceil(F.col("__part") * F.abs("__rest")).cast("int") + 2
    steps = F.when((F.col("__rest") == 0) | (F.col("__part") == 0), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), shown))
    k = F.when(F.col("__rest") > 0, F.col("__base") + F.col("__step")).otherwise(F.col("__base") - F.col("__step") - 1)
    tried = based.select("*", F.explode_outer(steps).alias("__step")).withColumn("__k", k)
    quotient = F.when(F.col("__step").isNotNull() & (F.col("__k") >= 0), F.col(votes) / (2 * F.col("__k") + 1))
    given = F.when(F.col("__rest") > 0, quotient)
    taken = F.when(F.col("__rest") < 0, quotient)
    tried = tried.withColumn("__place", F.row_number().over(whole.orderBy(given.desc_nulls_last(), taken.asc_nulls_last(), F.when(F.col("__rest") < 0, -F.col(order)).otherwise(F.col(order)))))
    won = F.when(quotient.isNotNull() & (F.col("__place") <= F.abs("__rest")), F.signum("__rest")).otherwise(0).cast("long")
    names = parties.columns
    return tried.withColumn("__won", won).groupBy(*[F.col(n) for n in names], "__base").agg(F.sum("__won").alias("__won")).select(*names, (F.col("__base") + F.col("__won")).alias("quota"))


def _plan(
    named: DataFrame, file: str, place: str, weights: tuple[int, ...], share: float, ceiling: float, seed: int, most_block: int, rows_per_shard: int, most_shards: int,
    id_column: str, text_column: str, source_column: str,
) -> DataFrame:
    """What ``mix`` returns, with the file and place of every row."""
    size = F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = materialise(named.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), size.alias("size"), F.col(file).alias("file"), F.col(place).alias("place")))
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    whole = Window.partitionBy(F.lit(0))
    named = targets(totals, weights, share, ceiling)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole)
    named = named.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(most_block), F.floor(least / 1000))), F.lit(1)).cast("long"))
    named = named.withColumn("all_seats", F.floor(F.sum("target").over(whole) / F.col("block") + 0.5).cast("long"))
    named = sainte_lague(named, [], "target", "all_seats", "rank").withColumnRenamed("quota", "seats")
    shards = F.least(F.lit(most_shards), F.greatest(F.lit(1), F.ceil(F.col("rows") / rows_per_shard))).cast("int")
    named = materialise(named.select("source", "rank", "source_size", "target", "block", "seats", shards.alias("shards")))
    side = F.broadcast(named) if named.count() <= BROADCAST_SOURCES else named
    placed = sized.alias("d").join(side.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).drop("source")
    placed = placed.withColumn("mixed", seeded(seed, F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(":", "file", "place")))).withColumn("shard", F.pmod(_number(F.col("mixed")), F.col("shards")).cast("int"))
    quotas = placed.groupBy("rank", "shard", "seats", "block").agg(F.sum("size").alias("shard_size"))
    quotas = sainte_lague(quotas, ["rank"], "shard_size", "seats", "shard").drop("seats", "block")
    inner = Window.partitionBy("rank", "shard")
    upto = inner.orderBy("mixed", "doc_id", "size", "file", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.withColumn("end", F.sum("size").over(upto)).join(quotas, ["rank", "shard"])
    rows = rows.withColumn("blocks", F.ceil(F.col("shard_size") / F.col("block")).cast("long"))
    rows = rows.withColumn("quota", F.least("quota", F.floor(F.lit(ceiling) * F.col("blocks")).cast("long")))
    some = F.greatest("blocks", F.lit(1))
    rows = rows.withColumn("passes", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / some)).otherwise(0).cast("long"))
    rows = rows.withColumn("run", F.col("quota") - F.col("passes") * F.col("blocks"))
    rows = rows.withColumn("first", F.pmod(_number(seeded(seed, F.lit("start"), "rank", "shard")), some))
    low = F.col("first") * F.col("block")
    high = F.least((F.col("first") + F.col("run")) * F.col("block"), F.col("shard_size"))
    around = F.greatest(F.lit(0), F.col("first") + F.col("run") - F.col("blocks")) * F.col("block")

    def inside(a: Column, b: Column) -> tuple[Column, Column]:
        """The part of [a, b) within the document, from the document's start."""
        start = F.col("end") - F.col("size")
        begin = F.least(F.greatest(a - start, F.lit(0)), F.col("size"))
        return begin, F.greatest(begin, F.least(F.greatest(b - start, F.lit(0)), F.col("size")))

    (a1, b1), (a2, b2) = inside(low, high), inside(F.lit(0), around)
    rows = rows.select("file", "place", "doc_id", "size", "source_size", "target", "passes", *[c.cast("long").alias(n) for n, c in (("from1", a1), ("to1", b1), ("from2", a2), ("to2", b2))])
    taken = F.col("passes") * F.col("size") + F.col("to1") - F.col("from1") + F.col("to2") - F.col("from2")
    return rows.withColumn("taken", taken.cast("long"))


def mix(
    documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 17,
    most_block: int = 1024, rows_per_shard: int = 2048, most_shards: int = 8192,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken, and how it is taken: ``passes`` whole
    ones and the word ranges [from1, to1) and [from2, to2).

    A block is a thousandth of the smallest target, ``most_block`` words at most.
    """
    rows = numbered(documents, "mix")
    return _plan(*rows, weights, share, ceiling, seed, most_block, rows_per_shard, most_shards, id_column, text_column, source_column).drop("file", "place")


def mixed_texts(
    documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 17,
    most_block: int = 1024, rows_per_shard: int = 2048, most_shards: int = 8192,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """The mix itself, with the columns of ``documents``: one row for each copy of a
    document and for each part of one.  Plans meet their rows by file and place.
    """
    named, file, place = numbered(documents, "mix")
    plan = _plan(named, file, place, weights, share, ceiling, seed, most_block, rows_per_shard, most_shards, id_column, text_column, source_column).where("taken > 0")
    ranges, piece = fresh(named, "ranges", "piece")
    span = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    whole = F.array_repeat(span(F.lit(0).cast("long"), F.col("size")), F.col("passes").cast("int"))
    cuts = F.filter(F.array(span(F.col("from1"), F.col("to1")), span(F.col("from2"), F.col("to2"))), lambda r: r["b"] > r["a"])
    plan = plan.select(F.col("file").alias(file), F.col("place").alias(place), F.concat(whole, cuts).alias(ranges), F.col("size").alias(piece))
    copies = named.join(plan, [file, place]).withColumn(ranges, F.explode(ranges))
    text, first, last = F.col(text_column).cast("string"), F.col(f"{ranges}.a"), F.col(f"{ranges}.b")
    words = F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN}{SPACE_CLASS}*)"), F.lit(1))  # each word with the white space behind it
    part = F.rtrim(F.array_join(F.slice(words, (first + 1).cast("int"), (last - first).cast("int")), ""), F.lit(" \t\n\x0b\x0c\r"))
    made = copies.withColumn(text_column, F.when((first == 0) & (last == F.col(piece)), text).otherwise(part))
    if "n_chars" in documents.columns:
        made = made.withColumn("n_chars", F.char_length(text_column).cast(dict(documents.dtypes)["n_chars"]))
    return made.select(*[F.col(f"`{c}`") for c in documents.columns])
