"""URL rules by cascades of Bloom filters, in DataFrame functions only.

A rule is a host and the start of a path.  It fits an address exactly if one of
the address's candidate keys (a suffix of its host at a dot, the first n
characters of its path for a length n that some rule has) is the rule's key.
The candidate keys of all addresses are the complete universe.  For each list,
allow and block, level 1 of the cascade encodes the listed keys, level 2 the
unlisted keys of the universe that level 1 lets through, level 3 the listed keys
that level 2 lets through, and so on until nothing passes wrongly.  A key is
listed exactly if the first level that rejects it is an even one.  Addresses are
judged by constants alone: no join, no lookup.

The first level's rate follows the proportion of listed keys in the universe, so
that the cascade's size follows the list and not the corpus.  Listed keys and
universe are dealt by hash into parts of about ``most_keys`` listed keys and
eight times as many keys at most, each with a cascade of its own, so that every filter
has the size it needs and every cascade ends, whatever the number of keys.  A
part is judged in one pass over the addresses; nearly always there is one.

If a key stands in both lists, block wins.  An address without a listed key is
allowed: that is the method's verdict, since it is certain to be on no list.

Defined results: a null address or one without "://" has an empty host and
path, no rule and the verdict allow; hosts and paths of any length are judged in
time in proportion to it, since only suffixes of as many labels, and starts of as
many characters, as some rule has are candidates; repeated rows are judged alike;
an empty table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm import bloom
from codequarry.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BETWEEN = "\n"  # between host and path in a key; a host cannot hold it once parsed from a rule


def parsed(pages: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    return pages.select(F.col(id_column).alias("page_id"), F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, URL, 2).alias("path"))


def candidates(shapes: list[tuple[int, int]]) -> Column:
    """Structs (size, host_size, key) of an address's candidate keys, from columns host and path.

    ``shapes``: the (host labels, path characters) that rules have.
    """
    labels = F.char_length("host") - F.char_length(F.translate("host", ".", "")) + 1
    wide = F.from_json(F.lit("[" + ",".join(f'{{"n":{n},"l":{length}}}' for n, length in shapes) + "]"), "array<struct<n:int,l:int>>")
    fitting = F.filter(wide, lambda s: (s["n"] <= labels) & (s["l"] <= F.char_length("path")))

    def made(shape: Column) -> Column:
        host, path = F.call_function("substring_index", F.col("host"), F.lit("."), -shape["n"]), F.substring(F.col("path"), F.lit(1), shape["l"])
        return F.struct((F.char_length(host) + shape["l"]).alias("size"), F.char_length(host).alias("host_size"), F.concat(host, F.lit(BETWEEN), path).alias("key"))

    return F.when(F.col("host") == "", F.array().cast("array<struct<size:int,host_size:int,key:string>>")).otherwise(F.transform(fitting, made))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[tuple[list[int], int], ...]  # words and number of hashes

    def lists(self, key: Column) -> Column:
        listed = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            words, hashes = self.levels[k]
            listed = F.when(~bloom.contains(words, key, hashes, k), F.lit(k % 2 == 1)).otherwise(listed)
        return listed


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(99)), F.lit(parts)).cast("int")


def build(listed: DataFrame, universe: DataFrame, most_levels: int = 64) -> Cascade:
    """A cascade that tells, for every key of ``universe``, if ``listed`` holds it (both: column ``key``, distinct)."""
    count, keys = listed.count(), universe.count()
    if not count:
        return Cascade(())
    rate = min(0.5, max(count / max(1, keys) * 0.7, 1e-9))
    bits, hashes = bloom.bits_for(count, rate)
    words = bloom.build(listed, "key", bits, hashes, 0)
    levels = [(words, hashes)]
    # a union and an aggregation take the listed keys out: no join here either
    through = universe.where(bloom.contains(words, F.col("key"), hashes, 0)).select("key", F.lit(0).alias("listed"))
    left = materialise(through.unionByName(listed.select("key", F.lit(1).alias("listed"))).groupBy("key").agg(F.max("listed").alias("listed")))
    for level in range(1, most_levels):
        wrong = left.where(F.col("listed") == (1 if level % 2 == 0 else 0))
        count = wrong.count()
        if not count:
            return Cascade(tuple(levels))
        bits, hashes = bloom.bits_for(count, 0.5 if level > 1 else 0.1)
        words = bloom.build(wrong, "key", bits, hashes, level)
        levels.append((words, hashes))
        left = left.where((F.col("listed") == (1 if level % 2 == 0 else 0)) | bloom.contains(words, F.col("key"), hashes, level))
    raise RuntimeError("the cascade did not end")


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", most_keys: int = bloom.MOST_KEYS) -> DataFrame:
    """page_id, host, path, rule, verdict; ``rules`` has host, path (from its slash) and action (allow or block)."""
    dots = F.char_length("host") - F.char_length(F.translate("host", ".", ""))
    keyed = materialise(rules.select("action", (dots + 1).alias("n"), F.char_length("path").alias("l"), F.concat("host", F.lit(BETWEEN), "path").alias("key")).distinct())
    # as many as rules have different shapes: lengths of names and of paths bound them, not the number of rules
    shapes = sorted((r["n"], r["l"]) for r in keyed.select("n", "l").distinct().collect())
    rows = parsed(pages, id_column, url_column)
    found = rows.withColumn("candidates", candidates(shapes)).withColumn("best", F.lit(None).cast("struct<size:int,host_size:int,key:string,blocks:boolean>"))
    universe = materialise(found.select(F.explode("candidates.key").alias("key")).distinct())
    parts = max(1, -(-keyed.count() // most_keys), -(-universe.count() // (8 * most_keys)))
    for part in range(parts):
        own = part_of(F.col("key"), parts) == part
        block = build(keyed.where(own & (F.col("action") == "block")).select("key"), universe.where(own))
        allow = build(keyed.where(own & (F.col("action") == "allow")).select("key"), universe.where(own))
        mine = F.filter("candidates", lambda c: part_of(c["key"], parts) == part) if parts > 1 else F.col("candidates")  # noqa: B023
        judged = F.transform(mine, lambda c: F.struct(c["size"].alias("size"), c["host_size"].alias("host_size"), c["key"].alias("key"), block.lists(c["key"]).alias("blocks"), allow.lists(c["key"]).alias("allows")))  # noqa: B023
        fitting = F.transform(F.filter(judged, lambda c: c["blocks"] | c["allows"]), lambda c: c.dropFields("allows"))
        best = F.array_max(F.array_append(fitting, F.col("best"))) if parts > 1 else F.array_max(fitting)
        found = found.withColumn("best", best)
        if parts > 1:
            found = materialise(found)
    verdict = F.when(F.col("best.blocks"), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.regexp_replace("best.key", BETWEEN, "").alias("rule"), verdict.alias("verdict"))
