"""Bloom filters out of DataFrame functions only.

A filter is an array of 64-bit words of fixed length.  It is filled by one
partial aggregation (``bit_or`` by word number), so at most ``bits / 64`` rows
come to the driver, and it goes back as a constant array.  Its size is bounded
by ``MOST_BITS``, whatever is put in; a filter that is too full only lets more
through.  Who needs a rate for any number of keys deals them into parts of
``MOST_KEYS`` at most, with a filter each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import materialise

MOST_BITS = 1 << 26
MOST_KEYS = MOST_BITS // 32


def bits_for(keys: int, rate: float = 0.01) -> tuple[int, int]:
    """(bits, hashes) for so many keys: a power of two up to ``MOST_BITS``."""
    import math

    want = max(64, math.ceil(max(1, keys) * -math.log(rate) / math.log(2) ** 2))
    bits = min(MOST_BITS, 1 << (want - 1).bit_length())
    return bits, max(1, min(8, round(-math.log2(rate))))


def _places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    first, second = F.xxhash64(key, F.lit(2 * seed)), F.xxhash64(key, F.lit(2 * seed + 1))
    mask = F.lit(bits - 1).cast("long")
    # each half of the two hashes gives places by masking: no sum can overflow
    halves = [first, second, F.shiftrightunsigned(first, 32), F.shiftrightunsigned(second, 32)]
    out = []
    for k in range(hashes):
        h = halves[k] if k < 4 else F.xxhash64(key, F.lit(2 * seed), F.lit(k))
        out.append(h.bitwiseAND(mask))
    return out


def _words(frame: DataFrame, key: str, bits: int, hashes: int, seed: int) -> DataFrame:
    """(word, mask) of every word that is not zero."""
    places = frame.select(F.explode(F.array(*_places(F.col(key), bits, hashes, seed))).alias("place"))
    return places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(cast(1 as bigint), cast(place & 63 as int))")).alias("mask"))


def build(frame: DataFrame, key: str, bits: int, hashes: int, seed: int = 0) -> list[int]:
    """The words of a filter over column ``key``."""
    out = [0] * (bits // 64)
    for row in _words(frame, key, bits, hashes, seed).collect():  # at most bits / 64 rows
        out[row["word"]] = row["mask"]
    return out


def table(frame: DataFrame, key: str, bits: int, hashes: int, seed: int = 0) -> DataFrame:
    """The same as a table of one row in the shared folder: its ``scalar()`` is a constant that no plan is long by."""
    every = frame.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    whole = _words(frame, key, bits, hashes, seed).unionByName(every).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    return materialise(whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda w: w["mask"]).alias("words")))


def constant(words: list[int]) -> Column:
    """The filter as an array that the optimizer folds into one constant."""
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def contains(words: list[int] | Column, key: Column, hashes: int, seed: int = 0, bits: int = 0) -> Column:
    """If the filter may hold ``key``.

    With a column of words (a subquery) ``bits`` must be given, and ``key`` should
    be a stored column, since it is read once for each hash.
    """

    def found(array: Column, bound: Column, size: int) -> Column:
        out = F.lit(True)
        for place in _places(bound, size, hashes, seed):
            word = F.get(array, F.shiftright(place, 6).cast("int"))
            out = out & (F.getbit(word, place.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
        return out

    if not isinstance(words, list):
        return found(words, key, bits)
    # bound as a lambda's variable, key and constant stand in the plan once and not for each hash
    return F.exists(F.array(F.struct(constant(words).alias("words"), key.alias("key"))), lambda b: found(b["words"], b["key"], 64 * len(words)))
