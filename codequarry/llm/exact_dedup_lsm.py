"""Exact duplicates by a log-structured merge index, in DataFrame functions only.

* Memtables: every input partition sorts its rows by digest.  ``flush`` writes
  them in one pass, dealt to ``FLUSHES`` flushes by partition.
* ``Index.insert`` makes each flush a run: one entry for each digest, with the
  identifier that stays and the number of rows, sorted by digest, and a Bloom
  filter over its digests.  Copies meet in the partial aggregation of each task,
  so a group of any size costs one entry per task.
* Compaction: as soon as two runs stand on one tier, the newer is merged into the
  older and the result goes up a tier.  An entry whose digest the other run's
  filter refuses is in no other place and passes as it is; only the rest is
  shuffled.  Of equal digests the smallest identifier of the longest rows stays.
* ``Index.probe`` looks digests up in the runs, newest first, each behind its
  filter.
* ``verify``: digests that were hit more than once are compared byte by byte.
  All texts of a digest are equal exactly if the least equals the greatest, which
  again is a partial aggregation; the filter of the hit digests keeps other texts
  from moving.  The same filter lets rows that have no copy keep their place.
* Digests under which different texts met are split by the texts themselves.

A filter is at most ``bloom.MOST_BITS`` long; one that is too full lets more
entries through to the exact comparison, and nothing else changes.

Texts are equal when identical after deleting the characters [\\x20\\x09-\\x0D];
of equal texts the one with the most code points stays, then the smallest
number, then the row that stands first.

Defined results: null counts as empty; rows with the same number and text are
one group and exactly one of them is kept; a null number stays only if no other
row of its group has as many code points; an empty table gives no rows; rows are
told apart by their place and not by number; only the two named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm import bloom
from codequarry.llm.common import join_one, materialise, numbered, without_rows, written

WHITE = " \t\n\x0b\x0c\r"
FLUSHES = 4


def normalised(text: Column) -> Column:
    """The text without its white space; null becomes empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def _keyed(named: DataFrame, file: str, place: str, id_column: str, text_column: str, digest_bytes: int) -> DataFrame:
    text = F.col(text_column).cast("string")
    once = lambda **made: F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()])))
    # conditions on the digest stay above a generator, so text and digest are computed once a row
    rows = named.select(F.col(id_column).alias("doc_id"), F.col(file).alias("file"), F.col(place).alias("place"), once(points=F.coalesce(F.char_length(text), F.lit(0)), body=normalised(text)))
    rows = rows.select("*", once(sha=F.unhex(F.sha2(F.col("body").cast("binary"), 256))))
    return rows.withColumn("digest", F.substring("sha", 1, digest_bytes) if digest_bytes < 32 else F.col("sha"))


def flush(keyed: DataFrame, flushes: int = FLUSHES) -> DataFrame:
    """Every row with its digest, in ``flushes`` folders; a partition is a memtable and leaves sorted by digest."""
    rows = keyed.select("digest", "doc_id", "points", "sha", "file", "place", F.pmod(F.spark_partition_id(), F.lit(flushes)).cast("int").alias("flush"))
    return written(rows.sortWithinPartitions("flush", "digest"), "memtable", by="flush")


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    # ~id falls as id grows and, unlike -id, exists for every long, so the greatest ``best`` is the row that stays
    best = F.struct("points", F.bitwise_not("doc_id").alias("rank"), F.bitwise_not("file").alias("file"), F.bitwise_not("place").alias("place"))
    return rows.groupBy(*keys).agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size"))


@dataclass(frozen=True)
class Filter:
    """The Bloom filter of a run, a table of one row; without it nothing is refused."""

    words: DataFrame | None
    bits: int = 0
    hashes: int = 0

    @staticmethod
    def over(frame: DataFrame, count: int, key: str = "digest") -> Filter:
        # below four bits a key a filter lets nearly everything through and is not worth its pass
        if 4 * count > bloom.MOST_BITS:
            return Filter(None)
        bits, hashes = bloom.bits_for(count)
        return Filter(bloom.table(frame, key, bits, hashes), bits, hashes)

    def may_hold(self, key: Column) -> Column:
        return F.lit(True) if self.words is None else bloom.contains(self.words.scalar(), key, self.hashes, bits=self.bits)


@dataclass(frozen=True)
class Run:
    entries: DataFrame  # digest, best, group_size, sorted by digest within files
    tier: int
    count: int
    filter: Filter


@dataclass
class Index:
    """Runs from the oldest to the newest; a digest may stand in several until they are merged."""

    runs: list[Run] = field(default_factory=list)

    def insert(self, rows: DataFrame) -> None:
        """One flush: rows with digest, doc_id, points, file and place."""
        self._push(_groups(rows, "digest"), 0)
        while len(self.runs) > 1 and self.runs[-1].tier == self.runs[-2].tier:
            self._merge()

    def compact(self) -> DataFrame:
        """All runs as one: each digest once."""
        while len(self.runs) > 1:
            self._merge()
        return self.runs[0].entries

    def probe(self, digests: DataFrame) -> DataFrame:
        """(digest, best, group_size) of what the runs hold of distinct ``digests``, an entry for each run."""
        found = None
        for run in reversed(self.runs):
            hits = run.entries.join(digests.where(run.filter.may_hold(F.col("digest"))), "digest", "left_semi")
            found = hits if found is None else found.unionByName(hits)
        return found

    def _push(self, entries: DataFrame, tier: int) -> None:
        table = written(entries.sortWithinPartitions("digest"), f"run-{tier}")
        count = table.count()
        self.runs.append(Run(table, tier, count, Filter.over(table, count)))

    def _merge(self) -> None:
        newer, older = self.runs.pop(), self.runs.pop()
        parts = [(newer.entries, older.filter), (older.entries, newer.filter)]
        apart = [entries.where(~other.may_hold(F.col("digest"))) for entries, other in parts]
        (mine, other), (yours, another) = parts
        shared = mine.where(other.may_hold(F.col("digest"))).unionByName(yours.where(another.may_hold(F.col("digest"))))
        merged = shared.groupBy("digest").agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))
        self._push(merged.unionByName(apart[0]).unionByName(apart[1]), max(newer.tier, older.tier) + 1)


def _kept(groups: DataFrame) -> DataFrame:
    best = {"keep_id": F.bitwise_not("best.rank"), "keep_file": F.bitwise_not("best.file"), "keep_place": F.bitwise_not("best.place")}
    return groups.withColumns(best).drop("best")


_RESULT = ["doc_id", "keep_id", "group_size", "file = keep_file AND place = keep_place AS kept", "sha", "file", "place"]


def _found(named: DataFrame, file: str, place: str, id_column: str, text_column: str, digest_bytes: int, flushes: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha, file, place for every row."""
    keyed = _keyed(named, file, place, id_column, text_column, digest_bytes)
    rows, index = flush(keyed, flushes), Index()
    for k in range(flushes):
        index.insert(rows.where(F.col("flush") == k))
    hits = materialise(_kept(index.compact().where("group_size > 1")))
    size = hits.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("group_size"), F.lit(0)).alias("rows")).first()
    if not size["n"]:
        return rows.selectExpr("doc_id", "doc_id AS keep_id", "1L AS group_size", "true AS kept", "sha", "file", "place")
    held = Filter.over(hits, size["n"])
    maybe = held.may_hold(F.col("digest"))
    collided = verify(keyed, maybe)
    whole = collided.isEmpty()
    alone = rows.where(~maybe).selectExpr("doc_id", "doc_id AS keep_id", "1L AS group_size", "true AS kept", "sha", "file", "place")
    copies = rows.where(maybe) if whole else rows.where(maybe).join(collided, "digest", "left_anti")
    out = alone.unionByName(_with_hits(copies, hits, size["rows"]))
    if whole:
        return out
    mixed = materialise(keyed.where(maybe).join(collided, "digest", "left_semi"))
    return out.unionByName(mixed.join(_kept(_groups(mixed, "digest", "body")), ["digest", "body"]).selectExpr(*_RESULT))


def _with_hits(copies: DataFrame, hits: DataFrame, total: int) -> DataFrame:
    """Rows with the entry of their digest; a row that the filter let through by chance has none and stands alone."""
    own = {"keep_id": F.col("doc_id"), "keep_file": F.col("file"), "keep_place": F.col("place")}
    joined = join_one(copies, hits.withColumn("members", F.col("group_size")), ["digest"], "members", total, "left")
    filled = {name: F.when(F.col("group_size").isNull(), other).otherwise(F.col(name)) for name, other in own.items()}
    return joined.withColumns(filled).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long"))).selectExpr(*_RESULT)


def verify(keyed: DataFrame, maybe: Column) -> DataFrame:
    """Digests under which texts differ in some byte, of the rows that may be hits."""
    texts = keyed.where(maybe).select("digest", "body")
    return materialise(texts.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("greatest")).where("least <> greatest").select("digest"))


def duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest_bytes: int = 32, flushes: int = FLUSHES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, sha (binary) for every row.

    ``digest_bytes`` below 32 makes collisions likely; tests use it to reach the
    byte comparison.
    """
    return _found(*numbered(documents, "exact"), id_column, text_column, digest_bytes, flushes).drop("file", "place")


def keep_first(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", flushes: int = FLUSHES) -> DataFrame:
    """The rows of ``documents`` that stay, all columns; texts stay where they lie unless very many rows go."""
    named, file, place = numbered(documents, "exact")
    found = _found(named, file, place, id_column, text_column, 32, flushes)
    return without_rows(named, file, place, materialise(found.where("NOT kept").select("file", "place")))
