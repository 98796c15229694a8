"""Near-duplicates at a shingle similarity: candidates by SimHash and by min-hash bands, every link verified exactly.

Two texts are near-duplicates if their sets of ``words``-word shingles have a
Jaccard similarity of at least ``SIMILARITY``; groups are the closure of these
links.  Bit-sliced SimHash names the candidates that are nearest.  It cannot name
all: texts at 0.8 differ in about 10 of 64 bits and up to 19, where unrelated
texts begin to meet too.  Min-hash bands name the rest, so no link depends on the
radius.

* Nodes are different texts, told apart by 128 bits of their SHA-256 and numbered.
* Fingerprints of the nodes' different shingles are linked at ``RADIUS`` bits by
  the bit-sliced comparison of ``simhash_bitsliced``.  A node's hub is the least
  node of the least fingerprint that its own is linked to, or else of its own.
* ``BANDS`` keys of ``ROWS`` least hashes each: a pair at similarity s shares no
  key with probability (1 - s**ROWS)**BANDS, 4.5e-10 at 0.8 and less above.
* Nodes that are joined by near fingerprints or shared keys form a block.  Every
  node is first compared with its hubs, the one by SimHash and the least node of
  the keys that it shares most often: a hub's nodes are dealt into parts of
  ``chunk``, and each text moves once for each of its at most two hubs.  A group
  of near copies, however large, is linked by this in linear work.
* Only blocks that are still in several pieces go on.  They are dealt into chunks
  of ``chunk`` nodes, and every pair of chunks becomes a cell of its own, but for
  chunks of one piece, which has nothing left to link.  In a cell an index from
  shingle to members counts common shingles exactly (as 64-bit hashes); it hands
  on a spanning forest of its links.

Defined results: a text of fewer words than a shingle is one shingle; null and
blank texts have one common shingle and link to each other; the smallest number
of a group stays, a null number only in a group without others, and of equal
numbers the one with the least name; of rows with equal number and text the one
that stands first in the least file stays; rows are told apart by their place
and not by number; an empty table gives no rows; only the two named columns are
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from codequarry.llm.common import BROADCAST_ROWS, join_one, map_batches, moved, numbered, settled, without_rows
from codequarry.llm.exact_dedup_lsm import Filter
from codequarry.llm.simhash_bitsliced import SEED, Forest, components, link, majority

SIMILARITY = (4, 5)
RADIUS = 4
ROWS, BANDS = 3, 30

_DRAW = np.random.default_rng(SEED)
_FACTORS = (_DRAW.integers(0, 1 << 32, ROWS * BANDS, np.uint64) | np.uint64(1)).astype(np.uint32)
_MASKS = _DRAW.integers(0, 1 << 32, ROWS * BANDS, np.uint64).astype(np.uint32)
_MIX = _DRAW.integers(0, 1 << 63, (ROWS, 2), np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted hashes of a text's different shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    joined = b" ".join(tokens)
    starts = np.cumsum(sizes + 1) - sizes - 1
    last = max(min(words, len(tokens)) - 1, 0)
    begin, end = starts[: len(tokens) - last].tolist(), (starts[last:] + sizes[last:]).tolist()
    found = np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)), np.uint64, len(begin)))
    return found if len(found) else np.zeros(1, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: its number and the least values of the set under ``ROWS`` orders."""
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(short), 512):
        least = np.minimum(least, ((short[low : low + 512, None] ^ _MASKS) * _FACTORS).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40)
    for row, (a, b) in zip(least.astype(np.uint64).reshape(BANDS, ROWS).T, _MIX, strict=True):
        keys = (keys ^ row) * a
        keys = (keys ^ (keys >> np.uint64(29))) * b
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def name_of(text: Column) -> Column:
    """128 bits of SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)), 1, 16)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """If two sets are at ``SIMILARITY``."""
    over, under = SIMILARITY
    if min(len(a), len(b)) * under < max(len(a), len(b)) * over:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * under >= (len(a) + len(b) - common) * over


def similar_pairs(sets: list[np.ndarray], part: np.ndarray, within: bool, pieces: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs at ``SIMILARITY``, beyond ``pieces`` that are linked already.

    Only members in different parts are compared unless ``within``.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders, edges = owner[order], np.r_[0, np.cumsum(np.bincount(code))]
    at = np.r_[0, np.cumsum(sizes)]
    forest = Forest(len(sets))
    if pieces is not None:
        _, first, which = np.unique(pieces, return_index=True, return_inverse=True)
        forest.merge(np.arange(len(sets)), first[which])
    over, under = SIMILARITY
    for k in range(len(sets) - 1):
        rest = np.arange(k + 1, len(sets))
        open_ = forest.label[rest] != forest.label[k]
        if not within:
            open_ &= part[rest] != part[k]
        small, large = np.minimum(sizes[rest], sizes[k]), np.maximum(sizes[rest], sizes[k])
        if not (open_ & (small * under >= large * over)).any():
            continue
        mine = code[at[k] : at[k + 1]]
        counts, step = np.zeros(len(sets), np.int64), 4096
        for low in range(0, len(mine), step):
            a, b = edges[mine[low : low + step]], edges[mine[low : low + step] + 1]
            length = b - a
            spots = np.repeat(a - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum()))
            counts += np.bincount(holders[spots], minlength=len(sets))
        common = counts[rest]
        for other in rest[open_ & (common * under >= (sizes[rest] + sizes[k] - common) * over)].tolist():
            if forest.label[other] != forest.label[k]:
                forest.merge(np.array([k]), np.array([other]))
                yield k, other


def _votes(nodes: DataFrame, count: int) -> DataFrame:
    """(node, least, n): how many keys of a node have which least node; of the ``count`` nodes, those that share keys."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    least = settled(keyed.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1"))
    shared = Filter.over(least, least.count(), "key")  # most keys are no other text's and need not move again
    joined = join_one(keyed.where(shared.may_hold(F.col("key"))), least, ["key"], "members", count * BANDS)
    return settled(joined.where("node <> least").groupBy("node", "least").agg(F.count(F.lit(1)).alias("n")))


def _near(nodes: DataFrame, count: int) -> DataFrame:
    """(node, hub): the hub of each of the ``count`` nodes whose fingerprint is another's or at ``RADIUS`` of one."""
    first = settled(nodes.groupBy("bits").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("members")))
    stars = settled(link(first.select("bits"), RADIUS).groupBy("b").agg(F.min("a").alias("a")))
    degrees = stars.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    hubs = settled(degrees.join(moved(first), F.col("a") == F.col("bits")).select("a", F.col("least").alias("hub"), "degree"))
    named = join_one(stars, hubs, ["a"], "degree", count).select(F.col("b").alias("bits"), "hub")
    known = first.join(moved(named), "bits", "left").where("hub IS NOT NULL OR members > 1").select("bits", F.coalesce("hub", "least").alias("hub"), "members")
    return settled(join_one(nodes.select("node", "bits"), settled(known), ["bits"], "members", count).where("node <> hub").select("node", "hub"))


def star_links(texts: Callable[[DataFrame], DataFrame], near: DataFrame, votes: DataFrame, words: int, chunk: int) -> DataFrame:
    """(a, b): verified links of nodes with their hubs; ``texts`` gives (node, text) of the nodes of a table."""
    voted = votes.groupBy("node").agg(F.max_by("least", F.struct(F.col("n"), -F.col("least"))).alias("hub"))
    stars = settled(near.unionByName(voted).distinct())
    degrees = settled(stars.groupBy("hub").agg(F.count(F.lit(1)).alias("degree")).withColumn("parts", F.ceil(F.col("degree") / chunk).cast("int")))
    dealt = join_one(stars, degrees, ["hub"], "degree", stars.count())
    members = dealt.select("hub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("rank"), "node")
    hubs = degrees.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("rank"), F.col("hub").alias("node"))
    places = settled(members.unionByName(hubs))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, known = None, None
        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            for name, rank, node, text in zip(*(batch.column(k) for k in (0, 2, 3, 4)), strict=True):
                mine = shingles(text.as_py(), words)
                if rank.as_py() == 0:
                    hub, known = name.as_py(), mine
                elif hub == name.as_py() and alike(known, mine):
                    found[0].append(node.as_py())
                    found[1].append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    rows = texts(places.select("node").distinct()).join(moved(places), "node").select("hub", "part", "rank", "node", "text")
    placed = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "rank", "node")
    return settled(map_batches(placed, compare, "a long, b long"))


def piece_links(texts: Callable[[DataFrame], DataFrame], pieces: DataFrame, words: int, chunk: int) -> DataFrame:
    """(a, b): verified links between different pieces of blocks, from (node, block, piece) of blocks with several pieces."""
    sizes = settled(pieces.groupBy("block", "piece").agg(F.count(F.lit(1)).alias("n")))
    large = F.col("n") > chunk
    before = Window.partitionBy("block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # a large piece has chunks of its own; the others of a block share the first ones
    own = sizes.where(large).withColumn("width", F.ceil(F.col("n") / chunk).cast("int")).withColumn("start", F.coalesce(F.sum("width").over(before), F.lit(0)).cast("int"))
    blocks = sizes.groupBy("block").agg(F.ceil(F.sum(F.when(~large, F.col("n")).otherwise(0)) / chunk).cast("int").alias("mixed"), F.sum(F.when(large, F.ceil(F.col("n") / chunk)).otherwise(0)).cast("int").alias("wide"), F.count(F.lit(1)).alias("pieces"))
    placed_pieces = sizes.join(moved(own.drop("n")), ["block", "piece"], "left")
    info = join_one(placed_pieces, settled(blocks), ["block"], "pieces", sizes.count())
    info = settled(info.select("block", "piece", "n", (F.col("mixed") + F.col("wide")).alias("chunks"), F.when(large, F.col("mixed") + F.col("start")).otherwise(0).alias("low"), F.when(large, F.col("width")).otherwise(F.col("mixed")).alias("count"), large.alias("alone")))
    dealt = join_one(pieces, info, ["block", "piece"], "n", pieces.count())
    dealt = dealt.withColumn("part", (F.col("low") + F.pmod(F.xxhash64("node"), F.col("count"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: ~F.col("alone") | (k < F.col("low")) | (k >= F.col("low") + F.col("count")))
    pairs = F.transform(others, lambda k: F.struct(F.least(k, F.col("part")).alias("low"), F.greatest(k, F.col("part")).alias("high")))
    cells = dealt.select("node", "block", "piece", "part", F.explode(pairs).alias("cell")).select("node", "block", "piece", "part", "cell.low", "cell.high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, names, sets, parts, labels = None, [], [], [], []

        def run() -> pa.RecordBatch:
            found = list(similar_pairs(sets, np.array(parts), cell[1] == cell[2], np.array(labels))) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[x[side]] for x in found], pa.int64()) for side in (0, 1)], ["a", "b"])

        for batch in batches:
            for block, low, high, part, node, piece, text in zip(*batch.columns, strict=True):
                now = (block.as_py(), low.as_py(), high.as_py())
                if now != cell:
                    if sets:
                        yield run()
                    cell, names, sets, parts, labels = now, [], [], [], []
                names.append(node.as_py())
                sets.append(shingles(text.as_py(), words))
                parts.append(part.as_py())
                labels.append(piece.as_py())
        if sets:
            yield run()

    keys = ["block", "low", "high"]
    placed = texts(pieces.select("node")).join(moved(cells), "node").select(*keys, "part", "node", "piece", "text").repartition(*keys).sortWithinPartitions(*keys, "part", "node")
    return settled(map_batches(placed, compare, "a long, b long").distinct())


def links(texts: Callable[[DataFrame], DataFrame], nodes: DataFrame, count: int, words: int, chunk: int) -> DataFrame:
    """(a, b): verified links whose closure is that of all links between the ``count`` nodes."""
    near, votes = _near(nodes, count), _votes(nodes, count)
    stars = star_links(texts, near, votes, words, chunk)
    candidates = near.toDF("a", "b").unionByName(votes.select(F.col("node").alias("a"), F.col("least").alias("b")))
    blocks = components(candidates, keep=settled).select("node", F.col("root").alias("block"))
    linked = components(stars, keep=settled).select("node", F.col("root").alias("piece"))
    pieces = settled(blocks.join(moved(linked), "node", "left").select("node", "block", F.coalesce("piece", "node").alias("piece")))
    open_ = pieces.groupBy("block").agg(F.min("piece").alias("low"), F.max("piece").alias("high"), F.count(F.lit(1)).alias("members")).where("low <> high").select("block", "members")
    rest = settled(join_one(pieces, settled(open_), ["block"], "members", count))
    return stars if rest.isEmpty() else stars.unionByName(piece_links(texts, rest, words, chunk))


def keep_first(documents: DataFrame, words: int = 5, chunk: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``documents`` that stay, all columns."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, keys = np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, BANDS), np.int64)
            for row, x in enumerate(batch.column(2)):
                mine = shingles(x.as_py(), words)
                bits[row], keys[row] = majority(mine), band_keys(mine)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 3, 4)), pa.array(bits.view(np.int64)), lists], ["doc_id", "name", "file", "place", "bits", "keys"])

    named, file, place = numbered(documents, "near")
    text = F.col(text_column).cast("string")
    rows = named.select(F.col(id_column).cast("long").alias("doc_id"), name_of(text).alias("name"), text.alias("text"), F.col(file).alias("file"), F.col(place).alias("place"))
    prints = settled(map_batches(rows, keyed, "doc_id long, name binary, file long, place long, bits long, keys array<long>"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "name", "file", "place")
    distinct = prints.groupBy("name").agg(F.first("bits").alias("bits"), F.first("keys").alias("keys"), F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    # a number for each different text, written down with it
    nodes = settled(distinct.select(F.monotonically_increasing_id().alias("node"), "bits", "keys", "first", "copies"))
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()

    def texts(wanted: DataFrame) -> DataFrame:
        """(node, text): texts of one node are equal, so the first row of each stands for all."""
        chosen = settled(nodes.join(moved(wanted), "node", "left_semi").select("node", F.col("first.file").alias("file"), F.col("first.place").alias("place")))
        side = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else moved(chosen)
        return rows.select("file", "place", "text").join(side, ["file", "place"]).select("node", "text")

    groups = settled(components(links(texts, nodes, size["n"], words, chunk), keep=settled))
    grouped = nodes.join(moved(groups), "node").select("root", "first")
    best = settled(grouped.groupBy("root").agg(F.min("first").alias("best"), F.count(F.lit(1)).alias("members")))
    others = join_one(grouped, best, ["root"], "members", size["n"]).where("first <> best").select("first.file", "first.place")
    twice = settled(nodes.where("copies > 1").select(F.col("first.name").alias("name"), "copies", F.col("first.file").alias("own_file"), F.col("first.place").alias("own_place")))
    leave = others
    if not twice.isEmpty():
        again = join_one(prints.select("name", "file", "place"), twice, ["name"], "copies", size["rows"])
        leave = others.unionByName(again.where("file <> own_file OR place <> own_place").select("file", "place"))
    return without_rows(named, file, place, settled(leave))
