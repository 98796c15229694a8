"""SimHash near-duplicates by bit-sliced comparison.

``fingerprints`` runs over the input partitions.  ``link`` works on distinct
fingerprints only.  The 64 bits are cut into m segments; two fingerprints at a
distance of at most r differ in at most r segments, so they agree in some choice
of m - r segments.  Each fingerprint therefore goes to C(m, r) buckets, one for
each choice, keyed by the agreeing bits; no pair is missed.  m grows with the
number of fingerprints so that a bucket of unrelated ones stays small.

A bucket above ``chunk`` members is dealt into chunks and every pair of chunks
becomes a cell of its own: the exact way for hot buckets, in blocks of bounded
size.  Cells are compared with vertical bit planes: word b of a block holds bit b
of 64 fingerprints, a query is compared with all 64 at once, carry-save adders
keep the 64 distances in three counter words and a sticky overflow word, and a
block is abandoned as soon as all its lanes exceed the radius.  A cell hands on
a spanning forest of its links, never all its pairs.

Components are found by alternating large-star and small-star steps over tables
in the shared checkpoint folder; hubs of many links are joined by a broadcast of
bounded size.

Defined results: null and empty texts have fingerprint zero and link like any
other; a null document number takes part in linking but never names a component
(a component of nulls alone has a null name); an empty table gives no rows;
repeated rows stay repeated; only the two named columns are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from codequarry.llm.common import join_one, map_batches, materialise, moved

SEED = 42
BITS = 64


def fingerprint(text: str | None, words: int = 4) -> int:
    """Majority of the shingles' hashes, bit by bit; a bit needs over half of them."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    joined = b" ".join(tokens)
    starts = np.cumsum(sizes + 1) - sizes - 1
    last = min(words, len(tokens)) - 1
    counts, total, step = np.zeros(BITS, np.int64), len(tokens) - last, 1 << 16
    for low in range(0, total, step):
        high = min(total, low + step)
        begin, end = starts[low:high].tolist(), (starts[low + last : high + last] + sizes[low + last : high + last]).tolist()
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)), np.uint64, high - low)
        counts += _bit_counts(hashes)
    return _over_half(counts, total)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes that are at hand."""
    counts, step = np.zeros(BITS, np.int64), 1 << 16
    for low in range(0, len(hashes), step):
        counts += _bit_counts(hashes[low : low + step])
    return _over_half(counts, len(hashes))


def _over_half(counts: np.ndarray, total: int) -> int:
    return int(sum(1 << b for b in range(BITS) if 2 * counts[b] > total))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, by sideways addition over bytes of lanes."""
    bits = np.unpackbits(np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(BITS, np.int64)
    for low in range(0, len(bits), 255):
        counts += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    return counts


def fingerprints(documents: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, bits): the fingerprint as a signed long of the same 64 bits."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "bits"])

    chosen = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(chosen, signed, "doc_id long, bits long")


def segment_masks(segments: int, radius: int) -> list[int]:
    """The bits of every choice of segments - radius segments, as signed longs."""
    edges = [BITS * k // segments for k in range(segments + 1)]
    part = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(segments)]
    masks = [sum(chosen) for chosen in itertools.combinations(part, segments - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def segments_for(count: int, radius: int, occupancy: int = 64) -> int:
    """The fewest segments whose keys spread ``count`` fingerprints to ``occupancy`` a bucket."""
    segments = radius + 1
    while segments < 2 * radius and count > occupancy << (BITS * (segments - radius) // segments):
        segments += 1
    return segments


def _cells(distinct: DataFrame, masks: list[int], chunk: int, count: int) -> DataFrame:
    """The ``count`` distinct fingerprints by the cells they are compared in."""
    keys = F.posexplode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseAND(F.col("bits"))))
    keyed = distinct.select("bits", keys.alias("mask", "key"))
    sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sizes = materialise(sizes.withColumn("chunks", F.ceil(F.col("members") / chunk).cast("int")))
    joined = join_one(keyed, sizes, ["mask", "key"], "members", count * len(masks))
    own = F.pmod(F.xxhash64("bits", "mask"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("low"), F.greatest(k, F.col("own")).alias("high")))
    return (
        joined.withColumn("own", own)
        .select("bits", "mask", "key", "own", F.explode(pairs).alias("cell"))
        .select("mask", "key", "cell.low", "cell.high", F.col("own").alias("part"), "bits")
    )


def _planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit b of 64 values in each word of row b."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")  # word, lane, bit
    return np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").reshape(64, -1, 8).copy().view(np.uint64)[:, :, 0]


def within_radius(planes: np.ndarray, word: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """For each (block word, query): a word of the lanes at a distance of at most ``radius``, which is 3 to 6.

    The counters hold 0 to 7, so a larger radius needs wider ones.
    """
    if not 3 <= radius <= 6:
        raise ValueError(f"the radius is 3 to 6, not {radius}")
    alive, near = np.arange(len(word)), np.zeros(len(word), np.uint64)
    ones = np.zeros(len(word), np.uint64)
    twos, fours, over = ones.copy(), ones.copy(), ones.copy()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)

    def differ(b: int) -> np.ndarray:
        return planes[b][word] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1)))

    def add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = a ^ b
        return half ^ c, (a & b) | (half & c)

    def exceeds() -> np.ndarray:
        # counters hold 0..7; beyond the radius means 5..7 for radius 4, and so on
        out = over.copy()
        for value in range(radius + 1, 8):
            out |= (fours if value & 4 else ~fours) & (twos if value & 2 else ~twos) & (ones if value & 1 else ~ones)
        return out

    for b in range(0, BITS, 4):
        ones, first = add(ones, differ(b), differ(b + 1))
        ones, second = add(ones, differ(b + 2), differ(b + 3))
        twos, carry = add(twos, first, second)
        over |= fours & carry
        fours ^= carry
        if b % 8 == 4 and b < BITS - 4:
            dead = exceeds() == full
            if dead.any():
                keep = ~dead
                alive, word, query, ones, twos, fours, over = (x[keep] for x in (alive, word, query, ones, twos, fours, over))
                if not len(alive):
                    return near
    near[alive] = ~exceeds()
    return near


class Forest:
    """Labels of local rows, merged in bulk; every label is the least row it can reach."""

    def __init__(self, size: int) -> None:
        self.label = np.arange(size)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def compare_cells(cell: np.ndarray, part: np.ndarray, low: np.ndarray, bits: np.ndarray, radius: int, slab: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of a spanning forest of every cell; rows of a cell stand together.

    ``cell``: numbers of the cells in order.  In a cell of two chunks only rows
    of different chunks are compared: each chunk has a cell with itself.
    """
    edges = np.flatnonzero(np.diff(cell)) + 1
    starts, ends = np.r_[0, edges], np.r_[edges, len(cell)]
    first_word = np.zeros(len(starts), np.int64)
    words = -(-(ends - starts) // 64)
    first_word[1:] = np.cumsum(words)[:-1]
    # every cell starts in a word of its own
    which = np.repeat(np.arange(len(starts)), ends - starts)
    position = first_word[which] * 64 + (np.arange(len(cell)) - starts[which])
    padded, filled, chunk_of = np.zeros(int(words.sum()) * 64, np.uint64), np.zeros(int(words.sum()) * 64, bool), np.zeros(int(words.sum()) * 64, np.int64)
    padded[position], filled[position], chunk_of[position] = bits, True, part
    row_at = np.zeros(len(padded), np.int64)
    row_at[position] = np.arange(len(cell))
    planes = _planes(padded)
    valid = np.packbits(filled.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    forest = Forest(len(cell))
    # a row is a query of the words from its own to the last of its cell
    own_word = position // 64
    todo = first_word[which] + words[which] - own_word
    total, row = np.cumsum(todo), 0
    while row < len(cell):
        base = total[row - 1] if row else 0
        upto = max(row + 1, int(np.searchsorted(total, base + slab, "right")))
        rows = np.repeat(np.arange(row, upto), todo[row:upto])
        word = own_word[rows] + (np.arange(len(rows)) - np.repeat(total[row:upto] - todo[row:upto] - base, todo[row:upto]))
        near = within_radius(planes, word, bits[rows], radius) & valid[word]
        hit = np.flatnonzero(near)
        if len(hit):
            for piece in np.array_split(hit, -(-len(hit) // 4096)):
                lanes = np.unpackbits(near[piece].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                at, lane = np.nonzero(lanes)
                a, b = rows[piece][at], row_at[word[piece][at] * 64 + lane]
                cross = part[a] != part[b]
                keep = (b > a) & (cross | (low[a] == -1))
                forest.merge(a[keep], b[keep])
        row = upto
    linked = np.flatnonzero(forest.label != np.arange(len(cell)))
    return bits[forest.label[linked]], bits[linked]


def link(distinct: DataFrame, radius: int = 4, chunk: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``bits``) whose closure is that of all links."""
    count = distinct.count()
    masks = segment_masks(segments_for(count, radius), radius)
    cells = _cells(distinct, masks, chunk, count)
    # cells of one chunk with itself compare all rows; low = -1 marks them
    keyed = cells.withColumn("low", F.when(F.col("low") == F.col("high"), F.lit(-1)).otherwise(F.col("low")))
    names = ["mask", "key", "high", "low"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def run(block: np.ndarray) -> pa.RecordBatch:
            changes = np.r_[True, (block[1:, :4] != block[:-1, :4]).any(axis=1)]
            a, b = compare_cells(np.cumsum(changes), block[:, 4], block[:, 3], block[:, 5].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
                size += batch.num_rows
            if size >= 1 << 15:
                block = np.concatenate(held)
                # the last cell may go on in the next batch
                differs = np.flatnonzero((block[:, :4] != block[-1, :4]).any(axis=1))
                end = differs[-1] + 1 if len(differs) else 0
                if end:
                    yield run(np.ascontiguousarray(block[:end]))
                held, size = [block[end:]], len(block) - end
        if size:
            yield run(np.ascontiguousarray(np.concatenate(held)))

    placed = keyed.select("mask", "key", "high", "low", "part", "bits").repartition(*names).sortWithinPartitions(*names, "part", "bits")
    return map_batches(placed, compare, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60, keep: Callable[[DataFrame], DataFrame] = materialise) -> DataFrame:
    """(node, root): the least node that each node of an edge list (a, b) reaches.

    Edges point from the greater node to the smaller.  A large-star step sends
    every edge on from its smaller node to that node's least neighbour; only nodes
    that stand at both ends of edges change anything, so only their edges meet
    them.  A small-star step joins all smaller neighbours of a node to the least;
    only nodes with several change anything.  Both end when all edges are stars.
    ``most_rounds`` only guards against a table that changes under the job, and
    ``keep`` writes down the table of a step.
    """
    edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    count = edges.count()  # no step makes more of them
    for _ in range(most_rounds):
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        hubs = edges.groupBy(F.col("b").alias("u")).agg(F.count(F.lit(1)).alias("degree"))
        chained = keep(hubs.join(moved(least), "u"))
        passed = chained.isEmpty()
        if not passed:
            sent = join_one(edges.withColumnRenamed("b", "u"), chained, ["u"], "degree", count, "left")
            edges = keep(sent.select("a", F.coalesce("m", "u").alias("b")).distinct())
        several = keep(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).where("degree > 1"))
        if not several.isEmpty():
            met = join_one(edges, several, ["a"], "degree", count, "left")
            stay = met.where("m IS NULL OR m = b").select("a", "b")
            edges = keep(stay.unionByName(met.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        elif passed:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError("the links did not settle")


def near_duplicates(documents: DataFrame, radius: int = 4, words: int = 4, chunk: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, bits, component_id): the smallest document number reachable over links."""
    prints = materialise(fingerprints(documents, words, id_column, text_column))
    distinct = materialise(prints.groupBy("bits").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies")))
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    roots = materialise(components(link(distinct.select("bits"), radius, chunk)))
    named = distinct.join(moved(roots), F.col("bits") == F.col("node")).select("bits", "least_id", "copies", "root")
    names = materialise(named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members")))
    linked = join_one(named, names, ["root"], "members", size["n"]).select("bits", "component_id", "copies")
    alone = distinct.join(moved(roots), F.col("bits") == F.col("node"), "left_anti").select("bits", F.col("least_id").alias("component_id"), "copies")
    return join_one(prints, materialise(linked.unionByName(alone)), ["bits"], "copies", size["rows"]).select("doc_id", "bits", "component_id")


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
