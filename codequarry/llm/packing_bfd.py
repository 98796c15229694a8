"""Packing by best-fit decreasing.

Documents become token ids on the executors, in parallel over the input
partitions; an overlong document is cut there into full windows and one
remainder, so that only piece descriptions (a few dozen bytes) move on.  Pieces
are dealt by hash into shards of a bounded number of pieces.  Within a shard a
segment tree indexed by remaining capacity finds, in O(log window), the tightest
open window that a piece fits into; pieces come in decreasing length.

Ids equal those of the ``tokenizers`` library for the given file.  The file's
vocabulary is handed to ``tiktoken``'s encoder, which is several times faster,
only if its merges are in rank order (then both define the same merges); texts
that hold an added token's string, all texts under any other file, and runs of
``LONG_SPACE`` white-space characters and more, for which that encoder's stack is
too small, go through ``tokenizers`` itself.

Defined results: a null text is empty and gives one piece, the end id alone; a
text of any length, and one of white space or a single word alone, has the ids
that ``tokenizers`` gives it; an
empty table gives no rows; repeated rows and repeated document numbers are
packed like any other row; only the two named columns are read.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import map_batches, materialise

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


LONG_SPACE = 1 << 16
#: The characters that Unicode calls white space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_SPACE = re.compile(f"[{_SPACE}]{{{LONG_SPACE},}}+")


class Encoder:
    """Token ids of a tokenizer file, without special tokens added."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [token["content"] for token in spec.get("added_tokens", [])]
        self.fast = _ranked(spec)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(token in text for token in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if len(text) < LONG_SPACE:
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        out: list[int] = []
        at = 0
        for run in _LONG_SPACE.finditer(text):
            # the last character of a run belongs to the word that follows
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self.fast.encode_ordinary(text[at : run.start()])
            out += self.exact.encode(text[run.start() : end], add_special_tokens=False).ids
            at = end
        return np.array(out + self.fast.encode_ordinary(text[at:]), dtype="<u4")


def _ranked(spec: dict):
    """The same byte-level BPE as ranks, or None if the file is of another kind."""
    import tiktoken

    model, before = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not (model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"))
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or not level or spec.get("normalizer"):
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    to_byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [vocab.get(a + b) for a, b in pairs]
    if None in order or any(x >= y for x, y in zip(order, order[1:])) or not all(c in vocab for c in to_byte):
        return None
    merged = {a + b for a, b in pairs}
    ranks = {bytes(to_byte[c] for c in token): rank for token, rank in vocab.items() if token in merged or len(token) == 1 and token in to_byte}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(documents: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of every document: full windows, then the remainder with the end id."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    rows.append((doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    chosen = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(chosen, pieces, PIECES)


class RoomTree:
    """Open windows by remaining room, and a segment tree over the rooms that have any."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.held = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.held[node] += by
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least ``length`` that an open window has."""
        node = length + self.size
        if self.held[node]:
            return length
        while node > 1:
            if not node & 1 and self.held[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.held[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None

    def take(self, room: int) -> int:
        self._count(room, -1)
        return self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; ``lengths`` must be in decreasing order."""
    tree, sequences, offsets, opened = RoomTree(window), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, length in enumerate(lengths.tolist()):
        room = tree.tightest(length)
        if room is None:
            room, sequence = window, opened
            opened += 1
        else:
            sequence = tree.take(room)
        sequences[k], offsets[k] = sequence, window - room
        if room > length:
            tree.add(room - length, sequence)
    return sequences, offsets


def pack(documents: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, pieces_per_shard: int = 32768, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece with its sequence and its offset there.

    ``pieces_per_shard`` bounds what a task holds; each shard leaves at most a
    few windows that better company could have filled.  The largest sequence
    number of a shard is below its number of pieces, so that shard * 2**32 keeps
    numbers of different shards apart.
    """
    pieces = materialise(cut(documents, tokenizer, window, end_id, id_column, text_column))
    shards = max(1, math.ceil(pieces.count() / pieces_per_shard))
    # Pieces of equal content differ in nothing a hash can see; a row number
    # within the partition of the written table keeps groups of copies apart.
    dealt = pieces.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(shards)).cast("long")
    )

    def place(key: tuple, shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("row", "ascending")])
        sequences, offsets = best_fit_decreasing(shard["length"].to_numpy(), window)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        base = key[0].as_py() << 32
        return pa.table([*(shard[n] for n in names), pa.array(sequences + base), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    return dealt.groupBy("shard").applyInArrow(place, PACKED)
