"""Chat formatting by columnar byte assembly.

A turn is written as

    <|im_start|>ROLE newline TEXT <|im_end|> newline

where ROLE and TEXT are escaped reversibly: every ``<``, backslashes, ``|`` gets
one more backslash, so that no ``<|`` of a text survives and no two texts are
written alike; in roles a newline and ``%`` are written as %0A and %25 first.

Rows are dealt by conversation and sorted by turn.  For every Arrow batch the
lengths of all segments (marks, roles, texts) are known in numpy, their
cumulative sums are the offsets, and the bytes of each column are scattered into
one preallocated Arrow buffer; no Python string is built for a turn.  A batch's
rows of one conversation are one part of its output, so that a conversation with
a third of all turns streams through its task in parts of bounded size.

Defined results: null text and role are empty; null turns come first; rows with
equal turns stand in order of role and text; repeated rows are turns of their
own; a null conversation number is a conversation; an empty table gives no
rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import map_batches

LONG = 1 << 14
START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
PARTS = "conv_id long, part long, formatted string, loss_start array<long>, loss_length array<long>"


def escaped(values: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(values, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(values: pa.Array) -> pa.Array:
    return escaped(pc.replace_substring(pc.replace_substring(values, "%", "%25"), "\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and the offsets of its values."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """Copy data[starts : starts + sizes] to out[at : at + sizes], all rows at once.

    An index is kept for every byte, so long rows, of which there are few, are copied as slices.
    """
    for k in np.flatnonzero(sizes >= LONG).tolist():
        out[at[k] : at[k] + sizes[k]] = data[starts[k] : starts[k] + sizes[k]]
    short = sizes < LONG
    at, starts, sizes = at[short], starts[short], sizes[short]
    total = int(sizes.sum())
    if total:
        within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(at, sizes) + within] = data[np.repeat(starts, sizes) + within]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, turn offsets, text offsets) of the formatted turns of one batch."""
    columns = [_bytes_of(escaped_role(roles)), _bytes_of(escaped(texts))]
    marks = np.frombuffer(START + MIDDLE + END, np.uint8)
    rows = len(roles)
    lengths = np.empty((rows, 5), np.int64)  # start mark, role, middle, text, end mark
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(START), len(MIDDLE), len(END)
    for place, (_, offsets) in zip((1, 3), columns, strict=True):
        lengths[:, place] = np.diff(offsets)
    ends = np.cumsum(lengths.reshape(-1)).reshape(rows, 5)
    begins = ends - lengths
    out = np.empty(int(ends[-1, 4]) if rows else 0, np.uint8)
    for place, low in ((0, 0), (2, len(START)), (4, len(START) + len(MIDDLE))):
        _scatter(out, begins[:, place], marks, np.full(rows, low), lengths[:, place])
    for place, (data, offsets) in zip((1, 3), columns, strict=True):
        _scatter(out, begins[:, place], data, offsets[:-1], lengths[:, place])
    return out, np.r_[begins[:, 0], len(out)], begins[:, 3]


def _formatted(batch: pa.RecordBatch, part_of: int) -> pa.RecordBatch:
    """One row for each run of a conversation in the batch."""
    conversations = batch.column(0)
    rows = batch.num_rows
    ids, valid = conversations.fill_null(0).to_numpy(zero_copy_only=False), conversations.is_valid().to_numpy(zero_copy_only=False)
    runs = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])])
    roles, texts = batch.column(1).fill_null(""), batch.column(2).fill_null("")
    out, turn_at, text_at = assemble(roles, texts)
    # masks count code points: those before a byte are the bytes that start one
    points = np.r_[0, np.cumsum((out & 0xC0) != 0x80)]
    run_of = np.repeat(np.arange(len(runs)), np.diff(np.r_[runs, rows]))
    learned = np.flatnonzero(pc.equal(roles, "assistant").to_numpy(zero_copy_only=False))
    text_end = turn_at[1:] - len(END)
    first = points[text_at[learned]] - points[turn_at[runs[run_of[learned]]]]
    sizes = points[text_end[learned]] - points[text_at[learned]]
    splits = np.searchsorted(run_of[learned], np.arange(len(runs) + 1)).astype(np.int32)
    offsets = pa.array(np.r_[turn_at[runs], len(out)], pa.int64())
    text = pa.LargeStringArray.from_buffers(len(runs), offsets.buffers()[1], pa.py_buffer(out)).cast(pa.string())
    lists = [pa.ListArray.from_arrays(pa.array(splits), pa.array(x.astype(np.int64))) for x in (first, sizes)]
    parts = pa.array(part_of + np.arange(len(runs)))
    return pa.RecordBatch.from_arrays([conversations.take(pa.array(runs)), parts, text, *lists], ["conv_id", "part", "formatted", "loss_start", "loss_length"])


def _slabs(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have about ``limit`` bytes at most."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        done = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield batch.slice(low, high - low)
        low = high


def format_conversations(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv_id, part, formatted, loss_start, loss_length (in code points of the part).

    The parts of a conversation, in order of ``part``, are its formatted text.
    They leave one task in that order, nearly always as a single part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for slab in _slabs(batch):
                out = _formatted(slab, made)
                made += out.num_rows
                yield out

    chosen = turns.select(F.col(id_column).cast("long").alias("c"), F.col(role_column).cast("string").alias("r"), F.col(text_column).cast("string").alias("t"), F.col(turn_column).alias("n"))
    placed = chosen.repartition("c").sortWithinPartitions("c", F.col("n").asc_nulls_first(), "r", "t")
    return map_batches(placed.select("c", "r", "t"), run, PARTS)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


class Digest:
    """What is read back of one conversation, part by part."""

    def __init__(self) -> None:
        self.turns, self.all, self.loss, self.loss_chars, self.chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0

    def add(self, formatted: str, starts: list[int], lengths: list[int]) -> None:
        self.chars += len(formatted)
        at = 0
        for match in _TURN.finditer(formatted):
            if match.start() != at:
                raise ValueError("the formatted text has bytes between its turns")
            at = match.end()
            self.turns += 1
            self.all.update(f"{unescape_role(match[1])}\n{unescape(match[2])}\n".encode("utf-8", "surrogatepass"))
        if at != len(formatted):
            raise ValueError("the formatted text ends within a turn")
        for start, length in zip(starts, lengths, strict=True):
            text = unescape(formatted[start : start + length])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of what ``format_conversations`` wrote, parsed from its text.

    Parts come in its order; others are refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, last = None, None, -1
        done: list[tuple] = []

        def close() -> None:
            done.append((now[0], digest.turns, digest.all.hexdigest(), digest.loss_chars, digest.loss.hexdigest(), digest.chars))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in READ.split(", ")])
            done.clear()
            return batch

        for batch in batches:
            for k in range(batch.num_rows):
                conversation = (batch.column(0)[k].as_py(),)
                if conversation != now:
                    if now is not None:
                        close()
                    now, digest = conversation, Digest()
                elif batch.column(1)[k].as_py() != last + 1:
                    raise ValueError("the parts of a conversation do not come in order")
                last = batch.column(1)[k].as_py()
                digest.add(batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), batch.column(4)[k].as_py())
            yield flush()
        if now is not None:
            close()
            yield flush()

    return map_batches(parts, run, READ)
