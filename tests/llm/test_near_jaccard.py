"""The near-duplicate stage against brute force over 5-word shingle sets."""

from __future__ import annotations

import random
import re
import time

import numpy as np

import corpus_pipeline
from codequarry.llm import common, near_jaccard


def plain_shingles(text: str | None) -> set:
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def plain_stay(rows: list[tuple]) -> set:
    """Indexes of the rows that stay, by all pairs."""
    sets, group = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return {min((k for k in range(len(rows)) if group[k] == g), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)) for g in set(group)}


def edited(words: list[str], edits: int, rng: random.Random) -> list[str]:
    made = list(words)
    for at in rng.sample(range(len(made)), edits):
        made[at] = f"new{rng.random()}"
    return made


def planted(families: int = 60) -> list[tuple]:
    rng, rows = random.Random(5), []
    for family in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((3, 30, 120, 400)))]
        rows.append(" ".join(base))
        for edits in (1, 2, 3, 4, 5):
            rows.append(" ".join(edited(base, min(len(base), max(edits, len(base) * edits // 100)), rng)))
    rng.shuffle(rows)
    return [*enumerate(rows, 1)]


def test_stage_equals_brute_force(spark, monkeypatch):
    rows = planted()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = sorted(rows[k][0] for k in plain_stay(rows))
    assert len(wanted) < len(rows) - 60
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "unused").collect()) == wanted
    assert sorted(r.doc_id for r in near_jaccard.keep_first(frame, chunk=2).collect()) == wanted
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(r.doc_id for r in near_jaccard.keep_first(frame).collect()) == wanted


def test_null_and_repeated_numbers(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(None, text), (None, text + " a"), (7, text + " b"), (7, text + " c"), (None, "alone"), (None, "apart"), (9, None), (10, " \n "), (3, "twice"), (3, "twice"), (None, "x y"), (None, "X  y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.near_dedup(spark, frame, "unused").collect()
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == [3, 7, 9]
    assert sorted((r.text or "").lower().split() for r in found if r.doc_id is None) == [["alone"], ["apart"], ["x", "y"]]


def test_bands_meet_at_the_threshold():
    rng = np.random.default_rng(3)
    for size in (5, 45, 450):
        for _ in range(300):
            common = rng.integers(0, 1 << 63, size * 8, np.uint64)
            a, b = (np.concatenate([common, rng.integers(0, 1 << 63, size, np.uint64)]) for _ in range(2))
            assert (near_jaccard.band_keys(np.unique(a)) == near_jaccard.band_keys(np.unique(b))).any()


def test_a_large_group_is_linked_by_its_hub(spark, monkeypatch):
    """Near copies of one text are linked by stars, and no cell of pairs is made; a chain needs cells of its pieces."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    copies = [" ".join(edited(base, 1, rng)) for _ in range(300)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(copies)], "doc_id long, text string")
    cells = []
    pairs = near_jaccard.piece_links
    monkeypatch.setattr(near_jaccard, "piece_links", lambda texts, pieces, *rest: cells.append(pieces.count()) or pairs(texts, pieces, *rest))
    assert near_jaccard.keep_first(frame, chunk=16).count() == 1 and not cells
    words, chain = [f"v{k}" for k in range(100)], []
    for k in range(40):
        chain.append((1000 + k, " ".join(words)))
        words = words[3:] + [f"v{100 + 3 * k + n}" for n in range(3)]
    rows = [*((k, t) for k, t in enumerate(copies)), *chain]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (4, 1024):
        assert {r.doc_id for r in near_jaccard.keep_first(frame, chunk=chunk).collect()} == {rows[k][0] for k in plain_stay(rows)}
    assert cells and max(cells) <= 40


def test_simhash_names_candidates(spark, monkeypatch):
    """Without a single band key, near fingerprints alone lead to links, and only to those that the sets bear out."""
    rng = random.Random(11)
    print_of = lambda text: near_jaccard.majority(near_jaccard.shingles(text))
    rows, fit, unfit = [], 0, 0
    while fit < 20 or unfit < 5:
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        other = edited(base, rng.choice((1, 4)), rng)
        if (print_of(" ".join(base)) ^ print_of(" ".join(other))).bit_count() > near_jaccard.RADIUS:
            continue
        similar = near_jaccard.alike(*(near_jaccard.shingles(" ".join(w)) for w in (base, other)))
        fit, unfit = fit + similar, unfit + (not similar)
        rows += [(2 * len(rows) + 1, " ".join(base), True), (2 * len(rows) + 2, " ".join(other), not similar)]
    none = spark.createDataFrame([], "node long, least long, n long")
    monkeypatch.setattr(near_jaccard, "_votes", lambda nodes, count: none)
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "unused").collect()}
    assert found == {r[0] for r in rows if r[2]}


def test_files_of_finished_steps_are_removed(spark, monkeypatch):
    """The shuffle files of a step go as soon as its table is written, whether the driver collects garbage or not."""
    rng = random.Random(13)
    base = [f"w{k}" for k in range(100)]
    frame = spark.createDataFrame([(k, " ".join(edited(base, 1, rng))) for k in range(100)], "doc_id long, text string")
    context, disk = spark.sparkContext._jsc.sc(), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    first, frames, write = context.newShuffleId(), [], type(frame).checkpoint
    monkeypatch.setattr(type(frame), "checkpoint", lambda self, *a, **b: frames.append(self) or write(self, *a, **b))  # none is garbage

    def held() -> int:
        return len({n for n in map(int, re.findall(r"\bshuffle_(\d+)_", disk.getAllFiles().mkString(" "))) if n > first})

    made = near_jaccard.keep_first(frame)
    steps, until = context.newShuffleId() - first, time.monotonic() + 10
    while held() > steps // 4 and time.monotonic() < until:
        time.sleep(0.2)
    assert steps > 40 and held() <= steps // 4
    assert made.count() == 1
