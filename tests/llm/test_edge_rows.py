"""Awkward rows for every document operator: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from codequarry.llm import exact_dedup_lsm, langid_zstd, media_mpeg, mixing_sainte_lague, packing_bfd, quality_ftrl, simhash_bitsliced

LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(60_000))
ROWS = [
    (1, "One two three four five six.", "en", "a"), (1, "One two three four five six.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n ", "de", "b"),
    (None, "no number here", "en", "a"), (5, "One  two three four five six.", "en", "b"), (6, LONG, "en", "a"), (7, "été où ça, n'est-ce pas", "fr", None), (8, None, None, "b"), (9, "12 34 %% !!", "de", "c"),
    (10, LONG + " end", "en", "c"), (11, "<|endoftext|> a b \x00 \U0001f600", "es", "c"), (12, "été où ça, n'est-ce pas", "fr", "d"),
]
CLASHING = ("row", "digest", "sha", "bits", "key", "shard", "size", "rank", "stay_id", "_stay_id", "own_sha", "points", "plan_id", "passes", "mixed_text", "part", "draw", "place", "end", "quota")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.where("false")


TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


def bodies() -> list[str]:
    return ["".join(c for c in (r[1] or "") if c not in " \t\n\x0b\x0c\r") for r in ROWS]


def test_media_round_trip(awkward, nothing):
    found = media_mpeg.inspect(media_mpeg.encode(awkward)).collect()
    wanted = []
    for r in ROWS:
        data = (r[1] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        wanted.append((r[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found], key=key) == sorted(wanted, key=key)
    assert all("crc_bad=0" in r.feature and r.duration_us > 0 and len(r.frame_offsets) == r.payload_bytes // 576 for r in found)
    assert media_mpeg.inspect(media_mpeg.encode(nothing)).count() == 0


def test_media_foreign_bytes():
    stream = media_mpeg.encode_bytes(b"x" * 2000)
    whole = media_mpeg.inspect_bytes(stream)
    at = whole.offsets[1]
    broken = media_mpeg.inspect_bytes(stream[:at] + b"\xff\xfbjunk" * 9 + stream[at:])
    assert broken.resyncs == 1 and broken.skipped == 54 and len(broken.offsets) == len(whole.offsets) == 4
    spoiled = bytearray(stream)
    spoiled[at + 7] ^= 1  # within the protected side information
    assert media_mpeg.inspect_bytes(bytes(spoiled)).crc_bad == 1
    assert media_mpeg.inspect_bytes(b"no audio at all").offsets == [] and media_mpeg.inspect_bytes(None).duration_us == 0
    assert whole.table["frames"] == 4 and len(whole.seek_table) == 100


def test_bytes_like_a_tag_are_no_tag():
    data = b"x" * 505 + b"TAG" + b"y" * 68
    whole = media_mpeg.inspect_bytes(media_mpeg.encode_bytes(data))
    assert media_mpeg.payload_of(media_mpeg.encode_bytes(data), whole)[: len(data)] == data
    for cut in range(500, 580):
        text = b"z" * cut + b"TAG" * 40
        stream = media_mpeg.encode_bytes(text)
        assert media_mpeg.payload_of(stream, media_mpeg.inspect_bytes(stream))[: len(text)] == text
    tagged = media_mpeg.inspect_bytes(media_mpeg.encode_bytes(data) + b"TAG" + b"title".ljust(30, b"\0") + bytes(95))
    assert tagged.tags["v1:title"] == "title" and len(tagged.offsets) == 1


def plain_crc(bits: str) -> int:
    value = 0xFFFF
    for bit in bits:
        value = ((value << 1) ^ (0x8005 if (value >> 15) != int(bit) else 0)) & 0xFFFF
    return value


@pytest.mark.parametrize(
    ("head", "protected"),
    [
        (b"\xff\xfe\x94\xc0", 128), (b"\xff\xfe\x94\x00", 256), (b"\xff\xfe\x94\x50", 4 * (32 + 8)),  # layer I: mono, stereo, joint from subband 8
        (b"\xff\xfc\x14\xc0", None), (b"\xff\xfc\x84\x04", None), (b"\xff\xfc\x48\x40", None), (b"\xff\xf4\x44\xc0", None), (b"\xff\xfc\x18\xc0", None),
    ],
)
def test_checksums_of_layers_one_and_two(head, protected):
    about = media_mpeg.header(head)
    body = np.random.default_rng(5).integers(0, 256, about.length - 6, np.uint8)
    bits = "".join(f"{b:08b}" for b in body)
    if protected is None:
        # allocations in order, then two bits for every channel of a subband that has any
        channels, at, scales = 1 if about.mono else 2, 0, 0
        for band, width in enumerate(media_mpeg._allocation(about)):
            for _ in range(channels if band < about.bound else 1):
                scales += (int(bits[at : at + width], 2) > 0) * (1 if band < about.bound else channels)
                at += width
        protected = at + 2 * scales
    crc = plain_crc("".join(f"{b:08b}" for b in head[2:]) + bits[:protected])
    frame = head + crc.to_bytes(2, "big") + body.tobytes()
    found = media_mpeg.inspect_bytes(frame * 3)
    assert (found.crc_good, found.crc_bad, len(found.offsets)) == (3, 0, 3)
    spoiled = bytearray(frame)
    spoiled[6] ^= 0x80
    assert media_mpeg.inspect_bytes(bytes(spoiled) * 2).crc_bad == 2


def test_tags_of_old_versions_and_delay():
    v22 = b"ID3\x02\x00\x00" + media_mpeg._syncsafe(16) + b"TT2" + (10).to_bytes(3, "big") + b"\x00old title"[:10]
    unsync = b"ID3\x03\x00\x80" + media_mpeg._syncsafe(16) + b"TIT2" + (5).to_bytes(4, "big") + b"\0\0" + b"\x00a\xff\x00bc"
    assert media_mpeg.inspect_bytes(v22).tags == {"TT2": "old title"} and media_mpeg.inspect_bytes(unsync).tags == {"TIT2": "a\xffbc"}
    stream = bytearray(media_mpeg.encode_bytes(b"x" * 5760))
    at = stream.index(b"Xing")
    stream[at + 120 : at + 124] = b"LAME"
    at = at + 116  # this table has no quality entry
    stream[at : at + 24] = b"LAME3.100" + bytes(12) + ((100 << 12) | 220).to_bytes(3, "big")
    found = media_mpeg.inspect_bytes(bytes(stream))
    assert found.samples == 5760 and found.duration_us == (5760 - 320) * 1_000_000 // 16000


def test_language_of_awkward_rows(awkward, nothing):
    found = langid_zstd.classify(awkward, langid_zstd.learn(awkward, F.lit(True))).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    und = {r.doc_id for r in found if r.lang_pred == "und"}
    assert und == {2, 3, 4, 8, 9}
    assert langid_zstd.learn(nothing, F.lit(True)) == [] and langid_zstd.classify(nothing, []).count() == 0


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 1), (None, 1), (9, None), (9, 0), (9, 0)], "doc_id long, quality int")
    weights = quality_ftrl.fit(awkward, labels, F.lit(True))
    found = quality_ftrl.score(awkward, weights).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    kept = quality_ftrl.keep_good(awkward, weights)
    assert kept.columns == awkward.columns and kept.count() == sum(r.score >= quality_ftrl.THRESHOLD for r in found)
    blank = quality_ftrl.fit(nothing, labels, F.lit(True))
    assert not blank.any() and {r.score for r in quality_ftrl.score(awkward, blank).collect()} == {0.5}


def test_sparse_product_equals_its_short_form():
    weights = np.random.default_rng(1).normal(size=1 << quality_ftrl.BITS).astype(np.float32)
    for text in ("", "a", "A a a, 7 b\nc " * 9, LONG):
        places, values = quality_ftrl.features(text)
        assert quality_ftrl.score_text(text, weights) == pytest.approx(quality_ftrl.sigmoid(float(weights[places].astype(float) @ values)), abs=1e-5)


def test_packing_awkward_rows(awkward, nothing):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(TOKENIZER)
    found = packing_bfd.pack(awkward, TOKENIZER).collect()
    ids = [np.array([*exact.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in ROWS]
    wanted = sorted(zlib.crc32(i[s : s + 2048].tobytes()) for i in ids for s in range(0, len(i), 2048))
    assert sorted(r.ids_crc32 for r in found) == wanted and sum(r.length for r in found) == sum(map(len, ids))
    sequences: dict[int, list] = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing_bfd.pack(nothing, TOKENIZER).count() == 0


@pytest.mark.parametrize(
    "text", ["a" + " " * 2_000_000 + "x", " \n" * 70_000, "\u2003" * 70_000 + "\n!", "w" * 1_000_000, ("b" + "\t" * 66_000 + "\x1c") * 3 + " 's", "x" + " " * 65_535 + "y" + " " * 65_536 + "\n" * 65_537 + "z"]
)
def test_ids_of_very_long_runs(text):
    encoder = packing_bfd.encoder(TOKENIZER)
    assert encoder.ids(text).tolist() == encoder.exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [7, 64, 2048])
def test_best_fit_equals_a_plain_search(window):
    lengths = np.sort(np.random.default_rng(window).integers(1, window + 1, 400))[::-1]
    sequences, offsets = packing_bfd.best_fit_decreasing(lengths, window)
    rooms: list[int] = []
    for length, sequence, offset in zip(lengths, sequences, offsets, strict=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            assert rooms[sequence] == min(fits) and offset == window - rooms[sequence]
            rooms[sequence] -= length
        else:
            assert sequence == len(rooms) and offset == 0
            rooms.append(window - length)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_groups(awkward, nothing, digest_bytes):
    found = exact_dedup_lsm.duplicates(awkward, digest_bytes=digest_bytes).collect()
    texts = bodies()
    best: dict[str, tuple] = {}
    for r, body in zip(ROWS, texts, strict=True):
        rank = (len(r[1] or ""), r[0] is not None, -(r[0] or 0))
        best[body] = max(best.get(body, ((-1, False, 0), None)), (rank, r[0]), key=lambda x: x[0])
    wanted = sorted(((r[0] is None, r[0] or 0), best[b][1] or 0, texts.count(b), hashlib.sha256(b.encode()).hexdigest()) for r, b in zip(ROWS, texts, strict=True))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.keep_id or 0, r.group_size, bytes(r.sha).hex()) for r in found) == wanted
    kept = [r for r in found if r.kept]
    assert len(kept) == len(set(texts)) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup_lsm.duplicates(nothing).count() == 0


def test_exact_keeps_one_whole_row(awkward, nothing):
    kept = exact_dedup_lsm.keep_first(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(set(bodies()))
    assert exact_dedup_lsm.keep_first(nothing).count() == 0


def test_second_batch_meets_an_earlier_level(spark):
    named = lambda low, high: spark.range(low, high).selectExpr("id AS doc_id", "cast(id % 700 AS string) AS text", "id AS f", "id AS p")
    keyed = [exact_dedup_lsm._keyed(named(*r), "f", "p", "doc_id", "text", 32) for r in ((0, 500), (500, 600), (600, 1000), (1000, 1500))]
    index = exact_dedup_lsm.Index()
    for rows in keyed[:3]:
        index.insert(rows)
    assert [r.tier for r in index.runs] == [1, 0]  # two flushes were merged, the third stands before them
    older = {r.best.rank: r.group_size for r in index.probe(keyed[3].select("digest").distinct()).collect()}
    assert len(older) == sum(older.values()) == 600  # 1000..1499 are 300..699 and 0..99 again, and both runs hold 0..99
    index.insert(keyed[3])
    assert [r.tier for r in index.runs] == [2]
    whole = index.compact()
    assert whole.count() == 700 and whole.agg(F.sum("group_size")).first()[0] == 1500
    assert {~r.best.rank for r in whole.collect()} == set(range(700))


def test_a_filter_refuses_what_its_run_lacks(spark):
    held = spark.range(5000).selectExpr("unhex(sha2(cast(id AS string), 256)) AS digest")
    other = spark.range(5000, 10_000).selectExpr("unhex(sha2(cast(id AS string), 256)) AS digest")
    made = exact_dedup_lsm.Filter.over(held, 5000)
    assert held.where(made.may_hold(F.col("digest"))).count() == 5000 and other.where(made.may_hold(F.col("digest"))).count() < 500


@pytest.mark.parametrize("flushes", [1, 3])
def test_flushes_change_no_group(awkward, flushes):
    rows = lambda n: sorted(map(repr, exact_dedup_lsm.duplicates(awkward.select("doc_id", "text"), flushes=n).drop("kept").collect()))
    assert rows(flushes) == rows(4)


def plain_fingerprint(text: str | None, words: int = 4) -> int:
    import re

    import xxhash

    tokens = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[int], radius: int) -> list[int]:
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_simhash_against_all_pairs(awkward, nothing):
    found = simhash_bitsliced.near_duplicates(awkward).collect()
    prints = [plain_fingerprint(r[1]) for r in ROWS]
    label = plain_components(prints, 4)
    names = [min((ROWS[j][0] for j in range(len(ROWS)) if label[j] == label[i] and ROWS[j][0] is not None), default=None) for i in range(len(ROWS))]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.bits % (1 << 64), r.component_id) for r in found], key=key) == sorted([(r[0], p, n) for r, p, n in zip(ROWS, prints, names, strict=True)], key=key)
    assert simhash_bitsliced.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("chunk", [4096, 16])
def test_links_of_planted_chains(spark, chunk):
    """Chains of near fingerprints, cut into cells of several chunks as hot buckets are."""
    random = np.random.default_rng(3)
    prints = [int(x) for x in random.integers(0, 1 << 63, 150)]
    for _ in range(150):
        near = prints[int(random.integers(len(prints)))]
        for b in random.choice(64, int(random.integers(1, 7)), replace=False):
            near ^= 1 << int(b)
        prints.append(near)
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "bits long")
    links = simhash_bitsliced.link(frame, 4, chunk)
    roots = {r.node % (1 << 64): r.root for r in simhash_bitsliced.components(links).collect()}
    label = plain_components(prints, 4)
    made: dict = {}
    for p, n in zip(prints, label, strict=True):
        made.setdefault(n, set()).add(roots.get(p, ("alone", p)))
    assert all(len(x) == 1 for x in made.values()) and len(set.union(*made.values())) == len(made)


def test_mixing_awkward_rows(awkward, nothing):
    found = mixing_sainte_lague.mix(awkward).collect()
    assert len(found) == len(ROWS) and all(0 <= r.taken <= 2 * r["size"] for r in found)
    assert all(r.taken == 0 for r in found if r["size"] == 0)
    again = mixing_sainte_lague.mix(awkward).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)
    assert sorted(found, key=key)[0]["size"] == 6
    texts = mixing_sainte_lague.mixed_texts(awkward.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert texts.columns == awkward.columns and texts.count() > 0
    assert mixing_sainte_lague.mix(nothing).count() == 0 and mixing_sainte_lague.mixed_texts(nothing).count() == 0


def test_mixed_copies_are_rows_of_their_own(spark):
    rows = [(1, "a b c d", "s"), (1, "e f g h", "s"), (2, "i j", "t"), (None, "k\n\nl  m", "t"), (None, "k\n\nl  m", "u"), (None, None, "u"), (3, "", None)] + [(k, f"n{k} \n o\tp", "v") for k in range(4, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("plan_id", F.lit("clash"))
    plan, made = mixing_sainte_lague.mix(docs).collect(), mixing_sainte_lague.mixed_texts(docs)
    assert made.columns == docs.columns
    made = made.collect()
    assert sum(r.taken for r in plan) == sum(len(r.text.split()) for r in made) and {r["size"]: 1 for r in plan}.keys() == {4, 2, 3, 0}
    originals = {(r[0], r[1]) for r in rows}
    for r in made:
        assert any(r.doc_id == d and r.text in (t or "") for d, t in originals) and r.text == r.text.strip()
    wanted: dict = {}
    for r in plan:
        wanted[r.doc_id] = wanted.get(r.doc_id, 0) + r.taken
    for r in made:
        wanted[r.doc_id] -= len(r.text.split())
    assert not any(wanted.values())
    assert sorted(map(repr, made)) == sorted(map(repr, mixing_sainte_lague.mixed_texts(docs).collect()))


def test_targets_share_what_is_above_a_ceiling(spark):
    sources = spark.createDataFrame([("a", 1, 10), ("b", 1, 1000), ("c", 1, 1000), ("d", 1, 0), (None, 1, 50)], "source string, rows long, source_size long")
    found = {r.source: r for r in mixing_sainte_lague.targets(sources).collect()}
    assert found["a"].target == 20 and found["d"].target == 0 and found[None].target <= 100
    assert sum(r.target for r in found.values()) == pytest.approx(1.5 * 2060)
    open_ = [r for r in found.values() if 0 < r.target < 2 * r.source_size]
    assert len({round(r.target / r.weight, 6) for r in open_}) == 1


def test_seats_equal_highest_quotients(spark):
    votes = [53, 24, 23, 1, 0, 700, 90]
    frame = spark.createDataFrame([(k, v, 31) for k, v in enumerate(votes)], "k int, v long, seats long")
    quotients = sorted(((v / (2 * n + 1), -k) for k, v in enumerate(votes) for n in range(31)), reverse=True)[:31]
    wanted = [sum(-k == n for _, k in quotients) for n in range(len(votes))]
    assert [r.quota for r in mixing_sainte_lague.sainte_lague(frame, [], "v", "seats", "k").orderBy("k").collect()] == wanted


def test_stages_take_clashing_columns(spark, awkward, nothing, sf_dir):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES[:4]:
            made = stage(spark, docs, sf_dir)
            assert made.columns == docs.columns, name
            made.count()
        pieces = [-(-(len(packing_bfd.encoder(TOKENIZER).ids(r[1] or "")) + 1) // 2048) for r in ROWS] if docs is awkward else []
        assert corpus_pipeline.packing(spark, docs, sf_dir).count() == sum(pieces)
    assert [r.text for r in corpus_pipeline.exact_dedup(spark, awkward, sf_dir).where("doc_id IS NULL").collect()] == ["no number here"]
