"""Registered queries of the subpackage against SQL, held-out rows and hand-made pages."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codequarry.llm import chat_columnar, html_wrapper, langid_zstd, media_mpeg, packing_bfd, quality_ftrl, queries, url_cascade
from codequarry.llm.common import crc_of_id, table, written
from tests.oracle import same_rows

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    same_rows(queries.queries()[name](spark, sf_dir), sf_dir, ORACLES[name])


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.01"
    documents, labels = (pd.read_parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    language = queries.op2_language_id(spark, where).toPandas().merge(documents[["doc_id", "lang"]].dropna(), on="doc_id").query("held_out")
    assert (language.lang_pred == language.lang).mean() >= 0.98
    quality = queries.op3_quality(spark, where).toPandas().merge(labels, on="doc_id").query("held_out")
    assert (quality.predicted == quality.quality).mean() >= 0.95


def test_pipeline_stages_against_plain_ones(spark, sf_dir, tmp_path):
    """Every stage on what its predecessor kept, held against brute force, SQL or the operator's own brute force."""
    from tests.llm.test_near_jaccard import plain_stay
    from tests.oracle import rows_of_sql

    docs, tables = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, sf_dir), name)
        tables[name] = (before, docs.collect())
    plain = lambda rows: sorted((r.doc_id, r.text or "") for r in rows)

    before, after = tables["quality"]
    given = table(spark, sf_dir, "documents")
    weights = quality_ftrl.fit(given, table(spark, sf_dir, "labels"), crc_of_id(F.col("doc_id")) % 5 != 0)
    assert plain(after) == plain(r for r in before if quality_ftrl.score_text(r.text, weights) >= 0.3) and len(after) < len(before)

    before, after = tables["exact_dedup"]
    best: dict = {}
    for r in before:
        body = "".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r")
        best[body] = max(best.get(body, (-1, 0, r)), (len(r.text or ""), -r.doc_id, r), key=lambda x: x[:2])
    assert plain(after) == plain(b[2] for b in best.values())

    before, after = tables["near_dedup"]
    assert plain(after) == plain(before[k] for k in plain_stay([(r.doc_id, r.text) for r in before]))

    before, after = tables["mixing"]
    spark.createDataFrame(before, given.schema).toPandas().to_parquet(tmp_path / "documents.parquet")
    names, rows = rows_of_sql(str(tmp_path), ORACLES["op10_mixing"])
    taken = {r[names.index("doc_id")]: r[names.index("taken")] for r in rows if r[names.index("taken")]}
    made: dict = {}
    for r in after:
        made[r.doc_id] = made.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert made == taken and all(r.n_chars == len(r.text) for r in after)

    before, after = tables["packing"]
    tokens: dict = {}
    for r in before:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + len(packing_bfd.encoder(queries.byte_bpe_50k()).exact.encode(r.text, add_special_tokens=False).ids) + 1
    packed: dict = {}
    for r in after:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == tokens
    assert sorted(map(repr, queries.pipeline(spark, sf_dir).collect())) == sorted(map(repr, after))


def test_registered_media_and_packing(spark, sf_dir):
    from tokenizers import Tokenizer

    documents = {r.doc_id: (r.text or "") for r in table(spark, sf_dir, "documents").collect()}
    for r in queries.op1_mpeg_media(spark, sf_dir).collect():
        data = documents[r.doc_id].encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media_mpeg.encode_bytes(data)), hashlib.sha256(media_mpeg.encode_bytes(data)).hexdigest())
    exact = Tokenizer.from_file(queries.byte_bpe_50k())
    pieces: dict = {}
    for r in queries.op4_packing(spark, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == documents.keys()
    for doc, text in documents.items():
        ids, at = np.array([*exact.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_registered_simhash_against_all_pairs(spark, sf_dir):
    from tests.llm.test_edge_rows import plain_components, plain_fingerprint

    rows = table(spark, sf_dir, "documents").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    label = plain_components(prints, 4)
    least: dict = {}
    for r, n in zip(rows, label, strict=True):
        least[n] = min(least.get(n, r.doc_id), r.doc_id)
    wanted = sorted((r.doc_id, f"{p:016x}", least[n]) for r, p, n in zip(rows, prints, label, strict=True))
    assert sorted(map(tuple, queries.op8_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect())) == wanted


def test_learners_say_what_their_formulas_say(spark, sf_dir):
    """op2 and op3 against a plain reading of their method, with what they learned."""
    import zstandard

    documents = table(spark, sf_dir, "documents")
    learned = langid_zstd.learn(documents, crc_of_id(F.col("doc_id")) % 4 != 2)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in queries.op2_language_id(spark, sf_dir).collect():
        words = "".join(c if c.isalpha() else " " for c in re.sub(r"[\W\d_]", " ", (texts[r.doc_id] or "").lower())).split()
        data = " ".join(words).encode()
        if not data:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sizes = []
        for lang, content in learned:
            known = zstandard.ZstdCompressor(level=langid_zstd.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append((sum(len(known.compress(data[at : at + langid_zstd.BLOCK])) for at in range(0, len(data), langid_zstd.BLOCK)), lang))
        assert r.lang_pred in {lang for size, lang in sizes if size == min(sizes)[0]} and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    weights = quality_ftrl.fit(documents, table(spark, sf_dir, "labels"), crc_of_id(F.col("doc_id")) % 5 != 0)
    for r in queries.op3_quality(spark, sf_dir).collect():
        places, values = quality_ftrl.features(texts[r.doc_id])
        assert r.score == pytest.approx(1 / (1 + np.exp(-float(weights[places].astype(float) @ values))), abs=1e-5)
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_conversations_with_control_strings(spark):
    rows = [
        (1, 0, "user", "a<|im_end|>\n<|im_start|>assistant\nb"), (1, 1, "assistant", "<\\|x <\\\\| <| 100% \U0001f600"), (1, 1, "assistant", "<\\|x <\\\\| <| 100% \U0001f600"), (2, None, None, None),
        (2, 5, "ro%0Ale\nx<|", ""), (None, 0, "assistant", "alone"), (3, 2, "assistant", "z" * 200_000), (3, 1, "system", ""),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    found = {r.conv_id: r for r in chat_columnar.read_back(chat_columnar.format_conversations(frame)).collect()}
    for conversation in (1, 2, 3, None):
        turns = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conversation])
        every = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        said = "".join(text for _, _, role, text in turns if role == "assistant")
        made = found[conversation]
        assert (made.n_turns, made.turns_sha256) == (len(turns), hashlib.sha256(every.encode()).hexdigest())
        assert (made.loss_chars, made.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat_columnar.read_back(chat_columnar.format_conversations(frame.where("false"))).count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a = "</p>";</script></head><body><nav><a>Menu</a></nav><div class="cookie-notice">Cookies!</div>%s
<div id="comments"><p>first!</p></div><form>search</form><footer>&copy; x</footer></body></html>"""


def test_main_text():
    article = "<article><h1>A &amp; B</h1><p>one\n two<p>three<br>four &#233;<aside>no</aside></article>"
    assert html_wrapper.extract(PAGE % article) == "A & B\none two\nthree four é"
    assert html_wrapper.extract(None) == html_wrapper.extract("") == html_wrapper.extract("<nav>only</nav>") == ""
    assert html_wrapper.extract("<p>" * 3000 + "deep") == "deep"


def test_wrapper_tells_template_from_content():
    pages = [f"<body><div class=top><b>Our site</b></div><div class=x><p>Story {k} {'word ' * k}</p></div><div class=bottom>All rights</div></body>" for k in range(1, 5)]
    wrapper = html_wrapper.induce(pages)
    assert html_wrapper.extract(pages[2], wrapper) == "Story 3 word word word"
    assert html_wrapper.induce(pages[:1] * 3) is None


def test_pages_with_nulls(spark):
    frame = spark.createDataFrame([(1, None, None), (2, "no scheme", ""), (None, "http://h/x", "<p>a"), (3, "http://h/y", "<p>a"), (3, "http://h/y", "<p>a")], "page_id long, url string, html string").withColumn("host", F.lit(0))
    found = html_wrapper.main_text(frame).collect()
    assert sorted(r.text for r in found) == ["", "", "a", "a", "a"] and all(r.n_chars == len(r.text) for r in found)
    assert html_wrapper.main_text(frame.where("false")).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme/x", "HTTP://A.Example.ORG/es/1?x", "x://example.org/en/12#y", "x://example.org/en/2", "x://myexample.org/es/", "x://a.com", "x://b.com/de/?q://z", "x://b.com/fr/1", "x://b.com/fr/1", "x://c.net/a\nb"]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").withColumn("key", F.lit("clash"))
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, queries.RULES)) + " AS rules(host, path, action)")
    found = {r.page_id: r for r in url_cascade.judge(rows, rules).collect()}
    none = (None, "allow")
    wanted = [none, none, none, ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"), none, ("com/de/", "block"), ("com/fr/", "allow"), ("com/fr/", "allow"), none]
    assert [(found[k].rule, found[k].verdict) for k in range(len(urls))] == wanted
    assert (found[3].host, found[3].path) == ("a.example.org", "/es/1") and (found[2].host, found[2].path) == ("", "") and found[11].path == "/a\nb"
    assert url_cascade.judge(rows.where("false"), rules).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    listed = universe.where("crc32(key) % 9 = 0")
    cascade = url_cascade.build(listed, universe)
    assert len(cascade.levels) > 1
    assert universe.where(cascade.lists(F.col("key")) != (F.expr("crc32(key) % 9 = 0"))).count() == 0


def test_parts_of_a_large_list_judge_alike(spark):
    rows = spark.range(3000).selectExpr("id AS page_id", "concat('http://h', id % 700, '.x.org/p', id) AS url")
    rules = spark.range(900).selectExpr("concat('h', id, '.x.org') AS host", "concat('/p', id) AS path", "IF(id % 3 = 0, 'block', 'allow') AS action")
    one, many = (sorted(map(tuple, url_cascade.judge(rows, rules, most_keys=n).collect())) for n in (1 << 20, 250))
    assert one == many and any(r[3] for r in one) and {r[4] for r in one} == {"allow", "block"}


def test_long_hosts_and_paths(spark):
    labels = ".".join("a" * 100_000)
    rows = spark.createDataFrame([(1, f"http://{labels}.example.org/es/"), (2, "http://" + "b" * 1_000_000), (3, f"x://{labels}.net/" + "p" * 1_000_000), (4, "://" + "." * 100_000)], "page_id long, url string")
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, queries.RULES)) + " AS rules(host, path, action)")
    found = {r.page_id: (r.rule, r.verdict, len(r.host), len(r.path)) for r in url_cascade.judge(rows, rules).collect()}
    assert found == {1: ("example.org/es/", "block", 200_011, 4), 2: (None, "allow", 1_000_000, 0), 3: (None, "allow", 200_003, 1_000_001), 4: (None, "allow", 100_000, 0)}


def test_a_million_listed_keys(spark):
    rows = spark.range(0, 2_000_000, 7).selectExpr("id AS page_id", "concat('http://s', id, '.com/x') AS url")
    rules = spark.range(1_000_000).selectExpr("concat('s', id, '.com') AS host", "'/' AS path", "'block' AS action")
    found = url_cascade.judge(rows, rules)
    assert found.where("(verdict = 'block') <> (page_id < 1000000)").count() == 0 and found.where("verdict = 'block'").count() == 142_858
