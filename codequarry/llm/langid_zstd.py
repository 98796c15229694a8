"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from learned texts.
A text (lower-cased, letters only, words one space apart) is compressed in blocks
with every dictionary; the language whose sizes sum to the least wins, and of
equal sums the one more frequent in the sample's population.  Small blocks keep
the dictionary's part in the size alive over the whole of a long text.

The dictionaries are the only thing that is fitted, on a bounded sample:
``SAMPLE_ROWS`` different texts of each language by hash order, for the
``LANGUAGES`` most frequent languages (every worker holds all dictionaries).
A dictionary has ``DICTIONARY_BYTES``, dealt evenly: short texts give all they
have, and each longer one the same number of bytes, in slices of
``SLICE_BYTES`` spread evenly over its whole length.  Texts are cut where they
lie; only slices move, and each dictionary is put together in an executor.

``rejected`` marks margins below ``MARGIN`` of the least size.  ``lang_pred`` is
the best guess all the same, and ``lang_accepted`` is ``und`` for what is rejected.

Defined results: ``und`` with score 0, rejected, for null, for texts without a
letter, and where nothing was learned; rows without text, letters or language
teach nothing; rows that say the same teach once; repeated rows are judged alike;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import map_batches, materialise

SAMPLE_ROWS, LANGUAGES, DICTIONARY_BYTES, SLICE_BYTES = 160, 256, 112_640, 352
BLOCK, LEVEL, MARGIN, TEMPERATURE = 4096, 6, 0.01, 8.0
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-cased words of letters, one space apart."""
    return _OTHER.sub(" ", (text or "").lower()).strip().encode("utf-8", "replace")


def evenly(sizes: list[int], total: int) -> list[int]:
    """How much each gives so that together they give ``total``: all alike, or all it has."""
    given, left = [0] * len(sizes), total
    for done, k in enumerate(sorted(range(len(sizes)), key=lambda k: (sizes[k], k))):
        given[k] = min(sizes[k], left // (len(sizes) - done))
        left -= given[k]
    return given


def slices(data: bytes, size: int) -> bytes:
    """``size`` bytes of ``data``: pieces spread evenly over its whole length."""
    if size >= len(data):
        return data
    count = max(1, size // SLICE_BYTES)
    part = size // count
    return b" ".join(data[k * (len(data) - part) // max(1, count - 1) :][:part] for k in range(count))


def learn(documents: DataFrame, teaches: Column, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id") -> list[tuple[str, bytes]]:
    """(language, dictionary) from the rows that teach, the most frequent language first."""
    text, lang = F.col(text_column).cast("string"), F.col(lang_column).cast("string")
    rows = documents.where(teaches & text.isNotNull() & lang.isNotNull()).select(lang.alias("lang"), F.xxhash64(F.col(id_column), text, F.lit(5)).alias("draw"), text.alias("text"))
    often = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.approx_count_distinct("draw").alias("different"))
    often = materialise(often.orderBy(F.desc("count"), "lang").limit(LANGUAGES).withColumn("share", 2 * SAMPLE_ROWS / F.col("different")))
    # only the lowest draws, twice as many as are wanted, come as far as the exact limit; copies share a draw
    low = F.shiftrightunsigned("draw", 11) * F.lit(2.0**-53) < F.col("share")
    named = rows.select("lang", "draw").join(F.broadcast(often), "lang").where(low).select("lang", "draw", "count").distinct()
    drawn = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("draw", 11), "draw")
    sample = materialise(named.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= SAMPLE_ROWS).select("lang", "draw", "count"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [letters(x.as_py()) for x in batch.column(3)]
            columns = [*(batch.column(k) for k in range(3)), pa.array([len(f) for f in found], pa.int64()), pa.array([slices(f, DICTIONARY_BYTES) for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "draw", "count", "size", "body"])

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("draw")
        bodies = [b for b in table["body"].to_pylist() if b]
        given = evenly([len(b) for b in bodies], DICTIONARY_BYTES - len(bodies))
        content = b" ".join(slices(b, n) for b, n in zip(bodies, given, strict=True))
        return pa.table({"lang": [key[0].as_py()], "count": [table["count"][0].as_py()], "content": pa.array([content], pa.binary())})

    # SAMPLE_ROWS draws of at most LANGUAGES languages: a side of bounded size
    texts = rows.join(F.broadcast(sample), ["lang", "draw"]).select("lang", "draw", "count", "text")
    bodies = map_batches(texts, cut, "lang string, draw long, count long, size long, body binary").dropDuplicates(["lang", "draw"])
    made = bodies.groupBy("lang").applyInArrow(fill, "lang string, count long, content binary").collect()  # LANGUAGES rows of DICTIONARY_BYTES at most
    return [(r["lang"], bytes(r["content"])) for r in sorted(made, key=lambda r: (-r["count"], r["lang"])) if r["content"]]


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]) -> None:
        self.compressors = []
        for lang, content in dictionaries:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            if data:
                data.precompute_compress(level=LEVEL)
            plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            self.compressors.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=data, **plain)))

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for _, c in self.compressors]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        data = letters(text)
        if not data or not self.compressors:
            return "und", 0.0, True
        sizes = self.sizes(data)
        best = min(sizes)
        score = 1 / sum(math.exp((best - s) / TEMPERATURE) for s in sizes)
        second = sorted(sizes)[1] if len(sizes) > 1 else math.inf
        return self.compressors[sizes.index(best)][0], score, second - best < MARGIN * best


def classify(documents: DataFrame, dictionaries: list[tuple[str, bytes]], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected, lang_accepted."""
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(shared.value)
        for batch in batches:
            found = [judge(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            accepted = pa.array(["und" if f[2] else f[0] for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, accepted], ["doc_id", "lang_pred", "score", "rejected", "lang_accepted"])

    chosen = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(chosen, run, "doc_id long, lang_pred string, score double, rejected boolean, lang_accepted string")
