"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that the contracts call white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one only under a local master where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or _private())
    return named or context.getCheckpointDir()


@functools.cache
def _private() -> str:
    """A folder of this process for a local master, removed at its end."""
    path = tempfile.mkdtemp(prefix="codequarry-checkpoints-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def materialise(frame: DataFrame) -> DataFrame:
    """Compute ``frame`` once into the shared checkpoint folder and cut its lineage.

    A reliable checkpoint lives in storage that every executor reads, so a lost
    executor costs nothing that was finished before.
    """
    checkpoint_root(frame.sparkSession)
    return frame.checkpoint(eager=True)


def settled(frame: DataFrame) -> DataFrame:
    """``materialise`` for a frame that nothing else reads: what its shuffles left on disk goes at once.

    Spark removes such files when the driver's collector happens to find that
    nothing refers to them, and those of many small steps pile up until then.
    """
    table = materialise(frame)
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        files = frame.sparkSession.sparkContext._jsc.sc().shuffleDriverComponents()
        for shuffle in list(plan.context().shuffleIds().keySet()):
            files.removeShuffle(shuffle, False)
    return table


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/codequarry/{spark.sparkContext.applicationId}"


def forget(spark: SparkSession) -> None:
    """Remove this application's written tables, when no frame that reads them is wanted any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(frame: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``frame`` as Parquet below the shared folder, in folders by a column if wanted, and return the table read back."""
    spark = frame.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    (frame.write.partitionBy(by) if by else frame.write).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Keys with more than 1 in so many of all rows are joined by broadcast: there are at most so many of them.
HEAVY_KEYS = 20_000


def moved(side: DataFrame) -> DataFrame:
    """``side`` of a join that is shuffled and merged, however small it turns out to be: no copy of it passes the driver."""
    return side.hint("merge")


def join_one(many: DataFrame, one: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner", least: int = 256) -> DataFrame:
    """``many`` joined (``inner`` or ``left``) with ``one``, which has one row a key; no key becomes one long task.

    ``one`` should be materialised.  Its column ``weight`` counts the key's rows in
    ``many``, and ``total`` is the rows of ``many``.  Keys above ``limit`` rows are
    at most total / limit <= ``HEAVY_KEYS``, so this part of ``one`` is broadcast
    and its rows of ``many`` stay where they are; all other keys are shuffled.
    """
    limit = max(least, -(-total // HEAVY_KEYS))
    heavy, light = one.where(F.col(weight) > limit).drop(weight), moved(one.where(F.col(weight) <= limit).drop(weight))
    if heavy.isEmpty():
        return many.join(light, keys, how)
    stay = many.join(F.broadcast(heavy), keys)
    move = many.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return stay.unionByName(move)


def map_batches(
    frame: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    return frame.mapInArrow(function, schema)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores in front as keep them apart from the columns of ``frame``."""
    known, front = {c.lower() for c in frame.columns}, ""
    while known & {f"{front}{n}".lower() for n in names}:
        front += "_"
    return [front + n for n in names]


def _plain_scan(frame: DataFrame) -> bool:
    """If ``frame`` is a table of files with columns or rows left out, and each row of it one row of a file."""
    plan = frame._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def numbered(documents: DataFrame, label: str) -> tuple[DataFrame, str, str]:
    """``documents`` with a stable name for every row, and the two columns that are the name.

    A row is named by its file (64 bits of a hash of the path) and its place in
    it, which a lost executor or another split of the files does not change.
    What is no plain table of Parquet files is written first.
    """
    file, place = fresh(documents, "row_file", "row_place")

    def named(frame: DataFrame) -> DataFrame:
        about = frame.metadataColumn("_metadata")
        return frame.select("*", F.xxhash64(about["file_path"]).alias(file), about["row_index"].alias(place))

    if _plain_scan(documents):
        try:
            return named(documents), file, place
        except AnalysisException:  # files of another kind have no row index
            pass
    return named(written(documents, label)), file, place


#: Row names up to this many are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000


def without_rows(named: DataFrame, file: str, place: str, leave: DataFrame) -> DataFrame:
    """What ``numbered`` gave, without the rows that ``leave`` (file, place) names; texts move only if it names very many."""
    held = leave.count()
    rows = leave.select(F.col("file").alias(file), F.col("place").alias(place))
    kept = named.join(F.broadcast(rows) if held <= BROADCAST_ROWS else rows, [file, place], "left_anti")
    return kept.drop(file, place)


def crc_of_id(doc_id: Column) -> Column:
    """CRC-32 of a document number written as decimal text."""
    return F.crc32(doc_id.cast("string").cast("binary"))
