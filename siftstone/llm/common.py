"""What the training-data operators share: table access, shared-folder tables, word rules.

A word is a run of code points other than ASCII white space, ``[^\\x20\\x09-\\x0D]+``.
Intermediate tables go to the folder named by ``spark.checkpoint.dir``; every executor sees it,
so a lost executor costs a task retry and never the run.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD_JAVA = r"[^\x20\x09-\x0D]+"
GAP_JAVA = r"[\x20\x09-\x0D]+"
_OTHER_SPACE = dict.fromkeys(map(ord, SPACE[1:]), " ")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for null."""
    if not text:
        return []
    if text.isascii():
        # str.split also splits at \x1c-\x1f, which are part of words here.
        if not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.split()
    return [w for w in text.translate(_OTHER_SPACE).split(" ") if w]


def words_column(text: Column) -> Column:
    """The same words as an array, inside the JVM; null text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP_JAVA), lambda w: w != "")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A folder of our own only where the setting is absent and
    driver and tasks share one machine, as in tests."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not at:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = _own.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="siftstone-")
        _own[context.applicationId] = at
    return at.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, **values: str):
    """Session settings for the length of a block; names with ``__`` for dots."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Folders of the intermediate tables that this driver has made, oldest first.
_made: list[str] = []


def own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/siftstone/{spark.sparkContext.applicationId}"


def hadoop_path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back; its shuffle files go at once.

    The folder of an application is deleted when its driver ends, tables of a `discarding` block before that.
    """
    spark = df.sparkSession
    folder = own_folder(spark)
    if not any(x.startswith(folder) for x in _made):
        path, files = hadoop_path(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard_tables(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application, once its results are written."""
    path, files = hadoop_path(spark, own_folder(spark))
    files.delete(path, True)
    _made.clear()


@contextlib.contextmanager
def discarding(spark: SparkSession):
    """Deletes the tables made inside the block but the last one, whose writing has used up the others."""
    first = len(_made)
    yield
    for at in _made[first:-1]:
        path, files = hadoop_path(spark, at)
        files.delete(path, True)
    del _made[first:-1]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *outputs: str) -> DataFrame:
    """Drops the columns that an operator is about to make, so that its own win a clash of names.

    Names that start with two underscores are the operators' own in any table that they are given.
    """
    taken = {x.lower() for x in outputs}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def check_whole_ids(df: DataFrame, id_column: str) -> None:
    if dict(df.dtypes)[id_column] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_column} must be a whole number, not {dict(df.dtypes)[id_column]}")


def byte_slices(batch, name: str, step: int = 256):
    """Slices of an Arrow batch, each with the UTF-8 bytes of one string column (None for null)."""
    import pyarrow as pa

    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, part.column(part.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def appended(batch, **columns):
    """The batch with further columns at its end."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns]
    )
