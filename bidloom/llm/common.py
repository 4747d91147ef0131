"""Pieces shared by the operators: word pattern, ASCII lower case, written tables, whole-row carrying."""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.session import scratch_dir

# A word is a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text in order; NULL has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of all tables that ``stored`` writes meanwhile."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.pop()


def most_tasks(spark: SparkSession, parts: int) -> int | None:
    """How many tasks write a table derived from one of ``parts`` parts: as many, and two for each core at least.

    None, for any number, unless shuffles have more than twice as many partitions: merging a few would only make tasks uneven. So files
    follow the data where Spark does not coalesce partitions itself. A local store starts several processes for each file, and each counts
    with the whole memory of its executor until it runs a program of its own.
    """
    least = max(parts, 2 * spark.sparkContext.defaultParallelism)
    return least if int(spark.conf.get("spark.sql.shuffle.partitions")) > 2 * least else None


def merged(df: DataFrame, tasks: int | None) -> DataFrame:
    return df.coalesce(tasks) if tasks else df


def stored(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder, by at most ``tasks`` tasks if given, and go on from the files.

    The files hold the rows against lost executors; they lie below the session's checkpoint folder and go with it.
    """
    path = scratch_dir(df.sparkSession, name)
    merged(df, tasks).write.parquet(path)
    for paths in _RECORDS:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str], but: DataFrame | None = None) -> None:
    """Delete written tables that nothing reads any more; those that ``but`` reads stay."""
    read = but.inputFiles() if but is not None else []
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        if not any(f"/{name}/" in file for file in read):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
