"""Tables in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it names none, a session on one machine gets a folder of its
    own; on a cluster no folder of this machine would do, and that is an error."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not said:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        said = tempfile.mkdtemp(prefix="brindle-")
        spark.sparkContext.setCheckpointDir(said)
    return said.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it has it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


_OPEN: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Removes what operators wrote into the shared folder meanwhile. Their results are read from such tables lazily, so a result that is
    used later is written inside, by :func:`table`, and taken out by :func:`kept`."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN[:] = [m for m in _OPEN if m is not made]
        for path in made:
            fs, at = file_system(spark, path)
            fs.delete(at, True)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which :func:`temporary` removes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _OPEN[-1:]:
        made.append(path)
    return path


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns the table read again: lineage ends here,
    so a lost executor costs a reread and not the work before it."""
    path = own_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def kept(df: DataFrame) -> DataFrame:
    """A table of :func:`table` that outlives its :func:`temporary`; one around that takes it over."""
    path = getattr(df, "_brindle_path", None)
    for k, made in enumerate(_OPEN):
        if path in made:
            made.remove(path)
            if k:
                _OPEN[k - 1].append(path)
            break
    return df


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables of :func:`table` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_brindle_path", None)
        if path:
            kept(df)
            fs, at = file_system(spark, path)
            fs.delete(at, True)
