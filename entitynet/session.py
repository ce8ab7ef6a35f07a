"""Session settings and lineage control."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

_folders: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def session(name: str = "entitynet", master: str | None = None, **conf) -> SparkSession:
    """A session with AQE, skew joins and ANSI on. Sizing is left to the cluster."""
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _run_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, removed when the application ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            shared = tempfile.mkdtemp(prefix="entitynet-")
        folder = f"{shared.rstrip('/')}/entitynet-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
        _folders[sc.applicationId] = folder
    return _folders[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written table.

    Iterative jobs call this once per round: a lost executor costs a re-read, the plan does
    not grow, and the next round is planned with the table's real size. (A checkpointed
    DataFrame keeps the estimates of the plan it came from, which multiply over the rounds.)
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._cut_path = path
    if _scopes:
        _scopes[-1].append(written)
    return written


@contextmanager
def scope() -> Iterator[None]:
    """Release, at the end, every table that ``cut`` writes inside, but for those given to ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        for written in _scopes.pop():
            release(written)


def keep(written: DataFrame) -> DataFrame:
    """Hand a table of the innermost scope, if there is one, on to the one around it."""
    if not _scopes:
        return written
    inner = _scopes[-1]
    inner[:] = [x for x in inner if x is not written]
    if len(_scopes) > 1:
        _scopes[-2].append(written)
    return written


def release(written: DataFrame) -> None:
    """Delete a table that ``cut`` returned and that nothing reads any more."""
    if (name := vars(written).pop("_cut_path", None)) is not None:
        sc = written.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> str:
    """A new path in this application's shared folder."""
    return f"{_run_folder(spark)}/{uuid.uuid4().hex}"
