"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator expects.

    Shuffle partitions, memory and the checkpoint folder are left to the cluster.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Rows hold whole texts, so batches are kept short.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; a
    cluster must name one that all executors see.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _own_folders:
        _own_folders[application] = tempfile.mkdtemp(prefix="lectern-")
    return _own_folders[application]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: The stages of the innermost ``scratch``.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that values which
    depend on the physical layout are fixed once and survive lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    stages = _scratch.get()
    if stages is not None:
        stages.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete what is materialised inside once it is left, also by an error. What outlives it is
    written by the function it gives, which is ``materialise`` for that."""
    stages: list[str] = []
    token = _scratch.set(stages)

    def kept(df: DataFrame, label: str = "result") -> DataFrame:
        written = materialise(df, label)
        outer.append(stages.pop())
        return written

    outer: list[str] = []
    try:
        yield kept
    finally:
        _scratch.reset(token)
        above = _scratch.get()
        if above is not None:
            above.extend(outer)
        discard(spark, *stages)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stages whose results have been read."""
    jvm = spark._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that Python is handed at a time where each holds a whole file.
FILE_BATCH_BYTES = 8 << 20


@contextmanager
def file_batches(spark: SparkSession, most: int = FILE_BATCH_BYTES) -> Iterator[None]:
    """Jobs that run inside hand rows to Python in batches of about ``most`` bytes, or of one row;
    a lower setting stays. Otherwise each worker holds what Spark's own bound allows (64 MB)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    if before is not None and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= most:
        yield
        return
    spark.conf.set(name, most)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def together(spark: SparkSession, *jobs: Callable[[], Any]) -> list[Any]:
    """Run independent actions at the same time, so that the tail of one job does not leave
    executors idle; the first failure is raised."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [job.result() for job in running]


def ship_package(spark: SparkSession, *packages: str) -> None:
    """Make this package, and others beside it, importable in Python workers (as
    ``--py-files`` would)."""
    root = Path(__file__).resolve().parent.parent
    # Spark takes one archive of a name, so each has its own.
    archive = Path(tempfile.mkdtemp(prefix="lectern-package-")) / f"lectern-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for package in ("lectern", *packages):
            for file in sorted((root / package).rglob("*.py")):
                out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
