"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "skein") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SKEIN_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package's code to the Python workers, once per application.

    Not needed, and not done, where local workers find it by PYTHONPATH.
    """
    context, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_skein_shipped", False):
        return
    context._skein_shipped = True
    if context.master.startswith("local") and str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    made = Path(tempfile.mkdtemp(prefix="skein-code-")) / "skein.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted((root / "skein").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(made))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where the setting is absent a local session (tests) makes and sets a temporary folder; a
    cluster must name one, since its machines share no local folder.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="skein-shared-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what runs here when it ends; its result is in files by then."""
    before = spark.conf.get(_DROP, None)
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP)
        else:
            spark.conf.set(_DROP, before)


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, cutting its lineage.

    Unlike executor-local caches the files survive the loss of any executor. They are removed
    when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skein-{name}-{uuid.uuid4().hex}"
    with _dropping_shuffles(spark):
        df.write.parquet(path, compression=codec)
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove the files of frames that ``materialize`` returned; they can't be read afterwards."""
    for df in frames:
        entry = (df.sparkSession, df._written)
        if entry in _WRITTEN:
            _WRITTEN.remove(entry)
            _remove(*entry)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys to as many tasks as the session shuffles to.

    For work that is heavy for its bytes, such as fitting models per key: Spark would else join
    small partitions until few tasks are left.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):
            _remove(spark, path)
