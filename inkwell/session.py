"""Session helpers: building a local session, cutting lineage, shipping the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("inkwell")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else (local mode only) a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "inkwell-checkpoints")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_CUTS: list[str] = []


def sweep(spark: SparkSession) -> int:
    """Delete the tables that this process has cut; frames that still read them are lost. Returns how many there were."""
    jvm, n = spark.sparkContext._jvm, len(_CUTS)
    while _CUTS:
        path = jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def drop(df: DataFrame) -> None:
    """Delete a table that `cut` gave, once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        name = path.rpartition("/")[2]
        for own in [x for x in _CUTS if x.endswith(f"/{name}")]:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            _CUTS.remove(own)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the query that wrote them ends, not when the driver's garbage is collected.

    Only for queries that end before their call returns, such as `cut`; toLocalIterator may read tables only."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a read, and the planner
    sees the true size of the table when it chooses a join. `sweep` removes the tables."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/inkwell-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers whose path lacks it."""
    root = str(PACKAGE_ROOT.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_inkwell_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "inkwell.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(PACKAGE_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE_ROOT.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._inkwell_shipped = True
