"""Session factory and the two services every multi-pass operator needs: a
shared folder for intermediate tables and a checked broadcast."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows below which a lookup side may be broadcast; beyond it callers shuffle.
BROADCAST_ROWS = 50_000

_written: list[tuple[object, str]] = []
_shipped: set[str] = set()


def build_session(master: str | None = None, app: str = "marlstone", **conf: object) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; `conf` wins over these."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).config(map=base)
    spark = (builder.master(master) if master else builder).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once: they may run
    elsewhere or without its folder on their path. The driver serves the file."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="marlstone-")
    path = os.path.join(folder, "marlstone_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
    atexit.register(shutil.rmtree, folder, True)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.
    Only where a local master names none (tests) a folder of this machine; a
    cluster without one is an error, as its machines would not see each other's."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "marlstone-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def release() -> None:
    """Remove the intermediate tables written so far. Results that read them must
    have been written or collected before; done by itself when the driver ends."""
    while _written:
        spark, path = _written.pop()
        try:
            hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


atexit.register(release)


def track(spark: SparkSession, path: str) -> str:
    """`path`, to be removed when the driver ends."""
    _written.append((spark, path))
    return path


def stored(df: DataFrame, label: str = "t") -> DataFrame:
    """Write `df` once as Parquet into the shared folder and read it back: cuts
    the lineage, survives the loss of executors, keeps column pruning. The
    files are removed when the driver ends."""
    spark = df.sparkSession
    path = track(spark, f"{shared_dir(spark)}/marlstone-{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where it has fewer partitions than these (a few small
    files); otherwise as it is. For steps that cost more than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lookup_join(left: DataFrame, right: DataFrame, on: list, how: str, right_rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a lookup side of counted size: broadcast up to `limit` rows,
    a shuffled join (split by adaptive execution where skewed) beyond."""
    return left.join(F.broadcast(right) if right_rows <= limit else right, on, how)
