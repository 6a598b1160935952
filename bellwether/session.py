"""Session set-up, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session settings every query of this library assumes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

#: A side of a join is broadcast by hint only when its counted rows and its bytes stay below these.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` overrides them."""
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def measured_broadcasts(spark: SparkSession) -> None:
    """Let a side be broadcast for the size it is measured to have at run time only, or by an explicit hint.

    The planner's estimates are those of the scan: after an explode, an Arrow function or a checkpoint they are
    far too small.  The session's own threshold is kept, as the adaptive one."""
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    own = spark.conf.get(static)
    if own != "-1":
        if spark.conf.get(adaptive, None) is None:
            spark.conf.set(adaptive, own)
        spark.conf.set(static, "-1")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once, wherever they run."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    _SHIPPED.add(sc.applicationId)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    sc.addPyFile(put_shared(spark, f"{root.name}.zip", packed.getvalue()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, as a lazy scan."""
    measured_broadcasts(spark)
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests on one machine) is a temporary folder made and set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        own = named or tempfile.mkdtemp(prefix="bellwether-")
        if not named:
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return named or sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that several readers don't compute it again.

    A reliable checkpoint: it survives the loss of executors."""
    measured_broadcasts(df.sparkSession)
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def put_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Write ``data`` to a new file in the shared folder and return its URI."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(data)
    finally:
        out.close()
    return fs.makeQualified(path).toString()


def replace_file(spark: SparkSession, path: str, data: bytes, backup: str | None = None) -> None:
    """Write ``data`` to ``path`` as a whole: beside it first, then in its place; what was there goes to ``backup``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = at(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(data)
    finally:
        out.close()
    if fs.exists(at(path)):
        if backup:
            fs.delete(at(backup), False)
            fs.rename(at(path), at(backup))
        else:
            fs.delete(at(path), False)
    fs.rename(beside, at(path))


def small(side: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``side``, counted and weighed, is small enough to be broadcast."""
    weight = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    n, size = side.agg(F.count("*"), weight).first()
    return n <= rows and (size or 0) <= BROADCAST_BYTES


def join_counted(df: DataFrame, side: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is usually small: it is materialised, counted and weighed first, and only
    broadcast when it has at most ``rows`` rows and BROADCAST_BYTES; otherwise Spark shuffles both sides."""
    side = materialize(side)
    return df.join(F.broadcast(side) if small(side, rows) else side, on, how)
