"""Session settings and the helpers that every operator shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was measured and has at most this many rows and bytes of text.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def build_session(name: str = "sieveline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; settings in ``conf`` win."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sieveline-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and go on from there: a lost executor loses nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, what: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def fits(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df, counted and measured, is small enough to be broadcast: BROADCAST_ROWS rows and most_bytes of text."""
    text = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(sum(text, F.lit(0)).cast("long")), F.lit(0)).alias("b")).first()
    return row["n"] <= BROADCAST_ROWS and row["b"] <= most_bytes


def small(df: DataFrame, is_small: bool | None = None) -> DataFrame:
    """df with a broadcast hint if it fits (measured here unless told), else as it is, for a shuffled join."""
    return F.broadcast(df) if (fits(df) if is_small is None else is_small) else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that Python functions find their modules there."""
    sc = spark.sparkContext
    if getattr(sc, "_sieveline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="sieveline-")) / "sieveline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"sieveline/{f.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._sieveline_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """df in enough parts to keep every core busy in a Python stage: as it is, unless it comes in fewer parts than cores.

    Adaptive execution joins small shuffle parts by bytes, and a small file is one part, however much work a row makes.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a range partition at most, where their number is measured.
RANGE_ROWS = 2_000_000


def range_parts(df: DataFrame) -> int:
    """How many range partitions df needs: as many as shuffles have, and more where a count of its rows asks for it. df should be cut."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // RANGE_ROWS))


def spread_small(df: DataFrame) -> DataFrame:
    """A narrow table of distinct values in a fixed number of parts, for Python stages."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
