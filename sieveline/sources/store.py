"""Tables of records on Parquet: appends, upserts by key, and the reads that screening needs.

An upserted table is a folder of Parquet folders and a log. An entry of the log names the folders that make up a version,
and is written last, in one step, so a write that fails leaves the version before it as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import placed

#: Parts of a table's latest version from which the next upsert writes it anew as one.
PARTS = 8
#: Folders that roles are hashed to.
ROLE_BUCKETS = 64


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key by ``order``; what is still equal is decided by all columns, so the result is the same every time.

    It is an aggregation, so a hot key is reduced before it is shuffled.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [F.col(o) if isinstance(o, str) else o for o in order]
    named = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(ordered)], *[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.max(named).alias("_x")).select(*[c if c in keys else F.col(f"_x.{c}").alias(c) for c in df.columns])


def role_bucket(role_id: Column) -> Column:
    return F.pmod(F.xxhash64(role_id), F.lit(ROLE_BUCKETS)).cast("int")


def stamped(scores: DataFrame, run_id: str | None = None) -> DataFrame:
    """scores with a run_id, one for all of them, and scored_at, the moment the query starts."""
    return scores.withColumns({"run_id": F.lit(run_id or str(uuid.uuid4())), "scored_at": F.current_timestamp()})


def append_scores(scores: DataFrame, path: str) -> None:
    """One write for a run, into a bounded number of folders by hash of the role: a run is there as a whole or not at all."""
    scores.withColumn("role_bucket", role_bucket(F.col("role_id"))).write.mode("append").partitionBy("role_bucket").parquet(path)


def scores_of_role(spark: SparkSession, path: str, role_id: str) -> DataFrame:
    """The scores of a role, read from its folder only."""
    return spark.read.parquet(path).where((F.col("role_bucket") == role_bucket(F.lit(role_id))) & (F.col("role_id") == role_id)).drop("role_bucket")


class _Log:
    """The log of a table: numbered files, of which the one with the greatest number holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.hadoop = spark, path.rstrip("/"), spark._jvm.org.apache.hadoop.fs
        self.folder = self.hadoop.Path(f"{self.path}/_log")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        if not self.fs.exists(self.folder):
            return []
        names = sorted(s.getPath().toString() for s in self.fs.listStatus(self.folder))
        return [json.loads(r[0]) for r in self.spark.read.option("wholetext", True).text(names).orderBy(F.input_file_name()).collect()] if names else []

    def latest(self) -> dict | None:
        if not self.fs.exists(self.folder):
            return None
        names = sorted(s.getPath().toString() for s in self.fs.listStatus(self.folder))
        return json.loads(self.spark.read.option("wholetext", True).text(names[-1]).first()[0]) if names else None

    def add(self, entry: dict) -> None:
        """Write the next entry; if another writer took its number first, this one fails and nothing changes."""
        self.fs.mkdirs(self.folder)
        text = bytearray(json.dumps(entry).encode())
        part = self.hadoop.Path(f"{self.path}/_new-{uuid.uuid4().hex}")
        out = self.fs.create(part, False)
        out.write(text, 0, len(text))
        out.close()
        target = self.hadoop.Path(self.folder, f"{entry['version']:020d}")
        if self.fs.exists(target) or not self.fs.rename(part, target):
            self.fs.delete(part, False)
            raise RuntimeError(f"version {entry['version']} of {self.path} was written by someone else")

    def remove(self, name: str) -> None:
        self.fs.delete(self.hadoop.Path(f"{self.path}/{name}"), True)


def _parts(spark: SparkSession, path: str, entry: dict) -> DataFrame:
    rows = spark.read.option("mergeSchema", "true").parquet(*[f"{path.rstrip('/')}/{p}" for p in entry["parts"]])
    return rows if len(entry["parts"]) == 1 else latest_per_key(rows, entry["keys"], entry["order"])


def upsert(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add rows to the table at ``path``, where a later row of a key replaces the earlier, and return the table.

    What is written is df itself, beside the parts the table has; only every PARTS-th upsert writes the whole table anew.
    A write that fails changes nothing, and neither does one that another writer overtook: it raises.
    """
    spark = df.sparkSession
    log = _Log(spark, path)
    old = log.latest()
    rows, parts = latest_per_key(df, keys, order), list(old["parts"]) if old else []
    if len(parts) >= PARTS:
        rows, parts = latest_per_key(_parts(spark, path, old).unionByName(df, allowMissingColumns=True), keys, order), []
    name = f"part-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(f"{path.rstrip('/')}/{name}")
        entry = {"version": (old["version"] if old else 0) + 1, "parts": [*parts, name], "keys": list(keys), "order": list(order)}
        log.add(entry)
    except BaseException:
        log.remove(name)
        raise
    return _parts(spark, path, entry)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` with columns of all its parts, or None if there is none yet."""
    entry = _Log(spark, path).latest()
    return _parts(spark, path, entry) if entry else None


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the parts that none of the last ``keep`` versions has, and return how many; for times without a writer."""
    log = _Log(spark, path)
    entries = log.entries()
    if not entries:
        return 0
    held = {p for e in entries[-max(keep, 1) :] for p in e["parts"]}
    gone = [s.getPath().getName() for s in log.fs.listStatus(log.folder.getParent()) if s.getPath().getName().startswith(("part-", "_new-")) and s.getPath().getName() not in held]
    for name in gone:
        log.remove(name)
    return len(gone)


def list_roles(jds: DataFrame) -> DataFrame:
    return jds.select("role_id", "role_title", "department", "file_name", "uploaded_at")


def latest_role(jds: DataFrame, role_id: str) -> DataFrame:
    return jds.where(F.col("role_id") == role_id).orderBy(F.col("uploaded_at").desc_nulls_last(), F.col("document_id").desc()).limit(1)


def in_list_or_all(df: DataFrame, key: str, wanted: Sequence | DataFrame | None) -> DataFrame:
    """Rows whose key is wanted; no list or an empty one means all. A DataFrame of keys is joined instead of listed."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(key).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(list(wanted))) if wanted else df


def latest_runs(scores: DataFrame) -> DataFrame:
    """role_id, run_id of the latest run of each role; of runs scored at the same moment the greater run_id."""
    return scores.where("run_id is not null").groupBy("role_id").agg(F.max(F.struct("scored_at", "run_id")).alias("x")).select("role_id", "x.run_id")


def latest_results(scores: DataFrame, resumes: DataFrame) -> DataFrame:
    """The rows of every role's latest run that have a resume, with the candidate's name."""
    rows = scores.join(latest_runs(scores), ["role_id", "run_id"], "left_semi")
    names = resumes.select("candidate_id", "candidate_name").groupBy("candidate_id").agg(F.max("candidate_name").alias("candidate_name"))
    return rows.join(names, "candidate_id")


def ranked_and_excluded(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = placed(scores, "role_id", [F.col("final_score").desc_nulls_last(), F.col("candidate_id").asc()], "place")
    failed = F.coalesce("hard_gate_failed", F.lit(False))
    return rows.where(~failed), rows.where(failed)
