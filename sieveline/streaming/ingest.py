"""A stream of structured resumes, as JSON lines dropped into a folder, into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lists import all_skills
from ..schemas import RESUME
from ..sources.store import upsert


def enriched(resumes: DataFrame) -> DataFrame:
    """Resumes with skills of all sources, in order and each once."""
    return resumes.withColumn("skills_all_sources", all_skills(F.col("skills"), F.col("experience"), F.col("projects"), F.col("certifications")))


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = RESUME, once: bool = True) -> StreamingQuery:
    """Start the stream. A resume that comes again replaces the earlier; a batch that is repeated changes nothing."""
    rows = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(source)

    def store(batch: DataFrame, _: int) -> None:
        upsert(enriched(batch.where("candidate_id is not null")), target, ["candidate_id"], ["uploaded_at"])

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def score_rates(scores: DataFrame, every: str = "1 day", late: str = "3 days") -> DataFrame:
    """start, role_id, n, best of each window of a stream (or table) of scores; rows later than ``late`` are left out of a stream."""
    windowed = scores.withWatermark("scored_at", late).groupBy(F.window("scored_at", every), "role_id")
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.max("final_score").alias("best")).select(F.col("window.start").alias("start"), "role_id", "n", "best")
