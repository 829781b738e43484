"""Streaming incident upsert.

Two stored tables stand behind a stream: the reports, and for every mission its merged incidents with the place in the order of
reports up to which they are merged.  A batch reads the state of the missions it touches and walks on from there; other missions
are not opened.  A mission with a report from before its mark is merged again from its stored reports, so the result is
that of the batch merge whatever the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skysift.lineage import cut
from skysift.operators import merging
from skysift.operators.incidents import finish
from skysift.sources.versioned import BUCKETS, VersionedTable

STATE = f"{merging.STATE}, frames array<long>, n long, mark_frame long, mark_seq long"
RADIUS = 2.0


def tables(spark: SparkSession, folder: str, reports: DataFrame, buckets: int = BUCKETS) -> tuple[VersionedTable, VersionedTable]:
    return VersionedTable(spark, f"{folder}/reports", reports.schema, buckets), VersionedTable(spark, f"{folder}/state", STATE, buckets)


def apply_batch(batch: DataFrame, batch_id: int, folder: str, buckets: int = BUCKETS) -> None:
    """Merge the reports of a batch into the state of the missions it touches.

    Both tables remember the last batch, so a batch that is repeated after a failure is applied once to each.
    """
    log, state = tables(batch.sparkSession, folder, batch, buckets)
    if state.applied is not None and batch_id <= state.applied:
        return
    rows = cut(batch)
    log.append(rows, batch_id)
    place = F.struct("frame_idx", "seq")
    touched = cut(rows.groupBy("mission_id").agg(F.min(place).alias("first"), F.max(place).alias("last")))
    known = cut(state.of_missions(touched))
    marks = known.groupBy("mission_id").agg(F.max(F.struct("mark_frame", "mark_seq")).alias("mark"))
    mark = F.struct(F.col("mark.mark_frame").alias("frame_idx"), F.col("mark.mark_seq").alias("seq"))
    judged = cut(
        touched.join(marks, "mission_id", "left").select(
            "mission_id", (F.col("mark").isNotNull() & (F.col("first") < mark)).alias("late"),
            F.when(F.col("mark").isNotNull() & (mark > F.col("last")), mark).otherwise(F.col("last")).alias("_mark"),
        )
    )
    late = judged.filter("late").select("mission_id")
    entry = known.join(late, "mission_id", "left_anti")
    due = rows.join(late, "mission_id", "left_anti").unionByName(log.of_missions(late))
    answers = cut(merging.walk(due, F.col("track_id"), RADIUS, merging.ByTrack, [], entry.drop("frames", "n", "mark_frame", "mark_seq")))
    merged = merging.collected(answers, entry).join(judged, "mission_id").select(
        "*", F.col("_mark.frame_idx").alias("mark_frame"), F.col("_mark.seq").alias("mark_seq")
    )
    state.replace_missions(merged, touched, batch_id)


def read_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """The incident table as of the last whole batch."""
    return finish(VersionedTable(spark, f"{folder}/state", STATE).read().drop("mark_frame", "mark_seq"), "INC-%03d")


def incident_stream(reports: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the incident table of ``folder`` (``read_incidents``) up to date with a report stream.

    Arrival order is the order of frames, as in the batch merge; a late report costs a new merge of its mission.
    """
    return (
        reports.writeStream.foreachBatch(lambda df, i: apply_batch(df, i, folder, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
