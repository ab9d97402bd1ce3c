"""Late events by an exact per-event watermark, in batch and over a stream.

An event is late if its time is before the greatest event time that arrived ahead of it, less the allowed lateness.
Arrival order is (observed time, id).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.functions.durations import micros
from tidewatch.operators.prepare import prepare
from tidewatch.operators.sequence import evaluate
from tidewatch.plans.rules import Detection
from tidewatch.storage import new_path

SLICE_US = 6 * 3600 * 1_000_000


def admission(events: DataFrame, lateness: object = "5m", seed_us: int | None = None, slice_us: int = SLICE_US) -> DataFrame:
    """events with watermark_us and late. The running maximum is taken within slices of arrival time and carried over by a
    running maximum of the slices' own, so no task reads the whole stream; seed_us is the maximum before the first event."""
    arrived = events.withColumn("arrival_us", F.coalesce("observed_us", "event_us"))
    sliced = arrived.withColumn("__slice", F.floor(F.col("arrival_us") / slice_us))
    tops = sliced.groupBy("__slice").agg(F.max("event_us").alias("__top"))
    carried = tops.withColumn("__before", F.max("__top").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))).drop("__top")
    ahead = Window.partitionBy("__slice").orderBy("arrival_us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max("event_us").over(ahead), F.col("__before"), F.lit(seed_us).cast("bigint"))
    out = sliced.join(carried, "__slice").withColumn("watermark_us", seen - micros(lateness))
    return out.withColumn("late", F.coalesce(F.col("event_us") < F.col("watermark_us"), F.lit(False))).drop("__slice", "__before")


def lateness_seconds(events: DataFrame) -> DataFrame:
    return events.select("event_id", ((F.col("observed_us") - F.col("event_us")) / 1_000_000).alias("lateness"))


def first_arrivals(admitted: DataFrame) -> DataFrame:
    """Of one event_id the copy that arrived first."""
    w = Window.partitionBy("event_id").orderBy("arrival_us", "event_us")
    return admitted.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


class StreamingEvaluator:
    """foreachBatch target: admits events exactly, keeps them in a table, and evaluates a rule over what was admitted.

    The greatest event time is carried from batch to batch; it stands beside the batch it belongs to, so an evaluator on
    the same folder, after a restart for instance, goes on where the last one ended. A batch that is replayed is written
    to the same place, so it counts once. result() is the batch evaluation of the admitted events; later events can
    complete, move, suppress or undo a match, so results are replaced, not appended.
    """

    def __init__(self, spark: SparkSession, detection: Detection, lateness: object = "5m", folder: str | None = None):
        self.spark, self.detection, self.lateness = spark, detection, lateness
        self.folder = folder or new_path(spark, "stream")

    def tops(self) -> DataFrame:
        """batch, top: the greatest admitted event time of every batch that was finished."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/tops")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], "batch bigint, top bigint")
        return self.spark.read.schema("top bigint, batch bigint").parquet(f"{self.folder}/tops").select("batch", "top")

    def __call__(self, batch: DataFrame, number: int) -> None:
        before = self.tops().where(F.col("batch") < number).agg(F.max("top")).first()[0]
        marked = admission(batch, self.lateness, before)
        marked.write.mode("overwrite").parquet(f"{self.folder}/events/batch={number}")
        self.spark.createDataFrame([(marked.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/schema")
        top = self.spark.read.schema(marked.schema).parquet(f"{self.folder}/events/batch={number}").where("NOT late").agg(F.max("event_us").alias("top"))
        top.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/tops/batch={number}")

    def table(self) -> DataFrame:
        """Every event of the finished batches, with its watermark."""
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.folder}/schema").first()[0]))
        done = sorted(r["batch"] for r in self.tops().select("batch").distinct().collect())
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/events/batch={n}" for n in done])

    def dropped_late(self) -> DataFrame:
        return self.table().where("late")

    def result(self) -> DataFrame:
        return evaluate(prepare(first_arrivals(self.table().where("NOT late"))), self.detection)

    def start(self, stream: DataFrame, checkpoint: str | None = None):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint or new_path(self.spark, "offsets")).trigger(availableNow=True).start()
