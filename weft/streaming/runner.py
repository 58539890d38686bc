"""The run loop as a streaming query.

Each micro-batch is decoded, processed by the same plan as in batch, and written to four
tables: results, retries, dead letters and events. Delivery is at least once: a batch may
be written again after a failure, so every row has the batch's number and the readers
take the last row per execution (``current``). What failed for a passing reason goes to
the retry table with its attempt counted, and the next batch takes it in beside its own
rows; beyond ``MOST_DELIVERIES`` attempts, or for a lasting reason, it is a dead letter.
So what the last batch left to be tried again waits for one more batch. An observer is
called with the failed rows of each batch. There is no time limit per row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.sources.messages import MOST_DELIVERIES, result_rows

TABLES = ("results", "retries", "dead_letters", "events")
Processor = Callable[[DataFrame], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share; where none is named, one below the warehouse if Spark runs in this one process."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return where or f"{spark.conf.get('spark.sql.warehouse.dir')}/streams"


def chain(*steps: Processor) -> Processor:
    """Steps one after another, the first outermost."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run


@dataclass(frozen=True)
class Runner:
    """``process`` adds ``output`` and ``failure`` (and ``error_type``, if it can tell) to rows with ``key`` and ``attempt``."""

    process: Processor
    folder: str
    key: str = "execution_id"
    most: int = MOST_DELIVERIES
    observer: Callable[[DataFrame], None] | None = None

    def table(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, batch: DataFrame, number: int) -> None:
        rows = batch if "attempt" in batch.columns else batch.withColumn("attempt", F.lit(1))
        again = self._left_over(rows.sparkSession, number)
        rows = rows if again is None else rows.unionByName(again.select(*rows.columns))
        inputs = rows.columns
        done = self.process(rows)
        kind = "error_type" if "error_type" in done.columns else None
        done = result_rows(done, "output", "failure", kind).withColumn("batch", F.lit(number).cast("long"))
        done = done.persist()
        try:
            retry = (F.col("status") == "failed") & F.col("error.retryable") & (F.col("attempt") < self.most)
            again = done.where(retry).select(*[c for c in inputs if c != "attempt"], (F.col("attempt") + 1).alias("attempt"), F.col("batch"))
            final = done.where(~F.coalesce(retry, F.lit(False)))
            parts = {
                "results": final.where("status = 'success'").select(self.key, "status", "result", "result_size", "attempt", "batch"),
                "retries": again,
                "dead_letters": final.where("status = 'failed'").select(self.key, "status", "error", "attempt", "batch"),
                "events": done.select(self.key, "event", "attempt", "batch"),
            }
            for name, part in parts.items():
                # One folder per batch: a batch that is written again replaces its own rows.
                part.drop("batch").write.mode("overwrite").parquet(f"{self.table(name)}/batch={number}")
            if self.observer is not None:
                self.observer(done.where("status = 'failed'"))
        finally:
            done.unpersist()

    def _left_over(self, spark: SparkSession, number: int) -> DataFrame | None:
        """What the batch before left to be tried again; None if there is none."""
        place = f"{self.table('retries')}/batch={number - 1}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.parquet(place)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts the query; ``availableNow=True`` works off what is there and ends."""
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def read(self, spark: SparkSession, name: str) -> DataFrame | None:
        """A table's rows; None if nothing has been written yet."""
        try:
            return spark.read.option("mergeSchema", "true").parquet(self.table(name))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def current(self, spark: SparkSession, name: str = "results") -> DataFrame | None:
        """The last row of each execution."""
        rows = self.read(spark, name)
        if rows is None:
            return None
        others = [c for c in rows.columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*others), F.struct("batch", "attempt")).alias("r")).select(self.key, "r.*")

    def metrics(self, spark: SparkSession) -> DataFrame | None:
        """Counts of processed, failed and retried, and the error rate, by batch."""
        rows = self.read(spark, "events")
        if rows is None:
            return None
        failed = F.count_if(F.col("event") == "error")
        return rows.groupBy("batch").agg(F.count("*").alias("processed"), failed.alias("errors"), F.count_if(F.col("attempt") > 1).alias("retried"), (failed / F.count("*")).alias("error_rate"))


def lifecycle(df: DataFrame, nodes: list[str], key: str, output: str = "output") -> DataFrame:
    """(key, node_id, state, items) of each node that ran: ended with its errors gathered over items, or failed."""
    from weft import paths

    each = df.select(key, F.explode_outer(output).alias("k", "v")).where(F.col("k").rlike(r"-/error(\[\d+\])*$"))
    rows = each.select(key, paths.key_node(F.col("k")).alias("node_id"), F.try_variant_get("v", "$", "boolean").alias("error")).where(F.col("node_id").isin(nodes))
    return rows.groupBy(key, "node_id").agg(F.count("*").alias("items"), F.count_if("error").alias("failed")).withColumn("state", F.when(F.col("failed") > 0, F.lit("failed")).otherwise(F.lit("ended")))
