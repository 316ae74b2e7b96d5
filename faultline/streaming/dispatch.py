"""Messages to their handlers, and answers to where they belong, for a table or a stream."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import messages

#: Takes the messages of a route, gives (message_id, reply, error): a null reply is none; an error sends a message to the dead letters. A
#: column ``retries`` tells how often it was tried again.
Handler = Callable[[DataFrame], DataFrame]

# fixed values: the routes whose answers go to the exchange of results if nobody waits for them, and what counts as no result there
RESULT_ROUTES = ("analyze", "analyze_item_early")
NO_RESULT = ("[]", "")

OUT = "message_id string, sink string, destination string, correlation_id string, body string, x_error string, x_routing_key string, x_retries int"


def dispatched(taken: DataFrame, handlers: dict[str, Handler], exchange: str | None = "results") -> DataFrame:
    """OUT of ``messages.opened`` rows: what is to be sent, with its sink.

    ``reply``: an answer to a message with ``reply_to``. ``result``: an answer of a route of results that isn't empty, with nobody
    waiting, if there is an exchange. ``dead``: what is no JSON or failed, with its error, key and number of retries. Messages of unknown
    keys and other answers are let go. An id that comes twice is two messages with the same answers; a handler must give one row an id.
    """
    known = taken.where(F.col("error").isNull() & F.col("routing_key").isin(*handlers))
    empty = taken.sparkSession.createDataFrame([], "message_id string, reply string, error string, retries int")
    parts = [h(known.where(F.col("routing_key") == k).select("message_id", "routing_key", "correlation_id", "headers", "body")) for k, h in handlers.items()]
    parts = [p.select("message_id", F.col("reply").cast("string"), F.col("error").cast("string"), (F.col("retries") if "retries" in p.columns else F.lit(0)).cast("int").alias("retries")) for p in parts]
    answers = reduce(DataFrame.unionByName, parts, empty).select("message_id", "reply", F.col("error").alias("failure"), "retries")
    rows = taken.join(answers, "message_id", "left")
    error = F.coalesce("error", "failure")
    result = F.col("routing_key").isin(*RESULT_ROUTES) & ~F.col("reply").isin(*NO_RESULT) & F.lit(bool(exchange))
    # an empty address is none
    waits = F.coalesce(F.col("reply_to"), F.lit("")) != ""
    sink = F.when(error.isNotNull(), "dead").when(F.col("reply").isNull(), None).when(waits, "reply").when(result, "result")
    rows = rows.withColumn("sink", sink).where(F.col("sink").isNotNull())
    dead = F.col("sink") == "dead"
    return rows.select(
        "message_id", "sink", F.when(F.col("sink") == "reply", F.col("reply_to")).when(F.col("sink") == "result", F.lit(exchange)).alias("destination"),
        F.when(~dead, F.col("correlation_id")).alias("correlation_id"), F.when(dead, F.col("body")).otherwise(F.col("reply")).alias("body"),
        F.when(dead, error).alias("x_error"), F.when(dead, F.coalesce("routing_key", F.lit(""))).alias("x_routing_key"), F.when(dead, F.coalesce("retries", F.lit(0))).alias("x_retries"),
    )


def sending(handlers: dict[str, Handler], out: str, exchange: str | None = "results") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over ``messages.opened`` rows. All sinks of a batch are written in one job into the folder of the batch's
    number, in the place of what an attempt before left there, so a repeated batch sends nothing twice."""

    def send(batch: DataFrame, epoch: int) -> None:
        # every handler looks at the batch, which is to be read and parsed once; what a lost executor held is read again
        held = batch.persist(StorageLevel.DISK_ONLY)
        try:
            dispatched(held, handlers, exchange).write.mode("overwrite").partitionBy("sink").parquet(f"{out.rstrip('/')}/epoch={epoch}")
        finally:
            held.unpersist()

    return send


def serve(spark: SparkSession, folder: str, handlers: dict[str, Handler], out: str, checkpoint: str, exchange: str | None = "results", **trigger) -> StreamingQuery:
    """Takes a folder's messages as they come. What a batch has read is noted in ``checkpoint`` before its answers count, so a restart goes
    on where it stopped; a handler that raises stops the stream, and the batch is tried again at the next start."""
    messages.register(spark)
    lines = spark.readStream.format("messages").load(folder)
    return messages.opened(lines).writeStream.foreachBatch(sending(handlers, out, exchange)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sent(spark: SparkSession, out: str) -> DataFrame:
    """OUT of all batches, with ``epoch``."""
    return spark.read.schema(OUT + ", epoch long").parquet(out)
