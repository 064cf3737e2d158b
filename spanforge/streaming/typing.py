"""The row-wise parts under Structured Streaming: detect, embed and type new texts; latency by window.

Only the inductive head streams: refinement needs the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import Detector, Embedder, detect, embed
from ..operators import vectors


def texts(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Texts of JSON lines (sent_id, text) as files arrive."""
    return spark.readStream.schema("sent_id long, text string").option("maxFilesPerTrigger", per_trigger).json(folder)


def typed(stream: DataFrame, detector: Detector, embedder: Embedder, prototypes: DataFrame) -> DataFrame:
    """Detections with their nearest label, stateless and in append mode: the argmax is an expression over broadcast prototypes."""
    found = embed(detect(stream, detector), embedder, "span")
    packed = prototypes.groupBy("label").agg(F.first("vec").alias("v")).groupBy().agg(F.sort_array(F.collect_list(F.struct("label", "v"))).alias("protos"))
    scored = found.crossJoin(F.broadcast(packed)).withColumn("s", F.transform("protos", lambda p: F.struct(F.round(vectors.dot(F.col("vec"), p["v"]), 6).alias("sim"), p["label"].alias("label"))))
    best = F.array_max(F.transform("s", lambda x: x["sim"]))
    first = F.element_at(F.filter("s", lambda x: x["sim"] == best), 1)
    return scored.select("sent_id", "start_off", "end_off", "span", first["label"].alias("label"), "score")


def latency_windows(events: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, p50_ms) by tumbling window; rows later than the watermark are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("p50_ms")).select(F.col("window.start").alias("window_start"), "event_type", "n", "p50_ms")
