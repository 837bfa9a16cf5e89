"""The same aggregations over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseflow.sources.readers import dose_reason
from caseflow.functions.codes import campaign
from caseflow.functions.dates import strip


def doses_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Running doses by state and campaign of dose extracts that are dropped into a folder."""
    raw = spark.readStream.schema("sg_uf_paciente string, ds_nome string, dt_vacina string, st_documento string").options(sep=";", header=True, encoding="ISO-8859-1").csv(folder)
    good = raw.where(dose_reason().isNull())
    return good.groupBy(F.upper(strip(F.col("sg_uf_paciente"))).alias("uf"), campaign(F.col("ds_nome")).alias("campanha")).agg(F.count("*").alias("doses_aplicadas"))


def daily_events_stream(spark: SparkSession, folder: str, schema, lateness: str = "2 days") -> DataFrame:
    """Events per day and type; a day is final once the watermark has passed it."""
    events = spark.readStream.schema(schema).parquet(folder).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    return events.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("dia"), "event_type", "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Works off what is there into a table in memory, and stops."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
