"""Writing: the processed layer, views, references, audit and history."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from caseflow.operators.reliability import upsert
from caseflow.schema import check_columns


def write_processed(cases: DataFrame, path: str) -> None:
    """The cleaned layer, partitioned by the year of its file; refused if a denied column is there."""
    check_columns(cases.columns)
    cases.write.mode("overwrite").partitionBy("ano_referencia").parquet(path)


def publish(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replaces a table as a whole: written beside it, then renamed, so that readers never see half of it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    df.write.parquet(new)
    at = hadoop.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(hadoop.Path(old), True)
    if store.exists(at):
        store.rename(at, hadoop.Path(old))
    store.rename(hadoop.Path(new), at)
    store.delete(hadoop.Path(old), True)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str, stamp: str) -> None:
    """Old and new rows, the latest of each key."""
    from caseflow.sources.readers import exists

    old = spark.read.parquet(path) if exists(spark, path) else new.limit(0)
    publish(spark, upsert(old, new.select(*old.columns), key, stamp), path)


def register_views(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Tables under their names, and their numbers of rows."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return {name: df.count() for name, df in tables.items()}


def write_reference(df: DataFrame, path: str, order: list[str], origin: dict) -> None:
    """A small reference as one sorted CSV file, with a note of its origin and digest."""
    rows = df.orderBy(*order).toPandas()
    rows.to_csv(path, index=False)
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    with open(os.path.splitext(path)[0] + ".provenance.json", "w", encoding="utf-8") as f:
        json.dump(origin | {"sha256": digest, "rows": len(rows)}, f, ensure_ascii=False, indent=1)


def append_json(path: str, entry: dict) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, ensure_ascii=False, default=str) + "\n")


def replace_run(events: DataFrame, path: str) -> None:
    """Audit events as a table with a partition per run; writing a run again replaces it."""
    events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
