"""Structured Streaming: ingest, click counts, change capture. The transformations are those of the batch side."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from mnemora.operators import documents as D
from mnemora.operators import search as S
from mnemora.rules import Rules
from mnemora.runtime import ship
from mnemora.sources import ADDRESS


def read(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "json", per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(folder)


def ingest(captures: DataFrame, out: str, checkpoint: str, rules: Rules = Rules(), base_url: str = f"http://{ADDRESS}") -> StreamingQuery:
    """Accepted documents, appended per batch under batch=N. A batch that is run again replaces its own files, so
    nothing is stored twice. ``current`` reads the latest version per address."""

    def write(batch: DataFrame, number: int) -> None:
        docs = D.accepted(D.from_capture(batch), rules, base_url)
        docs.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return captures.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, order: str = "captured_at") -> DataFrame:
    return D.latest(spark.read.parquet(out), "url", F.col(order), F.col("batch"))


def click_counts(clicks: DataFrame, checkpoint: str, out: str, late: str = "30 days") -> StreamingQuery:
    """Running counts per (query, url). A click that is sent again within the watermark counts once. Each batch
    writes the groups that changed; the last batch of a group holds its count (see ``latest_counts``)."""
    once = clicks.where("url is not null and query is not null").withWatermark("received_at", late).dropDuplicatesWithinWatermark(["click_id"])
    counts = once.groupBy("query", "url").agg(F.count(F.lit(1)).alias("count"))

    return run_to_folder(counts, checkpoint, out, "update")


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("query", "url").agg(F.max_by("count", "batch").alias("count"))


def answers(queries: DataFrame, posts: DataFrame | None, docs: DataFrame, out: str, checkpoint: str, options: S.Options = S.Options()) -> StreamingQuery:
    """Best documents of each query of a stream (query_id, text), in the whole query language: (query_id, rank, url,
    relevance). The queries of a batch are answered together, against the index as it is then, or against the documents
    themselves where there are no postings."""

    def write(batch: DataFrame, number: int) -> None:
        S.batch_ranked(posts, docs, batch, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_CHANGE = T.StructType([T.StructField("key", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("id", T.LongType()), T.StructField("content", T.StringType())])
_STATE = T.StructType([T.StructField("content", T.LongType())])


def _changed(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The rows of one key of one batch, in order of time and id. They are held together, without their pages, as a
    batch isn't sorted; contents come as text and are compared as whole numbers, null as one of its own."""
    held = [row for f in frames for row in zip(f["at"], f["id"], f["content"], f["forced"])]
    last = state.get if state.exists else None
    out = []
    for at, i, content, forced in sorted(held, key=lambda r: r[:2]):
        now = (None if content is None else int(content),)
        if forced or now != last:
            out.append((key[0], at, i, content))
        last = now
    if last is not None:
        state.update(last)
    if out:
        yield pd.DataFrame(out, columns=["key", "at", "id", "content"])


def changes(versions: DataFrame) -> DataFrame:
    """Versions (key, at, id, content hash) that differ from the one before of their key, by (at, id), and those whose
    ``forced`` is true, where there is such a column. Versions without key, time or id are left out. The state is one number per key; a batch's rows of one key are held
    together, which files per trigger bound."""
    ship(versions.sparkSession)
    forced = F.coalesce("forced", F.lit(False)) if "forced" in versions.columns else F.lit(False)
    rows = versions.select("key", "at", "id", F.col("content").cast("string").alias("content"), forced.alias("forced")).where("key is not null and at is not null and id is not null")
    return rows.groupBy("key").applyInPandasWithState(_changed, _CHANGE, _STATE, "append", "NoTimeout").withColumn("content", F.col("content").cast("long"))


def run_to_folder(df: DataFrame, checkpoint: str, out: str, mode: str = "append") -> StreamingQuery:
    """Runs what is available; each batch has its own folder and replaces it if it is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
