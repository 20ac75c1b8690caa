"""Incremental ingest: a stream of parsed texts upserted into the current state, one addition a micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from lexspark.operators.versioning import upsert_rows, version_chunks
from lexspark.runtime import cut
from lexspark.sources.readers import append_snapshot, read_laws, read_snapshot


def upsert_stream(stream: DataFrame, root: str, checkpoint: str, available_now: bool = True, embed: Callable[[Column], Column] | None = None) -> StreamingQuery:
    """Upserts texts (``source_key, title, source_url, content_hash, raw_text, metadata_json, fetched_at``) into the state at ``root``.

    Of several rows of a key in a batch the last fetched counts. A batch writes its new laws, versions and chunks only; which version
    is current is derived by who reads (``derive_current``). Of the stored state a batch reads keys, hashes and numbers, no texts. A
    batch that runs again adds nothing: its hashes are those of the current versions by then.
    """

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        w = Window.partitionBy("source_key").orderBy(F.desc("fetched_at"), F.desc("content_hash"))
        last = rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
        laws = read_laws(spark, root)
        versions = read_snapshot(spark, root, "law_versions").drop("state")
        changed, added = upsert_rows(last, laws, versions)
        added = cut(added)  # written, and cut into chunks
        if added.isEmpty() and changed.isEmpty():
            return
        titles = changed.select("law_id", "title").unionByName(laws.join(changed.select("law_id"), "law_id", "left_anti").select("law_id", "title"))
        append_snapshot({"laws": changed, "law_versions": added, "law_chunks": version_chunks(added, embed, titles)}, root, f"batch-{n}-{uuid4().hex[:8]}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
