"""Version history of changing entities from a log of observations.

Method: co-partitioned, key-sorted runs merged by entity and time. The log is range-partitioned by (entity, time), so that a hot
entity is cut over as many tasks as its rows need; Spark's external sort merges the sorted runs of each partition, and one
streaming pass emits a version wherever the payload changes. No history is ever held in memory: the pass keeps one row per
partition end. Entities cut by a partition border are joined from one summary row per partition end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexspark.runtime import cut

_BLANK = r"(?U)^[\s﻿]+|[\s﻿]+$"

_RUN = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("kind", T.StringType()),  # v: a version begins; h / t: first / last observation of the partition
        T.StructField("entity", T.LongType()),
        T.StructField("payload", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("local_no", T.LongType()),
        T.StructField("next_id", T.LongType()),
        T.StructField("at", T.TimestampNTZType()),
        T.StructField("until", T.TimestampNTZType()),
        T.StructField("first_here", T.BooleanType()),  # the entity is the partition's first one
        T.StructField("last_here", T.BooleanType()),  # the entity is the partition's last one
    ]
)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows sorted by (entity, at, ingested desc, row_id desc): versions by change of payload, and the partition's ends."""
    schema = pa.schema(
        [("part", pa.int32()), ("kind", pa.string()), ("entity", pa.int64()), ("payload", pa.string()), ("row_id", pa.int64()), ("local_no", pa.int64()), ("next_id", pa.int64()), ("at", pa.timestamp("us")), ("until", pa.timestamp("us")), ("first_here", pa.bool_()), ("last_here", pa.bool_())]
    )
    prev = None  # entity, at, payload of the row before
    open_ = None  # the version not yet closed
    number = 0
    first_entity = None
    part = None

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        ent = b.column("entity").to_numpy(zero_copy_only=False)
        at = b.column("at").cast(pa.int64()).to_numpy(zero_copy_only=False)
        pay = b.column("payload").to_numpy(zero_copy_only=False)
        rid = b.column("row_id").to_numpy(zero_copy_only=False)
        new_ent = np.r_[prev is None or prev[0] != ent[0], ent[1:] != ent[:-1]]
        new_at = new_ent | np.r_[prev is None or prev[1] != at[0], at[1:] != at[:-1]]
        # Of several rows of one entity and time the first in this order counts.
        keep = np.flatnonzero(new_at)
        part = b.column("part")[0].as_py()
        if not len(keep):
            continue
        pk = pay[keep]
        before = np.r_[np.array([prev[2] if prev else None], dtype=object), pk[:-1]]
        change = new_ent[keep] | (pk != before)
        out = []
        if first_entity is None:
            first_entity = ent[0]
            out.append((part, "h", int(ent[0]), pk[0], int(rid[keep[0]]), 0, None, int(at[keep[0]]), None, True, False))
        for j in np.flatnonzero(change):
            i = keep[j]
            if open_ is not None:
                same = open_[2] == ent[i]
                out.append((*open_[:6], int(rid[i]) if same else None, open_[7], int(at[i]) if same else None, open_[9], False))
            number = number + 1 if open_ is not None and open_[2] == ent[i] else 1
            open_ = (part, "v", int(ent[i]), pk[j], int(rid[i]), number, None, int(at[i]), None, bool(ent[i] == first_entity), False)
        prev = (ent[keep[-1]], at[keep[-1]], pk[-1])
        if out:
            yield emit(out)
    if open_ is not None:
        yield emit([(*open_[:10], True), (part, "t", open_[2], prev[2], open_[4], number, None, int(prev[1]), None, bool(open_[2] == first_entity), True)])


def version_history(
    log: DataFrame, entity: str = "law_id", payload: str = "content_hash", at: str = "fetched_at", ingested: str = "ingested_at", row_id: str = "fetch_id", partitions: int | None = None
) -> DataFrame:
    """Every version of every entity with the period for which it was valid.

    Returns ``entity, version_no, payload, is_current, valid_from, valid_to, opened_by, closed_by`` (names of the input kept for
    the first and third). A version begins wherever the trimmed, lower-case payload differs from that of the observation before
    it, also if it was seen earlier. Of several rows with one entity and time the one ingested last counts, then the largest
    row id. Rows delivered again change nothing. Rows with a null entity, time, row id or payload, or a blank payload, are no
    observations; a null ingestion time counts as the earliest. An empty log gives no rows; other columns are ignored.
    """
    spark = log.sparkSession
    obs = log.select(
        F.col(entity).cast("long").alias("entity"),
        F.col(at).cast("timestamp_ntz").alias("at"),
        F.lower(F.regexp_replace(F.col(payload), _BLANK, "")).alias("payload"),
        F.col(ingested).cast("timestamp_ntz").alias("ing"),
        F.col(row_id).cast("long").alias("row_id"),
    ).where("entity is not null and at is not null and row_id is not null and payload is not null and payload <> ''")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        obs.repartitionByRange(n, "entity", "at")
        .sortWithinPartitions(F.col("entity"), F.col("at"), F.col("ing").desc_nulls_last(), F.col("row_id").desc())
        .select("entity", "at", "payload", "row_id", F.spark_partition_id().alias("part"))
    )
    runs = cut(ordered.mapInArrow(_runs, _RUN))
    # At most two rows a partition: what a border entity had before and after this partition.
    ends = runs.where("kind in ('h', 't')")
    # By (partition, head before tail): the tail before a head, and the head after a tail.
    heads = ends.where("kind = 'h'").select("part", "entity", "payload", "row_id", "at")
    tails = ends.where("kind = 't'").select("part", "entity", F.col("payload").alias("t_payload"), F.col("local_no").alias("t_no"))
    both = heads.join(tails.withColumnRenamed("entity", "t_entity"), "part")
    w = Window.orderBy("part")  # one row a partition: bounded by the number of partitions
    chain = both.withColumns(
        {
            "p_entity": F.lag("t_entity").over(w),
            "p_payload": F.lag("t_payload").over(w),
        }
    ).withColumn("glued", F.col("p_entity").eqNullSafe(F.col("entity")) & F.col("p_payload").eqNullSafe(F.col("payload")))
    # Versions that entity t_entity has in this partition, without one that only goes on from before.
    chain = chain.withColumn("adds", F.col("t_no") - F.when(F.col("glued") & (F.col("entity") == F.col("t_entity")), 1).otherwise(0))
    by_entity = Window.partitionBy("t_entity").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    chain = chain.withColumn("upto", F.sum("adds").over(by_entity))
    chain = chain.withColumns({"p_upto": F.lag("upto").over(w)}).withColumn("offset", F.when(F.col("p_entity").eqNullSafe(F.col("entity")), F.col("p_upto")).otherwise(0) - F.when(F.col("glued"), 1).otherwise(0))
    front = chain.select("part", F.col("entity").alias("f_entity"), "offset", "glued")
    v = runs.where("kind = 'v'").join(F.broadcast(front), "part")
    v = v.withColumn("no", F.col("local_no") + F.when(F.col("first_here"), F.col("offset")).otherwise(0)).where(~(F.col("first_here") & F.col("glued") & (F.col("local_no") == 1)))
    # A version still open at its partition's end is closed by the entity's next version, in a later partition.
    later = v.where("first_here").groupBy("entity", "part").agg(F.min_by("row_id", "local_no").alias("row_id"), F.min("at").alias("at"))
    # The openings of a glued head's own partition: its first version goes on, so that version's end is taken from there.
    glued = runs.where("kind = 'v' and first_here and local_no = 1").join(F.broadcast(front.where("glued")), "part").select("entity", "part", F.col("next_id").alias("g_next"), F.col("until").alias("g_until"))
    firsts = (
        glued.select("entity", "part", F.col("g_next").alias("row_id"), F.col("g_until").alias("at"))
        .unionByName(later.join(F.broadcast(front.where("glued").select("part")), "part", "left_anti").select("entity", "part", "row_id", "at"))
        .where("row_id is not null")
        .select(F.col("entity").alias("n_entity"), F.col("part").alias("n_part"), F.col("row_id").alias("n_id"), F.col("at").alias("n_at"))
    )
    # The next opening of the same entity in a later partition, by one pass over its borders from the last to the first.
    borders = v.where("last_here").select("entity", "part", F.lit(0).alias("opens"), F.lit(None).cast("struct<n_id: bigint, n_at: timestamp_ntz>").alias("c"))
    borders = borders.unionByName(firsts.select(F.col("n_entity").alias("entity"), F.col("n_part").alias("part"), F.lit(1).alias("opens"), F.struct("n_id", "n_at").alias("c")))
    after = Window.partitionBy("entity").orderBy(F.desc("part"), "opens").rowsBetween(Window.unboundedPreceding, -1)
    closing = borders.withColumn("c", F.last("c", ignorenulls=True).over(after)).where("opens = 0 and c is not null")
    closing = closing.select(F.col("entity").alias("c_entity"), F.col("part").alias("c_part"), F.col("c.n_id").alias("c_id"), F.col("c.n_at").alias("c_at"))
    done = v.join(F.broadcast(closing), (F.col("entity") == F.col("c_entity")) & (F.col("part") == F.col("c_part")) & F.col("last_here"), "left")
    closed = F.coalesce("next_id", "c_id")
    return done.select(
        F.col("entity").alias(entity),
        F.col("no").cast("int").alias("version_no"),
        F.col("payload").alias(payload),
        closed.isNull().alias("is_current"),
        F.col("at").alias("valid_from"),
        F.coalesce("until", "c_at").alias("valid_to"),
        F.col("row_id").alias("opened_by"),
        F.coalesce(closed, F.lit(0)).cast("long").alias("closed_by"),
    )


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Versions of every law from the whole fetch log (status 200 with a hash)."""
    log = spark.read.parquet(f"{sf_dir}/law_fetches.parquet").where("status_code = 200")
    return version_history(log).select("law_id", "version_no", "content_hash", "opened_by", "closed_by")


P6_SQL = r"""
WITH o AS (
  SELECT law_id, fetched_at, ingested_at, fetch_id, lower(regexp_replace(content_hash, '^[\s\x{3000}\x{00A0}\x{FEFF}]+|[\s\x{3000}\x{00A0}\x{FEFF}]+$', '', 'g')) AS content_hash
  FROM law_fetches WHERE status_code = 200 AND content_hash IS NOT NULL AND law_id IS NOT NULL AND fetched_at IS NOT NULL AND fetch_id IS NOT NULL
), d AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY law_id, fetched_at ORDER BY ingested_at DESC NULLS LAST, fetch_id DESC) rn FROM o WHERE content_hash <> '') WHERE rn = 1
), c AS (
  SELECT * FROM (SELECT *, lag(content_hash) OVER (PARTITION BY law_id ORDER BY fetched_at) p FROM d) WHERE p IS NULL OR p <> content_hash
)
SELECT law_id, CAST(row_number() OVER w AS INTEGER) AS version_no, content_hash, fetch_id AS opened_by, coalesce(lead(fetch_id) OVER w, 0) AS closed_by
FROM c WINDOW w AS (PARTITION BY law_id ORDER BY fetched_at)
"""
