"""Session helpers shared by every operator: reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "lexspark", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A local session for tests and benches; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, set on the context; one is made only in local mode without it (tests)."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lexspark-ckpt-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place for a table of intermediate data in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage ends there and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def tasks(spark: SparkSession) -> int:
    """The session's shuffle partitions: for exchanges that must keep their parallelism although they move few bytes.

    Adaptive execution merges small partitions; a named number is kept. Worth it before work that is heavy by row.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _parquet(path: str):
    import re

    from pyarrow import dataset, fs

    uri = re.sub("^s3a:", "s3:", re.sub("^file:/+", "file:///", path))
    system, at = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
    return dataset.dataset(at, filesystem=system, format="parquet")


def read_rows(path: str):
    """A parquet table of the shared folder inside a task, as an Arrow table."""
    return _parquet(path).to_table()


def read_batches(path: str, columns: list[str]):
    """Columns of a parquet table of the shared folder inside a task, batch by batch, in an order that is the same every time."""
    for f in sorted(_parquet(path).get_fragments(), key=lambda f: f.path):
        yield from f.to_batches(columns=columns, batch_size=8_192, batch_readahead=1, use_threads=False)
