"""Session helpers.

The library never creates a cluster-wide session on its own; `get_spark`
is for tests, benchmarks and local runs.  On a cluster the caller's session
is used as is, and only unset options receive a default.
"""
from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Defaults applied only where the session does not already define a value.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "finlake") -> SparkSession:
    """Local/test session: UI off, AQE on, UTC, shuffle partitions ~ cores."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", os.environ.get("FINLAKE_DRIVER_MEM", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set library defaults on an existing session, keeping explicit settings."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


BYTES_PER_PARTITION = 8 << 20  # of stored input; joined and as text it is several times that
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_INITIAL, _OURS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "finlake.initialPartitionNum"


def fit_partitions(spark: SparkSession, paths: list[str]) -> int:
    """Lets adaptive execution start from as many shuffle partitions as the
    stored input needs, so a task's share does not grow with the input; it
    merges small ones again, up to 16 MB as shuffled (sorted rows take some 20
    times that in memory).  Never fewer than ``spark.sql.shuffle.partitions``;
    what the user has set stays."""
    if spark.conf.get(_ADVISORY, None) is None:
        spark.conf.set(_ADVISORY, "16m")
    said = spark.conf.get(_INITIAL, None)
    if said is not None and said != spark.conf.get(_OURS, None):
        return int(said)
    size, conf = 0, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        size += fs.getContentSummary(p).getLength() if fs.exists(p) else 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_PER_PARTITION))
    spark.conf.set(_INITIAL, str(n))
    spark.conf.set(_OURS, str(n))
    return n


def is_local(master: str) -> bool:
    """Whether driver and executor are one process, sharing all folders."""
    return re.fullmatch(r"local(\[[^]]*\])?", master) is not None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by `spark.checkpoint.dir`.

    On a cluster this must be set by the deployment (a shared file system
    every executor can reach); without it this raises.  Only a local session,
    as in tests, gets a fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="finlake-ckpt-", dir=os.environ.get("FINLAKE_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


# for several large writes in a row: the shuffle files of a query go when it ends, not when the driver next collects
# garbage; a task reads at most 32 MB of stored rows (compressed, a tenth of what they take when sorted)
WRITES_IN_A_ROW = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.files.maxPartitionBytes": "32m"}


@contextmanager
def unless_set(spark: SparkSession, options: dict[str, str]):
    """Session options that hold inside only; what the user has set stays."""
    ours = {k: v for k, v in options.items() if spark.conf.get(k, None) is None}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in ours:
            spark.conf.unset(k)


_SCRATCH: list[str] = []


def scratch_dir(spark: SparkSession, prefix: str = "scratch") -> str:
    """A fresh folder for intermediate tables under the shared checkpoint
    folder (``spark.checkpoint.dir``), never a machine-local path on a
    cluster.  ``drop_scratch`` removes them once results are written."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    _SCRATCH.append(f"{base}/{prefix}-{uuid.uuid4().hex[:12]}")
    return _SCRATCH[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has made; results that are
    still lazy must be written first.  Returns how many folders went."""
    gone, jvm = 0, spark.sparkContext._jvm
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        gone += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone
