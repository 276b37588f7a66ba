"""Spark session helpers.

The library never creates its own cluster settings when a session already
exists: it only fills in values that are unset (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults for local runs. On a cluster these come from the deployment.
_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # every cross-product must be explicit; the library never emits one
    "spark.sql.crossJoin.enabled": "false",
}


_PKG_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tablefold",
                  driver_memory: str = "16g") -> SparkSession:
    # Python workers fork from the JVM's environment: make the package importable there
    # (on a cluster, ship it with --py-files / spark.submit.pyFiles instead)
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if _PKG_ROOT not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([_PKG_ROOT] + [p for p in paths if p])
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; set a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. Only local runs (tests) get a fresh folder under the temp dir; on a
    cluster each executor would see its own disk there, so that is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tablefold-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for written intermediate tables, under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def materialize(df):
    """Cut lineage with a reliable checkpoint in the session's checkpoint folder.

    Use it on ``scored`` before running many ad-hoc reports with filters on
    score columns; the checkpoint survives executor loss (never a local one).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHUFFLING = {"Aggregate", "Window", "Join", "Sort", "Distinct", "Deduplicate", "Repartition", "RepartitionByExpression",
              "RebalancePartitions", "Intersect", "Except", "GlobalLimit", "Pivot", "AsOfJoin"}


def _shuffles(plan) -> bool:
    """Whether a logical plan has an operator that moves rows."""
    kids = plan.children()
    return plan.nodeName() in _SHUFFLING or any(_shuffles(kids.apply(i)) for i in range(kids.size()))


def spread(df):
    """Round-robin repartition when a scan gives fewer partitions than the cluster has cores.

    CPU-heavy row work (regexes, JSON parsing, candidate generation) runs in
    the scan stage; a table stored as one large row group would put all of it
    in one task. On big inputs the scan already has enough partitions and this
    is a no-op (no shuffle). Streaming inputs are returned unchanged, as are those with a shuffle:
    it spreads the rows, and asking for its partitions would run it. No job runs here.
    """
    if df.isStreaming or _shuffles(df._jdf.queryExecution().analyzed()):
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < n:
        return df.repartition(n)
    return df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tablefold`` importable in Python workers (for the Arrow UDFs): zip the package
    into the shared checkpoint folder once per SparkContext and ``addPyFile`` it."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.join(_PKG_ROOT, "tablefold")
    target = scratch_path(spark, f"tablefold-{key}.zip")
    if "://" in target:          # a remote checkpoint folder: stage the zip on the driver instead
        local = tempfile.mkstemp(suffix=".zip")[1]
    else:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        local = target
    with zipfile.ZipFile(local, "w") as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, _PKG_ROOT))
    sc.addPyFile(local)
    _SHIPPED.add(key)
