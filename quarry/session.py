"""Session helpers: a tuned SparkSession and a shared scratch location.

Scratch data (checkpoints, stream state, materialised stages) lives under
``spark.checkpoint.dir``.  On a cluster that setting must name a shared
folder; we only invent one for local masters (tests, bench).
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "quarry",
                  shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with AQE, Arrow and UTC pinned and the web UI off."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Remote-model stages must never run twice concurrently.
        "spark.speculation": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per Spark context.

    Needed where the package is only on the driver's path; a package that is
    itself loaded from an archive is taken to be installed everywhere.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_quarry_shipped", False) or not os.path.isdir(root):
        return
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".py"))
    digest = hashlib.md5()
    for f in files:
        with open(f, "rb") as src:
            digest.update(src.read())
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-code-"), f"quarry-{digest.hexdigest()[:12]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, os.path.relpath(f, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._quarry_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    Reads ``spark.checkpoint.dir`` from the session.  Only when it is unset
    and the master is local (tests, bench) a private folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) visible to every executor")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint dir (never reused)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared scratch folder and read it back.

    Cuts lineage with a single computation (a reliable ``checkpoint()``
    computes the plan twice unless it is cached first) and survives
    executor loss: later stages read files, not lost shuffle blocks.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    written = df.sparkSession.read.parquet(path)
    written._quarry_scratch = path
    if _collecting:
        _collecting[-1].append(written)
    return written


#: Tables written inside each running ``settle``, innermost last.
_collecting: list[list] = []


def settle(build, name: str):
    """Write the result of ``build()`` once and remove every table that was written on the way to it.

    A job of many steps then leaves one table instead of one per step.
    """
    _collecting.append([])
    try:
        out = materialize(build(), name)
    finally:
        made = _collecting.pop()
    discard(*[table for table in made if table is not out])
    if _collecting:
        _collecting[-1].append(out)
    return out


def discard(*written) -> None:
    """Remove tables that ``materialize`` wrote, once everything made from them has itself been written.

    Only the folders that ``materialize`` made are touched; other frames are left alone.
    """
    for df in written:
        path = getattr(df, "_quarry_scratch", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def estimated_partitions(df, target_bytes: int = 128 * 1024 * 1024, cap: int = 200_000) -> int:
    """Partition count so each holds about ``target_bytes`` by the optimizer's
    size estimate (no job runs), never below ``spark.sql.shuffle.partitions``."""
    spark = df.sparkSession
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        size = int(str(plan.stats().sizeInBytes()))
        # join estimates multiply child sizes; never trust more than twice the inputs
        leaves = plan.collectLeaves()
        inputs = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
        size = min(size, 2 * inputs) if inputs > 0 else size
    except Exception:  # noqa: BLE001 - stats unavailable: fall back to the floor
        return floor
    return max(floor, min(cap, -(-size // target_bytes)))


def local_path(p: str) -> str:
    """Strip a ``file:`` scheme for local filesystem operations in tests."""
    return p[5:] if p.startswith("file:") else p


__all__ = ["build_session", "ship_package", "ensure_checkpoint_dir", "scratch_path", "local_path", "materialize", "discard", "settle",
           "estimated_partitions", "path_exists", "is_folder"]
