"""Session helpers: one place for the configuration the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "tabsight", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the one the context has (``setCheckpointDir``,
    or ``spark.checkpoint.dir`` at its start), else the session's
    ``spark.checkpoint.dir``. Only a local master may do without: it gets a scratch
    folder. Elsewhere a missing folder raises, as executors could not share one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (sc.master or "").startswith("local") or (sc.master or "").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tabsight-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def broadcast_byte_limit(spark: SparkSession) -> int:
    """Bytes up to which a derived table may be broadcast."""
    return int(spark.conf.get("tabsight.broadcastBytes", str(64 << 20)))


def broadcast_row_limit(spark: SparkSession) -> int:
    """Rows up to which a derived table of a few numbers a row (at most about 320
    bytes) may be broadcast; tables that carry texts are checked by their bytes."""
    return broadcast_byte_limit(spark) // 320


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tabsight`` importable in Python workers (grouped pandas functions
    pickle their functions by module). Zips the package once per SparkContext
    and adds it with ``addPyFile``, the standard way to ship Python code."""
    sc = spark.sparkContext
    key = id(sc._jsc) if getattr(sc, "_jsc", None) is not None else id(sc)
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="tabsight-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(key)
