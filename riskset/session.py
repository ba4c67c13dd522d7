"""Session helpers: a tuned local/cluster session and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; each is only a default and never overrides
# a value the cluster already set.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def share_package() -> None:
    """Let Python workers of a JVM that is started from here import this package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = os.environ.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "riskset") -> SparkSession:
    """Return the active session or build one with the defaults above.

    ``master`` and ``shuffle_partitions`` are only applied when a session is
    created here (tests, bench); a cluster-provided session is left alone
    except for filling a checkpoint folder when none is configured.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    share_package()
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("RISKSET_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the configured checkpoint folder; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; without it this raises, as executors could not read a folder of
    the driver's machine. Local runs (tests, bench) get a fresh temporary
    folder, which is removed when Python ends.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        current = current.get() if current.isDefined() else None
    if not current:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set on {master}: name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="riskset-ckpt-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the configured folder.

    Used before iterative driver loops (Newton steps) so that a lost executor
    re-reads the checkpoint instead of recomputing the whole cohort.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
