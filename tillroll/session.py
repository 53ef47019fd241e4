"""Session helpers.

Library code never creates a session behind the caller's back; these helpers
exist for tests, the bench and the command line.  Cluster settings (shuffle
partitions, checkpoint directory, memory) always win over the defaults here.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package relies on.
#  * UTC session zone: timestamps are zone-less (timestamp_ntz) and must not
#    shift when cast or truncated.
#  * AQE: coalesces small shuffle partitions, splits skewed join partitions and
#    demotes sort-merge joins to broadcast joins when a side turns out small.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tillroll", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.ui.enabled", "false")
               # checkpoint files of frames that are gone are deleted by the context cleaner
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for k, v in {**REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    """Pin the zone and AQE flags on an existing session (driver-made sessions)."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory named by the cluster.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may go
    without: its driver and executors are one process, so a temporary folder is
    shared.  On a cluster a folder of one machine would be useless to the others.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote (Connect) sessions: the server's setting applies
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tillroll-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()
