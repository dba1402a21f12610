"""Session settings shared by every module, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every plan in this package relies on. They are safe on a cluster; sizes such as executor memory stay with
# the submitter.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Extraction is bound by CPU, not by bytes: small shuffle partitions keep every core busy.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM compiles no method of more than 8,000 bytes. Stages of many expressions would be one such method, interpreted for
    # every row; beyond this size they are run as many small ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Applications whose executors have been sent this package.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors as an archive, once for each application; in local mode they have it already."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # The driver serves the archive itself, so it may lie in a folder of its own.
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-docledger-"), "docledger.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session, and give its executors this package."""
    for key, value in DEFAULT_CONF.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def run_folder(spark: SparkSession) -> str:
    """A fresh folder for the tables, streams and checkpoints of one run, in the shared folder of the session.

    Only a session in local mode may be without one: elsewhere executors would write to disks of their own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/docledger-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-docledger-")


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docledger")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Plans of hundreds of expressions build several times faster without a stack capture for each of them.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
