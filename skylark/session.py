"""Sessions, and the package on the executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once an application, so that their Python can import it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="skylark-")
        atexit.register(shutil.rmtree, folder, True)
        path = f"{folder}/skylark.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f"{top.name}/{f.relative_to(top)}")
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; it goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    path = f"{base.rstrip('/')}/work-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the gateway may have gone first
        return


def session(name: str = "skylark", **conf: str) -> SparkSession:
    """A session with the settings that the engine expects; those of the cluster stay."""
    b = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return ship(b.getOrCreate())
