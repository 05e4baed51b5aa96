"""Sessions: the package on the workers' path, and settings that suit the operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
_own: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once a session; nothing to do where PYTHONPATH has it."""
    app = spark.sparkContext.applicationId
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if app in _shipped or str(_ROOT) in on_path:
        return
    folder = tempfile.mkdtemp(prefix="lumenweave-package-")
    atexit.register(shutil.rmtree, folder, True)
    name = os.path.join(folder, "lumenweave_engine.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in (_ROOT / "lumenweave").rglob("*.py"):  # one archive of all that is there: a second one of the package would hide behind it
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir. Only a local master may do without that setting (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lumenweave-shared-"))
            atexit.register(shutil.rmtree, _own[0], True)
        found = f"file://{_own[0]}"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """A small table (a row a group, a frame or a header unit) written to the shared folder and read back: what stands on it doesn't compute it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def session(name: str = "lumenweave", **conf: str) -> SparkSession:
    """A session with adaptive plans (coalescing, skewed joins, local reads) and Arrow; ``conf`` adds or replaces."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
