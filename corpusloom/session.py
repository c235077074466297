"""Session defaults that suit the engine's plans; a cluster's own settings win."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(name: str = "corpusloom", cores: str | None = None, **settings: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cores if cores.isdigit() else "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | settings
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, if PYTHONPATH does not give it to them."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted((root / "corpusloom").rglob("*.py")):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
