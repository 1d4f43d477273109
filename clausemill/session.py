"""Session for tests and benches on one machine; a cluster brings its own."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from clausemill.functions.scale import tune

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers once per application, as `--py-files` would."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        archive = Path(tempfile.mkdtemp(prefix="clausemill-")) / "clausemill.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, str(f.relative_to(PACKAGE.parent)))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark


def local_session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clausemill")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="clausemill-ckpt-"))  # one machine: shared by nature
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
