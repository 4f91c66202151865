"""Getting the package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: Bytes of rows that a Python worker is sent at a time, where the session does not say otherwise: texts are long, and a batch of
#: Spark's usual number of them takes much memory on both sides.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once for each application; needless where it is installed there."""
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.getConf().contains(_BATCH[0]):
        spark.conf.set(*_BATCH)
    if app not in _SHIPPED:
        here = Path(__file__).parent
        target = os.path.join(tempfile.mkdtemp(prefix="spanloom-"), "spanloom.zip")
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, Path(here.name) / f.relative_to(here))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    return spark
