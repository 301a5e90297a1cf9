"""The package's modules on every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application.

    Arrow functions are imported by name on the executors, which need not have the package installed nor
    share the driver's working directory.
    """
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="siftlight-"), "siftlight.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("siftlight", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
