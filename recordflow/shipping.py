"""Sends this package to the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the session, once per Spark application.

    Workers then import it by name, whatever their working folder; the zip is
    served by the driver, so no shared folder is needed.
    """
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="recordflow-"), "recordflow_pkg.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("recordflow", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(out)
    _SENT.add(app)
