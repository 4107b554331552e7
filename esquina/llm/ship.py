"""The package's code for the Python workers of a session that was started elsewhere."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once; Spark serves it to every executor."""
    context = spark.sparkContext
    if getattr(context, "_esquina_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="esquina-code-"), "esquina.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("esquina", os.path.relpath(full, package)))
    context.addPyFile(target)
    context._esquina_shipped = True
