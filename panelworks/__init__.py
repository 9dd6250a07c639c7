"""panelworks: a PySpark-native engine for building, running and scoring synthetic survey panels."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Sends this package to the executors' Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_panelworks_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="panelworks-"), "panelworks.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("panelworks", os.path.relpath(full, top)))
    sc.addPyFile(target)
    sc._panelworks_shipped = True
