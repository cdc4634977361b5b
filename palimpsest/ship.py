"""Makes the package importable on executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, unless they find it by PYTHONPATH or the working folder.

    On a cluster ``--py-files`` does the same.
    """
    root = Path(__file__).resolve().parents[1]
    near = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    app = spark.sparkContext.applicationId
    if app in _SENT or any(p and (Path(p) / "palimpsest" / "ship.py").exists() for p in near):
        return
    made = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest"), "zip", root, "palimpsest")
    spark.sparkContext.addPyFile(made)
    _SENT.add(app)
