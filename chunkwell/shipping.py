"""Send the package to workers that could not import it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: add the package as a zip file, unless the workers' path has it already."""
    paths = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    name = spark.sparkContext.applicationId
    if str(ROOT) in paths or name in _sent:
        return
    target = Path(tempfile.mkdtemp()) / "chunkwell.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "chunkwell").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    _sent.add(name)
