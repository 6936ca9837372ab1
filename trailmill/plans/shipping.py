"""Makes this package importable in the workers, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application, once."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    package = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="trailmill-py-")) / "trailmill_sources.zip"
    with zipfile.ZipFile(to, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(to))
    _SENT.add(context.applicationId)
