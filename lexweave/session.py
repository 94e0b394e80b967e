"""Makes the package importable in the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_attached: set[str] = set()


def attach(spark: SparkSession) -> SparkSession:
    """Ships the package's sources with the application, once."""
    context = spark.sparkContext
    if context.applicationId not in _attached:
        root = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="lexweave-")) / "lexweave_sources.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, str(source.relative_to(root.parent)))
        context.addPyFile(str(target))
        _attached.add(context.applicationId)
    return spark
