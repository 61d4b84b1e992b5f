from __future__ import annotations

import os
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, wherever the driver was started from."""
    if spark.sparkContext.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    folder = Path(SparkFiles.getRootDirectory()) / "source"
    folder.mkdir(exist_ok=True)
    archive = folder / "earshot.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in [*root.glob("earshot/**/*.py"), *root.glob("catalogue/*.py")]:
            out.write(source, source.relative_to(root))
    context = spark.sparkContext
    context.addPyFile(str(archive))
    # Stateful streaming also starts a worker beside the driver, which is not given the archive.
    known = context.environment.get("PYTHONPATH")
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root), known]))
    _shipped.add(spark.sparkContext.applicationId)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that must give the same rows."""

    def register(run: Query) -> Query:
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf_dir)

        in_utc.__name__ = run.__name__
        QUERIES[name] = in_utc
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register
