import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def packs(spark):
    from earshot.sources.packs import read_packs

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return read_packs(spark, f"{root}/packs/neutral")


@pytest.fixture(scope="session")
def make_packs(spark):
    """Packs from a dict of language to (rules, allow)."""
    import yaml

    from earshot.sources.packs import packs_from_files

    def make(spec, mode="failfast"):
        files = [
            (f"/packs/{language}.yml", yaml.safe_dump(
                {"version": 1, "language": language, "rules": rules, "allow": list(allow)},
                allow_unicode=True,
            ).encode())
            for language, (rules, allow) in spec.items()
        ]
        return packs_from_files(
            spark.createDataFrame(files, "source_path string, content binary"), mode
        )

    return make


def rule(rule_id, match, *patterns, severity=1, category="spam", review=False, **extra):
    return {
        "id": rule_id, "term": patterns[0], "variants": list(patterns[1:]), "match": match,
        "severity": severity, "category": category, "context_required": review, **extra,
    }
