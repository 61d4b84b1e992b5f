"""Packs of every word: nothing is dropped, nothing is gathered on the driver."""

import os

import pytest
from pyspark.sql import functions as F

from catalogue import inputs
from earshot.functions import text as tx

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_every_word_is_a_rule_of_a_valid_pack(spark):
    packs = inputs.word_packs(spark, DATA)
    words = inputs.documents(spark, DATA).select("lang", F.explode(tx.tokens(F.col("norm"))).alias("word")).filter("word <> ''").distinct()
    assert packs.n_patterns == words.count() == packs.rules.count()
    assert packs.rejects.count() == 0
    sizes = packs.rules.groupBy("language").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 1000 and sizes[1] == len(packs.languages) > 4


def test_pack_tables_are_read_from_files(spark):
    packs = inputs.word_packs(spark, DATA)
    for df in (packs.rules, packs.patterns, packs.allow_terms):
        assert "FileScan" in df._jdf.queryExecution().executedPlan().toString()


def test_words_are_read_from_the_documents_once(spark):
    words = inputs.pack_words(spark, DATA)
    assert "documents.parquet" not in words._jdf.queryExecution().executedPlan().toString()


def test_known_disagreements_name_packs_by_a_join(spark):
    from catalogue import packqa

    plan = packqa._known(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    # No word is held against a list of all packs.
    assert "Generate" not in plan and "Join" in plan


def test_word_packs_are_parsed_in_many_tasks(spark):
    files = inputs.word_pack_files(spark, DATA)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Few bytes are else coalesced to one partition, and one task parses every pack.
    assert parts > 1 and files.rdd.getNumPartitions() == parts
