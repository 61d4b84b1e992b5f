"""A training corpus from documents: five operators in a row, each on all its predecessor kept.

Documents whose language is not recognised go; of each group of near copies the one with
the smallest id stays; documents that a benchmark contaminates go; sources are mixed to
target weights, so that a document comes as often as it has copies in the mix; what is
left is shuffled into shards. All stages but the last return the columns of documents.

Documents need doc_id, text, lang and source; other columns, whatever they are called, are
set aside while an operator works and come out as they went in. Every stage gives an empty
table for an empty one. What a stage does with nulls, ties and repeated rows it says itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.registry import ship_package
from earshot.llm import langid, mix, shard
from earshot.llm.decontam import find_passages
from earshot.llm.frames import without
from earshot.llm.jaccard import similar_documents
from earshot.llm.queries import SHARDS, WINDOW_WORDS, contamination
from earshot.plans.sizing import broadcast_if_bounded, materialize


def _set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with the used columns and all others in one, and the columns of docs again from that."""
    aside = "set_aside"
    while aside in {c.lower() for c in docs.columns}:
        aside += "_"
    others = [c for c in docs.columns if c not in used]
    held = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    restored = [F.col(c) if c in used else F.col(aside)[c].alias(c) for c in docs.columns]
    return docs.select(*used, held.alias(aside)), restored


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model, learned from labelled documents, recognises.

    A null text and one without letters are of no language and go. Rows are judged by
    their text alone, so repeated ones go or stay together; a null lang teaches nothing.
    """
    ship_package(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang").filter(~langid.held_out()))
    plain, restored = _set_aside(docs, "text")
    return langid.identify(plain, model).filter(~F.col("rejected")).select(*restored)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest id.

    Rows that share an id are one document and one of them stays, by hash of the row; rows
    with a null id have no copies and all stay. A document without words has none either.
    """
    ship_package(spark)
    own = [F.col(f"`{c}`") for c in docs.columns]
    copies = similar_documents(docs.select("doc_id", "text")).filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(broadcast_if_bounded(materialize(copies, "copies")), "doc_id", "left_anti").select(*own)
    repeated = kept.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    repeated = broadcast_if_bounded(materialize(repeated, "repeated"))
    # Narrow where ids are unique, and added up before it is moved where one is not.
    row = F.struct(*own)
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(row)).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(*own).unionByName(one.select("row.*"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark passages.

    A null or empty text has no words and stays. Rows are judged one by one, by their
    text alone.
    """
    ship_package(spark)
    plain, restored = _set_aside(docs, "text")
    found = find_passages(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=WINDOW_WORDS)
    return contamination(found).filter(~F.col("contaminated")).select(*restored)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources by weights 1, 2, 3 takes it.

    A null source is a source, the last; a null text has no words, and its document goes
    in and out by its place like others. Rows equal in id and size are ties: which of
    them gets a copy more is open. Rows that come several times are documents each.
    """
    ship_package(spark)
    plain, restored = _set_aside(docs, "doc_id", "source", "text")
    return mix.emit(mix.mix_sources(plain)).select(*restored)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus with each row's shard and slot.

    Null ids and texts are values like others; rows equal in both are ties and may stand
    for each other. Columns called shard or slot, in any case, are replaced.
    """
    ship_package(spark)
    docs = without(docs, "shard", "slot")
    plain, restored = _set_aside(docs, "doc_id", "text")
    return shard.shard_rows(plain, SHARDS).select(*restored, "shard", "slot")


STAGES = [
    ("language", recognised),
    ("near copies", distinct),
    ("decontamination", uncontaminated),
    ("mix", mixed),
    ("shards", sharded),
]

#: The language model has no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: every stage written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
