"""Documents to a sharded training mix: toxicity, near duplicates, benchmark passages, source weights, placement.

Each stage is a function of (spark, docs, sf_dir) and reads all that the one before it kept; run() writes each result
as Parquet and reads it again, so a lost executor costs one stage at most.

All stages but the last return the columns of documents as they were and where they were; extra columns of any name pass through. A row with a
null or empty text is no reason for any stage to drop it: it is neither toxic nor a copy nor contaminated, and it is mixed and
placed like all others. An empty table stays empty. Repeated rows share the fate of toxicity, decontamination, mixing and sharding;
what becomes of them among near duplicates is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from braidwork.llm._store import Table
from braidwork.llm.decontamination import decontaminate
from braidwork.llm.mixing import mix
from braidwork.llm.near_dedup import drop_near_duplicates
from braidwork.llm.sharding import place
from braidwork.llm.toxicity import drop_toxic, learn_lexicon


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go: those whose clauses sum up to the bound or more, whatever their doc_id. Without labels the lexicon is the seeds."""
    return drop_toxic(docs, learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id.

    Rows with words that repeat a doc_id are one document and leave one row, the one with the fewest shingles, then the least hash of them. A row
    with a null doc_id is in no group.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go: 13 words in a row, or the whole of an item of 4 to 12 words. An empty benchmark removes nothing."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source as often as its target weight says, four times at most; a null source is one of its own. A row's fraction is decided by its
    doc_id, for a null doc_id by its text, so repeated rows have equally many copies."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each row, in the column shard (shard_ if there is one already): by its doc_id, for a null doc_id by its text, so copies of a row stay together."""
    return place(docs)


STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: Neither the grammar nor the sketches nor the suffix arrays are SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: Table | None = None
    for _, stage in STAGES:
        table = Table(stage(spark, docs, sf_dir))
        if before is not None:
            before.release()
        before, docs = table, table.df
    return docs
