"""Documents to packed training sequences: classify, drop near duplicates, cut repeated passages, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, the last one the packed pieces. A row is
known by its ``doc_id`` and a hash of its text. No SQL says the same (the classifier and the packing have none).

Every stage takes NULLs in any column, empty and very long texts, repeated rows and empty tables; columns beyond those of
``documents`` pass through all but the last. What a case becomes is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridership.llm import mixing, ngram_join, packing, quality, suffix_dedup
from ridership.llm.common import table
from ridership.llm.queries import EPOCHS, MIX_SEED, SHARE, WEIGHTS, domain, tokenizer_file
from ridership.session import stage

ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents that are not among ``gone`` (doc_id, text_key)."""
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key"))
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_gone")) & (key == F.col("_gone_key")), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A NULL text is judged as an empty one, a NULL source or language as a site of its own; repeated rows are judged alike;
    an empty table stays empty.
    """
    judged = quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return _without(docs, judged.filter("NOT keep"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays, that with the smallest id.

    Ties and NULL ids: of documents with one id the text with the smaller hash stays, a NULL id only where the group has no
    other. Of rows repeated with id and text one stays, the first by its other columns. Documents without words are linked
    with nothing: all stay, but repeated rows once.
    """
    linked = stage(ngram_join.jaccard_components(docs), "linked")
    heads = linked.filter("doc_id <=> component_id")
    alone = F.when(F.col("component").isNull(), F.struct("doc_id", "text_key"))
    heads = heads.select("doc_id", "text_key", F.struct("component", alone.alias("alone")).alias("_group"))
    tied = heads.groupBy("_group").agg(F.min(F.struct("doc_id", "text_key")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    tied = stage(heads.join(tied, heads["_group"].eqNullSafe(tied["_group"])).select("doc_id", "text_key", "_first"), "tied")
    is_first = F.struct("doc_id", "text_key").eqNullSafe(F.col("_first"))
    gone = linked.filter("NOT doc_id <=> component_id").select("doc_id", "text_key")
    left = _without(docs, gone.union(tied.filter(~is_first).select("doc_id", "text_key")))
    again = stage(tied.filter(is_first).groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key"), "repeated_rows")
    if again.isEmpty():
        return left
    key = F.xxhash64(F.coalesce(left["text"], F.lit("")))
    same = left["doc_id"].eqNullSafe(again["doc_id"]) & (key == again["text_key"])
    # few rows go through this: one of each set of repeated rows, found with partial minima
    once = left.join(again, same, "left_semi").withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    once = once.groupBy("doc_id", "_key").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return _without(left, again).unionByName(once)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat an earlier document go, and documents of which nothing is left.

    Where a cut splits a character, the rest of the character goes as well. NULL and empty texts stay as they are, as do
    texts under 50 bytes; a repeat is one of a document with a smaller id, so rows with one id, or none, do not cut each other.
    """
    lost, cut = suffix_dedup.remove_repeats(docs)
    left = _without(docs, lost.filter("n_bytes > 0 AND n_removed = n_bytes").select("doc_id", "text_key"))
    text = F.coalesce(F.col("text"), F.lit(""))
    changed = cut.select(F.col("text_key").alias("_key"), F.col("n_bytes").alias("_size"), F.col("kept").alias("_kept"))
    joined = left.join(changed, (F.xxhash64(text) == F.col("_key")) & (F.octet_length(text) == F.col("_size")), "left")
    new = {"text": F.coalesce("_kept", "text"), "n_chars": F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("_kept"))}
    return joined.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen by target weights; one that is taken in two epochs comes twice.

    A NULL source or language is a leaf of its own; texts without words take none of a budget and are chosen by
    their place in the seeded order; repeated rows are chosen each; ties of the order go by id; an empty table stays empty.
    """
    return mixing.mix(docs, domain(), WEIGHTS, F.col("_all") * F.lit(SHARE), EPOCHS, MIX_SEED).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset.

    A NULL text is packed as an empty one, which is its end mark; very long texts are cut into pieces; rows that come twice
    are packed each; an empty table has no pieces; other columns go.
    """
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
