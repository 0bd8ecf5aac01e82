"""Corpus pipeline: toxicity, exact duplicates, near duplicates, source mix, SentencePiece ids.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and all but the last
return the columns of documents. A null text counts as empty everywhere; an empty table passes through.
Decisions are made for rows: where rows share a doc_id or have none, each is decided by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tubula.llm.common import discard, read, stored
from tubula.llm.dedup import exact_duplicates
from tubula.llm.mixing import mix_sources
from tubula.llm.neardup import near_components
from tubula.llm.pieces import model_bytes, piece_report
from tubula.llm.toxicity import toxic_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Decisions (a few bytes each) that may be broadcast; with more, they are joined by shuffle.
BROADCAST_ROWS = 4_000_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and the column that tells rows apart: doc_id, or a stored number of the row where rows
    share an id or have none."""
    docs = docs.select(*COLUMNS)
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if not shared.limit(1).count():
        return docs, "doc_id"
    return stored(docs.withColumn("row_id", F.monotonically_increasing_id()), "pipeline-rows"), "row_id"


def _small(decisions: DataFrame, name: str) -> DataFrame:
    """Decisions, stored and marked for broadcast if they are few, so that texts needn't be shuffled."""
    decisions = stored(decisions, f"pipeline-{name}")
    return F.broadcast(decisions) if decisions.count() <= BROADCAST_ROWS else decisions


def _without(docs: DataFrame, gone: DataFrame, key: str, name: str) -> DataFrame:
    """The documents whose key isn't among the gone ones."""
    return docs.join(_small(gone.select(key), name), key, "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts as toxic go. It is trained on the labelled ones outside its held-out fold."""
    docs, key = _keyed(docs)
    scores = toxic_scores(docs, read(spark, sf_dir, "labels"), key == "row_id")
    return _without(docs, scores.filter("predicted = 1"), key, "toxic")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the smallest doc_id stays."""
    docs, key = _keyed(docs)
    return _without(docs, exact_duplicates(docs, rows=key == "row_id").filter("not kept"), key, "copies")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one row with the smallest doc_id stays;
    texts without words are no copies of each other."""
    docs, key = _keyed(docs)
    found = near_components(docs, 5, 80, rows=key == "row_id")
    if key == "doc_id":
        return _without(docs, found.filter("not kept"), key, "near")
    found = stored(found.filter("component is not null").select("row_id", "kept", "component"), "pipeline-components")
    stays = found.filter("kept").groupBy("component").agg(F.min("row_id").alias("row_id"))
    return _without(docs, found.join(stays.select("row_id"), "row_id", "left_anti"), key, "near")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; sources meet their target shares of words."""
    docs, key = _keyed(docs)
    other = mix_sources(docs, key == "row_id").filter("copies <> 1").select(key, F.col("copies").cast("int").alias("copies"))
    mixed = docs.join(_small(other, "copies"), key, "left").withColumn("copies", F.coalesce("copies", F.lit(1))).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text: their number and digest, and whether decoding gives the text back."""
    return piece_report(docs, model_bytes(spark))


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mix", mix), ("pieces", pieces)]
#: The model-based stages can't be put in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage has read goes
    once the next one is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
