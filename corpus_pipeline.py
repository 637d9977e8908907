"""A corpus pipeline of five operators: language ID, near-dedup, substring dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the
last return the columns of documents, whatever other columns there are and however they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import language_id, mixing, near_dedup, packing, substring_dedup
from leafmill.llm.common import apart, documents, hash_share, place, scratch, written


def _neutral(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with columns that no operator's result is called like, and what the named ones are called there."""
    rows, given = apart(docs)
    return rows, [place(given, x) for x in names]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier is sure enough of; it rejects texts without letters, and far ones.

    Null and empty texts go; repeated rows and null ids or languages stay; without training documents all go.
    """
    rows, (key, text, lang) = _neutral(docs, "doc_id", "text", "lang")
    learn = ~language_id.held_out(key) & F.col(key).isNotNull()
    model = language_id.fit_classifier(rows, learn, key, text, lang)
    return language_id.predict(rows, model, text, keep_text=True).filter(~F.col("rejected")).select(*rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of 0.8 or more), the one of the smallest id.

    Null and empty texts and rows without an id stay; all rows of the id that stays stay.
    """
    rows, (key, text) = _neutral(docs, "doc_id", "text")
    found = near_dedup.near_dedup(rows, key, text, percent=80)
    gone = written(found.filter(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct(), "near-copies")
    if gone.count() <= 500_000:  # 4 MB of ids; else a shuffled join
        gone = F.broadcast(gone)
    return rows.join(gone, key, "left_anti").select(*rows.columns).toDF(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that also start in a document of a smaller id.

    All rows stay; null and empty texts and rows without an id stay as they are.
    """
    rows, (key, text) = _neutral(docs, "doc_id", "text")
    return substring_dedup.substring_dedup(rows, key, text).select(*rows.columns).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them; a fractional repetition is drawn by a seeded hash.

    Documents without words go; rows of one id, or of none, of a source draw alike; a null source is one source.
    """
    rows, (key, text, source) = _neutral(docs, "doc_id", "text", "source")
    mixed = mixing.mix_sources(rows, id_col=key, text_col=text, source_col=source, keep_text=True)
    whole = F.floor("repeats")
    copies = whole + F.when(hash_share(key, seed="mix-copies") < F.col("repeats") - whole, 1).otherwise(0)
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*rows.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words; copies of one document are kept in different bins.

    A document without words has a row without a bin; rows without an id are one cluster.
    """
    rows, (key, text, source) = _neutral(docs, "doc_id", "text", "source")
    return packing.pack_documents(rows, id_col=key, text_col=text, source_col=source, cluster=F.xxhash64(key))


STAGES = [
    ("language_id", languages),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("source_mixing", mix),
    ("packing", pack),
]

#: The classifier and the packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents, each written and read again before the next; what a stage wrote besides is removed."""
    docs = documents(spark, sf_dir)
    with scratch(spark, "pipeline"):
        for name, stage in STAGES[:-1]:
            with scratch(spark, name):
                docs = written(stage(spark, docs, sf_dir), f"stage-{name}", outer=True)
        return written(STAGES[-1][1](spark, docs, sf_dir), "packed", outer=True)
