"""A training-data pipeline over ``documents``: language, near duplicates, secrets, mix, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeline.llm import language, minhash, mixing, packing, secrets
from gradeline.llm.common import apart, written
from gradeline.llm.queries import word_vocabulary

#: Share of a document's words that its language must hold for it to stay.
LEAST_SHARE = 0.4


def one_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose text is null, has no letter, or has no language with enough of its words.

    If no row outside the held-out ids has a language to learn from, all documents with a letter stay.
    """
    model = language.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    kept = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    kept = language.identify(kept, model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id stays of each group of five-word near duplicates.

    Rows that repeat an id and text are copies too, and one of them stays. Rows that repeat an id with
    another text are documents of their own. Rows without an id stay.
    """
    keyed, _ = apart(docs.withColumn("_key_of_row", F.col("doc_id")), "_key_of_row", F.xxhash64("text"), "pipeline-ids")
    texts = keyed.select(F.col("_key_of_row").alias("doc_id"), "text")
    kept = minhash.duplicate_classes(texts, width=5, percent=80).where("kept AND doc_id IS NOT NULL")
    kept = kept.select(F.col("doc_id").alias("_key_of_row"))
    known = keyed.where(F.col("_key_of_row").isNotNull()).join(kept, "_key_of_row", "left_semi")
    known = known.dropDuplicates(["_key_of_row"]).select(*docs.columns)
    return known.unionByName(docs.where(F.col("doc_id").isNull()))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans found in its text are blanked out and n_chars follows."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = ~F.col("n_chars").eqNullSafe(F.char_length("text")) & F.col("text").contains(secrets.MARK)
        clean = clean.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out, stay or repeat as the targets of their sources ask."""
    return mixing.resample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs, word_vocabulary())


STAGES = [
    ("language", one_language),
    ("near_duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: Trained models and a tokenizer's vocabulary have no SQL form; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
