"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import langid, minhash, packing, pii, substring
from chronofold.llm.common import drop_table, stage_table


#: Any character that is not ASCII white space.
WORDS = "[^ \\t\\n\\x0B\\f\\r]"


def _measured(docs: DataFrame) -> DataFrame:
    """The length column follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go; the others keep their columns, whatever their names.

    Where no row has a language nothing can be learned, and all rows stay.
    """
    rows = langid.training_rows(docs)
    if not rows:
        return docs
    model = langid.fit([t for t, _ in rows], [x for _, x in rows])
    names = [f"c{i}" for i in range(len(docs.columns))]
    known = langid.predict(docs.toDF(*names), model, text_column=names[docs.columns.index("text")])
    return known.where(~F.col("lang_rejected")).select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, whatever its ids: that of the least id, one with no id last."""
    return minhash.deduplicate(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more that stand in several places go; documents of which nothing is left go too."""
    left = substring.remove_repeats(docs, keep_columns=True)
    return _measured(left.where(F.col("text").rlike(WORDS)))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind."""
    return pii.mask_documents(docs, pii.fit(pii.training_texts(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts in sequences of 2048 tokens; one row for each piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Stages 1, 4 and 5 are learned or tokenised, which SQL cannot express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each result is written to the shared folder and read again.

    A stage's table goes once the next one is written; the last goes when Python exits.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        made = stage_table(stage(spark, docs, sf_dir), f"pipeline-{number}-{name}")
        drop_table(docs)
        docs = made
    return docs
