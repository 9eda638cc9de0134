"""From raw documents to packed training sequences: language, toxicity, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the last return the columns
of documents; the last returns the pieces of packed sequences.

In every stage a null text is an empty one, rows with equal ids or texts are told apart as rows where nothing else is said,
extra columns pass through, names that begin with an underscore are the stages' own, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, linededup, packing, similar, toxicity
from tidemark.llm.common import shared_folder, table
from tidemark.llm.queries import piece_digests, vocabulary

#: A document goes if the best language has less of its n-grams than this share of the best two,
LEAST_LANGUAGE_SCORE = 0.52
#: if that language knows less of them than this part of what is usual for it (1 on clean text, 0.1 on random letters),
LEAST_USUAL_SHARE = 0.5
#: or no more than this many standard deviations over what chance gives.
LEAST_DEVIATIONS = 4.0
LEAST_TOXICITY = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of unknown language: without a letter, with too few n-grams that the best language knows, or with no language that fits better than the next.

    Null and empty texts go. Languages that fit equally well are a reason to go. Equal texts have equal fates.
    """
    model = langid.fit(docs)
    usual = langid.usual_shares(docs, model).select(F.col("lang").alias("_lang"), F.col("share").alias("_usual"))
    found = langid.identify(docs, model, lang_col="_lang", score_col="_score", evidence_cols=("_share", "_deviations"))
    found = found.join(F.broadcast(usual), "_lang", "left")  # a row for each language of the model
    least = LEAST_USUAL_SHARE * F.coalesce("_usual", F.lit(1.0))
    evident = (F.col("_score") >= LEAST_LANGUAGE_SCORE) & (F.col("_share") >= least) & (F.col("_deviations") > LEAST_DEVIATIONS)
    return found.where((F.col("_lang") != "und") & evident).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier calls toxic. Null and empty texts stay; equal texts have equal fates."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="_score").where(F.col("_score") < LEAST_TOXICITY).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of lines that stand in an earlier document out of texts; n_chars follows the text. All rows stay, with empty texts if nothing is left."""
    cleaned = linededup.remove_repeated(docs, removed_col="_removed")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard similarity of five-word shingles 0.8 or more) the document with the smallest id stays.

    The SimHash index links first; exact comparison decides. Texts without words are one group. Of equal ids in a group
    the one with the smallest text hash stays; an id that repeats with another text keeps both.
    """
    return similar.drop_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences: every row has its tokens, null and empty texts the end id alone."""
    return piece_digests(packing.pack(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("language_id", keep_known_languages),
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: SQL has no classifier, no fingerprints and no tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What each returns is written as Parquet to the shared folder and read again."""
    folder, docs = shared_folder(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
