"""Corpus preparation: toxicity, near-dedup, substring dedup, mixing to target weights, best-fit packing.

Every stage but the last takes and returns the columns of documents (with n_chars kept true to the text); each is written
as Parquet and reread as the next one's input. Filters keep every document that they do not reject, unlabelled and empty
ones included.

Defined results: a null text has no words, no score above a textless one's, no near copies, and stays; very long texts go
through whole; rows that share a doc_id or are repeated are scored, cut, mixed and packed one by one (in near-dedup they
are one document, of which every row stays or goes); a null doc_id is kept; columns beside those of documents are
carried along with their values, also where an operator has a column of that name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm.common import materialise
from wavemill.llm.minhash_dedup import near_duplicates
from wavemill.llm.mixing import WORD, mix, word_count
from wavemill.llm.packing import pack
from wavemill.llm.substring_dedup import dedup_substrings
from wavemill.llm.toxicity import THRESHOLD, fit, held_out, score

#: The stages learn, sample and link across documents, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None
#: The pipeline takes as near copies what shares this percentage of its 5-word shingles at least; the query op6 has 85.
NEAR_PERCENT = 80


def _apart(docs: DataFrame, *named: str) -> DataFrame:
    """The columns that an operator is to see, and all others as one struct, out of reach of the operator's own names."""
    rest = [F.col(c) for c in docs.columns if c not in named]
    return docs.select(*named, F.struct(*rest, F.lit(0).alias("__")).alias("__row"))


def _together(rows: DataFrame, columns: list[str], named: tuple[str, ...], **changed) -> DataFrame:
    """The columns of documents again; what `changed` has takes the place of theirs."""
    return rows.select(*(changed[c].alias(c) if c in changed else F.col(c) if c in named else F.col("__row").getField(c).alias(c) for c in columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; fitted on the labels that are not held out."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))
    scored = score(_apart(docs, "doc_id", "text"), model)
    return _together(scored.where(F.col("score") < THRESHOLD), docs.columns, ("doc_id", "text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = NEAR_PERCENT) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    dropped = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeat a smaller document; documents of which nothing is left go."""
    cut = dedup_substrings(_apart(docs, "doc_id", "text"))
    left = cut.where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("__row.n_chars")) if "n_chars" in docs.columns else None
    return _together(left, docs.columns, ("doc_id",), text=text, n_chars=n_chars)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a source's last one is cut to the words it is taken for.

    Documents without words have no share in the mix and stay once.
    """
    sized = materialise(_apart(docs, "doc_id", "source", "text").withColumn("size", word_count()), "sizes")  # words are counted once
    mixed = mix(sized)
    first_words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int"))
    part = F.when(F.col("part") == F.col("size"), F.col("text")).when(F.col("part") > 0, F.array_join(first_words, " "))
    whole = F.when(F.col("size") == 0, 1).otherwise(F.col("whole")).cast("int")
    copies = F.array_repeat(F.col("text"), whole)
    copies = F.when((F.col("part") > 0) & (F.col("size") > 0), F.concat(copies, F.array(part))).otherwise(copies)
    rows = mixed.select("doc_id", "source", "__row", F.explode(copies).alias("text"))
    return _together(rows, docs.columns, ("doc_id", "source", "text"), n_chars=F.when(F.col("text").isNotNull(), F.length("text")).cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and the sequence that each is in."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
