"""From raw documents to token ids: quality, near copies, repeats, leaked test items, encoding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that
stay, with the columns it was given (the last: the encoded documents). run() writes each stage's rows as
Parquet to the folder that the cluster shares and reads them back for the next.

docs needs doc_id (a whole number) and text; any other columns pass through, whatever their names. What every stage does with odd
rows: a null text is an empty one; a row without an id is looked at like the others where only its own text counts, and
otherwise stays as it is; repeated rows get the same decision; an empty table gives an empty one; texts of any length are one row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, decontam, minhash, quality, repeats
from gleaner.llm.shared import settle

TOKENIZER = "byte_bpe_50k.json"
#: Documents of a lower score are rejected; near copies are similar by this share or more.
LEAST_SCORE, NEAR = 0.3, (80, 100)


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of these documents, doesn't reject. Every row is scored by its
    text alone; without usable labels all scores are a half and everything stays."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = _free(docs, "score")
    return quality.with_score(docs, model, score_col=name).filter(F.col(name) >= LEAST_SCORE).select(*_columns(docs))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies. Texts without words are near to nothing; rows without an
    id stay; rows of one id are one document, which goes only if none of its texts is kept."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"), share=NEAR)
    gone = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*_columns(docs))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that stand earlier; a text that loses all words goes. Null and empty texts
    stay, and so do rows without an id. n_chars, where there is such a column, follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("boolean")
    cut = repeats.dedup(docs.select("doc_id", "text", rest.alias("rest")), keep=("rest",))
    left = cut.filter("n_removed < n_words or n_words = 0")

    def column(name: str) -> Column:
        if name in ("doc_id", "text"):
            return F.col("doc_id" if name == "doc_id" else "kept").alias(name)
        old = F.col("rest")[name]
        if name == "n_chars":
            old = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(docs.schema[name].dataType)).otherwise(old)
        return old.alias(name)

    return left.select(*map(column, docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item. Rows without an id stay; rows of one id are one document."""
    leaks = decontam.contained(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*_columns(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the ids and of the text decoded from them, of every row: a null or empty text has no tokens; rows without
    an id and repeated rows are encoded like any other."""
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_copies_stage),
    ("substring dedup", repeats_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: SQL can't express the classifier or the encoder; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
