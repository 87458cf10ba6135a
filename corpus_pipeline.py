"""A corpus pipeline over documents: language, near copies, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of docs, whatever their names. run() writes each stage's rows to the shared folder and reads them again for the next, so a
lost executor costs at most the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe_codec, language_id, mixing, ngram_join
from lodestone.llm.common import clear_scratch, scratch, scratches

TOKENIZER = "byte_bpe_50k.json"


def quoted(docs: DataFrame) -> list:
    """The columns of docs, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose text is in one of the languages that the labelled rows teach.

    Cosine and margin must reach cut-offs by length class: half of what 99 of 100 training rows (labelled, rightly predicted)
    reach. Rows without a letter, with a null or an empty text among them, go. Repeated rows are judged alike. A null lang or
    doc_id bars a row from teaching, not from being kept. With no labelled row nothing is learnt and all rows go; an empty table
    gives none. Training rows are judged for the cut-offs first and all rows then, so no text is written on the way.
    """
    languages, prototypes = language_id.learn(docs.where(~language_id.held_out() & F.col("doc_id").isNotNull()))
    own = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # free of clashes with the prediction's columns
    inner = docs.select([F.col(f"`{c}`").alias(n) for c, n in own.items()])

    def judged(rows: DataFrame, keep: list[str]) -> DataFrame:
        return language_id.predict(rows, languages, prototypes, keep, text_col=own["text"], length_col="letters")

    teaching = inner.where(F.col(own["doc_id"]).isNotNull() & ~language_id.held_out(own["doc_id"]) & F.col(own["lang"]).isNotNull())
    cuts = language_id.cutoffs(judged(teaching, [own["lang"]]), F.col(own["lang"]).cast("string") == F.col("lang_pred"), "letters")
    return judged(inner, list(own.values())).where(language_id.accepted(cuts, "letters")).select([F.col(n).alias(c) for c, n in own.items()])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near copies, the document with the least id.

    Null and empty texts are copies of each other. Where the table repeats an id or has rows without one, rows are numbered first
    and grouped by their numbers, so that each row is judged by its own text: of a group the least id stays (any id before none),
    and of rows alike in that, one. An empty table gives none.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    if ids.where("id IS NULL").isEmpty() and ids.groupBy("id").count().where("count > 1").isEmpty():
        heads = ngram_join.join(docs).where("doc_id = class_id").select("doc_id")
        return docs.join(heads, "doc_id", "left_semi").select(quoted(docs))
    own = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    folder = scratch(spark, "numbered")
    docs.select([F.col(f"`{c}`").alias(n) for c, n in own.items()]).withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    groups = ngram_join.join(rows, id_col="row", text_col=own["text"]).select("row", "class_id")
    order = F.struct(F.col(own["doc_id"]).isNull().alias("idless"), F.col(own["doc_id"]).alias("id"), F.col("row"))
    heads = rows.select("row", own["doc_id"]).join(groups, "row").groupBy("class_id").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(heads, "row", "left_semi").select([F.col(n).alias(c) for c, n in own.items()])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats rows so that sources stand at their target weights, by tokens; every row stays at least once.

    A null source is a source of its own; a null or empty text has no tokens and stays once. Rows that share id and source are
    repeated alike. An empty table gives none.
    """
    return mixing.repeat_rows(docs, public_tokenizers.path(TOKENIZER))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every row of the mixture, repeated rows as often as they stand there; none for a null or empty text."""
    return bpe_codec.encode(docs, public_tokenizers.path(TOKENIZER), keep=["source"])


STAGES = [("language", known_language), ("near copies", one_of_near_copies), ("mixing", mixed_sources), ("token ids", token_ids)]

#: SQL can't express hyperdimensional profiles or BPE; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from the shared folder; what came before is removed."""
    docs, since, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratches(), ""
    for name, stage in STAGES:
        folder = scratch(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    clear_scratch(spark, since, keep=folder)
    return docs
