"""The corpus pipeline: filters, deduplicates, decontaminates and packs the documents.

Each stage takes what the one before has written and returns the documents it keeps, with the columns they
came with; the last returns the packed sequences. Null and empty texts pass every filter. No documents
give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.llm import decontaminate, line_dedup, minhash, packing, toxicity
from tickloom.llm.queries import TOKENIZER, TOXIC_FROM, held_out
from tickloom.llm.tables import table
from tickloom.session import written_once

#: Part of a document's words that benchmark passages make up from which it goes as a whole.
MOSTLY = 0.5
#: Toxic texts up to which their names, 16 bytes each, are broadcast.
BROADCAST_NAMES = 1_000_000


def _own(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _text_names() -> list[Column]:
    """Two hashes that name a text; those of null are null's own."""
    return [F.xxhash64(F.lit(k), F.coalesce("text", F.lit("")), F.col("text").isNull()) for k in range(2)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine does not find toxic.

    Texts are scored by themselves and the names of toxic ones written; documents are then filtered by these,
    without Python beside the rows that are written. The names are broadcast while they are few. Null and empty
    texts stay, equal texts share their fate, and texts of any length are scored whole.
    """
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = toxicity.fit(docs, labels)
    names = [_own(docs, f"__name{k}") for k in range(2)]
    scored = docs.select(*[c.alias(n) for c, n in zip(_text_names(), names)],
                         toxicity.score(model, F.col("text")).alias("score"))
    toxic = written_once(scored.where(F.col("score") >= TOXIC_FROM).select(*names).distinct())
    few = toxic.count() <= BROADCAST_NAMES
    named = docs.withColumns(dict(zip(names, _text_names())))
    return named.join(F.broadcast(toxic) if few else toxic, names, "left_anti").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those that nothing is left of go.

    Null and empty texts stay. Of equal lines that in the document with the smallest id stays, null ids last; rows
    that share an id count as one document. Texts of any length are read whole.
    """
    found = _own(docs, "__lines")
    marked = line_dedup.dedup_lines(docs, out=found, short_copies=True)
    removed = F.col(found)["removed"]
    text = line_dedup.remaining(F.col("text"), removed)
    cut = marked.withColumn("text", text).where(
        (F.size(removed) == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.size(removed) == 0, F.col("n_chars")).otherwise(
            F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return cut.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; those without an id all stay.

    Of rows that share an id one stays. Null and empty texts are no duplicates of each other. Similarity is
    that of shingles of five words.
    """
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(
        "doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return chosen.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that consist of them to at least half go.

    Null and empty texts stay, repeated rows are treated alike, and texts of any length are read whole.
    """
    name = _own(docs, "__found")
    marked = decontaminate.decontaminate(
        docs, table(spark, sf_dir, "benchmark"), cleaned=True, out=name)
    found = F.col(name)
    kept = marked.where(~found["contaminated"] | (found["n_hit"] < MOSTLY * found["n_words"]))
    cut = kept.withColumn("text", F.coalesce(found["text"], F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(
            found["contaminated"], F.length("text").cast(dict(docs.dtypes)["n_chars"])
        ).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as sequences in length buckets and batches; every row is one, also of null or empty text."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_documents),
]

#: Toxicity scores and packed batches have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to all documents, each to what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written_once(stage(spark, docs, sf_dir))
    return docs
