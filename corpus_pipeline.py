"""A corpus pipeline: toxicity filter, line dedup, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm import decontaminate, linededup, ngramjoin, packing, toxicity
from tsengine.llm.queries import public_vocabulary
from tsengine.llm.store import apart, row_key, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.

    Null and empty texts stay (they show nothing toxic); repeated rows are judged row by row; an
    empty table, or one without labels, loses nothing; other columns are handed on."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, back = apart(docs)
    return toxicity.toxicity(docs, labels, docs.columns).filter("score < 0.5").select(back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents keep the lines that op7 leaves them; n_chars, where there is one, follows the text.

    No document goes, even one that loses all lines. Null texts stay null; repeated rows lose the
    same lines; an empty table gives an empty one; other columns are handed on."""
    named, back = apart(docs)
    cut = linededup.apply_keep_bitmaps(named, linededup.line_keep_bitmaps(named))
    out = cut.select(*back, F.col("n_dropped").alias("_dropped"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("_dropped") > 0, length).otherwise(F.col("n_chars")))
    return out.drop("_dropped")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the one with the smallest doc_id.

    Null and wordless texts are similar to nothing and stay; of repeated rows one stays; an empty
    table gives an empty one; other columns are handed on."""
    docs, back = apart(docs)
    judged = ngramjoin.jaccard_components(docs).groupBy(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"))
    judged = judged.agg(F.count_if("kept").alias("_kept"), F.count(F.lit(1)).alias("_n")).filter("_kept < _n")
    keyed = docs.withColumn("_row", row_key())
    match = lambda side: (F.col("_row") == side["_key"]) & F.col("doc_id").eqNullSafe(side["_id"])
    left = keyed.join(judged, match(judged), "left_anti")
    # Of rows that repeat with the same doc_id, one stays if it is its group's choice.
    again = judged.filter("_kept > 0")
    once = keyed.join(again, match(again), "left_semi").dropDuplicates(["doc_id", "_row"])
    return left.unionAll(once).select(back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op1's rule calls contaminated go.

    Null and wordless texts stay; repeated rows are judged alike; without items, or without
    documents, nothing goes; other columns are handed on."""
    docs, back = apart(docs)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.filter(decontaminate.is_contaminated()).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct()
    return docs.withColumn("_row", row_key()).join(bad, (F.col("_row") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select(back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that the remaining documents are packed into: doc_id, start, length,
    ids, doc_tokens, sequence_id, offset. Null texts count as empty, repeated rows are packed
    each; an empty table gives no piece; other columns are ignored."""
    return packing.packed_sequences(docs.select("doc_id", "text"), **public_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the toxicity model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
