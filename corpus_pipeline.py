"""From raw documents to training sequences in five stages; each works on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, minhash, packing, quality, substring
from tidemark.llm.common import table, written
from tidemark.llm.queries import tokenizer_path


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of `docs` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1; all of them if no label can be learned from.

    Rows come back whole, with all columns; nulls and empty texts are scored like any text, repeated rows each. An empty table
    stays empty; a text of any length is read whole, passage by passage.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told with a score of at least one half; all of them if no language can be learned.

    Rows come back whole, with all columns. A null text and one without a letter is rejected; repeated rows are judged each. An empty table
    stays empty; a text of any length is read whole, window by window.
    """
    model = language_id.train(docs)
    return docs if model is None else language_id.keep_spoken(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    A row is known by its doc_id and text, so rows that share an id, or have none, are judged each by its text;
    of rows that are equal in both one stays. Texts without words all stay. Other columns come back as they are, whatever their names. An empty table stays empty; of a text of any length all shingles count.
    """
    id_, hash_, again = free(docs, "kept_id", "kept_hash", "kept_again")
    kept = written(minhash.near_duplicates(docs, by_text=True).filter("kept").select("doc_id", "body", (F.col("n_shingles") > 0).alias("worded")), "kept")
    alone = kept.groupBy(F.col("doc_id").alias(id_), F.col("body").alias(hash_)).agg((F.max("worded") & (F.count(F.lit(1)) > 1)).alias(again))
    out = docs.join(alone, docs["doc_id"].eqNullSafe(alone[id_]) & (F.xxhash64(docs["text"]) == alone[hash_]))
    if alone.filter(again).isEmpty():
        return out.select(docs.columns)
    return out.filter(~F.col(again)).unionByName(out.filter(again).dropDuplicates(["doc_id", hash_])).select(docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages of 20 words or more; n_chars, if there is one, follows the text.

    A row is known by its doc_id and text; equal rows are cut alike. Null, empty and short texts stay. Other
    columns come back as they are, whatever their names. An empty table stays empty; a text of any length is searched whole.
    """
    id_, hash_, kept = free(docs, "cut_id", "cut_hash", "cut_text")
    cut = substring.remove_repeats(docs.select("doc_id", "text"), span=20, keep_text=True, changed_only=True).filter("n_removed > 0")
    cut = cut.select(F.col("doc_id").alias(id_), F.col("body").alias(hash_), F.col("kept_text").alias(kept))
    if not docs.groupBy("doc_id", F.xxhash64("text")).count().filter("count > 1").isEmpty():
        cut = cut.dropDuplicates([id_, hash_])
    joined = docs.join(cut, docs["doc_id"].eqNullSafe(cut[id_]) & (F.xxhash64(docs["text"]) == cut[hash_]), "left")
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.char_length(kept).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return joined.withColumns(new).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens along the curve; a null or empty text is its end token alone, repeated rows are packed each.

    Other columns than doc_id and text are ignored, whatever their names; an empty table gives no pieces; a long text goes on over as many sequences as it needs.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_dedup", drop_near_duplicates), ("substring_dedup", drop_repeats), ("packing", pack)]

#: The models and sketches cannot be said in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
