"""From raw documents to packed training sequences: select, deduplicate, mix and pack.

Every stage takes all rows that the one before kept, as a table; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import line_dedup, mixing, packing, quality_classifier, simhash
from granary.llm.common import word_count, written
from granary.operators.ordered import running
from granary.shared import Tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade is probable enough, by a model fitted on the rated ones among them.

    Rows are judged one by one, by their whole text: repeated rows fare alike, a null text is an empty one, and null
    ids have no rating but a verdict. Without any rating the model's start decides. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.quality_scores(docs.select(COLUMNS), labels).where("kept").select(COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; documents that lose all their lines go, n_chars follows the text.

    The smallest doc_id keeps a line, and rows of one doc_id count as one document, so that repeated rows keep their
    lines here; rows without a doc_id come after all others. Null texts become empty ones and stay, as do empty ones.
    """
    kept = line_dedup.line_dedup(docs.select(COLUMNS)).where("n_dropped = 0 OR text != ''")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays.

    Copies are found by whole texts. Rows that share a doc_id are one document and stay or go together; what
    `simhash.drop_near_duplicates` says of null, empty and short texts and of null ids holds here.
    """
    return simhash.drop_near_duplicates(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, so that each source's words come near its target.

    Rows that share a doc_id, null included, have a number each by `mixing.mix`: of those of equal source and size any one may
    get any of them, since they weigh the same. Null sources are one source; texts without words are taken like the
    rest of their source; an empty table stays empty.
    """
    docs = docs.select(COLUMNS)
    decided = written(mixing.mix(docs).select("doc_id", "source", "size", "nth", F.col("times").cast("int").alias("times")))
    per_id = decided.groupBy("doc_id").agg(F.count("*").alias("_rows"), F.max("times").alias("_times")).withColumnRenamed("doc_id", "_id")
    same_id = docs["doc_id"].eqNullSafe(F.col("_id"))
    taken = docs.join(per_id.where("_rows = 1 AND _times > 0").hint("merge"), same_id).select(*COLUMNS, "_times")
    shared = written(per_id.where("_rows > 1").select("_id"))
    if shared.head(1):
        tables = Tables(spark)
        rows = docs.join(shared, same_id, "left_semi").withColumns({"_size": word_count(F.col("text")), "_tie": F.monotonically_increasing_id()})
        numbered = running(tables.write(rows), ["doc_id", "source", "_size"], ["_tie"], {"_nth": None}, tables)
        times = decided.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_words"), F.col("nth").alias("_place"), F.col("times").alias("_times")).where("_times > 0")
        fits = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_words")) & (F.col("_nth") == F.col("_place") + 1)
        taken = taken.unionByName(numbered.join(times, fits).select(*COLUMNS, "_times"))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their checksum, their sequence and their place in it.

    Every row is packed, repeated ones each for itself; null and empty texts are one piece of the ending alone; long
    ones are cut into pieces whole; an empty table stays empty. Token ids would have to be shuffled with the pieces,
    which takes twice the stage's disk budget; `packing.pack` gives them where there is room.
    """
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality classifier", select_quality),
    ("line dedup", drop_shared_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Stages fit models and sample; SQL can't express them. tests/llm/test_pipeline.py follows each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
