"""Exact duplicates and output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.ordered import running
from granary.shared import Tables


def _order(split: str, path: str, preferred: str) -> Column:
    return F.struct((F.coalesce(F.col(split) != preferred, F.lit(True))).alias("other"), F.col(path).alias("path"))


def first_of_each(samples: DataFrame, digest: str, split: str, path: str, preferred: str) -> DataFrame:
    """(digest, first): the path kept for each content, from the preferred split if there is one, then the smallest.

    An aggregate with partial sums, so that no content's copies meet in one task.
    """
    return samples.groupBy(digest).agg(F.min(_order(split, path, preferred))["path"].alias("first"))


def kept(samples: DataFrame, digest: str, split: str, path: str, preferred: str = "train") -> DataFrame:
    first = first_of_each(samples, digest, split, path, preferred)
    return samples.join(first.select(F.col("first").alias(path)), path, "left_semi")


def dropped(samples: DataFrame, digest: str, split: str, path: str, preferred: str = "train") -> DataFrame:
    """(path, kept_path) of what goes."""
    narrow = samples.select(digest, path)
    return narrow.join(first_of_each(samples, digest, split, path, preferred), digest).where(F.col(path) != F.col("first")).select(path, F.col("first").alias("kept_path"))


def output_names(samples: DataFrame, name: str, digest: str, order: list[str]) -> DataFrame:
    """Adds output_name: samples in `order` take their own name if it is free, else the first free one of
    stem_hash.ending, stem_hash_1.ending, ... with ten digits of their hash and the ending in lower case.

    `order` tells samples apart. Names are claimed in rounds: a sample without its own name claims the one that its
    rank among those of equal stem, hash and ending gives it, every name goes to its first claimant, and losers count
    on, or claim a made name where they lose their own. A hot name's ranks come from a distributed order. No two output
    names are equal; a null name stays null.
    """
    tables = Tables(samples.sparkSession)
    stem, ending = F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?$", 1), F.lower(F.regexp_extract(name, r"(?s)(\.[^.]*)?$", 1))
    asked = samples.where(F.col(name).isNotNull()).select(
        F.col(name).alias("_name"), F.concat(stem, F.lit("_"), F.substring(F.coalesce(digest, F.lit("")), 1, 10)).alias("_stem"), ending.alias("_ending"), F.struct(*order).alias("_order")
    )
    asked = tables.write(asked)
    by = ["_stem", "_ending"]
    own = tables.write(asked.groupBy("_name").agg(F.min("_order").alias("_order")))  # who holds its own name
    while True:
        others = asked.join(own.select("_order"), "_order", "left_anti")
        ranked = tables.write(running(others, by, ["_order"], {"_rank": None}, tables))
        shut = samples.sparkSession.createDataFrame([], "_stem string, _ending string, _from array<bigint>")
        while True:
            past = F.size(F.filter(F.coalesce("_from", F.array().cast("array<bigint>")), lambda r: r <= F.col("_rank")))
            count = F.col("_rank") - 1 + past
            made = F.concat("_stem", F.when(count > 0, F.concat(F.lit("_"), count.cast("string"))).otherwise(""), "_ending")
            claims = tables.write(ranked.join(shut, by, "left").select(*by, "_order", "_rank", made.alias("_name")))
            every = claims.unionByName(own.select("_name", "_order"), allowMissingColumns=True)
            first = every.groupBy("_name").agg(F.min("_order").alias("_first"), F.count("*").alias("_n")).where(F.col("_n") > 1)
            lost = tables.write(every.join(first, "_name").where(F.col("_order") != F.col("_first")).select(*by, "_order", "_rank"))
            ousted = lost.where(F.col("_rank").isNull()).select("_order")
            if ousted.head(1) or not lost.head(1):
                break
            # of those who share a list of names only the first loser is sure: the ones behind may move up to other names
            more = lost.groupBy(*by).agg(F.min("_rank").alias("_at"))
            shut = tables.write(more.join(shut, by, "full").select(*by, F.sort_array(F.concat(F.coalesce("_from", F.array().cast("array<bigint>")), F.when(F.col("_at").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("_at")))).alias("_from")))
        if not ousted.head(1):
            break
        own = tables.write(own.join(ousted, "_order", "left_anti"))
    final = claims.select("_order", "_name").unionByName(own.select("_order", "_name")).withColumnRenamed("_name", "output_name")
    found = samples.withColumn("_order", F.struct(*order)).join(final, "_order", "left").drop("_order")
    return tables.keep(found)
