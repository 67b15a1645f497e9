"""Image files as tables: listings, header scans and manifests."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from granary.sources.labels import source_group

#: Endings of image files in flat and in recursive listings.
FLAT = ["jpg", "jpeg", "png", "bmp", "webp"]
DEEP = ["jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff", "dng", "mpo"]


def has_ending(path: Column, endings: list[str]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(endings)


def list_images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, file_name, group_id, image_hash, content) of the image files in a folder, one row per path.

    Files without a byte are not listed, since Spark's reader passes over them.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = rows.where(has_ending(F.col("path"), DEEP if recursive else FLAT))
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", name.alias("file_name"), source_group(name).alias("group_id"), F.sha1("content").alias("image_hash"), "content")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the images that a text file lists, each once."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where(has_ending(F.col("path"), DEEP)).distinct()


def image_size(data: bytes | None) -> str:
    """`WxH` from the header of a PNG, JPEG, GIF or BMP file, else `unreadable`."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return "%dx%d" % struct.unpack(">II", data[16:24])
        if data[:3] == b"GIF":
            return "%dx%d" % struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return f"{w}x{abs(h)}"
        at = 2
        while data[:2] == b"\xff\xd8":
            mark, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return f"{w}x{h}"
            at += 2 + length
    except (TypeError, IndexError, struct.error):
        pass
    return "unreadable"


@F.pandas_udf(StringType())
def image_size_of(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in content:
        yield part.map(image_size)
