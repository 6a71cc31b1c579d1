"""Caption sets: images, their captions (annotations) and categories.

A set is a table (id, image_id, category_id, x, y, w, h, iscrowd, ...), a row an annotation.  Id lists are
given as DataFrames with the named column, or as Python lists for a few values; nothing is collected.
"Has all of these categories" is a test of bits: each image has one bitmap of its categories, built with map-side
combine.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.operators.runs import rank_within


def _among(df: DataFrame, ids: DataFrame | Iterable | None, col: str) -> DataFrame:
    """Rows whose ``col`` is in a list (None: all; an empty list filters nothing, as the sets' readers have it)."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)).distinct(), col, "left_semi")
    few = list(ids)
    return df.where(F.col(col).isin(few)) if few else df


def caption_index(captions: DataFrame) -> DataFrame:
    """A10: (image_id, n_captions, first_id, last_id)."""
    return captions.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_captions"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def captions_of(captions: DataFrame, images: DataFrame | Iterable) -> DataFrame:
    """A10: the annotations of some images."""
    return _among(captions, images, "image_id")


def filter_captions(captions: DataFrame, images=None, categories=None, area: tuple[float, float] | None = None,
                    crowd: int | None = None) -> DataFrame:
    """Annotation ids by image list, category list, open range of the area and crowd flag."""
    out = _among(_among(captions, images, "image_id"), categories, "category_id")
    if area:
        size = F.col("w") * F.col("h")
        out = out.where((size > area[0]) & (size < area[1]))
    return (out if crowd is None else out.where(F.col("iscrowd") == crowd)).select("id")


def filter_categories(categories: DataFrame, names=None, supers=None, ids=None) -> DataFrame:
    """Category ids by name, supercategory and id."""
    return _among(_among(_among(categories, names, "name"), supers, "supercategory"), ids, "id").select("id")


def category_bitmaps(captions: DataFrame) -> DataFrame:
    """(image_id, bucket, bits): which categories an image has, a bitmap for each range of category numbers."""
    return captions.where("category_id IS NOT NULL").groupBy("image_id", F.expr("bitmap_bucket_number(category_id)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(category_id))").alias("bits"))


def images_with(captions: DataFrame, categories: list[int], images=None) -> DataFrame:
    """Images (of a start list, if given) that have every one of the categories."""
    wanted = sorted(set(categories))
    found = _among(captions, images, "image_id")
    if not wanted:
        return found.select("image_id").distinct()
    spark = captions.sparkSession
    need = spark.createDataFrame([(c,) for c in wanted], "category_id long").groupBy(F.expr("bitmap_bucket_number(category_id)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(category_id))").alias("need"))
    n = F.broadcast(need)  # a caller's list
    held = category_bitmaps(found.where(F.col("category_id").isin(wanted))).join(n, "bucket")
    buckets = len({1 + (c - 1) // 32768 if c > 0 else -(-c // 32768) for c in wanted})
    return (held.where(F.col("bits") == F.col("need")).groupBy("image_id").agg(F.count(F.lit(1)).alias("k"))
            .where(F.col("k") == buckets).select("image_id"))


def load_by_ids(table: DataFrame, ids, col: str = "id") -> DataFrame:
    """The rows (annotations, images or categories) of some ids."""
    return _among(table, ids, col)


def attach_results(results: DataFrame, images: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): results whose image is in the set, numbered from 1 by ``order`` (res_id), and those
    whose image isn't, with the reason."""
    known = images.select("image_id").distinct()
    kept = rank_within(results.join(known, "image_id", "left_semi").withColumn("_g", F.lit(0)), "_g", order)
    rejected = results.join(known, "image_id", "left_anti").withColumn("error", F.lit("its image is not in the set"))
    return kept.withColumnRenamed("rank", "res_id").drop("_g"), rejected


def box_enrich(captions: DataFrame) -> DataFrame:
    """Corner points and area of each box; results aren't crowds."""
    x, y, w, h = (F.col(k) for k in "xywh")
    return captions.select("id", x.alias("x1"), y.alias("y1"), x.alias("x2"), (y + h).alias("y2"), (x + w).alias("x3"),
                           (y + h).alias("y3"), (x + w).alias("x4"), y.alias("y4"), (w * h).alias("area"), F.lit(0).cast("int").alias("iscrowd"))
