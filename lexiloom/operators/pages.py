"""Page statistics of a document and the image-heavy decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lexiloom.dimensions import ANALYSED_PAGES, MEANINGFUL_TEXT


def first_pages(pages: DataFrame, n: int = ANALYSED_PAGES) -> DataFrame:
    """First ``n`` pages per document; the rank limit runs before the shuffle."""
    order = Window.partitionBy("doc").orderBy("page_no")
    return pages.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n).drop("__rank")


def page_stats(pages: DataFrame) -> DataFrame:
    """Counts, ratios and averages over the analysed pages, and the total number of pages."""
    analysed = first_pages(pages).groupBy("doc").agg(
        F.count(F.lit(1)).alias("analysed_pages"),
        F.count_if(F.col("text_length") > MEANINGFUL_TEXT).alias("text_pages"),
        F.count_if(F.col("image_count") > 0).alias("image_pages"),
        F.sum("text_length").cast("long").alias("total_text_length"),
        F.sum("image_count").cast("long").alias("total_images"),
    )
    totals = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("total_pages"))
    n = F.col("analysed_pages")
    return totals.join(analysed, "doc").select(
        "doc", "total_pages", "analysed_pages", "text_pages", "image_pages",
        (F.col("text_pages") / n).alias("text_ratio"),
        (F.col("image_pages") / n).alias("image_ratio"),
        (F.col("total_text_length") / n).alias("avg_text_per_page"),
        (F.col("total_images") / n).alias("avg_images_per_page"),
        "total_text_length", "total_images",
    )


def image_heavy(documents: DataFrame, stats: DataFrame) -> DataFrame:
    """Image-heavy flag of every document; one without readable pages counts as image-heavy."""
    defaults = {
        "total_pages": 0, "analysed_pages": 0, "text_pages": 0, "image_pages": 0, "text_ratio": 0.0,
        "image_ratio": 1.0, "avg_text_per_page": 0.0, "avg_images_per_page": 1.0,
        "total_text_length": 0, "total_images": 1,
    }
    joined = documents.select("doc").distinct().join(stats, "doc", "left").fillna(defaults)
    average = F.col("avg_text_per_page")
    heavy = (F.col("text_ratio") < 0.3) | (average < 50) | ((F.col("image_ratio") > 0.7) & (average < 200))
    return joined.withColumn("is_image_heavy", heavy).withColumn(
        "recommended_processing", F.when(F.col("is_image_heavy"), "llamaparse").otherwise("direct_upload")
    )
