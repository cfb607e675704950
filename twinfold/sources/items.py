"""Items from tables of page elements and from image files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.bits import hash_base64
from twinfold.functions.domains import fetchable, host, resolved, to_https
from twinfold.functions.grids import gray_image, luminance
from twinfold.functions.hashes import image_hash

LISTING, SEARCH = "listing page", "search page"


def page_route(classes: Column, found: Column | None = None) -> Column:
    """struct(page_type, container, reason) by the classes of a page's body; container is null for pages that are not searched.

    found: the containers that the page has; one that lacks its container is not searched either.
    """
    has = lambda c: F.array_contains(classes, c)
    route = lambda kind, container, why: F.struct(F.lit(kind).cast("string").alias("page_type"), F.lit(container).cast("string").alias("container"), F.lit(why).cast("string").alias("reason"))

    def searched(kind: str, container: str) -> Column:
        if found is None:
            return route(kind, container, None)
        return F.when(F.array_contains(found, container), route(kind, container, None)).otherwise(route(kind, None, "no container"))

    return (
        F.when(classes.isNull() | (F.size(classes) == 0), route(None, None, "no body class"))
        .when(has("single-page"), route(None, None, "single page"))
        .when(has("listing-page"), searched(LISTING, "#siteTable"))
        .when(has("search-page") & has("combined-search-page"), searched(SEARCH, ".search-result-group:last"))
        .when(has("search-page"), searched(LISTING, "#siteTable"))
        .otherwise(route(None, None, "other"))
    )


def project(things: DataFrame) -> DataFrame:
    """url and domain of listed things: a listing has both as they are; a search result's come from its link, or are null. Links are completed by page_url where there is one."""
    link = F.coalesce("search_link", "search_title")
    if "page_url" in things.columns:
        link = resolved(link, F.col("page_url"))
    listing = F.col("page_type") == LISTING
    kind = F.when(F.col("page_type").isin(LISTING, SEARCH), F.col("page_type")).otherwise(F.raise_error(F.concat(F.lit("unknown page type: "), F.coalesce("page_type", F.lit("null")))))
    return things.withColumns({"page_type": kind, "url": F.when(listing, F.col("data_url")).otherwise(link), "domain": F.when(listing, F.col("data_domain")).otherwise(host(link))})


def background_requests(requests: DataFrame) -> DataFrame:
    """Add fetch_url and error: only allowed hosts are fetched, and by https. Urls are completed by page_url where there is one."""
    url = resolved(F.col("url"), F.col("page_url")) if "page_url" in requests.columns else F.col("url")
    ok = fetchable(url)
    return requests.withColumns({"fetch_url": F.when(ok, to_https(url)), "error": F.when(~ok, F.lit("host is not allowed"))})


def background_replies(requests: DataFrame, images: DataFrame, function: str) -> DataFrame:
    """Add reply and error: the fingerprint in base 64 of the image that a request may fetch, or what went wrong, which is not told further.

    images: rows (fetch_url, grid), one for each url; a null grid is an image that can't be read.
    """
    asked = background_requests(requests).drop("error").join(images.select("fetch_url", image_hash(F.col("grid"), function).alias("_hash")), "fetch_url", "left")
    failed = F.when(F.col("_hash").isNull(), F.lit("Failed to get image hash"))
    return asked.withColumns({"reply": hash_base64(F.col("_hash")), "error": failed}).drop("_hash")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def grid_of(image: pd.DataFrame) -> pd.Series:
    """32 x 32 luminance of images as Spark's image source has them; null for a broken one."""
    out = [luminance(row) for row in image.to_dict("records")]
    return pd.Series([None if g is None else g.ravel().tolist() for g in out], dtype=object)


def image_grids(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Rows (origin, width, height, grid) of image files; an unreadable one has a null grid."""
    read = spark.read.format("image").option("dropInvalid", drop_invalid).load(path)
    return read.select("image.origin", "image.width", "image.height", grid_of(F.struct("image.height", "image.width", "image.nChannels", "image.data")).alias("grid"))


def image_hashes(spark: SparkSession, path: str, function: str) -> DataFrame:
    """Rows (origin, hash) of image files; null for one that can't be read."""
    return image_grids(spark, path).select("origin", image_hash(F.col("grid"), function).alias("hash"))


def image_looks(spark: SparkSession, path: str, function: str) -> DataFrame:
    """Rows (origin, hash, levels) of image files, as image_hashes() and gray_images() tell them, from one reading."""
    image = F.struct("image.height", "image.width", "image.nChannels", "image.data")
    read = spark.read.format("image").load(path).select("image.origin", grid_of(image).alias("grid"), gray_image(image).alias("levels"))
    return read.select("origin", image_hash(F.col("grid"), function).alias("hash"), "levels")


def gray_images(spark: SparkSession, path: str) -> DataFrame:
    """Rows (origin, levels): images as 32 x 32 whole gray levels."""
    read = spark.read.format("image").load(path)
    return read.select("image.origin", gray_image(F.struct("image.height", "image.width", "image.nChannels", "image.data")).alias("levels"))


def image_files(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,gif,bmp}") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
