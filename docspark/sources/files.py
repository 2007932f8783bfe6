"""Documents as files: a pluggable parser gives text items and images, a pluggable detector gives layout boxes.

A file that fails gives one row with its error; other files go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.cluster import ship

#: What a parser yields for each item: page, order, text, x, y, width, font size, font name.
ITEM = "page int, seq long, str string, x double, y double, width double, font_size double, font_name string"
BOX = "class string, score double, x double, y double, w double, h double"
Parser = Callable[[bytes], Iterable[tuple]]


def read_items(spark: SparkSession, path: str, make_parser: Callable[[], Parser], page_limit: int | None = None) -> DataFrame:
    """Items of the files under path, with path and error; blank items are dropped, pages over the limit too."""
    ship(spark)
    columns = [c.split(" ")[0] for c in ITEM.split(", ")]

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = make_parser()
        for part in parts:
            for name, content in zip(part.path, part.content, strict=True):
                try:
                    out = pd.DataFrame(parser(content), columns=columns).assign(error=None)
                except Exception as error:  # of this file only
                    out = pd.DataFrame([[None] * len(columns)], columns=columns).assign(error=repr(error))
                yield out.assign(path=name)[["path", *columns, "error"]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    items = files.mapInPandas(parse, f"path string, {ITEM}, error string")
    keep = F.col("error").isNotNull() | (F.trim("str") != "")
    return items.where(keep if not page_limit else keep & (F.col("error").isNotNull() | (F.col("page") <= page_limit)))


IMAGE = "page int, name string, x double, y double, w double, h double, kind string, bytes binary"


def read_images(spark: SparkSession, path: str, make_parser: Callable[[], Parser]) -> DataFrame:
    """Embedded images of the files under path, with path and error."""
    ship(spark)
    columns = [c.split(" ")[0] for c in IMAGE.split(", ")]

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = make_parser()
        for part in parts:
            for name, content in zip(part.path, part.content, strict=True):
                try:
                    out = pd.DataFrame(parser(content), columns=columns).assign(error=None)
                except Exception as error:  # of this file only
                    out = pd.DataFrame([[None] * len(columns)], columns=columns).assign(error=repr(error))
                yield out.assign(path=name)[["path", *columns, "error"]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, f"path string, {IMAGE}, error string")


def detect(pages: DataFrame, make_detector: Callable[[], Callable[[bytes], Iterable[tuple]]], least: float = 0.3, classes: tuple[str, ...] = ("image", "chart", "table")) -> DataFrame:
    """pages(doc_id, page, pixels) -> boxes that score `least` or more and are of a known class; the model is made once per worker."""
    ship(pages.sparkSession)
    columns = [c.split(" ")[0] for c in BOX.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make_detector()
        for part in parts:
            rows = [(r.doc_id, r.page, *box) for r in part.itertuples() for box in detector(r.pixels)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", *columns])

    return pages.select("doc_id", "page", "pixels").mapInPandas(run, f"doc_id long, page int, {BOX}").where((F.col("score") >= least) & F.col("class").isin(*classes))


def sparse_figures(boxes: DataFrame, ink: str = "ink") -> DataFrame:
    """Figure boxes that are large enough and neither blank nor full."""
    return boxes.where(F.col("class").isin("image", "chart") & (F.col("h") >= 40) & (F.col("w") >= 60) & F.col(ink).between(0.5, 12))


def figure_regions(pages: DataFrame, make_detector: Callable[[], Callable[[bytes], Iterable[tuple]]] | None, ink: Callable[[DataFrame], DataFrame], matched: DataFrame) -> DataFrame:
    """Figure regions of pages(doc_id, page, pixels): sparse boxes of the detector that no matched image (doc_id, page, y, h) covers.

    Without a detector there are none. ink adds the percentage of dark pixels to boxes. A region is covered if its centre
    is nearer to an image's than 0.4 of both heights.
    """
    if make_detector is None:
        return pages.sparkSession.createDataFrame([], f"doc_id long, page int, {BOX}, ink double")
    boxes = sparse_figures(ink(detect(pages, make_detector)))
    images = matched.select(F.col("doc_id").alias("its_doc"), F.col("page").alias("its_page"), F.col("y").alias("its_y"), F.col("h").alias("its_h"))
    near = F.abs(F.col("y") + F.col("h") / 2 - F.col("its_y") - F.col("its_h") / 2) < 0.4 * (F.col("h") + F.col("its_h"))
    return boxes.join(images, (F.col("doc_id") == F.col("its_doc")) & (F.col("page") == F.col("its_page")) & near, "left_anti")


def detector_recall(captioned: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pages with a caption, those of them with a figure or table box, and the share."""
    hits = captioned.join(boxes.where(F.col("class").isin("image", "chart", "table")), ["doc_id", "page"], "left_semi")
    return captioned.agg(F.count("*").alias("captioned")).join(hits.agg(F.count("*").alias("hits")), F.lit(True)).withColumn("recall", F.try_divide("hits", "captioned"))
