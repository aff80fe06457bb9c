"""Whole jobs: compiling line samples, decoding, evaluating, converting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import nested
from vellum.operators import decoding, layout, metrics
from vellum.operators.alphabet import Alphabet
from vellum.sources import pagexml


def compile_lines(pages: DataFrame, stem: str = "page_id") -> DataFrame:
    """Parsed pages to line samples: sample_id, region frame coordinates, size of the crop and text; one lazy plan.

    A sample is named by its region, so lines without one give none; outside_regions() has them.
    """
    found = pagexml.lines(pages, stem).filter(F.size("region_ids") > 0)
    outer = pagexml.regions(pages, stem).filter(F.size("parent_ids") == 0)
    outer = outer.withColumn("_b", nested.box(F.col("coords"))).select(stem, "region_id", "_b.*")
    rows = layout.in_region(found, outer, stem)
    at = F.row_number().over(_in_order(stem))
    rows = rows.withColumn("_k", at - 1).withColumn("_box", nested.box(F.col("coords")))
    return rows.select(layout.sample_name(F.col(stem), F.col("region_id"), F.col("_k")).alias("sample_id"), stem, "region_id", F.col("_k").alias("line_pos"), "coords", "baseline", (F.col("_box.r") - F.col("_box.l") + 1).alias("width"), (F.col("_box.b") - F.col("_box.t") + 1).alias("height"), F.col("text").alias("transcription"))


def outside_regions(pages: DataFrame, stem: str = "page_id") -> DataFrame:
    """The lines that compile_lines() leaves out: those without a region."""
    return pagexml.lines(pages, stem).filter(F.coalesce(F.size("region_ids"), F.lit(0)) <= 0)


def _in_order(stem: str):
    from pyspark.sql import Window

    return Window.partitionBy(stem, "region_id").orderBy("line_pos")


def decode(samples: DataFrame, alphabet: Alphabet, frames: str = "frames", split_output: bool = False, decoder: Callable[[Column, Column | None], Column] = decoding.greedy) -> DataFrame:
    """Samples with prediction and scores from their frames of class scores, by any decoder that decoding.predicted() takes."""
    if split_output:
        samples = samples.withColumn(frames, F.transform(frames, decoding.half))
    return decoding.predicted(samples, alphabet, frames, decoder=decoder)


def compiled_counts(compiled: DataFrame, stem: str = "page_id") -> DataFrame:
    """(n_lines, n_files) of compiled lines."""
    return compiled.agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct(stem).alias("n_files"))


def sample_log(predictions: DataFrame, alphabet: Alphabet, k: int, order: str = "id", pred: str = "prediction", gt: str = "gt") -> DataFrame:
    """(order, prediction, reduced, gt) of the first k samples, for a run's log; reduced is the ground truth in the alphabet's form."""
    return predictions.orderBy(order, pred, gt).limit(k).select(order, F.col(pred).alias("prediction"), alphabet.reduce(F.col(gt)).alias("reduced"), F.col(gt).alias("gt"))


def evaluate(predictions: DataFrame, alphabet: Alphabet, by: tuple[str, ...] = (), pred: str = "prediction", gt: str = "gt") -> DataFrame:
    """Error rates of predictions against ground truths in the alphabet's reduced form."""
    rows = predictions.withColumn("_gt", alphabet.reduce(F.col(gt)))
    return metrics.error_rates(metrics.scored(rows, pred, "_gt"), by)


def xml_to_json(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, json) of parsed pages, lines at the top with their regions."""
    line = lambda x: F.struct(x["line_id"].alias("id"), x["baseline"].alias("baseline"), x["coords"].alias("coords"), x["region_ids"].alias("regions"), x["text"].alias("text"), x["custom"].alias("custom"))
    region = lambda r: F.struct(r["region_id"].alias("id"), r["coords"].alias("coords"))
    body = F.struct(F.struct("created", "creator", "comments").alias("metadata"), F.lit("baselines").alias("type"), F.lit("horizontal-lr").alias("text_direction"), "image_filename", "image_width", "image_height", F.transform("lines", line).alias("lines"), F.transform("regions", region).alias("regions"))
    return pages.select(key, F.to_json(body).alias("json"))


def json_to_xml(pages: DataFrame, key: str = "page_id", with_text: bool = True) -> DataFrame:
    """(page_id, xml) of page documents, whichever way their lines stand."""
    line = lambda x, i: F.struct(i.cast("int").alias("line_pos"), x["id"].alias("line_id"), x["regions"].alias("region_ids"), x["coords"].alias("coords"), x["baseline"].alias("baseline"), x["text"].alias("text"), x["custom"].alias("custom"))
    none = F.array().cast(pages.schema["lines"].dataType)
    inner = F.flatten(F.transform(F.coalesce("regions", F.array().cast(pages.schema["regions"].dataType)), lambda r: F.transform(F.coalesce(r["lines"], none), lambda x: x.withField("regions", F.array(r["id"])))))
    top = F.when(F.size(F.coalesce("lines", none)) > 0, F.col("lines")).otherwise(inner)
    region = lambda r, i: F.struct(i.cast("int").alias("region_pos"), r["id"].alias("region_id"), F.array().cast("array<string>").alias("parent_ids"), r["coords"].alias("coords"))
    rows = pages.select(key, "image_filename", "image_width", "image_height", F.col("metadata.creator").alias("creator"), F.col("metadata.created").alias("created"), F.col("metadata.comments").alias("comments"), F.transform(top, line).alias("lines"), F.transform("regions", region).alias("regions"))
    return pagexml.emitted(rows, key, with_text)
