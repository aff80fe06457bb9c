"""Other readers and writers: page JSON, sample lists, files of samples, resources, checksums, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import schemas


class SourceError(ValueError):
    """Inputs that do not fit together."""


def stem(path: Column) -> Column:
    """A file's name up to its first dot."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^/]*)?$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def files(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None, one_folder: bool = False) -> DataFrame:
    """(path, length, content, stem) of files, to be ordered by path; content is read only where it is used."""
    reader = spark.read.format("binaryFile")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(list(paths) if not isinstance(paths, str) else paths)
    if one_folder and found.select(parent(F.col("path"))).distinct().limit(2).count() > 1:
        raise SourceError("paths lie in several folders")
    return found.withColumn("stem", stem(F.col("path")))


def first_pages(found: DataFrame, limit: int) -> DataFrame:
    """The first pages by path, before anything else is looked at."""
    return found.orderBy("path").limit(limit)


def with_suffix(path: Column, old: str, new: str) -> Column:
    """A path with another suffix: how files of one sample are related."""
    return F.regexp_replace(path, old.replace(".", r"\.") + "$", new)


def paired(images: DataFrame, annotations: DataFrame, image_suffix: str, label_suffix: str) -> DataFrame:
    """(img_path, label_path): images that have an annotation beside them."""
    want = images.select(F.col("path").alias("img_path"), with_suffix(F.col("path"), image_suffix, label_suffix).alias("label_path"))
    return want.join(annotations.select(F.col("path").alias("label_path")), "label_path", "left_semi").select("img_path", "label_path")


def work_list(images: DataFrame, image_suffix: str, layout_suffix: str, output_suffix: str, markers: DataFrame | None = None) -> DataFrame:
    """Distinct (img_path, layout_path, output_path); with markers only of folders that hold one of those files."""
    if markers is not None:
        images = images.join(markers.select(parent(F.col("path")).alias("_dir")), parent(F.col("path")) == F.col("_dir"), "left_semi")
    path = F.col("path")
    return images.select(path.alias("img_path"), with_suffix(path, image_suffix, layout_suffix).alias("layout_path"), with_suffix(path, image_suffix, output_suffix).alias("output_path")).dropDuplicates()


def not_done(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What has no result yet: makes a repeated or resumed job idempotent."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def read_pages(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Page documents in JSON, one a file, by the declared schema; page_id is the file's stem."""
    return spark.read.schema(schemas.DOCUMENT).json(paths, multiLine=True).withColumn("page_id", stem(F.col("_metadata.file_path")))


def page_json(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, json), absent fields left out."""
    return pages.select(key, F.to_json(F.struct(*(c for c in pages.columns if c != key))).alias("json"))


MASKED = r"(?s)^(.+)<\[([^>]*)\]>$"
PAIR = r"\((\d+),\s*(\d+)\)"


def split_masks(text: Column) -> Column:
    """(text, masks) of a transcription that may end with `<[(offset, length), ...]>`; parsed by pattern."""
    masked = text.rlike(MASKED)
    body = F.regexp_extract(text, MASKED, 2)
    off, size = (F.regexp_extract_all(body, F.lit(PAIR), F.lit(g)) for g in (1, 2))
    masks = F.transform(F.arrays_zip(off.alias("o"), size.alias("l")), lambda x: F.struct(x["o"].cast("int").alias("off"), x["l"].cast("int").alias("len")))
    none = F.array().cast("array<struct<off:int,len:int>>")
    return F.struct(F.when(masked, F.regexp_extract(text, MASKED, 1)).otherwise(text).alias("text"), F.when(masked, masks).otherwise(none).alias("masks"))


def join_masks(text: Column, masks: Column) -> Column:
    """The inverse of split_masks()."""
    pairs = F.array_join(F.transform(masks, lambda m: F.format_string("(%d,%d)", m["off"], m["len"])), ",")
    return F.when(F.size(masks) > 0, F.concat(text, F.lit("<["), pairs, F.lit("]>"))).otherwise(text)


SAMPLE_LIST = "img_path string, gt string, height int, width int"


def read_samples(spark: SparkSession, path: str, header: bool = True, channel: bool = False) -> DataFrame:
    """A sample list: tab-separated path, transcription (maybe with masks), height, width and maybe channel."""
    schema = SAMPLE_LIST + ", channel string" * channel
    rows = spark.read.csv(path, sep="\t", header=header, schema=schema, quote="", enforceSchema=True)
    return rows.withColumn("_m", split_masks(F.col("gt"))).select("img_path", F.col("_m.text").alias("transcription"), F.col("_m.masks").alias("expansion_masks"), "height", "width", *(["channel"] if channel else []))


def write_samples(samples: DataFrame, path: str, mode: str = "error") -> None:
    """The inverse of read_samples(): tab-separated with a header; tabs and line ends in texts become spaces."""
    gt = F.translate(join_masks(F.col("transcription"), F.col("expansion_masks")), "\t\n\r", "   ")
    rows = samples.select(F.col("img_path").alias("ImgPath"), gt.alias("GT"), F.col("height").alias("Height"), F.col("width").alias("Width"), *([F.col("channel").alias("Channel")] if "channel" in samples.columns else []))
    rows.write.mode(mode).csv(path, sep="\t", header=True, quote="", emptyValue="")


def samples(images: DataFrame, texts: DataFrame, masks: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """Line samples from files() by stem: image and text must be there, so must the mask; the channel may be missing."""
    out = images.select("stem", F.col("content").alias("img")).join(texts.select("stem", F.regexp_replace(F.decode("content", "utf-8"), r"(?U)\s+$", "").alias("transcription")), "stem")
    out = out.join(masks.select("stem", F.col("content").alias("binary_mask")), "stem", "left")
    out = out.filter(F.when(F.col("binary_mask").isNull(), F.raise_error(F.concat(F.lit("no mask for "), F.col("stem")))).otherwise(True))
    return out.join(channels.select("stem", F.col("content").alias("img_channel")), "stem", "left") if channels is not None else out


def write_lines(found: DataFrame, path: str, partition: str = "iteration", mode: str = "overwrite") -> None:
    """Line samples as Parquet, a folder for each iteration; overwriting touches only the iterations written."""
    found.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_alphabet(table: DataFrame, path: str, mode: str = "error") -> None:
    """symbol and code, tab-separated, by symbol; an alphabet is bounded by Unicode."""
    table.orderBy("symbol").coalesce(1).select(F.concat_ws("\t", "symbol", F.col("code").cast("string"))).write.mode(mode).text(path)


def write_confusions(table: DataFrame, path: str, mode: str = "error") -> None:
    """Confusions as sparse rows of Parquet; absent pairs are zero."""
    table.write.mode(mode).parquet(path)


def report(predictions: DataFrame, metadata: Sequence[str] = (), decimals: int = 4) -> DataFrame:
    """(id, prediction, gt, scores, metadata...) as strings for a tab-separated report."""
    optional = [F.col("gt")] if "gt" in predictions.columns else []
    scores = [F.array_join(F.transform("scores", lambda s: F.round(s, decimals).cast("string")), " ").alias("scores")] if "scores" in predictions.columns else []
    return predictions.select("id", "prediction", *optional, *scores, *metadata)


def read_resource(spark: SparkSession, path: str) -> DataFrame:
    """A data set's description."""
    return spark.read.schema(schemas.RESOURCE).json(path, multiLine=True)


def checksums(found: DataFrame) -> DataFrame:
    return found.select("path", F.md5("content").alias("md5"))


def tree_checksum(sums: DataFrame, by: Sequence[str] = (), order: str = "path", md5: str = "md5") -> DataFrame:
    """md5 of the concatenated md5s of a folder's files, in order of their paths: 32 characters a file."""
    ordered = F.sort_array(F.collect_list(F.struct(order, md5)))
    return sums.groupBy(*by).agg(F.md5(F.array_join(F.transform(ordered, lambda x: x[md5]), "").cast("binary")).alias("md5"))
