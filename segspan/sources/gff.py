"""GFF3 and GTF annotations as DataFrames.

features: source, ord, seqid, type, start, stop, strand, gff_id, parent; coordinates as in the file,
1-based and inclusive. `ord` keeps the file's order; lines are parsed in parallel and in the JVM.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def annotation_format(path: str) -> str:
    """`gtf` if that is among the suffixes (any case, also before .gz), else `gff3`."""
    return "gtf" if "gtf" in os.path.basename(path).lower().split(".")[1:] else "gff3"


def _attribute(name: str) -> Column:
    value = F.regexp_extract("attributes", rf"(?:^|;)\s*{name}=([^;]*)", 1)
    return F.nullif(F.trim(value), F.lit(""))


def parse(lines: DataFrame, kind: str, source: str, exclude: Iterable[str] = ()) -> DataFrame:
    """Features from text lines (`value`, and `ord` if the caller has an order). Comments and short lines are skipped.

    GFF3: gff_id is ID, parent the first of Parent. GTF: both are transcript_id. Types in `exclude` are left
    out; rows without coordinates stay, with nulls.
    """
    if "ord" not in lines.columns:
        lines = lines.withColumn("ord", F.monotonically_increasing_id())
    cols = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select("ord", cols.alias("c")).where(F.size("c") >= 9)
    rows = rows.select(
        F.lit(source).alias("source"),
        "ord",
        F.col("c")[0].alias("seqid"),
        F.col("c")[2].alias("type"),
        F.col("c")[3].try_cast("long").alias("start"),
        F.col("c")[4].try_cast("long").alias("stop"),
        F.col("c")[6].alias("strand"),
        F.col("c")[8].alias("attributes"),
    )
    if kind == "gtf":
        ident = F.nullif(F.regexp_extract("attributes", r'(?:^|;)\s*transcript_id "?([^";]*)"?', 1), F.lit(""))
        rows = rows.withColumn("gff_id", ident).withColumn("parent", ident)
    else:
        rows = rows.withColumn("gff_id", _attribute("ID")).withColumn("parent", F.split_part(_attribute("Parent"), F.lit(","), F.lit(1)))
    out = rows.drop("attributes")
    exclude = list(exclude)
    return out.where(~F.col("type").isin(*exclude)) if exclude else out


def read(spark: SparkSession, path: str, source: str, exclude: Iterable[str] = ()) -> DataFrame:
    """Features of one file (or a folder of them); compressed files are read as such."""
    return parse(spark.read.text(path), annotation_format(path), source, exclude)


def _counts() -> list[Column]:
    """Of lines (`value`) that are neither empty nor comments: features, short ones (under nine columns), those without coordinates."""
    content = ~F.col("value").startswith("#") & (F.trim("value") != "")
    c = F.split("value", "\t")
    whole = F.size(c) >= 9
    placed = F.get(c, 3).try_cast("long").isNotNull() & F.get(c, 4).try_cast("long").isNotNull()
    return [F.count_if(content & whole).alias("features"), F.count_if(content & ~whole).alias("short"), F.count_if(content & whole & ~placed).alias("unplaced")]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.text(path)
    except Exception as e:
        raise RuntimeError(f"{path} can't be read as an annotation") from e


def judge(path: str, n: dict[str, int]) -> dict[str, int]:
    """Lines of which none is a feature raise a RuntimeError; short lines and missing coordinates give a warning each."""
    if n["short"] and not n["features"]:
        raise RuntimeError(f"{path} is no annotation: no line has nine columns")
    if n["short"]:
        warnings.warn(f"{path}: {n['short']} lines with fewer than nine columns are left out", stacklevel=3)
    if n["unplaced"]:
        warnings.warn(f"{path}: {n['unplaced']} features without coordinates are not evaluated", stacklevel=3)
    return n


def inspect(spark: SparkSession, path: str) -> dict[str, int]:
    """Counts of a file's lines: features, short ones (under nine columns), those without coordinates. One scan.

    A path that can't be read, or lines of which none is a feature, raise a RuntimeError; short lines and missing
    coordinates give a warning each.
    """
    return judge(path, _lines(spark, path).agg(*_counts()).first().asDict())


def observed(spark: SparkSession, path: str, source: str, exclude: Iterable[str] = ()) -> tuple[DataFrame, Observation]:
    """Features of one file or folder, and the counts of `inspect` from the same scan: they are known once the features were used."""
    seen = Observation()
    return parse(_lines(spark, path).observe(seen, *_counts()), annotation_format(path), source, exclude), seen


def lines(features: DataFrame) -> DataFrame:
    """GFF3 lines (ord, value) of features."""
    attributes = F.concat_ws(";", F.when(F.col("gff_id").isNotNull(), F.concat(F.lit("ID="), "gff_id")), F.when(F.col("parent").isNotNull(), F.concat(F.lit("Parent="), "parent")))
    return features.select("ord", F.concat_ws("\t", "seqid", F.lit("."), "type", F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("."), "strand", F.lit("."), attributes).alias("value"))


def gtf_lines(features: DataFrame) -> DataFrame:
    """GTF lines (ord, value); the transcript id is the row's own id for transcripts, else its parent."""
    ident = F.coalesce("parent", "gff_id")
    attributes = F.concat(F.lit('gene_id "g"; transcript_id "'), ident, F.lit('";'))
    return features.select("ord", F.concat_ws("\t", "seqid", F.lit("."), "type", F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("."), "strand", F.lit("."), attributes).alias("value"))


def exon_arrays(features: DataFrame, transcript_types: Iterable[str], exclude: Iterable[str] = ()) -> DataFrame:
    """seq_id (id_strand), n, lo, hi: per transcript the painted union of all its non-transcript children, clipped to it.

    A transcript without children has one row with null lo and hi; of equal keys the last in file order stays.
    """
    from pyspark.sql import Window as W

    from ..operators.runs import interval_union

    types, exclude = list(transcript_types), list(exclude)
    used = features.where(~F.col("type").isin(*exclude)) if exclude else features
    key = F.concat_ws("_", "gff_id", "strand")
    spans = used.where(F.col("type").isin(*types) & F.col("gff_id").isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull()).withColumn("seq_id", key)
    spans = spans.withColumn("_r", F.row_number().over(W.partitionBy("seq_id").orderBy(F.desc("ord")))).where("_r = 1")
    spans = spans.select("seq_id", "gff_id", F.col("start").alias("t_start"), F.col("stop").alias("t_stop"))
    kids = used.where(~F.col("type").isin(*types) & F.col("parent").isNotNull()).select(F.col("parent").alias("gff_id"), "start", "stop")
    inside = spans.join(kids, "gff_id").where("start <= t_stop and stop >= t_start")
    clipped = inside.select("seq_id", (F.greatest("start", "t_start") - F.col("t_start")).cast("int").alias("lo"), (F.least("stop", "t_stop") - F.col("t_start")).cast("int").alias("hi"))
    union = interval_union(clipped, ["seq_id"])
    return spans.select("seq_id", (F.col("t_stop") - F.col("t_start") + 1).cast("int").alias("n")).join(union, "seq_id", "left")
