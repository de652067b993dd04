"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents stand in the order of that
key; distributed prefix sums of their sizes cut each source at its exact budget, after as many
whole epochs as the budget holds. All steps are native and no task ever holds a whole source:
a source is dealt into key ranges, and only one row per range meets in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .store import Scratch

#: Leading hex digits of a key that name its range: 16**3 ranges a source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; null and empty texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    empty = lambda x: F.when(x == "", 1).otherwise(0)
    n = F.size(parts)
    return (n - empty(F.element_at(parts, 1)) - F.when(n > 1, empty(F.element_at(parts, -1))).otherwise(0)).cast("long")


def source_targets(sizes: DataFrame, weights: dict[str, float] | None = None, cap: int = 3) -> DataFrame:
    """One row per source: source, source_size, target.

    The targets share the sum of all sizes by weight. Without `weights`, sources in code-point order
    (null last) weigh 1, 2, 3, repeating. A target stops at `cap` times its source's size; the excess
    is shared again by weight until none is above: the water level `u` solves
    sum(min(cap * size, weight * u)) = total, and is read off prefix sums over cap * size / weight.
    Works on one row per source, so its windows see no documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
        per = per.withColumn("weight", ((rank - 1) % 3 + 1).cast("long"))
    else:
        w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        per = per.withColumn("weight", F.coalesce(F.try_element_at(w, F.coalesce("source", F.lit(""))), F.lit(0.0)))
    everything = W.partitionBy()
    order = W.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    per = (
        per.withColumn("ceiling", F.col("source_size") * cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum("ceiling").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level_here", (F.col("total") - F.col("full_before")) / F.col("weight_from"))
    )
    # The first source, in this order, that the level does not fill sets the level for all after it.
    level = F.max(F.when(F.col("ceiling") >= F.col("weight") * F.col("level_here"), F.col("level_here"))).over(everything)
    target = F.least(F.col("ceiling").cast("double"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    return per.withColumn("target", target.cast("double")).select("source", "source_size", "target")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, cap: int = 3, seed: str = "", rows_as: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of `docs`.

    With `rows_as`, the whole input row rides along as a struct of that name.

    `taken` counts the words that the mix takes of a row, repeats included: a multiple of its size for
    whole epochs, and in the last epoch all, a part (the row at the cut) or none of it. The sum over a
    source is its target rounded down. Equal seeds give equal mixes.

    Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its own,
    last in order; a null doc_id counts as the empty string in the key, so rows without an id still spread by their
    texts; equal rows follow one another and are taken one by one; an empty table gives an empty frame; other columns
    are not read.
    """
    words_of = F.coalesce(F.col(text), F.lit(""))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("/"), F.md5(words_of)))
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias(rows_as)] if rows_as else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("key"), word_count(F.col(text)).alias("size"), *whole)
    rows = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    order = ["key", "doc_id", "size"]
    if rows_as:
        plain = [F.col(f"{rows_as}.`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
        rows = rows.withColumn("tie", F.xxhash64(*plain))
        order.append("tie")
    else:
        # One pass over the texts: everything after it reads these short columns.
        rows = Scratch(docs.sparkSession, "mixing").put("sizes", rows)
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("size"))
    starts = ranges.withColumn("before", F.sum("size").over(W.partitionBy("source").orderBy("range")) - F.col("size"))
    starts = starts.select(F.col("source").alias("s"), F.col("range").alias("r"), "before")
    targets = source_targets(ranges, weights, cap).withColumnRenamed("source", "t")
    inside = W.partitionBy("source", "range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = (
        rows.withColumn("upto", F.sum("size").over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .join(targets, F.col("source").eqNullSafe(F.col("t")))
    )
    words = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - epochs * F.col("source_size")
    start = F.col("before") + F.col("upto") - F.col("size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return out.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + last).cast("long").alias("taken"), *([rows_as] if rows_as else []))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM {docs}
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS ceiling,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM per
), levels AS (
  SELECT *, CAST(total - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level_here
  FROM weighed
), targets AS (
  SELECT source, source_size, least(CAST(ceiling AS DOUBLE), weight * coalesce(max(CASE WHEN ceiling >= weight * level_here THEN level_here END) OVER (), CAST('inf' AS DOUBLE))) AS target
  FROM levels
), placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS words,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, words - epochs * source_size - start)) AS BIGINT) AS taken
FROM cut
"""
