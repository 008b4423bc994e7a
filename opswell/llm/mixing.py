"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from opswell.llm.rows import carried
from opswell.session import settle

WORD = r"[^\x20\x09-\x0D]+"
#: No source gives more than so many times its own words.
MOST_EPOCHS = 3
#: Rows in one range of hash keys; a source with more rows has more ranges.
ROWS_PER_RANGE = 4_000


def words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds `target` to rows (source, weight, source_size): all words shared by weight, none above `most` times its source.

    Sources reach their bound in the order of bound over weight. Once those up to
    some place are full, the others share the rest by weight; the first place
    where the next source stays below its bound is the answer. A source without
    words has target 0.
    """
    order = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    bound = F.col("source_size") * most
    level = sources.withColumn("_full_at", bound / F.col("weight")).select(
        "*",
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum(bound).over(before), F.lit(0))) / F.sum("weight").over(onward)).alias("_level"),
    )
    # The level rises while sources fill up; the first one that is not full sets it. Of several with one bound over weight
    # that is the one with the highest level, as each that is taken for full though it is not lowers the next one's.
    open_level = -F.min(F.when(F.col("_full_at") >= F.col("_level"), F.struct("_full_at", (-F.col("_level")).alias("_down")))).over(everything)["_down"]
    return level.withColumn(
        "target", F.when(F.col("_full_at") < F.coalesce(open_level, F.lit(0.0)), bound.cast("double")).otherwise(F.coalesce(open_level, F.lit(0.0)) * F.col("weight"))
    ).drop("_full_at", "_level")


def weighted(sizes: DataFrame, weights=(1, 2, 3)) -> DataFrame:
    """One row per source: source, weight (repeating in the order of code points, null last), source_size, source_rows."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    return totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))


def mix(docs: DataFrame, keep: list[str], weights=(1, 2, 3), most: int = MOST_EPOCHS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The columns of `keep` with size, source_size, target and taken (words the mix takes, repeats counted).

    docs: doc_id, source, text and whatever `keep` names. Each row gets a key from
    the md5 of its doc_id. The rows of a source are cut into ranges of keys, as
    many as its rows ask for, so a source with a third of all rows is many ranges.
    Sums of ranges give each range its start, a running sum inside the range each
    row its start, and the budget of the source says how much of the row is taken:
    whole epochs, then rows in the order of keys until the budget is used up to the
    word; the row at the cut is taken in part.

    Null texts and texts without words have size 0 and taken 0. Null sources are one
    source, last. Rows with equal doc_id are ordered by size, then by their kept
    columns. Without rows the result is empty.
    """
    sized = settle(
        docs.select(
            *keep,
            F.col("source").alias("_source"),
            words("text").alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")).alias("_key"),
            F.col("doc_id").alias("_id"),
        )
    )
    of = weighted(sized.select(F.col("_source").alias("source"), "size"), weights)
    budget = settle(targets(of, most)).select(
        F.col("source").alias("_of"), "source_size", "target", F.greatest(F.ceil(F.col("source_rows") / rows_per_range), F.lit(1)).alias("_ranges")
    )
    share = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / 2.0**32
    ranged = sized.join(budget, F.col("_source").eqNullSafe(F.col("_of"))).withColumn("_range", F.floor(share * F.col("_ranges")))
    starts = ranged.groupBy(F.col("_of").alias("_s_of"), F.col("_range").alias("_s_range")).agg(F.sum("size").alias("_sum")).select(
        "_s_of",
        "_s_range",
        F.coalesce(F.sum("_sum").over(Window.partitionBy("_s_of").orderBy("_s_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_range_start"),
    )
    inside = Window.partitionBy("_of", "_range").orderBy("_key", "_id", "size", F.xxhash64(*keep)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("_until", F.sum("size").over(inside))
        .join(starts, F.col("_of").eqNullSafe(F.col("_s_of")) & (F.col("_range") == F.col("_s_range")))
        .withColumn("_start", F.col("_range_start") + F.col("_until") - F.col("size"))
        .withColumn("_budget", F.floor("target"))
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)))
    )
    left = F.col("_budget") - F.col("_epochs") * F.col("source_size") - F.col("_start")
    taken = F.col("_epochs") * F.col("size") + F.least(F.greatest(left, F.lit(0)), F.col("size"))
    return placed.select(*keep, "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, weights=(1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """The documents of the mix with their own columns: a row for each copy.

    Copies are whole. The one at a source's budget's cut is taken if at least half
    of its words are within the budget. Documents without words are in no mix; null
    texts, sources, ties and empty tables are as in `mix`.
    """
    plan = mix(carried(docs), ["_doc"], weights, most)
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    taken = plan.filter((F.col("size") > 0) & (copies > 0))
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), copies)).alias("_copy")).select("_doc.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, source_size * 3 / CAST(weight AS DOUBLE) AS full_at,
         (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(source_size * 3) OVER before, 0))
           / CAST(sum(weight) OVER onward AS DOUBLE) AS level
  FROM totals
  WINDOW before AS (ORDER BY source_size * 3 / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS (ORDER BY source_size * 3 / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
opened AS (SELECT min_by(level, full_at) AS level FROM levels WHERE full_at >= level),
budgets AS (
  SELECT source, source_size,
         CASE WHEN full_at < opened.level THEN CAST(source_size * 3 AS DOUBLE) ELSE opened.level * weight END AS target
  FROM levels, opened),
placed AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, CAST(floor(b.target) AS BIGINT) AS budget,
         CASE WHEN b.source_size > 0 THEN CAST(floor(b.target) AS BIGINT) // b.source_size ELSE 0 END AS epochs,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS start
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       epochs * size + least(greatest(budget - epochs * source_size - start, 0), size) AS taken
FROM placed
"""
