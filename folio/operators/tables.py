"""Keyed tables without row transactions: latest and strongest rows, upserts, insert-or-ignore, ordered lists, corrections, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; ties must be broken by it. Spark prunes each task's rows to one a key before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def upserted(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """base with changes by key; the row with the greatest version wins, and a change wins over base."""
    both = base.withColumn("__c", F.lit(0)).unionByName(changes.withColumn("__c", F.lit(1)))
    return first_by(both, keys, F.desc("__c"), F.desc(version)).drop("__c")


def inserted(base: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """base and the first of the rows of each key that base doesn't have."""
    return base.unionByName(first_by(rows.join(base.select(*keys), keys, "left_anti"), keys, *order))


def strongest(candidates: DataFrame, key: str, score: list[str], tie: str) -> DataFrame:
    """The candidate of each key with the greatest score, compared field by field; the smaller tie-breaker on ties."""
    return first_by(candidates.where(F.col(key).isNotNull()), [key], *[F.desc(c) for c in score], F.asc(tie))


def order_with_insert(items: DataFrame, by: str, item: str, order: str, new_id: Column, at: Column) -> DataFrame:
    """(by, item, order) with a new item in each group at a place, all from there on moved by one."""
    moved = items.select(by, item, F.when(F.col(order) >= at, F.col(order) + 1).otherwise(F.col(order)).alias(order))
    return moved.unionByName(items.select(by).distinct().select(by, new_id.alias(item), at.cast(items.schema[order].dataType).alias(order)))


def order_with_move(items: DataFrame, order: str, source: Column, target: Column) -> DataFrame:
    """items with the one at `source` moved to `target`, those between moved by one."""
    o = F.col(order)
    down = (source < target) & (o > source) & (o <= target)
    up = (target < source) & (o >= target) & (o < source)
    return items.withColumn(order, F.when(o == source, target).when(down, o - 1).when(up, o + 1).otherwise(o).cast(items.schema[order].dataType))


def corrected(regions: DataFrame, corrections: DataFrame, key: str, text: str) -> DataFrame:
    """regions with corrected texts where there are any; the latest correction of each wins."""
    latest = first_by(corrections, [key], F.desc("updated_at"), F.desc("correction")).select(key, "correction")
    return regions.join(latest, key, "left").withColumn(text, F.coalesce("correction", F.col(text))).drop("correction")


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def even_split(lines: DataFrame, by: str, number: str, columns: int) -> DataFrame:
    """lines with the column each belongs to, from 0: even, and the last columns take what is over."""
    n, i = F.count("*").over(Window.partitionBy(by)), F.row_number().over(Window.partitionBy(by).orderBy(number)) - 1
    base, extra = F.floor(n / columns), n % columns
    short = (F.lit(columns) - extra) * base
    return lines.withColumn("column_no", F.when(i < short, F.floor(i / F.greatest(base, F.lit(1)))).otherwise(F.lit(columns) - extra + F.floor((i - short) / (base + 1))).cast("int"))
