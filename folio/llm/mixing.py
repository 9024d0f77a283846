"""Mixing sources to target shares of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.tokenize import token_counts
from folio.session import written


def with_rates(targets: DataFrame, total: float | None) -> DataFrame:
    """(source, target_share, max_repeats, n tokens) with rate: how often each source's documents are used, for a mixture of `total` tokens, or all that there are.

    A source that would need more than its most repeats gets just those; what it leaves of the total goes to the others in
    proportion to their shares, until no further one is short. A source without tokens gets 0. What an open source gets is its share times one
    level, which rises as sources get short: each round is one aggregate over the targets, of which only the sums reach the driver.
    """
    usable = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("n") > 0)
    most = F.col("max_repeats") * F.col("n")
    level, before = 0.0, -1
    while True:
        short = usable & (level * F.col("target_share") > most * (1 + 1e-12))
        one = targets.agg(F.sum("n").alias("n"), F.sum(F.when(short, most)).alias("taken"), F.sum(F.when(usable & ~short, F.col("target_share"))).alias("open"), F.count_if(short).alias("short")).first()
        if one["short"] == before or not one["open"]:
            break
        before = one["short"]
        level = ((total if total is not None else float(one["n"] or 0)) - float(one["taken"] or 0)) / one["open"]
    gets = F.when(short, F.col("max_repeats").cast("double")).otherwise(F.lit(level) * F.col("target_share") / F.col("n"))
    return targets.withColumn("rate", F.when(usable, gets).otherwise(F.lit(0.0)))


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, **tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, copy_no, n_tokens), and the report of shares by source.

    total: its size in tokens, or else all tokens of the listed sources. Each document is used floor(rate) times, and once more
    if a hash of its id, its text and the seed falls under the rate's fraction; so no document is used more than max_repeats times, and the
    same rows give the same mixture. A source that cannot fill its share (see rates) is reported as capped. Documents of unlisted
    or null sources are not used; null and empty texts have 0 tokens and are used like their source's others; rows that are
    repeated count each; a null doc_id is kept; a target listed twice counts once with its largest share; null max_repeats count
    as 1. Without documents or targets the mixture is empty; the report has every listed source. Tokens are counted once, over
    the listed sources only, summed per source before the shuffle, and written to the shared folder.
    """
    listed = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("int").alias("max_repeats")
    )
    used = documents.select("doc_id", "source", F.xxhash64("text").alias("text_key"), "text").join(listed.select("source"), "source", "left_semi")
    counted = written(token_counts(used, ["doc_id", "source", "text_key"], **tokenizer), "mixture")
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("documents"))
    known = listed.join(sums, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("n"), F.coalesce("documents", F.lit(0)).alias("documents"))
    plan = with_rates(written(known, "targets"), float(total) if total is not None else None).withColumnRenamed("n", "available_tokens")
    drawn = F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    copies = F.floor("rate") + F.when(drawn < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    mixed = counted.join(plan.select("source", "rate"), "source").withColumn("__n", copies.cast("int"))
    mixed = mixed.where("__n > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(1), "__n")).alias("copy_no"), "n_tokens")
    actual = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.max("copy_no").alias("most_used"))
    whole = actual.agg(F.sum("mixed_tokens").alias("whole"))
    report = plan.join(actual, "source", "left").join(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "documents", "available_tokens", "rate", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        (F.coalesce("mixed_tokens", F.lit(0)) / F.col("whole")).alias("actual_share"), F.coalesce("most_used", F.lit(0)).alias("most_used"),
        ((F.col("rate") >= F.col("max_repeats")) | (F.col("available_tokens") == 0)).alias("capped"),
    )
    return mixed, report
