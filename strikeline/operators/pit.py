"""Point-in-time rules: availability, effective intervals, unambiguous enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def available(df: DataFrame, decision: Column, at: str = "available_at") -> DataFrame:
    """Only what was known at the decision."""
    return df.where(F.col(at) <= decision)


def match_master(observations: DataFrame, master: DataFrame, decision: Column, id_col: str = "contract_id", row_col: str = "record_index", at: str = "ts") -> DataFrame:
    """Every observation once, with the values of its master record if exactly one fits, and ``match_status``.

    A record fits if the id is equal, effective_from <= at <= effective_to (null:
    open) and it was available.  Matches are counted by a partial aggregation on
    the row number, not collected: several fits exclude the row, however many.
    The join is left to the optimizer: broadcast if the master is small by its
    statistics, else a sort-merge join that AQE can split.
    """
    m = available(master, decision).select(F.col(id_col).alias("__id"), F.col("effective_from").alias("__from"), F.col("effective_to").alias("__to"), F.struct(*[c for c in master.columns if c not in (id_col, "available_at")]).alias("__m"))
    fits = (F.col(id_col) == F.col("__id")) & (F.col("__from") <= F.col(at)) & (F.col("__to").isNull() | (F.col(at) <= F.col("__to")))
    joined = observations.join(m, fits, "inner")
    found = joined.groupBy(F.col(row_col).alias("__row")).agg(F.count("*").alias("__n"), F.min("__m").alias("__m"))
    out = observations.join(found, F.col(row_col) == F.col("__row"), "left")
    n = F.coalesce(F.col("__n"), F.lit(0))
    said = F.when(n == 1, "ENRICHED").when(n == 0, "CONTRACT_MASTER_NOT_FOUND").otherwise("CONTRACT_MASTER_AMBIGUOUS")
    own = [c for c in master.columns if c not in (id_col, "available_at") and c not in observations.columns]
    return out.select(*observations.columns, *(F.when(n == 1, F.col(f"__m.{c}")).alias(c) for c in own), n.alias("matches"), said.alias("match_status"))


def overlapping_intervals(master: DataFrame, id_col: str = "contract_id") -> DataFrame:
    """Pairs of neighbouring versions of a contract whose intervals overlap."""
    w = Window.partitionBy(id_col).orderBy("effective_from", "effective_to")
    x = master.withColumn("next_from", F.lead("effective_from").over(w))
    return x.where(F.col("next_from").isNotNull() & (F.col("effective_to").isNull() | (F.col("next_from") <= F.col("effective_to")))).select(id_col, "effective_from", "effective_to", "next_from")
