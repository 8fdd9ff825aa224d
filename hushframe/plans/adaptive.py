"""Two-phase counts: a cheap coarse release decides how finely each group is counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.calibration import scale_for
from hushframe.functions.noise import Draw, Noise
from hushframe.functions.scalars import label
from hushframe.operators.bounding import ROW, PrivacyUnit, bound_contributions
from hushframe.operators.keysets import aggregate_on_keyset
from hushframe.operators.matching import null_safe_semi_join
from hushframe.plans.materialise import materialise


def two_phase_count(
    df: DataFrame,
    coarse_keyset: DataFrame,
    coarse: Sequence[str],
    fine_keyset: DataFrame,
    fine: Sequence[str],
    total_rho: float,
    threshold: float,
    noise: Noise,
    coarse_share: float = 0.1,
    unit: PrivacyUnit = ROW,
) -> DataFrame:
    """Count coarse groups with a tenth of the budget; spend the rest on fine counts of large groups
    and on better coarse counts of small ones.

    ``fine`` holds the coarse keys and the extra ones. The private table is read once: its fine counts
    are written, the coarse ones are their sums, and the released label is joined to those counts
    instead of to the rows. The two branches count disjoint rows, so each may use the whole rest. The
    coarse release is written before it is used; both phases see the same noise. A unit with an id is kept
    in one coarse group, as it could otherwise lie in both branches.
    """
    if unit.column is not None:
        if unit.partitions != 1:
            raise ValueError("a unit may lie in one coarse group only")
        df = bound_contributions(df, unit, coarse, coarse_keyset)
    influence = unit.rows
    extra = [c for c in fine if c not in coarse]
    cells = materialise(df.groupBy(*fine).agg(F.count(F.lit(1)).alias("n")), "cells")
    count = {"n": F.coalesce(F.sum("n"), F.lit(0))}
    coarse_counts = aggregate_on_keyset(cells.select(*coarse, "n"), coarse_keyset, coarse, count)

    first_scale = scale_for(float(influence), total_rho * coarse_share, "zcdp")
    second_scale = scale_for(float(influence), total_rho * (1.0 - coarse_share), "zcdp")
    first = coarse_counts.withColumnRenamed("n", "coarse_count")
    histogram = noise.add(first, [Draw("coarse_count", "discrete_gaussian", first_scale)], coarse)
    histogram = materialise(histogram, "coarse")
    labelled = histogram.select(
        *coarse, label(F.col("coarse_count") < F.lit(threshold), "true", "false").alias("under_threshold")
    )

    small_keys = labelled.filter("under_threshold = 'true'").drop("under_threshold")
    small = null_safe_semi_join(coarse_counts, small_keys, coarse).withColumnRenamed("n", "small_count")
    small = noise.add(small, [Draw("small_count", "discrete_gaussian", second_scale)], coarse)

    large_keys = labelled.filter("under_threshold = 'false'").drop("under_threshold")
    wanted = null_safe_semi_join(fine_keyset.select(*fine), large_keys, coarse)
    large = aggregate_on_keyset(cells, wanted, fine, count).withColumnRenamed("n", "large_count")
    large = noise.add(large, [Draw("large_count", "discrete_gaussian", second_scale)], fine)

    missing = [F.lit(None).cast(fine_keyset.schema[c].dataType).alias(c) for c in extra]
    under = F.lit("true").alias("under_threshold")
    over = F.lit("false").alias("under_threshold")
    return small.select(*coarse, *missing, under, F.col("small_count").alias("count")).unionByName(
        large.select(*fine, over, F.col("large_count").alias("count"))
    )
