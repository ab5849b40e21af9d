"""Coverages and their writing patterns: matrices, vectors, summaries and derived loss patterns.

All heavy work is done once per distinct (pattern, start date), which is bounded by patterns x calendar
days however many coverages there are. Results go back to the coverages as one packed row per pair.
"""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy

from pyspark.sql import DataFrame, functions as F

from .expand import daily_factors, element_schedule, financial_cells, row_factor_summary, scheduled_elements
from .joins import HOT_ROWS, counted_keys, lookup_join, spread_rows
from .patterns import LOSS_CODE, ZERO, consolidate, nest_elements

PAIR = ["pattern_id", "start_date"]

# Month steps into February go to the 28th for coverage patterns.
COVERAGE_CLAMP = "feb28"

# Identifiers and texts of summaries and derived patterns.
UNNAMED_PATTERN = "Pattern_"
LOSS_PATTERN_ID = "LI_"
LOSS_PATTERN_NAME = "Loss incurred pattern for writing pattern "
UNKNOWN_COVERAGE = "No pattern found for coverage_id: "

TOLERANCE = 1e-6


def first_allocations(allocations: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """One row per coverage: its first allocation by ``order`` (default: earliest start, lowest pattern)."""
    rank = F.struct(*order) if order else F.struct("pattern_start_date", "writing_premium_pattern_id")
    pick = F.min_by(F.struct("writing_premium_pattern_id", "pattern_start_date"), rank)
    return allocations.groupBy("coverage_id").agg(pick.alias("_a")).select(
        "coverage_id",
        F.col("_a.writing_premium_pattern_id").alias("pattern_id"),
        F.col("_a.pattern_start_date").cast("date").alias("start_date"),
    )


def _vector_array(axis: str):
    entry = F.struct(F.col("bucket").alias("date_bucket"), F.col("value").alias("sum"))
    mine = (F.col("axis") == axis) & (F.abs("value") > ZERO)
    return F.sort_array(F.collect_list(F.when(mine, entry)))


class CoveragePatterns:
    """The three pattern tables and everything derived from them. Every method returns a lazy DataFrame."""

    def __init__(
        self,
        allocations: DataFrame,
        factors: DataFrame,
        patterns: DataFrame,
        allocation_order: Sequence[str] | None = None,
        factor_order: Sequence[str] | None = None,
        unique_coverages: bool = False,
        hot_rows: int = HOT_ROWS,
    ):
        """``unique_coverages``: the allocation table has one row per coverage, so no grouping is needed."""
        if unique_coverages:
            self.allocations = allocations.select(
                "coverage_id",
                F.col("writing_premium_pattern_id").alias("pattern_id"),
                F.col("pattern_start_date").cast("date").alias("start_date"),
            )
        else:
            self.allocations = first_allocations(allocations, allocation_order)
        self.factors = factors
        self.hot_rows = hot_rows
        self.elements = consolidate(factors, order=factor_order)
        self.pattern_rows = nest_elements(self.elements)
        self.names = patterns.groupBy("pattern_id").agg(F.min("pattern_name").alias("pattern_name"))

    def only(self, *coverage_ids: int) -> CoveragePatterns:
        """The same book for a few coverages: just their pairs are expanded."""
        part = copy(self)
        part.allocations = self.allocations.filter(F.col("coverage_id").isin(*coverage_ids))
        return part

    # --- per (pattern, start date) ---------------------------------------------------------------

    def pairs(self) -> DataFrame:
        """The distinct pairs; the same count as for hot pairs, so that Spark makes it once."""
        return counted_keys(self.allocations, PAIR).filter(F.col("_rows") > 0).select(*PAIR)

    def instances(self) -> DataFrame:
        """One row per pair with the pattern's elements, spread over all tasks before it expands."""
        return spread_rows(self.pairs().join(self.pattern_rows, "pattern_id"), PAIR)

    def schedule(self) -> DataFrame:
        return element_schedule(self.instances(), PAIR, clamp=COVERAGE_CLAMP)

    def pair_factors(self) -> DataFrame:
        """Daily factors per pair; large, meant for a few pairs. Sums come from ``pair_cells``."""
        return daily_factors(self.schedule(), PAIR)

    def pair_cells(self) -> DataFrame:
        return financial_cells(self.schedule(), PAIR)

    def pair_vectors(self) -> DataFrame:
        """Per pair: number of cells, their total, and both vectors as sorted arrays."""
        sides = F.explode(F.array(
            F.struct(F.lit("exposure").alias("axis"), F.col("exposure_bucket").alias("bucket")),
            F.struct(F.lit("incurred").alias("axis"), F.col("incurred_bucket").alias("bucket")),
        ))
        by_bucket = (
            self.pair_cells()
            .select(*PAIR, "value", sides.alias("_s"))
            .groupBy(*PAIR, F.col("_s.axis").alias("axis"), F.col("_s.bucket").alias("bucket"))
            .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("cells"))
        )
        exposure = F.col("axis") == "exposure"
        return by_bucket.groupBy(*PAIR).agg(
            F.sum(F.when(exposure, F.col("cells")).otherwise(0)).alias("matrix_entries_count"),
            F.sum(F.when(exposure, F.col("value")).otherwise(0.0)).alias("matrix_total_sum"),
            _vector_array("exposure").alias("exposure_vector"),
            _vector_array("incurred").alias("incurred_vector"),
        )

    def for_coverages(self, per_pair: DataFrame, how: str = "inner") -> DataFrame:
        """Give every coverage its pair's row; a pair shared by very many coverages is salted."""
        return lookup_join(
            self.allocations, per_pair, PAIR, how, spread=["coverage_id"], hot_rows=self.hot_rows
        )

    # --- per coverage ----------------------------------------------------------------------------

    def coverage_matrix(self) -> DataFrame:
        packed = self.pair_cells().groupBy(*PAIR).agg(
            F.collect_list(F.struct("incurred_bucket", "exposure_bucket", "value")).alias("_cells")
        )
        return self.for_coverages(packed).select("coverage_id", F.inline("_cells"))

    def coverage_vector(self, axis: str = "exposure") -> DataFrame:
        vectors = self.pair_vectors().select(*PAIR, f"{axis}_vector")
        return (
            self.for_coverages(vectors)
            .select("coverage_id", F.inline(f"{axis}_vector"))
            .withColumnRenamed("sum", "value")
        )

    def coverage_factors(self) -> DataFrame:
        """Daily factors of every coverage: the schedule is joined first, the days come after the join."""
        packed = self.schedule().groupBy(*PAIR).agg(
            F.collect_list(
                F.struct("ord", "element_start", "element_days", "up_front", "up_days", "distribution", "dist_days")
            ).alias("_elements")
        )
        rows = self.for_coverages(packed).select("coverage_id", F.inline("_elements"))
        return daily_factors(spread_rows(rows, ["coverage_id"]), ["coverage_id"])

    def _pattern_summary(self) -> DataFrame:
        def listed(value: str):
            entry = F.struct(
                F.col("period"), F.col(value).alias("factor_value"), F.col("duration"), F.col("unit").alias("factor_type")
            )
            return F.sort_array(F.collect_list(F.when(F.col(value) > 0, entry)))

        exact = F.aggregate(
            F.sort_array(F.collect_list(F.struct("ord", (F.col("distribution") + F.col("up_front")).alias("share")))),
            F.lit(0.0),
            lambda acc, e: acc + e["share"],
        )
        return self.elements.groupBy("pattern_id").agg(
            F.count_if(F.col("up_front") > 0).alias("upfront_factors_count"),
            F.count_if(F.col("distribution") > 0).alias("distributed_factors_count"),
            F.sum("up_front").alias("total_upfront_factor"),
            F.sum("distribution").alias("total_distributed_factor"),
            F.count(F.lit(1)).alias("total_elements"),
            (exact == 1).alias("distribution_sum"),
            listed("up_front").alias("upfront_factors"),
            listed("distribution").alias("distributed_factors"),
        )

    def _with_pattern(self, coverages: DataFrame, per_pattern: DataFrame) -> DataFrame:
        return lookup_join(
            coverages, per_pattern, ["pattern_id"], "left", spread=["coverage_id"], hot_rows=self.hot_rows
        )

    def summaries(self, coverage_ids: DataFrame | None = None) -> DataFrame:
        """One summary row per coverage; ids without an allocation get an ``error`` text instead."""
        described = self.names.join(self._pattern_summary(), "pattern_id", "full")
        if coverage_ids is None:
            base = self.allocations.withColumn("_known", F.lit(True))
        else:
            base = coverage_ids.select("coverage_id").join(
                self.allocations.withColumn("_known", F.lit(True)), "coverage_id", "left"
            )
        joined = self._with_pattern(base, described)
        zero = ["upfront_factors_count", "distributed_factors_count", "total_elements"]
        zero_sums = ["total_upfront_factor", "total_distributed_factor"]
        known = F.col("_known")
        return joined.select(
            "coverage_id",
            "pattern_id",
            F.when(
                known,
                F.coalesce("pattern_name", F.concat(F.lit(UNNAMED_PATTERN), F.col("pattern_id").cast("string"))),
            ).alias("pattern_name"),
            F.col("start_date").alias("pattern_start_date"),
            *[F.when(known, F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in zero],
            *[F.when(known, F.coalesce(c, F.lit(0.0))).alias(c) for c in zero_sums],
            F.when(known, F.coalesce("distribution_sum", F.lit(False))).alias("distribution_sum"),
            "upfront_factors",
            "distributed_factors",
            F.when(
                known.isNull(),
                F.concat(F.lit(UNKNOWN_COVERAGE), F.col("coverage_id").cast("string")),
            ).alias("error"),
        )

    def _pair_analysis(self) -> DataFrame:
        counts = (
            self.instances()
            .select(*PAIR, scheduled_elements(F.col("start_date"), clamp=COVERAGE_CLAMP).alias("_schedule"))
            .select(*PAIR, F.size("_schedule").cast("long").alias("total_elements"), *[
                column.alias(name) for name, column in row_factor_summary("_schedule").items()
            ])
        )
        return (
            counts.join(self.pair_vectors(), PAIR, "left")
            .join(self.names, "pattern_id", "left")
            .select(
                *PAIR,
                F.coalesce("pattern_name", F.concat(F.lit(UNNAMED_PATTERN), F.col("pattern_id").cast("string"))).alias(
                    "pattern_name"
                ),
                "total_elements",
                "factors_count",
                F.coalesce("matrix_entries_count", F.lit(0)).alias("matrix_entries_count"),
                F.coalesce("matrix_total_sum", F.lit(0.0)).alias("matrix_total_sum"),
                F.coalesce(F.size("exposure_vector"), F.lit(0)).alias("exposure_vector_count"),
                F.coalesce(F.size("incurred_vector"), F.lit(0)).alias("incurred_vector_count"),
                "min_incurred",
                "max_incurred",
                "min_exposed",
                "max_exposed",
                "exposure_vector",
                "incurred_vector",
            )
        )

    def analysis(self) -> DataFrame:
        return self.for_coverages(self._pair_analysis())

    @staticmethod
    def _loss_summary(per_pair: DataFrame) -> DataFrame:
        entries = F.transform(
            "exposure_vector",
            lambda e: F.struct(
                e["date_bucket"].alias("exposure_date"),
                e["sum"].alias("factor_value"),
                F.lit(0).alias("duration"),
                F.lit(LOSS_CODE).alias("period_frequency"),
            ),
        )
        shares = F.aggregate("exposure_vector", F.lit(0.0), lambda acc, e: acc + e["sum"])
        pattern = F.col("pattern_id").cast("string")
        return per_pair.filter(F.size("exposure_vector") > 0).select(
            *PAIR,
            F.concat(F.lit(LOSS_PATTERN_ID), pattern).alias("loss_pattern_id"),
            F.concat(F.lit(LOSS_PATTERN_NAME), pattern).alias("loss_pattern_name"),
            F.get("exposure_vector", F.lit(0))["date_bucket"].alias("loss_pattern_start_date"),
            F.size("exposure_vector").alias("qe_factors_count"),
            shares.alias("total_exposure_distribution"),
            (shares == 1).alias("loss_distribution_sum"),
            entries.alias("qe_factors"),
        )

    def loss_patterns(self) -> DataFrame:
        """One loss row per coverage and exposure quarter: share of that quarter, duration 0.

        The durations are 0, so these rows are an end product; expanding them again gives nothing.
        """
        return self.for_coverages(self._loss_summary(self.pair_vectors())).select(
            "coverage_id",
            F.col("loss_pattern_id").alias("pattern_id"),
            F.col("loss_pattern_name").alias("pattern_name"),
            F.col("loss_pattern_start_date").alias("pattern_start_date"),
            F.inline("qe_factors"),
        )

    def loss_summaries(self) -> DataFrame:
        return self.for_coverages(self._loss_summary(self.pair_vectors())).withColumnRenamed(
            "pattern_id", "original_writing_pattern_id"
        )

    def complete_analysis(self) -> DataFrame:
        """Writing-pattern analysis with the derived loss pattern next to it, in one row per coverage."""
        writing = self._pair_analysis()
        return self.for_coverages(writing.join(self._loss_summary(writing), PAIR, "left"))


def portfolio_matrix(
    coverages: DataFrame, pattern_rows: DataFrame, amount: str, keys: Sequence[str] = (), unit: str = "QUARTER"
) -> DataFrame:
    """Expected amounts per cell over a whole portfolio (``keys``: one matrix per key).

    The amounts are added up per (pattern, start date) before anything expands, and the element shares
    are multiplied by them. So the cells of all pairs are combined inside the tasks and only one row
    per cell leaves them; no row per coverage and cell, or per pair and cell, is ever shuffled.
    """
    keys = list(keys)
    per_pair = coverages.groupBy(*keys, *PAIR).agg(F.sum(amount).alias("_amount"))
    instances = spread_rows(per_pair.join(pattern_rows, "pattern_id"), PAIR)
    schedule = element_schedule(instances, [*keys, "_amount"], clamp=COVERAGE_CLAMP).withColumns(
        {"up_front": F.col("up_front") * F.col("_amount"), "distribution": F.col("distribution") * F.col("_amount")}
    )
    return financial_cells(schedule, keys, unit)


def reconcile(writing: DataFrame, loss: DataFrame, keys: Sequence[str] = ("coverage_id",)) -> DataFrame:
    """Row by row: exposure vector entry against loss row of the same date, equal within 1e-6."""
    keys = list(keys)
    left = writing.select(*keys, F.col("date_bucket").alias("exposure_date"), F.col("value").alias("exposure_value"))
    right = loss.select(*keys, "exposure_date", F.col("factor_value").alias("loss_value"))
    both = left.join(right, keys + ["exposure_date"], "full")
    matches = F.abs(F.col("exposure_value") - F.col("loss_value")) < TOLERANCE
    return both.withColumn("matches", F.coalesce(matches, F.lit(False)))


def reconciliation_totals(rows: DataFrame, keys: Sequence[str] = ("coverage_id",)) -> DataFrame:
    """Per coverage: both totals, whether all rows match, and whether the loss shares add up to 1."""
    return rows.groupBy(*keys).agg(
        F.sum("exposure_value").alias("exposure_total"),
        F.sum("loss_value").alias("loss_total"),
        F.bool_and("matches").alias("one_to_one"),
        (F.abs(F.sum("loss_value") - 1) < TOLERANCE).alias("sums_to_one"),
    )
