import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from earnloom.functions import calendar
from earnloom.operators import buckets, expand, matrix, patterns
from earnloom.operators.coverage import CoveragePatterns, portfolio_matrix, reconcile, reconciliation_totals
from earnloom.plans import results
from tests import brute

D = dt.date
START = D(2023, 1, 1)


@pytest.fixture(scope="module")
def book(spark):
    allocations = spark.createDataFrame(
        [(100, 1000, START), (101, 1001, START), (102, 1002, START), (102, 1000, D(2024, 1, 1))],
        "coverage_id long, writing_premium_pattern_id long, pattern_start_date date",
    )
    factors = spark.createDataFrame(
        [(1000, "Q", 1, 1.0, 360), (1001, "QS", 1, 0.1284, 360)]
        + [(1001, "Q", i, 0.2179, 360) for i in (1, 2, 3, 4)]
        + [(1002, "QS", 1, 1.0, 360)],
        "pattern_id long, period_frequency string, period int, factor_value double, duration int",
    )
    names = spark.createDataFrame(
        [(1000, "Simple 1 quarer all written"), (1001, "Classic 4 quarters")], "pattern_id long, pattern_name string"
    )
    return CoveragePatterns(allocations, factors, names, hot_rows=1)


# published cells of coverage 101: incurred quarter, then exposure quarters from the first one
GOLDEN = {
    "2023-03-31": (0.058525, 0.086338, 0.087287, 0.087287, 0.026864, 0, 0, 0),
    "2023-06-30": (0, 0.027089, 0.054773, 0.054773, 0.054177, 0.027089, 0, 0),
    "2023-09-30": (0, 0, 0.027386, 0.054773, 0.054177, 0.054177, 0.027386, 0),
    "2023-12-31": (0, 0, 0, 0.027386, 0.054177, 0.054177, 0.054773, 0.027386),
}
VECTOR = (0.058525, 0.113426, 0.169446, 0.224218, 0.189396, 0.135443, 0.082159, 0.027386)


def test_golden_matrix(book):
    rows = book.coverage_matrix().filter("coverage_id = 101").collect()
    assert len(rows) == 20
    quarters = sorted({r["exposure_bucket"] for r in rows})
    cells = {(r["incurred_bucket"].isoformat(), quarters.index(r["exposure_bucket"])): r["value"] for r in rows}
    for incurred, values in GOLDEN.items():
        for k, expected in enumerate(values):
            assert cells.get((incurred, k), 0.0) == pytest.approx(expected, abs=5e-7)


def test_golden_vectors_and_loss_pattern(book):
    vector = [r["value"] for r in book.coverage_vector().filter("coverage_id = 101").orderBy("date_bucket").collect()]
    assert vector == pytest.approx(list(VECTOR), abs=5.1e-7)
    loss = book.loss_patterns().filter("coverage_id = 101").orderBy("exposure_date").collect()
    assert [r["factor_value"] for r in loss] == pytest.approx(vector)
    assert {r["pattern_id"] for r in loss} == {"LI_1001"}
    assert {r["pattern_start_date"] for r in loss} == {D(2023, 3, 31)}
    assert {(r["duration"], r["period_frequency"]) for r in loss} == {(0, "QE")}


def test_golden_analysis(book):
    found = {r["coverage_id"]: r for r in book.complete_analysis().collect()}
    assert {k: r["factors_count"] for k, r in found.items()} == {100: 32941, 101: 134233, 102: 545}
    assert {k: r["exposure_vector_count"] for k, r in found.items()} == {100: 5, 101: 8, 102: 4}
    row = found[101]
    assert (row["matrix_entries_count"], row["incurred_vector_count"], row["qe_factors_count"]) == (20, 4, 8)
    assert (row["min_incurred"], row["max_incurred"]) == (START, D(2023, 12, 31))
    assert (row["min_exposed"], row["max_exposed"]) == (START, D(2024, 12, 31))
    assert row["matrix_total_sum"] == pytest.approx(1.0)
    assert found[102]["pattern_name"] == "Pattern_1002"


def test_daily_rows_match_counts(book):
    counts = {r["coverage_id"]: r["count"] for r in book.coverage_factors().groupBy("coverage_id").count().collect()}
    assert counts == {100: 32941, 101: 134233, 102: 545}


def test_summaries_and_unknown_coverage(spark, book):
    asked = spark.createDataFrame([(101,), (999,)], "coverage_id long")
    rows = {r["coverage_id"]: r for r in book.summaries(asked).collect()}
    assert rows[999]["error"] == "No pattern found for coverage_id: 999"
    known = rows[101]
    assert known["error"] is None
    assert (known["upfront_factors_count"], known["distributed_factors_count"], known["total_elements"]) == (1, 4, 4)
    assert known["distribution_sum"] is True
    assert [f["period"] for f in known["distributed_factors"]] == [1, 2, 3, 4]
    assert known["upfront_factors"][0]["factor_type"] == "QUARTER"


def test_one_coverage(book):
    one = book.only(101)
    assert one.pairs().count() == 1
    assert one.coverage_matrix().count() == 20


def test_year_elements_in_leap_years(spark):
    cases = [(0, D(2024, 2, 29), [("YEAR", 0.1, 90, 0.5, 29), ("YEAR", 0.0, 0, 0.4, 30)]), (1, D(2023, 12, 31), [("YEAR", 0.0, 1, 1.0, 1)])]
    schedule = expand.element_schedule(instance_frame(spark, cases), ["k"])
    found = {}
    for r in expand.financial_cells(schedule, ["k"]).collect():
        found.setdefault(r["k"], {})[(r["incurred_bucket"], r["exposure_bucket"])] = r["value"]
    for key, start, elements in cases:
        assert found[key] == pytest.approx(brute.bucketed(brute.daily(elements, start), brute.quarter_end, brute.quarter_end), abs=1e-9)


def test_first_allocation_wins(book):
    rows = {r["coverage_id"]: r for r in book.allocations.collect()}
    assert (rows[102]["pattern_id"], rows[102]["start_date"]) == (1002, START)


def test_reconciliation(book):
    rows = reconcile(book.coverage_vector(), book.loss_patterns())
    totals = reconciliation_totals(rows).collect()
    assert len(totals) == 3
    assert all(r["one_to_one"] and r["sums_to_one"] for r in totals)
    broken = book.loss_patterns().withColumn("factor_value", F.col("factor_value") + 0.01)
    assert not any(r["one_to_one"] for r in reconciliation_totals(reconcile(book.coverage_vector(), broken)).collect())


def test_portfolio_matrix_equals_sum_of_coverages(spark, book):
    premiums = spark.createDataFrame(
        [(1001, START, 10.0), (1001, START, 5.0), (1000, START, 2.0)], "pattern_id long, start_date date, premium double"
    )
    total = {(r[0], r[1]): r[2] for r in portfolio_matrix(premiums, book.pattern_rows, "premium").collect()}
    expected = {}
    weights = {100: 2.0, 101: 15.0}
    for r in book.coverage_matrix().filter("coverage_id in (100, 101)").collect():
        key = (r["incurred_bucket"], r["exposure_bucket"])
        expected[key] = expected.get(key, 0.0) + weights[r["coverage_id"]] * r["value"]
    assert total == pytest.approx(expected)


def test_consolidation_last_row_wins_and_defaults(spark):
    rows = [(1, "Q", 2, 0.5, 0, 1), (1, "Q", 2, 0.7, 90, 2), (1, "QS", 1, 0.3, 30, 3)]
    df = spark.createDataFrame(rows, "pattern_id long, period_frequency string, period int, factor_value double, duration int, line int")
    found = {r["period"]: r for r in patterns.consolidate(df, order=["line"]).collect()}
    assert (found[2]["distribution"], found[2]["distribution_days"], found[2]["up_front"], found[2]["up_front_days"]) == (0.7, 90, 0.0, 1)
    assert (found[1]["up_front"], found[1]["distribution"], found[1]["distribution_days"], found[1]["duration"]) == (0.3, 0.0, 1, 30)
    seen = patterns.nest_elements(patterns.consolidate(df, order=["line"], first_seen=True)).first()["elements"]
    assert [e["ord"] for e in seen] == [2, 1]


def test_invalid_durations(spark):
    rows = [(1000, 1, "Q", 1.0, 0), (1001, 1, "QS", 0.128372, 0), (1001, 1, "Q", 0.0, 1), (1001, 2, "Q", 0.212891, 2), (1002, 1, "QS", 1.0, 0)]
    df = spark.createDataFrame(rows, "pattern_id long, period int, period_frequency string, factor_value double, duration int")
    assert patterns.invalid_durations(df).count() == 3
    covers = spark.createDataFrame([(1, 1001), (2, 1001), (3, 5)], "coverage_id long, writing_premium_pattern_id long")
    repeated = df.union(df.filter("pattern_id = 1001"))
    by_cover = patterns.invalid_durations_by_coverage(repeated, covers, hot_rows=1).collect()
    assert sorted((r["coverage_id"], r["period"], r["factor_rows"]) for r in by_cover) == [(1, 1, 2), (2, 1, 2)]


def test_distribution_check_exact_and_tolerant(spark):
    elements = [{"ord": i, "unit": "QUARTER", "up_front": 0.0, "up_front_days": 1, "distribution": 0.1, "distribution_days": 9} for i in range(10)]
    df = spark.createDataFrame([(1, elements)], f"pattern_id long, elements {patterns.ELEMENTS_TYPE}")
    row = patterns.distribution_check(df).first()
    assert row["sums_to_one"] and not row["exactly_one"]


def test_normalise_and_ultimates(spark):
    df = spark.createDataFrame([(1, START, 1.0), (1, START, 3.0), (2, START, 5.0)], "k int, day date, value double")
    values = sorted((r["k"], r["value"]) for r in patterns.normalise(df, ["k"], "day").collect())
    assert values == [(1, 0.25), (1, 0.75), (2, 1.0)]
    zero = spark.createDataFrame([(1, START, 1.0), (1, START, -1.0)], "k int, day date, value double")
    with pytest.raises(Exception, match="add up to zero"):
        patterns.normalise(zero, ["k"], "day").collect()
    listed = patterns.apply_ultimates(df, [("premium", 10.0), ("LOSSES", None)]).groupBy("ultimate_type").agg(F.sum("value").alias("v"))
    assert {r[0]: r[1] for r in listed.collect()} == {"PREMIUM": 90.0, "LOSSES": 9.0}
    own = df.withColumn("u", F.expr("array(named_struct('type', 'costs', 'value', -2D))"))
    assert {r["ultimate_type"] for r in patterns.apply_ultimates(own, "u").collect()} == {"COSTS"}


# --- closed form against loops -------------------------------------------------------------------

STARTS = [D(2024, 2, 29), D(2023, 11, 30), D(2023, 11, 29), D(2023, 1, 31), D(2023, 12, 31), D(2024, 8, 2), D(2023, 2, 28)]
DURATIONS = [0, 1, 29, 90, 360, 361, 900]


def random_patterns(seed: int, count: int):
    rnd = random.Random(seed)
    cases = []
    for key in range(count):
        elements = [
            (
                rnd.choice(["DAY", "WEEK", "MONTH", "QUARTER", "QUARTER"]),
                rnd.choice([0.0, 0.1, 0.35]),
                rnd.choice(DURATIONS),
                rnd.choice([0.0, 0.2, 0.55]),
                rnd.choice(DURATIONS),
            )
            for _ in range(rnd.randint(1, 3))
        ]
        cases.append((key, rnd.choice(STARTS), elements))
    return cases


def instance_frame(spark, cases):
    names = ("ord", "unit", "up_front", "up_front_days", "distribution", "distribution_days")
    rows = [(key, start, [dict(zip(names, (i, *e))) for i, e in enumerate(elements)]) for key, start, elements in cases]
    return spark.createDataFrame(rows, f"k int, start_date date, elements {patterns.ELEMENTS_TYPE}")


@pytest.mark.parametrize("clamp", ["calendar", "feb28"])
def test_quarter_cells_equal_daily_sums(spark, clamp):
    cases = random_patterns(7, 24)
    schedule = expand.element_schedule(instance_frame(spark, cases), ["k"], clamp=clamp)
    found = {}
    for r in expand.financial_cells(schedule, ["k"]).collect():
        found.setdefault(r["k"], {})[(r["incurred_bucket"], r["exposure_bucket"])] = r["value"]
    for key, start, elements in cases:
        expected = brute.bucketed(brute.daily(elements, start, feb28=clamp == "feb28"), brute.quarter_end, brute.quarter_end)
        assert found.get(key, {}) == pytest.approx(expected, abs=1e-9)


def test_merged_elements_give_the_same_daily_sums(spark):
    """Equal elements are expanded once; weights of about zero are judged before their shares add up."""
    row = lambda k, day, share, days: (k, day, 1, "WEEK", share, 7, 0.25, days)
    rows = [row("a", D(2024, 1, 30), x, n) for x in (0.2, 0.5, 1e-10) for n in (9, 30)]
    rows += [row("b", None, 0.1, 5), row(None, D(2024, 3, 1), None, 5), row("b", D(2024, 1, 30), 0.25, 9), row("b", START, 0.5, 0)]
    rows += [("z", START, 1, "WEEK", 0.5, 0, 0.5, None)]
    # 21 x 7 daily weights of 0.9e-10, 1.5e-10 (its edges do not count) and 4e-10
    rows += [("z", START, 1, "WEEK", 0.0, 7, x * 21 * 7, 21) for x in (9e-11, 9e-11, 1.5e-10, 4e-10)]
    names = ["ord", "unit", "up_front", "up_front_days", "distribution", "distribution_days"]
    lines = spark.createDataFrame(
        rows, "k string, start_date date, ord int, unit string, up_front double, up_front_days int, distribution double, distribution_days int"
    )
    packed = lambda df: df.select("*", F.array(F.struct(*names)).alias("elements"))
    plain = expand.element_schedule(packed(lines), ["k"])

    def summed(daily, by, count):
        sums = daily.groupBy(*by, "incurred_date", "exposed_date", "factor_type").agg(count.alias("n"), F.sum("value").alias("v"))
        found = {tuple(r)[:-2]: tuple(r)[-2:] for r in sums.collect()}
        return {k: (n, None if v is None else pytest.approx(v, rel=1e-9)) for k, (n, v) in found.items()}

    one = F.count(F.lit(1))
    for by in ([], ["k"]):
        early = expand.merged_elements(lines, by, "start_date", ["ord", "unit", "up_front_days", "distribution_days"])
        once = expand.element_schedule(packed(early), [*by, "merged"])
        late = expand.merged_elements(plain, by)
        assert once.count() == late.count() < plain.count()
        for linear in (False, True):
            want = summed(expand.daily_factors(plain, by, linear=linear), by, one)
            for merged in (once, late):
                assert summed(expand.daily_factors(merged, [*by, "merged"], linear=linear), by, F.sum("merged")) == want
        shown = expand.merged_elements(plain, by, significant_only=True)
        want = summed(expand.daily_factors(plain, by, significant_only=True), by, one)
        got = expand.daily_factors(shown, [*by, "merged"], significant_only=True)
        assert summed(got, by, F.sum("merged")).keys() == want.keys()
    with pytest.raises(ValueError):
        expand.daily_factors(shown, by, linear=True, significant_only=True)


def test_elements_of_a_key_that_lie_together(spark):
    rows = [(k, START + dt.timedelta(days=40 * i % 400), 1, "WEEK", 0.1 * i, 7, 0.2, 5 + i % 3) for k in (*"abcde", None) for i in range(12)]
    names = ["ord", "unit", "up_front", "up_front_days", "distribution", "distribution_days"]
    lines = spark.createDataFrame(
        rows + rows, "k string, start_date date, ord int, unit string, up_front double, up_front_days int, distribution double, distribution_days int"
    )
    lengths = ["ord", "unit", "up_front_days", "distribution_days"]
    apart, together = (
        expand.merged_elements(lines, ["k"], "start_date", lengths, together=t, count=120 if t else 0) for t in (False, True)
    )
    assert apart.columns == together.columns
    assert sorted(map(str, together.collect())) == sorted(map(str, apart.collect()))
    tasks = together.select("k", F.spark_partition_id().alias("task")).distinct()
    assert tasks.count() == tasks.select("k").distinct().count() == 6

    def per_day(merged):
        schedule = expand.element_schedule(merged.select("*", F.array(F.struct(*names)).alias("elements")), ["k"])
        return expand.daily_factors(schedule, ["k"]).groupBy("k", "exposed_date").agg(F.sum("value").alias("value"))

    def listed(df):
        return {(r["k"], r["exposed_date"]): pytest.approx(r["value"], rel=1e-9) for r in df.collect()}

    want = listed(patterns.normalise(per_day(apart), ["k"], "exposed_date"))
    assert {k for k, _ in want} == set("abcde")
    assert listed(patterns.normalise(per_day(together), ["k"], "exposed_date", together=True)) == want


def test_normalise_of_rows_that_lie_together(spark):
    values = [(1, 1, 1.0), (1, 9000, 3.0), (1, 2, None), (1, None, 7.0), (2, 1, 5.0), (2, 1, 5.0), (None, 1, 5.0), (3, 1, None)]
    df = spark.createDataFrame(values, "k int, day int, value double")
    want = sorted(map(str, patterns.normalise(df, ["k"], "day").collect()))
    got = patterns.normalise(df, ["k"], "day", together=True)
    assert got.columns == df.columns and sorted(map(str, got.collect())) == want and len(want) == 6
    zero = spark.createDataFrame([(1, 1, 1.0), (1, 2, -1.0)], "k int, day int, value double")
    with pytest.raises(Exception, match="add up to zero"):
        patterns.normalise(zero, ["k"], "day", together=True).collect()


def test_normalised_factors_work_the_days_out_once_and_shuffle_none(spark):
    from workload import pattern_queries

    plan = pattern_queries.e11(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange" in line]
    assert shuffles and not any("exposed_date" in line or "Broadcast" in line for line in shuffles)
    assert sum("Generate explode(sequence" in line for line in plan.splitlines()) == 3  # up-front days, element days, their days


def test_daily_factors_equal_loops(spark):
    cases = random_patterns(11, 6)
    schedule = expand.element_schedule(instance_frame(spark, cases), ["k"], calendar=False)
    rows = expand.daily_factors(schedule, ["k"]).groupBy("k", "incurred_date", "exposed_date").agg(
        F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")
    )
    found = {(r[0], r[1], r[2]): r[3] for r in rows.collect()}
    expected = {}
    for key, start, elements in cases:
        for incurred, exposed, value in brute.daily(elements, start, use_calendar=False):
            at = (key, incurred, exposed)
            expected[at] = expected.get(at, 0.0) + value
    assert found == pytest.approx(expected, abs=1e-12)


def test_bucket_cells_with_gaps_and_starts(spark):
    cases = random_patterns(3, 16)
    ends = [D(2024, 3, 15), D(2023, 12, 30), D(2024, 9, 1), D(2025, 1, 10)]
    starts = [D(2023, 6, 1), D(2024, 2, 20), D(2024, 11, 11)]
    frame = instance_frame(spark, cases).select(
        "k", "start_date", expand.scheduled_elements(F.col("start_date")).alias("s"),
        buckets.from_ends(F.array(*[F.lit(d) for d in ends])).alias("incurred_buckets"),
        buckets.from_starts(F.array(*[F.lit(d) for d in starts])).alias("exposure_buckets"),
    ).select("k", "incurred_buckets", "exposure_buckets", F.inline("s"))
    found = {}
    for r in expand.bucket_cells(frame, ["k"]).collect():
        found.setdefault(r["k"], {})[(r["incurred_bucket"], r["exposure_bucket"])] = r["value"]

    def by_end(day):
        return min((e for e in ends if e >= day), default=None)

    def by_start(day):
        return max((s for s in starts if s <= day), default=None)

    for key, start, elements in cases:
        expected = brute.bucketed(brute.daily(elements, start), by_end, by_start)
        assert found.get(key, {}) == pytest.approx(expected, abs=1e-9)


def test_linear_mode(spark):
    cases = random_patterns(5, 10)
    frame = instance_frame(spark, cases)
    schedule = expand.element_schedule(frame, ["k"])
    daily = expand.daily_factors(schedule, ["k"], linear=True).groupBy("k", "incurred_date", "exposed_date", "factor_type").agg(
        F.sum("value").alias("v")
    )
    found = {tuple(r[:4]): r["v"] for r in daily.collect()}
    expected = {}
    for key, start, elements in cases:
        for incurred, exposed, value, kind in brute.linear(elements, start):
            at = (key, incurred, exposed, kind)
            expected[at] = expected.get(at, 0.0) + value
    assert found == pytest.approx(expected, abs=1e-12)
    ends = [D(2024, 1, 15), D(2024, 2, 10), D(2024, 9, 1), D(2027, 1, 10)]
    both = buckets.from_ends(F.array(*[F.lit(d) for d in ends]))
    rows = frame.select("k", both.alias("incurred_buckets"), both.alias("exposure_buckets"), F.inline(
        expand.scheduled_elements(F.col("start_date"))))
    cells = {}
    for r in expand.linear_bucket_cells(rows, ["k"]).collect():
        cells.setdefault(r["k"], {})[(r["incurred_bucket"], r["exposure_bucket"])] = r["value"]

    def by_end(day):
        return min((e for e in ends if e >= day), default=None)

    for key, start, elements in cases:
        assert cells.get(key, {}) == pytest.approx(brute.bucketed(brute.linear(elements, start), by_end, by_end), abs=1e-9)


def test_factor_summary_equals_daily_rows(spark):
    cases = random_patterns(13, 8)
    frame = instance_frame(spark, cases)
    schedule = expand.element_schedule(frame, ["k"])
    for linear in (False, True):
        for significant in (False, True):
            quick = {r["k"]: tuple(r)[1:] for r in expand.factor_summary(schedule, ["k"], significant, linear).collect()}
            daily = expand.daily_factors(schedule, ["k"], linear=linear, significant_only=significant).groupBy("k").agg(
                F.count(F.lit(1)), F.min("incurred_date"), F.max("incurred_date"), F.min("exposed_date"), F.max("exposed_date")
            )
            slow = {r["k"]: tuple(r)[1:] for r in daily.collect()}
            assert {k: v for k, v in quick.items() if v[0]} == slow
            in_row = frame.select("k", expand.scheduled_elements(F.col("start_date")).alias("s"))
            facts = expand.row_factor_summary("s", significant, linear)
            rows = in_row.select("k", *[c.alias(n) for n, c in facts.items()])
            assert {r["k"]: tuple(r)[1:] for r in rows.collect() if r["factors_count"]} == slow


# --- results of documents ------------------------------------------------------------------------


def config_frame(spark, linear=False, end_of_period=True, unit="QUARTER"):
    elements = [(0, "QUARTER", 0.1284, 360, 0.2179, 360)] + [(i, "QUARTER", 0.0, 0, 0.2179, 360) for i in (1, 2, 3)]
    names = ("ord", "unit", "up_front", "up_front_days", "distribution", "distribution_days")
    row = ("doc", D(2024, 8, 2), True, linear, end_of_period, unit, unit, [dict(zip(names, e)) for e in elements])
    return spark.createDataFrame(
        [row],
        "config_id string, start_date date, calendar boolean, linear boolean, end_of_period boolean, "
        f"incurred_unit string, exposed_unit string, elements {patterns.ELEMENTS_TYPE}",
    )


def test_result_selectors(spark):
    configs = config_frame(spark)
    for selector in ("FFM", "DDM", "CCM", "DFM", "fdm"):
        total = results.result(configs, selector).agg(F.sum("value")).first()[0]
        assert total == pytest.approx(1.0, abs=1e-9) or "D" in selector.upper()
    matrix_total = results.result(configs, "FFM").count()
    columns = results.result(configs, "FFC").orderBy("date_bucket").collect()
    assert sum(r["value"] for r in columns) == pytest.approx(1.0)
    assert [r["date_bucket"] for r in columns] == sorted({r["date_bucket"] for r in columns})
    assert matrix_total > len(columns)
    with pytest.raises(ValueError):
        results.result(configs, "FFMM")
    with pytest.raises(ValueError):
        results.result(configs, "XFM")


def test_result_labels_by_start(spark):
    by_start = results.result(config_frame(spark, end_of_period=False), "FFR").orderBy("date_bucket").collect()
    assert by_start[0]["date_bucket"] == D(2024, 7, 1)
    by_end = results.result(config_frame(spark), "FFR").orderBy("date_bucket").collect()
    assert by_end[0]["date_bucket"] == D(2024, 9, 30)
    assert [r["value"] for r in by_start] == pytest.approx([r["value"] for r in by_end])


def test_result_against_loops(spark):
    elements = [("QUARTER", 0.1284, 360, 0.2179, 360)] + [("QUARTER", 0.0, 0, 0.2179, 360)] * 3
    start = D(2024, 8, 2)
    rows = brute.daily(elements, start)
    ends, at = [], start
    while at <= D(2026, 12, 31):
        at = brute.plus_months(at, 3)
        if at - dt.timedelta(1) <= D(2026, 12, 31):
            ends.append(at - dt.timedelta(1))

    def by_end(day):
        return min((e for e in ends if e >= day), default=None)

    expected = brute.bucketed(rows, by_end, by_end)
    found = {(r["incurred_bucket"], r["exposure_bucket"]): r["value"] for r in results.result(config_frame(spark), "DDM").collect()}
    assert found == pytest.approx(expected, abs=1e-9)


# --- matrices ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(1, D(2023, 3, 31), D(2023, 3, 31), 1.0), (1, D(2023, 3, 31), D(2023, 6, 30), 2.0), (1, D(2023, 6, 30), D(2023, 9, 30), 4.0),
            (1, D(2023, 6, 30), D(2023, 6, 30), 8.0), (2, D(2023, 6, 30), D(2023, 12, 31), 16.0)]
    return spark.createDataFrame(rows, "k int, incurred_bucket date, exposure_bucket date, value double")


def test_vectors_totals_lookup(cells):
    assert {r["date_bucket"]: r["value"] for r in matrix.vector(cells.filter("k=1"), ["k"]).collect()} == {
        D(2023, 3, 31): 1.0, D(2023, 6, 30): 10.0, D(2023, 9, 30): 4.0}
    assert {r["k"]: r["total"] for r in matrix.total(cells, ["k"]).collect()} == {1: 15.0, 2: 16.0}
    hit = matrix.cell_value(cells, ["k"], F.lit(D(2023, 6, 30)), F.lit(D(2023, 9, 30)))
    assert {r["k"]: r["value"] for r in hit.collect()} == {1: 4.0, 2: 0.0}
    active = {r["k"]: r["exposure_buckets"] for r in matrix.active_buckets(cells, ["k"]).collect()}
    assert active[1] == [D(2023, 3, 31), D(2023, 6, 30), D(2023, 9, 30)]


def test_directional_sums(cells):
    row = matrix.directional_sums(cells.filter("k = 1"), ["k"], F.lit(D(2023, 6, 30))).first()
    assert (row["left"], row["right"], row["top"], row["bottom"]) == (11.0, 14.0, 15.0, 12.0)
    assert (row["top_left"], row["top_right"], row["bottom_left"], row["bottom_right"]) == (11.0, 14.0, 8.0, 12.0)
    back = matrix.directional_sums(cells.filter("k = 1"), ["k"], F.lit(D(2023, 6, 30)), at_most=False).first()
    assert (back["left"], back["right"], back["top"], back["bottom"]) == (14.0, 11.0, 12.0, 15.0)


@pytest.mark.parametrize("keys", [["k"], []])
def test_criteria_table_equals_conditional_sums(spark, cells, keys):
    asked = [(k, d, i, e) for k in (1, 2) for d in (D(2023, 3, 31), D(2023, 6, 30), D(2024, 1, 1), D(2022, 1, 1))
             for i in matrix.OPERATORS for e in matrix.OPERATORS]
    criteria = spark.createDataFrame(asked, "k int, as_of date, incurred_op string, exposed_op string")
    found = matrix.sum_by_criteria_table(cells, keys, criteria).collect()
    compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    rows = cells.collect()
    assert len(found) == len(asked) // (1 if keys else 2)
    for r in found:
        expected = sum(
            c["value"] for c in rows
            if (not keys or c["k"] == r["k"])
            and compare[r["incurred_op"]](c["incurred_bucket"], r["as_of"]) and compare[r["exposed_op"]](c["exposure_bucket"], r["as_of"])
        )
        assert r["value"] == pytest.approx(expected)


def test_criteria_reject_unknown_operator(spark, cells):
    with pytest.raises(ValueError):
        matrix.sum_by_criteria(cells, ["k"], [("x", D(2023, 1, 1), "=", "<")])


def test_table_columns_come_from_the_cells(spark, cells):
    assert matrix.bucket_labels(cells) == ["2023-03-31", "2023-06-30", "2023-09-30", "2023-12-31"]
    wide = matrix.table(cells, ["k"])
    assert wide.columns == ["k", "incurred_bucket", "2023-03-31", "2023-06-30", "2023-09-30", "2023-12-31", "Total"]
    for r in wide.collect():
        assert sum(r[c] for c in wide.columns[2:-1]) == r["Total"]
    assert matrix.table(cells.limit(0), ["k"], totals=False).columns == ["k", "incurred_bucket"]
    with pytest.raises(Exception, match="no column for the exposure bucket 2023-0|no column for the exposure bucket 2023-1"):
        matrix.table(cells, ["k"], [D(2023, 3, 31)], totals=False).collect()
    with pytest.raises(ValueError):
        matrix.table(cells, ["k"], unlisted="keep")


def test_unknown_units_are_errors(spark):
    units = spark.createDataFrame([("YEAR",), ("HALFYEAR",), (None,)], "unit string")
    moved = units.withColumn("next", calendar.advance(F.lit(D(2024, 1, 31)), F.col("unit")))
    assert moved.filter("unit = 'YEAR'").first()["next"] == D(2025, 1, 31)
    for bad, text in (("unit = 'HALFYEAR'", "unknown time unit HALFYEAR"), ("unit IS NULL", "unknown time unit null")):
        with pytest.raises(Exception, match=text):
            moved.filter(bad).collect()
        ends = units.filter(bad).select(buckets.period_set("F", F.lit(D(2024, 1, 1)), F.lit(D(2024, 1, 1)), F.lit(D(2024, 12, 31)), F.lit(D(2024, 12, 31)), F.col("unit")))
        with pytest.raises(Exception, match=text):
            ends.collect()
    with pytest.raises(ValueError):
        calendar.advance(F.col("d"), "HALFYEAR")


def test_tables(cells):
    wide = matrix.table(cells, ["k"], [D(2023, 3, 31), D(2023, 6, 30)], unlisted="drop").filter("k = 1").orderBy("incurred_bucket").collect()
    assert [r["incurred_bucket"] for r in wide] == [None, D(2023, 3, 31), D(2023, 6, 30)]
    assert (wide[0]["2023-03-31"], wide[0]["2023-06-30"], wide[0]["Total"]) == (1.0, 10.0, 15.0)
    plain = matrix.table(cells, ["k"], [D(2023, 3, 31)], 1, totals=False, unlisted="drop")
    assert "Total" not in plain.columns and plain.count() == 3
    totals = {(r["incurred_bucket"], r["exposure_bucket"]): r["value"] for r in matrix.with_totals(cells.filter("k=1"), ["k"]).collect()}
    assert totals[(None, None)] == 15.0 and totals[(None, D(2023, 6, 30))] == 10.0 and totals[(D(2023, 6, 30), None)] == 12.0


def test_bucket_assignment(spark):
    days = spark.createDataFrame([(D(2023, 1, d),) for d in (1, 10, 11, 20, 21)], "day date")
    bounds = [D(2023, 1, 10), D(2023, 1, 20)]
    by_end = {r["day"].day: r["bucket"] for r in buckets.assign_bucket(days, "day", bounds).collect()}
    assert by_end == {1: bounds[0], 10: bounds[0], 11: bounds[1], 20: bounds[1], 21: None}
    by_start = {r["day"].day: r["bucket"] for r in buckets.assign_bucket(days, "day", bounds, to_end=False).collect()}
    assert by_start == {1: None, 10: bounds[0], 11: bounds[0], 20: bounds[1], 21: bounds[1]}


def test_linear_cells_add_up_the_days_in_closed_form(spark):
    """Any lengths against loops over the days, null shares included, and no row per element day."""
    draw = random.Random(5)
    bounds = [(D(2020, 1, 1), D(2020, 1, 9)), (D(2020, 1, 10), D(2020, 6, 30)), (D(2020, 7, 1), D(2023, 12, 31))]
    rows = []
    for k in range(200):
        ne, n, nu = draw.choice([1, 7, 31, 366, 450]), draw.choice([0, 1, 5, 90, 500]), draw.choice([0, 3, 40])
        up, dist = (None if draw.random() < 0.1 else draw.random() for _ in range(2))
        rows.append((k, D(2020, 1, 1) + dt.timedelta(draw.randrange(30)), ne, up, nu, dist, n))
    schema = "k int, element_start date, element_days int, up_front double, up_days int, distribution double, dist_days int"
    bucket = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(hi).alias("label")) for lo, hi in bounds])
    frame = spark.createDataFrame(rows, schema).withColumns({"incurred_buckets": bucket, "exposure_buckets": bucket})
    cells = expand.linear_bucket_cells(frame, ["k"])
    got = {(r["k"], r["incurred_bucket"], r["exposure_bucket"]): r["value"] for r in cells.collect()}
    want = {}
    for k, start, ne, up, nu, dist, n in rows:
        home = next(hi for lo, hi in bounds if lo <= start <= hi)
        shares = [(i, up / nu) for i in range(nu if up is not None else 0)]
        for day in range(ne if dist is not None and n else 0):
            left = ne - day
            shares += [(i, dist / n / 2 / left if i < left or i > n - day else dist / n / ne) for i in range(n)]
        for i, v in shares:
            at = start + dt.timedelta(i)
            end = next(hi for lo, hi in bounds if lo <= at <= hi)
            want[k, home, end] = want.get((k, home, end), 0.0) + v
    assert got.keys() == {key for key, v in want.items() if abs(v) > 1e-10}
    assert all(abs(got[key] - want[key]) < 1e-11 for key in got)
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2


def test_bucket_matching_is_compiled(spark):
    """Touched buckets are rows behind a plain filter, not arrays filtered by a lambda for every element."""
    cases = random_patterns(3, 4)
    ends = buckets.from_ends(F.array(F.lit(D(2024, 3, 15)), F.lit(None).cast("date"), F.lit(D(2025, 1, 10))))
    frame = instance_frame(spark, cases).select(
        "k", expand.scheduled_elements(F.col("start_date")).alias("s"), ends.alias("incurred_buckets"), ends.alias("exposure_buckets")
    ).select("k", "incurred_buckets", "exposure_buckets", F.inline("s")).localCheckpoint()
    assert "lambda" not in expand.bucket_cells(frame, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    without = frame.withColumn("exposure_buckets", F.lit(None).cast(frame.schema["exposure_buckets"].dataType))
    assert expand.bucket_cells(without, ["k"]).count() == 0


def test_ends_of_a_period_set_are_worked_out_once(spark):
    ends = F.array(F.make_date(F.col("id").cast("int") + 2024, F.lit(3), F.lit(31)), F.lit(D(2024, 6, 30)))
    df = spark.range(1).select(buckets.from_period(F.lit(D(2024, 2, 10)), ends).alias("b"))
    assert df._jdf.queryExecution().analyzed().toString().count("make_date") == 1
    assert [(b["lo"], b["hi"]) for b in df.first()["b"]] == [(D(2024, 2, 10), D(2024, 3, 31)), (D(2024, 4, 1), D(2024, 6, 30))]
