"""Campaign metrics, bands, profiles and data-quality checks, each a function from DataFrame to DataFrame.

Labels: 0 rejected, 1 and 2 accepted (two products); null and other labels count as records but not as valid ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Valid and accepted labels, and month names in calendar order.
VALID, ACCEPTED = (0, 1, 2), (1, 2)
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def is_valid(label: Column) -> Column:
    return F.coalesce(label.isin(*VALID), F.lit(False))


def is_accepted(label: Column) -> Column:
    return F.coalesce(label.isin(*ACCEPTED), F.lit(False))


def rounded(number: Column, places: int) -> Column:
    """A double rounded in double arithmetic, ties away from zero, as DuckDB does it.

    ``F.round`` with places rounds the shortest decimal text of a double, which for some halves gives another cent.
    """
    return F.round(number * 10.0**places) / 10.0**places


def known(value: Column) -> Column:
    """A group key; null is "Unknown"."""
    return F.coalesce(value, F.lit("Unknown"))


def sliced(frame: DataFrame, labels: list[int] | None, label_col: str = "label") -> DataFrame:
    """Rows with one of the labels; no labels mean no filter."""
    return frame.where(F.col(label_col).isin(*labels)) if labels else frame


def acceptance_columns(label: Column) -> list[Column]:
    """records, valid, accepted and rate; the rate of no valid rows is null."""
    valid, accepted = F.count_if(is_valid(label)), F.count_if(is_accepted(label))
    return [F.count(F.lit(1)).alias("records"), valid.alias("valid"), accepted.alias("accepted"), F.try_divide(accepted, valid).alias("rate")]


def product_columns(label: Column) -> list[Column]:
    """Rows by label, and each product's share of accepted rows."""
    first, second, accepted = F.count_if(label == 1), F.count_if(label == 2), F.count_if(is_accepted(label))
    return [F.count_if(label == 0).alias("rejected"), first.alias("first_product"), second.alias("second_product"), F.try_divide(first, accepted).alias("first_share"), F.try_divide(second, accepted).alias("second_share")]


def acceptance(frame: DataFrame, label_col: str = "label") -> DataFrame:
    return frame.agg(*acceptance_columns(F.col(label_col)))


def snapshot(frame: DataFrame, label_col: str = "label") -> DataFrame:
    return frame.agg(*acceptance_columns(F.col(label_col)), *product_columns(F.col(label_col)))


def acceptance_by(frame: DataFrame, group_col: str, label_col: str = "label") -> DataFrame:
    return frame.groupBy(known(F.col(group_col)).alias("grp")).agg(*acceptance_columns(F.col(label_col)))


def acceptance_by_each(frame: DataFrame, dimensions: list[str], label_col: str = "label") -> DataFrame:
    """Acceptance and products for the values of several dimensions, in one pass over the frame."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), known(F.col(d).cast("string")).alias("grp")) for d in dimensions]))
    label = F.col("label_")
    return frame.select(F.col(label_col).alias("label_"), pairs.alias("p")).groupBy("p.dimension", "p.grp").agg(*acceptance_columns(label), *product_columns(label)).select("dimension", "grp", "records", "valid", "accepted", "rate", "rejected", "first_product", "second_product", "first_share", "second_share")


def best_group(groups: DataFrame) -> DataFrame:
    """The group of the highest rate of each dimension; null rates are passed over, ties go to the first name."""
    order = W.partitionBy("dimension").orderBy(F.desc("rate"), "grp")
    return groups.where("rate is not null").withColumn("place", F.row_number().over(order)).where("place = 1").select("dimension", "grp", "rate")


def age_band(age: Column) -> Column:
    """Bands closed on the right, so that 29.5 is in 30-39."""
    return F.when(age.isNull() | F.isnan(age), None).when(age <= 29, "<30").when(age <= 39, "30-39").when(age <= 49, "40-49").when(age <= 59, "50-59").otherwise("60+")


def income_band(income: Column, cuts: tuple[float, float, float, float] = (15_000, 30_000, 50_000, 100_000)) -> Column:
    a, b, c, d = cuts
    return (
        F.when(income.isNull() | F.isnan(income), "Missing").when(income < 0, "Negative").when(income == 0, "Zero")
        .when(income <= a, f"0-{a:g}").when(income <= b, f"{a:g}-{b:g}").when(income <= c, f"{b:g}-{c:g}").when(income <= d, f"{c:g}-{d:g}").otherwise(f">{d:g}")
    )


def month_order(month: Column) -> Column:
    """1 to 12 by name; 0 for other names; null stays null."""
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month).cast("long")


def response_label(label: Column) -> Column:
    return F.when(label == 0, "Rejected").when(label == 1, "First product").when(label == 2, "Second product").otherwise("Unknown")


def has_missing(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def missing_counts(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values of each column with a severity: over 20 % alert, over 5 % warn."""
    counts = frame.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = counts.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in columns])).alias("f")).select("f.field", "f.missing", F.try_divide("f.missing", F.col("n")).alias("rate"))
    return rows.withColumn("severity", F.when(F.col("rate") > 0.20, "alert").when(F.col("rate") > 0.05, "warn").otherwise("info"))


def missing_patterns(frame: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """The commonest patterns of missing columns as strings of 0 and 1, ties by pattern."""
    pattern = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    return frame.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), "pattern").limit(most)


def profile_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    """rows, non-null, null, null rate, distinct values and their share of non-null rows, by column; exact."""
    counts = frame.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"{c}_full") for c in columns], *[F.count_distinct(c).alias(f"{c}_distinct") for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col("n").alias("records"), F.col(f"{c}_full").alias("non_null"), F.col(f"{c}_distinct").alias("distinct_values")) for c in columns]))
    return counts.select(each.alias("f")).select("f.*").select("field", "records", "non_null", (F.col("records") - F.col("non_null")).alias("nulls"), F.try_divide(F.col("records") - F.col("non_null"), "records").alias("null_rate"), "distinct_values", F.try_divide("distinct_values", "non_null").alias("cardinality"))


def top_values(frame: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """The commonest values of each column, missing ones included, ties by value."""
    pairs = frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*")
    counted = pairs.groupBy("field", "value").agg(F.count(F.lit(1)).alias("records"))
    order = W.partitionBy("field").orderBy(F.desc("records"), F.asc_nulls_last("value"))
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("field", "value", "records", "place")


@dataclass
class _Range:
    """Where the two values beside one quantile of a field lie: ranks from ``below`` on, between two values, both included."""

    field: str
    place: float  # (n - 1) * q
    whole: int  # numbers of the field
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    within: int = 0
    inner: int = 0  # without both ends, which are one value each


def _number(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _narrowed(frame: DataFrame, ranges: list[_Range], accuracy: int) -> None:
    """Cut ranges by a sketch of the values in them, and count exactly what is below and within each; two passes."""
    margin = 8 / accuracy
    asked = []
    for k, r in enumerate(ranges):
        value = _number(r.field)
        first, last = (math.floor(r.place) - r.below) / r.within, (math.ceil(r.place) + 1 - r.below) / r.within
        cut = [max(0.0, first - margin), min(1.0, last + margin)]
        asked.append(F.percentile_approx(F.when(value.between(r.low, r.high), value), F.array(*map(F.lit, cut)), accuracy).alias(f"c{k}"))
    cuts = frame.agg(*asked).first()
    for k, r in enumerate(ranges):
        r.low, r.high = cuts[k]
    values = [_number(r.field) for r in ranges]
    counts = frame.agg(
        *(F.count_if(v < r.low).alias(f"b{k}") for k, (v, r) in enumerate(zip(values, ranges, strict=True))),
        *(F.count_if(v.between(r.low, r.high)).alias(f"w{k}") for k, (v, r) in enumerate(zip(values, ranges, strict=True))),
        *(F.count_if((v > r.low) & (v < r.high)).alias(f"i{k}") for k, (v, r) in enumerate(zip(values, ranges, strict=True))),
    ).first()
    for k, r in enumerate(ranges):
        r.below, r.within, r.inner = counts[f"b{k}"], counts[f"w{k}"], counts[f"i{k}"]
        if not r.below <= math.floor(r.place) or not math.ceil(r.place) < r.below + r.within:  # beyond what the sketch promises
            r.low, r.high, r.below, r.within, r.inner = -math.inf, math.inf, 0, r.whole, r.whole


def exact_quantiles(frame: DataFrame, columns: list[str], quantiles: tuple[float, ...], counts: dict[str, int] | None = None, most: int = 1 << 20, accuracy: int = 10_000) -> DataFrame:
    """(field, q): exact interpolated quantiles of the numbers in some columns; fields without a number have no row.

    While more than ``most`` rows could hold a rank, a sketch says between which values it lies, and only those are looked at
    further: each round leaves a few thousandths of them, whatever their distribution, and a range of one value is done. So no task
    puts more than ``most`` values in order, and the driver holds a range for each quantile of a field. counts: numbers of the
    columns, where they are known.
    """
    spark = frame.sparkSession
    counts = counts or frame.agg(*(F.count(_number(c)).alias(c) for c in columns)).first().asDict()
    ranges = {(c, k): _Range(c, (counts[c] - 1) * q, counts[c], within=counts[c], inner=counts[c]) for c in columns if counts[c] for k, q in enumerate(quantiles)}
    for _ in range(64):
        wide = [r for r in ranges.values() if r.inner > most and r.low < r.high]
        if not wide:
            break
        before = [r.inner for r in wide]
        _narrowed(frame, wide, accuracy)
        if [r.inner for r in wide] == before:
            break
    one = {key: r for key, r in ranges.items() if r.low == r.high}
    rest = {key: r for key, r in ranges.items() if key not in one}
    spans = sorted({(r.field, r.low, r.high, r.below) for r in rest.values()})
    each = F.array(*(F.when(_number(f).between(low, high), F.struct(F.lit(k).alias("span"), _number(f).alias("value"))) for k, (f, low, high, _) in enumerate(spans))) if spans else F.array().cast("array<struct<span int, value double>>")
    held = frame.select(F.explode(F.array_compact(each)).alias("p")).select("p.*").groupBy("span", "value").agg(F.count(F.lit(1)).alias("m"))
    ends = held.withColumn("end", F.sum("m").over(W.partitionBy("span").orderBy("value")))
    number = {s: k for k, s in enumerate(spans)}
    wanted = [(number[r.field, r.low, r.high, r.below], rank - r.below, c, k, r.place) for (c, k), r in rest.items() for rank in {math.floor(r.place), math.ceil(r.place)}]
    asked = spark.createDataFrame(wanted, "span int, rank long, field string, k int, place double")
    found = ends.join(F.broadcast(asked), "span").where("rank < end and rank >= end - m")  # two of a quantile
    known = spark.createDataFrame([(c, k, r.place, r.low) for (c, k), r in one.items()], "field string, k int, place double, value double")
    pairs = found.select("field", "k", "place", "value").unionByName(known).groupBy("field", "k", "place").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    share = F.col("place") - F.floor("place")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * (1 - share) + F.col("high") * share)
    return pairs.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))), lambda x: x["v"]).alias("q"))


def numeric_profile(frame: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Extremes, mean, sample deviation, exact interpolated quantiles, zeros and negatives of each column."""
    told = {"non_null": F.count, "least": F.min, "most": F.max, "mean": lambda v: F.round(F.avg(v), 6), "deviation": lambda v: F.round(F.stddev_samp(v), 6), "zeros": lambda v: F.count_if(v == 0), "negatives": lambda v: F.count_if(v < 0)}
    own, counts = _by_field(frame, columns, told, "non_null")
    found = own.join(exact_quantiles(frame, columns, quantiles, counts), "field")
    return found.select("field", "non_null", "least", "most", "mean", "deviation", *[F.round(F.col("q")[i], 6).alias(f"q{round(q * 100):02d}") for i, q in enumerate(quantiles)], "zeros", "negatives")


def _by_field(frame: DataFrame, columns: list[str], told: dict[str, Callable[[Column], Column]], count: str) -> tuple[DataFrame, dict[str, int]]:
    """A row of measures for each column, made in one pass, and the numbers that each column holds."""
    row = frame.agg(*(F.struct(*(f(_number(c)).alias(n) for n, f in told.items())).alias(c) for c in columns)).first()
    kinds = {"least": "double", "most": "double", "mean": "double", "deviation": "double"}
    schema = "field string, " + ", ".join(f"{n} {kinds.get(n, 'long')}" for n in told)
    return frame.sparkSession.createDataFrame([(c, *row[c]) for c in columns], schema), {c: row[c][count] for c in columns}


def financial_summary(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Number, quartiles, extremes, zeros and negatives of each money column."""
    told = {"values": F.count, "least": F.min, "most": F.max, "zeros": lambda v: F.count_if(v == 0), "negatives": lambda v: F.count_if(v < 0)}
    own, counts = _by_field(frame, columns, told, "values")
    quartiles = [F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    return own.join(exact_quantiles(frame, columns, (0.25, 0.5, 0.75), counts), "field").select("field", "values", *quartiles, "least", "most", "zeros", "negatives")


def text_profile(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Empty and untrimmed values and lengths of each text column."""
    pairs = frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("p")).select("p.*").where("value is not null")
    size = F.length("value")
    return pairs.groupBy("field").agg(F.count_if(F.trim("value") == "").alias("empty"), F.count_if(F.trim("value") != F.col("value")).alias("untrimmed"), F.min(size).cast("long").alias("shortest"), F.max(size).cast("long").alias("longest"), F.round(F.avg(size), 6).alias("mean_length"))


def duplicates(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Copies beyond the first and rows in groups of copies; nulls are equal to nulls."""
    groups = frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_groups"))


def pair_comparison(frame: DataFrame, left: str, right: str) -> DataFrame:
    """Equal, both missing, all and differing pairs; a pair with one side missing is in none but all."""
    a, b = F.col(left), F.col(right)
    both = a.isNotNull() & b.isNotNull()
    return frame.agg(F.count_if(both & (a == b)).alias("equal_pairs"), F.count_if(a.isNull() & b.isNull()).alias("shared_missing"), F.count(F.lit(1)).alias("pairs"), F.count_if(both & (a != b)).alias("mismatches"))


def flow_mismatches(frame: DataFrame, net: str, inflow: str, outflow: str, tolerance: float = 0.01) -> DataFrame:
    """Rows whose net flow is not inflow less outflow; rows with a missing part are not compared."""
    gap = F.abs(F.col(net) - (F.col(inflow) - F.col(outflow)))
    return frame.agg(F.count(gap).alias("compared"), F.count_if(gap > tolerance).alias("mismatches"))


def quality_flags(frame: DataFrame, columns: list[str], label_col: str = "label", compare: tuple[str, str] | None = None) -> DataFrame:
    """(check, subject, records, severity) of all checks with findings."""
    missing = missing_counts(frame, columns).where("missing > 0").select(F.lit("missing").alias("check"), F.col("field").alias("subject"), F.col("missing").alias("records"), "severity")
    label = frame.agg(F.count_if(~is_valid(F.col(label_col))).alias("records")).where("records > 0").select(F.lit("invalid label").alias("check"), F.lit(label_col).alias("subject"), "records", F.lit("alert").alias("severity"))
    copies = duplicates(frame, columns).where("excess > 0").select(F.lit("copies").alias("check"), F.lit("*").alias("subject"), F.col("excess").alias("records"), F.lit("warn").alias("severity"))
    found = missing.unionByName(label).unionByName(copies)
    if compare:
        pairs = pair_comparison(frame, *compare).where("mismatches > 0")
        found = found.unionByName(pairs.select(F.lit("pair differs").alias("check"), F.lit("/".join(compare)).alias("subject"), F.col("mismatches").alias("records"), F.lit("info").alias("severity")))
    return found


def measures(frame: DataFrame, visible_labels: list[int] | None, by: list[str] | None = None, label_col: str = "label") -> DataFrame:
    """Report measures under a label slicer.

    valid, accepted and rate ignore the slicer on the label and keep every other filter and grouping; visible counts
    the rows that the slicer leaves. Groups are those with a visible row.
    """
    label = F.col(label_col)
    seen = label.isin(*visible_labels) if visible_labels else F.lit(True)
    grouped = frame.groupBy(*[F.col(c) for c in by or []])
    return grouped.agg(F.count_if(seen).alias("visible"), *acceptance_columns(label)[1:]).where("visible > 0")


def under_slicers(frame: DataFrame, slices: dict[str, list[str]]) -> DataFrame:
    """Rows that slicers on some columns leave; an empty list of values leaves all."""
    for column, values in slices.items():
        if values:
            frame = frame.where(F.col(column).isin(*values))
    return frame


def cards(frame: DataFrame, slices: dict[str, list[str]], visible_labels: list[int] | None = None, label_col: str = "label") -> DataFrame:
    """The four cards of a report under its slicers, as one row: total rows, visible responses, accepted ones, and their rate.

    The slicer on the label counts for the visible responses alone.
    """
    label = F.col(label_col)
    seen = label.isin(*visible_labels) if visible_labels else F.lit(True)
    told = under_slicers(frame, slices).agg(F.count(F.lit(1)).alias("total"), F.count_if(seen).alias("visible"), *acceptance_columns(label)[1:])
    return told.select("total", "visible", "accepted", "rate")


def detail(frame: DataFrame, by: list[str], average: str, slices: dict[str, list[str]] | None = None) -> DataFrame:
    """The table of a report: the mean of a column and the records of each combination of some others, under slicers."""
    return under_slicers(frame, slices or {}).groupBy(*by).agg(F.round(F.avg(average), 6).alias(f"mean_{average}"), F.count(F.lit(1)).alias("records"))


def visual(frame: DataFrame, by: list[str], slices: dict[str, list[str]] | None = None, order: list[Column] | None = None, label_col: str = "label") -> DataFrame:
    """What a report shows by some columns under slicers on others: counts and rates, most accepted first or in the order given."""
    return under_slicers(frame, slices or {}).groupBy(*by).agg(*acceptance_columns(F.col(label_col))).orderBy(*(order or [F.desc("accepted")]), *by)
