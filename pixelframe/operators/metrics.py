"""Benchmark histories: windows over runs, robust baselines, limits and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fixed, iso_time, round_half_even, scenario_id
from ..meta import require
from .windows import MAD_SCALE

SCENARIO, START, OUTCOME, NODE = "scenario_id", "_timestamp", "test:outcome", "test:nodeid"


def c(name: str) -> Column:
    """A column whose name may hold colons or dots."""
    return F.col(f"`{name}`")


# --- filters -------------------------------------------------------------------------------------------


def filter_outcome(df: DataFrame, outcome: str | None = "passed") -> DataFrame:
    return df.where(c(OUTCOME) == outcome) if outcome and OUTCOME in df.columns else df


def start_time(df: DataFrame) -> Column:
    """Epoch seconds of a run's start; from the ISO text where the number is missing."""
    if "test:start" in df.columns:
        return c("test:start").cast("double")
    return F.unix_micros(F.to_timestamp(c("test:start:datetime"))) / 1e6


def filter_recent(df: DataFrame, max_age_days: float | None, as_of: float) -> DataFrame:
    """Runs that started no more than max_age_days before as_of (epoch seconds); 0 or None keeps all."""
    if not max_age_days:
        return df
    cutoff = as_of - max_age_days * 86400
    if "test:start:YYYYMM" in df.columns:  # lets Spark skip whole months of a partitioned history
        df = df.where(c("test:start:YYYYMM") >= F.date_format(F.timestamp_seconds(F.lit(cutoff)), "yyyy-MM"))
    return df.where(start_time(df) >= cutoff)


def filter_regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """The pattern must match at the start of the text."""
    return df.where(c(column).rlike(f"^(?:{pattern})"))


def sample_n(df: DataFrame, n: int, seed: int = 0, keys: Sequence[str] | None = None, most_sorted: int = 100_000) -> DataFrame:
    """n rows chosen by a seeded hash of the key columns as text (all for a negative n).

    Up to most_sorted rows are the first in order of the hash. Beyond, a count of the rows by the hash's leading digits finds the digits that the last row
    has, twice (65,536 numbers each); what lies below is taken where it is, and only the rows of the border are sorted.
    """
    if n < 0:
        return df
    keys = list(keys or df.columns)
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), *(c(k).cast("string") for k in keys)))
    if n <= most_sorted:
        return df.orderBy(hashed, *(c(k) for k in keys)).limit(n)
    rows, taken, left = df.withColumn("_hash", hashed), [], n
    for at in (1, 5):
        digits = F.substring("_hash", at, 4)
        counts = rows.groupBy(digits.alias("d")).agg(F.count("*").alias("c"))
        upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("d")))
        border = upto.where(F.col("upto") >= left).orderBy("d").first()
        if border is None:
            return df
        taken.append(rows.where(digits < border.d))
        left -= border.upto - border.c
        rows = rows.where(digits == border.d)
    some = rows.orderBy("_hash", *(c(k) for k in keys)).limit(left)
    return taken[0].unionAll(taken[1]).unionAll(some).drop("_hash")


# --- histories --------------------------------------------------------------------------------------------


def with_scenario(df: DataFrame) -> DataFrame:
    """scenario_id from the node id where it is missing, and the time of the run as number and text."""
    own = scenario_id(c(NODE))
    known = F.coalesce(F.col(SCENARIO), own) if SCENARIO in df.columns else own
    return df.withColumn(SCENARIO, known).withColumn(START, start_time(df)).withColumn("_datetime", iso_time(F.col(START)))


def _latest(by: str = SCENARIO) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(F.desc(START), F.desc(c(NODE))))


def latest_run(df: DataFrame) -> DataFrame:
    return df.withColumn("_n", _latest()).where("_n = 1").drop("_n")


def previous_runs(df: DataFrame) -> DataFrame:
    return df.withColumn("_n", _latest()).where("_n > 1").drop("_n")


def last_n_valid(df: DataFrame, metric: str, n: int) -> DataFrame:
    """The last n runs of each scenario whose metric is neither null nor NaN."""
    valid = df.where(c(metric).isNotNull() & ~F.isnan(c(metric).cast("double")))
    return valid.withColumn("_n", _latest()).where(F.col("_n") <= n).drop("_n")


def group_history(df: DataFrame, metric: str) -> DataFrame:
    """Each scenario's runs in order of time as arrays of values and texts of time."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(START), F.col("_datetime"), c(metric).alias("value"))))
    return df.groupBy(SCENARIO).agg(rows.alias("_r")).select(SCENARIO, F.size("_r").alias("runs"), F.transform("_r", lambda r: r["_datetime"]).alias("times"), F.transform("_r", lambda r: r["value"]).alias("values"))


def track_update(events: DataFrame, keys: Sequence[str] = ("test", "name"), order: str = "seq", mode: str = "update") -> DataFrame:
    """Update mode keeps the last value of each key, append mode all of them."""
    if mode == "append":
        return events
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return events.withColumn("_n", last).where("_n = 1").drop("_n")


def phase_state(events: DataFrame) -> DataFrame:
    """The last phase started, ended and failed of each test; events are (test, seq, kind, phase)."""
    last = lambda kind: F.max_by("phase", F.when(F.col("kind") == kind, F.col("seq")))
    out = events.groupBy("test").agg(last("start").alias("phase_start"), last("end").alias("phase_end"), last("exception").alias("phase_exception"))
    return out.withColumn("failed_phase", F.split("phase_exception", ":")[0])


def failure_sections(lines: DataFrame) -> DataFrame:
    """Sections under FAILURES of test reports: lines (file, line_no, text) give (file, section, body).

    ==== title ==== opens a part, ____ title ____ a section in it. Lines lose the white space at their ends, bodies that around them; a section
    without lines has an empty body, and of sections of one title in a file the last counts. Reports are handled apart, by file;
    line_no is anything that orders a file's lines.
    """
    h1 = F.regexp_extract("text", r"^={4,}\s+(.+)\s+={4,}$", 1)
    h2 = F.regexp_extract("text", r"^_{4,}\s+(.+)\s+_{4,}$", 1)
    by_line = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_h1", F.nullif(h1, F.lit(""))).withColumn("_h2", F.nullif(h2, F.lit("")))
    # a new part closes the section before it
    at = F.max(F.when(F.col("_h1").isNotNull(), F.struct("line_no", F.col("_h1").alias("h")))).over(by_line)
    section = F.max(F.when(F.col("_h2").isNotNull(), F.struct("line_no", F.col("_h2").alias("h")))).over(by_line)
    placed = marked.withColumn("_part", at).withColumn("_sec", section)
    inside = placed.where((F.col("_part.h") == "FAILURES") & (F.col("_sec.line_no") > F.col("_part.line_no")) & F.col("_h1").isNull())
    line = F.struct("line_no", F.regexp_replace("text", r"\s+$", "").alias("text"))
    rows = F.sort_array(F.collect_list(F.when(F.col("_h2").isNull(), line)))
    body = F.regexp_replace(F.array_join(F.transform(rows, lambda r: r["text"]), "\n"), r"^\s+|\s+$", "")
    joined = inside.groupBy("file", F.col("_sec.h").alias("section"), F.col("_sec.line_no").alias("_at")).agg(body.alias("body"))
    joined = joined.groupBy("file", "section").agg(F.max_by("body", "_at").alias("body"))
    return joined.select("file", "section", "body")


# --- baselines --------------------------------------------------------------------------------------------


def mad_threshold(df: DataFrame, keys: Sequence[str], metric: str, k: float = 3.0, min_margin: float = 2.0) -> DataFrame:
    """(keys, n, median, mad, margin, upper_limit, lower_limit): median +- max(min_margin, k scaled deviations).

    Limits have four decimals (half to even), the lower one is 0 at least. Two aggregations; values never meet on the driver.
    """
    v = c(metric).cast("double")
    rows = df.select(*keys, v.alias("_v"))
    centre = rows.groupBy(*keys).agg(F.median("_v").alias("median"), F.count("_v").alias("n"))
    spread = rows.join(centre.select(*keys, "median"), list(keys)).groupBy(*keys).agg(F.median(F.abs(F.col("_v") - F.col("median"))).alias("mad"))
    margin = F.greatest(F.lit(float(min_margin)), k * MAD_SCALE * F.col("mad"))
    out = centre.join(spread, list(keys)).withColumn("margin", margin)
    return out.select(*keys, "n", "median", "mad", "margin", round_half_even(F.col("median") + F.col("margin"), 4).alias("upper_limit"), F.greatest(F.lit(0.0), round_half_even(F.col("median") - F.col("margin"), 4)).alias("lower_limit"))


def compute_baselines(history: DataFrame, metric: str = "costs", min_samples: int = 3, max_samples: int = 20, k: float = 3.0, min_margin: float = 2.0) -> DataFrame:
    """Limits of each scenario from its last max_samples valid runs; scenarios with fewer than min_samples have none."""
    recent = last_n_valid(history, metric, max_samples)
    return mad_threshold(recent, [SCENARIO], metric, k, min_margin).where(F.col("n") >= min_samples)


def python_float(x: Column) -> Column:
    """A double as Python writes it: at least one decimal."""
    text = x.cast("double").cast("string")
    return text


def check_limits(latest: DataFrame, baselines: DataFrame, metric: str = "costs") -> DataFrame:
    """latest with its limits and `violation` (a message, or null); a null or NaN metric never violates."""
    actual = c(metric).cast("double")
    valid = actual.isNotNull() & ~F.isnan(actual)
    head = F.concat(F.lit("["), F.col(SCENARIO), F.lit(f"] regression in '{metric}': actual="), python_float(actual))
    over = F.concat(head, F.lit(" exceeds upper_limit="), python_float(F.col("upper_limit")))
    under = F.concat(head, F.lit(" below lower_limit="), python_float(F.col("lower_limit")))
    message = F.when(valid & (actual > F.col("upper_limit")), over).when(valid & (actual < F.col("lower_limit")), under)
    return latest.join(baselines, SCENARIO, "left").withColumn("violation", message)


def performance_regressions(history: DataFrame, as_of: float, metric: str = "costs", outcome: str = "passed", max_age_days: float = 90, min_samples: int = 3, max_samples: int = 20) -> DataFrame:
    """(scenario_id, runs, status, message) for each scenario.

    A scenario with fewer than three runs has an insufficient history; of the others the latest run is checked
    against the baseline of those before it, if that has min_samples valid values.
    """
    runs = with_scenario(filter_recent(filter_outcome(history, outcome), max_age_days, as_of)).withColumn("_n", _latest())
    counted = runs.groupBy(SCENARIO).agg(F.count("*").alias("runs"))
    base = compute_baselines(runs.where("_n > 1").drop("_n"), metric, min_samples, max_samples)
    latest = check_limits(runs.where("_n = 1").drop("_n"), base, metric).select(SCENARIO, "violation", "upper_limit")
    joined = counted.join(latest, SCENARIO)
    few = F.col("runs") < 3
    status = F.when(few, "insufficient").when(F.col("upper_limit").isNull(), "no baseline").when(F.col("violation").isNotNull(), "regression").otherwise("ok")
    message = F.when(few, F.concat(F.lit("insufficient history ("), F.col("runs").cast("string"), F.lit(" runs)"))).when(F.col("upper_limit").isNull(), F.lit(f"no {metric} baseline")).otherwise(F.coalesce("violation", F.lit("ok")))
    return joined.select(SCENARIO, "runs", status.alias("status"), message.alias("message"))


def outcome_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("n"))


def trend_series(history: DataFrame, metric: str = "costs") -> DataFrame:
    """What a chart of each scenario needs: values in order, the median and limits repeated, and the top of the axis."""
    runs = with_scenario(history).where(c(metric).isNotNull() & ~F.isnan(c(metric).cast("double")))
    base = mad_threshold(runs, [SCENARIO], metric)
    grouped = group_history(runs, metric).join(base, SCENARIO)
    top = F.greatest(F.lit(1.0), 1.1 * F.greatest(F.array_max("values"), F.col("upper_limit")))
    return grouped.select(SCENARIO, "times", "values", *(F.array_repeat(n, F.col("runs").cast("int")).alias(n) for n in ("median", "upper_limit", "lower_limit")), top.alias("y_max"))


# --- job metadata -------------------------------------------------------------------------------------------


def usage_metrics(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """(job, name, value): the cost, and usage:{name}:{unit} where a unit and a value are given."""
    cost = jobs.where(F.col("cost").isNotNull()).select(key, F.lit("costs").alias("name"), F.col("cost").cast("double").alias("value"))
    used = jobs.select(key, F.explode("usage").alias("u")).where(F.col("u.unit").isNotNull() & F.col("u.value").isNotNull())
    return cost.union(used.select(key, F.concat_ws(":", F.lit("usage"), "u.name", "u.unit"), F.col("u.value").cast("double")))


def asset_areas(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """(job, megapixel, km2): the largest of a job's assets; km2 only for metric zone codes 32601-32659 and 32701-32759."""
    a = jobs.select(key, F.explode(F.map_values("assets")).alias("a"))
    shape, box, code = F.col("a.`proj:shape`"), F.col("a.`proj:bbox`"), F.col("a.`proj:epsg`")
    zone = ((code >= 32601) & (code < 32660)) | ((code >= 32701) & (code < 32760))
    area = F.when(zone, (box[2] - box[0]) * (box[3] - box[1]) / 1e6)
    return a.groupBy(key).agg(F.max(shape[0].cast("double") * shape[1] / 1e6).alias("megapixel"), F.max(area).alias("km2"))


def pivot_metrics(rows: DataFrame, names: Sequence[str], key: str = NODE) -> DataFrame:
    """(key, name, value) rows as one wide row for each key; a name that repeats within a key is an error."""
    twice = F.raise_error(F.concat(F.lit("duplicate metric: "), F.first("name")))
    value = F.when(F.count("value") > 1, twice.cast("double")).otherwise(F.first("value"))
    return rows.groupBy(c(key)).pivot("name", list(names)).agg(value)


def cost_pivot(jobs: DataFrame, months: Sequence[int]) -> DataFrame:
    """Mean cost by height of the box in about kilometres (108 a degree) and length in months (30 days)."""
    span = F.round((F.col("north") - F.col("south")) * 108).cast("int").alias("km")
    length = F.round(F.datediff("end", "start") / 30).cast("int").alias("months")
    return jobs.select(span, length, "cost").groupBy("km").pivot("months", list(months)).agg(F.avg("cost"))


def job_grid(boxes: DataFrame, months: Sequence[int], base: str) -> DataFrame:
    """Every box (any columns) with every duration from a base date."""
    return boxes.withColumn("months", F.explode(F.array(*(F.lit(int(m)) for m in months)))).withColumn("start", F.lit(base).cast("date")).withColumn("end", F.expr("add_months(start, months)"))


# --- comparisons --------------------------------------------------------------------------------------------


def compare_cubes(actual: DataFrame, expected: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("x", "y"), rtol: float = 1e-3, atol: float = 1.0, pixel_tolerance: float = 1.0) -> DataFrame:
    """One row: missing, extra and bad pixels, their percentage of all, and whether that is within the tolerance."""
    a = actual.select(*keys, *(F.col(b).cast("double").alias(f"_a_{b}") for b in bands), F.lit(True).alias("_ina"))
    e = expected.select(*keys, *(F.col(b).cast("double").alias(f"_e_{b}") for b in bands), F.lit(True).alias("_ine"))
    wrong = F.lit(False)
    for b in bands:
        x, y = F.col(f"_a_{b}"), F.col(f"_e_{b}")
        wrong = wrong | F.coalesce(F.abs(x - y) > atol + rtol * F.abs(y), x.isNull() != y.isNull())
    both = F.col("_ina").isNotNull() & F.col("_ine").isNotNull()
    out = a.join(e, list(keys), "full_outer").agg(
        F.count("*").alias("pixels"), F.count_if(F.col("_ina").isNull()).alias("missing"), F.count_if(F.col("_ine").isNull()).alias("extra"), F.count_if(both & wrong).alias("bad")
    )
    percent = F.coalesce(F.try_divide(100.0 * (F.col("missing") + F.col("extra") + F.col("bad")), F.col("pixels")), F.lit(0.0))
    return out.withColumn("bad_percent", percent).withColumn("passed", percent <= pixel_tolerance)


def diff_links(actual: DataFrame, expected: DataFrame, rel: str = "derived_from") -> DataFrame:
    """Links of a relation that only one side has."""
    a, e = (d.where(F.col("rel") == rel).select("href").distinct() for d in (actual, expected))
    only = lambda x, y, side: x.exceptAll(y).select("href", F.lit(side).alias("side"), F.lit(f"{rel}-change").alias("kind"))
    return only(a, e, "actual").union(only(e, a, "expected"))


def compare_files(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """All file names of both sides with sizes and a note where they differ."""
    joined = actual.select("file", F.col("size").alias("_a")).join(expected.select("file", F.col("size").alias("_e")), "file", "full_outer")
    kb = lambda x: fixed(x / 1024, 1)
    note = F.when(F.col("_a").isNull(), F.lit("(missing in actual)")).when(F.col("_e").isNull(), F.lit("(missing in reference)")).when(F.col("_a") != F.col("_e"), F.concat(F.lit("(actual: "), kb(F.col("_a")), F.lit(" kb)")))
    return joined.select("file", kb(F.coalesce("_e", "_a")).alias("kb"), note.alias("note"))


def union_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all runs; a column that one lacks is null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(c(key).alias(key)).agg(F.count("*").alias("n")).where("n > 1")


def best_scenes(df: DataFrame, min_images: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    """Scenes (t, invalid): all without invalid pixels if there are min_images of these, else the min_images with fewest."""
    w = Window.partitionBy(*keys)
    counted = df.withColumn("_clean", F.sum((F.col("invalid") == 0).cast("int")).over(w)).withColumn("_n", F.row_number().over(w.orderBy("invalid", "t")))
    chosen = F.when(F.col("_clean") >= min_images, F.col("invalid") == 0).otherwise(F.col("_n") <= min_images)
    return counted.where(chosen).drop("_clean", "_n")


def ordered_shares(df: DataFrame, key: str = "feature_index") -> DataFrame:
    """Each feature's classes with their percentage, largest first."""
    names = [n for n in df.columns if n != key]
    long = df.select(key, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(key, names, "label", "share")
    total = F.sum("share").over(Window.partitionBy(key))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("share"), "label"))
    return long.withColumn("percent", F.try_divide(100 * F.col("share"), total)).withColumn("place", place)


def order_groups(df: DataFrame) -> DataFrame:
    require(df, [SCENARIO])
    return df.orderBy(SCENARIO)


def sort_by_time(df: DataFrame) -> DataFrame:
    return df.orderBy(START)
