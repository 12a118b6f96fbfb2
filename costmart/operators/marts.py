"""Dashboard marts (G1–G14): KPI row, top-N tables, trends, shares,
histogram, per-patient and per-payer summaries.

Money is summed as a decimal (exact, independent of row order) and cast to
double at the output; a mean is ``double(sum) / count`` (decision D8). Group
keys are never NULL (decision D2). Ties break on the key, ascending (D5).

Scale notes. Every grouping is a partial + final hash aggregate, so a hot key
is collapsed on the map side before the shuffle. Top-N outputs use
``orderBy(...).limit(n)`` (``TakeOrderedAndProject``): each task keeps its own
top n, no global sort and no single-task window over all groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costmart.functions.textfmt import compact, count_text, month_label, rupiah, truncate
from costmart.operators.aggregates import first_k_distinct, order_value, top_k_values
from costmart.schema import (
    DEFAULT_COLUMNS,
    FIRST_CLINICS,
    FIRST_DOCTORS,
    HISTOGRAM_BINS,
    OTHER,
    SHARE_TOP_N,
    TOP_N,
    TOP_PATIENTS,
    TOP_PER_PAYER,
    UNKNOWN,
    Columns,
)
from costmart.session import materialise

#: A patient with more rows is not put into one task; rows that a task takes on average.
HOT_PATIENT_ROWS, PATIENT_TASK_ROWS = 200_000, 500_000


def money(c: Column) -> Column:
    return c.cast("double")


def mean_of(cost: str) -> Column:
    """Exact decimal sum over the non-null count, as double."""
    return F.try_divide(F.sum(cost).cast("double"), F.count(cost))


def _nonnull(df: DataFrame, *keys: str) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)


# --------------------------------------------------------------------- G1, G14
def kpis(df: DataFrame, cols: Columns = DEFAULT_COLUMNS, exact: bool = True) -> DataFrame:
    """G1: one row of KPIs. Distinct counts skip NULL. ``exact=False`` swaps
    the exact distinct counts (an ``Expand`` over the input) for HyperLogLog
    sketches, which keep one small state per task regardless of cardinality."""
    distinct = F.count_distinct if exact else (lambda c: F.approx_count_distinct(c, 0.01))
    return df.agg(
        money(F.sum(cols.cost)).alias("total"),
        mean_of(cols.cost).alias("mean"),
        money(F.max(cols.cost)).alias("max"),
        money(F.min(cols.cost)).alias("min"),
        F.count(F.lit(1)).alias("n_rows"),
        distinct(F.col(cols.patient_id)).alias("n_patients"),
        distinct(F.col(cols.clinic)).alias("n_clinics"),
        distinct(F.col(cols.doctor)).alias("n_doctors"),
        distinct(F.col(cols.payer)).alias("n_payers"),
    )


def kpi_display(k: DataFrame) -> DataFrame:
    """G1 as shown: money as 'Rp 1,234'; rows and patients with thousands
    separators, clinics, doctors and payers as plain numbers."""
    return k.select(
        *[rupiah(c).alias(f"{c}_text") for c in ("total", "mean", "max", "min")],
        *[count_text(c).alias(f"{c}_text") for c in ("n_rows", "n_patients")],
        *[F.col(c).cast("string").alias(f"{c}_text")
          for c in ("n_clinics", "n_doctors", "n_payers")])


def filter_stats(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """Rows, mean and sum under a filter, with their display text."""
    s = df.agg(F.count(F.lit(1)).alias("n_rows"), mean_of(cols.cost).alias("mean"),
               money(F.sum(cols.cost)).alias("total"))
    return s.withColumns({"n_rows_text": count_text("n_rows"), "mean_text": rupiah("mean"),
                          "total_text": rupiah("total")})


# --------------------------------------------------------------------- G2, G3
def top_n(df: DataFrame, key: str, n: int = TOP_N) -> DataFrame:
    """The n keys with the most rows (key, n_rows), NULL key dropped."""
    return (_nonnull(df, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy(F.desc("n_rows"), F.col(key)).limit(n))


def top_value(df: DataFrame, key: str, width: int = 20) -> DataFrame:
    """The most frequent key, with its label truncated for display."""
    return top_n(df, key, 1).withColumn("label", truncate(key, width))


# --------------------------------------------------------------------- G4–G6
def top_n_measure(df: DataFrame, key: str, n: int = TOP_N, cols: Columns = DEFAULT_COLUMNS,
                  with_total: bool = False, count_of: str | None = None) -> DataFrame:
    """Among the n keys with the most rows, the mean cost and a count,
    sorted by mean cost, descending.

    One aggregation serves both steps: the row count that picks the top n and
    the measures are computed in the same pass (no semi-join and no second
    scan; ``filters.keep_top_keys`` is the row-level form of the same set).
    ``count_of``: the column whose non-null values are counted (the patient
    id for clinics and doctors, the cost for payers).
    """
    count_col = count_of or cols.patient_id
    stats = _nonnull(df, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        mean_of(cols.cost).alias("mean_cost"),
        money(F.sum(cols.cost)).alias("total_cost"),
        F.count(count_col).alias("n_rows"),
    )
    top = stats.orderBy(F.desc("_n"), F.col(key)).limit(n)
    out_cols = [key, "mean_cost"] + (["total_cost"] if with_total else []) + ["n_rows"]
    return top.select(*out_cols).orderBy(F.desc("mean_cost"), F.col(key))


def mean_cost_by_clinic(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    return top_n_measure(df, cols.clinic, TOP_N, cols)


def mean_cost_by_doctor(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    return top_n_measure(df, cols.doctor, TOP_N, cols)


def mean_cost_by_payer(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    return top_n_measure(df, cols.payer, TOP_N, cols, with_total=True, count_of=cols.cost)


# --------------------------------------------------------------------- G7, G8
def top_patients(df: DataFrame, n: int = TOP_PATIENTS, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """The n patients (by name) with the highest total cost."""
    return (_nonnull(df, cols.patient).groupBy(cols.patient)
            .agg(F.sum(cols.cost).alias("_total"), F.count(cols.patient_id).alias("n_visits"))
            .orderBy(F.desc("_total"), F.col(cols.patient)).limit(n)
            .select(cols.patient, money(F.col("_total")).alias("total_cost"), "n_visits"))


def monthly_trend(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """Per month: total, mean, count, 'Jan 2025' label, compact total label."""
    return (_nonnull(df, cols.month_key).groupBy(cols.month_key)
            .agg(money(F.sum(cols.cost)).alias("total_cost"), mean_of(cols.cost).alias("mean_cost"),
                 F.count(cols.cost).alias("n_rows"))
            .withColumns({"label": month_label(cols.month_key),
                          "total_label": compact("total_cost")})
            .orderBy(cols.month_key))


# --------------------------------------------------------------------- G9, G10
def bucket_other(df: DataFrame, key: str, n: int = SHARE_TOP_N, other: str = OTHER) -> DataFrame:
    """G9 + G10: the n most frequent keys and one ``other`` row holding the
    rest (only when more than n keys exist), with each slice's percentage.

    The top n come from a top-k (no window over all groups); the rest is a
    left-anti join against those n keys (a proven size bound, so broadcast)
    and one global sum. The percentage window runs over at most n + 1 rows.
    """
    counts = _nonnull(df, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    top = counts.orderBy(F.desc("n_rows"), F.col(key)).limit(n)
    rest = (counts.join(F.broadcast(top.select(key)), on=key, how="left_anti")
            .agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("_keys"))
            .where(F.col("_keys") > 0)
            .select(F.lit(other).alias(key), F.col("n_rows").cast("bigint").alias("n_rows")))
    slices = top.unionByName(rest)
    total = F.sum("n_rows").over(Window.partitionBy())
    return slices.withColumn("pct", F.col("n_rows").cast("double") * 100.0 / total.cast("double"))


# --------------------------------------------------------------------- G11
def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in ``bins`` equal-width bins between min and max.

    The last bin is closed; min = max gives one bin. The bounds come from one
    scalar subquery (a small aggregate job whose result is a literal), so the
    rows are not joined to anything.
    """
    x = F.col(column).cast("double")
    vals = df.where(F.col(column).isNotNull())
    bounds = vals.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    staged = vals.select(x.alias("_x"), bounds.alias("_b")).select(
        "_x", F.col("_b.lo").alias("_lo"), F.col("_b.hi").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - lo) / width), F.lit(bins - 1))).cast("int")
    counted = staged.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.any_value("_lo").alias("_lo"),
        F.any_value("_hi").alias("_hi"))
    return counted.select(
        "bin",
        (lo + F.col("bin") * width).alias("lo"),
        (lo + (F.col("bin") + 1) * width).alias("hi"),
        "n_rows",
    ).orderBy("bin")


# --------------------------------------------------------------------- G12, G13
def patient_grain(df: DataFrame, cols: Columns = DEFAULT_COLUMNS,
                  order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per (patient, clinic, doctor, payer): sum, counts, first row order."""
    order = list(order_by or cols.row_order(df.columns))
    return (_nonnull(df, cols.patient, cols.patient_id)
            .groupBy(cols.patient, cols.patient_id, cols.clinic, cols.doctor, cols.payer).agg(
                F.sum(cols.cost).alias("_sum"),
                F.count(cols.cost).alias("_cnt"),
                F.count(F.lit(1)).alias("_rows"),
                F.min(order_value(order)).alias("_first")))


def _patient_totals(rows: DataFrame, keys: Sequence[str], cols: Columns) -> DataFrame:
    """Per patient: total, mean, visits, main payer (NULL without one) and ``_rows``."""
    payers = rows.groupBy(*keys, cols.payer).agg(
        F.sum(cols.cost).alias("_sum"), F.count(cols.cost).alias("_cnt"),
        F.count(F.lit(1)).alias("_rows"))
    rank = F.when(F.col(cols.payer).isNotNull(), F.struct(-F.col("_rows"), F.col(cols.payer)))
    return payers.groupBy(*keys).agg(
        money(F.sum("_sum")).alias("total_cost"),
        F.try_divide(F.sum("_sum").cast("double"), F.sum("_cnt")).alias("mean_cost"),
        F.sum("_cnt").alias("n_visits"),
        F.min_by(cols.payer, rank).alias("main_payer"),
        F.sum("_rows").alias("_rows"))


def _first_lists(rows: DataFrame, keys: Sequence[str], cols: Columns, order: Sequence[str],
                 tasks: int) -> DataFrame:
    """First distinct clinics and doctors of patients whose rows fit one task: one shuffle of the
    rows by patient, then every step works within its partition."""
    needed = dict.fromkeys([*keys, cols.clinic, cols.doctor, *order])
    together = rows.select(*needed)
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Spark merges small partitions where it chose their number.
    together = together.repartition(tasks, *keys) if tasks > usual else together.repartition(*keys)
    clinic, doctor = (F.struct(F.lit(p).alias("part"), F.lit(k).alias("k"), F.col(c).alias("value"))
                      for p, k, c in (("c", FIRST_CLINICS, cols.clinic),
                                      ("d", FIRST_DOCTORS, cols.doctor)))
    seen = (together.select(*keys, order_value(order).alias("_order"),
                            F.explode(F.array(clinic, doctor)).alias("_v"))
            .select(*keys, "_order", "_v.part", "_v.k", "_v.value").where(F.col("value").isNotNull())
            .groupBy(*keys, "part", "k", "value").agg(F.min("_order").alias("_first")))
    w = Window.partitionBy(*keys, "part").orderBy("_first", "value")
    ranked = seen.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.col("k"))
    found = ranked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("part", "rn", "value"))).alias("_found"))

    def listed(part: str) -> Column:
        return F.array_join(F.transform(F.filter("_found", lambda s: s["part"] == part),
                                        lambda s: s["value"]), ", ")
    return found.select(*keys, listed("c").alias("clinics"), listed("d").alias("doctors"))


def _hot_lists(rows: DataFrame, keys: Sequence[str], cols: Columns,
               order: Sequence[str]) -> DataFrame:
    """The same for patients with very many rows: no step takes a patient's rows to one task."""
    grain = materialise(patient_grain(rows, cols, order), "patient-grain")
    clinics = first_k_distinct(grain, keys, cols.clinic, FIRST_CLINICS, [], "clinics",
                               first_col="_first")
    doctors = first_k_distinct(grain, keys, cols.doctor, FIRST_DOCTORS, [], "doctors",
                               first_col="_first")
    return clinics.join(doctors, keys, "full")


def patient_summary(df: DataFrame, cols: Columns = DEFAULT_COLUMNS,
                    order_by: Sequence[str] | None = None, hot_rows: int = HOT_PATIENT_ROWS,
                    task_rows: int = PATIENT_TASK_ROWS) -> DataFrame:
    """Per (patient name, patient id): total, mean, visit count, the first
    3 distinct clinics and first 2 distinct doctors in row order, and the main
    payer (mode, else 'Tidak Diketahui').

    Runs when called. The needed columns of the rows are written to the shared
    folder once and read twice: for the totals and payers, summed up in the
    tasks before their shuffle, and for both first-k lists, with one shuffle by
    patient into partitions of about ``task_rows`` rows. Patients with more than
    ``hot_rows`` rows take ``patient_grain`` and first-k steps that are limited
    before each shuffle. The result is a table of a row per patient, the one
    mart that grows with the data; sorting by total is left to the consumer
    (``export``), which reads that table.
    """
    keys = [cols.patient, cols.patient_id]
    order = list(order_by or cols.row_order(df.columns))
    needed = dict.fromkeys([*keys, cols.clinic, cols.doctor, cols.payer, cols.cost, *order])
    rows = materialise(_nonnull(df, *keys).select(*needed), "patient-rows")
    totals = materialise(_patient_totals(rows, keys, cols), "patient-totals")
    n_rows, n_hot = totals.agg(F.sum("_rows"), F.count_if(F.col("_rows") > hot_rows)).first()
    tasks = -(-(n_rows or 0) // task_rows)
    if n_hot:
        # At most n_rows / hot_rows patients, so small beside the rows.
        hot = F.broadcast(totals.where(F.col("_rows") > hot_rows).select(*keys))
        lists = (_first_lists(rows.join(hot, keys, "left_anti"), keys, cols, order, tasks)
                 .unionByName(_hot_lists(rows.join(hot, keys, "left_semi"), keys, cols, order)))
    else:
        lists = _first_lists(rows, keys, cols, order, tasks)
    return materialise(
        totals.join(lists, keys, "left")
        .select(*keys, "total_cost", "mean_cost", "n_visits",
                F.coalesce("clinics", F.lit("")).alias("clinics"),
                F.coalesce("doctors", F.lit("")).alias("doctors"),
                F.coalesce("main_payer", F.lit(UNKNOWN)).alias("main_payer")), "patient-summary")


def payer_grain(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """Rows per (payer, clinic), (payer, doctor) and (payer, patient) in one pass.

    Grouping sets: each set has few keys, so a task sums a hot payer up before
    the one shuffle. ``_part`` names the set of a row.
    """
    key = cols.payer
    sets = [[key, cols.clinic], [key, cols.doctor], [key, cols.patient_id]]
    clinic_set, doctor_set = 0b011, 0b101     # bits of the columns left out, in order
    return (_nonnull(df, key).groupingSets(sets, key, cols.clinic, cols.doctor, cols.patient_id)
            .agg(F.grouping_id().alias("_set"),
                 F.sum(cols.cost).alias("_sum"), F.count(cols.cost).alias("_cnt"),
                 F.min(cols.cost).alias("_min"), F.max(cols.cost).alias("_max"),
                 F.count(F.lit(1)).alias("_rows"))
            .withColumn("_part", F.when(F.col("_set") == clinic_set, "clinic")
                        .when(F.col("_set") == doctor_set, "doctor").otherwise("patient"))
            .drop("_set"))


def payer_summary(df: DataFrame, cols: Columns = DEFAULT_COLUMNS) -> DataFrame:
    """Per payer: total, mean, min, max, count, distinct patients, and the
    3 most frequent clinics and doctors. Sorted by total, descending.

    ``payer_grain`` is written to the shared folder when this function is
    called (one scan and one shuffle of the rows); the three parts read it.
    """
    key = cols.payer
    grain = materialise(payer_grain(df, cols), "payer-grain")
    part = lambda name: grain.where(F.col("_part") == name)
    stats = part("patient").groupBy(key).agg(
        money(F.sum("_sum")).alias("total_cost"),
        F.try_divide(F.sum("_sum").cast("double"), F.sum("_cnt")).alias("mean_cost"),
        money(F.min("_min")).alias("min_cost"),
        money(F.max("_max")).alias("max_cost"),
        F.sum("_cnt").alias("n_rows"),
        F.count(cols.patient_id).alias("n_patients"),   # one row per patient
    )
    clinics = top_k_values(part("clinic"), [key], cols.clinic, TOP_PER_PAYER, "top_clinics",
                           count_col="_rows")
    doctors = top_k_values(part("doctor"), [key], cols.doctor, TOP_PER_PAYER, "top_doctors",
                           count_col="_rows")
    return (stats.join(clinics, key, "left").join(doctors, key, "left")
            .select(key, "total_cost", "mean_cost", "min_cost", "max_cost", "n_rows", "n_patients",
                    F.coalesce("top_clinics", F.lit("")).alias("top_clinics"),
                    F.coalesce("top_doctors", F.lit("")).alias("top_doctors"))
            .orderBy(F.desc("total_cost"), F.col(key)))
