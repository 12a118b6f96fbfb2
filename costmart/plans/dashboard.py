"""The dashboard as one plan: a filtered frame persisted once, all marts from it.

Entry 1 (numbers and charts), entry 2 (summary tables and exports) and entry 3
(prediction) of the source application read the same filtered rows. Here that
frame is narrowed to the columns the marts use and persisted
(MEMORY_AND_DISK: blocks lost with an executor are recomputed from lineage);
each mart is then a short aggregate over it.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from costmart.operators import marts, predict
from costmart.operators.encode import encode
from costmart.operators.filters import FilterSpec, apply_filters
from costmart.session import ensure_checkpoint_dir, materialise
from costmart.schema import (
    DEFAULT_COLUMNS,
    ENCODED,
    FEATURES,
    SAMPLE_POINTS,
    TOP_N,
    TOP_PATIENTS,
    Columns,
)


class Dashboard:
    """``materialize``: 'persist' keeps the filtered frame in executor memory
    and disk (a lost block is recomputed from its lineage); 'checkpoint'
    writes it once to the shared checkpoint folder, so an executor loss costs a
    re-read instead of a recomputation of the joins (preferable on large
    clusters, where losses are routine)."""

    def __init__(self, cleaned: DataFrame, spec: FilterSpec, cols: Columns = DEFAULT_COLUMNS,
                 order_by: list[str] | None = None, materialize: str = "persist"):
        self.cols = cols
        self.cleaned = cleaned
        self.spec = spec
        self.order_by = list(order_by or cols.row_order(cleaned.columns))
        used = {cols.patient, cols.patient_id, cols.clinic, cols.doctor, cols.payer, cols.cost,
                cols.month_key, cols.date, *self.order_by}
        keep = [c for c in cleaned.columns if c in used]
        narrowed = apply_filters(cleaned, spec, cols).select(*keep)
        if materialize == "checkpoint":
            ensure_checkpoint_dir(cleaned.sparkSession)
            self.filtered = narrowed.checkpoint()
        elif materialize == "persist":
            self.filtered = narrowed.persist(StorageLevel.MEMORY_AND_DISK)
        else:
            raise ValueError(f"materialize must be 'persist' or 'checkpoint', not {materialize!r}")

    def release(self) -> None:
        self.filtered.unpersist()

    def render(self, consume: Callable[[str, DataFrame], None], parallelism: int = 4) -> None:
        """Run ``consume(name, mart)`` for every mart, ``parallelism`` at a time.

        The marts are independent jobs over the same persisted frame; most are
        a couple of small stages, so submitting several at once keeps the
        executors busy. ``consume`` writes or shows a mart (e.g. to a sink);
        it should not collect a mart that grows with the data.
        """
        items = list(self.marts().items())
        # Materialise the shared frame once before the concurrent jobs read it.
        self.filtered.count()
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            for f in [pool.submit(consume, name, df) for name, df in items]:
                f.result()

    def marts(self) -> dict[str, DataFrame]:
        """Every table of entries 1 and 2. Each runs when consumed, but for the two
        summaries, which write their grain tables here."""
        c, f = self.cols, self.filtered
        return {
            "kpis": marts.kpis(f, c),
            "filter_stats": marts.filter_stats(f, c),
            "top_payer": marts.top_value(f, c.payer),
            "top_clinics": marts.top_n(f, c.clinic, TOP_N),
            "top_doctors": marts.top_n(f, c.doctor, TOP_N),
            "top_payers": marts.top_n(f, c.payer, TOP_N),
            "mean_cost_by_clinic": marts.mean_cost_by_clinic(f, c),
            "mean_cost_by_doctor": marts.mean_cost_by_doctor(f, c),
            "mean_cost_by_payer": marts.mean_cost_by_payer(f, c),
            "top_patients": marts.top_patients(f, TOP_PATIENTS, c),
            "monthly_trend": marts.monthly_trend(f, c),
            "payer_share": marts.bucket_other(f, c.payer),
            "cost_histogram": marts.histogram(f, c.cost),
            "patient_summary": marts.patient_summary(f, c, order_by=self.order_by),
            "payer_summary": marts.payer_summary(f, c),
        }

    def prediction(self, key: str, num_trees: int = 100, max_depth: int = 10,
                   seed: int = 42) -> dict[str, DataFrame]:
        """Entry 3: codes fit on the whole cleaned table (before the filter),
        hash split of the filtered rows, forest, metrics, sample, ideal line."""
        coded = encode(apply_filters(self.cleaned, self.spec, self.cols), ENCODED,
                       fit_on=self.cleaned)
        # Written once to the shared checkpoint folder: the forest passes over
        # its input several times and scoring reads it again.
        table = predict.feature_table(predict.hash_split(coded, key, seed), FEATURES,
                                      keep=[key, "is_train"])
        table = materialise(table, "features")
        predict.require_rows(table)
        model = predict.fit_forest(table.where("is_train"), num_trees=num_trees,
                                   max_depth=max_depth, seed=seed)
        scored = predict.predict(model, table.where("not is_train"), keep=[key])
        sample = predict.sample_pairs(scored, key, SAMPLE_POINTS, seed)
        return {"predictions": scored, "metrics": predict.metrics(scored),
                "sample": sample, "ideal_line": predict.ideal_line(sample)}
