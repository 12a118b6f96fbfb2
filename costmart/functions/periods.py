"""A table function for SQL: one row with a span of days into a row per calendar month."""

from __future__ import annotations

from pyspark.sql import SparkSession

PERIOD_TYPE = "id long, line int, period string, days int, running_days long"
#: With ``opens``: whether the row is the first of its id in that month.
OPENING_TYPE = f"{PERIOD_TYPE}, opens boolean"


class PeriodRows:
    """Rows (id, line, first_day, last_day) -> one row per month the span touches.

    ``days`` are the span's days in that month, ``running_days`` the days of the
    id's spans up to and with this line: the call deals the rows by id (or by
    buckets of ids) with ``PARTITION BY`` and sorts them by id and line with
    ``ORDER BY``. Only the last id and its sum are kept between batches, so an
    id with very many lines passes in batches. Rows without a day, or that end
    before they begin, give none; a null id is an id like any other.
    """

    def __init__(self):
        self.last, self.total = None, 0

    def eval(self, batch):
        yield self.periods(batch)[0]

    def periods(self, batch):
        """The batch's table of months, and per row of it the span's row and the month's number."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = batch if isinstance(batch, pa.RecordBatch) else pa.RecordBatch.from_struct_array(batch)
        rows = rows.filter(pc.fill_null(pc.less_equal(rows["first_day"], rows["last_day"]), False))
        first, last = (rows[c].cast(pa.int32()).to_numpy(zero_copy_only=False).astype("datetime64[D]")
                       for c in ("first_day", "last_day"))
        month = first.astype("datetime64[M]").astype(int)
        n = last.astype("datetime64[M]").astype(int) - month + 1
        at = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        number = month[at] + nth
        begin = number.astype("datetime64[M]")
        end = (begin + 1).astype("datetime64[D]") - 1
        days = (np.minimum(end, last[at]) - np.maximum(begin.astype("datetime64[D]"), first[at])
                ).astype(int) + 1
        ids = rows["id"].cast(pa.int64()).fill_null(np.iinfo("int64").min).to_numpy()
        span = (last - first).astype(int) + 1
        running = np.cumsum(span)
        if len(ids):
            # Of each row, what had been summed when its id began in this batch.
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            before = (running - span)[starts]
            if ids[0] == self.last:
                before[0] -= self.total
            running = running - np.repeat(before, np.diff(np.r_[starts, len(ids)]))
            self.last, self.total = ids[-1], int(running[-1])
        # Each month is spelled once.
        months, spelled = np.unique(number, return_inverse=True)
        names = np.datetime_as_string(months.astype("datetime64[M]"), unit="M").astype(object)
        found = pa.table({"id": rows["id"].take(pa.array(at)).cast(pa.int64()),
                          "line": rows["line"].take(pa.array(at)).cast(pa.int32()),
                          "period": pa.array(names, pa.string()).take(pa.array(spelled)),
                          "days": pa.array(days, pa.int32()),
                          "running_days": pa.array(running[at], pa.int64())})
        return found, ids, at, number


class OpeningPeriodRows(PeriodRows):
    """``PeriodRows`` with ``opens``: whether the row is the first of its id in that month.

    An id's rows come together, so the rows that open are the distinct ids of a
    month and need no distinct count. Only the months of the last id are kept
    between batches.
    """

    def __init__(self):
        super().__init__()
        self.months = None

    def eval(self, batch):
        import numpy as np
        import pyarrow as pa

        last = self.last
        found, ids, at, number = self.periods(batch)
        opens = np.zeros(len(at), bool)
        if len(ids):
            run = np.cumsum(np.r_[False, ids[1:] != ids[:-1]])[at]
            low = number.min()
            opens[np.unique(run * (number.max() - low + 1) + number - low, return_index=True)[1]] = True
            known = self.months if last is not None and ids[0] == last else number[:0]
            opens[(run == 0) & np.isin(number, known)] = False
            ending = np.unique(number[run == run[-1]])
            self.months = ending if run[-1] else np.union1d(known, ending)
        yield found.append_column("opens", pa.array(opens))


def register_period_rows(spark: SparkSession, name: str = "period_rows", opens: bool = False) -> None:
    """Make the function known to the session's SQL as ``name(TABLE(...))``; ``opens`` adds that
    column."""
    from pyspark.sql.functions import arrow_udtf
    made = (arrow_udtf(OpeningPeriodRows, returnType=OPENING_TYPE) if opens
            else arrow_udtf(PeriodRows, returnType=PERIOD_TYPE))
    spark.udtf.register(name, made)
