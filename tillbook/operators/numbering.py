"""Document numbers and surrogate ids (W-5, W-6, H-19, M-11).

Numbers follow an explicit order; the per-group position is the skew-safe
prefix count, so one busy year (or one huge batch) still spreads over many
tasks.  No global ``row_number()`` over an unpartitioned window is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions import rules as R
from tillbook.operators.windows import dense_ids, row_number_in_group

# W-5
def assign_doc_numbers(rows: DataFrame, existing: DataFrame | None, year_col: str,
                       order: list[str], out: str = "invoice_no") -> DataFrame:
    """``YYYY`` + serial per year, at least five digits, continuing after the
    highest existing serial of that year (else from 1).

    ``existing`` has one string column ``invoice_no``.  The serial is
    everything after the year and compared as a number, so a year may have
    any number of documents; numbers whose rest is not a number are ignored.
    """
    pos = row_number_in_group(rows, [year_col], order, "_pos")
    year_txt = F.col(year_col).cast("string")
    if existing is not None:
        # per year: the highest serial of the numbers LIKE 'YYYY%' (B-12)
        no = F.col("invoice_no").cast("string")
        prior = (existing.groupBy(F.substring(no, 1, 4).alias("_y"))
                 .agg(F.max(R.doc_serial(no)).alias("_last")))
        pos = pos.join(prior, year_txt == F.col("_y"), "left").drop("_y")
        serial = F.coalesce(F.col("_last"), F.lit(0)) + F.col("_pos")
    else:
        serial = F.col("_pos")
    return pos.withColumn(out, R.doc_number(F.col(year_col), serial)).drop("_pos", "_last")


# W-6
def assign_ids(rows: DataFrame, order: list[str], start: int = 1, out: str = "id") -> DataFrame:
    """Dense surrogate ids ``start..start+n-1`` in ``order`` (SERIAL/IDENTITY)."""
    return dense_ids(rows, order, out, start)


def next_id_start(table: DataFrame, col: str, floor: int = 1) -> int:
    """First free id after the table's maximum (a one-value aggregate)."""
    top = table.agg(F.max(col)).first()[0]
    return max(floor, (top or 0) + 1)
