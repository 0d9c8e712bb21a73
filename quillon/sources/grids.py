"""Images from the rows of a table: each entry of a vector is a block of equal pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grids(rows: DataFrame, key: str, vector: str, side: int = 8, zoom: int = 8, middle: float = 0.5, gain: float = 1.5) -> DataFrame:
    """(case_id, h, w, pixels) of every row whose vector has side * side numbers: side x side blocks of zoom x zoom pixels, row by row.

    An entry e has the intensity middle + gain * e, cut to 0 and 1. Rows with a null key, a vector of another length, or one that
    holds null or nan have no image; repeated rows have one each. Built-in functions alone.
    """
    n = side * zoom
    whole = (F.size(vector) == side * side) & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e)) & F.col(key).isNotNull()
    levels = F.transform(vector, lambda e: F.least(F.greatest(F.lit(middle) + F.lit(gain) * e.cast("double"), F.lit(0.0)), F.lit(1.0)).cast("float"))
    lines = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda y: F.array_repeat(F.flatten(F.transform(F.slice("_levels", y * side + 1, side), lambda e: F.array_repeat(e, zoom))), zoom)))
    out = rows.where(F.coalesce(whole, F.lit(False))).select(F.col(key).alias("case_id"), levels.alias("_levels"))
    return out.select("case_id", F.lit(n).alias("h"), F.lit(n).alias("w"), F.flatten(lines).alias("pixels"))
