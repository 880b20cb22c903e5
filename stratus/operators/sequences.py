"""Sliding sequence windows per series.

A sequence of length L ends at each row with position rn >= L and holds the
L scaled feature rows up to it (``collect_list`` over a bounded row frame:
memory per row is L x 11 doubles, independent of data volume).  Sequences are
assigned by their end row: train if L <= rn <= split_at, test if rn > split_at,
so test sequences borrow the last L-1 training rows and no training sequence
reaches into the test range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.operators.features import seasonal_columns, series_window
from stratus.schemas import DEFAULT_SEQ_LEN, SEQUENCE_FEATURES
from stratus.sources.payload import last_rows


def scaled_names(cols: list[str] | None = None, suffix: str = "_s") -> list[str]:
    return [f"{c}{suffix}" for c in (cols or SEQUENCE_FEATURES)]


def with_sequences(scaled: DataFrame, seq_len: int = DEFAULT_SEQ_LEN,
                   cols: list[str] | None = None) -> DataFrame:
    """Add ``seq`` (array<array<double>>) and ``seq_split``; keep complete windows only.

    Expects ``rn`` and ``split_at`` from :func:`stratus.operators.split.with_split`.
    """
    cols = cols or scaled_names()
    frame = series_window().rowsBetween(-(seq_len - 1), 0)
    out = scaled.withColumn("seq", F.collect_list(F.array(*[F.col(c) for c in cols])).over(frame))
    out = out.where(F.col("rn") >= seq_len)
    return out.withColumn("seq_split",
                          F.when(F.col("rn") <= F.col("split_at"), "train").otherwise("test"))


def sequence_rejects(split_df: DataFrame, seq_len: int = DEFAULT_SEQ_LEN) -> DataFrame:
    """Places that get no sequence: shorter than ``seq_len`` or without a training row (Q7)."""
    # n and split_at are per-place constants of the split; one aggregate, combined before the shuffle.
    sizes = split_df.groupBy("location_id").agg(F.max("n").alias("rows"), F.max("split_at").alias("split_at"))
    reason = (F.when(F.col("split_at") < 1, "no training row")
              .when(F.col("rows") < seq_len, "fewer complete rows than the sequence length"))
    return sizes.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("location_id", "rows", "reason")


def flat_features(seq_col: str = "seq"):
    """L x 11 window -> one flat array (for array_to_vector)."""
    return F.flatten(F.col(seq_col))


def latest_sequence(rows: DataFrame, as_of: str, seq_len: int = DEFAULT_SEQ_LEN,
                    cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Last L complete rows up to ``as_of`` per location.

    Returns (sequences, rejects).  Each sequence row holds ``seq`` sorted by
    date; locations with fewer than L complete rows go to rejects.
    """
    cols = cols or SEQUENCE_FEATURES
    prepared = (rows.where(F.col("date") <= F.lit(as_of).cast("date"))
                .withColumns(seasonal_columns()).na.drop("any", subset=cols))
    tail = last_rows(prepared, seq_len)
    grouped = (tail.groupBy("location_id")
               .agg(F.array_sort(F.collect_list(F.struct("date", *cols))).alias("_rows"),
                    F.count(F.lit(1)).alias("seq_rows")))
    ok = grouped.where(F.col("seq_rows") == seq_len).select(
        "location_id", "seq_rows",
        F.col("_rows")[0]["date"].alias("seq_start"),
        F.col("_rows")[seq_len - 1]["date"].alias("seq_end"),
        F.transform("_rows", lambda r: F.array(*[r[c] for c in cols])).alias("seq"))
    rejected = grouped.where(F.col("seq_rows") < seq_len).select(
        "location_id", "seq_rows", F.lit("fewer complete rows than the sequence length").alias("reason"))
    return ok, rejected
