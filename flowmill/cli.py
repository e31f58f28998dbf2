"""Reports and cleaning of a CSV folder or Parquet table from the command line: ``python -m flowmill.cli TASK INPUT``.

The rows read and written are observed while the task runs, without a pass of their own.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from flowmill.operators import cleaning, correlation, dedup, profile, sampling
from flowmill.operators.schema import drop_columns, find_label, normalize_columns, numeric_columns
from flowmill.session import session
from flowmill.sources.readers import nan_to_null, read_csv_text, row_counts
from flowmill.sources.sinks import report_text, run_folder, write_by_class


def load(spark, path: str) -> DataFrame:
    """A Parquet table, or all CSV files of a folder as text; names normalised."""
    return normalize_columns(nan_to_null(spark.read.parquet(path)) if path.rstrip("/").endswith(".parquet") else read_csv_text(spark, path))


REPORTS = {
    "rows": lambda df, a: row_counts(df),
    "labels": lambda df, a: profile.label_distribution(df, find_label(df, a.label), with_null=True),
    "missing": lambda df, a: profile.missing_profile(df),
    "infinite": lambda df, a: profile.inf_profile(df, coerce=True),
    "types": lambda df, a: profile.type_profile(df),
    "variance": lambda df, a: profile.low_variance(df),
    "dominance": lambda df, a: profile.dominance(df, df.columns),
    "describe": lambda df, a: profile.describe(df, a.columns or numeric_columns(df)),
    "duplicates": lambda df, a: dedup.duplicate_counts(df),
    "validity": lambda df, a: cleaning.validity_counts(df, cleaning.invalid_row(df)),
    "correlation": lambda df, a: correlation.correlations(df, a.columns or numeric_columns(df)),
}

CLEANERS = {
    "dedup": lambda df, a: dedup.distinct_rows(df),
    "drop-invalid": lambda df, a: cleaning.drop_invalid(df),
    "drop-text": lambda df, a: cleaning.drop_text_rows(df, a.columns or [c for c in df.columns if c != a.label]),
    "drop-missing": lambda df, a: cleaning.missing_split(df)[0],
    "drop-columns": lambda df, a: drop_columns(df, a.columns),
    "inf-to-median": lambda df, a: cleaning.inf_to_median(df, a.columns or numeric_columns(df)),
    "inf-to-zero": lambda df, a: cleaning.inf_and_null_to_zero(df, a.columns or numeric_columns(df)),
    "split": lambda df, a: sampling.stratified_split(df.withColumn("row_key", dedup.row_key(df)), find_label(df, a.label), a.ratio, ["row_key"]).drop("row_key"),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("task", choices=[*REPORTS, *CLEANERS, "by-class"])
    parser.add_argument("input")
    parser.add_argument("--output", help="folder for the result; a run gets a folder of its own in it")
    parser.add_argument("--columns", nargs="*", default=[])
    parser.add_argument("--label", default="label")
    parser.add_argument("--ratio", type=float, default=0.6)
    args = parser.parse_args(argv)
    spark = session()
    totals = Observation("input")
    df = load(spark, args.input).observe(totals, F.count("*").alias("rows_read"))
    if args.task in REPORTS:
        report = REPORTS[args.task](df, args)
        print(report_text(report, args.task))
        print(f"rows read: {totals.get['rows_read']}")
        if args.output:
            report.write.parquet(run_folder(args.output))
        return 0
    if not args.output:
        parser.error("this task needs --output")
    folder = run_folder(args.output)
    if args.task == "by-class":
        from flowmill.functions.expr import is_label

        write_by_class(df, folder, is_label(df[find_label(df, args.label)], "benign"), name="is_benign")
        print(f"rows read: {totals.get['rows_read']}")
    else:
        written = Observation("output")
        CLEANERS[args.task](df, args).observe(written, F.count("*").alias("rows_written")).write.parquet(folder)
        print(f"rows read: {totals.get['rows_read']}, written: {written.get['rows_written']}")
    print(folder)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
