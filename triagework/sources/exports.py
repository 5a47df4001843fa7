"""Writing ticket tables, feature tables and label tables."""

from pyspark.sql import DataFrame

CSV_WRITE_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str) -> str:
    """CSV folder with a header, one file per task and no index column."""
    df.write.mode("overwrite").options(**CSV_WRITE_OPTIONS).csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path
