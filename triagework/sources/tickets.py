"""Ticket files: finding, reading and checking them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagework.domain import HISTORY_SCHEMA, NULL_TOKENS, SERVING_DEFAULTS
from triagework.functions.dates import parse_submission
from triagework.functions.text import is_blank
from triagework.sources.csv_records import read_quoted_csv

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def child_paths(spark: SparkSession, path: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return sorted(status.getPath().toString() for status in found)


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    return next((path for path in candidates if path_exists(spark, path)), None)


def history_path(spark: SparkSession, root: str, file_name: str = "customer_support_tickets.csv") -> str:
    """The ticket history below ``root``: ``data/raw/`` first, then ``data/``."""
    found = first_existing(spark, [f"{root}/data/raw/{file_name}", f"{root}/data/{file_name}"])
    if found is None:
        raise FileNotFoundError(f"{file_name} was not found below {root}/data")
    return found


def read_ticket_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = HISTORY_SCHEMA,
    line_breaks: bool = False,
    parallel: bool = True,
    **options,
) -> DataFrame:
    """Tickets of a CSV file or folder, with the types of ``schema``; unknown columns stay text.

    Null tokens and values that do not fit the type become null. ``line_breaks`` allows line breaks inside quoted cells;
    files are then read twice, unless ``parallel`` is off or there are ``options``: then a file is one split.
    """
    if line_breaks and parallel and not options:
        raw = read_quoted_csv(spark, path)
    else:
        raw = spark.read.options(**{**CSV_OPTIONS, "multiLine": line_breaks, **options}).csv(path)
    types = {field.name: field.dataType for field in schema}
    return raw.select([_typed(F.col(f"`{name}`"), types.get(name, T.StringType())).alias(name) for name in raw.columns])


def _typed(cell: Column, data_type: T.DataType) -> Column:
    value = F.when(~cell.isin(NULL_TOKENS), cell)
    if isinstance(data_type, T.StringType):
        return value
    if isinstance(data_type, T.TimestampType):
        return parse_submission(value)
    return value.try_cast(data_type)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def complete_batch(df: DataFrame) -> DataFrame:
    """Add the optional columns a batch came without; the description must be there."""
    require_columns(df, ["Ticket_Description"])
    absent = {name: F.lit(value) for name, value in SERVING_DEFAULTS.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


def fill_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Replace nulls in the named columns."""
    return df.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def flag_blank(df: DataFrame, column: str = "Ticket_Description") -> DataFrame:
    return df.withColumn("is_blank", is_blank(F.col(column)))


def split_blank(df: DataFrame, column: str = "Ticket_Description") -> tuple[DataFrame, DataFrame]:
    """Accepted tickets, and the rejects whose text is null or only white space."""
    flagged = flag_blank(df, column)
    return flagged.where(~F.col("is_blank")).drop("is_blank"), flagged.where("is_blank").drop("is_blank")


def select_available(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that exist, in the order given."""
    return df.select([name for name in names if name in df.columns])


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)
