"""Department queues: a Parquet table partitioned by department, appended to by batches and read whole.

Every stream that routes tickets has a table of its own below it. So have batches that come with a name: each is written
whole under an attempt of its own and then committed by one new file, whose name is the batch's. Only one attempt can
commit a batch, and readers see committed attempts only, so a batch that is run twice, or broken off and run again, is
there once. Reading unites all three.
"""

import hashlib
import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagework.domain import QUEUE_COLUMNS, QUEUE_OF
from triagework.session import broadcast_if_small
from triagework.sources.tickets import child_paths, path_exists

QUEUE_SCHEMA = (
    "Ticket_ID string, Ticket_Subject string, Ticket_Description string, Issue_Category string, Priority string, "
    "Expected_Resolution string, Ticket_Channel string, Routed_Department string, Routed_At timestamp, "
    "ticket_md5 string, department_key string"
)


COLUMNS = [*QUEUE_COLUMNS, "ticket_md5", "department_key"]

#: Folders below the queues; readers of the plain table pass over names that begin with an underscore.
STREAMS = "_streams"
BATCHES = "_batches"
COMMITS = "_commits"


def append_to_queues(routed: DataFrame, path: str, batch: str | None = None) -> str:
    """Append routed tickets; each task writes its own files, so a hot department needs no shuffle.

    A ``batch`` that is there already is not written again. Without a name appending twice is there twice.
    """
    if batch is None:
        routed.select(COLUMNS).write.mode("append").partitionBy("department_key").parquet(path)
        return path
    spark, name = routed.sparkSession, batch_name(batch)
    if not path_exists(spark, f"{path}/{COMMITS}/{name}"):
        attempt = write_attempt(routed, path, name)
        commit(spark, path, name, attempt, [])
    return path


def batch_name(batch: str) -> str:
    return f"b{hashlib.md5(batch.encode()).hexdigest()}"


def new_attempt(path: str, name: str) -> tuple[str, str]:
    """Name and folder of a new attempt to write a batch."""
    attempt = uuid.uuid4().hex
    return attempt, f"{path}/{BATCHES}/batch={name}/attempt={attempt}"


def write_attempt(routed: DataFrame, path: str, name: str) -> str:
    attempt, folder = new_attempt(path, name)
    routed.select(COLUMNS).write.partitionBy("department_key").parquet(folder)
    return attempt


def commit(spark: SparkSession, path: str, name: str, attempt: str, replaces: list[str]) -> bool:
    """Commit an attempt unless the batch is committed; whether this call did it.

    The file is written aside and renamed, which fails where the name is taken. It lists the batches whose rows it holds
    in their place.
    """
    jvm = spark.sparkContext._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    told, goal = place(f"{path}/{COMMITS}/_{attempt}"), place(f"{path}/{COMMITS}/{name}")
    files = goal.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = files.create(told, False)
    out.write(bytearray(json.dumps({"batch": name, "attempt": attempt, "replaces": replaces}).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), files.getConf())
    fails_if_taken = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(told), files.makeQualified(goal), fails_if_taken)
    except Py4JJavaError as error:
        files.delete(told, False)
        if not files.exists(goal):
            raise error
        return False
    return True


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``batch`` and ``attempt`` of the committed batches that no later one replaces."""
    schema = "batch string, attempt string, replaces array<string>"
    if not path_exists(spark, f"{path}/{COMMITS}"):
        return spark.createDataFrame([], schema).drop("replaces")
    told = spark.read.schema(schema).json(f"{path}/{COMMITS}")
    gone = told.select(F.explode("replaces").alias("batch"))
    return told.join(gone, "batch", "left_anti").select("batch", "attempt")


def committed(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame | None:
    """Tickets of all committed batches, with ``batch`` and ``attempt``; None if there is no such table."""
    if not path_exists(spark, f"{path}/{BATCHES}"):
        return None
    schema = f"{QUEUE_SCHEMA}, batch string, attempt string"
    table = spark.read.schema(schema).option("ignoreCorruptFiles", skip_unreadable).parquet(f"{path}/{BATCHES}")
    return table.join(broadcast_if_small(commits(spark, path)), ["batch", "attempt"], "left_semi")


def compact_batches(
    spark: SparkSession, path: str, name: str, rows_per_file: int = 1_000_000, bytes_per_file: int = 256 << 20
) -> list[str]:
    """Rewrite the committed batches as one called ``name``, in few files; the names of those it replaces.

    No task gets many more rows, or bytes of text, than a file is to hold; rows are dealt in turn, whatever their keys.

    Readers see either the old ones or the new one. Replaced batches stay committed, so running one of them again still
    changes nothing.
    """
    replaced = [r["batch"] for r in commits(spark, path).collect()]
    if len(replaced) < 2 or path_exists(spark, f"{path}/{COMMITS}/{batch_name(name)}"):
        return []
    tickets = committed(spark, path)
    texts = [field.name for field in tickets.schema if field.dataType.simpleString() == "string"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(0))
    rows, total = tickets.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    files = max(1, -(-rows // rows_per_file), -(-total // bytes_per_file))
    attempt = write_attempt(tickets.repartition(files), path, batch_name(name))
    return replaced if commit(spark, path, batch_name(name), attempt, replaced) else []


def stream_path(path: str, checkpoint: str) -> str:
    """Table of the stream with this checkpoint among the queues at ``path``."""
    return f"{path}/{STREAMS}/s{hashlib.md5(checkpoint.encode()).hexdigest()}"


def read_queues(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """All queues as one table, from plain appends, named batches and streams; no table yet means no tickets.

    With ``skip_unreadable`` files that cannot be read count as empty instead of failing the job.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], QUEUE_SCHEMA)
    reader = spark.read.schema(QUEUE_SCHEMA).option("ignoreCorruptFiles", skip_unreadable)
    streams = f"{path}/{STREAMS}"
    tables = [path, *(child_paths(spark, streams) if path_exists(spark, streams) else [])]
    named = committed(spark, path, skip_unreadable)
    parts = [reader.parquet(table) for table in tables] + ([] if named is None else [named.drop("batch", "attempt")])
    return reduce(DataFrame.unionByName, parts)


def department_dimension(spark: SparkSession) -> DataFrame:
    """The five departments and their queue keys."""
    rows = ", ".join(f"('{department}', '{key}')" for department, key in QUEUE_OF.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(department, queue_key)")


def scan_queues(spark: SparkSession, path: str) -> DataFrame:
    """Every department with its tickets; a department without tickets keeps one row of nulls.

    The empty departments are found from the partition keys that occur, so the tickets themselves are not joined.
    """
    queued = read_queues(spark, path).withColumnRenamed("department_key", "queue_key")
    departments = department_dimension(spark)
    occupied = queued.select("queue_key").distinct()
    empty = departments.join(occupied, "queue_key", "left_anti")
    labelled = F.create_map(*[F.lit(x) for d, k in QUEUE_OF.items() for x in (k, d)])
    return queued.withColumn("department", labelled[F.col("queue_key")]).unionByName(empty, allowMissingColumns=True)
