"""What the operators of this subpackage share: reading, materialising, word grammar."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

#: Spark's setting that removes a job's shuffle files when the job ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A session of this machine alone may do without; on a cluster the setting is needed.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("spark-warehouse/checkpoints")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/ledgerloom-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        path = self.path()
        writer = df.write.mode("errorifexists")
        # What the job shuffled goes when its result is written; nothing reads it again.
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        # The schema is given, so that an empty table and all-null columns read back alike.
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/{self.count}"

    def keep(self, *numbers: int) -> None:
        """Remove all tables saved so far but these: what is made from them is saved itself."""
        self.drop(*set(range(1, self.count + 1)).difference(numbers))

    def drop(self, *numbers: int) -> None:
        """Remove earlier tables of a loop that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for number in numbers:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{number}")
            path.getFileSystem(conf).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often the body's lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_text(df: DataFrame, name: str) -> Column:
    """A column of ids as the text by which Python tasks carry them: pandas would turn whole numbers
    beside a null into doubles."""
    kind, column = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        return F.base64(column)
    return F.to_json(column) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else column.cast("string")


def id_back(df: DataFrame, name: str, column: Column) -> Column:
    """What id_text() made of the column name of df, turned back."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BinaryType):
        return F.unbase64(column)
    return F.from_json(column, kind) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else column.cast(kind)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binomial_tail(n: int, p: float, least: int) -> float:
    """P(X >= least) for X ~ Binomial(n, p)."""
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))
