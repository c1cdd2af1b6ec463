"""What the operators of this subpackage share: text rules, intermediate tables, table access."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only separator of words here: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
#: Where intermediate tables go in local sessions that name no shared folder.
LOCAL_SHARED = "/tmp/checkpoints/cairn"


#: Bytes of files a core below which a table is dealt to all cores.
SMALL = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  A small file may be one row group, which one task reads; its rows are dealt to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the identifier's decimal text, modulo a fold count; a null identifier counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session, or a local one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_SHARED


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, and a lost executor costs a
    re-read at most.  Every call has a folder of its own, so that reruns never meet."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what store() wrote, when all that was read from it is in another stored table."""
    spark = df.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def own_names(df: DataFrame, keep: list[str]) -> DataFrame:
    """Only the columns an operator works on, so that extra columns of the input can't clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in keep])


def boxed(docs: DataFrame) -> Column:
    """All columns of a table in one struct, so that none of them can clash with an operator's own; select("row.*")
    gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows(row, keys) that share the keys, the least row by its columns in their order (any one if a column has no
    order, as maps); its columns alone."""
    pick = F.min if orderable(rows.schema["row"].dataType) else F.first
    return rows.groupBy(*keys).agg(pick("row").alias("row")).select("row.*")


def id_key(column: Column) -> Column:
    """An identifier as text, so that null is a value like others; no number is written as an empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))
