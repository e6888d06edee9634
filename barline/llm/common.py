"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words: space and the five controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACES_PATTERN = r"[\x20\x09-\x0D]+"
#: A key with more rows than these is heavy, if it also has more than a MOST_HEAVY-th of all rows.
HEAVY_ROWS, MOST_HEAVY = 100_000, 1000
#: The same for the last join of a result, whose rows are all documents.
HEAVY_DOCUMENTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(name: str) -> str:
    """A column's name as F.col() takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def text_of(column: str = "text") -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than SPACES; [] for a blank text."""
    for space in SPACES[1:]:  # replace() works on bytes, and split() has a quick way for one plain character
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    A local session that names none gets a temporary folder; a cluster without one is an error, since its
    machines share no folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="barline-checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written as Parquet and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner", heavy_rows: int | None = None) -> DataFrame:
    """rows (total in all) joined to table by key, however many rows one key has.

    table has one row a key, and n, how many of rows have it (n isn't in the result). A key of more than heavy_rows rows (HEAVY_ROWS)
    that is also more than a MOST_HEAVY-th of all rows meets them by broadcast, so at most MOST_HEAVY rows of table are broadcast;
    the others meet theirs by a shuffle. Both are read more than once where there are as many rows, so they had better be durable.
    """
    heavy_rows = HEAVY_ROWS if heavy_rows is None else heavy_rows
    is_heavy = F.col("n") > max(heavy_rows, total // MOST_HEAVY)
    heavy = table.where(is_heavy).drop("n")
    if total <= heavy_rows or heavy.isEmpty():
        return rows.join(table.drop("n"), key, how)
    heavy = F.broadcast(heavy)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(table.where(~is_heavy).drop("n"), key, how))
