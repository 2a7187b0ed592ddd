"""Column helpers and shared-folder handling used by several operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The six white-space characters that separate words (space, and U+0009 to U+000D).
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    It is set here (to a temporary folder) only where the session names none and is a local one, as in tests.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that the executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cellreach-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable stands for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def folded(text: Column) -> Column:
    """A string that two texts share if and only if they are equal but for the case of A-Z.

    Each UTF-8 byte is read as one character and lower-cased, which is many times as fast as `translate`. The lead bytes C0 to
    DE become E0 to FE with it, which no other character can have: those are followed by more bytes. ASCII texts are the same as their bytes.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.lower(F.decode(text.cast("binary"), "ISO-8859-1")))


def folded_words(line: Column) -> Column:
    """The words (maximal runs of characters other than SPACES) of a line, folded."""
    plain = F.split(folded(line), " ")
    odd = F.split(F.translate(folded(line), SPACES[1:], " " * (len(SPACES) - 1)), " ")
    has_odd = F.contains(line, F.lit(SPACES[1]))
    for c in SPACES[3:]:
        has_odd = has_odd | F.contains(line, F.lit(c))
    return F.array_remove(F.when(has_odd, odd).otherwise(plain), "")


def space_words(text: Column) -> Column:
    """Array of the maximal runs of characters other than SPACES; empty for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def row_struct(df: DataFrame) -> Column:
    """All columns of df as one struct, so that names of our own cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpack(df: DataFrame, struct: str, names: list[str], **replaced: Column) -> DataFrame:
    """Back to the columns packed by row_struct; those in `replaced` take the given values."""
    return df.select(*[replaced.get(c, F.col(f"{struct}.`{c}`")).alias(c) for c in names])


class RowKey:
    """(doc, th): what tells the rows of docs apart and orders them, alike in any order of the input.

    doc is the id, the largest long for a null one. th is 0; if any id repeats (nulls included), a hash of id and text, so that
    rows of one id and different texts are different documents and rows equal in both are one.
    """

    def __init__(self, docs: DataFrame, id_col: str):
        ids = docs.select(self._doc(F.col(f"`{id_col}`")).alias("doc"))
        self.repeats = bool(ids.groupBy("doc").agg(F.count(F.lit(1)).alias("times")).where("times > 1").head(1))

    @staticmethod
    def _doc(key: Column) -> Column:
        return F.coalesce(key.cast("long"), F.lit(2**63 - 1))

    def columns(self, key: Column, text: Column) -> list[Column]:
        th = F.xxhash64(key.cast("long"), text) if self.repeats else F.lit(0).cast("long")
        return [self._doc(key).alias("doc"), th.alias("th")]

    def once(self, rows: DataFrame) -> DataFrame:
        """rows (doc, th, ...) with rows of equal key once; shuffled only if ids repeat."""
        return rows.dropDuplicates(["doc", "th"]) if self.repeats else rows


def equal_texts(texts: DataFrame) -> DataFrame:
    """(doc, th, size, o_doc, o_th) of every one of texts (doc, th, text) that equals an earlier one, which is o_doc, o_th; size in bytes."""
    named = texts.select("doc", "th", F.md5(F.col("text").cast("binary")).alias("m"), F.octet_length("text").alias("size"))
    firsts = named.groupBy("m").agg(F.min(F.struct("doc", "th")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    later = named.join(firsts, "m").where(F.struct("doc", "th") != F.col("first"))
    return later.select("doc", "th", "size", F.col("first.doc").alias("o_doc"), F.col("first.th").alias("o_th")).distinct()


#: A key list of at most so many rows (some 16 MB) is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def is_small(df: DataFrame) -> bool:
    """Whether a count proves df (a table already written, of a few narrow columns) short enough to broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small_side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe from lost executors.

    The shuffle files of the job are of no more use then; Spark drops them once the driver's garbage collector has
    seen that, which is asked for here rather than at the next half-hourly call.
    """
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def released(*tables: DataFrame) -> None:
    """Delete tables made by `written` that nothing will read again."""
    for table in tables:
        removed(table.sparkSession, table.written_to)
