"""What the operators of this subpackage share: the word pattern, order hashes, row ids and shared tables."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.catalog import table
from episodica.plans.lineage import cut, fresh_dir

__all__ = ["WORD", "cut", "fresh_dir", "table", "text_of", "words", "n_words", "order_hash", "fresh_name", "documents", "struct_array"]

# A word: anything between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_of(col: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def order_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 over id and text as a long: a repeatable shuffle that any SQL engine can restate."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


# The same hash in DuckDB's SQL.
ORDER_HASH_SQL = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT)"


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def struct_array(rows: list[tuple], kind: pa.StructType) -> pa.StructArray:
    """Rows of plain values as an Arrow struct column."""
    columns = list(zip(*rows)) or [()] * len(kind)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
