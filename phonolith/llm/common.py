"""What the training-data operators share: shared-folder tables, word rules, names.

Nothing here keeps state outside the session: tables that cut lineage are
written below ``spark.checkpoint.dir``, which every executor sees.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Suffix of the columns that operators add to a caller's rows for a while; an
#: input column that ends with it is refused.
MARK = "__phonolith"


def mark(name: str) -> str:
    return name + MARK


def checked(df: DataFrame) -> DataFrame:
    """df, whose columns must not end with the operators' suffix."""
    if clash := [c for c in df.columns if c.lower().endswith(MARK)]:
        raise ValueError(f"columns {clash} end with {MARK}, which is reserved for the operators' own")
    return df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A local session without one gets its own; a cluster's is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set: on {master} the operators need a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='phonolith-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, removed when the session ends if nobody did before."""
    path = f"{shared_dir(spark)}/phonolith/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_folder, spark, path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended; the cluster clears its folder
        return


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    The result has no lineage: a lost executor costs a re-read, not the work
    before it.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_path = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; what was derived from them must have been written."""
    for table in tables:
        remove_folder(table.sparkSession, table.staged_path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def without(items: Column, cut: Column) -> Column:
    """The array without the places in cut (from 0, sorted, each once).

    Between two of them lies a run of kept items; runs are cut out whole, so the
    work is linear.
    """
    ends = F.concat(cut, F.array(F.size(items)))
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda i: i + 1))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(items, a + 1, F.greatest(b - a, F.lit(0)))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def sql_crc_mod(id_col: str, n: int) -> str:
    """crc_mod as DuckDB SQL, for ids without null; the query must have SQL_CRC_TABLE among its tables."""
    codes = f"list_transform(string_split(CAST({id_col} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    crc = f"list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, crc_t[(xor(c, b) & 255) + 1]))"
    return f"xor({crc}, 4294967295) % {n}"


#: The 256 remainders of the checksum's polynomial, one row.
SQL_CRC_TABLE = """(
  SELECT list(c ORDER BY i) AS crc_t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
)"""
