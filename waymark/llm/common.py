"""Helpers shared by the training-data operators.

White space and words are ASCII here: a word is a maximal run of characters
other than space and U+0009..U+000D, on every engine alike.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only where a session has none (local tests) is a temporary one set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="waymark-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_written: list[str] = []


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/waymark-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_so_far() -> int:
    """How many tables this process has written and not removed."""
    return len(_written)


def remove_written(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes tables that this process has written to the shared folder, from a count of written_so_far() on, but for the last few; call it when no result is read from them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _written[since : len(_written) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        _written.remove(name)
    return len(gone)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, f"__wm_{name}"
    while out in taken:
        out += "_"
    return out


def text_of(name: str) -> Column:
    """The column as text, null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words of a non-null text."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]++"))).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)
