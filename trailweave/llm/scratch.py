"""Shared scratch tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts of a batch.
TEXT_ROWS = 1024
#: Endings of columns that are added for a while.
_NAMES = count()


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="trailweave-")
        atexit.register(shutil.rmtree, folder, True)
        _OWN[app] = "file://" + folder
    return _OWN[app]


def own_session(spark: SparkSession, rows: int = TEXT_ROWS) -> SparkSession:
    """A session with the settings of ``spark``, whose texts go to Python workers in batches of ``rows`` rows; ``spark`` stays as it is."""
    session = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    session.conf.set(BATCH_ROWS, rows)
    return session


def in_session(df: DataFrame, session: SparkSession) -> DataFrame:
    """The same rows as a frame of another session."""
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_{next(_NAMES)}"
        out.append(name)
    return out


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all."""
    fs, target = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(text.encode())
    out.close()
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be written")


def names_in(spark: SparkSession, folder: str) -> list[str]:
    fs, target = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``materialise`` returned and that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        delete(df.sparkSession, path)


def split_by_key(docs: DataFrame, keys: list, wanted: DataFrame, bits: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows whose ``keys`` may be in ``wanted`` (columns of the same order), and rows whose keys aren't.

    The test is a bitmap of ``bits`` places, whatever the corpus, so that
    rows that join with nothing need no shuffle.  A null key is in neither's
    way: such rows are in the second.
    """
    slot = F.pmod(F.xxhash64(*wanted.columns), F.lit(bits)).cast("int")
    taken = np.zeros(bits, bool)
    taken[wanted.select(slot.alias("slot")).distinct().toArrow().to_pandas()["slot"].to_numpy(int)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(taken))

    def there(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    test = F.pandas_udf(there, "boolean")
    known = keys[0].isNotNull()
    for key in keys[1:]:
        known = known & key.isNotNull()
    near = F.when(known, test(F.pmod(F.xxhash64(*keys), F.lit(bits)).cast("int"))).otherwise(F.lit(False))
    return docs.where(near), docs.where(~near)
