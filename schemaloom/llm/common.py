"""What the operators share: reading tables, the shared folder, folds and fixed-size id filters."""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: A fixed value: the words of a text lie between these bytes (0x20 and 0x09 to 0x0D).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read back: lineage ends here and is never recomputed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._stored_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Deletes the files of ``stored`` tables that nothing reads any more."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fold_py(doc_id, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def id_told(df: DataFrame, ids: DataFrame, column: str, bits: int = 23) -> DataFrame:
    """``df`` with ``_told``: false if its id is surely not in ``ids``. A bitmap of ``2**bits`` bits is broadcast, 1 MB by default
    whatever the input; of the ids outside some are told in as well, so an exact join has to follow.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    words = (
        ids.select(slot(F.col(column)).alias("_s"))
        .groupBy(F.shiftright("_s", 6).alias("_w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_s & 63 as int))")).alias("_b"))
    )
    return (
        df.withColumn("_slot", slot(F.col(column)))
        .withColumn("_w", F.shiftright("_slot", 6))
        .join(F.broadcast(words), "_w", "left")
        .withColumn("_told", F.expr("coalesce(shiftrightunsigned(_b, cast(_slot & 63 as int)) & 1 = 1, false)"))
        .drop("_slot", "_w", "_b")
    )


def id_filter(df: DataFrame, ids: DataFrame, column: str, bits: int = 23) -> DataFrame:
    """The rows of ``df`` that ``id_told`` tells in: nearly all others are dropped before anything is shuffled."""
    return id_told(df, ids, column, bits).where("_told").drop("_told")


def labelled_ids(labels: DataFrame, column: str, bound: int, folds: int = 3, held_out: int = 1, seed: int = 0) -> DataFrame:
    """(doc_id, label) of about ``bound`` labelled rows outside the held-out fold, chosen by hash; never many more, so it may be
    broadcast. A doc_id with several labels counts once, with the largest; null labels and ids are left out.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .where(fold(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    n = max(rows.count(), 1)
    share = min(1.0, bound / n)
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 24)) < int(share * (1 << 24)))


#: Bytes of rows that go to a Python worker at once. The JVM keeps what it sends in direct memory, several times over.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what is sent to Python at once by bytes, unless the session was set up with a bound of its own: texts may be very long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, f"{BATCH_BYTES}b")


def keep_rows(docs: DataFrame, judge: Callable[[list[str]], list[bool]], at_once: int = 512) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps by their texts (null: empty), as they are: no id, join or shuffle is needed. Only where
    ``text`` isn't a string column, a copy of it goes along."""
    small_batches(docs.sparkSession)
    own = "text" if docs.schema["text"].dataType.typeName() == "string" else fresh(docs, "_judged")
    sent = docs if own == "text" else docs.withColumn(own, F.col("text").cast("string"))
    at_column, columns = sent.columns.index(own), range(len(docs.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                kept = judge([t or "" for t in part.column(at_column).to_pylist()])
                yield part.select(columns).filter(pa.array(kept, pa.bool_()))

    return sent.mapInArrow(run, docs.schema)


def id_and_text(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, label, text) of the documents of ``labelled_ids``; where documents share an id, the least text stands for it, so that the
    rows are bounded as the ids are."""
    ids = labelled_ids(labels, column, bound)
    return id_and_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))


def logistic(x, y, penalty: float = 1e-2, steps: int = 40):
    """Weights, the last one the intercept, of a penalised logistic fit by Newton's method; numpy arrays."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
