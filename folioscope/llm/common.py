"""What the operators of this subpackage share: shared storage, table access, word tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
#: Rows and bytes of the batches that a Python worker gets, whatever the size of a text or a set.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests).

    Executors of a cluster can't see a folder of the driver's machine, so there an unset folder is an error.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="folioscope-"))
    return f"file://{_own_dir[0]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: lineage ends there, so a lost executor costs a reread only."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables that are needed for a while: cut() and bucketed() write one, drop() deletes all of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.names = spark, [], []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(path := scratch(self.spark, name))
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """df as a table in the shared folder, bucketed by key, so that joins on the key move the other side alone."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.names.append(name := f"{name}_{uuid.uuid4().hex}")
        self.paths.append(path := scratch(self.spark, name))
        df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
        return self.spark.table(name)

    def drop(self) -> None:
        """Only call it once everything that is read from the tables is written."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths.clear()
        self.names.clear()


#: Tables of words that live as long as their worker does.
_memos: list[Memo] = []


def _trimmed() -> None:
    """Empties lasting tables and gives unused memory back, as a worker lives on for the tasks of other stages."""
    for held in _memos:
        held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes.

    Both bounds are settings of the session and stay; smaller ones that it already has are kept.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB"))
        if not 0 < now <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            _trimmed()

    return df.mapInArrow(bounded, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns kept and the text, null as the empty text."""
    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text"))


#: UTF-8 bytes of words: digits, letters (A-Z as a-z) and all above ASCII; every other byte parts words.
_FOLD = bytes((b | 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words as [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ finds them after A-Z are lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Memo(dict):
    """Keeps f(key) of at most `limit` keys and forgets all of them when it is full; a lasting one at the end of each task too."""

    def __init__(self, f, limit: int = 250_000, lasting: bool = False):
        super().__init__()
        self.f, self.limit = f, limit
        if lasting:
            _memos.append(self)

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.f(key)
        return value


def lists(flat, ends, kind=None) -> pa.Array:
    """An arrow list array of the flat values cut at the ends."""
    values = flat if isinstance(flat, pa.Array) else pa.array(flat, kind)
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values)


def numbered(text: str, get, piece: int = 1 << 20):
    """An int64 array of get(word) of each word of the text; long texts are cut between words, so few words live at once."""
    import numpy as np

    data = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    if len(data) <= piece:
        words = data.split()
        return np.fromiter(map(get, words), np.int64, len(words))
    out, at = [], 0
    while at < len(data):
        end = at + piece
        end = len(data) if end >= len(data) else (data.find(b" ", end) % (len(data) + 1))
        words = data[at:end].split()
        out.append(np.fromiter(map(get, words), np.int64, len(words)))
        at = end
    return np.concatenate(out)


def largest(values, k: int):
    """Columns, in order, of the k largest values of each row of a numpy array; of equal ones at the edge the first."""
    import numpy as np

    edge = -np.partition(-values, k - 1, axis=1)[:, k - 1 : k]
    above = values > edge
    level = values == edge
    free = k - above.sum(1, keepdims=True)
    take = above | (level & (np.cumsum(level, axis=1) <= free))
    return np.nonzero(take)[1].reshape(len(values), k)
