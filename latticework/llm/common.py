"""What the operators of this subpackage share: reading tables, staging results in the shared folder, shipping code."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Hashable, Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors once for each context, so that Python workers import the same code; bounds their batches."""
    sc = spark.sparkContext
    small_batches(spark)
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():  # when already imported from a shipped archive there is nothing to do
        target = os.path.join(tempfile.mkdtemp(), "latticework_code.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one only where it is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='latticework-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables staged under the shared folder for one run of an operator.

    ``put`` writes a frame and reads it back, which cuts its lineage in a way that survives lost
    executors; ``free`` removes what is no longer needed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/latticework/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.option("compression", "zstd").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._staged_at = where
        return out

    def free(self, *frames: DataFrame) -> None:
        for df in frames:
            if where := getattr(df, "_staged_at", None):
                self.remove(where)

    def remove(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(where)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Limits of the batches that go to Python workers, where the session has Spark's own (10,000 rows, 64 MB): a worker holds one batch at a time.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    for key, plain, own in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", plain) == plain:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(own))


class WorkerMemory:
    """What a Python worker remembers between tasks, by key: two generations of about ``limit`` bytes together.

    Workers are reused by later stages, so only the operator that runs may hold such a memory: ``enter``, called when a task
    starts, drops that of any other operator. What is dropped is only computed again."""

    holder: WorkerMemory | None = None

    def __init__(self, limit: int, overhead: int, leave: Callable[[], None] = lambda: None):
        """``overhead``: bytes of an entry beside its key's length; ``leave``: called when another operator takes over."""
        self.limit, self.overhead, self.leave = limit, overhead, leave
        self.clear()

    def clear(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.bytes = 0

    def enter(self) -> WorkerMemory:
        if WorkerMemory.holder is not self:
            if WorkerMemory.holder is not None:
                WorkerMemory.holder.clear()
                WorkerMemory.holder.leave()
                give_back()
            WorkerMemory.holder = self
        return self

    def turn(self) -> None:
        """To be called between texts, or parts of ``PART`` words: starts a generation when the present one has its share."""
        if self.bytes > self.limit // 2:
            self.old, self.young, self.bytes = self.young, {}, 0

    def put(self, key: Hashable, value: object) -> None:
        self.young[key] = value
        self.bytes += len(key) + self.overhead

    def add(self, found: dict) -> None:
        self.young.update(found)
        self.bytes += sum(map(len, found)) + self.overhead * len(found)

    def learn(self, keys: Iterable, make: Callable) -> None:
        """Puts keys that the present generation lacks into it; what the older one knows is carried over."""
        for key in keys:
            got = self.old.get(key)
            self.put(key, make(key) if got is None else got)


#: A text's words are looked up in parts of so many, so that one very long text does not outgrow the memory.
PART = 100_000


def parts_of(words: list) -> Iterable[list]:
    return (words,) if len(words) <= PART else (words[i : i + PART] for i in range(0, len(words), PART))


def give_back() -> None:
    """Returns freed memory of the allocators to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them where the frame has such columns (names are compared as Spark does, without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns under fixed names; a null text becomes the empty one."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def crc32_mod(column: str, m: int):
    """crc32 of the id written as text, modulo m; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(m))
