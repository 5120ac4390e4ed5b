"""Helpers shared by the corpus operators: tables, the shared work folder, word and shingle hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
BATCH_ROWS = 1_000  # rows of an Arrow batch, at most: texts can be long
BATCH_BYTES = 4 << 20  # or so many bytes; a longer text is a batch of its own
#: Python workers hand large freed blocks back at once: workers are used again for later stages.
ALLOCATOR = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304", "ARROW_DEFAULT_MEMORY_POOL": "system"}
WORD_MEMO = 150_000  # words whose hash a Python worker remembers
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether the executors are threads of the driver."""
    return spark.sparkContext.master.partition("[")[0] == "local"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, on a cluster from an archive that Spark sends to them, and keep Arrow batches of whole texts small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    for k, v in ALLOCATOR.items():
        context.environment.setdefault(k, v)
    if is_local(spark):
        path = context.environment.get("PYTHONPATH", "")
        if ROOT not in path.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    elif getattr(ship_package, "sent", None) != context.applicationId:
        archive = Path(tempfile.mkdtemp(prefix="waymark-")) / "waymark_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted((Path(ROOT) / "waymark").rglob("*.py")):
                z.write(f, f.relative_to(ROOT))
        context.addPyFile(str(archive))
        ship_package.sent = context.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); where it is unset, a temporary one, in local mode only."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        own = getattr(shared_dir, "own", None)
        if own is None:
            own = shared_dir.own = tempfile.mkdtemp(prefix="waymark-")
        told = f"file://{own}"
    return told.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a work table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/waymark/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read it back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Delete what ``saved`` wrote; everything made from it must be written already."""
    drop_path(df.sparkSession, df.work_path)


class WordHash(dict):
    """Memo of 64-bit word hashes, emptied when full, so that its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: bytes, memo: WordHash) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, in order."""
    words = text.lower().split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_B
    return h ^ (h >> np.uint64(27))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, in order; of the whole sequence where there are fewer; none without words."""
    n = len(words)
    if n == 0:
        return words
    span = min(k, n)
    h = np.full(n - span + 1, np.uint64(span))
    for i in range(span):
        h = mix((h + words[i : n - span + 1 + i]) * MIX_A)
    return h


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from sorted batches; at most a batch and a run are held."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        whole = pa.Table.from_batches(rest)
        new = starts(whole, keys)
        last = int(new[-1])
        if last:
            yield whole.slice(0, last).combine_chunks()
            rest = whole.slice(last).combine_chunks().to_batches()
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new run of equal keys starts."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a frame that is already written has so few rows at most; what may be broadcast is decided by this."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if small_enough(df, rows) else df
