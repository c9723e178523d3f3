"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> None:
    """Make sure that a checkpoint folder is set; one that the cluster names is left alone.

    Only a local session gets a folder of this machine; on a cluster that names none, this is an error.
    """
    if not spark.sparkContext.getCheckpointDir():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "/tmp/contractscope-checkpoints")


def free_shuffles(spark: SparkSession) -> None:
    """From now on let each query's shuffle files go when it ends, so that steps don't pile up on disk."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder, so that no executor loss recomputes what lies before it.

    With free_shuffles, the computation's shuffle files go as soon as the checkpoint is written.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, rows: int) -> None:
    """Bound the rows of an Arrow batch handed to Python, and with them a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def blocks(n_rows: int, per_block: int) -> int:
    """Number of blocks of at most about per_block rows."""
    return max(1, math.ceil(n_rows / per_block))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordTable:
    """A bounded table from words to the bytes that stand for them; a batch's words are looked up all at once."""

    def __init__(self, most: int, longest: int = 64):
        self.most, self.longest = most, longest
        self.words, self.values = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def look_up(self, split: pa.ListArray, make: Callable[[list[str]], list[bytes]]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The values of all words of the lists, one after another, and where each list's begin; make gives those of new words."""
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        made = pa.array(make(new.to_pylist()), pa.large_binary())
        values = pa.concat_arrays([self.values, made])
        lacking = at.is_null().to_numpy(zero_copy_only=False)
        place = np.where(lacking, len(self.values) - 1 + np.cumsum(lacking), at.fill_null(0).to_numpy(zero_copy_only=False))
        short = pc.less_equal(pc.utf8_length(new), self.longest)
        if len(self.words) + len(new) > self.most:
            self.words, self.values = new.filter(short), made.filter(short)
        else:
            self.words, self.values = pa.concat_arrays([self.words, new.filter(short)]), pa.concat_arrays([self.values, made.filter(short)])
        offsets = split.offsets.to_numpy()
        return values.take(pa.array(place[coded.indices.to_numpy()], pa.int64())), offsets - offsets[0]


def ragged(values: pa.LargeBinaryArray, ends: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the values as numbers, and where the groups of values begin that `ends` delimits."""
    if not len(values):
        return np.zeros(0, kind), np.zeros(len(ends), np.int64)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    every = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None else np.zeros(0, kind)
    return every, (offsets[ends] - offsets[0]) // np.dtype(kind).itemsize


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back what Arrow's pool and the C library keep of its task.

    Spark reuses workers from one stage to the next, and without this each keeps the most that any of its tasks held.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return each


def gathered(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches put together to about most_bytes of text, so that more words of a batch repeat."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
