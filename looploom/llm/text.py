"""Words and other shared definitions of the text operators."""

from __future__ import annotations

import ctypes
import gc
import re
import threading
import time

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a maximal run of other characters than these: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def words(text: Column) -> Column:
    """Array of the words of a text, in order; empty for null and for texts without words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: A worker that has computed nothing for so many seconds frees what it keeps.
IDLE = 2.0

_kept: dict[tuple, object] = {}
_watch: threading.Thread | None = None


def keep(key: tuple, make):
    """What this process keeps between tasks under ``key``, made when it is first asked for. Workers serve one operator after another, so
    what is kept for other keys is freed first, and all of it when a worker stands idle, as its executor's next stage may need the memory."""
    if TaskContext.get() is not None:
        _free_when_idle()
    found = _kept.get(key)
    if found is None:
        if _kept:
            _release()
        _kept[key] = found = make()
    return found


def free() -> None:
    """Free what this process keeps for other operators, now, and what the task leaves, once the worker stands idle."""
    if TaskContext.get() is not None:
        _free_when_idle()
    if _kept:
        _release()


def _release() -> None:
    """Free all that is kept, and give the memory back: allocators hold on to it otherwise."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _free_when_idle() -> None:
    """Watch this process until it stands idle, if nothing does so already. A task that only waits loses nothing, as it has its own reference."""
    global _watch

    def watch() -> None:
        global _watch
        spent = time.process_time()
        while True:
            time.sleep(IDLE)
            now = time.process_time()
            if now - spent < 0.05 * IDLE:
                break
            spent = now
        _watch = None
        _release()

    if _watch is None:
        _watch = threading.Thread(target=watch, daemon=True)
        _watch.start()


#: Most whole texts in an Arrow batch, after :func:`bound_batches`.
BATCH_TEXTS = 1000


def bound_batches(spark: SparkSession, rows: int = BATCH_TEXTS) -> None:
    """From now on Arrow batches of this session hold at most ``rows`` rows. An executor holds several buffers of a batch's size outside
    its heap for each task. A lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
