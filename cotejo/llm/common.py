"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.session import shared_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(name: str) -> Column:
    """A text column in which null reads as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder, as a qualified URI, in the storage that all executors share."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return fs.makeQualified(path).toString()


def open_fs(uri: str):
    """The pyarrow file system of a URI and the path inside it. Runs inside tasks."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)



LONG = 64                # words of more characters are not remembered
MEMORY = 48 * 1024 ** 2  # bytes of one generation of a memory, about


def word_bytes(word: str) -> int:
    """About what remembering a word takes: the string, its entry and a small result."""
    return 200 + 2 * len(word)


class Memory:
    """A memory of results by word, bounded in words and in bytes, kept by a worker process from task to task.

    Two generations: when the young one is full it becomes the old one, and words found in the
    old one move back, so frequent words stay. Words of more than ``LONG`` characters, which seldom
    come back, are held for one call only.
    """

    def __init__(self, limit: int, most: int = MEMORY):
        self.limit, self.most, self.young, self.old = limit, most, {}, {}
        self.held, self.long = 0, []

    def missing(self, words: set[str]) -> list[str]:
        """The words without a result, once the remembered ones are in ``young``."""
        for w in self.long:
            self.young.pop(w, None)
        if len(self.young) > self.limit or self.held > self.most:
            self.young, self.old, self.held = {}, self.young, 0
        new = words.difference(self.young)
        self.long = [w for w in new if len(w) > LONG]
        lost = []
        for w in new:
            if w in self.old:
                self.young[w] = self.old[w]
            else:
                lost.append(w)
        self.held += sum(word_bytes(w) for w in new if len(w) <= LONG)
        return lost


def kept(key: tuple, make):
    """What this worker process keeps under ``key``; made by the first task that asks.

    One thing at a time: a model or an encoder that the next stage does not ask for is let go.
    """
    import sys
    import types

    store = sys.modules.setdefault("_kept_between_tasks", types.ModuleType("_kept_between_tasks")).__dict__
    if store.get("key") != key:
        store.pop("value", None)
        store["value"], store["key"] = make(), key
    return store["value"]
