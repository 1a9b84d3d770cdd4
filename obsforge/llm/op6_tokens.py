"""Token counts as delta-maintained rollups by source, language and tokenizer version.

Totals are additive, so a batch of changes is a few signed sums: inserts add a document and its
tokens, deletes take them away, revised counts move the difference. A batch's sums are written to a
folder of their own; then a small marker with the batch's name is created, only if there is none,
and tells the folder: that is the commit. A writer that finds a marker takes its own folder away, so
a retry, or a second writer at the same time, changes nothing. Totals are the sums over the folders
that markers tell; what a crash left without one is never read, and ``sweep`` deletes it.
"""

from __future__ import annotations

import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from .common import Durable, delete_folder, map_batches, shared_folder, table, utf8
from .tokens import encoder, vocabulary

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
VOCABULARY = "word_bpe_49k.json"
#: Characters of the name of a folder of sums.
NAME = len("sums-") + 32


def inserts(docs: DataFrame) -> DataFrame:
    """Signed changes of new documents: ``source, lang, tokenizer, tokens`` each."""
    return docs.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("tokens").cast("long").alias("n_tokens"))


def deletes(docs: DataFrame) -> DataFrame:
    return docs.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("tokens")).cast("long").alias("n_tokens"))


def revisions(docs: DataFrame) -> DataFrame:
    """Signed changes of documents counted anew: ``old_`` and ``new_`` source, lang, tokenizer, tokens each."""
    old, new = (docs.select(*[F.col(f"{when}_{k}").alias(k) for k in (*KEYS, "tokens")]) for when in ("old", "new"))
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """A rollup in a folder that all executors share.

    Keys may be null, which is a value of its own; null counts add nothing. Sums that come to no
    documents and no tokens are left out of the totals. A batch is any frame of signed changes, an
    empty one too, and its name becomes part of a path: letters, digits, ``-`` and ``_``.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _markers(self) -> list[tuple[object, str, str]]:
        """Each marker's status, its batch and the folder that it tells (none if a crash cut it short)."""
        path, fs = self._path("")
        found = []
        for status in fs.listStatus(path) if fs.exists(path) else []:
            name = status.getPath().getName()
            if name.startswith("batch="):
                told = scratch.content_of(self.spark, status.getPath().toString()).decode()
                found.append((status, name.removeprefix("batch="), told if len(told) == NAME else ""))
        return found

    def committed(self, batch: str) -> bool:
        """Whether a batch is there. A marker without content is a commit under way or one that broke off: an error."""
        told = {b: folder for _, b, folder in self._markers()}
        if told.get(batch) == "":
            raise RuntimeError(f"the marker of batch {batch!r} is empty: another writer is at it, or broke off and is to be swept")
        return batch in told

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing changes, if it is there already."""
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch name: {batch!r}")
        if self.committed(batch):
            return False
        folder = f"sums-{uuid.uuid4().hex}"
        sums = changes.groupBy(*KEYS).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
        sums.write.parquet(f"{self.folder}/{folder}")
        if not self._mark(batch, folder):
            delete_folder(self.spark, f"{self.folder}/{folder}")
            return False
        return True

    def _mark(self, batch: str, folder: str) -> bool:
        """Create a batch's marker; False if it is there, whoever created it."""
        return scratch.create_once(self.spark, f"{self.folder}/batch={batch}", folder.encode())

    def sweep(self, older_than_ms: int) -> list[str]:
        """Delete folders that no marker tells, and empty markers, older than so many milliseconds; returns their names."""
        path, fs = self._path("")
        markers, old = self._markers(), time.time() * 1000 - older_than_ms
        live = {folder for *_, folder in markers}
        loose = [s for s, _, folder in markers if not folder]
        loose += [s for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getPath().getName().startswith("sums-") and s.getPath().getName() not in live]
        gone = [s.getPath() for s in loose if s.getModificationTime() <= old]
        for p in gone:
            fs.delete(p, True)
        return sorted(p.getName() for p in gone)

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``tokenizer``, ``n_docs`` and ``n_tokens`` over all batches."""
        folders = sorted(folder for *_, folder in self._markers() if folder)
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        sums = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{f}" for f in folders]).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def count_tokens(documents: DataFrame, vocabulary_path: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``words`` and ``tokens`` of every row; a null or empty text has none of either."""
    k = len(keep)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(vocabulary_path).encode
        texts = [t.as_py() for t in batch.column(k)]
        counts = [np.array([f(t) for t in texts], np.int64) for f in (lambda t: len(t.split()), lambda t: len(encode(t)) // 4)]
        return pa.RecordBatch.from_arrays([*batch.columns[:k], *map(pa.array, counts)], [*keep, "words", "tokens"])

    kinds = dict(documents.dtypes)
    return map_batches(documents.select(*keep, utf8("text").alias("__text")), each, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "words long, tokens long")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load of all documents by words, a retry of it, a recount by a tokenizer, and a takedown of toxic ones."""
    counted = count_tokens(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY), "doc_id", "source", "lang")
    counted = Durable(spark).keep(counted, "counted")
    words, pieces = F.lit("words-1").alias("tokenizer"), F.lit("word_bpe_49k-1").alias("tokenizer")
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    load = inserts(counted.select("source", "lang", words, F.col("words").alias("tokens")))
    rollup.commit("load", load)
    rollup.commit("load", load)
    recount = counted.select(*[F.col(c).alias(f"{when}_{c}") for c in ("source", "lang") for when in ("old", "new")], words.alias("old_tokenizer"), F.col("words").alias("old_tokens"), pieces.alias("new_tokenizer"), F.col("tokens").alias("new_tokens"))
    rollup.commit("recount", revisions(recount))
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    rollup.commit("takedown", deletes(counted.join(toxic, "doc_id", "left_semi").select("source", "lang", pieces, "tokens")))
    return rollup.totals()
