"""Delta-maintained token rollups (operator 4).

Totals by source, language and tokenizer version are sums of signed deltas: an insert adds a
document and its tokens, a delete takes them back, a revision does both. Batches of deltas are
committed once: a batch's rows are reduced to one per key, written to a folder of their own, and
become visible by a marker that is written last; committing a batch again changes nothing. Every few
batches a commit also folds what is new into a compacted total, so that reading totals means reading one of these
and a bounded number of batches. Nothing that a reader may still name is deleted but by :meth:`RollupStore.vacuum`.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.packing import load_tokenizer
from orrery.llm.rows import trimmed

KEYS = ("source", "lang", "tokenizer")
#: Tokenizer versions that are counted in place: code points of ``pattern`` matches.
PATTERNS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "words-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]",
}


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a text under a version; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[version])), F.lit(0)).cast("long")


def signed(counts: DataFrame, sign: int, tokens: str = "tokens") -> DataFrame:
    """Deltas that insert (+1) or delete (-1) each row of ``counts`` (source, lang, tokenizer, tokens)."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.coalesce(F.col(tokens), F.lit(0)) * sign).cast("long").alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace counts: what ``old`` said is taken back and what ``new`` says is added."""
    return signed(old, -1).unionByName(signed(new, 1))


def reduced(deltas: DataFrame) -> DataFrame:
    """One row per key. Sums combine on the map side, so a hot source is a row per task in the shuffle."""
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


#: Batches that no compacted total has, from which on a commit folds them into a new one.
FOLD_FROM = 4


class RollupStore:
    """Committed batches in one folder of a file system that all executors share.

    ``deltas/<batch>/<attempt>`` hold rows, ``commits/<batch>~<attempt>`` are the markers, and
    ``totals/<number>-<attempt>`` are compacted totals with the names of the batches in them. No file
    is ever written twice, so writers need no lock: of several attempts at one batch, which all
    have the same deltas, one counts, and of several compacted totals any is right with the
    batches that it does not name. A run that stopped half-way left files without a marker, which
    nobody reads. A commit or a read lists two folders and reads one list of names, however many
    batches there have been; the list of markers is as long as what :meth:`vacuum` has left.
    """

    def __init__(self, spark: SparkSession, path: str, fold_from: int = FOLD_FROM):
        self.spark, self.path, self.fold_from = spark, path.rstrip("/"), fold_from
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self._conf), path

    def _names(self, folder: str) -> dict[str, int]:
        """Names in a folder, in order, with the time of their last change in milliseconds."""
        fs, path = self._at(folder)
        found = fs.listStatus(path) if fs.exists(path) else []
        return dict(sorted((s.getPath().getName(), s.getModificationTime()) for s in found))

    def _put(self, name: str, text: str = "") -> None:
        fs, path = self._at(name)
        out = fs.create(path, False)
        out.write(text.encode())
        out.close()

    def _drop(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def _marked(self) -> dict[str, str]:
        """Batches with a marker, and the attempt of each that counts, the least."""
        return {batch: attempt for batch, attempt in sorted((tuple(n.split("~")) for n in self._names("commits")), reverse=True)}

    def batches(self) -> list[str]:
        """Committed batches, least name first."""
        return sorted(self._latest()[1].union(self._marked()))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Apply a batch once. False if it was committed before, in which case nothing is read."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
            raise ValueError(f"a batch is named by letters, digits, '.', '_' and '-', not {batch!r}")
        marked, (_, inside) = self._marked(), self._latest()  # in this order: what is no longer marked is inside
        if batch in marked or batch in inside:
            return False
        attempt = uuid.uuid4().hex
        reduced(deltas).write.parquet(f"{self.path}/deltas/{batch}/{attempt}")
        self._put(f"commits/{batch}~{attempt}")
        if len(marked.keys() - inside) + 1 >= self.fold_from:
            self.compact()
        return True

    def _latest(self) -> tuple[str | None, set[str]]:
        """The newest compacted total that is whole, and the batches in it."""
        for name in reversed(self._names("totals")):
            fs, done = self._at(f"totals/{name}/_DONE")
            if fs.exists(done):
                _, listed = self._at(f"totals/{name}/batches.txt")
                stream = fs.open(listed)
                try:
                    return name, set(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split())
                finally:
                    stream.close()
        return None, set()

    def _sums(self) -> tuple[DataFrame, str | None, set[str], list[str]]:
        marked, (name, inside) = self._marked(), self._latest()
        fresh = sorted(marked.keys() - inside)
        paths = [f"{self.path}/deltas/{batch}/{marked[batch]}" for batch in fresh]
        paths += [f"{self.path}/totals/{name}/rows"] if name else []
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return reduced(rows), name, inside, fresh

    def compact(self) -> None:
        """Fold the batches that no compacted total has into a new one. Nothing is deleted: readers may name what is old."""
        sums, name, inside, fresh = self._sums()
        if not fresh:
            return
        number = int(name.split("-")[0]) + 1 if name else 1
        folder = f"totals/{number:012d}-{uuid.uuid4().hex}"
        sums.where("docs <> 0 or tokens <> 0").write.parquet(f"{self.path}/{folder}/rows")
        self._put(f"{folder}/batches.txt", "\n".join(sorted(inside.union(fresh))))
        self._put(f"{folder}/_DONE")

    def vacuum(self, older_than_s: float = 7 * 24 * 3600.0) -> int:
        """Delete what the newest whole total makes needless, if that total is at least so old; the number of things deleted.

        These are totals before it, and markers and rows of batches in it. The age has to exceed the
        longest time that a reader keeps a result of :meth:`totals`, or a writer takes for a commit.
        """
        name, inside = self._latest()
        totals = self._names("totals")
        if name is None or totals[name] > (time.time() - older_than_s) * 1000:
            return 0
        gone = [f"totals/{old}" for old in totals if old < name]
        gone += [f"commits/{marker}" for marker in self._names("commits") if marker.split("~")[0] in inside]
        gone += [f"deltas/{batch}" for batch in self._names("deltas") if batch in inside]
        for item in gone:
            self._drop(item)
        return len(gone)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all batches committed so far; later commits do not change it.

        Null sources and languages are keys of their own. A key whose documents are all gone, with
        no tokens left, has no row.
        """
        sums = self._sums()[0].where("docs <> 0 or tokens <> 0")
        return sums.select(*KEYS, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """source, lang, words (``words-1``) and bpe (ids that ``tokenizer`` gives the whole text), one row per
    document. A null text has none of either; ids and other columns do not matter."""
    schema = pa.schema([("source", pa.string()), ("lang", pa.string()), ("words", pa.int64()), ("bpe", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_tokenizer(tokenizer)
        for batch in batches:
            counts = [len(encode(text)) if (text := body.as_py()) else 0 for body in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64())], schema=schema)

    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), count_tokens(F.col("text"), "words-1").alias("words"), F.col("text").alias("text"))
    return rows.mapInArrow(trimmed(work), "source string, lang string, words long, bpe long")


def roll_up_tokenized(store: RollupStore, slim: DataFrame, version: str) -> DataFrame:
    """Five batches over a corpus, given by its :func:`tokenized` rows: all documents by words; all of them
    under ``version``, delivered twice; the short ones deleted; those inserted again, as they were; and
    counts that were one too high, revised. The totals are those of the whole corpus by both versions."""
    words = slim.select("source", "lang", F.lit("words-1").alias("tokenizer"), F.col("words").alias("tokens"), "words")
    ids = slim.select("source", "lang", F.lit(version).alias("tokenizer"), F.col("bpe").alias("tokens"), "words")
    short = F.col("words") < 20
    store.commit("0001-words", signed(words.withColumn("tokens", F.when(short, F.col("tokens")).otherwise(F.col("tokens") + 1)), 1))
    for _ in range(2):
        store.commit("0002-ids", signed(ids, 1))
    gone = words.where(short).unionByName(ids.where(short))
    store.commit("0003-short-out", signed(gone, -1))
    store.commit("0004-short-back", signed(gone, 1))
    store.commit("0005-revised", revised(words.where(~short).withColumn("tokens", F.col("tokens") + 1), words.where(~short)))
    return store.totals()


def roll_up(store: RollupStore, slim: DataFrame) -> DataFrame:
    """Four batches over a corpus, given by its :func:`measured` rows, one batch delivered twice: all
    documents under ``words-1``; English ones revised to ``words-2``; documents of fewer than 20 words
    deleted; those again, and each document under the other version too, so that the totals are those of
    the whole corpus by version."""
    one = slim.select("source", "lang", F.lit("words-1").alias("tokenizer"), F.col("words_1").alias("tokens"), "words_1")
    two = slim.select("source", "lang", F.lit("words-2").alias("tokenizer"), F.col("words_2").alias("tokens"), "words_1")
    english = F.col("lang").eqNullSafe("en")
    store.commit("0001-load", signed(one, 1))
    for _ in range(2):
        store.commit("0002-english", revised(one.where(english), two.where(english)))
    short = F.col("words_1") < 20
    store.commit("0003-short", signed(one.where(short & ~english), -1).unionByName(signed(two.where(short & english), -1)))
    store.commit("0004-whole", signed(one.where(short | english), 1).unionByName(signed(two.where(short | ~english), 1)))
    return store.totals()


def measured(docs: DataFrame) -> DataFrame:
    """source, lang and both versions' counts, one row per document; ids and other columns do not matter."""
    return docs.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        count_tokens(F.col("text"), "words-1").alias("words_1"), count_tokens(F.col("text"), "words-2").alias("words_2"),
    )


#: Of :func:`roll_up`.
WORDS_SQL = rf"""
WITH counted AS (
  SELECT source, lang, unnest(['words-1', 'words-2']) AS tokenizer,
         unnest([coalesce(len(regexp_extract_all(text, '{PATTERNS["words-1"]}')), 0), coalesce(len(regexp_extract_all(text, '{PATTERNS["words-2"]}')), 0)]) AS words
  FROM documents)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(words) AS BIGINT) AS n_tokens FROM counted GROUP BY 1, 2, 3
"""
