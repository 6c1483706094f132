"""Substring deduplication with a log-structured fingerprint index.

A window is so many consecutive words. Its fingerprint is the smallest hash of its 4-word grams: equal windows have
equal fingerprints, while neighbouring windows mostly share one, so a text has about a fifth as many fingerprints
as windows. Each batch of documents adds one immutable run of (fingerprint, id) rows, sorted by fingerprint. The
runs are met with it by a count over all of them: fingerprints that occur in two documents, one of them new, are hits. A hit is verified on
the texts: the documents that have it are read again and their windows under it compared by a 128-bit digest of
the words. What was verified
is kept as runs of window digests, each with the first document that has it, so an old document is read again only
when a fingerprint that was its alone is met for the first time. Runs are compacted when there are many.

A fingerprint that a third of all documents share is counted with partial sums, and its windows meet only in a count
and a minimum by window, never pair by pair. Joins are shuffled hash joins, whose sides adaptive execution splits where
they are skewed. A merge-join of bucketed sorted runs was tried and not measured to the end; see the README.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.plans.storage import Workspace

GRAM = 4


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return (text or "").encode("utf-8", "replace").split()


def fingerprints(words: list[bytes], window: int) -> np.ndarray:
    """The fingerprint of each window, in order; none where there are fewer words than a window."""
    if len(words) < window:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    gram = min(GRAM, window)
    n = len(words) - gram + 1
    g = np.zeros(n, np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    return np.lib.stride_tricks.sliding_window_view(g, window - gram + 1).min(axis=1).view(np.int64)


def window_digests(words: list[bytes], starts: np.ndarray, window: int) -> np.ndarray:
    """128-bit digests of the windows that start at ``starts``, as rows of two longs."""
    digest, text = xxhash.xxh128_digest, b" ".join(words)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    raw = b"".join([digest(text[i:j]) for i, j in zip(at[starts].tolist(), (at[starts + window] - 1).tolist(), strict=True)])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _sorted_run(docs: DataFrame, window: int) -> DataFrame:
    """(id, fp) of every document, each fingerprint once, sorted by fingerprint within tasks."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            each = [np.unique(fingerprints(words_of(t), window)) for t in batch["text"]]
            yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), [len(x) for x in each]), "fp": np.concatenate([*each, np.zeros(0, np.int64)])})

    return docs.mapInPandas(found, "id long, fp long").sortWithinPartitions("fp", "id")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(id, w1, w2): the windows of each document whose fingerprint is among its ``fps``, each once."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, out = [], [np.zeros((0, 2), np.int64)]
            for i, text, fps in zip(batch["id"].to_numpy(), batch["text"], batch["fps"], strict=True):
                words = words_of(text)
                starts = np.flatnonzero(np.isin(fingerprints(words, window), fps))
                w = window_digests(words, starts, window)
                w = w[np.unique(w[:, 0], return_index=True)[1]]
                out.append(w)
                ids.append(np.full(len(w), i))
            w = np.concatenate(out)
            yield pd.DataFrame({"id": np.concatenate([*ids, np.zeros(0, np.int64)]), "w1": w[:, 0], "w2": w[:, 1]})

    return docs.mapInPandas(found, "id long, w1 long, w2 long")


def _kept(text: Column, gone: Column, window: int) -> Column:
    """n_words, n_removed and the kept words of a text, ``gone`` naming the windows to remove by half their digest."""

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for t, bad in zip(texts, gone, strict=True):
            words = words_of(t)
            if bad is None:
                rows.append((len(words), 0, None if t is None else b" ".join(words).decode()))
                continue
            n = len(words) - window + 1
            hit = np.isin(window_digests(words, np.arange(n), window)[:, 0], bad)
            # a word is covered if one of the windows that begin in the last ``window`` places is hit
            covered = np.convolve(hit, np.ones(window, np.int64)) > 0
            rows.append((len(words), int(covered.sum()), b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c).decode()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    return cut(text, gone)


class FingerprintIndex:
    """Runs of fingerprints of the documents seen so far; ``add`` takes the next batch.

    Ids grow from batch to batch, as arrival numbers do; a batch that breaks this raises ValueError. The documents
    of earlier batches must stay readable, for hits are verified on their texts.
    """

    def __init__(self, spark: SparkSession, window: int = 13, most_runs: int = 4) -> None:
        self.work, self.window, self.most_runs = Workspace(spark, "substrings"), window, most_runs
        self.runs: dict[str, DataFrame] = {}  # (id, fp), sorted by fp
        self.windows: dict[str, DataFrame] = {}  # (w1, w2, first, last) of the windows verified so far
        self.seen: list[DataFrame] = []
        self.largest: int | None = None
        self.n = 0

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Index a batch. Returns the columns of ``docs`` with the kept words as text, and n_words and n_removed.

        A word goes if it is covered by a window whose words also stand in a row with a smaller id, of this or an
        earlier batch. Windows are judged on the input, not on what is left. Null texts stay null and have no
        words; rows with a null id stay whole and count for nothing; rows that share an id are one document.
        Texts of any length are read whole; columns named n_words or n_removed are replaced.
        """
        self.n += 1
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
        new = self.work.table(f"run-{self.n}", _sorted_run(rows, self.window))
        least, most = new.agg(F.min("id"), F.max("id")).first()
        if least is not None and self.largest is not None and least <= self.largest:
            raise ValueError(f"id {least} comes after {self.largest}")
        before, self.largest = self.largest, self.largest if most is None else most
        self.seen.append(rows)

        # merge: fingerprints of two documents at least, one of them new; of old documents only those whose
        # fingerprint was alone so far, the windows under the others are in a run already
        old = [r.withColumn("new", F.lit(0)) for r in self.runs.values()]
        merged = reduce(DataFrame.unionByName, [*old, new.withColumn("new", F.lit(1))])
        hits = merged.groupBy("fp").agg(F.sum("new").alias("fresh"), F.count("*").alias("n")).where("n > 1 and fresh > 0")
        wanted = merged.join(hits.select("fp", (F.col("n") - F.col("fresh")).alias("before")).hint("shuffle_hash"), "fp").where("new = 1 or before = 1")
        self.runs[f"run-{self.n}"] = new
        lists = self.work.table("hits", wanted.groupBy("id").agg(F.collect_set("fp").alias("fps")))

        # verify on the texts; the first document of each window keeps it
        texts = reduce(DataFrame.unionByName, self.seen)
        same = self.work.table("windows", _windows(texts.join(lists.hint("shuffle_hash"), "id"), self.window))
        self.work.drop("hits")
        label = f"windows-{self.n}"
        self.windows[label] = self.work.table(label, same.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last")))
        first = reduce(DataFrame.unionByName, self.windows.values())
        if len(self.windows) > 1:
            first = first.groupBy("w1", "w2").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        first = self.work.table("first", first.where("last > first").select("w1", "w2", "first"))
        fresh = same if before is None else same.where(F.col("id") > before)
        later = fresh.join(first.hint("shuffle_hash"), ["w1", "w2"]).where("id > first").groupBy("id").agg(F.collect_set("w1").alias("gone"))
        gone = self.work.table(f"gone-{self.n}", later)
        self.work.drop("windows", "first")
        if len(self.runs) > self.most_runs:
            self.compact()

        cut = gone.select(F.col("id").alias("__id"), F.col("gone").alias("__gone")).hint("shuffle_hash")
        joined = docs.join(cut, docs[id_col] == cut["__id"], "left").withColumn("__cut", _kept(F.col(text_col), F.col("__gone"), self.window))
        return joined.select(*(F.col("__cut.kept").alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns if c not in ("n_words", "n_removed")), "__cut.n_words", "__cut.n_removed")

    def compact(self) -> None:
        """Merge all runs of fingerprints into one, and all runs of windows."""
        merged = reduce(DataFrame.unionByName, self.runs.values()).repartitionByRange("fp", "id").sortWithinPartitions("fp", "id")
        self.runs = self._replaced(self.runs, f"run-{self.n}-compacted", merged)
        first = reduce(DataFrame.unionByName, self.windows.values()).groupBy("w1", "w2").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        self.windows = self._replaced(self.windows, f"windows-{self.n}-compacted", first)

    def _replaced(self, old: dict[str, DataFrame], label: str, merged: DataFrame) -> dict[str, DataFrame]:
        new = {label: self.work.table(label, merged)}
        self.work.drop(*old)
        return new


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, batches: int = 2) -> DataFrame:
    """One pass over a table: :class:`FingerprintIndex` fed in ``batches`` ranges of ids, equal in rows or nearly so.

    An empty table gives no rows.
    """
    index, key = FingerprintIndex(docs.sparkSession, window), F.col(id_col)
    cuts = docs.agg(F.percentile_approx(key, [(k + 1) / batches for k in range(batches - 1)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = F.lit(True) if low is None else key > low
        inside = inside if high is None else inside & (key <= high)
        parts.append(index.add(docs.where(inside | key.isNull() if low is None else inside), id_col, text_col))
    return reduce(DataFrame.unionByName, parts)
