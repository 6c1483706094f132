"""Spelling variants: words one edit apart, found by a rare-first prefix filter over positional bigrams.

The bigrams of the vocabulary are put into one order, the rarest first. One edit touches at most two places where a
bigram stands, so of the three rarest bigrams of a word one at least is left whole in any word near to it, and is among
the three rarest there too, or the other way round. Only those three are joined, under limits of position: beside a bigram
left whole, the edit is on one side. So all of the other side is alike, and so is the edit's own side but for one of its
``PARTS`` stretches. A key is made of just that: the place from the word's beginning (or end), the length, and what must be
alike. Words that meet in a key are verified inside the join, so candidates are never rows; a pair that meets in several
keys is counted once.

Distribution. Tokens are counted with partial sums; from then on there is only the vocabulary. A key holds nearly the
whole word, so no key gathers many words however frequent its bigram is. The order of bigrams is a table of at most
``LETTERS`` squared rows, since words have no other letters.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.urls import LOWER, UPPER
from narrata.plans.storage import Workspace

RUN = "[A-Za-zÀ-ÿ]+"
#: Letters that a word can have once A-Z are lower-cased.
LETTERS = 26 + 64
RAREST, PARTS = 3, 3


def runs(text: Column) -> Column:
    """Maximal runs of letters, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({RUN})"), F.lit(1))


def mistyped(id: Column, run: Column, every: int) -> Column:
    """The run, one code point short where ``every`` divides the CRC-32 of ``id:run``: typing errors to be found again."""
    h = F.crc32(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, every: int | None = None) -> DataFrame:
    """(word, n): the words of whole texts with at least so many code points and occurrences. Null texts have none; a null
    id counts as empty; repeated rows count each. every: plant a typing error in one of so many runs (``mistyped``)."""
    found = docs.select(F.col(id_col).alias("id"), F.explode(runs(F.col(text_col))).alias("run"))
    words = found.select((mistyped(F.col("id"), F.col("run"), every) if every else F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def keys_of(word: str, rank: dict[str, int]) -> set[int]:
    """Hashes of the keys of a word; two words one edit apart share one at least. ``rank`` orders the bigrams."""
    n = len(word)
    grams = [word[i : i + 2] for i in range(n - 1)]
    rare = set(sorted(set(grams), key=rank.__getitem__)[:RAREST])
    out = set()
    for p in (i for i, g in enumerate(grams) if g in rare):
        for side, room in (("r", n - p - 2), ("l", p)):  # code points on the side of the edit
            place, whole = (p, word[: p + 2]) if side == "r" else (n - p, word[p:])
            rest = word[p + 2 :] if side == "r" else word[:p]
            for size in (room, room - 1):  # of the shorter word; the longer one has one more
                for c in range(PARTS if size >= 0 else 0):
                    low, high = c * size // PARTS, (c + 1) * size // PARTS
                    out.add(xxhash.xxh64_intdigest(f"{side}{place},{size},{c},{whole},{rest[:low]},{rest[room - (size - high) :]}") - (1 << 63))
    return out


def _keys(rank: dict[str, int]):
    @F.pandas_udf("array<long>")
    def keys(words: pd.Series) -> pd.Series:
        return pd.Series([list(keys_of(w, rank)) for w in words], dtype=object)

    return keys


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: words exactly one inserted, deleted or replaced code point apart. ``words`` has one row a word of four
    code points or more; shorter ones could lose all their bigrams to one edit and must not come here."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("g"))
    order = grams.groupBy("g").count().orderBy("count", "g").collect()  # bounded by the letters, see above
    keyed = words.select("word", F.explode(_keys({r["g"]: i for i, r in enumerate(order)})("word")).alias("key"))
    a, b = keyed.select("key", F.col("word").alias("a")), keyed.select("key", F.col("word").alias("b"))
    one_edit = (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    return a.hint("merge").join(b, (a["key"] == b["key"]) & one_edit).select("a", "b").distinct()


def spelling_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word of ``words`` (word, n).

    n_near counts the words one edit apart. Of these the one with the largest n (ties: the smallest by code points) is the
    form, where its n is at least ``ratio`` times the word's; else form and form_n are null. root: forms followed to the
    last, the word itself where it has none. Words of a null n or fewer than four code points raise; repeated
    words must have been added up. No words: no rows.
    """
    work = Workspace(words.sparkSession, "spelling")
    words = work.table("words", words.select("word", F.col("n").cast("long").alias("n")))
    if not words.where("word is null or n is null or char_length(word) < 4").isEmpty():
        raise ValueError("Words need four code points and a count")
    pairs = work.table("pairs", near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    met = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = met.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    fits = -F.col("best.m") >= ratio * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"))
    formed = work.table("formed", formed)
    work.drop("words", "pairs")
    # counts grow ``ratio`` times along forms, so ways to the root are short and each round halves them
    to, turn = work.table("to-0", formed.where("form is not null").select("word", F.col("form").alias("root"))), 0
    while True:
        on = work.table("on", to.select("root").distinct().join(to.select(F.col("word").alias("root"), F.col("root").alias("next")), "root"))
        if on.isEmpty():
            break
        turn += 1
        to = work.table(f"to-{turn}", to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        work.drop(f"to-{turn - 1}")
    return formed.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
