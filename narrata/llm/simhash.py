"""SimHash near-duplicates: fingerprints, a Gray-order hierarchical index, and components of the links.

Distribution. Two 64-bit fingerprints that differ in at most four bits agree on at least two of six bit blocks,
so each distinct fingerprint goes to the 15 groups named by a pair of blocks and its bits there (about 21 bits).
Every link between different fingerprints is met in some group; equal fingerprints meet before, in a
pre-aggregation. Inside a group the fingerprints are sorted by Gray rank and indexed: upper nodes hold the bits
that all their members share, children add only the bits their parent did not have. A pair of nodes is followed
with the differences accumulated so far: beyond the limit the whole pair is pruned, and where even the open bits
cannot exceed it the two nodes are joined without looking at members, so a dense group of near copies costs a
walk over nodes and yields one link per member, never all pairs. The index works within these groups; its nodes cut
the Gray order at midpoints. A group with more members than a task should hold is cut into pairs of shares.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.tables import SMALL_BATCHES, few_broadcast, text_key, with_columns_kept
from narrata.operators.components import connected_components
from narrata.operators.skew import join_counted
from narrata.plans.storage import Workspace, session_settings

BITS = 64
LEAF = 32


def fingerprint_of(text: str | None, words_per_shingle: int = 4) -> int:
    """The 64-bit SimHash of one text. Null or no words: 0. Fewer words than a shingle: all words are the one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    n = len(words) - words_per_shingle + 1
    begin, end = starts[:n].tolist(), (starts[words_per_shingle:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[b:e], 42) for b, e in zip(begin, end, strict=True)), np.uint64, n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 4096):
        part = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def simhash(text: Column, words_per_shingle: int = 4) -> Column:
    """SimHash of a text column as a signed long that holds the 64 bits."""

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint_of(t, words_per_shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return fingerprint(text)


def block_masks(max_bits: int, extra: int = 2) -> list[int]:
    """Masks of every choice of ``extra`` blocks among ``max_bits + extra``: at most ``max_bits`` blocks can differ."""
    from itertools import combinations

    n = max_bits + extra
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    return [sum(c) for c in combinations(blocks, extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Rank of each code in the reflected Gray sequence: neighbours in that order differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Joins the members of one group that differ in at most ``max_bits`` bits, through ``root``."""

    def __init__(self, codes: np.ndarray, max_bits: int) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes, self.max_bits = codes[self.order], max_bits
        self.parent = list(range(len(codes)))
        self.nodes: list[tuple] = []
        self.full = (1 << BITS) - 1
        self._build(0, len(codes))
        self._walk()

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def _build(self, lo: int, hi: int) -> int:
        """A node: bounds, children, the bits all members share, and their values."""
        if hi - lo <= LEAF:
            kids: tuple = ()
            every, some = int(np.bitwise_and.reduce(self.codes[lo:hi])), int(np.bitwise_or.reduce(self.codes[lo:hi]))
        else:
            mid = (lo + hi) // 2
            kids = (self._build(lo, mid), self._build(mid, hi))
            a, b = self.nodes[kids[0]], self.nodes[kids[1]]
            every, some = a[4] & b[4], a[5] | b[5]
        shared = self.full & ~(every ^ some)
        self.nodes.append((lo, hi, kids, shared, every, some))
        return len(self.nodes) - 1

    def _join(self, lo: int, hi: int) -> None:
        for i in range(lo + 1, hi):
            self.union(lo, i)

    def _walk(self) -> None:
        """From the leaves up; ``one`` tells the nodes whose members are known to be one component."""
        self.one: list[bool] = []
        for lo, hi, kids, shared, _, _ in self.nodes:  # children come before their parents
            if (self.full & ~shared).bit_count() <= self.max_bits:
                self._join(lo, hi)
                self.one.append(True)
            elif kids:
                self._pair(*kids)
                left, right = kids
                self.one.append(self.one[left] and self.one[right] and self.find(lo) == self.find(self.nodes[right][0]))
            else:
                self._leaf(lo, hi, lo, hi)
                self.one.append(len({self.find(i) for i in range(lo, hi)}) == 1)

    def _pair(self, a: int, b: int) -> None:
        """Join what is near between two disjoint nodes. seen: bits compared above; spent: how many of them differ."""
        todo = [(a, b, 0, 0)]
        while todo:
            a, b, seen, spent = todo.pop()
            alo, ahi, akids, ashared, aval, _ = self.nodes[a]
            blo, bhi, bkids, bshared, bval, _ = self.nodes[b]
            if self.one[a] and self.one[b] and self.find(alo) == self.find(blo):
                continue
            both = ashared & bshared
            spent += ((aval ^ bval) & both & ~seen).bit_count()
            if spent > self.max_bits:
                continue
            if spent + (self.full & ~both).bit_count() <= self.max_bits:
                self._join(alo, ahi)
                self._join(blo, bhi)
                self.union(alo, blo)
            elif akids and (not bkids or ahi - alo >= bhi - blo):
                todo += [(k, b, both, spent) for k in akids]
            elif bkids:
                todo += [(a, k, both, spent) for k in bkids]
            else:
                self._leaf(alo, ahi, blo, bhi)

    def _leaf(self, alo: int, ahi: int, blo: int, bhi: int) -> None:
        apart = np.bitwise_count(self.codes[alo:ahi, None] ^ self.codes[None, blo:bhi])
        for i, j in np.argwhere(apart <= self.max_bits).tolist():
            self.union(alo + i, blo + j)

    def labels(self) -> np.ndarray:
        """A component number for each code, in the order they were given."""
        out = np.empty(len(self.codes), dtype=np.int64)
        out[self.order] = [self.find(i) for i in range(len(self.codes))]
        return out


def _group_links(codes: np.ndarray, reps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    labels = GrayIndex(codes, max_bits).labels()
    order = np.lexsort((reps, labels))
    labels, reps = labels[order], reps[order]
    first = np.r_[True, labels[1:] != labels[:-1]]
    heads = reps[np.maximum.accumulate(np.where(first, np.arange(len(reps)), 0))]
    return [(h, r) for h, r in zip(heads.tolist(), reps.tolist(), strict=True) if h != r]


def _dealt(reps: DataFrame, max_bits: int, most_members: int) -> DataFrame:
    """(t, key, part, fp, rep): every fingerprint in each of its groups.

    A group of more than ``most_members`` is cut by a hash into shares of half that size, and each pair of shares, and
    each share with itself, is a part of its own: all pairs of members meet in some part, and no part outgrows a task.
    """
    masks = block_masks(max_bits)
    groups = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks))))
    dealt = reps.select("fp", "rep", groups.alias("g")).select("g.t", "g.key", "fp", "rep")
    total = reps.count()
    if total <= most_members:
        return dealt.select("t", "key", F.lit(0).cast("long").alias("part"), "fp", "rep")
    # sums over bins of groups tell where a crowded group can be; there are at most len(masks) * total / most_members
    bins = F.pmod(F.xxhash64("t", "key"), F.lit(max(1 << 16, 4 * len(masks) * total // most_members)))
    work = Workspace(reps.sparkSession, "dealt")
    full = few_broadcast(work.table("full", dealt.groupBy(bins.alias("bin")).count().where(F.col("count") > most_members).select("bin")))
    counted = dealt.withColumn("bin", bins).join(full, "bin", "left_semi").groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > most_members)
    crowded = few_broadcast(work.table("crowded", counted.select("t", "key", F.ceil(F.col("n") / (most_members / 2)).alias("k"))))
    shares = dealt.join(crowded, ["t", "key"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("k"))
    each = shares.select("t", "key", "fp", "rep", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
    return each.select("t", "key", (F.least("own", "other") * (1 << 31) + F.greatest("own", "other")).alias("part"), "fp", "rep")


def fingerprint_links(reps: DataFrame, max_bits: int = 4, most_members: int = 1 << 14) -> DataFrame:
    """(src, dst): links that connect the same fingerprints as all pairs at most ``max_bits`` apart would.

    reps: distinct (fp long, rep long), rep naming the fingerprint. most_members: fingerprints that one index
    holds; its walk takes the square of that at worst, some seconds for unrelated codes.
    """
    group = ["t", "key", "part"]
    dealt = _dealt(reps, max_bits, most_members).repartition(*group).sortWithinPartitions(*group)

    def links(batches):
        held: list[pd.DataFrame] = []  # the rows of the group that the last batch ended in

        def judged(rows: pd.DataFrame) -> pd.DataFrame:
            t, key, part, fp, rep = (rows[c].to_numpy() for c in (*group, "fp", "rep"))
            codes, out = fp.view(np.uint64), []
            at = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1]), True])
            size = np.diff(at)
            two = at[:-1][size == 2]
            near = two[np.bitwise_count(codes[two] ^ codes[two + 1]) <= max_bits]
            out += zip(np.minimum(rep[near], rep[near + 1]).tolist(), np.maximum(rep[near], rep[near + 1]).tolist(), strict=True)
            for lo, n in zip(at[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                out += _group_links(codes[lo : lo + n], rep[lo : lo + n], max_bits)
            return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

        for batch in batches:
            if not len(batch):
                continue
            if held and held[-1][group].iloc[-1].equals(batch[group].iloc[-1]):
                held.append(batch)  # one group spans the batches
                continue
            rows = pd.concat([*held, batch]) if held else batch
            last = (rows[group] == rows[group].iloc[-1]).all(axis=1)
            held = [rows[last]]
            yield judged(rows[~last]) if (~last).any() else pd.DataFrame({"src": [], "dst": []}, dtype="int64")
        if held:
            yield judged(pd.concat(held))

    return dealt.mapInPandas(links, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: its id, ``fp`` (long, 64 bits), ``fingerprint`` (16 hex digits) and ``component_id``.

    component_id is the smallest id that links reach, the row's own included; fingerprints at most ``max_bits``
    bits apart link, each for itself where rows of several share an id. Null or blank texts have fingerprint 0 and link like others; texts of any length are read whole.
    Rows with a null id are kept: they take the component of their fingerprint (null when no row of it has an id) but
    name none. Repeated ids give a row each. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    return _judged(docs, id_col, text_col, words_per_shingle, max_bits).drop("of")


def _judged(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int = 4, max_bits: int = 4, of: Column | None = None) -> DataFrame:
    """What :func:`near_duplicates` returns, with a column ``of`` of the row."""
    work = Workspace(docs.sparkSession, "simhash")
    prints = docs.select(F.col(id_col).cast("long").alias("id"), simhash(F.col(text_col), words_per_shingle).alias("fp"), *([] if of is None else [of.alias("of")]))
    with session_settings(docs.sparkSession, SMALL_BATCHES):
        rows = work.table("fingerprints", prints)
    reps = work.table("reps", rows.groupBy("fp").agg(F.min("id").alias("rep")))
    links = work.table("links", fingerprint_links(reps.where("rep is not null").select("fp", F.col("fp").alias("rep")), max_bits))
    parts = work.table("parts", connected_components(links).withColumnRenamed("node", "fp"))
    least = work.table("least", parts.join(reps, "fp").groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n")))
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = reps.join(join_counted(parts, least, "component", total).select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *([] if of is None else ["of"])
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id stays.

    All columns of ``docs`` stay, whatever their names. Rows are judged by id and text: of two texts under one id, each
    goes or stays by its own component. Rows of a component that have no id go if any of its rows has one, else all
    stay. Rows alike in id and text share one fate. An empty table stays empty.
    """
    found = _judged(docs, id_col, text_col, of=text_key(docs[text_col]), **options)
    gone = found.where(F.col("component_id").isNotNull() & (F.col(id_col).isNull() | (F.col(id_col) != F.col("component_id"))))
    return with_columns_kept(docs, gone.select(id_col, "of"), id_col, text_key(docs[text_col]))
