"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton of a set of items holds every run of words of any item. A document's words are streamed through it;
after each word the state tells the longest run that ends there and occurs in an item. Runs of ``window`` words or
more are hits, and so are items shorter than a window that end there whole.

Test sets are small beside a corpus, but nothing here counts on it: items go into automata of at most
``max_words`` words each, on average (a longer item alone is not cut), which bounds its states by about twice as many and
its memory by some 130 MB; one automaton at a time is gathered and broadcast,
and the documents are matched against each. With one automaton, the usual case, the documents are read once.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.tables import bound_batches
from narrata.plans.storage import Workspace

WORD_BYTES = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: Lower-cases A-Z and turns whatever cannot be in a word into a space.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c in WORD_BYTES else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TO_WORDS).split()


class SuffixAutomaton:
    """All runs of words of the items added; states know their longest run, and which items have their runs."""

    def __init__(self, window: int = 10) -> None:
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.prefixes: list[tuple[object, list[int]]] = []
        self.whole: dict[int, list[tuple[int, object]]] = {}

    def add(self, item: object, words: list[bytes]) -> None:
        """Items without words are ignored; repeated items count as one wherever their ids are equal."""
        if not words:
            return
        state, path = 0, []
        for w in words:
            state = self._extend(state, self.vocabulary.setdefault(w, len(self.vocabulary)))
            path.append(state)
        self.prefixes.append((item, words))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state({}, length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, edges: dict[int, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def seal(self) -> SuffixAutomaton:
        """After the last item: the items of each state whose runs are a window long, and short items by state."""
        items: list[set] = [set() for _ in self.next]
        self.short: list[tuple[tuple[int, object], ...]] = [()] * len(self.next)
        for item, words in self.prefixes:
            state = 0
            for w in words:
                state = self.next[state][self.vocabulary[w]]
                at = state
                while at > 0 and self.length[at] >= self.window and item not in items[at]:
                    items[at].add(item)
                    at = self.link[at]
            if len(words) < self.window:  # the state of the run that is the whole item
                self.short[state] = (*self.short[state], (len(words), item))
        self.items = [frozenset(x) for x in items]
        self.prefixes = []
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        self.at_window = [0] * len(self.next)  # where the last ``window`` words of a state's runs are
        for s in order[1:]:
            up = self.link[s]
            if up > 0 and self.short[up]:
                self.short[s] = (*self.short[s], *(x for x in self.short[up] if x not in self.short[s]))
            self.at_window[s] = self.at_window[up] if self.length[up] >= self.window else s
        return self

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Disjoint spans [begin, end) of hit words in order, and the items that hit them."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        state = run = 0
        get = self.vocabulary.get
        for i, c in enumerate(map(get, words)):
            if c is None:
                state = run = 0
                continue
            edges = nxt[state]
            while c not in edges:
                if not state:
                    break
                state = link[state]
                run = length[state]
                edges = nxt[state]
            else:
                state = edges[c]
                run += 1
                begin = i + 1
                if run >= window:
                    begin = i + 1 - run
                    found |= self.items[self.at_window[state]]
                for size, item in short[state]:
                    if size <= run:
                        begin = min(begin, i + 1 - size)
                        found.add(item)
                if begin <= i:
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, i + 1))
                continue
            state = run = 0
        return spans, found


def _automata(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_words: int):
    """The automata, one after another; items are dealt to them by the words before them."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(text_col, F.lit("")).alias("text"))
    size = F.regexp_count("text", F.lit(WORD.pattern))
    whole = items.agg(F.sum(size)).first()[0] or 0
    shards = max(1, -(-whole // max_words))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))
    for shard in range(shards):
        automaton = SuffixAutomaton(window)
        for row in dealt.where(F.col("shard") == shard).orderBy("item", "text").toLocalIterator():
            automaton.add(row["item"], words_of(row["text"]))
        yield automaton.seal(), shard == shards - 1


def match_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, max_words: int = 200_000) -> DataFrame:
    """One row per row of ``docs``: id, n_words, spans (array of begin and end, in words), items (sorted strings).

    Null texts have no words. An item of fewer words than ``window`` is one window, an item without words none;
    items with a null id count as one without a name. Texts of any length are read whole, in batches bounded by bytes.
    Repeated rows and ids give a row each. Other columns are not read. Empty tables: no rows, or no hits.
    """
    bound_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "decontaminate")
    out, found = docs.select(F.col(id_col), F.col(text_col).alias("__text")), None
    for k, (automaton, last) in enumerate(_automata(benchmark, item_col, item_text_col, window, max_words)):
        out = out.withColumn("__m", _matcher(docs.sparkSession.sparkContext.broadcast(automaton))(F.col("__text")))
        spans, items = F.col("__m.spans"), F.col("__m.items")
        if k:
            spans, items = merged_spans(F.array_sort(F.concat("spans", spans))), F.array_sort(F.array_union("items", items))
        out = out.withColumns({"n_words": F.col("__m.n_words"), "spans": spans, "items": items}).drop("__m")
        if not last:  # one automaton at a time in memory
            out = work.table(f"after-{k % 2}", out)
    return out.drop("__text")


def _matcher(shared):
    @F.pandas_udf("n_words long, spans array<array<int>>, items array<string>")
    def matched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = words_of(t)
            spans, items = shared.value.match(words)
            rows.append((len(words), [list(s) for s in spans], sorted("" if x is None else x for x in items)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return matched


def _cut_text(text, spans):
    @F.pandas_udf("string")
    def shortened(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut(t, [(int(b), int(e)) for b, e in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return shortened(text, spans)


def merged_spans(spans):
    """Sorted spans that may overlap, as disjoint ones."""
    none = F.array().cast("array<array<int>>")

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))[1] >= s[0]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, none, add)


def hit_counts(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What :func:`match_items` found, as counts: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans, and what stands between the words of one span."""
    if not spans or text is None:
        return text
    places, out, at = [m.span() for m in WORD.finditer(text)], [], 0
    for begin, end in spans:
        out.append(text[at : places[begin][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def remove_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, most_covered: float = 0.5, max_words: int = 200_000, length_col: str | None = None) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut out of the texts, all columns stay.

    A document of which more than ``most_covered`` of the words are hit goes as a whole. Null and empty texts stay
    as they are. length_col: a column with the number of code points, set anew where a text was cut. All automata
    read the input's texts; their spans are merged before anything is measured or cut, so ``max_words`` changes no result.
    """
    bound_batches(docs.sparkSession)
    work, out = Workspace(docs.sparkSession, "decontaminate"), docs
    m, n_words, held, new = free_names(docs.columns, "m", "words", "spans", "new")
    for k, (automaton, last) in enumerate(_automata(benchmark, item_col, item_text_col, window, max_words)):
        matched = _matcher(docs.sparkSession.sparkContext.broadcast(automaton)).asNondeterministic()  # else the optimizer would copy it into the filter on its result
        out = out.withColumn(m, matched(F.col(text_col)))
        spans = F.col(m)["spans"]
        if k:
            spans = merged_spans(F.array_sort(F.concat(held, spans)))
        out = out.withColumns({n_words: F.col(m)["n_words"], held: spans}).drop(m)
        if not last:
            out = work.table(f"after-{k % 2}", out)
    n_hit = F.aggregate(held, F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    out = out.where(n_hit / F.greatest(F.lit(1), n_words) <= most_covered)
    out = out.withColumn(new, F.when(F.size(held) > 0, _cut_text(F.col(text_col), F.col(held))).otherwise(F.col(text_col)))
    changed = {text_col: F.col(new)}
    if length_col:
        cut_short = ~F.col(new).eqNullSafe(F.col(text_col))
        changed[length_col] = F.when(cut_short, F.char_length(new).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return out.withColumns(changed).select(*(F.col(f"`{c}`") for c in docs.columns))


def free_names(taken: list[str], *names: str) -> list[str]:
    """Column names that no column of a table has, in any case of letters."""
    prefix, used = "__", [c.lower() for c in taken]
    while any(c.startswith(prefix) for c in used):
        prefix += "_"
    return [prefix + n for n in names]
