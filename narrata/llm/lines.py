"""Line deduplication by winnowing over line hashes, with DataFrame operations only.

Every run of ``run_lines`` lines is a window; the position of its smallest line hash (the last, of equal ones) is an
anchor, and that hash a fingerprint. Equal windows have equal anchors, so any run that occurs twice shares one, whatever
surrounds it, while a text has about two anchors for every four lines.

Anchors are joined by their fingerprints; those whose fingerprint occurs once are done with. From the others the match is
extended both ways, line by line, over the windows that have the anchor: windows are the same if the SHA-256 of their
lines is, and each is joined with the position where it stood first. Windows that continue each other, in the row and in
that first place alike, are one run, which ends where the lines differ. All but the first place lose their runs.

Counting and choosing the first combine before they shuffle; nothing pairs the occurrences of a line with each other.
Fingerprints and windows that very many rows share are joined by a broadcast of a bounded number of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.operators.skew import join_counted
from narrata.plans.storage import Workspace


def lines_of(text: Column) -> Column:
    """The lines of a text, unchanged, split at line feeds; null has none."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def _windows(docs: DataFrame, id_col: str, text_col: str, run_lines: int) -> DataFrame:
    """(id, row, start, fp, leads, digest): the windows of each row, by first line, with the fingerprint of their anchor.

    An anchor's windows stand together; the first of them leads.
    """
    text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    lines = lines_of(text[1])
    rows = docs.select(text[0].alias("id"), F.xxhash64(text[1]).alias("row"), lines.alias("lines"), F.transform(lines, lambda x: F.xxhash64(x)).alias("h"))
    rows = rows.where(F.size("h") >= run_lines)

    def window(i: Column) -> Column:
        part = F.slice("h", i + 1, F.lit(run_lines))
        from_end = F.array_position(F.reverse(part), F.array_min(part))
        digest = F.unhex(F.sha2(F.array_join(F.slice("lines", i + 1, F.lit(run_lines)), "\n"), 256))
        return F.struct(i.cast("int").alias("start"), (i - from_end).cast("int").alias("at"), F.array_min(part).alias("fp"), digest.alias("digest"))

    windows = rows.select("id", "row", F.transform(F.sequence(F.lit(0), F.size("h") - run_lines), window).alias("w"))
    leads = lambda x, i: F.when((i == 0) | (F.get("w", i - 1)["at"] != x["at"]), 1).otherwise(0)
    led = F.transform("w", lambda x, i: F.struct(x["start"].alias("start"), x["fp"].alias("fp"), leads(x, i).alias("leads"), x["digest"].alias("digest")))
    return windows.select("id", "row", F.explode(led).alias("w")).select("id", "row", "w.*")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_lines: int = 3, small: int = 100_000) -> DataFrame:
    """(id, row, begin, end, first_id, first_begin): runs [begin, end) of lines, from 0, that also start earlier, and where.

    A run has ``run_lines`` lines or more, and the same lines, in the same order, start in a row with a smaller id, or
    further up in the same text. Runs of one row may overlap where they come from different places. ``row`` tells rows
    that share an id apart: it is a hash of the text. Rows with a null id are not read. small: see ``join_counted``.
    """
    work = Workspace(docs.sparkSession, "lines")
    windows = work.table("windows", _windows(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col, run_lines))
    total = windows.count()
    shared = work.table("shared", windows.groupBy("fp").agg(F.count("*").alias("n"), F.sum("leads").alias("anchors")).where("anchors > 1").select("fp", "n"))
    near = work.table("near", join_counted(windows, shared, "fp", total, how="left_semi", small=small).select("id", "row", "start", "digest"))
    first = near.groupBy("digest").agg(F.min(F.struct("id", "start", "row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = work.table("first", first)
    later = join_counted(near, first, "digest", near.count(), small=small).where(~F.struct("id", "start", "row").eqNullSafe(F.col("first")))
    later = later.select("id", "row", "start", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"), (F.col("first.start") - F.col("start")).alias("shift"))
    # extension: windows that start one line after another, in both places, are one run
    beside = Window.partitionBy("id", "row", "first_id", "first_row", "shift").orderBy("start")
    runs = later.distinct().withColumn("run", F.col("start") - F.row_number().over(beside))
    runs = runs.groupBy("id", "row", "first_id", "first_row", "shift", "run").agg(F.min("start").alias("begin"), (F.max("start") + run_lines).alias("end"))
    return runs.select("id", "row", "begin", "end", "first_id", (F.col("begin") + F.col("shift")).alias("first_begin"))


def _disjoint(spans: Column) -> Column:
    """Sorted spans that may overlap or touch, as disjoint ones in descending order."""

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.lit(0))
        joined = F.concat(F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))), F.slice(done, F.lit(2), F.size(done)))
        return F.when((F.size(done) > 0) & (last["end"] >= s["begin"]), joined).otherwise(F.concat(F.array(s), done))

    return F.aggregate(spans, F.array().cast("array<struct<begin:int,end:int>>"), add)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_lines: int = 3, small: int = 100_000) -> DataFrame:
    """The columns of ``docs`` with the repeated runs cut out of the texts, and ``n_lines`` and ``n_removed``.

    A line goes if it lies in a run of ``run_lines`` consecutive lines that also starts earlier: in a row with a smaller
    id, or further up in the same text. Runs are judged on the input, not on what is left of it.

    Null texts stay null and have no lines; an empty text is one empty line. Rows with a null id never lose lines
    and never count as earlier. Of rows that share an id, the run that starts further up counts as earlier, then that of the
    smaller hash of the text; rows alike in both lose the same lines. Columns named ``n_lines`` or ``n_removed`` are replaced. An empty table gives no rows.
    """
    # begin and end of a row's runs: as many as the row has lines, at most
    spans = repeated_runs(docs, id_col, text_col, run_lines, small).groupBy("id", "row").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("__gone"))
    spans = spans.select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.reverse(_disjoint(F.col("__gone"))).alias("__gone"))
    text = F.col(f"`{text_col}`")
    mine = docs[f"`{id_col}`"].eqNullSafe(spans["__id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == spans["__row"])
    joined = docs.join(spans, mine, "left").withColumn("__lines", lines_of(text))
    # what stays lies between the spans
    begins = F.concat(F.array(F.lit(0)), F.transform("__gone", lambda s: s["end"]))
    ends = F.concat(F.transform("__gone", lambda s: s["begin"]), F.array(F.size("__lines")))
    kept = F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice("__lines", b + 1, e - b)))
    new = F.when(F.col("__gone").isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.aggregate("__gone", F.lit(0), lambda n, s: n + s["end"] - s["begin"]), F.lit(0)).cast("long")
    out = joined.withColumns({"__text": new, "__n_lines": F.size("__lines").cast("long"), "__n_removed": removed})
    kept_columns = [F.col("__text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*kept_columns, F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))
