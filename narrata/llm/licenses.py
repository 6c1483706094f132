"""License scans by diagonal voting: word k-grams of texts are joined to their places in templates.

A k-gram of a text that stands in a template votes for the diagonal of that place: its place in the text less its place in
the template, which is where the template would begin. Words put in or left out move later votes to a diagonal nearby, so
each diagonal is merged with the few that follow it, and the share of the template's places that voted there is its
coverage. Base phrases want one diagonal that is voted for whole. Votes join by hash and by the words themselves, so a
span is verified word by word where it is found.

Distribution. Templates are few and go to the texts, which stay where they are: only votes are shuffled, as numbers, and added
up before. A document's votes meet in one task, all the votes for one template at most, which its words bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.functions.text import let
from narrata.llm.tables import few_broadcast, text_key
from narrata.llm.urls import LOWER, UPPER
from narrata.operators.skew import join_counted
from narrata.plans.storage import Workspace

#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that give a label wherever their words stand.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Sentences by which licenses are granted, and the label of each.
GRANTS = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
)
K, SLACK, LEAST = 2, 3, 0.75
END = -1


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def rolling(words: Column, k: int) -> Column:
    """From each word on, the next ``k`` words joined by spaces, fewer at the end. The words are found once, not for each run."""
    return let(lambda w: F.transform(w, lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + j) for j in range(1, k)))), words)


def template_grams(spark: SparkSession, phrases=PHRASES, grants=GRANTS, k: int = K) -> DataFrame:
    """(template, label, base, places, at, gram): the k-grams of all templates; ``places`` is how many a template has."""
    rows = []
    for t, (text, label, base) in enumerate([(*p, True) for p in phrases] + [(*g, False) for g in grants]):
        words = text.split()
        if len(words) < k:
            raise ValueError(f"A template needs {k} words or more: {text!r}")
        rows += [(t, label, base, len(words) - k + 1, at, " ".join(words[at : at + k])) for at in range(len(words) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, places int, at int, gram string")


def votes(docs: DataFrame, id_col: str, text_col: str, grams: DataFrame, k: int) -> DataFrame:
    """(id, of, template, label, base, places, start, at, copies): for each diagonal, named by the word it would start at, the
    places of the template that stand there. Repeated rows are one document of so many copies. Each document has one more
    row, of template -1, whose start is its number of words: the end of a text is found like any other k-gram."""
    ended = F.concat(rolling(words_of(F.col(text_col)), k), F.array(F.lit("")))
    keyed = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("of"), ended.alias("grams"))
    found = keyed.select("id", "of", F.posexplode("grams").alias("pos", "gram"))  # the text's hash is not taken anew for each of its words
    held = few_broadcast(grams.unionByName(grams.sparkSession.createDataFrame([(END, None, None, 0, 0, "")], grams.schema)).withColumn("h", F.xxhash64("gram")))
    met = found.withColumn("h", F.xxhash64("gram")).join(held, ["h", "gram"])  # by the hash, and by the words
    return met.groupBy("id", "of", "template", "label", "base", "places", (F.col("pos") - F.col("at")).alias("start")).agg(F.collect_set("at").alias("at"), F.count("*").alias("copies"))


def coverages(found: DataFrame, slack: int) -> DataFrame:
    """Diagonals with their coverage: a phrase's own, a grant's with those up to ``slack`` further on."""
    found = found.where(F.col("template") != END)
    near = Window.partitionBy("id", "of", "template").orderBy("start").rangeBetween(0, slack)
    merged = F.array_distinct(F.flatten(F.collect_list("at").over(near)))
    held = F.when(F.col("base"), F.col("at")).otherwise(merged)
    end = F.col("start") + F.array_max("at")
    last = F.when(F.col("base"), end).otherwise(F.max(end).over(near))
    return found.select("id", "of", "template", "label", "base", "start", (F.size(held) / F.col("places")).alias("coverage"), last.alias("last"))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, grants=GRANTS, k: int = K, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """(id, of, label, base, start, stop, coverage): where templates stand, in words from 0; ``of`` tells the texts under
    one id apart. A phrase must stand whole; of a grant at least ``least``, and of diagonals that merge the best one is returned,
    the first of equals."""
    found = coverages(votes(docs, id_col, text_col, template_grams(docs.sparkSession, phrases, grants, k), k), slack)
    kept = found.where(F.when(F.col("base"), F.col("coverage") == 1).otherwise(F.col("coverage") >= least))
    around = Window.partitionBy("id", "of", "template").orderBy("start")
    best = F.max("coverage").over(around.rangeBetween(-slack, slack))
    before = F.coalesce(F.max("coverage").over(around.rangeBetween(-slack, -1)), F.lit(0.0))
    ranked = kept.withColumns({"best": best, "before": before}).where("base or (coverage = best and before < coverage)")
    return ranked.select(F.col("id").alias(id_col), "of", "label", "base", F.greatest("start", F.lit(0)).alias("start"), (F.col("last") + k).alias("stop"), "coverage")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, grants=GRANTS, k: int = K, slack: int = SLACK, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base (places of phrases), first_word and last_word (their smallest and
    largest start, else null), base_labels, labels (with those of grants; distinct, sorted, comma-joined), score.

    score is the greatest coverage of any template: 1 where a phrase stands; a grant gives its label from ``least`` on. Null
    and empty texts have no words and score 0; texts of any length are read whole. Repeated rows and ids and null ids give a
    row each, judged by their own texts. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "licenses")
    every = work.table("votes", votes(docs, id_col, text_col, template_grams(docs.sparkSession, phrases, grants, k), k))
    base = F.col("base") & (F.col("coverage") == 1)
    label = F.when(base | (~F.col("base") & (F.col("coverage") >= least)), F.col("label"))
    facts = coverages(every, slack).groupBy(F.col("id").alias("__id"), F.col("of").alias("__of")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"), F.collect_set(label).alias("labels"), F.max(F.when(~F.col("base") | base, F.col("coverage"))).alias("score"),
    )
    facts = few_broadcast(work.table("facts", facts))
    ends = every.where(F.col("template") == END).select("id", "of", F.col("start").cast("long").alias("n_words"), "copies")
    judged = ends.join(facts, ends["id"].eqNullSafe(facts["__id"]) & (ends["of"] == facts["__of"]), "left").drop("__id", "__of")
    # null ids get a key, too, and documents of very many copies are met by a broadcast, so no task has all of them
    key = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")).alias("key")
    judged = work.table("judged", judged.select(key, "of", *judged.columns[2:]))
    work.drop("votes", "facts")
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("of")).select(key, "id", "of")
    total = judged.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    out = join_counted(rows, judged, ["key", "of"], total, n="copies")
    joined = lambda c: F.array_join(F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>"))), ",")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", joined("base_labels").alias("base_labels"),
        joined("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
