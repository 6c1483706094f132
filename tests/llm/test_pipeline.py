"""The corpus pipeline, each stage held against what it was given."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from narrata.llm import decontaminate, quality, similar, simhash, urls
from narrata.llm.tables import table


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    names, kept, seen = [n for n, _ in corpus_pipeline.STAGES], docs, {}
    assert names == ["quality", "exact", "near", "benchmark", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf).persist()
        seen[name] = (rows(kept), out)
        if name != "mixing":
            assert set(out.columns) == set(docs.columns)
        kept = out
    before, after = seen["quality"][0], rows(seen["quality"][1])
    scores = {r["doc_id"]: r["score"] for r in quality.classify(docs, table(spark, sf, "labels")).collect()}
    assert set(after) == {i for i in before if scores[i] >= 0.5} and len(after) > len(before) / 2

    before, after = after, rows(seen["exact"][1])
    groups = {}
    for i, r in before.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append((-len(r["text"] or ""), i))
    assert set(after) == {min(g)[1] for g in groups.values()}

    before, after = after, rows(seen["near"][1])
    prints = {i: simhash.fingerprint_of(r["text"]) for i, r in before.items()}
    assert {i for i in before if not any(j < i and (prints[i] ^ prints[j]).bit_count() <= 4 for j in before)} >= set(after)
    sets = {i: shingles(r["text"]) for i, r in before.items()}
    alike = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    assert all(any(j < i and alike(i, j) for j in before) for i in set(before) - set(after))
    assert not any(j < i and alike(i, j) for i in after for j in after)

    before, after = after, rows(seen["benchmark"][1])
    assert set(after) <= set(before) and all(r["n_chars"] == len(r["text"]) for i, r in after.items() if r["text"] != before[i]["text"])
    mixed = seen["mixing"][1].collect()
    assert {r["doc_id"] for r in mixed} <= set(after) and max(r["mix_copy"] for r in mixed) <= 3
    total = sum(len(r["text"].split()) for r in after.values())
    assert abs(sum(len(r["text"].split()) for r in mixed) - total) <= total / 10


def test_rows_that_share_an_id_or_have_none(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    docs = spark.createDataFrame([(1, a), (5, a + " x"), (5, b), (None, a), (None, c), (7, c)], "doc_id long, text string").withColumn("__m", F.lit(1)).withColumn("of", F.lit(2))
    want = [(1, a), (5, b), (7, c)]
    for keep in (simhash.keep_one, lambda d: similar.keep_one(d.where("doc_id is not null"))):
        got = keep(docs).select("doc_id", "text").collect()
        assert sorted(map(tuple, got)) == want, keep
    assert {tuple(r) for r in similar.keep_one(docs).select("doc_id", "text").collect()} == {*want, (None, a), (None, c)}
    items = spark.createDataFrame([(1, " ".join(f"c{i}" for i in range(12)))], "item_id long, text string")
    cut = decontaminate.remove_items(docs, items)
    assert cut.columns == docs.columns and {r["text"] for r in cut.where("doc_id = 7").collect()} == {" " + " ".join(f"c{i}" for i in range(12, 40))}
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://ok.com/"), (None, "http://b.net/"), (None, "http://fine.com/"), (2, None)], "page_id long, url string")
    assert {r["url"] for r in urls.keep_allowed(pages).collect()} == {"http://ok.com/", "http://fine.com/", None}
