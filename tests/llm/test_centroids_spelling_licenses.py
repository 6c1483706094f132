"""Centroids, spelling variants and license scans against plain models, and their edges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrata.llm import centroids, licenses, queries, spelling
from tests.compare import of_duckdb, of_spark

NEW = ("op11_centroids", "op12_spelling", "op13_licenses")


@pytest.mark.parametrize("name", NEW)
def test_larger_tables(spark, name):
    assert of_spark(queries.QUERIES[name](spark, "/root/testdata/sf0.01")) == of_duckdb(queries.ORACLES[name], "/root/testdata/sf0.01")


def plain_clusters(rows, k, rounds, dims, scale=1024):
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(v) for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in set(own):
            of = [v for (_, v), c in zip(kept, own, strict=True) if c == n]
            cents[n] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    return sorted(((i, *reversed(nearest(v))) for i, v in kept), key=repr)


def test_annulus_search_keeps_ties():
    rng = np.random.default_rng(4)
    for span, dims in ((2, 2), (3, 3), (900, 64)):
        x = rng.integers(-span, span + 1, (2000, dims))
        c = x[:11].copy()
        c[7] = c[2]
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        number, best = centroids.nearest(x, c)
        assert (best == d.min(axis=1)).all() and (number == d.argmin(axis=1)).all()


def test_clusters_with_edges(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.25, 1.0]), rng.uniform(-1, 1), 0.0]) for i in range(60)]
    rows += [(7, rows[7][1]), (8, [0.1, 0.2, 0.3]), (None, [0.0, 0.0, 0.0]), (61, None), (62, []), (63, [1.0, 2.0]), (64, [1.0, None, 2.0]), (65, [float("nan"), 0.0, 0.0]), (66, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit("x"), "cluster": F.lit(1), "id": F.lit(2)})
    for parts, k in ((1, 4), (5, 4), (3, 100)):
        got = centroids.cluster(df.repartition(parts), k=k, rounds=5, dims=3).collect()
        assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=repr) == plain_clusters(rows, k, 5, 3)
        assert {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}
    for none in (df.limit(0), df.where("vec_id = 61")):
        assert centroids.cluster(none, dims=3).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dims=2).collect()


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    return any(a[:i] == b[:i] and a[i + (len(a) == len(b)) :] == b[i + 1 :] for i in range(len(b)))


def test_every_near_pair_is_met(spark):
    rng = random.Random(9)
    for letters in ("ab", "abcé", "abcdefghij"):
        words = set()
        while len(words) < 250:
            w = "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))
            i = rng.randrange(len(w))
            words |= {w, w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + w[i + 1 :]}
        words = sorted(w for w in words if len(w) >= 4)
        got = {tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string").repartition(3)).collect()}
        assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)} and got


def test_spelling_forms_and_roots(spark):
    counts = {"colour": 700, "color": 3, "colours": 30, "coloura": 30, "colouraz": 2, "kolour": 140, "kolours": 5, "kolourss": 1, "lonely": 9, "aaaaaa": 50, "aaaaaaa": 10, "baaaaa": 9}
    got = {r["word"]: r for r in spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    for w, n in counts.items():
        near = sorted((-counts[v], v) for v in counts if one_edit(w, v))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        assert (got[w]["form"], got[w]["n_near"], got[w]["form_n"]) == (form, len(near), counts.get(form)), w
        root = w
        while (n := sorted((-counts[v], v) for v in counts if one_edit(root, v))) and -n[0][0] >= 5 * counts[root]:
            root = n[0][1]
        assert got[w]["root"] == root
    assert got["kolourss"]["root"] == "colour" and got["kolours"]["form"] == "kolour"
    assert spelling.spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(spark.createDataFrame([("abc", 1)], "word string, n long"))


def test_words_of_texts(spark):
    long = "Übergang " * 30000
    docs = spark.createDataFrame([(1, "The Éclair-ÉCLAIR x2y garden GARDEN"), (1, "garden"), (None, "garden"), (2, None), (3, ""), (4, long)], "doc_id long, text string").withColumns({"run": F.lit("z"), "word": F.lit(1)})
    assert dict(spelling.word_counts(docs, least_count=1).collect()) == {"Éclair": 2, "garden": 4, "Übergang": 30000}
    import zlib

    planted = Counter()
    for i, run, n in ((1, "Éclair", 2), (1, "garden", 3), ("", "garden", 1), (4, "Übergang", 30000)):
        h = zlib.crc32(f"{i}:{run}".encode())
        planted[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += n
    assert dict(spelling.word_counts(docs, least_length=4, least_count=1, every=3).collect()) == dict(planted)
    assert spelling.word_counts(docs.limit(0)).count() == 0


def test_licenses(spark):
    grant = licenses.GRANTS[0][0].split()
    shifted = [*grant[:9], "each", "and", "any", *grant[11:]]
    texts = [
        (1, "Released under the MIT License; the mit, license. THE APACHE LICENSE"), (2, None), (3, ""), (4, "mit"), (4, "general public licence, general public license"),
        (None, "apache license"), (None, "nothing"), (5, " ".join(["x"] * 7 + shifted)), (6, "permission is hereby granted free of charge"), (7, "GNU General Public License " * 20000), (1, "Released under the MIT License; the mit, license. THE APACHE LICENSE"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"of": F.lit(1), "id": F.lit("x"), "labels": F.lit("y"), "__of": F.lit(1)})
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) for r in licenses.scan(docs).collect())
    assert got == Counter({
        (1, 11, 3, 3, 9, "apache,mit", "apache,mit"): 2, (2, 0, 0, None, None, "", ""): 1, (3, 0, 0, None, None, "", ""): 1, (4, 1, 0, None, None, "", ""): 1, (4, 6, 1, 3, 3, "gpl", "gpl"): 1,
        (None, 2, 1, 0, 0, "apache", "apache"): 1, (None, 1, 0, None, None, "", ""): 1, (5, 7 + len(shifted), 0, None, None, "", "mit"): 1, (6, 7, 0, None, None, "", ""): 1, (7, 80000, 20000, 1, 79997, "gpl", "gpl"): 1,
    })
    spans = {(r["doc_id"], r["label"], r["start"], r["stop"]) for r in licenses.license_spans(docs).where("doc_id < 7").collect()}
    assert spans == {(1, "mit", 3, 5), (1, "mit", 6, 8), (1, "apache", 9, 11), (4, "gpl", 3, 6), (5, "mit", 7, 7 + len(shifted))}
    assert licenses.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, phrases=(("one", "x"),))
