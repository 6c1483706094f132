"""Exact and line duplicates: batches, collisions, hot keys, awkward rows; groups of fingerprints that are cut."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from narrata.llm import exact, lines, simhash

ROWS = [
    (1, "a b"), (2, "ab "), (3, "a  b"), (3, "a  b"), (None, "a   b"), (5, None), (6, ""), (7, " \n\t"), (None, None), (8, "ab "), (9, "x" * 5_000_000), (10, "x" * 5_000_000 + " "),
    *((100 + i, f"text {i % 7}") for i in range(60)),
]


def plain_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    return {b: (min(g)[2], len(g)) for b, g in groups.items()}


@pytest.mark.parametrize("options", [{}, {"batches": 4}, {"digest_chars": 1}, {"digest_chars": 1, "batches": 3}])
def test_exact(spark, options):
    """Repeats across batches; digests of one hexadecimal digit, which collide, so that the texts decide."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(6).withColumns({c: F.lit("z") for c in ("id", "n", "digest", "keeper", "file", "row", "body", "content", "n_chars", "kept")})
    want = plain_groups(ROWS)
    got = exact.exact_duplicates(docs, **options).collect()
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    sha = {hashlib.sha256(b.encode()).hexdigest(): b for b in want}
    seen = [(r["doc_id"], r["keep_id"], r["group_size"], sha[r["text_sha256"]]) for r in got]
    assert sorted(seen, key=repr) == sorted(((i, *want[normal(t)], normal(t)) for i, t in ROWS), key=repr)
    assert sum(r["kept"] for r in got) == len(want)
    kept = exact.keep_one(docs, **options)
    assert kept.columns == docs.columns
    assert sorted(((normal(r["text"]), r["doc_id"]) for r in kept.collect()), key=repr) == sorted(((b, i) for b, (i, _) in want.items()), key=repr)
    assert exact.exact_duplicates(docs.limit(0), **options).count() == exact.keep_one(docs.limit(0), **options).count() == 0


def plain_lines(docs, run=3):
    first, split = {}, [(i, [] if t is None else t.split("\n")) for i, t in docs]
    order = sorted((i, k, n) for n, (i, x) in enumerate(split) if i is not None for k in range(len(x) - run + 1))
    for i, k, n in order:
        first.setdefault(tuple(split[n][1][k : k + run]), (i, k))
    out = []
    for i, x in split:
        gone = {k + j for k in range(len(x) - run + 1) if i is not None and first[tuple(x[k : k + run])] != (i, k) for j in range(run)}
        out.append((i, len(x), len(gone), "\n".join(s for k, s in enumerate(x) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [0, 100_000])
@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_lines(spark, run, small):
    """Few different lines, so that runs overlap and repeat within texts; one run that most texts share."""
    rng = random.Random(run)
    docs = [(i, "\n".join([*(rng.choice("abcd") for _ in range(rng.randint(0, 12))), *(["hot 1", "hot 2", "hot 3", "hot 4", "hot 5"] if i % 3 else []), f"own {i}"])) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "a\nb\nc\n" * 2000), (None, docs[0][1])]
    frame = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, n_lines string").withColumns({c: F.lit("q") for c in ("id", "row", "start", "fp", "digest", "begin", "h", "w")})
    out = lines.dedup_lines(frame, run_lines=run, small=small)
    assert out.columns == [c for c in frame.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"] or "") for r in out.collect()), key=repr) == plain_lines(docs, run)
    assert lines.dedup_lines(frame.limit(0), run_lines=run).count() == 0


def test_runs_are_extended(spark):
    """A run is found whole, with the place where it stood first; rows that share an id keep their own lines."""
    docs = [(1, "p\nq\na\nb\nc\nd\ne\nr"), (4, "s\na\nb\nc\nd\ne\nt\nu"), (4, "own 1\nown 2\nown 3\nown 4"), (7, "d\ne\nt\nu\nv")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["id"], r["begin"], r["end"], r["first_id"], r["first_begin"]) for r in lines.repeated_runs(frame).collect())
    assert got == [(4, 1, 6, 1, 2), (7, 0, 4, 4, 4)]
    kept = {(r["doc_id"], r["text"]) for r in lines.dedup_lines(frame).collect()}
    assert kept == {(1, docs[0][1]), (4, "s\nt\nu"), (4, docs[2][1]), (7, "v")}


def test_long_text_of_lines(spark):
    text = "\n".join(f"line {i % 50_000}" for i in range(200_000))
    row = lines.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_lines"], row["n_removed"]) == (200_000, 150_000) and row["text"] == "\n".join(f"line {i}" for i in range(50_000))


@pytest.mark.parametrize("most", [4, 16, 1 << 20])
def test_crowded_groups_of_fingerprints(spark, most):
    rng = random.Random(5)
    codes = {0x0123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))) for _ in range(150)}
    codes = sorted(c - (1 << 64) if c >> 63 else c for c in codes)
    links = simhash.fingerprint_links(spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "fp long, rep long"), 4, most).collect()
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def joined(pairs):
        root[:] = range(len(codes))
        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return [find(i) for i in range(len(codes))]

    want = joined([(i, j) for i in range(len(codes)) for j in range(i) if ((codes[i] ^ codes[j]) & (1 << 64) - 1).bit_count() <= 4])
    assert joined([tuple(r) for r in links]) == want and 1 < len(set(want)) < len(codes)
