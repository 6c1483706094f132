"""Near copies by shingles against brute force."""

import random

import corpus_pipeline
from narrata.llm import similar


def plain(text):
    w = (text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_no_near_pair_stays(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(200))
    texts = [None, "one", "one two", "a b c d e", "a b c d e f"]
    common = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([8, 40, 150]))]
        for edits in (0, 0, 1, 2, 3, 4):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join([*copy, "."] if edits else copy))
    texts += [" ".join(common + [word() for _ in range(9)]) for _ in range(12)]  # meet in many buckets, not near
    rng.shuffle(texts)
    sets = [plain(t) for t in texts]
    near = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for rounds in (6, 0):
        gone = {r["id"] for r in similar.similar_ids(docs, rounds=rounds).collect()}
        assert all(i in gone or j in gone for i, j in near) and gone <= {j for _, j in near} and len(gone) > 20
    empty = similar.keep_one(docs.limit(0))
    assert empty.count() == 0 and empty.columns == docs.columns


def test_near_stage_drops_what_four_bits_miss(spark):
    words = [f"w{i}" for i in range(120)]
    other = [*words[:40], "x", *words[41:90], "y", *words[91:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert len(plain(" ".join(words)) & plain(" ".join(other))) / len(plain(" ".join(words)) | plain(" ".join(other))) >= 0.8
    assert {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == {1, 3}
