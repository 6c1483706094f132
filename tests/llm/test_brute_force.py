"""Operators beyond SQL against models written plainly."""

import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from narrata.llm import mixing, pii, quality, queries, simhash
from tests.compare import of_spark

SPACE = " \t\n\x0b\x0c\r"


def plain_words(text):
    return [w for w in re.split("[" + SPACE + "]+", text or "") if w]


def plain_fingerprint(text):
    words = plain_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_near_duplicates_of_a_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    assert len(set(want.values())) < len(want)


def test_links_of_dense_and_chained_fingerprints(spark):
    base = 0x0123456789ABCDEF
    codes = [base ^ (1 << i) for i in range(40)]  # all within two bits of each other
    chain = [base ^ 0xFFFF000000000000 ^ ((1 << 4 * k) - 1) for k in range(8)]  # each four bits from the next
    codes = sorted({c - (1 << 64) if c >> 63 else c for c in codes + chain})
    reps = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "fp long, rep long")
    links = {(min(r), max(r)) for r in simhash.fingerprint_links(reps, 4).collect()}
    near = lambda a, b: ((codes[a] ^ codes[b]) & (1 << 64) - 1).bit_count() <= 4
    nodes = list(range(len(codes)))
    assert components(nodes, lambda a, b: (a, b) in links) == components(nodes, near)
    assert len(links) < len(nodes) * 3  # not all pairs


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights, left, open_, target = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total >= 3 * sizes[s] - 1e-9}
        if not full:
            target |= {s: left * weights[s] / total for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    sizes = {i: len(plain_words(r["text"])) for i, r in rows.items()}
    source = defaultdict(int)
    for i, r in rows.items():
        source[r["source"]] += sizes[i]
    target, got = plain_targets(source), queries.op3_mixing(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(rows) and len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        s = rows[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (sizes[r["doc_id"]], source[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
    largest = max(sizes.values())
    assert all(abs(taken[s] - target[s]) <= largest for s in target)
    again = mixing.mix_plan(docs.repartition(7)).select("doc_id", "copies").collect()
    assert {tuple(r) for r in again} == {(r["doc_id"], r["copies"]) for r in got}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op6_quality(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    from zlib import crc32

    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.9


def test_quality_takes_nulls_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, "")], "doc_id long, text string")
    got = quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == 4 and len({r["score"] for r in got}) == 1
    assert quality.keep_good(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def luhn(digits):
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def test_pseudonyms(spark):
    rows = [
        (1, "card 4111 1111 1111 1111 and ip 10.1.2.3, born 1999-12-31."),
        (2, "again 10.1.2.3; 10.1.2.4; 4111 1111 1111 1112; 999.1.1.1; 1999-13-45"),
        (3, None),
        (4, ""),
        (5, "mail ann.b7@example.org, ssn 123-45-6789, born 31/12/1999"),
        (5, "mail ann.b7@example.org, ssn 123-45-6789, born 31/12/1999"),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = sorted((r.asDict() for r in pii.pseudonymise(docs, "k").collect()), key=lambda r: (r["doc_id"], r["text"] or ""))
    assert [r["n_pii"] for r in got] == [3, 2, 0, 0, 3, 3] and got[2]["text"] is None and got[3]["text"] == "" and got[4] == got[5]
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) ", got[0]["text"])[1]
    assert luhn(card.replace(" ", "")) and card != "4111 1111 1111 1111"
    ip = re.search(r"ip ([\d.]+),", got[0]["text"])[1]
    assert ip != "10.1.2.3" and all(int(x) < 256 for x in ip.split(".")) and f"again {ip};" in got[1]["text"]
    assert "4111 1111 1111 1112; 999.1.1.1; 1999-13-45" in got[1]["text"]
    import datetime

    datetime.date.fromisoformat(re.search(r"born (\S+)\.", got[0]["text"])[1])
    assert re.search(r"mail [a-z]{3}\.[a-z]\d@example\.org, ssn \d{3}-\d{2}-\d{4}, born \d\d/\d\d/\d{4}", got[4]["text"])


def test_pseudonyms_of_secrets(spark):
    """Quoted values as the tables have them, and the other ways to write a name and its value."""
    value = "04dbebab77c1e09f5a2b"
    forms = ['token = "{}"', "token = '{}'", "token = {}", "password:{}", '"api_key": "{}"', "'secret':'{}'"]
    docs = spark.createDataFrame([(i, f"a {f.format(value)}\nb") for i, f in enumerate(forms)] + [(9, f'TOKEN = "{value.upper()}"'), (10, 'token = ""')], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_pii"], r["text"]) for r in pii.pseudonymise(docs, "k").collect()}
    new = re.search('token = "(.*)"', got[0][1])[1]
    assert new != value and re.fullmatch("[0-9a-f]{20}", new)
    assert got == {i: (1, f"a {f.format(new)}\nb") for i, f in enumerate(forms)} | {9: (1, f'TOKEN = "{new.upper()}"'), 10: (0, 'token = ""')}


def test_pseudonyms_are_bijections(spark):
    n = 100
    values = spark.range(n * n).select(F.col("id"), pii.feistel((F.col("id") / n).cast("long"), F.col("id") % n, F.lit(n), F.lit(n), "k", "t").alias("p"))
    assert values.select("p.l", "p.r").distinct().count() == n * n
    assert values.where("p.l not between 0 and 99 or p.r not between 0 and 99").count() == 0


def test_cuts_do_not_depend_on_the_number_of_automata(spark):
    """Items that overlap in a text, words that a cut would bring together, and a document that only all items cover."""
    from narrata.llm import decontaminate

    items = [(1, "a b c d"), (2, "c d e f"), (3, "x y z"), (4, "g h i"), (5, "p q r")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "1 2 3 4 5 6 7 8 A b, c d e f. 9", "1 2 3 4 5 6 7 8 . 9"),
        (2, "1 2 3 4 5 6 7 8 x y a b c d z", "1 2 3 4 5 6 7 8 x y  z"),
        (3, "1 2 3 g h i 4 p q r", None),
        (4, None, None),
        (5, "", ""),
    ]
    docs = spark.createDataFrame([(i, len(t or ""), t) for i, t, _ in rows], "doc_id long, n_chars long, text string")
    want = {(i, len(t or ""), t) for i, _, t in rows if i != 3}
    for most in (1, 10, 20_000_000):
        got = decontaminate.remove_items(docs, bench, window=3, max_words=most, length_col="n_chars")
        assert got.columns == docs.columns and {tuple(r) for r in got.collect()} == want


def test_edges_give_rows(spark):
    """Nulls, empty and repeated rows, empty tables and clashing columns, for every operator on documents."""
    from narrata.llm import decontaminate, exact, lines, substrings

    rows = [(1, "a b c d e", "s"), (2, None, None), (3, "", "s"), (1, "a b c d e", "s"), (None, "x y", "s"), (7, "w " * 5000, None)]
    kept = "doc_id long, text string, source string"
    clash = ("id", "fp", "rep", "gone", "kept", "w1", "size", "ord", "at", "length", "h", "taken", "n_words", "copies")
    docs = spark.createDataFrame(rows, kept).withColumns({c: F.lit("z") for c in clash})
    bench = spark.createDataFrame([(1, "c d e"), (2, None), (None, "")], "item_id long, text string")
    for frame, n in ((docs, len(rows)), (docs.limit(0), 0)):
        assert simhash.near_duplicates(frame).count() == n
        assert mixing.mix_plan(frame).count() == n
        assert exact.exact_duplicates(frame).count() == n
        assert decontaminate.match_items(frame, bench).count() == n
        assert len(of_spark(substrings.dedup_substrings(frame, window=3))[1]) == n
        assert len(of_spark(lines.dedup_lines(frame))[1]) == n
    hit = {r["doc_id"]: r["n_hit"] for r in decontaminate.hit_counts(decontaminate.match_items(docs, bench)).collect()}
    assert hit == {1: 3, 2: 0, 3: 0, None: 0, 7: 0}
    assert set(simhash.keep_one(docs).columns) == set(docs.columns) == set(exact.keep_one(docs).columns)
