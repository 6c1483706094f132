"""Archives, rules for URLs, substrings, lines: small cases with known answers."""

import gzip

import pytest
from pyspark.sql import functions as F

from narrata.llm import substrings, urls, warc


def test_records_round_trip():
    raw = warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:1>", "WARC-Payload-Digest": "sha1:" + warc.sha1_base32(b"hi")}, b"HTTP/1.1 200 OK\r\n\r\nhi")
    chunks = [bytes([b]) for b in raw + raw]
    records = list(warc.read_records(chunks))
    assert len(records) == 2 and records[0].block.endswith(b"hi")
    with pytest.raises(ValueError):
        list(warc.read_records([raw[:-9]]))
    assert warc.sha1_base32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert gzip.decompress(raw).startswith(b"WARC/1")


def test_pages_round_trip(spark):
    rows = [(3, "http://a/", "<p>ä</p>"), (1, "http://b/", "<p>ä</p>"), (2, None, None), (5, "u", ""), (3, "http://a/", "<p>ä</p>")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, refers_to string")
    got = sorted(tuple(r) for r in warc.page_rows(warc.round_trip(pages)).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    assert got == [(1, 9, "response", None), (2, 0, "response", None), (3, 9, "revisit", 1), (3, 9, "revisit", 1), (5, 0, "revisit", 2)]
    assert warc.page_rows(warc.round_trip(pages.limit(0))).count() == 0


def member(page, payload, revisits=None):
    return warc.page_record(page, "http://a/", payload, revisits, 6)


def test_damaged_members_are_reported():
    """Reading goes on with the next member, whatever the chunks; only the damaged one is lost."""
    whole = [member(i, bytes([65 + i]) * 3000 + b"x") for i in range(4)]
    broken = whole[1][:40] + b"\x00\xff\x13\x37" + whole[1][44:]
    for size in (1, 7, 100, 1 << 16):
        raw = whole[0] + broken + whole[2] + whole[3][:-9]
        records = list(warc.read_records((raw[i : i + size] for i in range(0, len(raw), size)), strict=False))
        good = [r for r in records if not r.problems]
        assert [r.headers["warc-record-id"] for r in good] == ["<urn:page:0>", "<urn:page:2>"] and len(records) >= 4


def test_archive_of_300_mb_is_read_in_chunks():
    import os
    import tracemalloc

    one = warc.record_bytes({"WARC-Type": "resource", "WARC-Block-Digest": "sha1:x"}, os.urandom(1 << 20), level=0)
    chunks = (one[i : i + warc.CHUNK] for _ in range(300) for i in range(0, len(one), warc.CHUNK))
    tracemalloc.start()
    n = sum(len(r.block) for r in warc.read_records(chunks))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300 << 20 and peak < 16 << 20


def test_archives_that_do_not_verify(spark, tmp_path):
    """A changed block of a revisit, a revisit of a payload its response has not, of a page that is missing, and garbage."""
    altered = warc.record_bytes({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:page:2>", "WARC-Block-Digest": "sha1:WRONG", "WARC-Refers-To": "<urn:page:1>", "WARC-Payload-Length": "1", "WARC-Payload-Digest": "sha1:" + warc.sha1_base32(b"a")}, b"HTTP/1.1 200 OK\r\n\r\n")
    records = [member(1, b"a"), altered, member(3, b"b", 1), member(4, b"a", 9), member(5, b"a", 1), gzip.compress(b"no record")]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(records))
    got = warc.check_revisits(warc.read_archives(spark, f"file://{tmp_path}")).collect()
    assert {r["record_id"]: list(r["problems"]) for r in got} == {
        "urn:page:1": [], "urn:page:2": ["warc-block-digest"], "urn:page:3": ["warc-refers-to"], "urn:page:4": ["warc-refers-to"], "urn:page:5": [],
        None: ["no WARC record at the start of a gzip member"],
    }
    with pytest.raises(Exception, match="does not verify"):
        warc.page_rows(warc.read_archives(spark, f"file://{tmp_path}")).collect()


def test_long_pages_and_names_that_clash(spark):
    rows = [(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000), (None, None, "z"), (None, None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("q") for c in ("id", "n", "part", "refers_to", "archive", "record_id", "problems")})
    got = [tuple(r) for r in warc.page_rows(warc.round_trip(pages)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == [(1, 6_000_000, "response", None), (2, 6_000_000, "revisit", 1), (None, 1, "response", None), (None, 1, "response", None)]


def plain_verdict(host, path, rules):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits) if fits else None


def test_many_rules(spark):
    """Ten thousand rules against a plain loop over all of them."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    rules = tuple({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((".".join(word() for _ in range(rng.randint(1, 2))), "/" + "".join(word() + "/" for _ in range(rng.randint(0, 2)))) for _ in range(14_000))}.values())
    assert len(rules) >= 10_000
    urls_ = [(i, f"http://{'.'.join(word() for _ in range(3))}/{word()}/{word()}/{word()}") for i in range(200)] + [(900, None), (901, "x" * 3_000_000), (902, "http://a.b/" + "y" * 3_000_000)]
    frame = spark.createDataFrame([(i, u, "z") for i, u in urls_], "page_id long, url string, host string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(frame, rules=rules, patterns=()).collect()}
    for i, u in urls_:
        rest = (u or "").partition("://")[2]
        host, _, path = rest.partition("/")
        best = plain_verdict(host, "/" + path if "/" in rest else "", rules)
        assert got[i] == ((best[1], best[2]) if best else (None, "allow"))
    assert sum(r is not None for r, _ in got.values()) > 50


def test_urls(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "http://EN.example.net/en/a?b#c": ("en.example.net", "/en/a", "example.net/en/", "allow"),
        "https://notexample.net": ("notexample.net", "", None, "allow"),
        "http://example.com/de/x": ("example.com", "/de/x", "example.com/de/", "block"),
        "http://badexample.com/de/x": ("badexample.com", "/de/x", None, "allow"),
        "http://w.org/fr/login/": ("w.org", "/fr/login/", "org/fr/", "allow"),
        "http://w.org/login/": ("w.org", "/login/", None, "block"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge(pages.limit(0)).count() == 0 and set(urls.keep_allowed(pages).columns) == set(pages.columns)


def plain_cut(docs, window):
    split = {i: (t or "").split() for i, t in docs}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k : k + window]), i)
    out = {}
    for i, words in split.items():
        gone = {k + j for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] < i for j in range(window)}
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def test_substrings_in_many_batches(spark):
    import random

    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))) for i in range(120)] + [(200, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = substrings.dedup_substrings(frame, window=5, batches=3).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"] or "") for r in got} == plain_cut(docs, 5)
    assert sum(r["n_removed"] for r in got) > 0
    # one run is left after each batch but the first; a column of the operator's own name is replaced
    index, kept = substrings.FingerprintIndex(spark, 5, most_runs=1), {}
    for part in ("doc_id < 60", "doc_id >= 60 and doc_id < 110", "doc_id >= 110"):
        out = index.add(frame.where(part).withColumn("n_words", F.lit("z")))
        kept |= {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"] or "") for r in out.collect()}
    assert kept == plain_cut(docs, 5) and len(index.runs) == len(index.windows) == 1
    with pytest.raises(ValueError):
        index.add(frame.where(F.col("doc_id") == 3))
