"""The queries of the training-data operators, and DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm import centroids, decontaminate, exact, licenses, lines, mixing, pii, quality, simhash, spelling, substrings, urls, warc
from narrata.llm.tables import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.narrata.pii.key", "a key for the test tables")
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key).select("doc_id", "n_pii", "text")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_rows(warc.round_trip(table(spark, sf_dir, "pages")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hit_counts(decontaminate.match_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(table(spark, sf_dir, "documents"), every=199))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash, "op2_pii": op2_pii, "op3_mixing": op3_mixing, "op4_substrings": op4_substrings, "op5_warc": op5_warc, "op6_quality": op6_quality, "op7_exact": op7_exact, "op8_decontaminate": op8_decontaminate, "op9_lines": op9_lines, "op10_urls": op10_urls, "op11_centroids": op11_centroids, "op12_spelling": op12_spelling, "op13_licenses": op13_licenses}


def centroid_rounds(rounds: int = 10) -> str:
    """DuckDB SQL of exact centroid rounds, one after another."""
    parts = [
        """v as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        "x as materialized (select rid, unnest(v) as x, generate_subscripts(v, 1) as j from v)",
        "seeds as (select row_number() over (order by sha256('3:' || vec_id), v) - 1 as k, v from v order by k limit 8)",
        "c0 as materialized (select k, unnest(v) as x, generate_subscripts(v, 1) as j from seeds)",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as materialized (select rid, min(d * 8 + k) as m from (select x.rid, c.k, sum((x.x - c.x) * (x.x - c.x))::bigint as d from x join c{r} c using (j) group by all) group by rid)""")
        if r < rounds:
            parts.append(f"""c{r + 1} as materialized (select c.k, c.j, coalesce((s - ((s % n) + n) % n) // n, c.x) as x from c{r} c
                left join (select m % 8 as k, j, sum(x)::bigint as s, count(*) as n from a{r} join x using (rid) group by 1, 2) using (k, j))""")
    return f"""with {", ".join(parts)},
        f as (select rid, m % 8 as k, m // 8 as d from a{rounds}), h as (select k, sha256(string_agg(x::varchar, ',' order by j)) as s from c{rounds} group by k)
        select vec_id, k::int as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, s as centroid_sha256
        from f join v using (rid) join h using (k)"""


TEMPLATES = ", ".join(f"({t}, '{text}', '{label}', {str(base).lower()})" for t, (text, label, base) in enumerate([(*p, True) for p in licenses.PHRASES] + [(*g, False) for g in licenses.GRANTS]))

ORACLES = {
    "op11_centroids": centroid_rounds(),
    "op12_spelling": r"""
        with recursive bits(i, step, c) as (select i, 0, i from range(256) as t(i) union all select i, step + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where step < 8),
        tab as materialized (select list(c order by i) as t from bits where step = 8),
        r as materialized (select doc_id, run, count(*) as n from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents) group by all),
        b as (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from r),
        h as (select run, n, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) as h from b, tab),
        m as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from h),
        w as materialized (select word, sum(n)::bigint as n from m where length(word) >= 6 group by 1 having sum(n) >= 5),
        g as materialized (select word, n, j, substr(word, 1, j) || substr(word, j + 2) as v from w, unnest(range(0, length(word))) as t(j)),
        near as (select distinct a.word, b.word as near, b.n as m from g a join g b on a.v = b.v and a.j = b.j and a.word <> b.word
                 union select g.word, w.word, w.n from g join w on g.v = w.word union select w.word, g.word, g.n from g join w on g.v = w.word),
        best as (select word, count(*) as n_near, min((-m, near)) as b from near group by word),
        f as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -b[1] >= 5 * n then b[2] end as form, case when -b[1] >= 5 * n then -b[1] end as form_n from w left join best using (word)),
        up(word, last, step) as (select word, word, 0 from f union all select up.word, f.form, step + 1 from up join f on f.word = up.last where f.form is not null),
        top as (select word, arg_max(last, step) as root from up group by word)
        select word, form, root, n, n_near::bigint as n_near, form_n::bigint as form_n from f join top using (word)""",
    "op13_licenses": r"""
        with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        t(template, phrase, label, base) as (values @TEMPLATES@), tw as (select *, string_split(phrase, ' ') as w from t),
        tg as (select template, label, base, len(w) - 1 as m, p, w[p + 1] || ' ' || w[p + 2] as g from tw, unnest(range(0, len(w) - 1)) as u(p)),
        dg as (select rid, i as pos, w[i + 1] || ' ' || w[i + 2] as g from d, unnest(range(0, len(w) - 1)) as u(i)),
        votes as (select rid, template, label, base, m, pos - p as start, list(distinct p) as ps from dg join tg using (g) group by all),
        cov as (select rid, label, base, start, case when base then len(ps) else len(list_distinct(flatten(list(ps) over (partition by rid, template order by start range between current row and 3 following)))) end / m as coverage from votes),
        facts as (select rid, count(*) filter (where base and coverage = 1) as n_base, min(start) filter (where base and coverage = 1) as first_word, max(start) filter (where base and coverage = 1) as last_word,
                         string_agg(distinct label, ',' order by label) filter (where base and coverage = 1) as base_labels,
                         string_agg(distinct label, ',' order by label) filter (where case when base then coverage = 1 else coverage >= 0.75 end) as labels,
                         max(coverage) filter (where not base or coverage = 1) as score from cov group by rid)
        select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
               coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
        from d left join facts using (rid)""".replace("@TEMPLATES@", TEMPLATES),
    "op4_substrings": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from d, unnest(range(1, len(w) - 11)) as t(i) where len(w) >= 13),
        f as (select g, min(doc_id) as first from win group by g having min(doc_id) < max(doc_id)),
        gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from win join f using (g) where doc_id > first),
        n as (select doc_id, count(*) as n, list(p) as ps from gone group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
               sha256(array_to_string(case when n is null then w else [w[k] for k in range(1, len(w) + 1) if not list_contains(ps, k)] end, ' ')) as kept_sha256
        from d left join n using (doc_id)""",
    "op9_lines": r"""
        with d as (select doc_id, text, case when text is null then [] else string_split(text, chr(10)) end as l from documents),
        w as (select doc_id, i, array_to_string(l[i:i + 2], chr(10)) as g from d, unnest(range(1, len(l) - 1)) as t(i) where len(l) >= 3),
        f as (select doc_id, i, row_number() over (partition by g order by doc_id, i) as r from w),
        gone as (select distinct doc_id, unnest(range(i, i + 3)) as p from f where r > 1),
        n as (select doc_id, count(*) as n_removed, list(p) as ps from gone group by doc_id)
        select doc_id, len(l)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
               sha256(coalesce(case when n_removed is null then text else array_to_string([l[k] for k in range(1, len(l) + 1) if not list_contains(ps, k)], chr(10)) end, '')) as kept_sha256
        from d left join n using (doc_id)""",
    "op10_urls": r"""
        with u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
        h as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                     regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u),
        r as (select *, case when ('.' || host) like '%.example.com' and starts_with(path, '/de/') then 'example.com/de/'
                             when ('.' || host) like '%.example.net' and starts_with(path, '/en/') then 'example.net/en/'
                             when ('.' || host) like '%.org' and starts_with(path, '/fr/') then 'org/fr/'
                             when ('.' || host) like '%.net' and starts_with(path, '/') then 'net/' end as rule from h)
        select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
               when regexp_matches(path, '/(ads|cart|login|tracking|wp-admin)/') then 'block' else 'allow' end as verdict from r""",
    "op5_warc": r"""
        with p as (select page_id, encode(coalesce(html, '')) as b from pages),
        d as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as h, min(page_id) over (partition by b) as first from p),
        bits as (select *, [('0x' || substr(h || '', 10 * g + 1, 10))::bigint for g in range(0, 4)] as five from d)
        select page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31)::int + 1, 1) for i in range(0, 32)], '') as payload_digest,
               case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
        from bits""",
    "op8_decontaminate": r"""
        with dw as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        win as (select distinct item_id, least(10, len(w)) as k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as g
                from bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as t(i) where len(w) > 0),
        sizes as (select distinct k from win),
        dg as (select rid, i, k, array_to_string(w[i:i + k - 1], ' ') as g from dw, sizes, unnest(range(1, len(w) - k + 2)) as t(i) where len(w) >= k),
        hit as (select rid, i, k, item_id from dg join win using (k, g)),
        pos as (select rid, count(distinct p) as n from hit, unnest(range(i, i + k)) as t(p) group by rid),
        its as (select rid, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as s from hit group by rid)
        select doc_id, len(w)::bigint as n_words, coalesce(pos.n, 0)::bigint as n_hit, coalesce(its.n, 0)::bigint as n_items,
               sha256(coalesce(its.s, '')) as items_sha256, coalesce(pos.n, 0) > 0 as contaminated
        from dw left join pos using (rid) left join its using (rid)""",
    "op7_exact": r"""
        with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as b from documents),
        r as (select doc_id, length(t)::int as length, sha256(b) as text_sha256,
                     first_value(doc_id) over w as keep_id, row_number() over w = 1 as kept, count(*) over (partition by b) as group_size
              from d window w as (partition by b order by length(t) desc, doc_id nulls last))
        select doc_id, keep_id, group_size, kept, text_sha256, length from r""",
}
