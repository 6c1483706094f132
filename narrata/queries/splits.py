"""Linked groups, leakage-safe splits, oversampling, exact samples, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions.text import normal_hash
from narrata.operators import checkpoints, linkage
from narrata.plans.storage import Workspace
from narrata.queries import table
from narrata.queries.documents import NORMAL

QUERIES, ORACLES = {}, {}
SEED = 42


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def linked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports; every fortieth names the next one, and one that does not exist, as related."""
    d = F.col("doc_id")
    related = F.when(d % 40 == 0, F.array((d + 1).cast("string"), F.concat(F.lit("x"), (d / 400).cast("long").cast("string"))))
    return table(spark, sf_dir, "documents").select(d.cast("string").alias("report_id"), related.alias("related_ids"), normal_hash(F.col("text")).alias("narrative_sha256"), "lang", "n_chars")


ROWS = f"""rows as (select doc_id::varchar as report_id, doc_id, {NORMAL} as narrative_sha256, lang, n_chars from documents),
        edges as (select report_id as a, 'text:' || narrative_sha256 as b from rows union select report_id, (doc_id + 1)::varchar from rows where doc_id % 40 = 0
                  union select report_id, 'x' || (doc_id // 400) from rows where doc_id % 40 = 0),
        ends as (select a, b from edges union select b, a from edges),
        nodes as (select distinct a as node from ends)"""
#: Labels spread along links until nothing changes; UNION drops what is known.
GROUPS = f"""{ROWS}, spread(node, label) as (select node, node from nodes union select e.b, s.label from spread s join ends e on e.a = s.node and s.label < e.b),
        groups as (select r.report_id, coalesce(min(s.label), r.report_id) as group_id from rows r left join spread s on s.node = r.report_id group by r.report_id)"""


@query(f"with recursive {GROUPS} select report_id, group_id from groups")
def link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link_groups(linked_rows(spark, sf_dir))


def parts_of(n: int) -> tuple[int, int]:
    """Sizes of eval and train: a twentieth and a half."""
    return n // 20, n // 2


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are hashed once, not for each of the passes over the rows
    rows = Workspace(spark, "split").table("rows", linked_rows(spark, sf_dir))
    return linkage.group_split(rows, *parts_of(rows.count()), seed=SEED)


FILL = f"""{GROUPS}, sizes as (select group_id, count(*) as n, row_number() over (order by sha256('{SEED}:' || group_id), group_id) as i from groups group by group_id),
        room as (select count(*) // 20 as e, count(*) // 2 as t from rows),
        walk(i, used_e, used_t, group_id, split) as (
            select 0::bigint, 0::bigint, 0::bigint, null::varchar, null::varchar
            union all
            select s.i, case when w.used_e + s.n <= r.e then w.used_e + s.n else w.used_e end, case when w.used_e + s.n > r.e and w.used_t + s.n <= r.t then w.used_t + s.n else w.used_t end,
                   s.group_id, case when w.used_e + s.n <= r.e then 'eval' when w.used_t + s.n <= r.t then 'train' else 'reserve' end
            from walk w join sizes s on s.i = w.i + 1 cross join room r),
        parts as (select g.report_id, g.group_id, w.split, r.narrative_sha256, r.lang, r.n_chars from groups g join walk w using (group_id) join rows r using (report_id))"""


@query(f"with recursive {FILL} select report_id, group_id, split from parts")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(spark, sf_dir).select("report_id", "group_id", "split")


@query(f"with recursive {FILL} select split, count(*) as n_rows, count(distinct group_id) as n_groups from parts group by 1")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_rows(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("group_id").alias("n_groups"))


@query(f"""with {ROWS}, p as (select *, case when doc_id % 3 = 0 then 'eval' else 'train' end as split from rows)
        select 'narrative_sha256' as key, narrative_sha256 as value from p group by 2 having count(distinct split) = 2""")
def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a split by id alone puts on both sides."""
    rows = linked_rows(spark, sf_dir).withColumns({"group_id": F.col("report_id"), "split": F.when(F.col("report_id").cast("long") % 3 == 0, "eval").otherwise("train")})
    return linkage.leaks(rows)


@query("select 'none' as leak, 0::bigint as n_rows")
def split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of a grouped split: none."""
    return linkage.leaks(split_rows(spark, sf_dir)).agg(F.coalesce(F.min("key"), F.lit("none")).alias("leak"), F.count("*").alias("n_rows"))


FLAGS = "lang = 'de' as rare, n_chars < 300 as brief"


@query(f"""with {ROWS}, f as (select report_id, {FLAGS} from rows), o as (select report_id, unnest(range(0, 1 + 2 * coalesce(rare, false)::int + coalesce(brief, false)::int)) as copy from f)
        select report_id, copy::int as copy from o""")
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row, two copies more of German ones and one more of short ones."""
    rows = linked_rows(spark, sf_dir).withColumns({"rare": F.col("lang") == "de", "brief": F.col("n_chars") < 300})
    return linkage.oversample(rows, {"rare": 3, "brief": 2}).select("report_id", "copy")


@query(f"select doc_id::varchar as report_id, (row_number() over (order by sha256('{SEED}:' || doc_id), doc_id::varchar))::int as rank from documents order by rank limit 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents for review, in seeded order."""
    return linkage.seeded_sample(linked_rows(spark, sf_dir), 50, "report_id", SEED).select("report_id", "rank")


@query(f"""with s as (select doc_id::varchar as report_id, row_number() over (order by sha256('{SEED}:' || doc_id), doc_id::varchar) as r from documents order by r limit 20),
        f as (select doc_id::varchar as report_id, 1000000000000 + doc_id as r from documents where n_chars < 200 order by doc_id limit 10),
        u as (select report_id, min(r) as r from (select * from s union all select * from f) group by 1)
        select report_id, (row_number() over (order by r))::int as rank from u""")
def review_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty sampled documents, then the first ten short ones, each once."""
    rows = linked_rows(spark, sf_dir)
    short = rows.where("n_chars < 200").withColumn("pos", F.col("report_id").cast("long"))
    return linkage.review_union(linkage.seeded_sample(rows, 20, "report_id", SEED), short, "report_id")


@query("select lang, count(*) as n_rows from documents group by 1 order by n_rows desc, lang limit 3")
def top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent languages."""
    return linkage.top_counts(table(spark, sf_dir, "documents"), "lang", 3)


@query("select doc_id from documents order by doc_id limit 10")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample that is written beside a split: its first ten rows."""
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(10)


NAMES = "[" + ", ".join(f"'{n}'" for n in checkpoints.REQUIRED) + "]"


@query(f"""with f as (select user_id as run, case when event_id % 11 = 0 then 'best' else 'checkpoint-' || (event_id // 1500) end as directory, {NAMES}[event_id % 7 + 1] as name, (value * 10)::bigint as length from events),
        c as (select run, directory from f where directory like 'checkpoint-%' and length > 0 group by 1, 2 having count(distinct name) = 7)
        select run, max(substr(directory, 12)::bigint) as step from c group by 1""")
def checkpoint_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest complete checkpoint of each run, in a listing made of events."""
    e, names = F.col("event_id"), F.array(*map(F.lit, checkpoints.REQUIRED))
    files = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.when(e % 11 == 0, "best").otherwise(F.concat(F.lit("checkpoint-"), F.floor(e / 1500).cast("string"))).alias("directory"),
        F.get(names, (e % 7).cast("int")).alias("name"), F.round(F.col("value") * 10).cast("long").alias("length"),
    )
    return checkpoints.latest_checkpoints(files)
