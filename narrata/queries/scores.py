"""Scores, metrics, gates and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import brief as briefs
from narrata.operators import reviews, scoring
from narrata.queries import table
from narrata.queries.reports import BREAKS
from narrata.queries.templates import reports, reports_sql

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold briefs as two models might repeat them: ``base`` breaks seven in eight, ``adapter`` swaps Weather for Other."""
    gold = briefs.gold(reports(spark, sf_dir), "told", parsed="gold").where("told is not null").withColumn("near_miss_gold", F.col("told.what_almost_happened") != "None stated")
    broken = "case pos % 8 " + " ".join(f"when {i} then {how.format('gold_text')}" for i, (how, _) in enumerate(BREAKS)) + " end"
    texts = F.array(F.struct(F.lit("base").alias("model"), F.expr(broken).alias("text")), F.struct(F.lit("adapter").alias("model"), F.replace("gold_text", F.lit("Weather"), F.lit("Other")).alias("text")))
    kept = ("narrative", "gold_text", "near_miss_gold", "gold", "gold_error", *scoring.EVIDENCE)
    long = scoring.prepared(gold.withColumn("gold_error", F.lit(None).cast("string"))).select(F.col("pos").cast("string").alias("report_id"), "pos", *kept, F.explode(texts).alias("x"))
    return long.select("report_id", *kept, "x.*", (F.col("pos") % 100 + 10).cast("int").alias("tokens"))


SCORED = f"""{reports_sql("written", "label", "lesson", "near")},
        g as (select pos, k, label, lesson, near from n where written is not null),
        s as (select pos, k, 'base' as model, pos % 8 = 0 as ok, label, lesson, near, true as factor_ok from g union all select pos, k, 'adapter', true, label, lesson, near, k <> 0 from g),
        x as (select pos::varchar as report_id, model, ok as schema_valid, ok and factor_ok as factor_correct, ok as phase_correct, ok as recoverable_correct, label <> 'Unknown' as recoverable_known, label as recoverable_gold,
                     near <> 'None stated' as near_miss_gold, ok and near <> 'None stated' as near_miss_distinct, case when ok then label else 'invalid' end as recoverable_prediction,
                     lesson <> 'None stated.' as lesson_gold, ok and lesson <> 'None stated.' as lesson_present, ok and lesson <> 'None stated.' as lesson_grounded, (pos % 100 + 10)::int as tokens, k = 6 as grounding_fail, ok from s)"""


@query(f"with {SCORED} select * exclude (ok) from x")
def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of both models on every report; no broken brief adds a specific, so flags are those of the gold."""
    return scoring.score(outputs(spark, sf_dir)).drop("grounding_flags", "parse_error")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as score rows: two heuristics, on length and on the language, guess the quality."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    long = rows.select("*", F.explode(F.array(F.lit("base"), F.lit("adapter"))).alias("model"))
    guess = F.when(F.col("model") == "base", F.col("n_chars") % 2 == 0).otherwise((F.col("n_chars") > 400) | (F.col("doc_id") % 5 == 0))
    good, known = F.col("quality") == 1, F.col("toxic") == 0
    right = guess == good
    return long.select(
        F.col("doc_id").cast("string").alias("report_id"), "model", (F.col("n_chars") > 60).alias("schema_valid"), right.alias("factor_correct"), (right & known).alias("phase_correct"), right.alias("recoverable_correct"),
        known.alias("recoverable_known"), F.when(known, F.when(good, "Yes").otherwise("No")).otherwise("Unknown").alias("recoverable_gold"), (~guess & ~good & ~known).alias("grounding_fail"),
        F.col("n_chars").cast("int").alias("tokens"), (F.col("lang") == "fr").alias("near_miss_gold"), guess.alias("near_miss_distinct"), F.when(guess, "Yes").otherwise("No").alias("recoverable_prediction"),
        good.alias("lesson_gold"), guess.alias("lesson_present"), (guess & good).alias("lesson_grounded"),
    )


JUDGED = """l as (select doc_id, quality = 1 as good, toxic = 0 as known, n_chars, lang from labels join documents using (doc_id)),
        g as (select *, 'base' as model, n_chars % 2 = 0 as guess from l union all select *, 'adapter', n_chars > 400 or doc_id % 5 = 0 from l),
        s as (select *, guess = good as hit, case when not known then 'Unknown' when good then 'Yes' else 'No' end as gold_label, case when guess then 'Yes' else 'No' end as said from g)"""


def share(c: str, among: str = "true") -> str:
    return f"avg(case when {among} then ({c})::int::double end)"


METRICS = f"""m as (select model, count(*) as n, {share('n_chars > 60')} as valid_schema, {share('hit')} as factor_acc, {share('hit and known')} as phase_acc, {share('hit')} as recoverable_acc,
        {share('hit', 'known')} as recoverable_known_acc, count(*) filter (known) as recoverable_known_n, {share('not guess and not good and not known')} as grounding_fail, median(n_chars)::double as median_tokens,
        {share('guess', "lang = 'fr'")} as near_miss_distinct, count(*) filter (lang = 'fr') as near_miss_n, {share('guess', 'good')} as lesson_recall, count(*) filter (good) as lesson_n, {share('guess')} as lesson_emitted,
        {share('good', 'guess')} as lesson_grounded, count(*) filter (gold_label = 'Yes') as gold_yes, count(*) filter (gold_label = 'No') as gold_no,
        count(*) filter (known and said = 'Yes') as known_yes, count(*) filter (known and said = 'No') as known_no from s group by 1)"""
RATES = ("valid_schema", "factor_acc", "phase_acc", "recoverable_acc", "recoverable_known_acc", "grounding_fail", "near_miss_distinct", "lesson_recall", "lesson_emitted", "lesson_grounded")


@query(f"with {JUDGED}, {METRICS} select * replace ({', '.join(f'round({c}, 9) as {c}' for c in RATES)}) from m")
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = scoring.checked_metrics(judged(spark, sf_dir))
    return table_.withColumns({c: F.round(c, 9) for c in RATES})


@query(f"""with {JUDGED} select model, 'recoverable_distribution' as distribution, said as label, count(*) as n_rows from s group by all
        union all select model, 'recoverable_gold_distribution', gold_label, count(*) from s where known group by all
        union all select model, 'recoverable_known_distribution', said, count(*) from s where known group by all""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.label_counts(judged(spark, sf_dir))


LONG = " union all ".join(f"select '{c}' as metric, model, {c}::double as v from m" for c in scoring.REPORTED)


@query(f"with {JUDGED}, {METRICS}, x as ({LONG}) select metric, round(max(v) filter (model = 'base'), 9) as base, round(max(v) filter (model = 'adapter'), 9) as adapter from x group by 1")
def paired_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.paired(scoring.metrics(judged(spark, sf_dir))).withColumns({c: F.round(c, 9) for c in ("base", "adapter")})


GATED = """select a.valid_schema >= 0.95 as schema_at_least_95_percent, a.valid_schema >= b.valid_schema as schema_not_worse, a.factor_acc - b.factor_acc >= 0.15 - 1e-9 as factor_gain_15pp,
        a.phase_acc - b.phase_acc >= 0.1 - 1e-9 as phase_gain_10pp, a.grounding_fail <= 0.1 as grounding_at_most_10_percent, a.grounding_fail <= b.grounding_fail as grounding_not_worse,
        coalesce(a.recoverable_known_acc > b.recoverable_known_acc, false) as recoverable_improves, a.gold_yes > 0 and a.gold_no > 0 as recoverable_binary_support, a.known_yes > 0 and a.known_no > 0 as recoverable_not_collapsed
        from m a, m b where a.model = 'adapter' and b.model = 'base'"""


@query(f"with {JUDGED}, {METRICS} {GATED}")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.gates(scoring.metrics(judged(spark, sf_dir))).select(*scoring.GATES)


ALL = " and ".join(scoring.GATES)


@query(f"""with {JUDGED}, {METRICS}, t as ({GATED}) select case when not grounding_not_worse then 'STOP: adapter grounding is worse than base; do not ship'
        when {ALL} then 'AUTOMATIC GATES PASS: rubric review still required before acceptance' else 'NOT ACCEPTED: one or more v0.1 targets were missed' end as decision from t""")
def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.gates(scoring.metrics(judged(spark, sf_dir))).select("decision")


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as review rows: poor texts are concerns, toxic ones violations unless nobody said."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        F.when(d % 2 == 0, "train").otherwise("eval").alias("split"), (F.col("quality") == 0).alias("grounding_concern"), F.when(d % 3 > 0, F.col("toxic") == 1).alias("grounding_rule_violation"),
        F.array_compact(F.array(F.lit("lesson"), F.when(F.col("toxic") == 1, "note"))).alias("fields"), F.lit("read").alias("note"),
    )


REVIEWED = "r as (select case when doc_id % 2 = 0 then 'train' else 'eval' end as split, quality = 0 as concern, case when doc_id % 3 > 0 then toxic = 1 else quality = 0 end as violation, toxic from labels)"


@query(f"with {REVIEWED} select coalesce(split, 'all') as split, count(*) as n, round(avg(concern::int), 9)::double as concern_rate, round(avg(violation::int), 9)::double as violation_rate from r group by rollup (split)")
def review_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.review_rates(reviewed(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("concern_rate", "violation_rate")})


@query(f"with {REVIEWED} select 'lesson' as field, count(*) as n_rows from r where concern union all select 'note', count(*) from r where concern and toxic = 1 having count(*) > 0")
def review_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.review_fields(reviewed(spark, sf_dir))


def packet_and_reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents as a packet in order of id; their reviews, of which every 50th is lost, every 40th of
    another document, every 30th repeated, and every 20th in the place of the 19th before it."""
    d, split = F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("eval")
    packet = table(spark, sf_dir, "labels").select(split.alias("split"), (d * 10).alias("pos"), d.cast("string").alias("report_id"))
    kept = packet.where(F.col("pos") % 500 != 0)
    pos = F.when(F.col("pos") % 200 == 0, F.col("pos") - 395).otherwise(F.col("pos"))
    reviews = kept.select("split", pos.alias("pos"), F.when(F.col("pos") % 400 == 0, F.concat(F.lit("x"), "report_id")).otherwise(F.col("report_id")).alias("report_id"))
    return packet, reviews.unionByName(kept.where("pos % 300 = 0").select("split", (F.col("pos") + 1).alias("pos"), "report_id"))


@query("""with p as (select case when doc_id % 2 = 0 then 'train' else 'eval' end as split, doc_id * 10 as pos, doc_id::varchar as report_id from labels), k as (select * from p where pos % 500 <> 0),
        r as (select split, case when pos % 200 = 0 then pos - 395 else pos end as pos, case when pos % 400 = 0 then 'x' || report_id else report_id end as report_id from k union all select split, pos + 1, report_id from k where pos % 300 = 0),
        pc as (select *, row_number() over (partition by split, report_id order by pos) as copy from p), rc as (select *, row_number() over (partition by split, report_id order by pos) as copy from r),
        b as (select split, report_id, copy, pc.pos as packet_pos, rc.pos as review_pos from pc full join rc using (split, report_id, copy)),
        c as (select split, report_id, copy, row_number() over (partition by split order by packet_pos) as a, row_number() over (partition by split order by review_pos) as b from b where packet_pos is not null and review_pos is not null)
        select b.split, b.report_id, packet_pos, review_pos, case when review_pos is null then 'missing' when packet_pos is null and b.report_id not in (select report_id from p) then 'foreign' when packet_pos is null then 'repeated'
               when c.a = c.b then 'aligned' else 'out of order' end as verdict from b left join c using (split, report_id, copy)""")
def review_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews held against the packet they are of."""
    return reviews.aligned(*packet_and_reviews(spark, sf_dir))
