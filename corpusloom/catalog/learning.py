"""Entity resolution and learning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import irt, scoring
from corpusloom.operators import graph as G
from corpusloom.operators import learning as L
from corpusloom.operators import resolve as E
from corpusloom.plans.lineage import cut, release
from corpusloom.sources.tables import table


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers once each; rows that were delivered twice differ in their arrival only."""
    a = table(spark, d, "answers")
    return a.dropDuplicates(["answer_id"]).withColumn("is_correct", F.coalesce("is_correct", F.lit(False)))


def irt_probability(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d).where("theta_before is not null")
    t = F.col("theta_before")
    return a.select("answer_id", F.round(irt.probability(t), 6).alias("p"), irt.information(t).alias("information"), F.round(irt.stepped(t, F.col("is_correct").cast("int")), 6).alias("theta_after"), F.round(irt.mastery(t), 6).alias("mastery"), irt.level(t).alias("level"))


def rasch_calibrate(spark: SparkSession, d: str) -> DataFrame:
    return L.rasch(_answers(spark, d))


def twopl_calibrate(spark: SparkSession, d: str) -> DataFrame:
    return L.two_pl(_answers(spark, d))


def theta_fold(spark: SparkSession, d: str) -> DataFrame:
    return L.folded(_answers(spark, d), "user_id").withColumn("theta", F.round("theta", 6))


def streaks(spark: SparkSession, d: str) -> DataFrame:
    return L.streak_islands(_answers(spark, d))


def mastery_state(spark: SparkSession, d: str) -> DataFrame:
    s = L.knowledge_state(_answers(spark, d))
    return s.select("user_id", "subject_id", "concept_id", "n", "correct", "streak", F.round("theta", 6).alias("theta"), F.round("mastery", 6).alias("mastery"), F.round("confidence", 6).alias("confidence"))


def state_propagated(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    e = G.edge_table(table(spark, d, "concept_edges"), "parent_id", "child_id", "relation_type", "confidence")
    s = L.propagate(L.knowledge_state(a), a, e)
    return s.select("user_id", "subject_id", "concept_id", F.round("mastery", 6).alias("mastery"), F.round("confidence", 6).alias("confidence"))


def profile_buckets(spark: SparkSession, d: str) -> DataFrame:
    return L.profile(L.knowledge_state(_answers(spark, d)))


def progress_trend(spark: SparkSession, d: str) -> DataFrame:
    return L.progress(_answers(spark, d))


def wrong_answer_book(spark: SparkSession, d: str) -> DataFrame:
    return L.wrong_answers(_answers(spark, d))


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    return L.recommendations(_answers(spark, d))


def bloom_radar(spark: SparkSession, d: str) -> DataFrame:
    """Six levels, also those without a question: questions, answers, share right."""
    q = table(spark, d, "question_bank").select(F.col("id").alias("question_id"), F.lower(F.trim("bloom_level")).alias("level")).dropDuplicates(["question_id"])
    a = _answers(spark, d).join(q, "question_id").groupBy("level").agg(F.count(F.lit(1)).alias("answers"), F.count_if("is_correct").alias("right"))
    n = q.groupBy("level").agg(F.count(F.lit(1)).alias("questions"))
    spine = spark.createDataFrame([(x,) for x in "remember understand apply analyze evaluate create".split()], "level string")
    z = F.lit(0).cast("bigint")
    return spine.join(n, "level", "left").join(a, "level", "left").select("level", F.coalesce("questions", z).alias("questions"), F.coalesce("answers", z).alias("answers"), F.round(F.coalesce(F.col("right") / F.col("answers"), F.lit(0.0)), 6).alias("share"))


def quizbank_stats(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "question_bank").dropDuplicates(["id"])
    key = lambda c: F.when(F.trim(c) != "", F.trim(c)).otherwise("unlabeled")
    return q.groupBy(F.coalesce(key(F.col("type")), F.lit("unlabeled")).alias("type"), F.coalesce(key(F.col("bloom_level")), F.lit("unlabeled")).alias("bloom_level")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_approved") == 1).alias("approved"), F.round(F.avg("difficulty"), 6).alias("difficulty"))


def score_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share right by question type, with weak below 0.5 and strong from 0.8."""
    q = table(spark, d, "question_bank").select(F.col("id").alias("question_id"), "type").dropDuplicates(["question_id"])
    g = _answers(spark, d).join(q, "question_id").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("is_correct").cast("int")), 6).alias("rate"))
    return g.withColumn("verdict", F.when(F.col("rate") < 0.5, "weak").when(F.col("rate") >= 0.8, "strong").otherwise("fair"))


def score_objective(spark: SparkSession, d: str) -> DataFrame:
    """Stored answers against the first option: letters named and scores."""
    q = table(spark, d, "question_bank").select("id", "answer", "explanation").distinct()
    return q.groupBy(scoring.letter(F.col("answer")).alias("letter")).agg(F.count(F.lit(1)).alias("n"), F.sum(scoring.objective(F.col("answer"), F.lit("A. x"))).alias("score"))


def score_fill_blank(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "question_bank").where("answer is not null").select("id", "answer", "explanation").distinct()
    return q.select("id", F.md5("answer").alias("answer_md5"), F.md5(F.coalesce("explanation", F.lit(""))).alias("given_md5"), scoring.fill_blank(F.col("answer"), F.col("explanation")).alias("score")).distinct()


def difficulty_heuristic(spark: SparkSession, d: str) -> DataFrame:
    e = G.edge_table(table(spark, d, "concept_edges"), "parent_id", "child_id", "relation_type", "confidence")
    c = table(spark, d, "canonical_concepts").groupBy("canonical_id").agg(F.max("description").alias("description"))
    g = G.degrees(e).withColumnRenamed("node", "canonical_id")
    x = c.join(g, "canonical_id", "left").fillna(0, ["in_degree", "out_degree"])
    return x.select("canonical_id", irt.heuristic_b(F.lit(0.5), F.col("in_degree") + F.col("out_degree"), F.col("description")).alias("b"))


# --- entity resolution ---------------------------------------------------------------


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_concepts")
    return c.select("name", "aliases", "concept_type", "description", "parent_hint", "source_chunks")


def name_profiles(spark: SparkSession, d: str) -> DataFrame:
    """As its SQL states it: without NFKC. ``name_profiles_nfkc`` has it."""
    p = E.profiles(_mentions(spark, d), native=True)
    return p.select("norm", "name", "frequency", F.array_join("alias_norms", "|").alias("alias_norms"))


def name_profiles_nfkc(spark: SparkSession, d: str) -> DataFrame:
    p = E.profiles(_mentions(spark, d))
    return p.select("norm", "name", "frequency", F.array_join("alias_norms", "|").alias("alias_norms"))


def surface_modes(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent spelling of every merge name."""
    m = table(spark, d, "merge_candidates").select(F.explode(F.array("left_name", "right_name")).alias("name")).withColumn("aliases", F.array().cast("array<string>"))
    return E.profiles(m).select("norm", "name", "frequency")


def pair_classify(spark: SparkSession, d: str) -> DataFrame:
    """As its SQL states it: without NFKC. ``pair_classify_nfkc`` has it."""
    p = E.profiles(_mentions(spark, d), native=True)
    return E.classify(E.candidate_pairs(p), p)


def pair_classify_nfkc(spark: SparkSession, d: str) -> DataFrame:
    p = cut(E.profiles(_mentions(spark, d)))
    return E.classify(E.candidate_pairs(p), p)


def canonical_build(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    p = cut(E.profiles(m))
    names = E.canonical_names(E.classify(E.candidate_pairs(p), p), p)
    of = cut(p.select("norm", "name").join(names.hint("merge"), "name").select("norm", "canonical"))
    release(p)
    full = m.withColumn("norm", E.normalized_name(F.col("name"))).drop("name", "aliases").join(of.hint("merge"), "norm")
    return E.gathered(full).withColumn("source_chunks", F.array_join("source_chunks", "|"))


def name_map(spark: SparkSession, d: str) -> DataFrame:
    return E.name_mapping(table(spark, d, "canonical_concepts"))


def advice_conflicts(spark: SparkSession, d: str) -> DataFrame:
    said = F.upper(F.trim("decision"))
    m = table(spark, d, "merge_candidates").where("left_name <> '' and right_name <> '' and left_name <> right_name")
    return E.advice_conflicts(m.select(F.col("left_name").alias("left"), F.col("right_name").alias("right"), said.alias("decision")))


QUERIES = {
    f.__name__: f
    for f in (
        irt_probability, rasch_calibrate, twopl_calibrate, theta_fold, streaks, mastery_state, state_propagated, profile_buckets, progress_trend, wrong_answer_book, recommendations, bloom_radar,
        quizbank_stats, score_rates, score_objective, score_fill_blank, difficulty_heuristic, name_profiles, name_profiles_nfkc, surface_modes, pair_classify, pair_classify_nfkc, canonical_build, name_map, advice_conflicts,
    )
}

_A = "a as (select distinct on (answer_id) * replace (coalesce(is_correct, false) as is_correct) from answers)"
_P = "(0.25 + 0.75 / (1 + exp(-{t})))"
_STEP = "greatest(-3.0, least(3.0, {t} + 0.3 * ({x} - " + _P + ")))"
_FOLD = "list_reduce(list_prepend(0.0::double, list(is_correct::int::double order by answered_at, answer_id)), lambda t, x: " + _STEP.format(t="t", x="x") + ")"
_STREAK = "list_reduce(list_prepend(0, list(case when is_correct then 1 else -1 end order by answered_at, answer_id)), lambda s, x: case when x = 1 then case when s >= 0 then s + 1 else 1 end else case when s <= 0 then s - 1 else -1 end end)"
_LETTER = "case when r in ('A', 'B', 'C', 'D', 'E', 'F') then r else upper(substr(raw, 1, 1)) end"
_STATE = f"""{_A}, c as (select user_id, subject_id, unnest(primary_concepts) as concept_id, is_correct, answered_at, answer_id from a),
    st as (select user_id, subject_id, concept_id, count(*) as n, count_if(is_correct)::bigint as correct, {_STREAK}::bigint as streak, {_FOLD} as theta from c where concept_id is not null group by 1, 2, 3),
    state as (select *, 1 / (1 + exp(-theta)) as mastery, least(1.0, n / 10) as confidence from st)"""
_NORM = "regexp_replace(lower({n}), '[\\s\\-_·•/\\\\()（）\\[\\]【】]+', '', 'g')"
_PROFILES = f"""m as (select name, aliases, {_NORM.format(n='name')} as norm from canonical_concepts where name is not null),
    sf as (select norm, name, count(*) as n from m where norm <> '' group by 1, 2), b as (select norm, arg_min(name, (-n, -length(name), name)) as name, sum(n)::bigint as frequency from sf group by 1),
    al as (select norm, list_sort(list(distinct an)) as alias_norms from (select norm, {_NORM.format(n='alias')} as an from (select norm, unnest(aliases) as alias from m where norm <> '') where alias is not null) where an <> '' and an <> norm group by 1),
    p as (select b.*, coalesce(alias_norms, []) as alias_norms from b left join al using (norm))"""

SQL = {
    "irt_probability": f"""with {_A}, t as (select answer_id, is_correct, theta_before as t, {_P.format(t='theta_before')} as p from a where theta_before is not null)
        select answer_id, round(p, 6) as p, round(p * (1 - p) / 0.5625, 4) as information, round({_STEP.format(t='t', x='is_correct::int')}, 6) as theta_after, round(1 / (1 + exp(-t)), 6) as mastery,
            case when t < -1.5 then 'beginner' when t < -0.5 then 'elementary' when t < 0.5 then 'intermediate' when t < 1.5 then 'advanced' else 'expert' end as level from t""",
    "rasch_calibrate": f"with {_A}, g as (select question_id, count(*) as n, greatest(0.01, least(0.99, avg(is_correct::int))) as p from a where question_id is not null group by 1) select question_id, n, round(-ln(p / (1 - p)), 2) as b from g where n >= 50",
    "twopl_calibrate": f"""with {_A}, x as (select question_id, theta_before, is_correct::int as ok, count(*) over (partition by question_id) as n, row_number() over (partition by question_id order by coalesce(theta_before, 0), answer_id) - 1 as i from a where question_id is not null),
        g as (select question_id, n, coalesce(avg(case when i < n // 4 then ok end), 0) as p25, coalesce(avg(case when i >= 3 * n // 4 then ok end), 0) as p75, coalesce(avg(case when i <= n // 2 then ok end), 0) as pm, avg(ok) as p, count(theta_before) as known,
            coalesce(max(case when i = n // 4 then theta_before end), 0) as t25, coalesce(max(case when i = 3 * n // 4 then theta_before end), 0) as t75, coalesce(max(case when i = n // 2 then theta_before end), 0) as tm from x where n >= 100 group by 1, 2),
        c as (select *, greatest(0.01, least(0.99, p25)) as lo, greatest(0.01, least(0.99, p75)) as hi, greatest(0.01, least(0.99, pm)) as m, greatest(0.01, least(0.99, p)) as pp from g),
        r as (select *, greatest(0.3, least(3.0, case when abs(t75 - t25) > 0.1 then (ln(hi / (1 - hi)) - ln(lo / (1 - lo))) / (t75 - t25) else 1.0 end)) as a from c)
        select question_id, n, case when known = 0 then 1.0 else round(a, 2) end as a, case when known = 0 then round(-ln(pp / (1 - pp)), 2) else round(tm - ln(m / (1 - m)) / a, 2) end as b from r""",
    "theta_fold": f"with {_A} select user_id, round({_FOLD}, 6) as theta, count(*) as n, count_if(is_correct)::bigint as correct, {_STREAK}::bigint as streak from a group by 1",
    "streaks": f"""with {_A}, x as (select user_id, is_correct::int as ok, row_number() over (partition by user_id order by answered_at, answer_id) - row_number() over (partition by user_id, is_correct order by answered_at, answer_id) as isle from a),
        r as (select user_id, ok, isle, count(*) as length from x group by 1, 2, 3) select user_id, ok as correct, length, count(*) as n from r group by 1, 2, 3""",
    "mastery_state": f"with {_STATE} select user_id, subject_id, concept_id, n, correct, streak, round(theta, 6) as theta, round(mastery, 6) as mastery, round(confidence, 6) as confidence from state",
    "state_propagated": f"""with {_STATE}, e as (select distinct parent_id as src, child_id as dst, relation_type as rel from concept_edges where parent_id <> '' and child_id <> '' and parent_id <> child_id),
        u as (select user_id, subject_id, src as concept_id, count(*) as ups from c join e on e.dst = c.concept_id and rel = 'DEPENDS_ON' where is_correct group by 1, 2, 3),
        w as (select user_id, subject_id, dst as concept_id, count(*) as downs from c join e on e.src = c.concept_id and rel = 'SOLUTION' where not is_correct group by 1, 2, 3)
        select user_id, subject_id, concept_id, round(least(1.0, mastery + 0.05 * coalesce(ups, 0)), 6) as mastery, round(confidence * pow(0.9, coalesce(downs, 0)), 6) as confidence
        from state left join u using (user_id, subject_id, concept_id) left join w using (user_id, subject_id, concept_id)""",
    "profile_buckets": f"""with {_STATE} select user_id, subject_id, round(avg(mastery), 6) as overall, count(*) as total, count_if(mastery >= 0.7)::bigint as mastered, count_if(mastery >= 0.8)::bigint as excellent, count_if(mastery >= 0.6 and mastery < 0.8)::bigint as good, count_if(mastery >= 0.4 and mastery < 0.6)::bigint as fair, count_if(mastery < 0.4)::bigint as weak,
        coalesce(array_to_string((list(concept_id order by round(mastery, 2), concept_id) filter (where mastery < 0.5))[1:5], ','), '') as weakest from state group by 1, 2""",
    "progress_trend": f"""with {_A}, x as (select user_id, theta_before as t, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by answered_at, answer_id) as i from a where theta_before is not null),
        g as (select user_id, n as points, round(avg(case when i <= n // 2 then t end), 6) as first_half, round(avg(case when i > n // 2 then t end), 6) as second_half from x group by 1, 2)
        select *, case when points >= 3 and second_half - first_half > 0.05 then 'up' when points >= 3 and second_half - first_half < -0.05 then 'down' else 'flat' end as trend from g""",
    "wrong_answer_book": f"""with {_A} select user_id, question_id, count_if(not is_correct)::bigint as wrong_count, min(case when not is_correct then answered_at end) as first_wrong, max(case when not is_correct then answered_at end) as last_wrong, arg_max(is_correct, (answered_at, answer_id)) as mastered
        from a where question_id is not null group by 1, 2 having count_if(not is_correct) > 0""",
    "recommendations": f"""with {_A}, w as (select user_id, question_id, unnest(primary_concepts) as concept_id from a where not is_correct and question_id is not null), g as (select user_id, concept_id, count(*) as wrong, count(distinct question_id) as questions from w group by 1, 2)
        select * from (select *, round(greatest(0.0, 1 - 0.3 * wrong / questions), 6) as mastery, row_number() over (partition by user_id order by wrong desc, concept_id)::int as rank from g) where rank <= 10""",
    "bloom_radar": f"""with {_A}, q as (select distinct on (id) id as question_id, lower(trim(bloom_level)) as level from question_bank), n as (select level, count(*) as questions from q group by 1), r as (select level, count(*) as answers, count_if(is_correct) as ok from a join q using (question_id) group by 1),
        s as (select unnest(['remember', 'understand', 'apply', 'analyze', 'evaluate', 'create']) as level) select level, coalesce(questions, 0) as questions, coalesce(answers, 0) as answers, round(coalesce(ok / answers, 0), 6) as share from s left join n using (level) left join r using (level)""",
    "quizbank_stats": "with q as (select distinct on (id) * from question_bank) select coalesce(nullif(trim(type), ''), 'unlabeled') as type, coalesce(nullif(trim(bloom_level), ''), 'unlabeled') as bloom_level, count(*) as n, count_if(is_approved = 1)::bigint as approved, round(avg(difficulty), 6) as difficulty from q group by 1, 2",
    "score_rates": f"with {_A}, q as (select distinct on (id) id as question_id, type from question_bank), g as (select type, count(*) as n, round(avg(is_correct::int), 6) as rate from a join q using (question_id) group by 1) select *, case when rate < 0.5 then 'weak' when rate >= 0.8 then 'strong' else 'fair' end as verdict from g",
    "score_objective": f"""with q as (select distinct id, trim(coalesce(answer, '')) as raw, explanation from question_bank), r as (select *, upper(trim(regexp_replace(raw, '^[A-Fa-f][.．、]\\s*', ''))) as r from q), l as (select {_LETTER} as letter from r)
        select letter, count(*) as n, sum(case when letter = 'A' then 1.0 else 0.0 end)::double as score from l group by 1""",
    "score_fill_blank": """with q as (select distinct id, answer, explanation from question_bank where answer is not null), k as (select *, regexp_extract_all(trim(answer), '[\\x{4E00}-\\x{9FFF}]{2,}|[A-Za-z]{3,}') as keys, lower(trim(coalesce(explanation, ''))) as low from q),
        r as (select *, len(list_filter(keys, lambda w: contains(low, lower(w)))) / greatest(len(keys), 1) as ratio from k)
        select distinct id, md5(answer) as answer_md5, md5(coalesce(explanation, '')) as given_md5, (case when low = '' then 0 when ratio >= 0.8 then 10 when ratio >= 0.5 then 5 else 0 end)::bigint as score from r""",
    "difficulty_heuristic": """with e as (select distinct parent_id as src, child_id as dst, relation_type as rel from concept_edges where parent_id <> '' and child_id <> '' and parent_id <> child_id), c as (select canonical_id, max(description) as description from canonical_concepts group by 1),
        g as (select node, count(*) as deg from (select src as node from e union all select dst from e) group by 1)
        select canonical_id, round_even(0.3 * 0.5 + 0.3 * least(coalesce(deg, 0) / 10, 1.0) + 0.2 * least(coalesce(length(description), 0) / 500, 1.0) + 0.1 - 0.5, 2) as b from c left join g on g.node = canonical_id""",
    "name_profiles": f"with {_PROFILES} select norm, name, frequency, array_to_string(alias_norms, '|') as alias_norms from p",
    "surface_modes": f"""with m as (select unnest([left_name, right_name]) as name from merge_candidates), s as (select {_NORM.format(n='name')} as norm, name, count(*) as n from m where name is not null group by 1, 2)
        select norm, arg_min(name, (-n, -length(name), name)) as name, sum(n)::bigint as frequency from s where norm <> '' group by 1""",
    "name_map": "with k as (select canonical_id, unnest(list_prepend(name, coalesce(aliases, []))) as k from canonical_concepts) select lower(trim(k)) as key, max(canonical_id) as canonical_id from k where trim(k) <> '' group by 1",
    "advice_conflicts": """with recursive m as (select left_name as l, right_name as r, upper(trim(decision)) as d from merge_candidates where left_name <> '' and right_name <> '' and left_name <> right_name), u as (select l, r from m where d = 'MERGE' union select r, l from m where d = 'MERGE'),
        c as (select l as node, l as other from u union select c.node, u.r from c join u on u.l = c.other), k as (select node, min(other) as comp from c group by 1),
        s as (select distinct l, r from m where d = 'SEPARATE'), x as (select s.l, s.r, a.comp from s join k a on a.node = s.l join k b on b.node = s.r and a.comp = b.comp),
        i as (select comp, sha256(array_to_string(list_sort(list(node)), '|')) as group_id from k group by 1) select l as left, r as right, group_id from x join i using (comp)""",
}
SQL["pair_classify"] = f"""with {_PROFILES},
    n as (select norm, name, alias_norms, case when ends_with(norm, '技术') and length(norm) > 3 then substr(norm, 1, length(norm) - 2) when ends_with(norm, '术语') and length(norm) > 3 then substr(norm, 1, length(norm) - 2) when ends_with(norm, '概念') and length(norm) > 3 then substr(norm, 1, length(norm) - 2) else norm end as base, {" or ".join(f"contains(norm, '{m}')" for m in E.MARKERS)} as mark from p),
    x as (select a.norm as l, b.norm as r, a.name as ln, b.name as rn, a.base as lb, b.base as rb, a.mark or b.mark as mark, list_contains(a.alias_norms, b.norm) or list_contains(b.alias_norms, a.norm) as ex,
        length(a.norm) as nl, length(b.norm) as nr from n a join n b on a.norm < b.norm),
    y as (select *, contains(l, r) or contains(r, l) as cont, contains(l, r) or contains(r, l) or contains(lb, rb) or contains(rb, lb) as edge, regexp_matches(case when nl <= nr then ln else rn end, '^[A-Z][A-Z0-9.+_-]{{1,10}}$') as acro from x),
    z as (select *, case when ex then 1 when lb = rb and not mark and acro then 2 when lb = rb and not mark then 3 when mark and cont and nl <> nr then 4 when mark and cont then 5 else 6 end as rule from y where ex or lb = rb or edge),
    w as (select *, case when rule in (4, 6) then 'NARROWER_THAN' when rule = 5 then 'RELATED_TO' else 'SAME_AS' end as relation from z)
    select ln as left, rn as right, case when relation = 'NARROWER_THAN' and nl <= nr then rn else ln end as subject, case when relation = 'NARROWER_THAN' and nl <= nr then ln else rn end as object, relation,
        (case rule when 1 then 0.99 when 2 then 0.96 when 3 then 0.88 when 4 then 0.8 when 5 then 0.8 else 0.76 end)::double as confidence, case when rule <= 2 then 'auto_merge' when rule = 3 then 'review' else 'keep_separate' end as decision from w"""
