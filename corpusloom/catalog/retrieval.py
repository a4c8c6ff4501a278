"""Retrieval and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import retrieval as R
from corpusloom.plans.sizes import small
from corpusloom.sources.tables import table

# DuckDB's words for the expressions of functions.text
TOKENS = "list_concat(regexp_extract_all(lower({t}), '[a-z0-9à-öø-ÿ]+'), flatten(list_transform(regexp_extract_all(lower({t}), '[\\x{{4E00}}-\\x{{9FFF}}]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_scores(table(spark, d, "documents").select("doc_id", "text"), _asked(spark, d)).withColumn("score", F.round("score", 6))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(_bm25(spark, d), "query_id", "doc_id", 10)


_BM25 = f"""
    with toks as (select doc_id, unnest({TOKENS.format(t='text')}) as term from documents),
    tf as (select doc_id, term, count(*) as tf from toks group by 1, 2),
    len as (select doc_id, coalesce(len({TOKENS.format(t='text')}), 0) as len from documents),
    w as (select count(*) as n, avg(len) as m from len),
    raw as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf, w group by term, n),
    idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
    q as (select query_id, term, count(*) as times from (select item_id as query_id, unnest({TOKENS.format(t='text')}) as term from eval_items where item_id % 100 = 0) group by 1, 2),
    s as (select query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / m))), 6) as score
          from q join idf using (term) join tf using (term) join len using (doc_id), w group by 1, 2),
    bm as (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s)"""


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    s = R.vector_scores(v, q).where("vec_id <> query_id").withColumn("score", F.round("score", 6))
    return R.ranked(s, "query_id", "vec_id", 10)


_VEC = """
    with v as (select vec_id, label, embedding::double[] as e from embeddings),
    s as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) as score from v, v q where q.vec_id % 100 = 0 and v.vec_id <> q.vec_id),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)"""


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and a lexical vector ranking (share of query terms) fused by rank."""
    bm = R.ranked(_bm25(spark, d), "query_id", "doc_id", 100)
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    q = _asked(spark, d).select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    share = docs.join(small(q), "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    fused = R.rrf([bm, R.ranked(share, "query_id", "doc_id", 100)], "query_id", "doc_id").withColumn("score", F.round("score", 6))
    return R.ranked(fused, "query_id", "doc_id", 10)


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    label = table(spark, d, "embeddings").select("vec_id", "label")
    r = vector_topk(spark, d).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return R.rank_metrics(r, "query_id", F.col("label") == F.col("wanted"))


def rerank_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The dot-product order of each query's ten nearest; ties in reverse order of rank."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    top = vector_topk(spark, d).select("query_id", "vec_id", "rank").join(v, "vec_id").join(q, "query_id")
    s = top.select("query_id", "vec_id", F.round(V.dot(F.col("embedding"), F.col("qv")), 6).alias("score"), (-F.col("rank")).alias("back"))
    from pyspark.sql.window import Window

    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "back"))).drop("back")


def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.mmr(vector_topk(spark, d).join(v, "vec_id"), "query_id", "vec_id", 5)


def parent_context_first(spark: SparkSession, d: str) -> DataFrame:
    """Paragraph chunks ranked by length within their document, with the parent's text once."""
    from pyspark.sql.window import Window

    chunks = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "parent_id", "document_name", "chunk_type", "text")
    w = Window.partitionBy("document_name").orderBy(F.length("text").desc(), "chunk_id")
    hits = chunks.where("chunk_type = 'paragraph'").withColumn("rank", F.row_number().over(w)).where("rank <= 5").select(F.col("document_name").alias("query_id"), "rank", "chunk_id", "parent_id")
    out = R.with_parent_context(hits, chunks)
    return out.select("query_id", "rank", "chunk_id", "parent_id", F.md5("parent_text").alias("parent_md5"))


def question_dup_check(spark: SparkSession, d: str) -> DataFrame:
    """For each question: whether its normalised text stands under another id."""
    q = table(spark, d, "question_bank").where("question is not null").select("id", T.normalized_question(F.col("question")).alias("norm")).distinct()
    seen = q.groupBy("norm").agg(F.countDistinct("id").alias("n"))
    return q.join(seen, "norm").select("id", F.md5("norm").alias("digest"), (F.col("n") > 1).alias("duplicate"))


def keywords_extract(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "question_bank").where("question is not null").select("id", "question").distinct()
    return q.select("id", F.posexplode(T.keywords(F.col("question"))).alias("pos", "word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_questions"))


def claims_extract(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(T.claims(F.regexp_replace("text", "\r", ""))).alias("pos", "claim"))
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_claims"), F.sum(F.length("claim")).alias("n_chars"), F.min(F.md5("claim")).alias("least"))


def claim_support(spark: SparkSession, d: str) -> DataFrame:
    """Claims of explanations against the chunk they cite: coverage and verdict."""
    q = table(spark, d, "question_bank").select("id", "question", "source_entry_id").distinct()
    c = table(spark, d, "chunks").select(F.col("chunk_id").alias("source_entry_id"), F.col("text").alias("source")).dropDuplicates(["source_entry_id"])
    x = q.join(c, "source_entry_id").select("id", "source", F.explode(T.claims(F.col("question"))).alias("claim")).distinct()
    cover = F.round(T.term_coverage(F.col("claim"), F.col("source")), 6)
    return x.select("id", F.md5("claim").alias("claim_md5"), cover.alias("coverage"), F.coalesce(cover >= 0.5, F.lit(True)).alias("supported"))


def density_signals(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    x = table(spark, d, "documents").where("text is not null")
    return x.select("doc_id", F.round(T.per_thousand(t, r"\d+ *[+*/-] *\d+", r"\$[^$]+\$"), 6).alias("formula"), F.round(T.per_thousand(t, r"return ", r"print *\(", "```"), 6).alias("code"), F.round(T.per_thousand(t, r"(?i)figure *\d+", r"图 *\d+"), 6).alias("diagram"))


def page_type_class(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "chunks").where("description_source = 'ocr'").dropDuplicates(["chunk_id"])
    return pages.groupBy(T.page_type(F.col("text")).alias("page_type")).agg(F.count(F.lit(1)).alias("n"))


def hash_embedding_sparse(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "canonical_concepts").where("name is not null").select("canonical_id", "name").distinct()
    x = c.select("canonical_id", F.explode(T.hashed_words(F.col("name"))).alias("h")).groupBy("canonical_id", F.col("h.slot").cast("bigint").alias("slot")).agg(F.sum("h.weight").alias("w"))
    return x.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"))


def relevance_rank(spark: SparkSession, d: str) -> DataFrame:
    """Concepts against the chunks they come from: heading as title, text as abstract."""
    c = table(spark, d, "canonical_concepts").select("canonical_id", "name", F.explode("source_chunks").alias("chunk_id")).distinct()
    k = table(spark, d, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "heading_path", "text")
    score = F.round(T.relevance(F.col("name"), F.coalesce("heading_path", F.lit("")), F.col("text")), 4)
    x = c.join(k, "chunk_id").select("canonical_id", "chunk_id", score.alias("score"))
    return x.withColumn("level", F.when(F.col("score") >= 0.42, "high").when(F.col("score") >= 0.18, "medium").otherwise("low"))


def plain_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.plain_text(F.col("text"))).alias("digest"))


def intent_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(T.intent(F.col("text")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


def query_rewrite(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "question_bank").where("topic is not null").select("topic").distinct()
    return q.select("topic", F.posexplode(T.query_variants(F.col("topic"))).alias("pos", "variant"))


def options_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Stored option lists, JSON or with separators: how many there are of each length."""
    q = table(spark, d, "question_bank").select("id", "options").distinct()
    return q.groupBy(F.size(T.string_list(F.col("options"))).cast("bigint").alias("n_options")).agg(F.count(F.lit(1)).alias("n"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("text is not null")
    return x.groupBy("doc_type").agg(F.sum(T.context_tokens(F.col("text"))).alias("tokens"), F.max(T.context_tokens(F.col("text"))).alias("most"))


QUERIES = {f.__name__: f for f in (bm25_topk, vector_topk, hybrid_topk, retrieval_metrics, rerank_cosine, mmr_select, parent_context_first, question_dup_check, keywords_extract, claims_extract, claim_support, density_signals, page_type_class, hash_embedding_sparse, relevance_rank, plain_texts, intent_route, query_rewrite, options_parsed, token_estimates)}

_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_CLAIMS = "list_filter(list_transform(string_split_regex({t}, '[。！？\\n]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) >= 10 and not ends_with(s, '?') and not ends_with(s, '？') and not regexp_matches(s, '^(请|建议|注意|简单来说|简而言之|总之)') and regexp_matches(s, '\\d|[A-Za-z]{{3}}|[\\x{{4E00}}-\\x{{9FFF}}]{{2}}'))"
_TERMS = "list_distinct(list_concat(regexp_extract_all({t}, '[A-Za-z]{{3,}}|\\d+\\.?\\d*%?'), regexp_extract_all({t}, '[\\x{{4E00}}-\\x{{9FFF}}]{{2,4}}')))"
_PLAIN = "substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce({t}, ''), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')), 1, {n})"
_REL = "list_distinct(list_concat(regexp_extract_all({t}, '[a-z0-9]{{2,}}'), flatten(list_transform(regexp_extract_all({t}, '[\\x{{4E00}}-\\x{{9FFF}}]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))))"
_INTENT = "case " + " ".join(f"when {' or '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in T.INTENTS[i])} then '{i}'" for i in T.INTENTS) + " else 'concept' end"


def _variants() -> str:
    cases = []
    for term, (first, _) in T.EXPANSIONS.items():
        cap = term[:1].upper() + term[1:].lower()
        once = lambda t: f"substr(topic, 1, strpos(topic, '{t}') - 1) || '{first}' || substr(topic, strpos(topic, '{t}') + {len(t)})"
        cases.append(f"when contains(lower(topic), '{term}') then case when contains(topic, '{term}') then {once(term)} when contains(topic, '{cap}') then {once(cap)} else topic || ' {first}' end")
    return "case " + " ".join(cases) + " end"


SQL = {
    "bm25_topk": _BM25 + " select * from bm where rank <= 10",
    "vector_topk": _VEC + " select * from r where rank <= 10",
    "hybrid_topk": _BM25 + f""",
        dt as (select doc_id, unnest(list_distinct({TOKENS.format(t='text')})) as term from documents),
        sh as (select query_id, doc_id, count(*) as score from dt join q using (term) group by 1, 2),
        sr as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sh),
        f as (select query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) as score from (select query_id, doc_id, rank from bm where rank <= 100 union all select query_id, doc_id, rank from sr where rank <= 100) group by 1, 2)
        select * from (select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from f) where rank <= 10""",
    "retrieval_metrics": _VEC + """,
        f as (select query_id, min(case when a.label = b.label then rank end) as first from r join v a using (vec_id) join v b on b.vec_id = query_id where rank <= 10 group by 1)
        select count(*) as n_queries, round(avg(coalesce((first <= 1)::int, 0)), 6) as hit_1, round(avg(coalesce((first <= 3)::int, 0)), 6) as hit_3, round(avg(coalesce((first <= 5)::int, 0)), 6) as hit_5, round(avg(coalesce(1.0 / first, 0)), 6) as mrr from f""",
    "rerank_cosine": _VEC + """,
        t as (select r.query_id, r.vec_id, round(list_inner_product(a.e, b.e), 6) as score, r.rank as old from r join v a using (vec_id) join v b on b.vec_id = r.query_id where rank <= 10)
        select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, old desc)::int as rank from t""",
    "parent_context_first": """
        with c as (select distinct on (chunk_id) chunk_id, parent_id, document_name, chunk_type, text from chunks),
        h as (select * from (select *, row_number() over (partition by document_name order by length(text) desc nulls last, chunk_id)::int as rank from c where chunk_type = 'paragraph') where rank <= 5),
        n as (select *, row_number() over (partition by document_name, parent_id order by rank, chunk_id) as nth from h)
        select n.document_name as query_id, n.rank, n.chunk_id, n.parent_id, case when nth = 1 then md5(p.text) end as parent_md5 from n left join c p on p.chunk_id = n.parent_id""",
    "question_dup_check": """
        with q as (select distinct id, lower(regexp_replace(question, '\\s+', '', 'g')) as norm from question_bank where question is not null)
        select id, md5(norm) as digest, count(id) over (partition by norm) > 1 as duplicate from q""",
    "keywords_extract": f"""
        with q as (select distinct id, question from question_bank where question is not null),
        w as (select id, unnest(regexp_extract_all(question, '[\\x{{4E00}}-\\x{{9FA5}}]+|[a-zA-Z]+')) as word from q)
        select word, count(*) as n, count(distinct id) as n_questions from w where length(word) > 1 and word not in ({_STOP}) group by 1""",
    "claims_extract": f"""
        with c as (select doc_id, unnest({_CLAIMS.format(t="replace(text, chr(13), '')")}) as claim from documents)
        select doc_id, count(*) as n_claims, sum(length(claim))::bigint as n_chars, min(md5(claim)) as least from c group by 1""",
    "claim_support": f"""
        with q as (select distinct id, question, source_entry_id from question_bank), k as (select distinct on (chunk_id) chunk_id, text from chunks),
        x as (select distinct id, text as source, claim from (select id, k.text, unnest({_CLAIMS.format(t="question")}) as claim from q join k on k.chunk_id = source_entry_id)),
        y as (select id, claim, {_TERMS.format(t="claim")} as t, source from x),
        z as (select id, md5(claim) as claim_md5, case when len(t) >= 2 then round(len(list_filter(t, lambda w: contains(lower(source), lower(w)))) / len(t), 6) end as coverage from y)
        select *, coalesce(coverage >= 0.5, true) as supported from z""",
    "density_signals": """
        with p as (select doc_id, text, greatest(length(text), 1) as n from documents where text is not null)
        select doc_id, round((len(regexp_extract_all(text, '\\d+ *[+*/-] *\\d+')) + len(regexp_extract_all(text, '\\$[^$]+\\$'))) / n * 1000, 6) as formula,
            round((len(regexp_extract_all(text, 'return ')) + len(regexp_extract_all(text, 'print *\\(')) + len(regexp_extract_all(text, '```'))) / n * 1000, 6) as code,
            round((len(regexp_extract_all(text, '(?i)figure *\\d+')) + len(regexp_extract_all(text, '图 *\\d+'))) / n * 1000, 6) as diagram from p""",
    "page_type_class": """
        with p as (select distinct on (chunk_id) chunk_id, coalesce(text, '') as t from chunks where description_source = 'ocr'),
        x as (select t, length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) as n from p)
        select case when n < 50 then 'scan' when len(regexp_extract_all(t, '[\\x{0370}-\\x{03FF}\\x{2200}-\\x{22FF}\\^_$\\\\]')) / greatest(n, 1) > 0.05 then 'formula_heavy'
            when len(regexp_extract_all(t, '[|+─━┌┐└┘├┤┬┴┼]')) > 10 or len(regexp_extract_all(t, '\\t')) > 20 then 'table' else 'text' end as page_type, count(*) as n from x group by 1""",
    "hash_embedding_sparse": """
        with c as (select distinct canonical_id, name from canonical_concepts where name is not null),
        w as (select canonical_id, unnest(list_filter(string_split_regex(lower(name), '\\s+'), lambda w: w <> '')) as w from c),
        h as (select canonical_id, ('0x' || right(md5(w), 3))::int % 2048 as slot, 1.0 as weight from w union all select canonical_id, ('0x' || right(sha256(w), 3))::int % 2048, 0.5 from w),
        s as (select canonical_id, slot, sum(weight) as w from h group by 1, 2)
        select slot::bigint as slot, count(*) as n, sum(w)::double as weight from s group by 1""",
    "relevance_rank": f"""
        with c as (select distinct canonical_id, name, chunk_id from (select canonical_id, name, unnest(source_chunks) as chunk_id from canonical_concepts)),
        k as (select distinct on (chunk_id) chunk_id, coalesce(heading_path, '') as heading, text from chunks),
        x as (select canonical_id, chunk_id, {_REL.format(t="lower(" + _PLAIN.format(t="name", n=2**31 - 1) + ")")} as q, {_REL.format(t="lower(" + _PLAIN.format(t="heading", n=2**31 - 1) + ")")} as a, {_REL.format(t="lower(" + _PLAIN.format(t="text", n=2**31 - 1) + ")")} as b from c join k using (chunk_id)),
        s as (select canonical_id, chunk_id, case when len(q) = 0 then 0.0 else round(least(1.0, len(list_intersect(q, a)) / greatest(1, least(len(q), 10)) * 0.72 + len(list_intersect(q, b)) / greatest(1, least(len(q), 14)) * 0.28), 4) end as score from x)
        select *, case when score >= 0.42 then 'high' when score >= 0.18 then 'medium' else 'low' end as level from s""",
    "plain_texts": f"select doc_id, md5({_PLAIN.format(t='text', n=2**31 - 1)}) as digest from documents where text is not null",
    "intent_route": f"select {_INTENT} as intent, count(*) as n from (select lower(coalesce(text, '')) as t from documents) group by 1",
    "query_rewrite": f"""
        with q as (select distinct topic from question_bank where topic is not null), v as (select topic, {_variants()} as grown from q),
        e as (select topic, list_filter([topic, grown, topic || ' 原理', topic || ' 详解', topic || ' 面试题', topic || ' 优化方法', topic || ' 实践指南'], lambda x: x is not null) as l from v),
        p as (select topic, unnest(l) as variant, generate_subscripts(l, 1) as i from e), f as (select topic, variant, min(i) as i from p group by 1, 2)
        select topic, (row_number() over (partition by topic order by i) - 1)::int as pos, variant from f qualify row_number() over (partition by topic order by i) <= 3""",
    "options_parsed": """
        with q as (select distinct id, options from question_bank)
        select (case when starts_with(trim(options), '[') and json_valid(options) then json_array_length(options) when options is null then 0
            else len(list_filter(string_split_regex(options, '[;,；，|]'), lambda s: trim(s) <> '')) end)::bigint as n_options, count(*) as n from q group by 1""",
    "token_estimates": """
        with t as (select doc_type, length(text) as n, len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]')) as c from documents where text is not null)
        select doc_type, sum(c + (n - c) // 4)::bigint as tokens, max(c + (n - c) // 4)::bigint as most from t group by 1""",
}
