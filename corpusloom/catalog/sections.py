"""Queries of document sections, outlines and markup, and of requests in text."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import documents as D
from corpusloom.operators import sections as S
from corpusloom.sources.tables import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("description_source = 'ocr' and chunk_type = 'parent_page'").select("chunk_id", "document_name", "page_number", "text").distinct()


def page_children(spark: SparkSession, d: str) -> DataFrame:
    """Children of every scanned page by itself."""
    split = lambda x: S.page_children(hashlib.md5(x.encode()).hexdigest(), x)
    out = D.generate(_pages(spark, d).where("trim(text) <> ''"), "chunk_id", "text", split, "parent string, child string, kind string, heading_path string, piece string")
    return out.select("chunk_id", "pos", "kind", "heading_path", F.length("piece").alias("chars"))


def document_children(spark: SparkSession, d: str) -> DataFrame:
    """Parents and children of scanned documents cut as a whole."""
    out = S.parent_child_documents(_pages(spark, d))
    return out.select("document_name", "id", "kind", F.array_join("pages", ",").alias("pages"), F.size("parents").alias("n_parents"), F.md5("text").alias("digest"))


def document_sections(spark: SparkSession, d: str) -> DataFrame:
    out = D.generate(table(spark, d, "documents"), "doc_id", "text", S.document_sections, "way string, level int, title string, content string")
    return out.select("doc_id", "pos", "way", "level", "title", F.length("content").alias("chars"))


def second_level(spark: SparkSession, d: str) -> DataFrame:
    out = D.generate(table(spark, d, "documents"), "doc_id", "text", lambda x: S.second_level("doc", x), "id string, type string, heading string, formulas int, table_lines int, content string")
    return out.select("doc_id", "pos", "id", "type", "heading", "formulas", "table_lines", F.length("content").alias("chars"))


def heading_spans(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("text is not null")
    x = x.select("doc_id", F.explode(S.heading_spans(F.regexp_replace("text", "\r", ""))).alias("h")).select("doc_id", "h.*")
    return x.withColumnRenamed("end", "until")


def outline_paths(spark: SparkSession, d: str) -> DataFrame:
    """Headings of every Markdown document in order of their ids, as an outline."""
    k = table(spark, d, "chunks").where("chunk_type = 'heading' and heading_level > 0 and document_name is not null").groupBy("document_name", "chunk_id").agg(F.min("heading_level").alias("level"), F.min(F.coalesce("text", F.lit(""))).alias("title"))
    return S.outline_paths(k, "document_name", "chunk_id", "level", "title")


def markup_counts(spark: SparkSession, d: str) -> DataFrame:
    n = T.markup_counts(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", *[c.alias(k) for k, c in n.items()])


def dialog_estimates(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("text is not null")
    return x.select("doc_id", T.dialog_tokens(F.col("text")).alias("dialog"), T.assembly_tokens(F.col("text")).alias("assembly"))


def question_requests(spark: SparkSession, d: str) -> DataFrame:
    """The number and topic that questions name, read as requests."""
    q = table(spark, d, "question_bank").where("question is not null").select("id", "question").distinct()
    return q.select("id", T.asked_count(F.col("question")).alias("asked"), F.md5(T.asked_topic(F.col("question"))).alias("topic_md5"))


QUERIES = {f.__name__: f for f in (page_children, document_children, document_sections, second_level, heading_spans, outline_paths, markup_counts, dialog_estimates, question_requests)}

_N = "len(regexp_extract_all({t}, '{p}'))"
_COUNTS = ["出\\s*(\\d+)\\s*道\\s*题", "出\\s*(\\d+)\\s*题", "(\\d+)\\s*道\\s*题", "(\\d+)\\s*题", "来\\s*(\\d+)\\s*道", "给\\s*我\\s*(\\d+)\\s*道"]
_GET = "try_cast(nullif(regexp_extract(question, '{p}', {g}), '') as int)"

SQL = {
    "heading_spans": """with l as (select doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) as x, unnest(range(0, len(string_split(replace(text, chr(13), ''), chr(10))))) as line, len(string_split(replace(text, chr(13), ''), chr(10))) as n from documents where text is not null),
        f as (select *, coalesce(sum(starts_with(x, '```')::int) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) % 2 as open from l),
        h as (select doc_id, line, length(regexp_extract(x, '^(#{1,6})\\s+.+$', 1)) as level, trim(regexp_extract(x, '^#{1,6}\\s+(.+)$', 1), ' ') as title, n from f where open = 0 and regexp_matches(x, '^#{1,6}\\s+.+$'))
        select a.doc_id, a.line::int as line, a.level::int as level, a.title, coalesce(min(b.line), a.n)::int as until from h a left join h b on b.doc_id = a.doc_id and b.line > a.line and b.level <= a.level group by a.doc_id, a.line, a.level, a.title, a.n""",
    "outline_paths": """with recursive k as (select document_name, chunk_id, min(heading_level)::int as level, min(coalesce(text, '')) as title, row_number() over (partition by document_name order by chunk_id) as i from chunks where chunk_type = 'heading' and heading_level > 0 and document_name is not null group by 1, 2),
        s as (select document_name, chunk_id, i, [title] as stack from k where i = 1 union all select k.document_name, k.chunk_id, k.i, list_append(s.stack[1:k.level - 1], k.title) from s join k on k.document_name = s.document_name and k.i = s.i + 1)
        select document_name, chunk_id, array_to_string(stack, ' > ') as path from s""",
    "markup_counts": "select doc_id, "
    + ", ".join(
        (
            _N.format(t="text", p="!\\[[^\\]]*\\]\\([^)]+\\)") + " as images", _N.format(t="text", p="(?s)\\$\\$.*?\\$\\$") + " + " + _N.format(t="text", p="(?s)\\\\\\[.*?\\\\\\]") + " as block_formulas",
            _N.format(t="regexp_replace(text, '\\$\\$', chr(10) || chr(10), 'g')", p="\\$[^$]+\\$") + " + " + _N.format(t="text", p="\\\\\\(.+?\\\\\\)") + " as inline_formulas", _N.format(t="text", p="(?m)^[ \\t]*\\|") + " as table_lines",
        )
    )
    + " from documents where text is not null",
    "dialog_estimates": """with x as (select doc_id, length(text) as n, length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) as cjk, len(regexp_extract_all(text, '[a-zA-Z]+')) as latin, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) as letters from documents where text is not null)
        select doc_id, (case when n = 0 then 0 else greatest(1, cjk + floor(latin * 0.75) + floor((n - cjk - letters) * 0.5)) end)::bigint as dialog, floor(cjk * 1.5 + (n - cjk) * 0.5)::bigint as assembly from x""",
    "question_requests": f"""with q as (select distinct id, question, lower(trim(question, ' ')) as l from question_bank where question is not null), x as (select *, coalesce({', '.join(_GET.format(p=p, g=1) for p in _COUNTS)}) as plain, {_GET.format(p='(\\d+)\\s*[-~到]\\s*(\\d+)\\s*道', g=2)} as upper, {_GET.format(p='(?i)(\\d+)\\s*questions?', g=1)} as english,
        trim(regexp_extract(l, '(?:on|about|关于)\\s+(.+?)(?:\\s*$|\\s+(?:的|question|题|quiz|test|exam|level))', 1), ' ') as af, trim(regexp_extract(l, 'evaluate\\s+my\\s+(.+?)\\s+level', 1), ' ') as mi from q)
        select id, (case when plain is not null then case when plain between 1 and 50 then plain end when upper is not null then upper when english between 1 and 50 then english end)::int as asked, md5(case when af <> '' then af when mi <> '' then mi else question end) as topic_md5 from x""",
}
