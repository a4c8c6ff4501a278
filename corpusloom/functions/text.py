"""Text functions as column expressions (JVM side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning of their own in a question.
STOPWORDS = "的 了 是 在 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 怎么 什么 讲讲 说说 介绍一下 一下 请 帮我 给我 怎样 如何 为什么 吗 呢 吧 啊 哦 嗯".split()
# Openings of sentences that claim nothing.
NO_CLAIM = "请 建议 注意 简单来说 简而言之 总之".split()
# Words that tell an intent, by intent in order of priority.
INTENTS = {
    "quiz": (
        "出题", "题目", "面试题", "练习题", "测试题", "考题", "试题", "考我", "测试我", "考一下", "测一下", "做道题", "来道题",
        "quiz", "question", "exam", "test me", "give me a question", "出一道", "来一道", "来几题", "出几题", "给我出题",
    ),
    "job": (
        "职位", "招聘", "找工作", "求职", "岗位", "jd", "简历", "投递", "面试机会", "内推", "猎头", "job", "position", "hiring",
        "recruit", "career", "apply", "推荐工作", "推荐职位", "有什么职位", "招什么人",
    ),
    "evaluate": (
        "评测", "评估", "评分", "打分", "测水平", "测能力", "我水平", "我能力", "测一下我", "评估我", "评价我",
        "evaluate", "assess", "score", "rate me", "my level", "我懂多少", "我学得怎么样", "我掌握",
    ),
}
# Names that a mention with an at-sign may give, and what they stand for.
AGENTS = {"tutor": "tutor", "quiz": "quiz", "coach": "coach", "job": "job"}
# Endings and beginnings that say too little in a short name.
VAGUE_ENDS = ("聚合", "嵌入", "优化", "集成", "整合", "微调", "完善", "完整", "整体")
VAGUE_STARTS = ("完整", "整体", "全部", "总体")
# Replacements of technical terms and suffixes for query variants.
EXPANSIONS = {
    "rag": ("检索增强生成", "RAG优化"), "transformer": ("Transformer架构原理", "自注意力机制详解"), "agent": ("AI Agent架构", "智能体设计"), "mcp": ("模型上下文协议MCP", "MCP通信机制"),
    "llm": ("大语言模型原理", "LLM训练与微调"), "prompt": ("提示词工程", "Prompt Engineering"), "embedding": ("词向量Embedding", "Embedding模型选择"), "微调": ("模型微调Fine-tuning", "参数高效微调PEFT"),
    "向量数据库": ("向量检索HNSW", "近似最近邻搜索ANN"), "训练": ("分布式训练DeepSpeed", "模型训练优化"), "面试": ("AI面试题", "大模型八股文"), "优化": ("性能优化方法", "系统优化策略"),
    "缓存": ("多级缓存架构", "Redis缓存策略"), "评估": ("模型评估指标BLEU", "ROUGE评分"), "检索": ("语义检索", "混合检索BM25"),
}
SUFFIXES = "原理 详解 面试题 优化方法 实践指南".split()
# What a table of characters, a formula or code looks like.
TABLE_MARKS = "[|+─━┌┐└┘├┤┬┴┼]"
FORMULA_MARKS = r"[\x{0370}-\x{03FF}\x{2200}-\x{22FF}\^_$\\]"


def tokens(text: Column) -> Column:
    """Lower-case Latin and digit runs, and bigrams of runs of ideographs."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit(r"([a-z0-9à-öø-ÿ]+)"), 1)
    runs = F.regexp_extract_all(low, F.lit(r"([\x{4E00}-\x{9FFF}]{2,})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit("(?=(..))"), 1)))
    return F.concat(latin, pairs)


def normalized_question(text: Column) -> Column:
    """Without white space, in lower case."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def keywords(text: Column) -> Column:
    """Runs of ideographs or of Latin letters, of two characters or more, without stopwords."""
    found = F.regexp_extract_all(text, F.lit(r"([\x{4E00}-\x{9FA5}]+|[a-zA-Z]+)"), 1)
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def relevance_terms(text: Column) -> Column:
    """Distinct Latin/digit words of two or more, and bigrams of ideographs."""
    low = F.lower(plain_text(text, None))
    latin = F.regexp_extract_all(low, F.lit(r"([a-z0-9]{2,})"), 1)
    runs = F.regexp_extract_all(low, F.lit(r"([\x{4E00}-\x{9FFF}]{2,})"), 1)
    return F.array_distinct(F.concat(latin, F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit("(?=(..))"), 1)))))


def relevance(query: Column, title: Column, abstract: Column) -> Column:
    """0.72 of the title's and 0.28 of the abstract's share of query terms, at most 1."""
    q = relevance_terms(query)
    n = F.size(q)
    share = lambda t, cap: F.size(F.array_intersect(q, relevance_terms(t))) / F.greatest(F.lit(1), F.least(n, F.lit(cap)))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), share(title, 10) * 0.72 + share(abstract, 14) * 0.28))


def plain_text(text: Column, limit: int | None = None) -> Column:
    """Tags to spaces, the usual entities to characters, white space collapsed; ``limit`` cuts it off."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return t if limit is None else F.substring(t, 1, limit)


def intent(text: Column) -> Column:
    """quiz, job, evaluate or concept: the first intent one of whose words occurs."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("concept")
    for name in reversed(INTENTS):
        hit = F.lit(False)
        for w in INTENTS[name]:
            hit = hit | low.contains(w)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def query_variants(text: Column, n: int = 3) -> Column:
    """The query, its first term replaced or expanded, and suffixed forms, ``n`` in all."""
    low = F.lower(text)
    grown = F.lit(None).cast("string")
    for term, (first, _) in reversed(EXPANSIONS.items()):
        cap = term[:1].upper() + term[1:].lower()
        once = lambda t, to: F.concat(F.substring_index(text, t, 1), F.lit(to), F.substring(text, F.length(F.substring_index(text, t, 1)) + len(t) + 1, F.lit(2**30)))
        grown = F.when(low.contains(term), F.when(text.contains(term), once(term, first)).when(text.contains(cap), once(cap, first)).otherwise(F.concat(text, F.lit(" " + first)))).otherwise(grown)
    every = F.concat(F.array(text, grown), F.array(*[F.concat(text, F.lit(" " + s)) for s in SUFFIXES]))
    return F.slice(F.array_distinct(F.filter(every, lambda v: v.isNotNull())), 1, n)


def claims(text: Column) -> Column:
    """Sentences of ten characters or more that state something."""
    parts = F.transform(F.split(text, "[。！？\n]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    states = lambda s: (F.length(s) >= 10) & ~s.endswith("?") & ~s.endswith("？") & ~F.exists(F.array(*map(F.lit, NO_CLAIM)), lambda w: F.startswith(s, w)) & s.rlike(r"\d|[A-Za-z]{3}|[\x{4E00}-\x{9FFF}]{2}")
    return F.filter(parts, states)


def claim_terms(claim: Column) -> Column:
    """Distinct Latin words, numbers, and ideograph runs of two to four."""
    return F.array_distinct(F.concat(F.regexp_extract_all(claim, F.lit(r"([A-Za-z]{3,}|\d+\.?\d*%?)"), 1), F.regexp_extract_all(claim, F.lit(r"([\x{4E00}-\x{9FFF}]{2,4})"), 1)))


def term_coverage(claim: Column, source: Column) -> Column:
    """Share of a claim's terms that the source holds; null with fewer than two terms."""
    t, low = claim_terms(claim), F.lower(source)
    return F.when(F.size(t) >= 2, F.size(F.filter(t, lambda w: F.contains(low, F.lower(w)))) / F.size(t))


def page_type(text: Column) -> Column:
    """scan, formula_heavy, table or text, from a page's characters."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    n = F.length(x)
    marks = lambda p: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p))
    return F.when(n < 50, "scan").when(marks(FORMULA_MARKS) / F.greatest(n, F.lit(1)) > 0.05, "formula_heavy").when((marks(TABLE_MARKS) > 10) | (marks("\t") > 20), "table").otherwise("text")


def per_thousand(text: Column, *patterns: str) -> Column:
    """Matches of the patterns for each thousand characters."""
    hits = sum((F.regexp_count(text, F.lit(p)) for p in patterns[1:]), F.regexp_count(text, F.lit(patterns[0])))
    return hits / F.greatest(F.length(text), F.lit(1)) * 1000


def context_tokens(text: Column) -> Column:
    """Estimated tokens: one for an ideograph, one for four other characters."""
    cjk = F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    return (cjk + F.floor((F.length(text) - cjk) / 4)).cast("bigint")


def dialog_tokens(text: Column) -> Column:
    """Estimated tokens: an ideograph 1, a Latin word 0.75, any other character 0.5; 0 for none."""
    cjk = F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    latin = F.regexp_count(text, F.lit("[a-zA-Z]+"))
    letters = F.length(F.regexp_replace(text, "[^a-zA-Z]", ""))
    n = cjk + F.floor(latin * 0.75) + F.floor((F.length(text) - cjk - letters) * 0.5)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), n)).cast("bigint")


def assembly_tokens(text: Column) -> Column:
    """Estimated tokens: an ideograph 1.5, any other character 0.5."""
    cjk = F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    return F.floor(cjk * 1.5 + (F.length(text) - cjk) * 0.5).cast("bigint")


def at_mentions(text: Column) -> Column:
    """Distinct known names after an at-sign, in order, as what they stand for."""
    names = F.create_map(*[F.lit(x) for pair in AGENTS.items() for x in pair])
    found = F.transform(F.regexp_extract_all(text, F.lit(r"@([\p{L}\p{N}_]+)"), 1), lambda m: F.element_at(names, F.lower(m)))
    return F.array_distinct(F.filter(found, lambda m: m.isNotNull()))


def without_mentions(text: Column) -> Column:
    """Without names after an at-sign and the space behind them."""
    return F.trim(F.regexp_replace(text, r"@[\p{L}\p{N}_]+\s*", ""))


def asked_count(text: Column) -> Column:
    """How many questions a request asks for, up to fifty; null if it doesn't say."""
    out = F.lit(None).cast("int")
    number = lambda p, g=1: F.regexp_extract(text, p, g).try_cast("int")
    upper = number(r"(\d+)\s*[-~到]\s*(\d+)\s*道", 2)
    plain = F.coalesce(*[number(p) for p in (r"出\s*(\d+)\s*道\s*题", r"出\s*(\d+)\s*题", r"(\d+)\s*道\s*题", r"(\d+)\s*题", r"来\s*(\d+)\s*道", r"给\s*我\s*(\d+)\s*道")])
    english = number(r"(?i)(\d+)\s*questions?")
    some = lambda n: F.when((n >= 1) & (n <= 50), n)
    return F.when(plain.isNotNull(), some(plain)).when(upper.isNotNull(), upper).when(english.isNotNull(), some(english)).otherwise(out)


def asked_topic(text: Column) -> Column:
    """The topic after on, about or 关于, or between "evaluate my" and "level"; else the text."""
    q = F.lower(F.trim(text))
    after = F.regexp_extract(q, r"(?:on|about|关于)\s+(.+?)(?:\s*$|\s+(?:的|question|题|quiz|test|exam|level))", 1)
    mine = F.regexp_extract(q, r"evaluate\s+my\s+(.+?)\s+level", 1)
    return F.coalesce(F.when(after != "", F.trim(after)), F.when(mine != "", F.trim(mine)), text)


def is_vague(name: Column) -> Column:
    """Whether a name of up to four characters says too little by itself."""
    low = F.lower(name)
    hit = F.lit(False)
    for w in VAGUE_ENDS:
        hit = hit | low.endswith(w)
    for w in VAGUE_STARTS:
        hit = hit | low.startswith(w)
    return (F.length(low) <= 4) & hit


def markup_counts(text: Column) -> dict[str, Column]:
    """Images, block and inline formulas, and table lines of a Markdown text."""
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("bigint")
    return {
        "images": n(r"!\[[^\]]*\]\([^)]+\)"),
        "block_formulas": n(r"(?s)\$\$.*?\$\$") + n(r"(?s)\\\[.*?\\\]"),
        "inline_formulas": F.regexp_count(F.regexp_replace(text, r"\$\$", "\n\n"), F.lit(r"\$[^$]+\$")).cast("bigint") + n(r"\\\(.+?\\\)"),
        "table_lines": n(r"(?m)^[ \t]*\|"),
    }


def theme_forms(heading: Column) -> Column:
    """Comparable forms of a heading: whole, without its number, its abbreviation, without brackets."""
    h = F.trim(heading)
    bare = F.trim(F.regexp_replace(F.regexp_replace(h, r"^[\d.\s、]+", ""), r"^第[一二三四五六七八九十\d]+[章节]\s*", ""))
    short = F.regexp_extract(h, r"\(([A-Z-]+)\)", 1)
    open_ = F.trim(F.regexp_replace(h, r"\s*\([^)]+\)", ""))
    forms = F.array(*[comparable(x) for x in (h, bare, short, open_)])
    return F.array_distinct(F.filter(forms, lambda f: f != ""))


def comparable(text: Column) -> Column:
    """Lower case, letters, digits and underscores only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", "")


def string_list(text: Column) -> Column:
    """A stored list: JSON, else parts between separators; nothing for null or empty text."""
    parsed = F.from_json(text, "array<string>")
    parts = F.filter(F.transform(F.split(text, "[;,；，|]"), lambda s: F.trim(s)), lambda s: s != "")
    return F.coalesce(F.when(F.trim(text).startswith("["), parsed), parts, F.array().cast("array<string>"))


def hashed_words(text: Column, dim: int = 2048) -> Column:
    """Entries (slot, weight) of a hash embedding: +1 at md5 and +0.5 at sha256 of each word.

    ``dim`` is a power of two up to 4096, so the last three hex digits hold the slot.
    """
    ws = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    slot = lambda digest: F.pmod(F.conv(F.right(digest, F.lit(3)), 16, 10).cast("int"), F.lit(dim))
    one = F.transform(ws, lambda w: F.struct(slot(F.md5(w.cast("binary"))).alias("slot"), F.lit(1.0).alias("weight")))
    two = F.transform(ws, lambda w: F.struct(slot(F.sha2(w.cast("binary"), 256)).alias("slot"), F.lit(0.5).alias("weight")))
    return F.concat(one, two)
