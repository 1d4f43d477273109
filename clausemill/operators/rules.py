"""Classification and rule tagging (L1-L21). Rule tables are small and written out, so rows are tagged in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.operators.structure import authority_of

# Intent patterns in class order, and the other rule tables of this family.
INTENT_PATTERNS = {
    "regulatory": ["要求", "规定", "必须", "应当", "限制", "标准", "规范", "批准", "符合性", "偏离", "豁免", "审定",
                   "require", "requirement", "standard", "shall", "must", "compliance", "deviation", "exemption"],
    "method": ["如何", "怎么", "方法", "步骤", "流程", "操作", "检测", "计算", "验证", "试验", "测试", "安装", "检查", "工作原理",
               "how", "method", "procedure", "step", "process", "calculate", "determine", "verify", "test", "install", "inspect"],
    "comparison": ["区别", "差异", "比较", "对比", "不同", "优缺点", "哪一个更好", "异同", "有何不同", "差异大吗",
                   "difference", "compare", "comparison", "versus", "vs", "between", "advantage", "disadvantage"],
    "definition": ["什么是", "定义", "含义", "概念", "解释", "说明", "是指", "包括哪些", "工作原理", "什么意思", "含义是",
                   "what is", "definition", "meaning", "concept", "explain", "describe", "define", "include"],
    "numerical": ["多少", "数值", "范围", "最小", "最大", "极限", "限制值", "阈值", "温度", "压力", "转速", "飞行小时", "摄氏",
                  "how many", "how much", "value", "range", "minimum", "maximum", "limit", "threshold", "temperature", "pressure", "rpm"],
    "cross_reference": ["对应条款", "等效条款", "对应", "等效", "相当于", "与...对应", "交叉", "交叉点",
                        "corresponds to", "correspond to", "equivalent to", "equivalent regulation", "correspondence"],
}
AUTHORITY_WEIGHTS = {
    "CCAR": 10.0, "CAAC": 8.0, "FAA": 9.0, "FAR": 9.0, "14 CFR": 8.5, "AC": 7.0, "EASA": 9.0, "CS": 8.0, "AMC": 6.0,
    "SAE": 6.0, "ISO": 5.0, "ASTM": 5.0,
}
QUERY_TYPES = [("要求|标准|限值|规定", "regulatory"), ("方法|程序|如何|怎么", "method"), ("比较|差异|区别", "comparison")]
COMPARISON_WORDS = ["vs", "versus", "与", "和", "对比", "差异", "区别"]
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?previous\s+instructions?", r"forget\s+everything", r"disregard\s+(your\s+)?instructions?",
    r"you\s+are\s+now\s+", r"act\s+as\s+", r"pretend\s+you\s+are", r"system\s*[:：]", r"instruction\s*[:：]",
    r"<(?:system|instructions?)>", r"\[SYSTEM\]", r"---\s*system",
]
INJECTION_NOTE = "[内容已审查 - 原句]: "
NODE_FAMILIES = {
    "regulation": ["chapter", "section", "regulation", "requirement", "clause"],
    "component": ["component", "rotorpart", "statorpart", "accessory", "module", "system"],
}
ENRICH_REQUIREMENTS = ["必须", "应当", "应该", "要求", "不得", "需", "shall", "must", "should", "require", "need"]


def with_intents(df: DataFrame, query: str = "query", patterns: dict[str, list[str]] = INTENT_PATTERNS) -> DataFrame:
    """Adds `intents`: array<struct<ord, intent, score>>, one entry per class in table order.

    The steps are separate columns so that each is computed once per row.
    """
    low, toks = F.col("_low"), F.col("_toks")

    def class_score(words: list[str]) -> Column:
        rules = F.array(*[F.struct(F.lit(w).alias("w"), tx.tokens(F.lit(w)).alias("t")) for w in words])
        points = lambda r: (
            F.when(low.contains(r["w"]), 3.0).otherwise(0.0)
            + F.when(F.arrays_overlap(r["t"], toks), 0.5).otherwise(0.0)
            + F.when(F.position(r["w"], low).between(1, 5), 2.0).otherwise(0.0)
        )
        return F.aggregate(rules, F.lit(0.0), lambda a, r: a + points(r))

    names = list(patterns)
    out = df.withColumn("_low", F.lower(query)).withColumn("_toks", tx.tokens(low))
    out = out.withColumn("_raw", F.array(*[class_score(words) for words in patterns.values()]))
    out = out.withColumn("_total", F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x))
    out = out.withColumn("_share", F.transform("_raw", lambda x: F.when(F.col("_total") > 0, x / F.col("_total")).otherwise(0.0)))
    share = F.col("_share")
    if "regulatory" in names and "method" in names:
        i, j = names.index("regulatory"), names.index("method")
        both = (share[i] > 0.3) & (share[j] > 0.2)
        mid = (share[i] + share[j]) / 2 * 0.6
        share = F.transform("_share", lambda x, n: F.when(both & n.isin(i, j), mid).otherwise(x))
    labels = F.array(*[F.lit(n) for n in names])
    entry = lambda x, n: F.struct(n.alias("ord"), F.element_at(labels, n + 1).alias("intent"), x.alias("score"))
    return out.withColumn("intents", F.transform(share, entry)).drop("_low", "_toks", "_raw", "_total", "_share")


def intent_scores(queries: DataFrame, patterns: dict[str, list[str]] = INTENT_PATTERNS) -> DataFrame:
    """L1: share of every intent class per query."""
    return with_intents(queries, patterns=patterns).select("query_id", F.inline("intents"))


def primary_intent(queries: DataFrame, patterns: dict[str, list[str]] = INTENT_PATTERNS) -> DataFrame:
    """L2: best class per query, first in table order on ties; keeps the query columns."""
    best = F.array_max(F.transform("intents", lambda s: F.struct(s["score"], -s["ord"], s["intent"])))
    out = with_intents(queries, patterns=patterns).withColumn("_b", best)
    return out.withColumns({"intent": F.col("_b.intent"), "confidence": F.col("_b.score")}).drop("_b", "intents")


def query_type(query: Column, rules: list[tuple[str, str]] = QUERY_TYPES) -> Column:
    """L3: first matching type, else general."""
    out = F
    for pattern, name in rules:
        out = out.when(query.rlike(pattern), name)
    return out.otherwise("general")


def retrieval_plan(queries: DataFrame) -> DataFrame:
    """L4: strategy, top_k and expansion flag from the intent; optional request columns override.

    queries(query_id, intent, confidence[, requested_k INT, requested_mode STRING]).
    """
    i = F.col("intent")
    unsure = F.col("confidence") < 0.5
    strategy = F.when(unsure, "expanded").when(i.isin("numerical", "method"), "expanded").when(
        i == "comparison", "multi_source").when(i == "cross_reference", "graph_first").otherwise("simple")
    k = F.when(i.isin("numerical", "method"), 5).when(i == "comparison", 4).otherwise(3)
    expansion = i.isin("numerical", "method") | unsure
    if "requested_k" in queries.columns:
        k = F.when(F.col("requested_k").isNotNull(), F.greatest(F.lit(1), F.least(F.col("requested_k"), F.lit(10)))).otherwise(k)
    if "requested_mode" in queries.columns:
        mode = F.replace(F.lower(F.trim("requested_mode")), F.lit("-"), F.lit("_"))
        for alias, name in {"graph": "graph_first", "multi": "multi_source", "brief": "concise", "full": "detailed"}.items():
            mode = F.when(mode == alias, name).otherwise(mode)
        strategy = F.when(mode.isin("simple", "expanded", "multi_source", "graph_first"), mode).otherwise(strategy)
        k = F.when(mode == "detailed", F.greatest(k, F.lit(5))).otherwise(k)
    return queries.withColumns({"strategy": strategy, "top_k": k.cast("long"), "use_expansion": expansion})


def subqueries(queries: DataFrame, words: list[str] = COMPARISON_WORDS, at_most: int = 4) -> DataFrame:
    """Parts around the first comparison word found (longer than 2), else the last two phrases, else the query."""
    low = F.lower("query")
    parts = F
    for w in words:
        parts = parts.when(low.contains(w), F.split(low, F.lit("\\Q" + w + "\\E")))
    cut = F.filter(F.transform(parts.otherwise(F.array().cast("array<string>")), F.trim), lambda p: F.length(p) > 2)
    tail = F.slice(tx.phrases(F.col("query")), F.greatest(F.size(tx.phrases(F.col("query"))) - 1, F.lit(1)), 2)
    chosen = F.when(F.size(cut) > 0, cut).when(F.size(tail) > 0, tail).otherwise(F.array("query"))
    return queries.select("query_id", F.posexplode(F.slice(chosen, 1, at_most)).alias("sub", "text"))


def classify_domain_first(title: Column, content: Column, domains: dict[str, list[str]], numbers: list[tuple[str, str]] = ()) -> Column:
    """First keyword of the table found in title or content decides; then number rules (regex on the title)."""
    out = F
    for domain, words in domains.items():
        out = out.when(tx.contains_any(F.lower(title), words) | tx.contains_any(F.lower(content), words), domain)
    for pattern, domain in numbers:
        out = out.when(title.rlike(pattern), domain)
    return out.otherwise(None)


def classify_domain_scored(title: Column, content: Column, domains: dict[str, list[str]]) -> Column:
    """+10 per keyword in the title, +5 per keyword in the content; best positive score, first on ties."""
    scored = [
        F.struct(
            (tx.count_contained(F.lower(title), words) * 10 + tx.count_contained(F.lower(content), words) * 5).alias("s"),
            F.lit(-n).alias("o"), F.lit(domain).alias("d"),
        )
        for n, (domain, words) in enumerate(domains.items())
    ]
    best = F.array_max(F.array(*scored))
    return F.when(best["s"] > 0, best["d"])


def content_flags(content: Column, requirement: list[str], material: list[str], sentence_end: str = "。") -> dict[str, Column]:
    """Flags of a section's content and its first three key sentences (cut at 100 characters)."""
    key = F.filter(
        F.transform(F.split(content, sentence_end), tx.strip), lambda s: (F.length(s) > 10) & tx.contains_any(s, requirement)
    )
    return {
        "has_requirements": tx.contains_any(content, requirement),
        "has_percent": content.rlike(r"[0-9]+%"),
        "has_temperature": content.rlike(r"[0-9]+°?[CFc]"),
        "has_time": content.rlike(r"[0-9]+\s*(秒|分钟|小时)"),
        "has_material": tx.contains_any(content, material),
        "key_sentences": F.transform(F.slice(key, 1, 3), lambda s: F.substring(s, 1, 100)),
    }


def implications(sections: DataFrame, rules: list[tuple[str, str | None, str]], content: str = "text") -> DataFrame:
    """Notes of the rules (domain, keyword or None, note) that fit a section. sections(node_id, domain, ...)."""
    table = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).cast("string").alias("w"), F.lit(n).alias("n"), F.lit(i).alias("o"))
                      for i, (d, w, n) in enumerate(rules)])
    hit = F.filter(table, lambda r: (r["d"] == F.col("domain")) & (r["w"].isNull() | F.lower(content).contains(r["w"])))
    return sections.select("node_id", "domain", F.explode(hit).alias("h")).select("node_id", "domain", F.col("h.o").alias("ordinal"), F.col("h.n").alias("note"))


def interpretations(sections: DataFrame, templates: DataFrame, default: dict[str, str]) -> DataFrame:
    """Domain templates joined to sections, defaults elsewhere. templates(domain, requirements, methods, checklist)."""
    out = sections.join(templates, "domain", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in default.items()})


def checklists(interpreted: DataFrame, high: list[str]) -> DataFrame:
    """One task per checklist entry; HIGH for the listed domains. checklist entries are separated by ';'."""
    return interpreted.select(
        "node_id", "domain", F.posexplode(F.split("checklist", ";")).alias("step", "task"),
    ).withColumn("priority", F.when(F.col("domain").isin(high), "HIGH").otherwise("MEDIUM"))


def verification_plans(interpreted: DataFrame) -> DataFrame:
    """The verification methods of every section that has some; entries are separated by ';'."""
    rows = interpreted.filter(F.coalesce(F.trim("methods"), F.lit("")) != "")
    return rows.select("node_id", "domain", F.transform(F.split("methods", ";"), lambda m: F.trim(m)).alias("plan"))


def design_tasks(interpreted: DataFrame, high: list[str]) -> DataFrame:
    """One task per design requirement with the section's verification; HIGH for the listed domains."""
    rows = interpreted.filter(F.coalesce(F.trim("requirements"), F.lit("")) != "")
    return rows.select(
        "node_id", "domain", F.posexplode(F.split("requirements", ";")).alias("step", "task"), F.coalesce("methods", F.lit("")).alias("verification"),
    ).withColumns({"task": F.trim("task"), "priority": F.when(F.col("domain").isin(high), "HIGH").otherwise("MEDIUM")})


def design_parameters(interpreted: DataFrame, pattern: str = r"\d+(?:\.\d+)?\s*(?:%|[A-Za-z]+)", text: str = "text") -> DataFrame:
    """Per section with a domain the distinct parameters (value and unit) of its text, in order; sections without any are left out."""
    found = F.array_distinct(F.transform(tx.matches(F.col(text), pattern), lambda m: F.trim(m)))
    return interpreted.filter("domain IS NOT NULL").select("node_id", "domain", F.posexplode(found).alias("step", "parameter"))


def compliance_methods(sections: DataFrame, methods: dict[str, list[str]], sentence_end: str = r"[。；;]", content: str = "text") -> DataFrame:
    """For every method keyword in a section the first sentence that holds it (cut at 200 characters)."""
    sentences = F.split(F.col(content), sentence_end)

    def first_with(word: str) -> Column:
        return F.get(F.filter(sentences, lambda s: F.lower(s).contains(word.lower())), F.lit(0))

    rows = F.array(*[
        F.struct(F.lit(m).alias("method"), F.lit(w).alias("keyword"), first_with(w).alias("s"))
        for m, words in methods.items() for w in words
    ])
    found = sections.select("node_id", F.inline(F.filter(rows, lambda r: r["s"].isNotNull())))
    return found.select("node_id", "method", "keyword", F.substring(tx.strip(F.col("s")), 1, 200).alias("context"))


def compliance_context(content: Column, groups: dict[str, list[str]]) -> dict[str, Column]:
    """One flag per group of words and the first word found in it."""
    low = F.lower(content)
    out = {}
    for name, words in groups.items():
        out[f"has_{name}"] = tx.contains_any(low, words)
        out[f"first_{name}"] = F.coalesce(F.get(tx.contained(low, words), F.lit(0)), F.lit(""))
    return out


def enrich_metadata(results: DataFrame, urls: DataFrame, agencies: list[tuple[str, str]], facts: DataFrame | None = None, preview: int = 200) -> DataFrame:
    """Chapter, section, ids, version, type, agency, lengths, requirement flag, preview and citation.

    results(doc, title, text, page), urls(doc, url), facts(doc, version, type); `unknown` where facts has no row.
    """
    title = F.col("title")
    chapter = F.coalesce(
        tx.first_match(title, "([A-Z])章", 1), F.when(title.contains("总则") | title.contains("General"), "A"),
        F.when(title.contains("性能") | title.contains("Performance"), "性能"),
        F.when(title.contains("设计与构造") | title.contains("Design"), "设计"), F.lit(""),
    )
    section = F.coalesce(tx.section_number(title), F.lit(""))
    agency = F
    for prefix, name in agencies:
        agency = agency.when(F.col("doc").startswith(prefix), name)
    out = results.withColumns(
        {
            "chapter": chapter, "section": section, "agency": agency.otherwise("UNKNOWN"),
            "document_id": F.concat(F.lit("doc_"), F.translate(F.lower("doc"), "-.", "__")),
            "content_length": F.length("text").cast("long"),
            "has_requirements": tx.contains_any(F.lower("text"), ENRICH_REQUIREMENTS),
        }
    ).join(urls, "doc", "left")
    link = F.when(F.col("url").isNull(), "").when(
        F.col("section") != "", F.concat("url", F.lit("#section-"), F.replace("section", F.lit("."), F.lit("_")))
    ).otherwise(F.col("url"))
    if facts is None:
        out = out.withColumns({"version": F.lit(None).cast("string"), "type": F.lit(None).cast("string")})
    else:
        out = out.join(facts.select("doc", "version", "type"), "doc", "left")
    both = (F.col("chapter") != "") & (F.col("section") != "")
    return out.withColumns(
        {
            "citation": F.concat("doc", F.lit(" §"), "section"), "source_link": link,
            "document_version": F.coalesce("version", F.lit("unknown")), "document_type": F.coalesce("type", F.lit("unknown")),
            "chapter_section": F.when(both, F.concat("chapter", F.lit(" > "), "section")).otherwise(F.col("section")),
            "preview": F.when(F.length("text") > preview, F.concat(F.substring("text", 1, preview), F.lit("..."))).otherwise(F.col("text")),
        }
    ).drop("url", "version", "type")


def authority_score(source: Column, doc_type: Column, chapter: Column, weights: dict[str, float] = AUTHORITY_WEIGHTS) -> Column:
    """Highest weight whose key occurs in source or type, plus 1 when the chapter holds a digit."""
    up = F.upper(F.concat_ws("\n", source, doc_type))
    best = F.greatest(F.lit(0.0), *[F.when(up.contains(k), w).otherwise(0.0) for k, w in weights.items()])
    return best + F.when(F.coalesce(chapter, F.lit("")).rlike("[0-9]"), 1.0).otherwise(0.0)


def domain_of_query(query: Column, domains: dict[str, list[str]], default: str = "general") -> Column:
    """First domain with a keyword in the query."""
    out = F
    for domain, words in domains.items():
        out = out.when(tx.contains_any(F.lower(query), words), domain)
    return out.otherwise(default)


def agency_of_node(nodes: DataFrame, edges: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """By id, then label, then by a neighbouring node whose id names an agency (smallest name wins)."""
    def by(c: str) -> Column:
        return F.nullif(authority_of(F.col(c), rules), F.lit("OTHER"))

    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("n")).union(edges.select("dst", "src"))
    near = both.withColumn("a", by("n")).filter("a is not null").groupBy("id").agg(F.min("a").alias("near"))
    return nodes.join(near, "id", "left").select("id", F.coalesce(by("id"), by("label"), "near", F.lit("OTHER")).alias("agency"))


def node_family(type_: Column, families: dict[str, list[str]] = NODE_FAMILIES, other: str = "support") -> Column:
    """Raw node type -> regulation, component or support."""
    out = F
    for family, types in families.items():
        out = out.when(F.lower(type_).isin(types), family)
    return out.otherwise(other)


def screen_injection(texts: DataFrame, id: str = "doc_id", text: str = "text", patterns: list[str] = INJECTION_PATTERNS) -> DataFrame:
    """Flags texts with suspicious lines and neutralises those lines; control characters are dropped."""
    rule = "(?i)(" + "|".join(patterns) + ")"
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    lines = F.split(clean, "\n")
    safe = F.transform(lines, lambda x: F.when(x.rlike(rule), F.concat(F.lit(INJECTION_NOTE), F.substring(x, 1, 80), F.lit("..."))).otherwise(x))
    return texts.select(id, F.exists(lines, lambda x: x.rlike(rule)).alias("suspicious"), F.array_join(safe, "\n").alias("safe_text"))
