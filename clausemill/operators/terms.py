"""Token, dictionary and term-mining jobs over a corpus (ids K1-K25 of the survey)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions.scale import containment_join, stored

# Word lists of the term rules.
ALLOWED_ABBREVIATIONS = ["APU", "OEI", "ETOPS", "VMC", "VNE", "TC", "PC", "FAR", "CCAR", "CS"]
TERM_SUFFIXES = [
    "系统", "装置", "设备", "测试", "试验", "要求", "规定", "保护", "控制", "监测", "指示", "记录", "报警", "防火",
    "防爆", "应急", "撤离", "液压", "燃油", "电气", "电子",
]
TERM_CONTEXTS = ["要求", "规定", "必须", "应当", "符合", "满足"]
TERM_CATEGORIES = {
    "发动机": ["发动机", "引擎", "engine", "turbine", "combustor", "压气机", "燃烧室"],
    "飞行": ["飞行", "flight", "起飞", "降落", "爬升", "巡航", "下降"],
    "系统": ["系统", "system", "液压", "燃油", "电气", "空调"],
    "安全": ["安全", "safety", "防火", "防爆", "应急", "emergency"],
    "结构": ["结构", "structure", "机身", "机翼", "起落架", "襟翼"],
    "测试": ["测试", "test", "试验", "验证", "verification"],
    "适航": ["适航", "airworthiness", "规章", "regulation", "CCAR", "FAR"],
}
REQUIREMENT_WORDS = ["必须", "应当", "要求", "不得", "shall", "must"]
SECTION_KEYWORDS = [
    "防火", "强度", "疲劳", "载荷", "振动", "噪音", "排放", "试验", "验证", "认证", "审定", "适航", "发动机", "机翼",
    "机身", "起落架", "襟翼", "副翼", "APU", "OEI", "ETOPS",
]


def tokenize(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """K1: one row per token with its 0-based position."""
    return df.select(id, F.posexplode(tx.tokens(F.col(text))).alias("pos", "token"))


def tokenize_search(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """K2: distinct index tokens (CJK characters and bigrams), order kept."""
    return df.select(id, F.posexplode(tx.search_tokens(F.col(text))).alias("pos", "token"))


def phrase_candidates(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """K3: distinct phrases in order of first appearance."""
    return df.select(id, F.posexplode(tx.phrases(F.col(text))).alias("pos", "phrase"))


def enhanced_tokens(text: Column, stop: list[str], stop_cjk: list[str], terms: list[str]) -> Column:
    """K4 as an expression: identifier parts of two or more characters, dictionary terms or bigrams, characters."""
    parts = F.filter(
        tx.matches(F.lower(text), r"[\p{L}&&[^一-鿿]]+|\p{N}+"), lambda w: (F.length(w) >= 2) & ~w.isin(stop)
    )
    keep = lambda grams: F.filter(grams, lambda g: ~g.isin(stop_cjk))

    def of_run(run: Column) -> Column:
        known = F.filter(tx.ngrams_between(run, 2, 4), lambda g: g.isin(terms))
        return F.concat(F.when(F.size(known) > 0, known).otherwise(keep(tx.char_ngrams(run, 2))), keep(tx.char_ngrams(run, 1)))

    cjk = F.flatten(F.transform(tx.matches(text, f"[{tx.CJK}]+"), of_run))
    return F.array_distinct(F.when(text.rlike(f"[{tx.CJK}]"), F.concat(parts, cjk)).otherwise(parts))


def tokenize_enhanced(df, stop, stop_cjk=("的",), terms=("",), id="doc_id", text="text") -> DataFrame:
    return df.select(id, F.explode(enhanced_tokens(F.col(text), list(stop), list(stop_cjk), list(terms))).alias("token"))


def ngram_tokens(text: Column) -> Column:
    """K5 as an expression: blank-separated tokens of two or more characters plus CJK 2-4-grams."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s,，。？！]+"), lambda w: F.length(w) >= 2)
    grams = F.flatten(F.transform(tx.matches(text, f"[{tx.CJK}]+"), lambda r: tx.ngrams_between(r, 2, 4)))
    return F.array_distinct(F.when(text.rlike(f"[{tx.CJK}]"), F.concat(words, grams)).otherwise(words))


def tokenize_ngram(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(id, F.explode(ngram_tokens(F.col(text))).alias("token"))


def query_keywords(df: DataFrame, stop: list[str], id: str, text: str, limit: int = 6) -> DataFrame:
    """K6: the first distinct keywords of a query, stop words and single characters left out."""
    words = F.filter(tx.tokens(F.col(text)), lambda w: (F.length(w) >= 2) & ~w.isin(stop))
    return df.select(id, F.posexplode(F.slice(F.array_distinct(words), 1, limit)).alias("pos", "keyword"))


def two_hop_synonyms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Terms with their synonyms and the synonyms of those. terms: any key columns + term."""
    keys = [c for c in terms.columns if c != "term"]
    pairs = synonyms.select("term", "synonym").distinct()
    one = terms.join(pairs, "term").select(*keys, F.col("synonym").alias("term")).distinct()
    two = one.join(pairs, "term").select(*keys, F.col("synonym").alias("term"))
    return terms.unionByName(one).unionByName(two).distinct()


def expand_synonyms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """K7: phrases of the query, their synonyms, and the synonyms of those."""
    found = queries.select("query_id", F.explode(tx.phrases(F.col("query"))).alias("term"))
    return two_hop_synonyms(found, synonyms)


def expand_mixed(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """K8: CJK runs, dictionary n-grams of long runs, words, adjacent word pairs, their synonyms, the whole query."""
    q = F.col("query")
    runs = tx.matches(q, f"[{tx.CJK}]+")
    words = F.transform(tx.matches(q, r"[a-zA-Z][a-zA-Z0-9\-]*"), F.lower)
    pairs = F.when(
        F.size(words) >= 2,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - 1),
            lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    units = F.array_distinct(F.concat(runs, words, pairs))
    spoken = queries.select("query_id", F.explode(units).alias("term"))
    inner = spoken.select("query_id", F.explode(tx.phrases(F.col("term"))).alias("term")).distinct()
    long_runs = F.filter(runs, lambda r: F.length(r) > 4)
    grams = F.array_distinct(F.flatten(F.transform(long_runs, lambda r: tx.ngrams_between(r, 2, 5))))
    known = synonyms.select("term", "synonym").distinct()
    hits = queries.select("query_id", F.explode(grams).alias("term")).join(known, "term")
    sub = hits.select("query_id", "term").union(hits.select("query_id", "synonym"))
    whole = queries.select("query_id", q.alias("term"))
    out = spoken.unionByName(two_hop_synonyms(inner, synonyms)).unionByName(sub).unionByName(whole)
    return out.filter(F.length(F.trim("term")) > 0).distinct()


def contained_terms(texts: DataFrame, id: str, text: str, terms: DataFrame) -> DataFrame:
    """(id, term) for every dictionary term inside the text, whatever its length: joined on first characters, then verified."""
    return containment_join(texts.select(id, text), text, terms.select("term").distinct(), "term").select(id, "term").distinct()


def expand_by_containment(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """K9: a contained standard term gives all its synonyms, a contained synonym gives the standard term."""
    pairs = synonyms.select("term", "synonym").distinct()
    names = pairs.select("term").union(pairs.select("synonym"))
    hits = contained_terms(queries, "query_id", "query", names)
    down = hits.join(pairs, "term").select("query_id", F.col("synonym").alias("term"))
    up = hits.withColumnRenamed("term", "synonym").join(pairs, "synonym").select("query_id", "term")
    return down.union(up).distinct()


def normalise_terms(df: DataFrame, synonyms: DataFrame, column: str) -> DataFrame:
    """Replace a synonym by its standard term; the later dictionary entry wins."""
    reverse = synonyms.groupBy(F.col("synonym").alias(column)).agg(F.max_by("term", F.struct("ordinal", "term")).alias("_std"))
    return df.join(reverse, column, "left").withColumn("standard", F.coalesce("_std", column)).drop("_std")


def tag_terms(texts: DataFrame, id: str, text: str, categories: dict[str, dict[str, list[str]]]) -> DataFrame:
    """(id, category, term) where the term or one of its synonyms occurs in the text.

    `categories` is a rule table written out in code, so it is tested inside each row: no join, no shuffle.
    """
    rules = F.array(
        *[
            F.struct(F.lit(c).alias("category"), F.lit(t).alias("term"), F.array(*[F.lit(w) for w in [t, *syn]]).alias("words"))
            for c, terms in categories.items()
            for t, syn in terms.items()
        ]
    )
    hit = F.filter(rules, lambda r: F.exists(r["words"], lambda w: F.col(text).contains(w)))
    return df_explode(texts, id, hit)


def df_explode(texts: DataFrame, id: str, hits: Column) -> DataFrame:
    return texts.select(id, F.explode(hits).alias("h")).select(id, "h.category", "h.term")


def related_terms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Dictionary names that contain a term or are contained in it (either way), of any length."""
    names = synonyms.select(F.col("term").alias("name")).union(synonyms.select("synonym")).distinct()
    mine = terms.select("term").distinct()
    inside = containment_join(mine, "term", names, "name").select("term", "name")
    around = containment_join(names, "name", mine, "term").select("term", "name")
    return inside.union(around).filter("term <> name").distinct()


def corpus_terms(sections: DataFrame, pattern: str = rf"[{tx.CJK}]{{2,4}}", text: str = "text") -> DataFrame:
    """(doc, node_id, term) for every match of the term pattern, repeats kept."""
    return sections.select("doc", "node_id", F.explode(tx.matches(F.col(text), pattern)).alias("term"))


def term_statistics(sections: DataFrame, pattern: str = rf"[{tx.CJK}]{{2,4}}", text: str = "text") -> DataFrame:
    """Occurrences, documents and sections per term.

    Three levels of pre-aggregation (section, document, term) keep a very frequent term spread out.
    """
    per_section = corpus_terms(sections, pattern, text).groupBy("term", "doc", "node_id").agg(F.count("*").alias("n"))
    per_doc = per_section.groupBy("term", "doc").agg(F.sum("n").alias("n"), F.count("*").alias("sections"))
    return per_doc.groupBy("term").agg(
        F.sum("n").alias("frequency"), F.count("*").alias("documents"), F.sum("sections").alias("sections"),
        F.max("n").alias("max_per_document"),
    )


def section_statistics(sections: DataFrame, requirement=REQUIREMENT_WORDS, keywords=SECTION_KEYWORDS) -> DataFrame:
    """Content length, requirement flag and keywords per section."""
    body = F.concat("summary", F.array_join("content_parts", " "))
    length = F.length("summary") + F.aggregate("content_parts", F.lit(0), lambda a, p: a + F.length(p))
    return sections.select(
        "doc", "number", "node_id", length.cast("long").alias("content_length"),
        tx.contains_any(body, requirement).alias("has_requirements"),
        F.array_join(tx.contained(F.concat("title", body), keywords), "|").alias("keywords"),
    )


def term_type(term: Column) -> Column:
    """Kind of a term by its characters."""
    return (
        F.when((F.upper(term) == term) & (F.length(term) <= 6), "abbreviation")
        .when(term.rlike("[一二三四五六七八九十百分]"), "numeric")
        .when(term.rlike(f"^[{tx.CJK}]+$"), "chinese")
        .when(term.rlike(r"^[a-zA-Z\s]+$"), "english")
        .otherwise("mixed")
    )


def term_category(term: Column, categories: dict[str, list[str]] = TERM_CATEGORIES) -> Column:
    """First category with a keyword inside the term."""
    out = F
    for name, words in categories.items():
        out = out.when(tx.contains_any(term, words), name)
    return out.otherwise("other")


def term_occurrences(sections: DataFrame, known: dict[str, list[str]], compound: str = r"[A-Z][a-z]+-[A-Z][a-z]+") -> DataFrame:
    """(doc, node_id, term) once per section: dictionary terms, abbreviations, likely CJK terms, capitalised words,
    compounds and percentages."""
    full = F.concat_ws(" ", "title", "summary", F.array_join("content_parts", " "))
    rules = F.array(*[F.struct(F.lit(t).alias("t"), F.array(*[F.lit(w) for w in s]).cast("array<string>").alias("s")) for t, s in known.items()])
    hit = F.filter(rules, lambda r: F.col("full").contains(r["t"]))
    names = F.flatten(F.transform(hit, lambda r: F.concat(F.array(r["t"]), F.filter(r["s"], lambda w: F.col("full").contains(w)))))
    spoken = tx.matches(F.col("full"), r"[\p{L}\p{N}_]+")
    abbr = F.filter(spoken, lambda a: a.isin(ALLOWED_ABBREVIATIONS))
    in_context = tx.contains_any(F.col("full"), TERM_CONTEXTS)
    cjk = F.filter(
        tx.matches(F.col("full"), f"[{tx.CJK}]{{2,8}}"),
        lambda t: in_context | t.rlike("(" + "|".join(TERM_SUFFIXES) + ")$"),
    )
    words = F.transform(F.filter(spoken, lambda w: w.rlike(r"^[A-Z][A-Za-z]{3,}$")), F.lower)
    compounds = tx.matches(F.col("full"), compound)
    percents = F.transform(tx.matches(F.col("full"), r"([0-9]+(?:\.[0-9]+)?)\s*%", 1), lambda p: F.concat(F.lit("value:"), p, F.lit("%")))
    every = F.array_distinct(F.concat(names, abbr, cjk, words, compounds, percents))
    return sections.withColumn("full", full).select("doc", "node_id", F.explode(every).alias("term")).filter(F.length("term") >= 2)


def extract_terms(occurrences: DataFrame, min_freq: int = 2) -> DataFrame:
    """Frequency, documents, type and category of the terms that reach the minimum frequency."""
    t = F.col("term")
    per_doc = occurrences.groupBy("term", "doc").agg(F.count("*").alias("n"))
    stats = per_doc.groupBy("term").agg(F.sum("n").alias("frequency"), F.count("*").alias("documents"))
    value = t.startswith("value:")
    return stats.filter(F.col("frequency") >= min_freq).withColumns(
        {"type": F.when(value, "value").otherwise(term_type(t)), "category": F.when(value, "percentage").otherwise(term_category(t))}
    )


SLOTS = 1 << 22  # pair counters: one byte each, so a task and the driver hold 4 MB
SHARES = 64  # parts in which the counters of all tasks are added up
RUN = 1 << 20  # pairs that are looked at together


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, slot) of all pairs a < b inside each sorted list, in runs of about RUN pairs, whatever the lists' length."""
    left, right, size = [], [], 0

    def run():
        a, b = np.concatenate(left), np.concatenate(right)
        mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(0x165667B19E3779F9))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return a, b, (mixed >> np.uint64(42)).astype(np.int64)  # 22 bits

    for batch in batches:
        lists = batch.column(0)
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            codes = flat[start:end]
            at = 0
            while at < len(codes) - 1:
                rows = max(1, min(len(codes) - 1 - at, RUN // len(codes)))
                i = np.arange(at, at + rows)
                per = len(codes) - 1 - i
                left.append(np.repeat(codes[i], per))
                right.append(codes[np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(i + 1, per)])
                size += int(per.sum())
                at += rows
                if size >= RUN:
                    yield run()
                    left, right, size = [], [], 0
    if size:
        yield run()


def _counters(lists: DataFrame) -> np.ndarray:
    """Occurrences of all pairs, added up by hash into SLOTS bytes (255: that many or more)."""

    def count(batches):
        counts = np.zeros(SLOTS, np.uint8)
        for _, _, slot in _pairs(batches):
            where, n = np.unique(slot, return_counts=True)
            counts[where] = np.minimum(counts[where].astype(np.int64) + n, 255)
        parts = counts.reshape(SHARES, -1)
        held = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([parts[h].tobytes() for h in held], pa.binary())], ["part", "counts"])

    def add(table):
        total = np.zeros(SLOTS // SHARES, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_buffer(), np.uint8)
        return pa.table({"part": table.column("part").slice(0, 1), "counts": [np.minimum(total, 255).astype(np.uint8).tobytes()]})

    out = np.zeros((SHARES, SLOTS // SHARES), np.uint8)
    for r in lists.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[r.part] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def cooccurrence(occurrences: DataFrame, terms: DataFrame, min_count: int = 2) -> DataFrame:
    """How many sections hold two terms of the term table together, both directions. occurrences(node_id, term), terms(term).

    Terms are numbered once. A first pass over the sections adds all pairs up by hash in a fixed number of counters, which is at
    least the true count of every pair; a second pass makes only pairs whose counter reaches `min_count` (255 at most), sums
    them inside each task, and shuffles numbers. A section's pairs are made in runs, so a long one needs no more memory.
    """
    known = stored(terms.select("term").distinct().withColumn("code", F.monotonically_increasing_id()), "term-codes")
    held = occurrences.join(known, "term").groupBy("node_id").agg(F.array_sort(F.collect_set("code")).alias("codes")).filter(F.size("codes") > 1)
    lists = stored(held.select("codes"), "section-terms")
    counters, least = _counters(lists), min(min_count, 255)

    def make(batches):
        for a, b, slot in _pairs(batches):
            keep = counters[slot] >= least
            a, b = a[keep], b[keep]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
            n = np.diff(np.r_[first, len(a)])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a[first], b[first], n)], ["a", "b", "n"])

    counted = lists.mapInArrow(make, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    name = lambda code, term: known.select(F.col("code").alias(code), F.col("term").alias(term))
    named = counted.join(name("a", "t1"), "a").join(name("b", "t2"), "b").select("t1", "t2", "n")
    both = F.array(F.struct("t1", "t2"), F.struct(F.col("t2").alias("t1"), F.col("t1").alias("t2")))
    return named.select(F.explode(both).alias("p"), "n").select("p.t1", "p.t2", "n")


def synonym_edges(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Dictionary pairs with both ends in the term table."""
    left = terms.select("term").distinct()
    return (
        synonyms.select("term", "synonym").distinct().join(left, "term", "left_semi")
        .join(left.withColumnRenamed("term", "synonym"), "synonym", "left_semi").select("term", "synonym")
    )


def detect_abbreviations(
    sections: DataFrame, long_first: str = rf"([{tx.CJK}]{{2,}})\s*[（(]([A-Z]{{2,6}})[)）]",
    short_first: str = r"(?<![\p{L}\p{N}_])([A-Z]{2,6})\s*[（(]([^()（）]{3,60})[)）]", text: str = "text",
    known: DataFrame | None = None,
) -> DataFrame:
    """(abbreviation, full form, count) from `long (ABC)` and `ABC (long)` forms; both patterns are parameters.

    known(abbreviation, full_form): a dictionary; all its entries are in the result, with the count of the texts' own forms, else 0.
    """
    def pairs(pattern: str, short: int, long: int) -> DataFrame:
        z = F.arrays_zip(tx.matches(F.col(text), pattern, short).alias("a"), tx.matches(F.col(text), pattern, long).alias("f"))
        return sections.select(F.explode(z).alias("z")).select(F.col("z.a").alias("abbreviation"), F.trim("z.f").alias("full_form"))

    both = pairs(long_first, 2, 1).unionByName(pairs(short_first, 1, 2)).withColumn("one", F.lit(1))
    if known is not None:
        both = both.unionByName(known.select("abbreviation", "full_form", F.lit(0).alias("one")))
    return both.groupBy("abbreviation", "full_form").agg(F.sum("one").alias("n"))


def ontology_by_category(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Terms, types and synonym relations per category."""
    rel = synonym_edges(terms, synonyms).groupBy("term").agg(F.count("*").alias("relations"))
    return terms.join(rel, "term", "left").groupBy("category", "type").agg(
        F.count("*").alias("terms"), F.sum("frequency").alias("frequency"),
        F.sum(F.coalesce("relations", F.lit(0))).alias("relations"),
    )


def find_synonyms(terms: DataFrame, synonyms: DataFrame, network: DataFrame) -> DataFrame:
    """Containment neighbours plus dictionary edges of the network, either direction."""
    contain = related_terms(terms, synonyms)
    net = network.select("term", F.col("synonym").alias("name"))
    back = net.select(F.col("name").alias("term"), F.col("term").alias("name"))
    edges = net.union(back).join(terms.select("term").distinct(), "term", "left_semi").select("term", "name")
    return contain.union(edges).distinct()


def discover_new_terms(log: DataFrame, known: DataFrame, pattern: str, text: str, k: int = 20) -> DataFrame:
    """Frequent query terms that are neither known terms nor parts of one; the top k is the report."""
    found = log.select(F.explode(tx.matches(F.lower(F.col(text)), pattern)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    word = F.lower("term")
    parts = containment_join(known.select(word.alias("w")).distinct(), "w", found.select("term"), "term").select("term").distinct()
    return found.join(parts, "term", "left_anti").orderBy(F.desc("n"), "term").limit(k)


def validate_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """True for CJK 2-6 characters or Latin/digit/blank/hyphen 2-15."""
    return terms.withColumn("valid", F.col(column).rlike(rf"^([{tx.CJK}]{{2,6}}|[A-Za-z0-9\-\s]{{2,15}})$"))


def merge_duplicate_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """Spellings that agree after trimming and lower-casing, two or more rows."""
    return (
        terms.groupBy(F.lower(F.trim(column)).alias("term_key"), column).agg(F.count("*").alias("n"))
        .groupBy("term_key").agg(F.sum("n").alias("rows"), F.count("*").alias("spellings"), F.min(column).alias("kept"))
        .filter(F.col("rows") > 1)
    )


def query_signature(text: Column) -> Column:
    """Lower case without punctuation and blanks."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_]", "")


