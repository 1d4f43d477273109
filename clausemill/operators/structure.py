"""Document structuring: headings to chunks, sections, trees, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions.scale import checked_join, containment_join, cut_lineage, salted_join, stored

# Defaults of the chunk context and the authority rules.
DEFAULT_H1, DEFAULT_H2, DEFAULT_H3, AFTER_H2 = "Unknown Document", "General Chapter", "General Clause", "General Section"
AUTHORITY_RULES = [("CCAR|CAAC", "CAAC"), ("FAR|FAA", "FAA"), ("CS-|EASA", "EASA")]
HEADING = r"(?<![^\n])(?=[ \t]*#{1,3}[ \t]+\S)"
STOP_TITLES = ["CS-E", "BOOK", "AMC", "Annex"]


def heading_blocks(text: Column) -> Column:
    """array<struct<level, title, body>>: the text cut before every heading line of level 1-3."""

    def block(b: Column) -> Column:
        head = F.regexp_extract(b, r"^[ \t]*(#{1,3})[ \t]+\S", 1)
        is_head = F.length(head) > 0
        rest = F.when(is_head, F.regexp_replace(b, r"^[^\n]*\n?", "")).otherwise(b)
        lines = F.filter(F.transform(F.split(rest, "\n"), tx.strip), lambda s: F.length(s) > 0)
        return F.struct(
            F.length(head).alias("level"),
            F.when(is_head, tx.strip(F.regexp_extract(b, r"^[ \t]*#{1,3}[ \t]+([^\n]*)", 1))).otherwise("").alias("title"),
            F.array_join(lines, "\n").alias("body"),
        )

    return F.transform(F.split(F.coalesce(text, F.lit("")), HEADING), block)


def chunk_by_headings(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One chunk per heading with a non-blank body, its heading context in front.

    The running headings are carried by `aggregate` inside the row, so the corpus is chunked without a shuffle.
    """
    start = F.struct(
        F.lit(DEFAULT_H1).alias("h1"), F.lit(DEFAULT_H2).alias("h2"), F.lit(DEFAULT_H3).alias("h3"),
        F.array().cast("array<struct<h1:string,h2:string,h3:string,body:string>>").alias("out"),
    )

    def step(s: Column, b: Column) -> Column:
        level = b["level"]
        h1 = F.when(level == 1, b["title"]).otherwise(s["h1"])
        h2 = F.when(level == 1, DEFAULT_H2).when(level == 2, b["title"]).otherwise(s["h2"])
        h3 = F.when(level == 1, DEFAULT_H3).when(level == 2, AFTER_H2).when(level == 3, b["title"]).otherwise(s["h3"])
        chunk = F.struct(h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), b["body"].alias("body"))
        out = F.when(F.length(b["body"]) > 0, F.array_append(s["out"], chunk)).otherwise(s["out"])
        return F.struct(h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), out.alias("out"))

    chunks = F.aggregate(heading_blocks(F.col(text)), start, step, lambda s: s["out"])
    out = docs.select(id, F.posexplode(chunks).alias("seq", "c")).select(id, "seq", "c.*")
    context = F.concat(F.lit("["), F.concat_ws(" > ", "h1", "h2", "h3"), F.lit("]\n"), F.col("body"))
    return out.select(id, "seq", "h1", "h2", "h3", F.col("body").alias("original_text"), context.alias("text"))


def authority_of(name: Column, rules: list[tuple[str, str]] = AUTHORITY_RULES, other: str = "OTHER") -> Column:
    """First rule whose pattern occurs in the upper-cased name."""
    out = F
    for pattern, agency in rules:
        out = out.when(F.upper(name).rlike(pattern), agency)
    return out.otherwise(other)


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Stem and 16 hex digits of sha1(source|chapter|section|first 256 characters|index).

    chunks(source, chapter, section, text, original_text, seq); the 256 characters are part of the id format.
    """
    body = F.when(F.length("original_text") > 0, F.col("original_text")).otherwise(F.coalesce("text", F.lit("")))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    seed = F.concat_ws("|", F.coalesce("source", F.lit("unknown")), blank("chapter"), blank("section"), F.substring(body, 1, 256), "seq")
    digest = F.substring(F.sha1(seed), 1, 16)
    return chunks.withColumn("chunk_id", F.concat_ws(":", stem(F.coalesce("source", F.lit("unknown"))), digest))


def dedupe_chunks(chunks: DataFrame, id: str = "chunk_id", order: str = "seq") -> DataFrame:
    """C4: first row per chunk id. `min_by` combines on the map side, so many copies of one chunk stay cheap."""
    rest = [c for c in chunks.columns if c != id]
    return chunks.groupBy(id).agg(F.min_by(F.struct(*rest), order).alias("r")).select(id, "r.*")


def split_sections_at_h2(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Text pieces that each begin at a level-two heading line."""
    parts = F.split(F.col(text), r"(?<![^\n])(?=## )")
    return docs.select(id, F.posexplode(parts).alias("seq", "section")).filter(F.length(tx.strip(F.col("section"))) > 0)


def article_map(docs: DataFrame, number: str = r"第\s*(33\.[0-9]+)\s*条", id: str = "doc_id", text: str = "text") -> DataFrame:
    """Longest text per article number over all documents; ties go to the lowest document id."""
    blocks = docs.select(id, F.explode(heading_blocks(F.col(text))).alias("b")).filter("b.level in (2, 3)")
    found = blocks.select(id, tx.first_match(F.col("b.title"), number, 1).alias("number"), F.col("b.body").alias("text"))
    best = F.struct(F.length("text"), -F.col(id))
    return found.filter("number is not null and length(text) > 0").groupBy("number").agg(F.max_by("text", best).alias("text"))


def fill_section_text(sections: DataFrame, articles: DataFrame) -> DataFrame:
    """Own text, else joined parts, else the article text, else the body embedded in the title."""
    present = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    in_title = tx.first_match(F.col("title"), r"^\S+\s+([\s\S]{11,})$", 1)
    side = articles.select("number", F.col("text").alias("article_text"))
    joined = sections.join(side, "number", "left")
    filled = F.coalesce(
        present(F.col("text")), present(F.array_join("content_parts", "\n\n")), F.col("article_text"), in_title
    )
    return joined.withColumn("text", filled).drop("article_text")


def clean_title(title: Column) -> Column:
    """Page-header title without trailing dashes and dot leaders; blank for (a), plain digits and stop titles."""
    t = F.regexp_replace(F.regexp_replace(title, r"\s*-\s*$", ""), r"\.{3,}$", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(t.rlike(r"^\([a-z]\)") | t.rlike(r"^[0-9]+$") | t.isin(STOP_TITLES), "").otherwise(t)


# Fixed value: lines between a number and its title that are dates in the page's margin.
MARGIN_DATE = r"^[0-9]+–[0-9]+–[0-9]+"


def sections_from_pages(
    pages: DataFrame, header: str = r"^CS-E\s+([0-9]+[a-z]*)\s+(.+)$", alone: str = r"^CS-E\s+([0-9]+[a-z]*)\s*$", ahead: int = 1
) -> DataFrame:
    """Sections named on page lines, number with title or number alone and the title below it.

    With ahead = 1 the title is the next line. With more, it is the first of the next `ahead` lines that is not empty, a page
    number, another section marker, a list item, a date or a running head. pages(doc, page, text). Lines are looked up inside
    the row; the first place per number wins.
    """
    lines = F.transform(F.split("text", "\n"), tx.strip)
    rows = pages.withColumn("l", lines).select("doc", "page", F.posexplode("l").alias("pos", "line"), F.col("l"))
    if ahead == 1:
        below = F.coalesce(F.get("l", F.col("pos") + 1), F.lit(""))
    else:
        skipped = lambda x: (x == "") | x.rlike(r"^[0-9]+$") | x.rlike(header) | x.rlike(alone) | x.rlike(r"^\([a-z]\)") | x.rlike(MARGIN_DATE) | x.isin(STOP_TITLES)
        below = F.coalesce(F.get(F.filter(F.slice("l", F.col("pos") + 2, F.lit(ahead)), lambda x: ~skipped(x)), F.lit(0)), F.lit(""))
    title = F.when(F.col("line").rlike(header), clean_title(F.regexp_extract("line", header, 2))).when(
        F.col("line").rlike(alone) & ~below.rlike(r"^\([a-z]\)"), clean_title(below)
    )
    number = F.when(F.col("line").rlike(header), F.regexp_extract("line", header, 1)).otherwise(F.regexp_extract("line", alone, 1))
    found = rows.select("doc", "page", "pos", number.alias("number"), title.alias("title")).filter(F.length("title") > 2)
    first = F.struct("page", "pos")
    return found.groupBy("doc", "number").agg(F.min_by(F.struct("title", "page"), first).alias("s")).select("doc", "number", "s.*")


def locate_ranges(subparts: DataFrame, pages: DataFrame, before: int = 5, after: int = 50) -> DataFrame:
    """First page near the hint that holds the marker, and the page before the next subpart as its end.

    subparts(doc, name, hint, marker), pages(doc, page, text). Which pages of a document hold a marker is looked up once for
    every distinct marker (`marked_pages`); the range condition is then an equi-join on the marker and page buckets of the window's width.
    """
    width = before + after + 1
    low, high = F.col("hint") - before, F.col("hint") + after
    asked = subparts.select("doc", "hint", "marker").distinct()
    wanted = asked.withColumn("b", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    near = marked_pages(subparts.select("doc", "marker"), pages).withColumn("b", F.floor(F.col("page") / width))
    hits = salted_join(near, wanted, ["doc", "marker", "b"], spread="page").filter(F.col("page").between(low, high))
    first = hits.groupBy("doc", "hint", "marker").agg(F.min("page").alias("start"))
    starts = subparts.join(first, ["doc", "hint", "marker"]).groupBy("doc", "name").agg(F.min("start").alias("start"))
    w = Window.partitionBy("doc").orderBy("start", "name")
    return starts.withColumn("end", F.lead("start").over(w) - 1)


def marked_pages(markers: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, marker), once each: pages with a text that holds a marker of their document. markers(doc, marker), pages(doc, page, text).

    A marker without blanks is inside one blank-separated word of the text, so words meet markers and no text is searched for every
    marker; which markers a word holds is looked up once for every distinct word (`containment_join`). Of a marker with blanks the
    longest word is looked up, and the texts of these pages are then searched.
    """
    longest = F.reduce(F.split("marker", " "), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    marks = stored(markers.filter("marker IS NOT NULL").select("doc", "marker", longest.alias("key")).distinct(), "markers")
    texts = pages.filter("text IS NOT NULL")
    words = texts.select("doc", "page", F.explode(F.array_distinct(F.split("text", " "))).alias("_w"))
    held = stored(containment_join(words.select("_w").distinct(), "_w", marks.select("key").distinct(), "key"), "word-markers")
    inside = checked_join(words, held, ["_w"], spread="page").select("doc", "page", "key").distinct()
    found = checked_join(inside, marks, ["doc", "key"], spread="page").select("doc", "page", "marker", "key")
    blank = marks.filter("key = ''")
    if not blank.isEmpty():
        found = found.unionByName(texts.select("doc", "page").distinct().join(blank, "doc").select("doc", "page", "marker", "key"))
    found = found.distinct()
    if marks.filter("marker <> key").isEmpty():
        return found.select("doc", "page", "marker")
    found = stored(found, "marked-pages")
    parted = salted_join(texts, found.filter("marker <> key"), ["doc", "page"], spread="page").filter(F.col("text").contains(F.col("marker")))
    return found.filter("marker = key").select("doc", "page", "marker").union(parted.select("doc", "page", "marker").distinct())


def section_fulltext(sections: DataFrame) -> DataFrame:
    """C11: document:number -> summary and parts joined by blanks; the later section overwrites."""
    body = F.trim(F.concat_ws(" ", F.when(F.length("summary") > 0, F.col("summary")), F.array_join("content_parts", " ")))
    rows = sections.select(F.concat_ws(":", "doc", "number").alias("key"), body.alias("fulltext"), "ordinal").filter("length(fulltext) > 0")
    return rows.groupBy("key").agg(F.max_by("fulltext", "ordinal").alias("fulltext"))


def lookup_section(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """First section of a document whose title contains the wanted number, in document order.

    A contained number lies inside a run of digits and dots, so the substrings of those short runs are
    exploded and the containment test becomes an equi-join. wanted(doc, number).
    """
    runs = sections.select("doc", "node_id", "ordinal", "title", F.explode(tx.matches(F.col("title"), r"[0-9][0-9.]*")).alias("run"))
    subs = runs.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("run")))).withColumn(
        "number", F.explode(F.transform(F.sequence(F.lit(1), F.length("run") - F.col("i") + 1), lambda n: F.col("run").substr(F.col("i"), n)))
    )
    hits = subs.join(wanted.select("doc", "number").distinct(), ["doc", "number"])
    return hits.groupBy("doc", "number").agg(F.min_by(F.struct("node_id", "title"), "ordinal").alias("s")).select("doc", "number", "s.*")


def document_stats(sections: DataFrame) -> DataFrame:
    """Pages, sections and sections with content per document."""
    return sections.groupBy("doc").agg(
        F.count("*").alias("sections"), F.max("page").alias("pages"),
        F.count_if(F.size("content_parts") > 0).alias("with_content"), F.sum(F.length("text")).alias("characters"),
    )


def list_sections(sections: DataFrame, markers: list[str], doc: str | None = None) -> DataFrame:
    """C14: sections whose title holds all markers, by page."""
    out = sections if doc is None else sections.filter(F.col("doc") == doc)
    for m in markers:
        out = out.filter(F.col("title").contains(m))
    return out.select("doc", "number", "title", "page").orderBy("page", "doc", "number")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """Root-to-node path of every node. nodes(id, parent); roots have a null parent.

    One join per level until a level is empty; a node that comes up again on its own path is an error.
    """
    frontier = cut_lineage(nodes.filter("parent is null").select("id", F.array("id").alias("path")))
    children = nodes.filter("parent is not null")
    levels = frontier
    while True:
        known = frontier.select(F.col("id").alias("parent"), "path")
        step = salted_join(children, known, ["parent"], spread="id")
        cycle = F.raise_error(F.concat(F.lit("cycle at node "), F.col("id").cast("string")))
        grown = F.when(F.array_contains("path", F.col("id")), cycle.cast("array<string>")).otherwise(F.array_append("path", F.col("id")))
        frontier = cut_lineage(step.select("id", grown.alias("path")))
        if frontier.isEmpty():
            return levels.withColumn("depth", F.size("path"))
        levels = levels.unionByName(frontier)


def parse_issues(headers: DataFrame) -> DataFrame:
    """Problems of a parsed document. headers(doc, total_sections, layout, found)."""
    flags = F.array_compact(
        F.array(
            F.when(F.coalesce("total_sections", F.lit(0)) == 0, "missing_total"),
            F.when(F.col("layout").isNull(), "missing_structure"),
            F.when(F.col("layout").isNotNull() & ~F.col("layout").isin("A", "B"), "bad_layout"),
            F.when(F.coalesce("found", F.lit(0)) == 0, "no_sections"),
        )
    )
    return headers.withColumn("issues", flags)


def repair_headers(headers: DataFrame, sections: DataFrame, marker: str = "条|§") -> DataFrame:
    """C17: fills total, agency, type, pages and quality from the sections. headers(doc, total_sections, agency, pages)."""
    counted = sections.groupBy("doc").agg(F.count_if(F.col("title").rlike(marker)).alias("counted"))
    total = F.coalesce(F.nullif(F.col("total_sections"), F.lit(0)), F.col("counted"), F.lit(0))
    out = headers.join(counted, "doc", "left").withColumn("total_sections", total)
    quality = tx.ladder(F.col("total_sections"), [(301, "excellent"), (101, "good")], "partial")
    return out.withColumns(
        {
            "agency": F.coalesce("agency", authority_of(F.col("doc"))),
            "pages": F.coalesce("pages", F.lit(0).cast("long")),
            "document_type": F.lit("regulation"),
            "parse_quality": quality,
        }
    ).drop("counted")


def fill_summaries(sections: DataFrame) -> DataFrame:
    """A summary that is missing or shorter than 5 becomes the first 100 characters of the title."""
    short = F.length(F.coalesce("summary", F.lit(""))) < 5
    return sections.withColumn("summary", F.when(short, F.substring("title", 1, 100)).otherwise(F.col("summary")))


def expanded_content(sections: DataFrame, minimum: int = 500) -> DataFrame:
    """Summary with all parts where the two together are shorter than the minimum and parts exist."""
    joined = F.concat_ws("\n", F.when(F.length("summary") > 0, F.col("summary")), F.array_join("content_parts", "\n"))
    short = (F.length("summary") + F.length(F.array_join("content_parts", ""))) < minimum
    return sections.withColumn(
        "content", F.when(short & (F.size("content_parts") > 0), joined).otherwise(F.col("summary"))
    ).withColumn("expanded", short & (F.size("content_parts") > 0))
