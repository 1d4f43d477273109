"""Graph queries for many seeds at once (Q1-Q17). nodes(id, type, label), edges(src, dst, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.functions import text as tx
from clausemill.functions.scale import checked_join, containment_join, cut_lineage, salted_join, stored, top_per
from clausemill.operators.rules import node_family

# Order of the node families.
FAMILY_ORDER = {"regulation": 0, "component": 1, "support": 2}
QUERY_TOKEN = rf"[0-9a-z{tx.CJK}]+"


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def family_rank(type_: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FAMILY_ORDER.items() for x in kv])
    return F.element_at(table, node_family(type_))


def keyword_edges(keywords: list[str], nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Q1: edges whose ends or description hold a keyword; only the first `limit` per keyword on request.

    Keywords are matched where the labels are, before the join: an edge qualifies by either end.
    """
    label = nodes.select("id", F.lower("label").alias("l"))
    hit = label.select("id", F.explode(tx.contained(F.col("l"), [k.lower() for k in keywords])).alias("keyword"))
    by_src = salted_join(edges, hit.withColumnRenamed("id", "src"), ["src"], spread="dst")
    by_dst = salted_join(edges, hit.withColumnRenamed("id", "dst"), ["dst"], spread="src")
    cols = ["keyword", "src", "dst", "type"]
    out = by_src.select(*cols).union(by_dst.select(*cols))
    if "description" in edges.columns:
        own = edges.withColumn("keyword", F.explode(tx.contained(F.lower("description"), [k.lower() for k in keywords])))
        out = out.union(own.select(*cols))
    out = out.distinct()
    return out if limit is None else top_per(out, ["keyword"], [F.col("src"), F.col("dst"), F.col("type")], limit)


def _with_default_nodes(scored: DataFrame, queries: DataFrame, ids: DataFrame, points: float, k: int) -> DataFrame:
    """Adds the first k nodes that score by type alone to every query; a query never needs more of them."""
    first = ids.select("id").orderBy("id").limit(k).agg(F.array_sort(F.collect_list("id")).alias("a")).scalar()
    plain = queries.select("query_id", F.explode(first).alias("id"), F.lit(points).alias("score"))
    return scored.unionByName(plain).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def seed_nodes(queries: DataFrame, nodes: DataFrame, k: int = 4) -> DataFrame:
    """Q2: token in the text +4 (one character: +2), whole query +6, regulation node +2; best k per query."""
    texts = nodes.select("id", "type", F.lower(F.concat_ws(" ", "label", "type")).alias("_t"))
    toks = queries.select("query_id", F.explode(tx.matches(F.lower("query"), QUERY_TOKEN)).alias("w"))
    per = toks.groupBy("query_id", "w").agg(F.count("*").alias("n"))
    hits = containment_join(texts, "_t", per, "w").withColumn(
        "p", F.when(F.length("w") == 1, 2).otherwise(4) * F.col("n"))
    sums = hits.groupBy("query_id", "id").agg(F.sum("p").cast("double").alias("score"), F.count("*").alias("found"))
    size = per.groupBy("query_id").agg(F.count("*").alias("words"))
    full = sums.join(size, "query_id").filter("found = words").select("query_id", "id").join(queries, "query_id").join(texts, "id")
    whole = full.filter(F.col("_t").contains(F.lower("query"))).select("query_id", "id", F.lit(6.0).alias("score"))
    matched = sums.select("query_id", "id", "score").unionByName(whole).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    regulation = node_family(F.col("type")) == "regulation"
    bonus = matched.join(nodes.select("id", F.when(regulation, 2.0).otherwise(0.0).alias("b")), "id").select("query_id", "id", (F.col("score") + F.col("b")).alias("score"))
    every = _with_default_nodes(bonus, queries, nodes.filter(regulation), 2.0, k)
    return top_per(every, ["query_id"], [F.desc("score"), F.col("id")], k)


def score_nodes(queries: DataFrame, nodes: DataFrame, k: int = 10, bonus_types: list[str] = ("section", "requirement", "component")) -> DataFrame:
    """Q3: label holds the query +10, each distinct word of two or more characters +3, bonus type +1; best k per query."""
    texts = nodes.select("id", F.lower("label").alias("_t"))
    words = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("query"), r"\s+"))).alias("w")).filter("length(w) >= 2")
    hits = containment_join(texts, "_t", words, "w")
    sums = hits.groupBy("query_id", "id").agg((F.count("*") * 3.0).alias("score"), F.count("*").alias("found"))
    size = words.groupBy("query_id").agg(F.count("*").alias("words"))
    full = sums.join(size, "query_id").filter("found = words").select("query_id", "id").join(queries, "query_id").join(texts, "id")
    whole = full.filter(F.col("_t").contains(F.lower("query"))).select("query_id", "id", F.lit(10.0).alias("score"))
    matched = sums.select("query_id", "id", "score").unionByName(whole).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    extra = F.lower("type").isin(list(bonus_types))
    bonus = matched.join(nodes.select("id", F.when(extra, 1.0).otherwise(0.0).alias("b")), "id").select("query_id", "id", (F.col("score") + F.col("b")).alias("score"))
    every = _with_default_nodes(bonus, queries, nodes.filter(extra), 1.0, k)
    return top_per(every, ["query_id"], [F.desc("score"), F.col("id")], k)


SEEDS_PER_ROW = 63  # seeds whose marks share one number


def khop(seeds: DataFrame, edges: DataFrame, depth: int, with_seed: bool = False) -> DataFrame:
    """Q4: nodes within `depth` undirected steps of every seed, with their distance; without the seed itself by default.

    Seeds are bits: a node holds one number for SEEDS_PER_ROW seeds, and a level sends it along every edge once for all of them.
    Arriving numbers are merged by a bitwise or, before the shuffle already, and what a node had seen is taken out.
    seeds(seed).
    """
    around = stored(both_ways(edges), "around")  # once, not once per level
    numbered = stored(seeds.select("seed").dropna().distinct().withColumn("n", F.monotonically_increasing_id()), "seeds")
    bit = lambda n: F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST({n} AS INT))")
    start = numbered.select(F.col("seed").alias("id"), F.floor(F.col("n") / SEEDS_PER_ROW).alias("row"), bit(f"n % {SEEDS_PER_ROW}").alias("mask"))
    frontier = seen = stored(start, "frontier")
    levels = [frontier.withColumn("distance", F.lit(0))]
    for level in range(1, depth + 1):
        sent = salted_join(around, frontier.withColumnRenamed("id", "src"), ["src"], spread="dst")
        come = sent.groupBy(F.col("dst").alias("id"), "row").agg(F.bit_or("mask").alias("mask"))
        known = seen.select("id", "row", F.col("mask").alias("had"))
        fresh = come.join(known, ["id", "row"], "left").select("id", "row", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("mask"))
        frontier = stored(fresh.filter("mask <> 0"), "frontier")
        levels.append(frontier.withColumn("distance", F.lit(level)))
        if level < depth:
            seen = stored(seen.unionByName(frontier).groupBy("id", "row").agg(F.bit_or("mask").alias("mask")), "seen")
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    out = marks(every, "id", "distance").join(numbered, "n").select("seed", "id", "distance")
    return out if with_seed else out.filter("distance > 0")


def marks(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, n): one row for every bit of `mask`; n is its number over all rows. rows(row, mask, columns)."""
    places = F.filter(F.sequence(F.lit(0), F.lit(SEEDS_PER_ROW - 1)), lambda i: F.getbit("mask", i) == 1)
    return rows.select(*columns, "row", F.explode(places).alias("i")).select(*columns, (F.col("row") * SEEDS_PER_ROW + F.col("i")).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """Undirected degree per node, counted once per edge end."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def expand_subgraph(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 18, skip_type: str = "parameter") -> DataFrame:
    """Q5: breadth-first expansion per query, neighbours by family, falling degree, label; first `limit` nodes.

    seeds(query_id, id, position). Only the first `limit` nodes of a level can be chosen or lead to a chosen one,
    so every level holds a bounded number of rows per query.
    """
    info = nodes.join(degrees(edges), "id", "left").filter(F.lower("type") != skip_type).select(
        "id", F.struct(family_rank(F.col("type")).alias("f"), (-F.coalesce("degree", F.lit(0))).alias("d"), F.col("label").alias("l"), F.col("id").alias("i")).alias("prio"))
    around = stored(both_ways(edges), "around")  # once, not once per level
    start = seeds.join(info.select("id"), "id", "left_semi")
    level = top_per(start, ["query_id"], [F.col("position")], limit, "pos").select("query_id", "id", F.col("pos").cast("long"))
    seen = level.withColumn("level", F.lit(0))
    for depth in range(1, limit):
        near = salted_join(around, level.withColumnRenamed("id", "src"), ["src"], spread="dst").select("query_id", "pos", F.col("dst").alias("id"))
        fresh = near.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti").join(info, "id")
        first = fresh.groupBy("query_id", "id").agg(F.min(F.struct("pos", "prio")).alias("o"))
        level = top_per(first, ["query_id"], [F.col("o")], limit, "pos").select("query_id", "id", F.col("pos").cast("long"))
        level = cut_lineage(level)
        if level.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(level.withColumn("level", F.lit(depth))))
        full = seen.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= limit)
        level = level.join(full, "query_id", "left_anti")
    return top_per(seen, ["query_id"], [F.col("level"), F.col("pos")], limit)


def induced_edges(node_sets: DataFrame, edges: DataFrame, limited: bool = False) -> DataFrame:
    """Q6: distinct edges with both ends in the set; limited: the first max(2n, 12) per set. node_sets(set_id, id)."""
    inside = node_sets.select("set_id", "id").distinct()
    a = salted_join(edges, inside.withColumnRenamed("id", "src"), ["src"], spread="dst")
    both = a.join(inside.withColumnRenamed("id", "dst"), ["set_id", "dst"], "left_semi").select("set_id", "src", "dst", "type").distinct()
    if not limited:
        return both
    size = inside.groupBy("set_id").agg(F.greatest(F.count("*") * 2, F.lit(12)).alias("_cap"))
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("set_id").orderBy("src", "dst", "type"))
    return both.withColumn("_rn", rn).join(size, "set_id").filter("_rn <= _cap").drop("_rn", "_cap")


def overview_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """Q7: first nodes by family, falling degree, label."""
    rows = nodes.join(degrees(edges), "id", "left").withColumns({"family": family_rank(F.col("type")), "degree": F.coalesce("degree", F.lit(0))})
    return rows.orderBy("family", F.desc("degree"), "label", "id").limit(limit)


def subgraph_summary(node_sets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q8: node counts by family and edge count of every set."""
    fam = node_sets.join(nodes, "id").withColumn("family", node_family(F.col("type"))).groupBy("set_id").pivot(
        "family", ["regulation", "component", "support"]).count().fillna(0)
    counts = induced_edges(node_sets, edges).groupBy("set_id").agg(F.count("*").alias("edges"))
    return fam.join(counts, "set_id", "left").fillna(0, ["edges"])


def filter_network(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q9: per query the nodes whose label holds one of its tokens, their one-hop neighbours, and the induced edges.

    Queries are bits, as in `khop`: a token, and then a node, holds one number for SEEDS_PER_ROW queries, so what a hub passes on to all
    its neighbours are a few numbers. Rows per query are made at the end.
    """
    numbered = stored(queries.select("query_id").distinct().withColumn("n", F.monotonically_increasing_id()), "queries")
    words = queries.select("query_id", F.explode(F.array_distinct(tx.matches(F.lower("query"), QUERY_TOKEN))).alias("w"))
    known = words.join(numbered.select(F.col("query_id").alias("_q"), "n"), F.col("query_id").eqNullSafe(F.col("_q")))
    bit = F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST(n % {SEEDS_PER_ROW} AS INT))")
    marked = stored(known.groupBy("w", F.floor(F.col("n") / SEEDS_PER_ROW).alias("row")).agg(F.bit_or(bit).alias("mask")), "query-words")
    held = containment_join(nodes.select("id", F.lower("label").alias("_t")), "_t", marked.select("w").distinct(), "w").select("id", "w")
    hit = stored(checked_join(held, marked, ["w"], spread="id").groupBy("id", "row").agg(F.bit_or("mask").alias("mask")), "hit-nodes")
    near = salted_join(both_ways(edges), hit.withColumnRenamed("id", "src"), ["src"], spread="dst").select(F.col("dst").alias("id"), "row", "mask")
    every = hit.unionByName(near).groupBy("id", "row").agg(F.bit_or("mask").alias("mask"))
    found = marks(every, "id").join(numbered, "n").select("query_id", "id")
    return found, induced_edges(found.withColumnRenamed("query_id", "set_id"), edges).withColumnRenamed("set_id", "query_id")


def resolve_node(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Q10: exact id, then separators as underscores, then without the doc: prefix, then containment either way.

    wanted(name). Containment runs only for names that the exact stages leave open.
    """
    ids = nodes.select("id")
    name = F.col("name")
    keys = F.array(
        F.struct(F.lit(1).alias("stage"), name.alias("id")), F.struct(F.lit(2).alias("stage"), F.translate(name, ":-", "__").alias("id")),
        F.struct(F.lit(3).alias("stage"), F.when(name.startswith("doc:"), F.substring(name, 5, 100000)).alias("id")))
    exact = wanted.select("name", F.inline(keys)).filter("id is not null").join(ids, "id", "left_semi")
    open_ = wanted.join(exact.select("name").distinct(), "name", "left_anti").withColumn("_n", F.lower("name"))
    low = ids.withColumn("_i", F.lower("id"))
    inside = containment_join(low, "_i", open_, "_n").select("name", "id")
    around = containment_join(open_, "_n", low, "_i").select("name", "id")
    rest = inside.union(around).select("name", F.lit(4).alias("stage"), "id")
    return exact.select("name", "stage", "id").union(rest).groupBy("name").agg(F.min(F.struct("stage", "id")).alias("m")).select("name", "m.*")


def paths(pairs: DataFrame, edges: DataFrame, max_len: int = 4, limit: int | None = None) -> DataFrame:
    """Q11: simple undirected paths of at most `max_len` nodes per (source, target) pair; the shortest first.

    Half paths grow from both ends, one step at a time and in turn, and meet over the edge in their middle: the paths of one
    length are all known before a longer half is made. A pair that has `limit` paths leaves before the next step, so hubs are only walked
    as far, and for as many pairs, as results are missing. pairs(source, target).
    """
    around = stored(both_ways(edges), "around")  # once, not once per level
    live = cut_lineage(pairs.filter("source <> target").select("source", "target").distinct())
    ends = {"fore": live.select("source", "target", F.array("source").alias("fore"), F.col("source").alias("src")),
            "back": live.select("source", "target", F.array("target").alias("back"), F.col("target").alias("src"))}

    def grown(side: str) -> DataFrame:
        rows = salted_join(around, ends[side].join(live, ["source", "target"], "left_semi"), ["src"], spread="dst")
        rows = rows.filter(~F.array_contains(side, F.col("dst")) & (F.col("dst") != F.col("target" if side == "fore" else "source")))
        longer = F.array_append(side, F.col("dst")) if side == "fore" else F.array_prepend(side, F.col("dst"))
        return stored(rows.select("source", "target", longer.alias(side), F.col("dst").alias("src")), "half-paths")

    done = None
    for steps in range(1, max_len):
        if steps > 1:
            side = "fore" if steps % 2 == 0 else "back"
            ends[side] = grown(side)
        # A path of so many steps is a half from each end and the edge between them, in one way only.
        step = salted_join(around, ends["fore"].join(live, ["source", "target"], "left_semi"), ["src"], spread="dst")
        meet = salted_join(step.select("source", "target", "fore", F.col("dst").alias("src")), ends["back"], ["source", "target", "src"], spread="fore")
        found = meet.filter(~F.arrays_overlap("fore", "back")).select("source", "target", F.concat("fore", "back").alias("path"))
        found = stored(found, "paths")
        done = found if done is None else done.unionByName(found)
        if limit is not None:
            enough = done.groupBy("source", "target").agg(F.count("*").alias("n")).filter(F.col("n") >= limit)
            live = cut_lineage(live.join(enough, ["source", "target"], "left_anti"))
            if live.isEmpty():
                break
    out = done.select("source", "target", F.size("path").alias("length"), F.array_join("path", ">").alias("path"))
    return out if limit is None else top_per(out, ["source", "target"], [F.col("length"), F.col("path")], limit)


def semantic_relations(queries: DataFrame, nodes: DataFrame, edges: DataFrame, best: int = 5, limit: int | None = None) -> DataFrame:
    """Q12: edges that touch the best nodes of a query by node rank; only the first `limit` on request."""
    top = score_nodes(queries, nodes, best).select("query_id", "id", "score", F.col("rank").alias("node_rank"))
    a = salted_join(edges, top.withColumnRenamed("id", "src"), ["src"], spread="dst")
    b = salted_join(edges, top.withColumnRenamed("id", "dst"), ["dst"], spread="src")
    cols = ["query_id", "src", "dst", "type", "node_rank"]
    every = a.select(*cols).union(b.select(*cols)).groupBy("query_id", "src", "dst", "type").agg(F.min("node_rank").alias("node_rank"))
    order = [F.col("node_rank"), F.col("src"), F.col("dst"), F.col("type")]
    return every if limit is None else top_per(every, ["query_id"], order, limit)


def degree_stats(edges: DataFrame) -> DataFrame:
    """Q13: in, out and total degree in one aggregation."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                                         F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def hubs(edges: DataFrame, k: int = 20) -> DataFrame:
    return degree_stats(edges).orderBy(F.desc("degree"), "id").limit(k)


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q14: node and edge histograms by type."""
    count = lambda df, kind: df.groupBy("type").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return count(nodes, "node").unionByName(count(edges, "edge"))


def clusters(nodes: DataFrame, by: str, at_least: int = 1) -> DataFrame:
    """Q15: cluster members with the cluster size, clusters below the size left out. Members stay rows."""
    sizes = nodes.groupBy(by).agg(F.count("*").alias("members")).filter(F.col("members") >= at_least)
    return salted_join(nodes.select(by, "id"), sizes, [by], spread="id")


def insights(nodes: DataFrame, edges: DataFrame, requirement: str, component_edge: str, reference_edge: str, k: int = 5) -> DataFrame:
    """Q16: (metric, key, value): requirement nodes, cross-document references, top components and top clauses."""
    doc = lambda c: F.split(c, ":")[0]
    need = nodes.agg(F.count_if(F.col("type") == requirement).alias("value")).select(F.lit("requirements").alias("metric"), F.lit("").alias("key"), "value")
    cross = edges.agg(F.count_if((F.col("type") == reference_edge) & (doc("src") != doc("dst"))).alias("value")).select(
        F.lit("cross_references").alias("metric"), F.lit("").alias("key"), "value")
    top = lambda df, c, name: df.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("value")).orderBy(F.desc("value"), "key").limit(k).select(
        F.lit(name).alias("metric"), "key", "value")
    comp = top(edges.filter(F.col("type") == component_edge), "dst", "component")
    clause = top(edges.filter(F.col("src").contains(":")), "src", "clause")
    return need.union(cross).union(comp).union(clause)


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    used = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(used, "id", "left_anti")


def isolated_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Q17."""
    return isolated(nodes, edges).agg(F.count("*").alias("isolated"))
