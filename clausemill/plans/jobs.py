"""The three end-to-end jobs, each a composition of operators over whole tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.functions.scale import stored
from clausemill.operators import answers as an
from clausemill.operators import graph_build as gb
from clausemill.operators import index as ix
from clausemill.operators import quality as ql
from clausemill.operators import rerank as rr
from clausemill.operators import rules as ru
from clausemill.operators import structure as st
from clausemill.operators import terms as tm
from clausemill.sources.index_store import write_index


def corpus_chunks(docs: DataFrame) -> DataFrame:
    """Documents -> chunks with stable ids, one row per id. docs(doc_id, source, text)."""
    cut = st.chunk_by_headings(docs.select("doc_id", "source", "text").withColumn("_id", F.struct("doc_id", "source")), id="_id")
    flat = cut.select("_id.doc_id", "_id.source", F.col("h2").alias("chapter"), F.col("h3").alias("section"), F.col("h1").alias("document"), "text", "original_text", "seq")
    return st.dedupe_chunks(st.chunk_ids(flat), order="doc_id")


def build_corpus(docs: DataFrame, path: str) -> None:
    """Full rebuild: chunks, postings, term counts and corpus figures written under one path."""
    chunks = stored(corpus_chunks(docs), "chunks")
    write_index(ix.build_index(chunks, id="chunk_id"), chunks, path)


@dataclass(frozen=True)
class Answers:
    """Results of one query batch."""

    plan: DataFrame
    ranking: DataFrame
    citations: DataFrame
    direct: DataFrame
    confidence: DataFrame


def answer_queries(queries: DataFrame, docs: DataFrame, index: ix.TextIndex, synonyms: DataFrame, vectors: DataFrame | None = None,
                   k: int = 3, patterns=ru.INTENT_PATTERNS, weights=ru.AUTHORITY_WEIGHTS, bonus=rr.INTENT_BONUS, end: str = "。", authority=None) -> Answers:
    """Many questions at once: intent and plan, keyword and vector search, fusion, rerank, citations, extractive answer,
    confidence. docs(doc_id, title, chapter, section, document, document_type, text), vectors(doc_id, embedding)."""
    typed = ru.primary_intent(queries, patterns)
    plan = ru.retrieval_plan(typed)
    expansions = stored(tm.expand_mixed(queries, synonyms), "expansions")
    keyword = ix.bm25_expanded(queries, expansions, index, k)
    if vectors is None:
        vectors = ix.hash_embed(docs.select("doc_id", "text"))
    asked = ix.hash_embed(queries.withColumnRenamed("query", "text"), id="query_id")
    near = ix.vector_topk(asked, vectors, ix.candidates_for(k), id="doc_id")
    fused = stored(ix.hybrid(near, keyword, k), "fused")
    candidates = fused.select("query_id", "doc_id", "rank").join(docs, "doc_id")
    ranking = stored(rr.rerank(rr.query_features(queries, expansions, patterns), candidates, k, weights, bonus), "ranking")
    agency = F.lit("OTHER") if authority is None else authority
    evidence = ranking.join(docs, "doc_id").select(
        F.col("query_id").alias("answer_id"), "rank", "text", F.col("document").alias("source"), agency.alias("authority"), "title", "section")
    cited = rr.citations(evidence.withColumnRenamed("answer_id", "query_id"), breaks=end)
    direct = an.direct_answer(evidence, typed.select(F.col("query_id").alias("answer_id"), "intent"), end.replace(".", "\\."))
    said = direct.join(queries.withColumnRenamed("query_id", "answer_id"), "answer_id").select("answer_id", "query", F.col("direct").alias("answer"))
    return Answers(plan, ranking, cited, direct, ql.confidence(said, evidence))


def build_graph(sections: DataFrame, patterns: list[tuple[str, str]], edge_types: dict[str, str], header: str, topics: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """Sections -> one node table and one deduplicated edge table: entities, relations, equal numbers, topics."""
    entities = stored(gb.extract_entities(sections, patterns), "entities")
    relations = gb.extract_relations(sections, entities, patterns, edge_types, header)
    equal = gb.equivalent_by_label(sections, other_documents=True).select("src", "dst", "type")
    near = gb.topic_window_pairs(sections, topics, equal).select("src", "dst", "type")
    nodes = gb.merge_nodes([entities, sections.select(F.col("node_id").alias("id"), F.lit("section").alias("type"), F.col("title").alias("label"))])
    return nodes, gb.dedupe_edges(relations.unionByName(equal).unionByName(near))
