"""Similar documents: dense and sparse cosine, top-k by label, duplicate probes, links of names to documents."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import all_grams, grams, normal_text, normal_url


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


#: Queries and items of a block: a pair of blocks is one matrix product of at most some 100 MB.
QUERY_BLOCK, ITEM_BLOCK = 512, 16_384
#: Products that differ by less are computed again one by one, so that equal vectors have equal products wherever they lie.
NEAR = 1e-9


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of length 1 as rows; a vector without length stays as it is."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(rows.flatten(), dtype=np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))
    length = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return flat / np.where(length > 0, length, 1.0)


def _nearest(q: pa.Table, p: pa.Table, k: int, per: list[str], id: str) -> pa.Table:
    """The ``k`` nearest of a block of items to each of a block of queries, within each value of ``per``."""
    if not len(q) or not len(p):
        q, p = q.slice(0, 0), p.slice(0, 0)
    of_q, of_p = _units(q.column("vector")), _units(p.column("vector"))
    q_ids, p_ids = (np.asarray(t.column(id)) for t in (q, p))
    group = np.zeros(len(p), np.int64)
    for c in per:
        code = np.asarray(pc.fill_null(p.column(c).combine_chunks().dictionary_encode().indices, -1)).astype(np.int64) + 1
        group = np.unique(group * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
    product, rows, columns = of_q @ of_p.T, [], []
    for g in range(int(group.max(initial=-1)) + 1):
        members = np.flatnonzero(group == g)
        for i in range(len(q_ids)):
            own = members[p_ids[members] != q_ids[i]]
            if len(own) > k:
                least = np.partition(product[i, own], len(own) - k)[len(own) - k]
                own = own[product[i, own] >= least - NEAR]
            exact = (of_p[own] * of_q[i]).sum(axis=1)
            best = own[np.lexsort((p_ids[own], -exact))[:k]]
            rows.append(np.full(len(best), i))
            columns.append(best)
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, columns))
    similarity = (of_q[i] * of_p[j]).sum(axis=1) if len(i) else np.zeros(0)
    return pa.table({"query_id": pa.array(q_ids[i]), id: pa.array(p_ids[j]), **{c: p.column(c).combine_chunks().take(pa.array(j)) for c in per}, "similarity": pa.array(similarity)})


def top_similar(queries: DataFrame, items: DataFrame, k: int, per: list[str] = [], id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest items (within each value of ``per``) of every query, ties to the smaller id: query_id, id, per, similarity, rank.

    Queries and items are dealt into blocks; each pair of blocks is a matrix product in one task that keeps its best, and
    these are merged.  Nothing is sent to all tasks, and no pair of rows becomes a row.  Rows without id or vector take no part.
    """
    good = lambda df: df.filter(F.col(id).isNotNull() & F.col(vector).isNotNull())
    blocks = lambda df, size: df.count() // size + 1
    queries, items = good(queries), good(items)
    nq, ni = blocks(queries, QUERY_BLOCK), blocks(items, ITEM_BLOCK)
    block = lambda n: F.pmod(F.xxhash64(id), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select(block(nq).alias("qb"), every(ni).alias("ib"), F.col(id), F.col(vector).alias("vector"))
    p = items.select(every(nq).alias("qb"), block(ni).alias("ib"), F.col(id), *per, F.col(vector).alias("vector"))
    kind = lambda c: items.schema[c].dataType.simpleString()
    schema = ", ".join([f"query_id {kind(id)}", f"`{id}` {kind(id)}", *[f"`{c}` {kind(c)}" for c in per], "similarity double"])
    met = q.groupBy("qb", "ib").cogroup(p.groupBy("qb", "ib")).applyInArrow(lambda a, b: _nearest(a, b, k, per, id), schema)
    w = W.partitionBy("query_id", *per).orderBy(F.desc("similarity"), id)
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def gram_counts(docs: DataFrame, sizes: tuple[int, ...] = (2, 3), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, gram, n): character grams with their counts."""
    return docs.select(id, F.explode(all_grams(F.col(text), sizes)).alias("gram")).groupBy(id, "gram").agg(F.count(F.lit(1)).alias("n"))


def sparse_cosine(left: DataFrame, right: DataFrame, id: str = "doc_id") -> DataFrame:
    """(left_id, right_id, cosine) of gram counts that share a gram; the left side is a stated set of queries."""
    norm = lambda df: df.withColumn("__w", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(id))))
    a = norm(left).select(F.col(id).alias("left_id"), "gram", F.col("__w").alias("a"))
    b = norm(right).select(F.col(id).alias("right_id"), "gram", F.col("__w").alias("b"))
    return a.join(b, "gram").filter("left_id <> right_id").groupBy("left_id", "right_id").agg(F.sum(F.col("a") * F.col("b")).alias("cosine"))


def probe_duplicate(incoming: DataFrame, corpus: DataFrame, least_title: int = 12) -> DataFrame:
    """Incoming documents with duplicate_of and how: the same link, else the same normalised title of some length."""
    urls = corpus.select(normal_url(F.col("url")).alias("__u"), F.col("doc_id").alias("by_url")).filter("__u <> ''").groupBy("__u").agg(F.min("by_url").alias("by_url"))
    titles = corpus.select(normal_text(F.col("title")).alias("__t"), F.col("doc_id").alias("by_title")).filter(F.length("__t") >= least_title).groupBy("__t").agg(F.min("by_title").alias("by_title"))
    met = incoming.withColumns({"__u": normal_url(F.col("url")), "__t": normal_text(F.col("title"))}).join(urls, "__u", "left").join(titles, "__t", "left")
    how = F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_title").isNotNull(), "title").otherwise("new")
    return met.withColumns({"duplicate_of": F.coalesce("by_url", "by_title"), "duplicate_by": how}).drop("__u", "__t", "by_url", "by_title")


def word_pattern(words: list[str]) -> str:
    """A pattern that, at any place of a text, gives the longest of ``words`` that begins there: a trie, so a place costs as many steps as the word is long."""
    trie: dict = {}
    for word in filter(None, words):
        node = trie
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [re.escape(c) + written(below) for c, below in sorted(node.items()) if c]
        inner = ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"
        return "" if not ways else f"(?:{inner})?" if "" in node else inner

    return f"(?=({written(trie)}))" if trie else "(?!)()"


def words_in(docs: DataFrame, words: list[str], text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, word): each of ``words`` (a lexicon of bounded size) that a text holds, found in one pass over it."""
    distinct = sorted({w for w in words if w})
    among, inner = set(distinct), {}  # what else stands in each word
    for w in distinct:
        parts = sorted({w[i:j] for i in range(len(w)) for j in range(i + 1, len(w) + 1)} & among)
        if len(parts) > 1:
            inner[w] = parts
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(word_pattern(distinct)), F.lit(1)))
    if inner:
        held = F.create_map(*[x for w, parts in inner.items() for x in (F.lit(w), F.array(*[F.lit(v) for v in parts]))])
        found = F.array_distinct(F.flatten(F.transform(found, lambda w: F.coalesce(F.try_element_at(held, w), F.array(w)))))
    # outer, as a plain explode adds a filter that reads every text a second time
    return docs.select(id, F.explode_outer(found).alias("word")).filter("word <> ''").distinct()


def link_entities(docs: DataFrame, aliases: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """(doc_id, entity, confidence, basis): entities whose alias stands in the text (the longest, once each); else by words of their sector.

    ``aliases`` (entity, alias, exact) and ``sectors`` (entity, word) are lexicons: dimensions that the driver may hold.
    """
    named = words_in(docs, [r["alias"] for r in aliases.select("alias").distinct().collect()]).withColumnRenamed("word", "alias").join(F.broadcast(aliases), "alias")
    best = named.groupBy("doc_id", "entity").agg(F.min_by(F.struct("alias", "exact"), F.struct(-F.length("alias"), "alias")).alias("m"))
    direct = best.select("doc_id", "entity", F.when(F.col("m.exact"), 0.98).otherwise(0.95).alias("confidence"), F.col("m.alias").alias("basis"))
    if sectors is None:
        return direct
    found = words_in(docs, [r["word"] for r in sectors.select("word").distinct().collect()]).join(direct.select("doc_id").distinct(), "doc_id", "left_anti")
    theme = found.join(F.broadcast(sectors), "word").groupBy("doc_id", "entity").agg(F.min("word").alias("basis"))
    return direct.unionByName(theme.select("doc_id", "entity", F.lit(0.91).alias("confidence"), "basis"))


def gram_similarity(docs: DataFrame, size: int = 5) -> DataFrame:
    """Documents with their gram sets, for similarity expressions."""
    return docs.withColumn("grams", grams(F.col("text"), size))
