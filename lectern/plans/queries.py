"""The driver's queries over its tables, and their DuckDB equivalents.

Each query puts an operator of the engine to work on a driver table whose
columns stand for the operator's own (an order is a document added on its date,
a conversation a document whose turns are blocks, and so on).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import ids, vectors
from lectern.functions import text as X
from lectern.jobs import summary
from lectern.operators import catalog, grams, retrieval
from lectern.operators.annotate import annotate, block_rows, histograms, outline
from lectern.operators.chunk import ChunkConfig, chunk
from lectern.operators.ingest import point_id
from lectern.operators.metadata import cascade, doi_of, enrich_abstracts, inverted_index, likeness, parse_works, rebuild_abstracts
from lectern.operators.segments import Blocks, with_context
from lectern.operators.models import HashingEmbedder, OverlapReranker, embed_column
from lectern.schemas import POINTS
from lectern.session import shared_folder, spread
from lectern.sources import files
from lectern.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: ASCII letters in DuckDB's translate.
FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 7 != 0, F.year("o_orderdate")).alias("year"), F.lit(None).cast("string").alias("journal"), F.col("o_orderstatus").alias("first_author"), F.lit(None).cast("string").alias("doi"), F.col("o_orderdate").alias("added_at"))


def parts_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.col("p_brand").alias("journal"), F.lit("").alias("first_author"), F.lit(None).cast("string").alias("doi"), F.col("p_retailprice").alias("added_at"), F.col("p_type").alias("abstract"), F.array(F.col("p_brand")).alias("keywords"))


_LISTED = "SELECT o_orderkey AS doc_id, o_orderpriority AS title, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders"


@query("SELECT doc_id, title, year FROM (SELECT o_orderkey AS doc_id, o_orderpriority AS title, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year, o_orderdate FROM orders) ORDER BY o_orderdate DESC, doc_id LIMIT 20 OFFSET 40")
def q01_list_added(spark, sf_dir):
    return catalog.list_documents(orders_as_documents(spark, sf_dir), "added", 3, 20).select("doc_id", "title", "year")


@query(f"{_LISTED} ORDER BY title NULLS FIRST, doc_id LIMIT 20 OFFSET 20")
def q02_list_title(spark, sf_dir):
    return catalog.list_documents(orders_as_documents(spark, sf_dir), "title", 2, 20).select("doc_id", "title", "year")


@query(f"{_LISTED} ORDER BY year NULLS FIRST, doc_id LIMIT 20 OFFSET 0")
def q03_list_year(spark, sf_dir):
    return catalog.list_documents(orders_as_documents(spark, sf_dir), "year", 1, 20).select("doc_id", "title", "year")


@query(f"SELECT p_partkey AS doc_id, p_name AS title, p_size AS year FROM part WHERE contains(translate(p_name, {FOLD}), 'in') AND contains(translate(p_brand, {FOLD}), 'brand#1') AND p_size >= 5 AND p_size <= 40 ORDER BY p_retailprice DESC, doc_id LIMIT 20")
def q04_search_like(spark, sf_dir):
    rows, _ = catalog.search_documents(parts_as_documents(spark, sf_dir), 1, 20, title="IN", journal="BRAND#1", year_from=5, year_to=40)
    return rows.select("doc_id", "title", "year")


@query("SELECT CAST(count(*) AS BIGINT) AS total FROM part p WHERE p_size >= 10 AND EXISTS (SELECT 1 FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE l.l_partkey = p.p_partkey AND contains(lower(s.s_name), '7'))")
def q05_search_exists_author(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    authors = lines.select(F.col("l_partkey").alias("doc_id"), F.col("l_orderkey").alias("position"), F.col("s_name").alias("name"))
    docs = parts_as_documents(spark, sf_dir)
    keywords = docs.select("doc_id", F.explode("keywords").alias("keyword"))
    _, total = catalog.search_documents(catalog.nested(docs.drop("keywords"), authors, keywords), authors="7", year_from=10)
    return total


@query("SELECT doc_id, source FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(source), 'the')) AND (contains(lower(text), 'src1') OR contains(lower(source), 'src1'))")
def q06_search_fulltext(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(X.fulltext([F.col("text"), F.col("source")], 'The "SRC1" of')).select("doc_id", "source")


@query("SELECT o_orderkey AS doc_id, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)), '') AS authors, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS keywords FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def q07_get_document_nested(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    authors = lines.select("doc_id", F.col("l_linenumber").alias("position"), F.col("l_partkey").cast("string").alias("name"))
    found = catalog.nested(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), authors, lines.select("doc_id", F.col("l_returnflag").alias("keyword")))
    return found.select("doc_id", F.array_join("authors", ",").alias("authors"), F.array_join("keywords", ",").alias("keywords"))


@query("SELECT doc_id, substr(text, 501, 500) AS content, CAST(greatest(1, ceil(length(text) / 500.0)) AS INTEGER) AS pages FROM documents WHERE greatest(1, ceil(length(text) / 500.0)) >= 2")
def q08_text_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.page(F.col("text"), 2, 500).alias("content"), X.page_count(F.col("text"), 500).alias("pages"))
    return docs.where("pages >= 2")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


_COSINE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


@query(f"SELECT vec_id, round({_COSINE}, 6) AS embed_score FROM embeddings e ORDER BY {_COSINE} DESC, vec_id LIMIT 50")
def q09_knn_topk(spark, sf_dir):
    got = retrieval.nearest(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), retrieval.pool_size(10), "vec_id")
    return got.select("vec_id", F.round("embed_score", 6).alias("embed_score"))


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("section"), F.col("n_chars").cast("int").alias("year"), F.lower("lang").alias("journal_norm"))
    return table(spark, sf_dir, "embeddings").join(d, "vec_id")


@query(f"SELECT vec_id, round({_COSINE}, 6) AS embed_score FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.source IN ('src0', 'src3', 'src5') AND lower(d.lang) = 'en' ORDER BY {_COSINE} DESC, vec_id LIMIT 25")
def q10_knn_filtered_in(spark, sf_dir):
    kept = points_of(spark, sf_dir).where(retrieval.compile_filter({"section": ["src0", "src3", "src5"], "journal": "EN"}))
    return retrieval.nearest(kept, first_vector(spark, sf_dir), 25, "vec_id").select("vec_id", F.round("embed_score", 6).alias("embed_score"))


@query(f"SELECT vec_id, round({_COSINE}, 6) AS embed_score FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.n_chars BETWEEN 300 AND 2000 ORDER BY {_COSINE} DESC, vec_id LIMIT 25")
def q11_knn_filtered_range(spark, sf_dir):
    kept = points_of(spark, sf_dir).where(retrieval.compile_filter({"year": {"gte": 300, "lte": 2000}}))
    return retrieval.nearest(kept, first_vector(spark, sf_dir), 25, "vec_id").select("vec_id", F.round("embed_score", 6).alias("embed_score"))


_POOL = f"(SELECT vec_id, label, {_COSINE} AS s FROM embeddings e ORDER BY s DESC, vec_id LIMIT 50)"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    return retrieval.nearest(points, first_vector(spark, sf_dir), 50, "vec_id").join(points.select("vec_id", "label"), "vec_id")


@query(f"SELECT vec_id, label / 10.0::DOUBLE AS rerank_score FROM {_POOL} WHERE label / 10.0::DOUBLE >= 0.2 ORDER BY label DESC, s DESC, vec_id LIMIT 10")
def q12_rerank_stable(spark, sf_dir):
    pool = _pool(spark, sf_dir).withColumn("rerank_score", F.col("label") / 10.0)
    return retrieval.rerank(pool, 10, 0.2, id_col="vec_id").select("vec_id", "rerank_score")


@query(f"SELECT vec_id, CAST(NULL AS DOUBLE) AS rerank_score, round(s, 6) AS embed_score FROM {_POOL} WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 10")
def q13_degraded(spark, sf_dir):
    return retrieval.degraded(_pool(spark, sf_dir), 10, 0.1, "vec_id").select("vec_id", "rerank_score", F.round("embed_score", 6).alias("embed_score"))


@query("SELECT vec_id, label FROM embeddings WHERE false")
def q14_empty_in_list(spark, sf_dir):
    return points_of(spark, sf_dir).where(retrieval.compile_filter({"section": []})).select("vec_id", "label")


@query(r"""SELECT doc_id, CASE WHEN trim(text) = '' THEN '' ELSE trim(regexp_replace(regexp_replace(text, '(?im)^Table\s+S?\d+.*$', '', 'g'), '\n{3,}', E'\n\n', 'g'), E' \n\t\r') || chr(10) END AS cleaned
FROM (SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, '!\[.*?\]\(.*?\)\s*', '', 'g'), '(?im)^(?:Figure|Fig\.)\s+S?\d+.*$', '', 'g'), '(?is)<table.*?</table>', '', 'g'), chr(10)), lambda x: NOT starts_with(ltrim(x, E' \t\r'), '|')), chr(10)) AS text FROM documents)""")
def q15_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_markdown(F.col("text")).alias("cleaned"))


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as blocks; a block's lines are parted by blank ones first."""
    spread = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.split_blocks(spread)).alias("idx", "block"))


_LINES = r"(SELECT doc_id, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS idx, len(b) AS n FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> '') AS b FROM documents))"


@query(f"SELECT doc_id, CAST(idx AS INTEGER) AS idx, block, idx / greatest(n - 1, 1)::DOUBLE AS ratio FROM {_LINES}")
def q16_blocks(spark, sf_dir):
    spread = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(X.placed_blocks(spread)))


@query(rf"""SELECT doc_id, CAST(idx AS INTEGER) AS idx,
  CAST(regexp_matches(block, '(?i)^(?:fig(?:ure)?\.?)\s*[A-Za-z]?\d+') AS INTEGER) AS figure, CAST(regexp_matches(block, '(?i)^(?:table)\s*[A-Za-z]?\d+') AS INTEGER) AS tabular,
  CAST(regexp_matches(block, '^(?:\(?\d+\)?[\].:]?\s+|[A-Z][A-Za-z'' -]+,\s*[A-Z]\.)') AS INTEGER) AS reference,
  CAST(length(replace(block, ' ', '')) <= 12 AND regexp_matches(replace(block, ' ', ''), '^[A-Za-z0-9_.:-]+$') AS INTEGER) AS short
FROM {_LINES}""")
def q17_signals(spark, sf_dir):
    s = X.signals(F.col("block"))
    named = {"figure": "starts_with_figure_token", "tabular": "starts_with_table_token", "reference": "has_reference_markers", "short": "looks_like_short_label"}
    return line_blocks(spark, sf_dir).select("doc_id", "idx", *(s[v].cast("int").alias(k) for k, v in named.items()))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM conversations")
def q18_anchor(spark, sf_dir):
    blocks = Blocks(("conv_id",), "turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", blocks.last_before(F.col("turn"), F.col("role") == "user").alias("anchor"))


def conversations_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as annotated documents: a turn is a block, its role the section, every third a heading, every fifth not kept."""
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    block = F.struct(turn, turn.cast("int").alias("idx"), (turn % 5 != 4).alias("kept"), (turn % 3 == 0).alias("is_heading"), F.lit(1).alias("heading_level"), F.col("role").alias("role"), F.col("role").alias("section"), text.alias("text"), (turn / 10).alias("confidence"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))


_KEPT = "kept AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, turn % 3 = 0 AS heading FROM conversations WHERE turn % 5 <> 4)"
_OUTLINE = f"WITH {_KEPT} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS INTEGER) AS ord, role AS section, CAST(sum(CASE WHEN heading THEN 0 ELSE length(text) END) AS BIGINT) AS char_count, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE NOT heading), '') AS text FROM kept GROUP BY conv_id, role"


@query(f"SELECT conv_id, ord, section, char_count FROM ({_OUTLINE})")
def q19_outline(spark, sf_dir):
    return outline(conversations_as_documents(spark, sf_dir), "conv_id").drop("text")


@query(f"SELECT conv_id, section, text AS content FROM ({_OUTLINE})")
def q20_section_text(spark, sf_dir):
    return outline(conversations_as_documents(spark, sf_dir), "conv_id").select("conv_id", "section", F.col("text").alias("content"))


@query(f"""WITH {_KEPT}, pathed AS (SELECT *, coalesce(last_value(CASE WHEN heading THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), '') AS path FROM kept),
body AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role OR lag(path) OVER w IS DISTINCT FROM path AS starts FROM pathed WHERE NOT heading WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
numbered AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM body)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY island) - 1 AS INTEGER) AS chunk_index, string_agg(trim(text, E' \\t\\n\\r'), E'\\n\\n' ORDER BY turn) AS content, any_value(role) AS section, any_value(path) AS heading_path FROM numbered WHERE trim(text, E' \\t\\n\\r') <> '' GROUP BY conv_id, island""")
def q21_islands(spark, sf_dir):
    return chunk(conversations_as_documents(spark, sf_dir), ChunkConfig(1, 1_000_000, 0), "conv_id")


def annotated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: each line a block, so the annotator has something to decide."""
    return annotate(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text")))


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, trim(text, E' \t\n\r\x0b\x0c') AS t FROM documents),
w AS (SELECT doc_id, t, 0 AS turn, 0 AS start, CASE WHEN length(t) <= 800 THEN length(t) ELSE 800 - least(coalesce(nullif(least(sp1, sp2, sp3, sp4, sp5, sp6), 9999), 9999), 9999) + 1 END AS stop0, least(sp1, sp2, sp3, sp4, sp5, sp6) AS sp
  FROM (SELECT doc_id, t, coalesce(nullif(strpos(r, ' .'), 0), 9999) AS sp1, coalesce(nullif(strpos(r, ' ?'), 0), 9999) AS sp2, coalesce(nullif(strpos(r, ' !'), 0), 9999) AS sp3, coalesce(nullif(strpos(r, chr(10) || '.'), 0), 9999) AS sp4, coalesce(nullif(strpos(r, chr(10) || '?'), 0), 9999) AS sp5, coalesce(nullif(strpos(r, chr(10) || '!'), 0), 9999) AS sp6
    FROM (SELECT doc_id, t, reverse(substr(t, 1, 800)) AS r FROM p)) WHERE t <> ''
  UNION ALL
  SELECT doc_id, t, turn + 1, start, 0, least(sp1, sp2, sp3, sp4, sp5, sp6) FROM (SELECT doc_id, t, turn, start, coalesce(nullif(strpos(r, ' .'), 0), 9999) AS sp1, coalesce(nullif(strpos(r, ' ?'), 0), 9999) AS sp2, coalesce(nullif(strpos(r, ' !'), 0), 9999) AS sp3, coalesce(nullif(strpos(r, chr(10) || '.'), 0), 9999) AS sp4, coalesce(nullif(strpos(r, chr(10) || '?'), 0), 9999) AS sp5, coalesce(nullif(strpos(r, chr(10) || '!'), 0), 9999) AS sp6
    FROM (SELECT doc_id, t, turn, start, reverse(substr(t, start + 1, 800)) AS r FROM (SELECT doc_id, t, turn, start + CASE WHEN 800 - sp - 1 > 400 THEN 800 - sp + 1 ELSE 800 END - 80 AS start FROM w WHERE start + 800 < length(t)))))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn) - 1 AS INTEGER) AS chunk_index, content FROM (SELECT doc_id, turn, trim(substr(t, start + 1, CASE WHEN start + 800 >= length(t) THEN length(t) - start WHEN 800 - sp - 1 > 400 THEN 800 - sp + 1 ELSE 800 END), E' \t\n\r\x0b\x0c') AS content FROM w) WHERE content <> ''""")
def q22_chunk(spark, sf_dir):
    block = F.struct(F.lit(True).alias("kept"), F.lit(False).alias("is_heading"), F.lit(0).alias("heading_level"), F.lit("Other").alias("section"), F.col("text").alias("text"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array(block).alias("blocks"))
    return chunk(docs, ChunkConfig(1, 800, 80)).select("doc_id", "chunk_index", "content")


@query()
def q22b_chunk_annotated(spark, sf_dir):
    return chunk(annotated_documents(spark, sf_dir), ChunkConfig(200, 800, 80))


@query("SELECT sha256(text) AS content_hash, CAST(min(doc_id) AS BIGINT) AS doc_id, CAST(count(*) - 1 AS BIGINT) AS skipped FROM documents GROUP BY 1")
def q23_sha256_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash")).groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("skipped"))


@query("SELECT doc_id, i AS chunk_index, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT doc_id, i, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || (doc_id || '#' || i)::BLOB) AS h FROM documents, (SELECT unnest([0, 1, 2])::INTEGER AS i))")
def q24_point_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("chunk_index")).withColumn("point_id", point_id(F.col("doc_id"), F.col("chunk_index")))


@query(r"""WITH parts AS (SELECT doc_id, unnest(p) AS k, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split_regex(text || ',', '[\n;,|]+') AS p FROM documents)),
bare AS (SELECT doc_id, i, trim(regexp_replace(trim(regexp_replace(k, '\s+', ' ', 'g')), '^(?:[-*•]|\d+[.)])\s*', ''), ' .,:;/-_') AS k FROM parts),
keyed AS (SELECT doc_id, i, k, regexp_replace(lower(k), '[^a-z0-9]+', '', 'g') AS key FROM bare WHERE k <> '' AND length(k) <= 80 AND lower(k) NOT IN ('abstract', 'article', 'keyword', 'keywords', 'paper', 'research', 'review', 'study')),
firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS turn FROM keyed WHERE key <> ''),
capped AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM firsts WHERE turn = 1)
SELECT d.doc_id, coalesce(string_agg(k, ';' ORDER BY i), '') AS keywords FROM documents d LEFT JOIN capped c ON c.doc_id = d.doc_id AND c.place <= 10 GROUP BY d.doc_id""")
def q25_keyword_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.keyword_list(F.concat("text", F.lit(","))), ";").alias("keywords"))


@query(r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(substr(text, 1, 1000), '\b((?:19|20)\d{2})\b', 1), '') AS INTEGER) AS year FROM documents")
def q26_year_sniff(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.year_sniff(F.col("text")).alias("year"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x{00a0}\x1c-\x1f\x{0085}]+', ' ', 'g')) AS content FROM pages")
def q27_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("content"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \n]+', ' ', 'g')) AS abstract FROM documents")
def q28_inverted_index(spark, sf_dir):
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    index = inverted_index(table(spark, sf_dir, "documents").select("doc_id", words.alias("words")), "doc_id", "words")
    return rebuild_abstracts(index, "doc_id", "index")


@query("SELECT event_type AS status, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NOT NULL) AS BIGINT) AS with_result, CAST(min(event_id) AS BIGINT) AS first_job FROM events GROUP BY event_type")
def q29_job_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_result"), F.min("event_id").alias("first_job"))


@query("SELECT d.source AS kb, CAST(count(DISTINCT d.doc_id) AS BIGINT) AS doc_count, CAST(count(e.vec_id) AS BIGINT) AS chunk_count FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.source")
def q30_kb_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("kb"), "doc_id")
    return catalog.counts(docs, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "kb")


@query()
def q31_annotate(spark, sf_dir):
    return block_rows(annotated_documents(spark, sf_dir)).select("doc_id", "idx", "role", "section", "confidence", "kept")


@query()
def q32_section_outline(spark, sf_dir):
    return outline(annotated_documents(spark, sf_dir)).drop("text")


@query("SELECT p_partkey, round(greatest(0.8, 2.0 * length(x) / (length(x) + length(y))), 6)::DOUBLE AS likeness FROM (SELECT p_partkey, lower(p_name) AS x, lower(p_name) || ' and ' || lower(p_brand) AS y FROM (SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_]+', ' ', 'g') AS p_name, regexp_replace(p_brand, '[^A-Za-z0-9_]+', ' ', 'g') AS p_brand FROM part))")
def q33_title_likeness(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    longer = F.concat(F.upper("p_name"), F.lit(",  and ("), F.col("p_brand"), F.lit(")."))
    return p.select("p_partkey", F.round(likeness(F.col("p_name"), longer), 6).alias("likeness"))


@query("SELECT doc_id, '10.1234/x.' || doc_id AS doi FROM documents")
def q34_find_doi(spark, sf_dir):
    text = F.concat(F.col("text"), F.lit("\ndoi: 10.1234/x."), F.col("doc_id"), F.lit(")."))
    return table(spark, sf_dir, "documents").select("doc_id", doi_of(text).alias("doi"))


@query("SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS embed_score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id) <= 10")
def q35_knn_batch(spark, sf_dir):
    import numpy as np
    import pyarrow as pa

    points = table(spark, sf_dir, "embeddings")
    asked = points.where("vec_id % 50 = 0").select(F.col("vec_id").cast("long"), "embedding").orderBy("vec_id").toArrow().combine_chunks()
    ids = asked.column("vec_id").to_numpy()
    asked = asked.column("embedding").combine_chunks()
    got = retrieval.nearest_batch(points, asked.flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.empty((0, 1)), 10, "vec_id")
    names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(ids)), pa.int32()), "query_id": pa.array(ids, pa.int64())}))
    return got.join(names, "query").select("query_id", "vec_id", F.round("embed_score", 5).alias("embed_score"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS size FROM embeddings")
def q36_vector_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("size"))


@query()
def q37_embed_and_rerank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", embed_column(F.col("text"), HashingEmbedder()).alias("embedding"), "text")
    pool = retrieval.nearest(docs, HashingEmbedder().embed(["the of and in"])[0], 50, "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    score = F.pandas_udf(lambda texts: pd.Series(OverlapReranker().score("the of and in", texts.tolist())), "double")(F.col("text"))
    return retrieval.rerank(pool.withColumn("rerank_score", score), 10, id_col="doc_id").select("doc_id", "embed_score", "rerank_score")


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: every fifth has another ending, every third another beginning."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/in/"), F.col("doc_id"), F.when(F.col("doc_id") % 5 == 0, ".txt").otherwise(".pdf"))
    content = F.concat(F.when(F.col("doc_id") % 3 == 0, "junk").otherwise("%PDF-1.4\n"), F.col("text"))
    return d.select(path.alias("path"), content.cast("binary").alias("content"))


_FILES = "files AS (SELECT doc_id, '/in/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.pdf' END AS path, CAST(doc_id AS VARCHAR) AS name, sha256(CASE WHEN doc_id % 3 = 0 THEN 'junk' ELSE '%PDF-1.4' || chr(10) END || text) AS content_hash, CASE WHEN doc_id % 5 = 0 THEN 'not a pdf file' WHEN doc_id % 3 = 0 THEN 'not a pdf header' END AS problem, text FROM documents)"


@query(f"WITH {_FILES} SELECT path, name, content_hash, problem FROM files")
def q38_stage_files(spark, sf_dir):
    return files.stage(documents_as_files(spark, sf_dir)).select("path", "name", "content_hash", "problem")


@query(f"WITH {_FILES}, good AS (SELECT * FROM files WHERE problem IS NULL), known AS (SELECT content_hash FROM files WHERE doc_id % 11 = 0) SELECT content_hash, min(path) AS path FROM good WHERE content_hash NOT IN (SELECT content_hash FROM known) GROUP BY content_hash")
def q39_new_content(spark, sf_dir):
    staged = files.stage(documents_as_files(spark, sf_dir))
    known = staged.where(F.col("name").cast("long") % 11 == 0).select("content_hash")
    fresh, _ = files.new_content(staged.where("problem IS NULL"), known)
    return fresh.select("content_hash", "path")


@query(f"WITH {_FILES} SELECT content_hash, any_value(CASE WHEN EXISTS (SELECT 1 FROM files k WHERE k.doc_id % 11 = 0 AND k.content_hash = f.content_hash) THEN 'held ' || content_hash ELSE text END) AS markdown FROM files f WHERE problem IS NULL GROUP BY content_hash")
def q40_parse_through_cache(spark, sf_dir):
    staged = files.stage(documents_as_files(spark, sf_dir))
    cache = staged.where(F.col("name").cast("long") % 11 == 0).select("content_hash", F.concat(F.lit("held "), "content_hash").alias("markdown")).distinct()
    parsed, _ = files.parse(staged.where("problem IS NULL"), cache, files.text_parser)
    return parsed.select("content_hash", "markdown")


@query("SELECT conv_id, (SELECT string_agg(role || ':' || n, ',' ORDER BY role) FROM (SELECT role, count(*) AS n FROM conversations d WHERE d.conv_id = c.conv_id GROUP BY role)) AS roles, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (WHERE turn / 10.0 < 0.7), '') AS doubtful FROM conversations c GROUP BY conv_id")
def q41_histograms(spark, sf_dir):
    found = histograms(conversations_as_documents(spark, sf_dir), "conv_id")
    roles = F.transform(F.array_sort(F.map_entries("sections")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return found.select("conv_id", F.array_join(roles, ",").alias("roles"), F.array_join(F.transform("doubtful", lambda i: i.cast("string")), ",").alias("doubtful"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new ' || doc_id ELSE text END AS full_text FROM documents WHERE doc_id % 7 <> 0")
def q42_store_upsert_remove(spark, sf_dir):
    """All texts go in, every tenth is replaced, every seventh removed; what the store then has."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.create("k", {"name": "k"})
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("full_text"))
    number = F.col("doc_id").cast("long")
    store.publish("k", {"doc_text": texts})
    store.publish("k", {"doc_text": texts.where(number % 10 == 0).withColumn("full_text", F.concat(F.lit("new "), "doc_id"))})
    store.publish("k", removed={"doc_text": texts.where(number % 7 == 0).select("doc_id")})
    return store.read("k", "doc_text")


@query("SELECT CAST(p_partkey AS VARCHAR) AS content_hash, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Work ' || p_partkey ELSE 'f' || p_partkey END ELSE 'f' || p_partkey END AS title, CAST(CASE p_partkey % 3 WHEN 0 THEN 1999 WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 2005 END END AS INTEGER) AS year, CASE p_partkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'crossref' ELSE 'unresolved' END ELSE 'unresolved' END AS source FROM part")
def q43_metadata_cascade(spark, sf_dir):
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("# "), "p_name", F.lit("\n\nPublished in 1999 or so"))).when(key % 3 == 1, F.concat(F.lit("see doi: 10.1000/part."), key)).otherwise(F.lit("plain words"))
    docs = p.select(key.cast("string").alias("content_hash"), F.concat(F.lit("f"), key).alias("name"), text.alias("markdown"))
    message = F.concat(F.lit('{"title": ["Work '), key, F.lit('"], "issued": {"date-parts": [[2005]]}}'))
    works = p.where(key % 2 == 0).select(F.concat(F.lit("10.1000/PART."), key).alias("doi"), message.alias("message"))
    return cascade(docs, works).select("content_hash", "title", "year", "source")


@query("SELECT doc_id, CASE WHEN source <> 'src1' AND n_chars % 2 = 0 THEN coalesce(CASE WHEN doc_id % 3 = 0 THEN 'first ' || doc_id END, CASE WHEN doc_id % 5 <> 0 THEN 'second ' || doc_id END) WHEN n_chars % 2 = 1 THEN 'own' END AS abstract FROM documents")
def q44_enrich_abstracts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    doi = F.concat(F.lit("10.1/D"), "doc_id")
    found = d.select("doc_id", doi.alias("doi"), F.when(F.col("source") == "src1", "unresolved").otherwise("crossref").alias("source"), F.when(F.col("n_chars") % 2 == 1, "own").alias("abstract"))
    say = lambda word, keep: d.where(keep).select(F.lower(doi).alias("doi"), F.concat(F.lit(word), "doc_id").alias("abstract"))
    return enrich_abstracts(found, [say("first ", F.col("doc_id") % 3 == 0), say("second ", F.col("doc_id") % 5 != 0)]).select("doc_id", "abstract")


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01 12:30:00' AND coalesce(year(o_orderdate), 0) <= 1997 AND lower(o_orderstatus) IN ('f', 'o')")
def q45_filter_added_after(spark, sf_dir):
    o = orders_as_documents(spark, sf_dir).withColumn("first_author_norm", F.lower("first_author")).withColumn("year", F.year("added_at")).withColumn("added_ts", F.unix_micros(F.col("added_at").cast("timestamp")) / 1e6)
    asked = {"added_after": "1996-03-01T12:30:00Z", "year": {"lte": 1997}, "first_author": ["F", "O"]}
    return o.where(retrieval.compile_filter(asked)).select("doc_id")


@query(f"SELECT CAST(vec_id AS VARCHAR) AS point_id, round(s, 5) AS embed_score, length(text) % 7 / 10.0::DOUBLE AS rerank_score FROM (SELECT e.vec_id, d.text, {_COSINE} AS s FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.source IN ('src0', 'src1', 'src2', 'src3') ORDER BY s DESC, CAST(e.vec_id AS VARCHAR) LIMIT 50) WHERE length(text) % 7 / 10.0::DOUBLE >= 0.2 ORDER BY length(text) % 7 DESC, s DESC, CAST(vec_id AS VARCHAR) LIMIT 10")
def q46_search_chunks(spark, sf_dir):
    """A search as a user makes it: filter, coarse and exact scores, payload, re-ranking."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("section"), F.col("text").alias("content"))
    points = table(spark, sf_dir, "embeddings").join(d, "vec_id").select(F.col("vec_id").cast("string").alias("point_id"), "section", "content", vectors.packed(F.col("embedding")).alias("packed")).withColumn("coarse", vectors.coarse(F.col("packed")))
    first = first_vector(spark, sf_dir)
    searcher = retrieval.Searcher(points, lambda q: first, lambda q, texts: [len(t) % 7 / 10 for t in texts])
    found = searcher.search("any", 10, 0.2, {"section": ["src0", "src1", "src2", "src3"]}).chunks
    rows = [(c["metadata"]["point_id"], round(c["embed_score"], 5), c["rerank_score"]) for c in found]
    return spark.createDataFrame(rows, "point_id string, embed_score double, rerank_score double")


@query(f"SELECT vec_id, round({_COSINE}, 6) AS embed_score FROM embeddings e ORDER BY {_COSINE} DESC, vec_id LIMIT 50")
def q47_knn_all_cells(spark, sf_dir):
    """The search over cells, looking into all of them, which is exact; tests measure the recall of fewer."""
    points = table(spark, sf_dir, "embeddings")
    centres = retrieval.centroids(points, 16)
    held = points.withColumn("cell", retrieval.cell_of(F.col("embedding"), centres))
    got = retrieval.nearest_in_cells(held, centres, first_vector(spark, sf_dir), 50, probes=16, id_col="vec_id")
    return got.select("vec_id", F.round("embed_score", 6).alias("embed_score"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS first, round(embedding[64]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS last FROM embeddings")
def q48_unit_vectors(spark, sf_dir):
    unit = vectors.unit(F.transform("embedding", lambda x: (x * 3).cast("float")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(unit[0].cast("double"), 4).alias("first"), F.round(unit[63].cast("double"), 4).alias("last"))


@query(r"SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(idx % 4 AS INTEGER) AS level, block AS text, lower(regexp_replace(block, '\s+', ' ', 'g')) AS key FROM " + _LINES)
def q49_headings(spark, sf_dir):
    b = line_blocks(spark, sf_dir).withColumn("block", F.concat(F.repeat(F.lit("#"), F.col("idx") % 4), F.when(F.col("idx") % 4 > 0, F.lit("  ")).otherwise(F.lit("")), F.col("block")))
    text = X.block_text(F.col("block"))
    return b.select("doc_id", "idx", X.heading_level(F.col("block")).alias("level"), text.alias("text"), X.heading_key(text).alias("key"))


@query("SELECT p_partkey AS doc_id, p_name AS title, p_brand || ',' || p_type AS keywords FROM part WHERE p_partkey = 17")
def q50_get_document(spark, sf_dir):
    docs = parts_as_documents(spark, sf_dir).withColumn("keywords", F.array("abstract", "journal"))
    return catalog.get_document(docs, 17).select("doc_id", "title", F.array_join("keywords", ",").alias("keywords"))


@query("SELECT sha256(text) AS content_hash, CAST(doc_id AS BIGINT) AS doc_id FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 5)")
def q51_find_by_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    wanted = d.where("doc_id = 5").select(ids.content_hash(F.col("text")).alias("h")).first().h
    return catalog.find_by_hash(d.select(ids.content_hash(F.col("text")).alias("content_hash"), "doc_id"), wanted)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of new content, cut into chunks, joined to vectors; the filtered pool in stable re-rank order."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy(ids.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    fresh = docs.join(first, "doc_id", "left_semi").where("lang = 'en'")
    spread = fresh.select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    chunks = chunk(annotate(spread), ChunkConfig(100, 800, 80)).where("chunk_index = 0")
    points = table(spark, sf_dir, "embeddings").join(chunks.select(F.col("doc_id").alias("vec_id"), "content"), "vec_id")
    pool = retrieval.nearest(points, first_vector(spark, sf_dir), 50, "vec_id").join(points.select("vec_id", "content"), "vec_id")
    ranked = pool.withColumn("rerank_score", F.length("content") / 800.0)
    return retrieval.rerank(ranked, 10, id_col="vec_id").select("vec_id", "embed_score", "rerank_score", F.substring("content", 1, 80).alias("begins"))


@query(ORACLES["q06_search_fulltext"])
def q52_search_fulltext_index(spark, sf_dir):
    """The rows of q06 by way of a trigram index: lists intersected, then a left-semi join."""
    fields = [F.col("text"), F.col("source")]
    docs = table(spark, sf_dir, "documents")
    index = grams.build(spark, docs, fields, f"{shared_folder(spark)}/grams-{uuid.uuid4().hex}")
    return grams.search(docs, fields, index, 'The "SRC1" of').select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(source), 'rc2') OR contains(lower(source), 'tion') AND contains(lower(text), 'rc2') OR contains(lower(text), 'tion') AND contains(lower(text), 'rc2')")
def q53_search_fulltext_index_rare(spark, sf_dir):
    fields = [F.col("text"), F.col("source")]
    docs = table(spark, sf_dir, "documents")
    index = grams.build(spark, docs, fields, f"{shared_folder(spark)}/grams-{uuid.uuid4().hex}")
    return grams.search(docs, fields, index, "TION rc2").select("doc_id", "source")


@query("""WITH b AS (SELECT conv_id, turn, role AS section, coalesce(text, '') AS text, turn % 3 = 0 AS heading FROM conversations),
w AS (SELECT *, last_value(CASE WHEN heading THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM b)
SELECT conv_id, turn, anchor, CAST(segment AS BIGINT) AS segment,
  (SELECT arg_max(p.section, p.turn) FROM b p WHERE p.conv_id = w.conv_id AND p.turn < w.turn AND p.section IS DISTINCT FROM w.section) AS previous_section,
  (SELECT arg_min(n.section, n.turn) FROM b n WHERE n.conv_id = w.conv_id AND n.turn > w.turn AND n.section IS DISTINCT FROM w.section) AS next_section,
  coalesce((SELECT string_agg(t, '|' ORDER BY turn) FROM (SELECT substr(n.text, 1, 20) AS t, n.turn FROM b n WHERE n.conv_id = w.conv_id AND n.turn > w.turn AND n.turn <= w.turn + 8 AND NOT n.heading
    AND n.turn < coalesce((SELECT min(h.turn) FROM b h WHERE h.conv_id = w.conv_id AND h.turn > w.turn AND h.heading), 1000000000) ORDER BY n.turn LIMIT 2)), '') AS body_sample FROM w""")
def q54_block_context(spark, sf_dir):
    """Windows over blocks: nearest heading, segment, sections around, the body that follows."""
    heading = F.col("turn") % 3 == 0
    rows = with_context(table(spark, sf_dir, "conversations"), Blocks(("conv_id",), "turn"), heading, F.col("role"), F.coalesce("text", F.lit("")), ~heading, letters=20)
    return rows.select("conv_id", "turn", "anchor", "segment", "previous_section", "next_section", F.array_join("body_sample", "|").alias("body_sample"))


@query("""WITH m AS (SELECT p_partkey AS k, p_name AS name, p_size AS size FROM part)
SELECT CAST(k AS VARCHAR) AS doi, CASE k % 4 WHEN 0 THEN 'Work ' || name WHEN 1 THEN name WHEN 2 THEN '' ELSE '' END AS title,
  CAST(CASE WHEN k % 4 = 3 THEN NULL WHEN k % 3 = 0 THEN 1900 + size WHEN k % 3 = 1 THEN 2000 END AS INTEGER) AS year,
  CASE k % 4 WHEN 0 THEN 'Ann Ek;' || name WHEN 1 THEN 'Ek' ELSE '' END AS authors, CASE WHEN k % 4 = 0 THEN 'a;' || size ELSE '' END AS keywords FROM m""")
def q55_work_answers(spark, sf_dir):
    """Answers of a bibliographic service as VARIANT: lists and texts, years in order, authors of all forms, what is no JSON."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    dated = lambda name, year: F.concat(F.lit(f'"{name}": {{"date-parts": [['), year, F.lit("]]}"))
    year = F.when(k % 3 == 0, F.concat(dated("issued", F.lit("1")), F.lit(", "), dated("published-print", (F.lit(1900) + F.col("p_size")).cast("string")))).when(k % 3 == 1, dated("created", F.lit("2000"))).otherwise(F.lit('"issued": {"date-parts": [["2001"]]}'))
    quoted = F.concat(F.lit('"'), "p_name", F.lit('"'))
    body = F.when(k % 4 == 0, F.concat(F.lit('"title": ["Work '), "p_name", F.lit('"], "author": [{"given": "Ann", "family": "Ek"}, '), quoted, F.lit(', 5], "subject": ["a", '), F.concat(F.lit('"'), F.col("p_size"), F.lit('"')), F.lit(", 7], ")))
    body = body.when(k % 4 == 1, F.concat(F.lit('"title": '), quoted, F.lit(', "author": [{"family": "Ek"}, {}], "subject": "a", '))).otherwise(F.lit('"title": {"x": 1}, "author": 3, '))
    message = F.when(k % 4 == 3, F.lit("[no json")).otherwise(F.concat(F.lit("{"), body, year, F.lit("}")))
    got = parse_works(p.select(k.cast("string").alias("doi"), message.alias("message")), "doi", "message", "work")
    return got.select(F.col("key").alias("doi"), "title", "year", F.array_join("authors", ";").alias("authors"), F.array_join("keywords", ";").alias("keywords"))


@query(r"""WITH RECURSIVE l AS (SELECT p_partkey // 40 AS doc, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) AS i, p_name AS t FROM part),
g AS (SELECT doc, i, length(t) AS n, 1 AS c FROM l WHERE i = 1 UNION ALL SELECT l.doc, l.i, CASE WHEN g.n + 2 + length(l.t) <= 50 THEN g.n + 2 + length(l.t) ELSE length(l.t) END, CASE WHEN g.n + 2 + length(l.t) <= 50 THEN g.c ELSE g.c + 1 END FROM g JOIN l ON l.doc = g.doc AND l.i = g.i + 1),
packed AS (SELECT g.doc, g.c, string_agg(l.t, E'\n\n' ORDER BY l.i) AS t FROM g JOIN l ON l.doc = g.doc AND l.i = g.i GROUP BY g.doc, g.c),
m AS (SELECT doc, c, length(t) AS n, 1 AS k FROM packed WHERE c = 1 UNION ALL SELECT p.doc, p.c, CASE WHEN m.n < 60 THEN m.n + 2 + length(p.t) ELSE length(p.t) END, CASE WHEN m.n < 60 THEN m.k ELSE m.k + 1 END FROM m JOIN packed p ON p.doc = m.doc AND p.c = m.c + 1)
SELECT CAST(m.doc AS BIGINT) AS doc_id, CAST(m.k - 1 AS INTEGER) AS chunk_index, string_agg(p.t, E'\n\n' ORDER BY p.c) AS content FROM m JOIN packed p ON p.doc = m.doc AND p.c = m.c GROUP BY m.doc, m.k""")
def q56_chunk_merge_forward(spark, sf_dir):
    """Paragraphs packed up to a limit, and chunks that are too small joined with what follows."""
    block = F.struct("p_partkey", F.lit(True).alias("kept"), F.lit(False).alias("is_heading"), F.lit(0).alias("heading_level"), F.lit("Other").alias("section"), F.col("p_name").alias("text"))
    docs = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 40).alias("doc_id")).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return chunk(docs, ChunkConfig(60, 50, 0)).select("doc_id", "chunk_index", "content")


@query(rf"""SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(regexp_matches(block, '(?i)\b(department|university|institute|school|hospital|laboratory|centre|center)\b') AS INTEGER) AS affiliation,
  CAST(regexp_matches(block, '(?i)\b(received|accepted|published|editorial decision|revised)\b') AS INTEGER) AS received, CAST(regexp_matches(block, '(?i)\b(summary|research article summary|significance)\b') AS INTEGER) AS summary,
  CAST(regexp_matches(block, '(?i)\b(shown from top to bottom|scale bar|cells were treated|left to right)\b') AS INTEGER) AS caption FROM {_LINES}""")
def q57_signals_of_words(spark, sf_dir):
    """The four signals that words give; q17 has the others."""
    s = X.signals(F.col("block"))
    named = {"affiliation": "has_affiliation_keywords", "received": "has_received_dates", "summary": "looks_like_summary_heading", "caption": "looks_like_caption_body"}
    return line_blocks(spark, sf_dir).select("doc_id", "idx", *(s[v].cast("int").alias(k) for k, v in named.items()))


@query("SELECT event_type AS kind, CAST(event_id % 7 AS INTEGER) AS base, CAST(count(*) AS BIGINT) AS jobs, CAST(sum(event_id % 11) AS BIGINT) AS done, CAST(sum(CASE WHEN event_id % 5 = 4 THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(max(event_id) AS BIGINT) AS last_job FROM events GROUP BY ALL")
def q58_jobs_by_kind(spark, sf_dir):
    """What the engine's summary of jobs says of events taken as jobs."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(i.cast("long").alias("job_id"), F.col("event_type").alias("type"), (i % 7).cast("int").alias("kb"), F.when(i % 5 == 4, "failed").otherwise("succeeded").alias("status"), (i % 11).cast("long").alias("done"))
    return summary(rows).select(F.col("type").alias("kind"), F.col("kb").alias("base"), "jobs", "done", "failed", "last_job")


def stored_points(spark: SparkSession, sf_dir: str) -> Store:
    """All vectors as points of a base whose cells are small: in three changes, every tenth document replaced, every seventh removed."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", cell_points=150)
    store.create("k", {"name": "k"})
    kinds = dict(c.split(None, 1) for c in POINTS.split(", "))
    packed = vectors.packed(F.col("embedding"))
    given = {"point_id": F.col("vec_id").cast("string"), "doc_id": F.floor(F.col("vec_id") / 5).cast("string"), "chunk_index": (F.col("vec_id") % 5).cast("int"), "year": F.col("label").cast("int"), "packed": packed, "coarse": vectors.coarse(packed), "content": F.concat(F.lit("old "), "vec_id")}
    points = table(spark, sf_dir, "embeddings").select(*(given.get(n, F.lit(None).cast(k)).alias(n) for n, k in kinds.items()))
    number = F.col("doc_id").cast("long")
    store.publish("k", {"points": points.where(number % 2 == 0)})
    store.publish("k", {"points": points.where(number % 2 == 1)})
    store.publish("k", {"points": points.where(number % 10 == 0).withColumn("content", F.replace("content", F.lit("old"), F.lit("new")))}, {"points": points.where(number % 7 == 0).select("doc_id").distinct()})
    return store


@query("SELECT CAST(vec_id AS VARCHAR) AS point_id, CAST(vec_id // 5 AS VARCHAR) AS doc_id, CASE WHEN vec_id // 5 % 10 = 0 THEN 'new ' ELSE 'old ' END || vec_id AS content, label AS year FROM embeddings WHERE vec_id // 5 % 7 <> 0 OR vec_id // 5 % 10 = 0")
def q59_store_points(spark, sf_dir):
    """What the base has after points were added, replaced and removed, and cells divided."""
    return stored_points(spark, sf_dir).read("k", "points").select("point_id", "doc_id", "content", "year")


@query(f"SELECT CAST(vec_id AS VARCHAR) AS point_id, round({_COSINE}, 5) AS embed_score FROM embeddings e WHERE vec_id // 5 % 7 <> 0 OR vec_id // 5 % 10 = 0 ORDER BY {_COSINE} DESC, CAST(vec_id AS VARCHAR) LIMIT 50")
def q60_search_stored_cells(spark, sf_dir):
    """The nearest stored points, looking into all cells, which is exact; tests measure the recall of fewer."""
    store, first = stored_points(spark, sf_dir), first_vector(spark, sf_dir)
    searcher = retrieval.Searcher(store.read("k", "points"), lambda q: first, lambda q, texts: [0.0] * len(texts), cells=store.cells("k"), probes=1 << 20)
    found = searcher.search("any", 50).chunks
    return spark.createDataFrame([(c["metadata"]["point_id"], round(c["embed_score"], 5)) for c in found], "point_id string, embed_score double")


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 8 = 7 THEN NULL WHEN p_partkey % 8 = 6 THEN '10.1371/journal.pone.' || p_partkey ELSE '10.1000/part' || p_partkey || 'x' END AS doi FROM part")
def q61_doi_junk_tails(spark, sf_dir):
    """DOIs of texts: words, numbers, signs and names that stick to their ends, broken lines, components, and what is none."""
    k = F.col("p_partkey")
    plain = F.concat(F.lit("10.1000/part"), k, F.lit("x"))
    ends = [" and so on", "OPEN", "/123456", ").", ".Received", "(see", None, None]
    text = F.when(k % 8 == 7, F.lit("https://doi.org/10.1074/jbc")).when(k % 8 == 6, F.concat(F.lit("doi:10.1371/journal.\npone."), k, F.lit(".g001")))
    for i, end in enumerate(ends[:6]):
        text = text.when(k % 8 == i, F.concat(F.lit("see https://doi.org/"), plain, F.lit(end)))
    return table(spark, sf_dir, "part").select(k.alias("doc_id"), doi_of(text).alias("doi"))
