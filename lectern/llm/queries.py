"""One query per training-data operator, over its whole table, as the contracts fix its columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import annular_codes, decontaminate, fingerprints, language, maintext, mixing, neardup, ngrams, pieces, sort_means, tokens, urls, warc
from lectern.llm.shared import Scratch, crc_mod
from lectern.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # a small table may be one file; its texts are then dealt out to all cores
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


@_query
def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, _table(spark, sf_dir, "documents"), shingle_words=2, percent=80).drop("set_hi", "set_lo")


ORACLES["op4_minhash_neardup"] = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sized AS (SELECT doc_id, g, n FROM shingles JOIN sizes USING (doc_id)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n + b.n AS n, count(*) AS k FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * k >= 80 * (n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT y, root FROM reached JOIN both_ways ON x = node WHERE root < y)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.root AS component_id, d.doc_id = r.root AS kept
FROM documents d JOIN (SELECT node, min(root) AS root FROM reached GROUP BY node) r ON r.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


@_query
def op9_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_spans(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


ORACLES["op9_winnowing_decontamination"] = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ix AS (SELECT item_id, w, least(len(w), 13) AS k FROM iw WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM ix)),
sizes AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM doc_windows JOIN item_windows USING (k, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(hi.ids, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit_words hw USING (doc_id) LEFT JOIN hit_items hi USING (doc_id)
"""


@_query
def op7_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    network = language.fit(docs, crc_mod(F.col("doc_id"), 4) != 2)
    found = language.identify(docs.select("doc_id", "text"), network)
    # a row without an id is never learned from
    held_out = F.coalesce(crc_mod(F.col("row.doc_id"), 4) == 2, F.lit(True))
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


@_query
def op5_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, texts, plan = mixing.mix(spark, _table(spark, sf_dir, "documents"), with_text=False)
    taken = parts.groupBy("source", "start").agg(F.sum("n_words").alias("taken")).select(F.col("source").alias("s"), F.col("start").alias("a"), "taken")
    rows = texts.join(taken, (F.col("size") > 0) & F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("a")), "left")
    named = spark.createDataFrame(list(zip(plan.sources, plan.sizes, plan.targets, strict=True)), "name string, source_size long, target double")
    rows = rows.join(mixing.sent(named, len(plan.sources), mixing.MOST_SENT_SOURCES), F.col("source").eqNullSafe(F.col("name")), "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


@_query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = tokens.token_counts(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@_query
def op3_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 7)
    model = ngrams.train(spark, docs.where(held_out != 2), Scratch(spark))
    found = ngrams.score(docs, model)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        # a row without an id is never learned from
        F.coalesce(crc_mod(F.col("row.doc_id"), 7) == 2, F.lit(True)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@_query
def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = maintext.extract(_table(spark, sf_dir, "pages"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@_query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("row.page_id", "host", "path", "rule", "verdict")


@_query
def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.build_derivatives(warc.responses_of_pages(_table(spark, sf_dir, "pages")), ["page_id"])
    sizes = F.octet_length("block").cast("long").alias("content_length")
    return records.select("key.page_id", "type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", sizes, F.decode("block", "UTF-8").alias("content"))


@_query
def op2_weighted_sampling_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


#: Labels whose sums go to all tasks at most; of more, both sides are dealt by label, where Spark splits a label of very many rows.
MOST_SENT_LABELS = 100_000


@_query
def op11_annular_norm_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = annular_codes.compress(spark, vectors.select("vec_id", "label", "embedding"))
    if found is None:
        return vectors.limit(0).select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    sums = Scratch(spark).keep(found.vectors.groupBy(F.col("row.label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= MOST_SENT_LABELS:
        sums = F.broadcast(sums)
    rows = found.vectors.select("row.vec_id", "code", "error", F.col("row.label").alias("label")).join(sums, F.col("label").eqNullSafe(F.col("of")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


@_query
def op12_sentencepiece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    found = pieces.decode(spark, pieces.encode(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"), words), words)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = sort_means.cluster(spark, vectors.select("vec_id", "embedding"))
    schema = "of int, cluster_inertia long, centroid_sha256 string"
    told = list(zip(range(len(found.inertia)), found.inertia.tolist(), found.digests(), strict=True)) if found else []
    rows = found.vectors if found else vectors.limit(0).select(F.struct("vec_id").alias("row"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    total = F.lit(int(found.inertia.sum()) if found else 0).cast("long")
    # a row a centroid
    rows = rows.join(F.broadcast(spark.createDataFrame(told, schema)), F.col("cluster") == F.col("of"))
    return rows.select("row.vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")


def _op13_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain k-means, a step of the CTE a round; integers as doubles, which hold them exactly."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.vec_id, x.v, y.c, x.q + y.q - 2 * list_inner_product(x.v, y.v) AS d FROM x, c{i} y) GROUP BY vec_id, v)")
        if i < rounds:
            means = f"SELECT c, list(m ORDER BY p) AS v FROM (SELECT c, p, floor(sum(u) / count(*)) AS m FROM (SELECT c, unnest(v) AS u, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY c, p) GROUP BY c"
            steps.append(f"m{i} AS ({means}), c{i + 1} AS (SELECT c, v, list_inner_product(v, v) AS q FROM (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c))")
    return f"""
WITH x AS MATERIALIZED (SELECT vec_id, v, list_inner_product(v, v) AS q FROM (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: coalesce(isfinite(e), false))) = 64)),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, v, q FROM (SELECT sha256('2:' || vec_id) AS h, v, q FROM x ORDER BY h LIMIT {k})),
{", ".join(steps).replace(" AS (SELECT vec_id, v, arg", " AS MATERIALIZED (SELECT vec_id, v, arg")}
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c{rounds}.v, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


ORACLES["op13_sort_means"] = _op13_sql()


def _op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every part against every entry, a step of the CTE a round; integers as doubles, which hold them exactly."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.vec_id, x.p, x.v, y.e, x.q + y.q - 2 * list_inner_product(x.v, y.v) AS d FROM x JOIN c{i} y ON x.p = y.p) GROUP BY vec_id, p, v)")
        if i < rounds:
            means = f"SELECT p, e, list(m ORDER BY s) AS v FROM (SELECT p, e, s, floor(sum(u) / count(*)) AS m FROM (SELECT p, e, unnest(v) AS u, generate_subscripts(v, 1) AS s FROM a{i}) GROUP BY p, e, s) GROUP BY p, e"
            steps.append(f"m{i} AS ({means}), c{i + 1} AS (SELECT p, e, v, list_inner_product(v, v) AS q FROM (SELECT c{i}.p, c{i}.e, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON m{i}.p = c{i}.p AND m{i}.e = c{i}.e))")
    return f"""
WITH whole AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor(1024 * CAST(e AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: coalesce(isfinite(e), false))) = len(embedding)),
x AS MATERIALIZED (SELECT vec_id, p, v, list_inner_product(v, v) AS q FROM (SELECT vec_id, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS v FROM whole, (SELECT unnest(range({parts})) AS p))),
c0 AS (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS e, v, q FROM x QUALIFY e < {entries}),
{", ".join(steps)},
sums AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda u: CAST(CAST(u AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM sums JOIN whole USING (vec_id), books
"""


ORACLES["op11_annular_norm_codes"] = _op11_sql()


# --- what of the results SQL can express, through the same operators


@_query
def part6_host_path_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule")


ORACLES["part6_host_path_rule"] = r"""
WITH parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)
SELECT page_id, host, path, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM cut
"""


@_query
def part2_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_weighted_sampling_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


ORACLES["part2_edited_texts"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next FROM t WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(substr(text, 1, length(text) - length(text) // 3) || substr(next, 1, length(text) // 3)) AS edited_sha256 FROM n
"""


@_query
def part5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_mixing_weights(spark, sf_dir).select("doc_id", "size", "source_size")


ORACLES["part5_sizes"] = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)
SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM s
"""


@_query
def part8_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


ORACLES["part8_bytes"] = "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents"
