"""Filtered nearest chunks: filter compiler, cosine top-k, re-ranking, graceful degradation.

Scores need keys, vectors and filter columns only; contents are joined to the
few candidates afterwards.  A single query's vector is a literal, so scoring is
a narrow scan that ends in TakeOrderedAndProject; many queries at once are
scored by batches in numpy against a matrix of checked size.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.errors import InvalidFilter
from lectern.functions.vectors import dot, norm
from lectern.operators.cells import Cells
from lectern.operators.models import in_batches

FIELDS = ("doc_id", "section", "doi", "journal", "title", "first_author", "year", "added_after")
EXACT, FOLDED = frozenset(["doc_id", "section", "doi"]), frozenset(["journal", "title", "first_author"])
#: Texts that a re-ranker gets at once.
RERANK_BATCH = 128
#: Values of one block of queries' vectors that go to all tasks at most, and scores made at once.
MOST_QUERY_VALUES, MOST_SCORES = 4_000_000, 8_000_000


def one_of(name: str, values: list) -> Column:
    """Whether a column has one of the values; a long list goes to the JVM as one text, not value by value."""
    if len(values) < 8 or not all(isinstance(v, str) or _is_int(v) for v in values):
        return F.col(name).isin(values)
    # $ begins a variable in such texts
    escaped = str.maketrans({"\\": "\\\\", "'": "\\'", "$": "\\u0024"})
    said = (f"'{v.translate(escaped)}'" if isinstance(v, str) else str(v) for v in values)
    return F.expr(f"`{name}` IN ({', '.join(said)})")


def _is_int(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _names(name: str, value: object) -> list[str]:
    values = [value] if isinstance(value, str) else value
    if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
        raise InvalidFilter(f"filter field {name!r} expects a string or a list of strings")
    return values


def _year(value: object) -> Column:
    # an unknown year counts as 0 here
    year = F.coalesce(F.col("year"), F.lit(0))
    if _is_int(value):
        return year == value
    if not isinstance(value, dict) or not set(value) <= {"gte", "lte"} or not all(v is None or _is_int(v) for v in value.values()):
        raise InvalidFilter("filter field 'year' expects an integer or a range of integers 'gte' and 'lte'")
    bounds = [year >= v if k == "gte" else year <= v for k, v in value.items() if v is not None]
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def _added_after(value: object) -> Column:
    try:
        at = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except (AttributeError, ValueError) as e:
        raise InvalidFilter(f"filter field 'added_after' is not a valid ISO 8601 time: {value!r}") from e
    return F.col("added_ts") >= (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()


def compile_filter(asked: dict | None) -> Column:
    """The conjunction of a metadata filter; an empty list matches nothing, no filter everything."""
    parts = []
    for name, value in (asked or {}).items():
        if name in EXACT:
            parts.append(one_of(name, _names(name, value)))
        elif name in FOLDED:
            parts.append(one_of(f"{name}_norm", [v.lower() for v in _names(name, value)]))
        elif name == "year":
            parts.append(_year(value))
        elif name == "added_after":
            parts.append(_added_after(value))
        else:
            raise InvalidFilter(f"unknown filter field {name!r}; allowed fields: {', '.join(FIELDS)}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def pool_size(top_k: int) -> int:
    return min(5 * top_k, 200)


def nearest(points: DataFrame, query: list[float], k: int, id_col: str = "point_id", vector_col: str = "embedding", norm_col: str | None = None) -> DataFrame:
    """(id, embed_score): the k points of the highest cosine; ties by id, zero vectors never."""
    q = np.asarray(query, np.float64)
    size = float(np.sqrt(q @ q))
    length = F.col(norm_col) if norm_col else norm(F.col(vector_col))
    score = F.try_divide(dot(F.col(vector_col), F.array(*map(F.lit, map(float, q)))), length * size)
    return points.select(id_col, score.alias("embed_score")).where("embed_score IS NOT NULL").orderBy(F.desc("embed_score"), id_col).limit(k)


def coarse_scores(points: DataFrame, query: list[float], k: int, id_col: str, coarse_col: str, most: int, least: float | None = None, packed_col: str | None = None) -> DataFrame:
    """(id, score, error) by coarse vectors, of each task those rows that may be among its k nearest, ``most`` and one at most.

    A score by coarse vectors is off by the rounding of its numbers, whose standard
    deviation is step * |query| / sqrt(12); ``error`` is six times that.  With ``least`` and
    ``packed_col`` the rows whose score and error reach ``least`` are scored by their packed vectors instead,
    however many they are, and the k best of each batch are given.
    """
    q = np.asarray(query, np.float64)
    unit = (q / np.sqrt(q @ q)).astype(np.float32)
    wide = len(unit) + 4
    id_arrow = to_arrow_type(points.schema[id_col].dataType)

    def kept(scores: np.ndarray, errors: np.ndarray) -> np.ndarray:
        if len(scores) <= k:
            return np.arange(len(scores))
        some = np.flatnonzero(scores + errors >= np.partition(scores - errors, -k)[-k])
        if len(some) > most + 1:
            some = some[np.argpartition(-(scores + errors)[some], most)[: most + 1]]
        return some

    def scored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        column = batch.column(1)
        first = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
        rows = np.frombuffer(column.buffers()[2], np.uint8, len(batch) * wide, first).reshape(len(batch), wide)
        step = np.ascontiguousarray(rows[:, -4:]).view("<f4")[:, 0].astype(np.float64)
        return (rows[:, :-4].view(np.int8).astype(np.float32) @ unit).astype(np.float64) * step, 6 * step / math.sqrt(12) + 1e-6

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores, errors = [np.zeros(0, object)], np.zeros(0), np.zeros(0)
        for batch in batches:
            batch = batch.filter(pc.equal(pc.binary_length(batch.column(1)), wide))
            if not len(batch):
                continue
            s, e = scored(batch)
            if packed_col:
                some = np.flatnonzero(s + e >= least)
                exact = packed_scores(batch.column(2).take(pa.array(some)).to_pylist(), query) if len(some) else np.zeros(0)
                names = np.array(batch.column(0).take(pa.array(some)).to_pylist(), object)
                top = _top(exact, names, k)
                yield _rows(names[top], exact[top], np.zeros(len(top)))
                continue
            some = kept(s, e)
            ids.append(np.array(batch.column(0).take(pa.array(some)).to_pylist(), object))
            scores, errors = np.concatenate([scores, s[some]]), np.concatenate([errors, e[some]])
            if len(scores) > 4 * (most + 1):
                some, ids = kept(scores, errors), [np.concatenate(ids)]
                ids, scores, errors = [ids[0][some]], scores[some], errors[some]
        if len(scores):
            some = kept(scores, errors)
            yield _rows(np.concatenate(ids)[some], scores[some], errors[some])

    def _rows(ids: np.ndarray, scores: np.ndarray, errors: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids.tolist(), id_arrow), pa.array(scores), pa.array(errors)], names=["id", "score", "error"])

    columns = [F.col(id_col).alias("id"), F.col(coarse_col).alias("v"), *([F.col(packed_col).alias("p")] if packed_col else [])]
    return points.select(*columns).mapInArrow(each, f"id {points.schema[id_col].dataType.simpleString()}, score double, error double")


#: Points that come into question after the coarse step and are fetched to the driver at most; of more, only the k best are.
MOST_CANDIDATES = 2000


def coarse_candidates(points: DataFrame, query: list[float], k: int, id_col: str = "point_id", coarse_col: str = "coarse", most: int = MOST_CANDIDATES) -> tuple[list, float, bool]:
    """(ids of points that may be among the k nearest, the score they have at least, whether these are all).

    No more than ``most`` leave a task or come to the driver, those of the highest
    scores.  Where equal or nearly equal vectors are more than that, the flag says so.
    """
    found = coarse_scores(points, query, k, id_col, coarse_col, most)
    top = found.orderBy(F.desc(F.col("score") + F.col("error")), "id").limit(most + 1).toArrow()
    scores, errors = top.column("score").to_numpy(), top.column("error").to_numpy()
    if len(scores) <= k:
        return top.column("id").to_pylist(), -math.inf, True
    least = float(np.partition(scores - errors, -k)[-k])
    some = np.flatnonzero(scores + errors >= least)
    return top.column("id").take(pa.array(some)).to_pylist(), least, len(some) <= most


def packed_scores(vectors: list[bytes], query: list[float]) -> np.ndarray:
    """Cosines of packed vectors and a query."""
    q = np.asarray(query, np.float64)
    x = np.frombuffer(b"".join(vectors), "<f4").reshape(len(vectors), -1).astype(np.float64)
    return x @ (q / np.sqrt(q @ q))


def nearest_packed(points: DataFrame, query: list[float], k: int, id_col: str = "point_id", packed_col: str = "packed", coarse_col: str = "coarse", most: int = MOST_CANDIDATES) -> DataFrame:
    """(id, embed_score): like ``nearest``, in two steps.

    Coarse vectors, a quarter of the bytes, say which points come into question;
    only these are scored by their packed vectors.  Where they are too many to be named,
    as many equal vectors are, each batch of points is scored where it lies.  A point of the k is missed
    only if its rounding errors add up to over six standard deviations, about one in a billion.
    """
    if not np.any(query):
        return points.select(F.col(id_col), F.lit(0.0).alias("embed_score")).limit(0)
    wanted, least, all_named = coarse_candidates(points, query, k, id_col, coarse_col, most)
    if all_named:
        found = nearest_of(points, wanted, query, k, id_col, packed_col)
    else:
        found = nearest_reaching(points, least, query, k, id_col, packed_col, coarse_col)
    return found.withColumnRenamed("id", id_col)


def nearest_of(points: DataFrame, ids: list, query: list[float], k: int, id_col: str = "point_id", packed_col: str = "packed") -> DataFrame:
    """(id, embed_score): the k nearest of the points with these ids, by packed vectors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed_scores(batch.column(1).to_pylist(), query))], names=["id", "embed_score"])

    rows = points.where(one_of(id_col, ids)).select(F.col(id_col).alias("id"), F.col(packed_col).alias("v"))
    return rows.mapInArrow(each, f"id {points.schema[id_col].dataType.simpleString()}, embed_score double").orderBy(F.desc("embed_score"), "id").limit(k)


def nearest_reaching(points: DataFrame, least: float, query: list[float], k: int, id_col: str = "point_id", packed_col: str = "packed", coarse_col: str = "coarse") -> DataFrame:
    """(id, embed_score): the k nearest of the points whose coarse score may reach ``least``, however many."""
    found = coarse_scores(points, query, k, id_col, coarse_col, MOST_CANDIDATES, least, packed_col)
    return found.select("id", F.col("score").alias("embed_score")).orderBy(F.desc("embed_score"), "id").limit(k)


#: Cells that a search over cells looks into, unless said otherwise.
PROBES = 8


def centroids(points: DataFrame, n: int, vector_col: str = "embedding", sample: int = 20_000, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """n unit centres by spherical k-means on a bounded sample: the ``sample`` points of the least hashes."""
    rows = points.where(F.col(vector_col).isNotNull()).select(vector_col).orderBy(F.xxhash64(vector_col)).limit(sample).toArrow()
    x = np.array(rows.column(0).to_pylist(), np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


def cell_of(vectors: Column, centres: np.ndarray) -> Column:
    """The number of each vector's nearest centre; -1 for zero vectors and null."""

    def each(parts: pd.Series) -> pd.Series:
        out = np.full(len(parts), -1, np.int32)
        good = np.flatnonzero([v is not None and len(v) == centres.shape[1] for v in parts])
        if len(good):
            x = np.stack(parts.iloc[good].to_list()).astype(np.float64)
            out[good] = np.where(np.any(x, axis=1), (x @ centres.T).argmax(axis=1), -1)
        return pd.Series(out)

    return F.pandas_udf(each, "int")(vectors)


def nearest_in_cells(points: DataFrame, centres: np.ndarray, query: list[float], k: int, probes: int = PROBES, cell_col: str = "cell", **of) -> DataFrame:
    """``nearest`` over the cells of the ``probes`` centres nearest to the query.

    Where points are stored by cell (partitionBy), only those cells are read.
    With all cells it is exact; with fewer, recall is to be measured.
    """
    near = np.argsort(-(centres @ np.asarray(query, np.float64)), kind="stable")[:probes]
    return nearest(points.where(F.col(cell_col).isin([int(i) for i in near])), query, k, **of)


def nearest_batch(points: DataFrame, queries: np.ndarray, k: int, id_col: str = "point_id", vector_col: str = "embedding") -> DataFrame:
    """(query, id, embed_score, rank): the k nearest points of each row of ``queries``.

    Tasks score batches of points against a block of queries and keep k of
    each; the merge reads k rows a task and query.  Each block of queries is of
    bounded size and is a pass over the points.
    """
    size = max(1, MOST_QUERY_VALUES // max(1, queries.shape[1]))
    blocks = [_nearest_of_block(points, queries[i : i + size], i, k, id_col, vector_col) for i in range(0, max(1, len(queries)), size)]
    local = reduce(DataFrame.unionAll, blocks)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("embed_score"), "id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", id_col)


def _nearest_of_block(points: DataFrame, queries: np.ndarray, first: int, k: int, id_col: str, vector_col: str) -> DataFrame:
    """(query, id, embed_score): the k nearest points in each task of these queries, numbered from ``first``."""
    queries = queries.astype(np.float64)
    unit = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300)
    sent = points.sparkSession.sparkContext.broadcast(unit)
    id_type = points.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(q)
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), q.shape[1]))
            if not len(batch):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            size = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            turned = None if x.dtype == np.float32 and len(q) == 1 else x.T.astype(np.float64)
            some = max(1, MOST_SCORES // len(batch))
            for start in range(0, len(q), some):
                if turned is None:
                    scores = np.einsum("ij,j->i", x, q[0], dtype=np.float64)[None]
                else:
                    scores = q[start : start + some] @ turned
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = np.where(size > 0, scores / size, -np.inf)
                for i, s in enumerate(scores, start):
                    top = _top(s, ids, k)
                    mine = ids[top], s[top]
                    if held[i] is not None:
                        mine = tuple(np.concatenate(z) for z in zip(held[i], mine, strict=True))
                        top = _top(mine[1], mine[0], k)
                        mine = mine[0][top], mine[1][top]
                    held[i] = mine
        some = max(1, MOST_SCORES // (8 * k))
        for start in range(0, len(held), some):
            rows = [(np.full(len(h[0]), first + i, np.int32), *h) for i, h in enumerate(held[start : start + some], start) if h is not None]
            if rows:
                n, ids, s = (np.concatenate(z) for z in zip(*rows, strict=True))
                real = s > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(n[real]), pa.array(ids[real], id_arrow), pa.array(s[real])], names=["query", "id", "embed_score"])

    id_arrow = to_arrow_type(points.schema[id_col].dataType)
    return points.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(each, f"query int, id {id_type}, embed_score double")


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; equal ones by id."""
    if len(scores) <= k:
        return np.lexsort((ids, -scores))
    least = np.partition(scores, -k)[-k]
    some = np.flatnonzero(scores >= least)
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def rerank(candidates: DataFrame, top_k: int, min_score: float | None = None, rerank_col: str = "rerank_score", id_col: str = "point_id") -> DataFrame:
    """Candidates by re-rank score, equal ones in embedding order; the threshold holds before the cut."""
    kept = candidates if min_score is None else candidates.where(F.col(rerank_col) >= min_score)
    return kept.orderBy(F.desc(rerank_col), F.desc("embed_score"), id_col).limit(top_k)


def degraded(candidates: DataFrame, top_k: int, min_score: float | None = None, id_col: str = "point_id") -> DataFrame:
    """Candidates by embedding score alone, with a null re-rank score."""
    kept = candidates if min_score is None else candidates.where(F.col("embed_score") >= min_score)
    return kept.withColumn("rerank_score", F.lit(None).cast("double")).orderBy(F.desc("embed_score"), id_col).limit(top_k)


@dataclass
class Outcome:
    chunks: list[dict]
    timings: dict[str, float]
    warning: str | None = None


@dataclass
class Searcher:
    """Chunk search over a table of points with injected models.

    With ``cells`` a search looks into the ``probes`` cells nearest to its query (as
    many as were measured to be enough, unless said), twice as many if it has a
    filter, and into all others if these hold too few points.
    """

    points: DataFrame
    embed_query: Callable[[str], list[float]]
    score: Callable[[str, list[str]], list[float]]
    clock: Callable[[], float] = field(default=time.perf_counter)
    cells: Cells | None = None
    probes: int | None = None

    def _nearest(self, points: DataFrame, vector: list[float], size: int) -> list[tuple[str, float, dict]]:
        """(id, cosine, payload) of the nearest points."""
        if not np.any(vector):
            return []
        fetched = lambda ids, *less: {r.point_id: r.asDict() for r in points.where(one_of("point_id", ids)).drop("embedding", "norm", "coarse", *less).collect()} if ids else {}
        if "coarse" not in points.columns:
            found = [(r.point_id, r.embed_score) for r in nearest(points, vector, size, norm_col="norm" if "norm" in points.columns else None).collect()]
        else:
            wanted, least, all_named = coarse_candidates(points, vector, size)
            if all_named and len(wanted) <= 8 * size:
                # these few are scored from what is fetched anyway
                payload = fetched(wanted)
                scores = packed_scores([p.pop("packed") for p in payload.values()], vector).tolist() if payload else []
                return sorted(((i, s, payload[i]) for i, s in zip(payload, scores, strict=True)), key=lambda x: (-x[1], x[0]))[:size]
            if all_named:
                exact = nearest_of(points, wanted, vector, size)
            else:
                exact = nearest_reaching(points, least, vector, size)
            found = [(r["id"], r.embed_score) for r in exact.collect()]
        payload = fetched([i for i, _ in found], *(["packed"] if "packed" in points.columns else []))
        return [(i, s, payload[i]) for i, s in found]

    def _pool(self, vector: list[float], size: int, asked: dict | None) -> list[tuple[str, float, dict]]:
        kept = self.points.where(compile_filter(asked))
        if self.cells is None or len(self.cells.numbers) == 1:
            return self._nearest(kept, vector, size)
        order = self.cells.near(vector)
        n = (self.probes or self.cells.probes) * (2 if asked else 1)
        found = self._nearest(kept.where(F.col("cell").isin(order[:n])), vector, size)
        if len(found) < size and n < len(order):
            found = sorted(found + self._nearest(kept.where(F.col("cell").isin(order[n:])), vector, size), key=lambda x: (-x[1], x[0]))[:size]
        return found

    def search(self, query: str, top_k: int = 10, min_score: float | None = None, metadata_filter: dict | None = None) -> Outcome:
        if not query or not 1 <= top_k <= 50 or min_score is not None and not 0 <= min_score <= 1:
            raise ValueError("query must not be empty, top_k is 1 to 50, min_score 0 to 1")
        marks = [self.clock()]
        vector = self.embed_query(query)
        marks.append(self.clock())
        pool = self._pool(vector, pool_size(top_k), metadata_filter)
        millis = lambda a, b: round((b - a) * 1000, 3)
        marks.append(self.clock())
        timings = {"embed_ms": millis(*marks[:2]), "search_ms": millis(*marks[1:3]), "rerank_ms": 0.0}
        if not pool:
            return Outcome([], timings)
        rows = [{"content": p.get("content") or "", "metadata": {k: v for k, v in p.items() if k != "cell"}, "embed_score": score, "rerank_score": None} for _, score, p in pool]
        warning = None
        start = self.clock()
        try:
            scores = in_batches(lambda part: self.score(query, part), [r["content"] for r in rows], RERANK_BATCH)
            for row, s in zip(rows, scores, strict=True):
                row["rerank_score"] = float(s)
            by = "rerank_score"
        except Exception:  # search goes on without a re-ranker, and says so
            for row in rows:
                row["rerank_score"] = None
            warning, by = "reranker_unavailable", "embed_score"
        timings["rerank_ms"] = millis(start, self.clock())
        rows.sort(key=lambda r: -r[by])
        return Outcome([r for r in rows if min_score is None or r[by] >= min_score][:top_k], timings, warning)
