"""Retrieval over tables of queries and chunks.

Chunks and queries are packed in tiles of TILE rows inside their partitions and meet by a join on a salt:
one scan of the chunks whatever the number of queries, which never pass through the driver. Query tiles
whose size was found to be small are broadcast, and the chunks aren't shuffled; larger ones are copied to
every salt. Each task keeps the best k per query of its own chunks, so what is shuffled after that is k
rows per query and task, whatever the corpus holds. Permissions are part of the kernels, below every top-k.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vocabulary import RERANK_K, RERANK_THRESHOLD, RRF_K, TOP_K, TRIGRAM_THRESHOLD
from lodestone.operators.access import tag_mask

TILE = 512
#: Query tiles of at most so many bytes are broadcast; query tiles whose best rows a task holds at a time.
BROADCAST_BYTES, HELD = 8 << 20, 64
#: Trigrams that are compared at a time; items of a tile; characters whose trigrams are made at a time.
WIDTH, ITEMS, BLOCK = 1024, 1 << 19, 1 << 17
#: Bytes of texts (components of vectors) that are encoded for tiles at a time.
SLICE = 1 << 21
_WORD = re.compile(r"[^\W_]+")
_PAIRS = "query_id long, chunk_id long, score double"
_TILE = "tile long, ids array<long>, mask array<long>, level array<int>, sizes array<int>, data array<{0}>, low int, high int"
_LISTS = 5


def _tiles(rows: DataFrame, encode: Callable[[pa.Array], tuple[list[int], np.ndarray]], kind: str) -> DataFrame:
    """rows (id, mask, level, value) as tiles; encode gives the number of items of each value and all items.

    A batch's rows are encoded SLICE bytes at a time, the shortest first. Each time that there are items for two tiles, rows are
    ordered by their numbers of items, so a tile's values are of like size (low to high items), and cut at TILE rows or
    ITEMS items; a value of more is a tile of its own. So what Python holds besides its Arrow batch doesn't grow with that.
    """

    def packed(keys: list[np.ndarray], sizes: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, ends = np.argsort(sizes, kind="stable"), np.cumsum(sizes, dtype=np.int64)
        n, columns = sizes[order], [x[order] for x in keys]
        before, at = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]), 0
        while at < len(n):
            end = min(at + TILE, max(at + 1, int(np.searchsorted(before, before[at] + ITEMS, "right")) - 1))
            own = n[at:end]
            items = data[np.repeat((ends - sizes)[order[at:end]] - (before[at:end] - before[at]), own) + np.arange(before[end] - before[at])]
            ids, mask, level = (c[at:end] for c in columns)
            name = int.from_bytes(blake2b(ids.tobytes(), digest_size=8).digest(), "little", signed=True)
            lists = [pa.array([x], pa.list_(t)) for x, t in ((ids, pa.int64()), (mask, pa.int64()), (level, pa.int32()), (own, pa.int32()), (items, pa.from_numpy_dtype(items.dtype)))]
            yield pa.RecordBatch.from_arrays([pa.array([name]), *lists, pa.array([own[0]], pa.int32()), pa.array([own[-1]], pa.int32())], ["tile", "ids", "mask", "level", "sizes", "data", "low", "high"])
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, keys = batch.column(3), [batch.column(i).to_numpy() for i in range(3)]
            length = (pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)).to_numpy(zero_copy_only=False)
            by = np.argsort(length, kind="stable")
            total, held, begin, at = np.cumsum(length[by], dtype=np.int64), [], 0, 0
            while at < len(by):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, "right")))
                held.append(encode(values.take(pa.array(by[at:end]))))
                if end == len(by) or sum(len(data) for _, data in held) >= 2 * ITEMS:
                    yield from packed([x[by[begin:end]] for x in keys], np.concatenate([n for n, _ in held]), np.concatenate([data for _, data in held]))
                    held, begin = [], end
                at = end

    return rows.mapInArrow(run, _TILE.format(kind))


def _met(queries: DataFrame, chunks: DataFrame, encode: Callable, kind: str, size: Column, best: Callable, k: int | None, ratio: float = 0.0) -> DataFrame:
    """Pairs (query_id, chunk_id, score) of best(query tile, chunk tile), the k of lowest score of each query and task if k is given.

    queries and chunks: id, mask, level, value; size: the bytes of a query's value. Tiles of which no two values
    have numbers of items within that ratio of each other don't meet.
    """
    held = queries.agg(F.coalesce(F.sum(size + 24), F.lit(0))).first()[0]
    asked, tiles = _tiles(queries, encode, kind), _tiles(chunks, encode, kind)
    right = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    salts = 1 if held <= BROADCAST_BYTES else 4 * chunks.sparkSession.sparkContext.defaultParallelism
    left = tiles.withColumn("salt", F.pmod("tile", F.lit(salts)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    fits = (F.col("high") + 1e-6 >= F.col("q_low") * ratio) & (F.col("q_high") + 1e-6 >= F.col("low") * ratio)
    pairs = left.join(F.broadcast(right) if salts == 1 else right, "salt").where(fits).select(*tiles.columns, *right.columns[:-1])

    def unpack(batch: pa.RecordBatch, row: int, first: int) -> tuple:
        return tuple(batch.column(first + i)[row].values.to_numpy(zero_copy_only=False) for i in range(1, 1 + _LISTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}

        def settled(name: int) -> pa.RecordBatch:
            ids, score, chunk = kept.pop(name)
            q, c = np.nonzero(np.isfinite(score))
            return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(chunk[q, c]), pa.array(score[q, c])], ["query_id", "chunk_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                mine, theirs, name = unpack(batch, row, 0), unpack(batch, row, _LISTS + 3), batch.column(_LISTS + 3)[row].as_py()
                score = best(theirs, mine)
                score[((theirs[1][:, None] & mine[1][None]) == 0) | (mine[2][None] > theirs[2][:, None])] = np.inf
                if k is None:
                    q, c = np.nonzero(np.isfinite(score))
                    yield pa.RecordBatch.from_arrays([pa.array(theirs[0][q]), pa.array(mine[0][c]), pa.array(score[q, c])], ["query_id", "chunk_id", "score"])
                    continue
                chunk = np.broadcast_to(mine[0], score.shape)
                if name in kept:
                    score, chunk = np.concatenate([kept[name][1], score], axis=1), np.concatenate([kept[name][2], chunk], axis=1)
                elif len(kept) == HELD:
                    yield settled(next(iter(kept)))
                order = np.lexsort((chunk, score), axis=1)[:, :k]
                kept[name] = [theirs[0], np.take_along_axis(score, order, 1), np.take_along_axis(chunk, order, 1)]
        for name in list(kept):
            yield settled(name)

    return pairs.mapInArrow(run, _PAIRS)


def principals(queries: DataFrame, users: DataFrame) -> DataFrame:
    """Queries with the mask and clearance of their users; without tags or user nothing is permitted."""
    u = users.select("user_id", tag_mask(F.col("permission_tags")).alias("mask"), "clearance_level")
    return queries.join(u, "user_id").where("mask <> 0")


def _guarded(chunks: DataFrame, column: str) -> DataFrame:
    return chunks.select("chunk_id", tag_mask(F.col("acl_tags")).alias("mask"), F.col("sensitivity_ordinal").cast("int").alias("ordinal"), F.col(column)).where(f"mask <> 0 and {column} is not null")


def _asked(queries: DataFrame, column: str) -> DataFrame:
    return queries.select("query_id", "mask", F.col("clearance_level").cast("int").alias("level"), F.col(column)).where(F.col(column).isNotNull())


def _unit_vectors(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int32)
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(n)), n)
    return n, x / np.maximum(np.sqrt(np.bincount(row, x * x, len(n))), 1e-300)[row]


def _of_length(side: tuple, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of a tile's vectors of n components."""
    rows = np.flatnonzero(side[3] == n)
    return rows, side[4][np.repeat(side[3] == n, side[3])].reshape(len(rows), n)


def _distances(query: tuple, chunk: tuple) -> np.ndarray:
    """Cosine distances; infinite, as if not permitted, between vectors of different lengths."""
    out = np.full((len(query[0]), len(chunk[0])), np.inf)
    for n in np.unique(query[3]).tolist():
        (i, a), (j, b) = _of_length(query, n), _of_length(chunk, n)
        out[np.ix_(i, j)] = np.round(1 - a @ b.T, 9)
    return out


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, chunk_id, dist, rank of the k nearest permitted chunks. queries: query_id, query_vector, mask, clearance_level.

    A chunk whose vector has another length than the query's is never near it (embedding_qc reports such vectors).
    """
    pairs = _met(_asked(queries, "query_vector"), _guarded(chunks, "dense_embedding"), _unit_vectors, "double", 8 * F.size("query_vector"), _distances, k)
    return _ranked(pairs, k, F.col("score").asc()).withColumnRenamed("score", "dist")


def _ranked(pairs: DataFrame, k: int, order) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(order, "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def trigrams(text: str) -> set[str]:
    """Set of trigrams of the lower-cased words, each padded by two blanks before and one behind."""
    out: set[str] = set()
    for w in set(_WORD.findall(text.lower())):
        w = f"  {w} "
        out.update([w[i : i + 3] for i in range(len(w) - 2)])
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array(list(map(len, texts)), np.int64)
    text = np.frombuffer("".join(f"\0{t}" for t in ["\0", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    # Letters are numbered from 1 in the order of their code points, 0 is all that parts words.
    seen = np.zeros(int(text.max()) + 1, np.int64)
    seen[text] = 1
    points = np.array([p for p in np.flatnonzero(seen).tolist() if _WORD.match(chr(p))], np.int64)
    seen[:] = 0
    seen[points] = np.arange(1, len(points) + 1)
    letter, points = seen[text], np.concatenate([[32], points])
    row = np.repeat(np.arange(-1, len(texts) + 1), np.concatenate([[2], n + 1, [1]]))
    base = len(points)
    if len(texts) > 1 and (len(texts) + 1) * base**3 >= 1 << 63:
        parts = [_codes(texts[: len(texts) // 2]), _codes(texts[len(texts) // 2 :])]
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    # The trigram that ends at each letter, and the one that ends behind each word.
    one, two = letter[1:-2], letter[2:-1]
    zero = np.where(one > 0, letter[:-3], 0)
    inside, last = two > 0, (two > 0) & (letter[3:] == 0)
    # A key is a row and a trigram, so sorting leaves each row's trigrams once.
    keys = np.concatenate([((row[2:-1] * base + zero) * base + one)[inside] * base + two[inside], ((row[2:-1] * base + one) * base + two)[last] * base])
    keys = np.sort(keys)
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    rest, third = np.divmod(keys, base)
    rest, second = np.divmod(rest, base)
    at, first = np.divmod(rest, base)
    return np.bincount(at, minlength=len(texts)).astype(np.int32), points[first] << 42 | points[second] << 21 | points[third]


def _trigram_codes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of each text (see trigrams) as numbers, three code points of 21 bits; BLOCK characters at a time, longer texts alone."""
    texts = [t.lower() for t in values.to_pylist()]
    done = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > BLOCK:
            done.append(_codes(texts[start:i]))
            start, held = i, 0
        held += len(t) + 1
    done.append(_codes(texts[start:]))
    return np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])


def _overlap(query: tuple, chunk: tuple, threshold: float = 0.0, counts: list | None = None) -> np.ndarray:
    """1 - similarity of each pair: shared trigrams over all of both; infinite if the similarity is under the threshold.

    Trigrams are compared WIDTH at a time, those of the fewest chunks first. Before each step a pair is given
    up if what is left of the smaller side can't bring it to the overlap that the threshold needs of sets
    of their sizes (first of all: sizes too far apart, or too few trigrams that the other tile has at all). Texts
    without a pair left leave the step, so pairs of few rare trigrams in common cost one step. counts
    gets the pairs of the tiles, those of fitting sizes, and those that were compared in each step.
    """
    n, m = len(query[0]), len(chunk[0])
    codes, at = np.unique(query[4], return_inverse=True)
    place = np.searchsorted(codes, chunk[4])
    hit = place < len(codes)
    hit[hit] = codes[place[hit]] == chunk[4][hit]
    own, place = np.repeat(np.arange(m), chunk[3])[hit], place[hit]
    shared = np.bincount(place, minlength=len(codes))
    # Trigrams that no chunk of the tile has are left out; the others are numbered by the chunks that have them.
    order = np.lexsort((codes, shared))
    order = order[np.searchsorted(shared[order], 1) :]
    number = np.full(len(codes), -1)
    number[order] = np.arange(len(order))
    asked = number[at] >= 0
    rows, at, place = np.repeat(np.arange(n), query[3])[asked], number[at][asked], number[place]
    by_q, by_c = np.argsort(at, kind="stable"), np.argsort(place, kind="stable")
    rows, at, own, place = rows[by_q], at[by_q], own[by_c], place[by_c]
    left_q, left_c = np.bincount(rows, minlength=n), np.bincount(own, minlength=m)
    total = query[3][:, None].astype(np.int64) + chunk[3][None]
    # Sets of a and b members are similar from a threshold t on if they share t (a + b) / (1 + t) or more.
    need = np.ceil(threshold / (1 + threshold) * total - 1e-6)
    common, alive, steps = np.zeros((n, m), np.float32), np.ones((n, m), bool), []
    for low in range(0, max(len(order), 1), WIDTH):
        alive &= common + np.minimum(left_q[:, None], left_c[None]) >= need
        q, c = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        steps.append(len(q) * len(c))
        if not steps[-1]:
            break
        x, y = slice(*np.searchsorted(at, (low, low + WIDTH))), slice(*np.searchsorted(place, (low, low + WIDTH)))
        new_q, new_c = np.full(n, -1), np.full(m, -1)
        new_q[q], new_c[c] = np.arange(len(q)), np.arange(len(c))
        # Incidence of WIDTH trigrams; sums of ones are exact.
        a, b = np.zeros((len(q), WIDTH), np.float32), np.zeros((len(c), WIDTH), np.float32)
        i, j = new_q[rows[x]], new_c[own[y]]
        a[i[i >= 0], at[x][i >= 0] - low] = b[j[j >= 0], place[y][j >= 0] - low] = 1
        common[np.ix_(q, c)] += a @ b.T
        left_q, left_c = left_q - np.bincount(rows[x], minlength=n), left_c - np.bincount(own[y], minlength=m)
    if counts is not None:
        counts.append((n * m, int((np.minimum(query[3][:, None], chunk[3][None]) >= need).sum()), steps))
    far = 1 - common.astype(np.float64) / np.maximum(total - common, 1)
    return np.where(alive & (1 - far >= threshold - 1e-12), far, np.inf)


def trigram_similarity(queries: DataFrame, chunks: DataFrame, threshold: float = TRIGRAM_THRESHOLD, k: int | None = None) -> DataFrame:
    """query_id, chunk_id, score of permitted pairs at the threshold or above; with k the best k of each task only.

    A similarity is at most the ratio of the numbers of trigrams, so tiles of other sizes don't meet; see _overlap for the pairs of tiles that do.
    """

    def similar(query: tuple, chunk: tuple) -> np.ndarray:
        # Rounded before the order counts, so that equal similarities are ties.
        return np.round(_overlap(query, chunk, threshold), 9)

    pairs = _met(_asked(queries, "query_text"), _guarded(chunks, "content"), _trigram_codes, "long", 8 * F.length("query_text"), similar, k, threshold)
    return pairs.withColumn("score", F.round(1 - F.col("score"), 9))


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """query_id, chunk_id, score, rank of the k most similar permitted chunks."""
    return _ranked(trigram_similarity(queries, chunks, threshold, k), k, F.col("score").desc())


def rrf_fusion(vector: DataFrame, keyword: DataFrame, k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, rrf_score, vector_rank, keyword_rank: full outer join; a missing rank counts as k + 1."""
    v, w = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank")), keyword.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"))
    part = lambda c: 1.0 / (rrf_k + F.coalesce(c, F.lit(k + 1)))
    fused = v.join(w, ["query_id", "chunk_id"], "full").withColumn("rrf_score", F.round(part(F.col("vector_rank")) + part(F.col("keyword_rank")), 9))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_only(vector: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """The vector leg scored alone, for queries too short for the keyword leg."""
    return vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), F.lit(None).cast("int").alias("keyword_rank"), F.round(1.0 / (rrf_k + F.col("rank")), 9).alias("rrf_score"), "rank")


_TOKENS = "[a-z0-9\\x{80}-\\x{10FFFF}]+"
#: Tokens are broadcast up to this number.
BROADCAST_TOKENS = 10_000


def _tokens(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TOKENS), 0))


def token_match(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id) where the chunk has every lower-cased token of the query; queries without a token match nothing.

    Each query is looked up by its token of the fewest chunks only; the chunks found are then held
    against all its tokens. Counts of tokens are summed before they are shuffled, and ids alone are looked up.
    """
    asked = queries.select("query_id", _tokens("query_text").alias("tokens")).where("size(tokens) > 0")
    wanted = asked.select(F.explode("tokens").alias("token")).distinct()
    held = chunks.select("chunk_id", _tokens("content").alias("has"))
    counts = held.select(F.explode("has").alias("token")).groupBy("token").agg(F.count("*").alias("n")).join(wanted, "token")
    # A token that no chunk has is the rarest: such a query finds nothing.
    by_token = asked.select("query_id", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = by_token.groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r")).where("r.n > 0").select("query_id", F.col("r.token").alias("token"))
    few = rarest.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    found = held.select("chunk_id", F.explode("has").alias("token")).join(F.broadcast(rarest) if few else rarest, "token").select("query_id", "chunk_id")
    return found.join(asked, "query_id").join(held, "chunk_id").where(F.size(F.array_except("tokens", "has")) == 0).select("query_id", "chunk_id")


def passthrough(batches: Iterator[tuple]) -> Iterator[np.ndarray]:
    """Keeps the order: every score is 1."""
    for queries, _ in batches:
        yield np.ones(len(queries))


def trigram_scorer(batches: Iterator[tuple]) -> Iterator[np.ndarray]:
    """Shared trigrams over all trigrams of both texts."""
    for queries, contents in batches:
        pairs = [(trigrams(a or ""), trigrams(b or "")) for a, b in zip(queries, contents, strict=True)]
        yield np.array([len(a & b) / len(a | b) if a or b else 0.0 for a, b in pairs])


def rerank(retrieved: DataFrame, scorer: Callable[[Iterator[tuple]], Iterator[np.ndarray]] = passthrough) -> DataFrame:
    """retrieved with rerank_score of scorer: a function from batches (query texts, contents) to their scores.

    It is called once for each task, so a model is loaded once before its first batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: list[pa.RecordBatch] = []

        def texts() -> Iterator[tuple]:
            for batch in batches:
                given.append(batch)
                yield batch.column("query_text").to_pylist(), batch.column("content").to_pylist()

        for scores in scorer(texts()):
            batch = given.pop(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "rerank_score"])

    return retrieved.mapInArrow(run, retrieved.withColumn("rerank_score", F.lit(0.0)).schema)


def ranked_topk(reranked: DataFrame, k: int = RERANK_K) -> DataFrame:
    """The k best of each query by rerank score, then prior rank; final_rank 1..k."""
    w = Window.partitionBy("query_id").orderBy(F.round("rerank_score", 9).desc(), "rank")
    return reranked.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= k)


def ranked_by_index(retrieved: DataFrame, results: DataFrame, k: int = RERANK_K) -> DataFrame:
    """The k best of a reranker's results of each query joined to the rows they point to; final_rank 1..k is the place among the results.

    retrieved: query_id, rank from 1; results: query_id, index (rank - 1), rerank_score, equal scores in the order of index. A result whose index
    is out of range is left out and keeps its rank, so ranks may have gaps.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "index")
    best = results.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= k)
    return retrieved.join(best.select("query_id", (F.col("index") + 1).alias("rank"), "rerank_score", "final_rank"), ["query_id", "rank"])


def relevance_gate(queries: DataFrame, ranked: DataFrame, threshold: float = RERANK_THRESHOLD) -> DataFrame:
    """query_id, best, finish_reason: no_relevant_content without a candidate or below the threshold."""
    best = ranked.groupBy("query_id").agg(F.max("rerank_score").alias("best"))
    reason = F.when(F.coalesce(F.col("best") < threshold, F.lit(True)), "no_relevant_content").otherwise("answer")
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", "best", reason.alias("finish_reason"))


def score_bands(scored: DataFrame, column: str = "score") -> DataFrame:
    """Counts of high (over 0.6), mid (over 0.35) and low scores."""
    band = F.when(F.col(column) > 0.6, "high").when(F.col(column) > 0.35, "mid").otherwise("low")
    return scored.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
