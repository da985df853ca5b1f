"""Toxicity: a convolutional text classifier in numpy.

Words [0-9a-z and non-ASCII], lower-cased, get the sum of hashed embeddings of the word and of its
first 4, 5 and 6 bytes (four tables, so that inflected forms share what their stems have, and one
collision is not enough to look like another word). Filters of widths 1, 2 and 3 run over the whole
text, the TOP maxima of each are pooled and a logistic layer scores the pools. One embedding dimension of each
table starts from the smoothed evidence of its buckets; embeddings, filters and layer are then
trained together by gradient descent through the positions of the maxima.

Fitted on all labelled documents (those with crc32 mod 4 = 2 held out). The driver fits a start on at most FIT_ROWS of them with FIT_BYTES
of bucket numbers, by hash order of ids. If there are more, the evidence is counted anew over all of them, and ROUNDS passes over all
go on from there: tasks train the model on blocks of as many rows and bytes, and each parameter moves by the mean of
what the blocks that moved it did. Thresholds are calibrated by language on the labelled documents that training did not see
(one in five), also all of them, within THRESHOLD_RANGE; a language with too few labels uses the threshold of all. The language picks
a threshold only and is never an input of a score.

Cases: null, empty and blank texts pool to zero and get the score of that; texts shorter than a filter pool it to zero;
without labelled rows, or with one class, scores are the smoothed share; a null or new
language uses the threshold of all; repeated rows score alike; extra columns are ignored, or pass untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import column, columns, cut, id_remainder, map_batches, names, scratch
from lodestone.llm.statistics import labelled_rows
from lodestone.llm.text import ALNUM, LOWER, Hasher, slices, spans

FIT_ROWS = 4_000
#: Of the sample in hash order, as many documents as have so many bytes of bucket numbers (16 a word) go to the driver.
FIT_BYTES = 64 << 20
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 6, (1, 2, 3)
#: Bytes of a word that each table hashes; None: all.
STEMS = (None, 4, 5, 6)
#: Responses of a filter that are pooled: a few different words tell more than one.
TOP = 3
EPOCHS, BATCH, STEP, PRIOR = 4, 64, 0.05, 10.0
#: Passes over all labelled rows where these are more than the start was fitted on.
ROUNDS = 2
THRESHOLD = 0.3
THRESHOLD_RANGE = (0.2, 0.5)
LANGUAGE_LABELS = 20
_U = np.uint64


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word, (words, STEMS), and where each row begins."""
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, ALNUM)
    hasher = Hasher(data)
    h = [hasher(starts, ends if n is None else np.minimum(ends, starts + n)) for n in STEMS]
    return np.column_stack([x & _U(BUCKETS - 1) for x in h]).astype(np.int32), first


def _embed(model: dict, buckets: np.ndarray) -> np.ndarray:
    return sum(model["table"][t][buckets[:, t]] for t in range(len(STEMS)))


def _pool(model: dict, emb: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TOP largest different responses of each filter by row, zero at least, and their word positions.

    Both (rows, widths, TOP, FILTERS).
    """
    rows = len(first) - 1
    pooled, at = np.zeros((rows, len(WIDTHS), TOP, FILTERS), np.float32), np.zeros((rows, len(WIDTHS), TOP, FILTERS), np.int64)
    for k, width in enumerate(WIDTHS):
        number = np.maximum(np.diff(first) - width + 1, 0)
        some = np.flatnonzero(number)
        if not len(some):
            continue
        # Windows inside rows only, row after row.
        begin = np.concatenate([[0], np.cumsum(number[some])])
        place = np.arange(begin[-1]) + np.repeat(first[:-1][some] - begin[:-1], number[some])
        out = sum(emb[place + j] @ model["filters"][k][j] for j in range(width)) + model["bias"][k]
        owner = np.repeat(np.arange(len(some)), number[some])
        for t in range(TOP):
            best = np.maximum.reduceat(out, begin[:-1], axis=0)
            if best.max() <= 0:
                break
            hit = out == best[owner]
            w, f = np.nonzero(hit & (out > 0))
            at[some[owner[w]], k, t, f] = place[w]
            pooled[some, k, t] = np.maximum(best, 0)
            out[hit] = 0
    return pooled.reshape(rows, -1), at.reshape(rows, -1)


def forward(model: dict, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scores by row."""
    emb = _embed(model, buckets)
    return 1 / (1 + np.exp(-(_pool(model, emb, first)[0].astype(float) @ model["dense"] + model["last"])))


def _odds(p):
    return np.log(p / (1 - p))


def _counted(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """(all, toxic) numbers of documents that have each bucket, by table."""
    out = np.zeros((2, len(STEMS), BUCKETS), np.int64)
    for d, label in zip(docs, y):
        for side in range(len(STEMS)):
            own = np.unique(d[:, side])
            out[0, side, own] += 1
            out[1, side, own] += int(label)
    return out


def _evidence(counts: np.ndarray, share: float) -> np.ndarray:
    return _odds((counts[1] + PRIOR * share) / (counts[0] + PRIOR)) - _odds(share)


def _begin(model: dict) -> None:
    """Filters that read the evidence, and the layer that sums them."""
    for f in model["filters"]:
        f[:, : len(STEMS), :] = np.abs(f[:, : len(STEMS), :]) + 1 / len(STEMS) / len(f)
    model["dense"][:] = 2 / (len(WIDTHS) * TOP * FILTERS)


def _pass(model: dict, docs: list[np.ndarray], y: np.ndarray, share: float, step: float, rng: np.random.Generator) -> None:
    """One pass of gradient descent over the documents, with weights that make the classes even."""
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    order = rng.permutation(len(docs))
    for lo in range(0, len(order), BATCH):
        own = order[lo : lo + BATCH]
        first = np.concatenate([[0], np.cumsum([len(docs[i]) for i in own])])
        b = np.concatenate([docs[i] for i in own])
        emb = _embed(model, b)
        pooled, at = _pool(model, emb, first)
        z = pooled.astype(float) @ model["dense"] + model["last"]
        error = (1 / (1 + np.exp(-z)) - y[own]) * weight[own] / len(own)
        back = (error[:, None] * model["dense"][None] * (pooled > 0)).astype(np.float32)
        model["dense"] -= 10 * step * (pooled.T.astype(float) @ error + 1e-4 * model["dense"])
        model["last"] -= 10 * step * float(error.sum())
        for k, width in enumerate(WIDTHS):
            cols = slice(k * TOP * FILTERS, (k + 1) * TOP * FILTERS)
            g = back[:, cols]
            for j in range(width):
                r, f = np.nonzero(g)
                p = at[:, cols][r, f] + j
                value = g[r, f]
                f = f % FILTERS
                kernel = model["filters"][k][j]
                to_words = value[:, None] * kernel[:, f].T
                np.add.at(kernel.T, f, -step * value[:, None] * emb[p])
                for side in range(len(STEMS)):
                    np.add.at(model["table"][side], b[p, side], -step * to_words)
            model["bias"][k] -= step * g.reshape(-1, FILTERS).sum(0)


def fit(docs: list[np.ndarray], y: np.ndarray, seed: int = 7) -> dict:
    """Trains on bucket arrays of whole documents; the arrays' order decides nothing but the batches."""
    rng = np.random.default_rng(seed)
    share = (y.sum() + 1) / (len(y) + 2)
    model = {"table": rng.normal(0, 0.01, (len(STEMS), BUCKETS, DIM)).astype(np.float32), "filters": [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], "bias": [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS], "dense": np.zeros(len(WIDTHS) * TOP * FILTERS), "last": float(_odds(share))}
    if len(np.unique(y)) < 2:
        return model
    evidence = _evidence(_counted(docs, y), share)
    for side in range(len(STEMS)):
        model["table"][side][:, side] = evidence[side]
    _begin(model)
    for epoch in range(EPOCHS):
        _pass(model, docs, y, share, STEP / (1 + epoch), rng)
    # The weights made classes even; undo that in the intercept so that scores are shares again.
    model["last"] += float(_odds(share))
    return model


def _flat(model: dict) -> np.ndarray:
    """All parameters as rows of DIM numbers: those of the tables, then the others."""
    rest = np.concatenate([x.ravel() for x in (*model["filters"], *model["bias"], model["dense"], np.array([model["last"]]))])
    return np.concatenate([model["table"].reshape(-1, DIM), np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])


def _shaped(flat: np.ndarray) -> dict:
    rest, at, parts = flat[len(STEMS) * BUCKETS :].ravel(), 0, []
    shapes = [*[(w, DIM, FILTERS) for w in WIDTHS], *[(FILTERS,) for _ in WIDTHS], (len(WIDTHS) * TOP * FILTERS,)]
    for shape in shapes:
        parts.append(rest[at : at + int(np.prod(shape))].reshape(shape))
        at += parts[-1].size
    n = len(WIDTHS)
    return {"table": flat[: len(STEMS) * BUCKETS].astype(np.float32).reshape(len(STEMS), BUCKETS, DIM), "filters": [x.astype(np.float32) for x in parts[:n]], "bias": [x.astype(np.float32) for x in parts[n : 2 * n]], "dense": parts[-1].astype(float), "last": float(rest[at])}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Bucket arrays and labels of up to FIT_ROWS rows (text, y) of FIT_BYTES; a larger document comes alone."""
    docs, y, held = [], [], 0
    for batch in batches:
        label = batch.column("y").to_numpy()
        for row, data, offsets in slices(batch.column("text")):
            b, first = tokens(data, offsets)
            for k, (i, j) in enumerate(zip(first, first[1:])):
                if docs and (len(docs) == FIT_ROWS or held + b[i:j].nbytes > FIT_BYTES):
                    yield docs, np.array(y, float)
                    docs, y, held = [], [], 0
                docs.append(b[i:j].copy())
                y.append(label[row + k])
                held += docs[-1].nbytes
    if docs:
        yield docs, np.array(y, float)


def fit_all(rows: DataFrame, model: dict, start: tuple[list[np.ndarray], np.ndarray], seed: int = 7) -> dict:
    """The model, fitted on start, fitted on all rows (text, y). Blocks of rows are trained in tasks; what comes to the driver is one model."""
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if toxic in (0, n):
        return fit([], np.zeros(0), seed) | {"last": float(_odds((toxic + 1) / (n + 2)))}
    share, (docs, y) = (toxic + 1) / (n + 2), start

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, y in _blocks(batches):
            c = _counted(docs, y).reshape(2, -1)
            at = np.flatnonzero(c[0])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c[0][at]), pa.array(c[1][at])], ["i", "n", "t"])

    got = rows.mapInArrow(count, "i int, n long, t long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    counts = np.zeros((2, len(STEMS) * BUCKETS), np.int64)
    counts[:, got["i"].to_numpy()] = got["n"].to_numpy(), got["t"].to_numpy()
    evidence = _evidence(counts.reshape(2, len(STEMS), BUCKETS), share)
    if len(np.unique(y)) == 2:
        own = (y.sum() + 1) / (len(y) + 2)
        evidence = evidence - _evidence(_counted(docs, y), own)
        model["last"] -= float(_odds(own))
    else:
        _begin(model)
        model["last"] = float(_odds(share))
    for side in range(len(STEMS)):
        model["table"][side][:, side] += evidence[side]
    for number in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def train_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before = _flat(shared.value)
            for docs, y in _blocks(batches):
                own = _shaped(before.copy())
                _pass(own, docs, y, share, STEP / (2 + number), np.random.default_rng((seed, number)))
                moved = _flat(own) - before
                at = np.flatnonzero(moved.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(moved[at, d].astype(float)) for d in range(DIM)]], ["i", *[f"d{d}" for d in range(DIM)]])

        moves = rows.mapInArrow(train_blocks, "i int, " + ", ".join(f"d{d} double" for d in range(DIM)))
        # Sums in any order differ in the last bits only; they are rounded away.
        got = moves.groupBy("i").agg(*[F.round(F.avg(f"d{d}"), 9).cast("float").alias(f"d{d}") for d in range(DIM)]).toArrow()
        flat = _flat(model)
        flat[got["i"].to_numpy()] += np.column_stack([got[f"d{d}"].to_numpy() for d in range(DIM)])
        model = _shaped(flat)
        shared.unpersist()
    model["last"] += float(_odds(share))
    return model


def thresholds(scores: np.ndarray, y: np.ndarray, lang: np.ndarray) -> dict:
    """The threshold of best F1 for each language with enough labels of both kinds, and for all (None)."""

    def best(s: np.ndarray, t: np.ndarray) -> float:
        grid = np.linspace(*THRESHOLD_RANGE, 31)
        f1 = np.array([2 * (t & (s >= g)).sum() / max(1, t.sum() + (s >= g).sum()) for g in grid])
        top = grid[f1 == f1.max()]
        return float(top[np.abs(top - THRESHOLD).argmin()])

    toxic = y > 0
    enough = lambda m: toxic[m].sum() >= LANGUAGE_LABELS and (~toxic)[m].sum() >= LANGUAGE_LABELS
    everything = np.ones(len(y), bool)
    out = {None: best(scores, toxic) if enough(everything) else THRESHOLD}
    for name in sorted({x for x in lang if isinstance(x, str)}):
        if enough(lang == name):
            out[name] = best(scores[lang == name], toxic[lang == name])
    return out


def thresholds_all(rows: DataFrame, model: dict) -> dict:
    """thresholds of all rows (text, lang, y): they are scored in tasks, and counted by language, label and place on the grid."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    grid = np.linspace(*THRESHOLD_RANGE, 31)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [forward(shared.value, *tokens(data, offsets)) for _, data, offsets in slices(batch.column("text"), 1 << 19)]
            place = np.searchsorted(grid, np.concatenate([*parts, np.zeros(0)]), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("y"), pa.array(place)], ["lang", "y", "place"])

    got = rows.select("text", F.col("lang").cast("string").alias("lang"), "y").mapInArrow(run, "lang string, y int, place int").groupBy("lang", "y", "place").count().toPandas()

    def best(x) -> float | None:
        of = lambda label: np.bincount(x["place"][(x["y"] > 0) == label], x["count"][(x["y"] > 0) == label], len(grid) + 1)
        toxic, clean = of(True), of(False)
        if min(toxic.sum(), clean.sum()) < LANGUAGE_LABELS:
            return None
        # Scores at place p reach the first p thresholds.
        hit, wrong = (c[::-1].cumsum()[::-1][1:] for c in (toxic, clean))
        f1 = 2 * hit / np.maximum(1, toxic.sum() + hit + wrong)
        top = grid[f1 == f1.max()]
        return float(top[np.abs(top - THRESHOLD).argmin()])

    out = {None: THRESHOLD if (t := best(got)) is None else t}
    return out | {name: t for name, x in got.groupby("lang") if (t := best(x)) is not None}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> tuple[dict, dict]:
    """(model, thresholds by language) of all labelled documents. One in five calibrates only. rows: of how many the start is fitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, data, offsets in slices(batch.column("text")):
                b, first = tokens(data, offsets)
                out += [b[i:j].tobytes() for i, j in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], ["doc_id", "lang", "y", "b"])

    every = labelled_rows(docs, labels, label).groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang", "y")).alias("s"))
    every = every.select("doc_id", "s.text", "s.lang", "s.y", F.xxhash64("doc_id").alias("place"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 4).alias("aside"))
    with scratch(docs.sparkSession):
        every = cut(every, "labelled")
        n = every.count()
        # The start: places of at most rows documents, and of these as many as fit by the bytes of their bucket numbers.
        ids = every.select("place", "doc_id").orderBy("place", "doc_id").limit(rows).select("doc_id")
        few = every.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang", "y", "text")
        kind = dict(every.dtypes)["doc_id"]
        few = cut(few.mapInArrow(run, f"doc_id {kind}, lang string, y int, b binary"), "start")
        sizes = few.select(F.octet_length("b").alias("n"), F.xxhash64("doc_id").alias("place")).orderBy("place").toArrow()
        within = np.cumsum(sizes["n"].to_numpy()) <= FIT_BYTES
        whole = n == len(within) and within.all()
        if not within.all():
            few = few.where(F.xxhash64("doc_id") < F.lit(int(sizes["place"][int(np.argmin(within))].as_py())))
        got = few.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 4).toArrow()
        order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
        arrays = [np.frombuffer(got["b"][i].as_buffer(), np.int32).reshape(-1, len(STEMS)) for i in order.tolist()]
        y, lang, aside = got["y"].to_numpy()[order].astype(float), np.array(got["lang"].to_pylist(), object)[order], got["aside"].to_numpy()[order]
        # Where the start is all there is, every fifth one of its ids in order.
        aside = np.arange(len(y)) % 5 == 4 if whole else aside
        start = [a for a, x in zip(arrays, aside) if not x], y[~aside]
        model = fit(*start)
        if not whole:
            model = fit_all(every.where("not aside").select("text", "y"), model, start)
            return model, thresholds_all(every.where("aside"), model)
    held = [a for a, x in zip(arrays, aside) if x]
    scores = np.array([forward(model, a, np.array([0, len(a)]))[0] for a in held])
    return model, thresholds(scores, y[aside], lang[aside])


def score(docs: DataFrame, model: dict, limits: dict, keep: tuple = ("doc_id",), score_name: str = "_score", rejected_name: str = "_rejected") -> DataFrame:
    """keep, score and rejected (score reaches the threshold of the document's language) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((model, limits))
    text, lang = names(keep, "text_of", "lang_of")
    of_lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    # The two that are read come last; a text that is kept isn't copied.
    texts = [] if "text" in keep else [F.col("text").alias(text)]
    rows = docs.select(*map(column, keep), *texts, of_lang.alias(lang))
    width, text_at, lang_at = len(keep), list(keep).index("text") if "text" in keep else len(keep), len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        model, limits = shared.value
        for batch in batches:
            parts = [forward(model, *tokens(data, offsets)) for _, data, offsets in slices(batch.column(text_at), 1 << 19)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            least = np.array([limits.get(x, limits[None]) for x in batch.column(lang_at).to_pylist()])
            yield [*batch.columns[:width], pa.array(s, pa.float64()), pa.array(s >= least, pa.bool_())]

    return map_batches(rows, run, [*rows.schema.fields[:width], T.StructField(score_name, T.DoubleType()), T.StructField(rejected_name, T.BooleanType())])


def judge(scored: DataFrame) -> DataFrame:
    """The columns of the query: doc_id, held_out, score, predicted, rejected."""
    return scored.select("doc_id", (id_remainder(F.col("doc_id")) == 2).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_rejected").alias("rejected"))


def without_toxic(docs: DataFrame, model: dict, limits: dict) -> DataFrame:
    """The documents that aren't rejected, all columns as they were."""
    s, r = names(docs.columns, "score", "rejected")
    return score(docs, model, limits, tuple(docs.columns), s, r).where(~column(r)).select(*columns(docs))
