"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed to embeddings; filters of several widths slide over them, each document keeps every filter's maximum,
and a logistic layer scores these. Scores are calibrated on all labelled rows that were not trained on, weighted so that
they stand for all labelled rows, and so is a threshold for each language. A language, source, id or label is never an input of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm import hashing
from tidebar.llm.store import written

#: Buckets of whole words and, after them, of beginnings of words (their first bytes); the embedding of a word is the sum.
WORDS, STEMS, STEM_BYTES = 1 << 15, 1 << 14, 5
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
PADS = max(WIDTHS) - 1
#: The bounded sample that the classifier is fitted on: documents of each class at most, and bytes of a document.
SAMPLE, SAMPLE_BYTES = (2_500, 3_500), 24_000
EPOCHS, STEPS, BATCH, RATE = 6, 1_000, 32, 0.1
THRESHOLD = 0.3
#: One labelled row in so many is never trained on; logits are counted in bins of this width, up to the greatest.
KEEP_OUT, BIN, FAR = 5, 1 / 32, 40.0
#: A language gets its own threshold from so many labelled rows of each class, and within this range.
ENOUGH, RANGE = 20, (0.2, 0.7)


def token_ids(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its beginning (two columns), every row followed by padding (bucket 0; a row without words has one more), and each row's start."""
    h, n, stem = hashing.words(raw, bounds, marks=True, prefix=STEM_BYTES)
    starts = np.concatenate([[0], np.cumsum(np.maximum(n, 1) + PADS)])
    ids = np.zeros((int(starts[-1]), 2), dtype=np.int32)
    at = hashing.ranges(starts[:-1], n)
    ids[at, 0] = (h % np.uint64(WORDS - 1)).astype(np.int32) + 1
    ids[at, 1] = (stem % np.uint64(STEMS)).astype(np.int32) + WORDS
    return ids, starts


def _inside(starts: np.ndarray) -> np.ndarray:
    """Where windows may begin: at words, not at padding."""
    ok = np.ones(int(starts[-1]), dtype=bool)
    for k in range(1, PADS + 1):
        ok[starts[1:] - k] = False
    return ok


@dataclass
class Model:
    embed: np.ndarray
    filters: dict[int, np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def tables(self) -> list[list[np.ndarray]]:
        """Per width and place in the filter, what each bucket adds: convolving is then looking up and adding."""
        return [[(self.embed @ self.filters[w][j]).astype(np.float32) for j in range(w)] for w in WIDTHS]

    def logits(self, ids: np.ndarray, starts: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        pad = ~_inside(starts)
        best = []
        for parts in tables:
            acc = parts[0][ids[:, 0]] + parts[0][ids[:, 1]]
            for j, part in enumerate(parts[1:], 1):
                acc[:-j] += part[ids[j:, 0]] + part[ids[j:, 1]]
            acc[pad] = -np.inf
            best.append(np.maximum.reduceat(acc, starts[:-1], axis=0))
        return np.maximum(np.hstack(best) + self.bias, 0) @ self.out + self.out_bias


def train(docs: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> Model:
    """Fits on hashed documents by AdaGrad; scores are not calibrated yet."""
    rng = np.random.default_rng(seed)
    fit = rng.permutation(len(docs))
    total = len(WIDTHS) * FILTERS
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    p = {"embed": draw(0.02, WORDS + STEMS, DIM), "bias": np.zeros(total, dtype=np.float32), "out": draw(0.3, total), "out_bias": np.zeros(1, dtype=np.float32)}
    p |= {f"w{w}": draw(0.5, w, DIM, FILTERS) for w in WIDTHS}
    p["embed"][0] = 0
    seen = {k: np.full_like(v, 1e-3) for k, v in p.items()}
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // max(1, len(fit))))):  # small samples are passed over more often
        rng.shuffle(fit)
        for k in range(0, len(fit), BATCH):
            part = fit[k : k + BATCH]
            rows, grads = _gradient(p, [docs[i] for i in part], labels[part])
            for name, g in grads.items():
                at = rows if name == "embed" else slice(None)
                seen[name][at] += g * g
                p[name][at] -= RATE * g / np.sqrt(seen[name][at])
    return Model(p["embed"], {w: p[f"w{w}"] for w in WIDTHS}, p["bias"], p["out"], float(p["out_bias"][0]))


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])


def _gradient(p: dict[str, np.ndarray], docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Gradients by parameter; those of embeddings only for the rows named first, as a maximum passes back to one window."""
    ids, starts = _joined(docs)
    n, pad = len(docs), ~_inside(starts)
    x = p["embed"][ids[:, 0]] + p["embed"][ids[:, 1]]
    grad, where, tops, rows, sums = {}, [], [], [], []
    for w in WIDTHS:
        acc = x @ p[f"w{w}"][0]
        for j in range(1, w):
            acc[:-j] += x[j:] @ p[f"w{w}"][j]
        acc[pad] = -np.inf
        where.append(np.stack([starts[i] + acc[starts[i] : starts[i + 1]].argmax(axis=0) for i in range(n)]))
        tops.append(np.take_along_axis(acc, where[-1], axis=0))
    hidden = np.maximum(np.hstack(tops) + p["bias"], 0)
    z = hidden @ p["out"] + p["out_bias"][0]
    d = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n).astype(np.float32)
    grad["out"], grad["out_bias"] = hidden.T @ d, d.sum(keepdims=True)
    dh = np.outer(d, p["out"]) * (hidden > 0)
    grad["bias"] = dh.sum(axis=0)
    for k, w in enumerate(WIDTHS):
        g, at = dh[:, k * FILTERS : (k + 1) * FILTERS], where[k]
        grad[f"w{w}"] = np.stack([np.einsum("nf,nfd->df", g, x[at + j]) for j in range(w)])
        for j in range(w):
            back = (g[:, :, None] * p[f"w{w}"][j].T[None]).reshape(-1, DIM)
            rows += [ids[at + j, 0].ravel(), ids[at + j, 1].ravel()]
            sums += [back, back]
    rows, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    grad["embed"] = np.zeros((len(rows), DIM), dtype=np.float32)
    np.add.at(grad["embed"], inverse, np.concatenate(sums))
    grad["embed"][rows == 0] = 0
    return rows, grad


def _platt(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Platt's scale of logits z with labels y, each counted n times."""
    pos, neg = (n * y).sum(), (n * (1 - y)).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        g = np.array([(n * (q - t) * z).sum(), (n * (q - t)).sum()])
        s = n * np.maximum(q * (1 - q), 1e-9)
        hess = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
        if abs(move).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _hashed(text: pa.Array) -> pa.Array:
    raw, at = hashing.utf8(text)
    ids, offsets = [], [np.zeros(1, dtype=np.int64)]
    for i, j in hashing.chunks(at):
        part, starts = token_ids(raw, at[i : j + 1])
        ids.append(part.ravel())
        offsets.append(offsets[-1][-1] + 2 * starts[1:])
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(flat))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> tuple[Model | None, dict[str, float], DataFrame | None]:
    """A model and a threshold for each language, learned from rows that are not held out, and the written logits (id, lang, long, logit) of all docs; no model if a class has none.

    Only what is trained on is bounded: SAMPLE documents of each class, the first by a hash of their id, of at most
    SAMPLE_BYTES and not among those kept out. Every other labelled row, of any length, calibrates scores and
    thresholds. A row whose label or id is null is not learned from.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    parts = [known.where((F.col("y") == y) & (F.pmod(F.xxhash64(F.lit("kept out"), "id"), F.lit(KEEP_OUT)) != 0)).orderBy(F.xxhash64("id"), "id").limit(most) for y, most in ((1, SAMPLE[0]), (0, SAMPLE[1]))]
    sample = parts[0].unionByName(parts[1])
    long = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) > SAMPLE_BYTES
    lang = F.coalesce(F.col(lang_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), long.alias("long")).where("not long").join(F.broadcast(sample), "id")  # at most sum(SAMPLE) rows
    rows = rows.select("id", "y", _hashed("text").alias("tokens")).orderBy(F.xxhash64("id"), "id").limit(sum(SAMPLE)).toArrow()
    y = rows.column("y").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None, {}, None
    model = train([x.values.to_numpy().reshape(-1, 2) for x in rows.column("tokens")], y)
    table = written(docs.select(F.col(id_col).alias("id"), lang.alias("lang"), long.alias("long"), logit_of(docs, model, text_col).alias("logit")), "logits")
    trained = F.coalesce(F.col("in_sample") & ~F.col("long"), F.lit(False))
    known = known.join(F.broadcast(sample.select("id", F.lit(True).alias("in_sample"))), "id", "left")
    bins = F.round(F.greatest(F.least("logit", F.lit(FAR)), F.lit(-FAR)) / BIN).cast("int")
    counts = table.join(known, "id").groupBy("lang", "long", "y", F.when(~trained, bins).alias("bin")).agg(F.count("*").alias("n")).collect()  # of each language, a few thousand bins at most
    model.scale, thresholds = calibrate([(r["lang"], r["long"], r["y"], r["bin"], r["n"]) for r in counts])
    return model, thresholds, table


def calibrate(counts: list[tuple[str, bool, int, int | None, int]]) -> tuple[tuple[float, float], dict[str, float]]:
    """Platt's scale, and each language's threshold, from counts (lang, long, label, bin of logits, n); bin None: rows trained on, whose logits are not used.

    Rows that were not trained on stand for those that were, of the same language, length and label, so that the share of
    each label is that of all labelled rows.
    """
    every, fresh = {}, {}
    for lang, long, y, k, n in counts:
        every[lang, long, y] = every.get((lang, long, y), 0) + n
        fresh[lang, long, y] = fresh.get((lang, long, y), 0) + n * (k is not None)
    rows = sorted((lang, y, k * BIN, n * every[lang, long, y] / fresh[lang, long, y]) for lang, long, y, k, n in counts if k is not None)
    y, z, n = (np.array([r[i] for r in rows], dtype=np.float64) for i in (1, 2, 3))
    scale = _platt(z, y, n) if len(rows) and y.min() < y.max() else (1.0, 0.0)
    score = _score(z, scale)
    langs = np.array([r[0] for r in rows], dtype=object)
    return scale, {lang: _threshold(score[langs == lang], y[langs == lang], n[langs == lang]) for lang in sorted({r[0] for r in rows})}


def _threshold(score: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Where F1 is best, in the middle of the widest gap between scores that reach it; the usual one where a class has few rows. Scores with label y count n times."""
    if min((n * y).sum(), (n * (1 - y)).sum()) < ENOUGH - 1e-6:
        return THRESHOLD
    s, at = np.unique(score, return_inverse=True)
    if len(s) < 2:
        return THRESHOLD
    pos, all_ = np.bincount(at, n * y), np.bincount(at, n)
    over = lambda x: x.sum() - np.cumsum(x)[:-1]
    f1 = 2 * over(pos) / np.maximum(1e-9, over(all_) + pos.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    c = best[np.argmax((s[1:] - s[:-1])[best])]
    return float(np.clip((s[c] + s[c + 1]) / 2, *RANGE))


def _score(logit: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scale[0] * logit + scale[1], -40, 40)))


def logit_of(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The logit of each whole text; null and empty texts are one padding word."""
    held = docs.sparkSession.sparkContext.broadcast((model, model.tables()))  # of fixed size

    @F.arrow_udf(T.DoubleType())
    def logit(text: pa.Array) -> pa.Array:
        model, tables = held.value
        raw, at = hashing.utf8(text)
        out = [model.logits(*token_ids(raw, at[i : j + 1]), tables) for i, j in hashing.chunks(at)]
        return pa.array((np.concatenate(out) if out else np.zeros(0)).astype(np.float64))

    return logit(F.col(text_col))


def score_of(logit: Column, model: Model) -> Column:
    """0 to 1, by Platt's scale."""
    a, b = model.scale
    return 1 / (1 + F.exp(-F.greatest(F.least(logit * a + b, F.lit(40.0)), F.lit(-40.0))))


def threshold_of(lang: Column, thresholds: dict[str, float]) -> Column:
    pairs = [F.lit(x) for kv in sorted(thresholds.items()) for x in kv]
    own = F.element_at(F.create_map(*pairs), F.coalesce(lang, F.lit(""))) if pairs else F.lit(None).cast("double")
    return F.coalesce(own, F.lit(THRESHOLD))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (score >= 0.3), lang_threshold and lang_predicted.

    Null and empty texts get the score of an empty document; null ids count as not held out; repeated rows get equal
    scores; a language without labelled rows has the threshold 0.3. Empty tables give no rows, and without labels of
    both classes every score is 0. Further columns are not looked at.
    """
    model, thresholds, table = fit(docs, labels, id_col, text_col, lang_col=lang_col)
    if model is None:
        table = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    score = F.lit(0.0) if model is None else score_of(F.col("logit"), model)
    rows = table.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), score.alias("score"), threshold_of(F.col("lang"), thresholds).alias("lang_threshold"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).cast("int").alias("lang_predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those at or over their language's threshold; all columns as they were. Nulls, repeated rows, empty tables and missing labels as in classify; without a model, all stay."""
    model, thresholds, _ = fit(docs, labels)
    if model is None:
        return docs
    row = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"), threshold_of(F.col("lang"), thresholds).alias("at"))
    return row.where(score_of(logit_of(row, model), model) < F.col("at")).select("row.*")
