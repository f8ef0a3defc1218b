"""Toxicity: a convolutional text classifier on hashed words, trained in numpy, with thresholds calibrated by language.

A word's vector is the sum of two hashed embeddings, of the word and of its first characters, so that unseen forms of a
known stem count. Filters of width 1, 2 and 3 run over the whole text, the maximum of each over all places is kept, and a
logistic layer gives the score, scaled on rows that were not trained on. Spark splits and hashes the words; tasks get
arrays of numbers and multiply matrices.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from seamark.llm.common import NOT_A_WORD, broadcast_below, shared_table, split_words

BUCKETS, PREFIX = 1 << 15, 4
DIM, FILTERS, WIDTHS = 16, 16, (1, 2, 3)
GAP = 3                     # empty rows after each text, so that no window reaches into the next
SPAN = 100_000              # words at a time
MAX_POSITIVE, MAX_NEGATIVE = 3000, 4500   # labelled rows learned from, at most
MIN_CLASS = 10              # rows of each class, not trained on, that a threshold needs
STEP = 0.01                 # of the logit by which scores are counted for thresholds
SMALL = 500_000             # labels that may be broadcast
MAX_WORDS = 5_000_000       # words of those rows altogether, at most
VISITS, BATCH, RATE, DROP = 24_000, 32, 0.1, 0.2   # texts shown in training, repeats included, if they are enough for 4 to 12 rounds


def hashed_words(text: Column) -> tuple[Column, Column]:
    """Two arrays of bucket numbers, of the words and of their first characters."""
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")
    words = split_words(F.lower(text), NOT_A_WORD)
    return words, lambda w: (F.transform(w, bucket), F.transform(w, lambda x: bucket(F.substring(x, 1, PREFIX))))


def with_hashed_words(docs: DataFrame, text: str, keep_text: bool = False) -> DataFrame:
    """``docs`` with arrays ``__w`` and ``__p``, in place of the text unless it is kept."""
    others = [c for c in docs.columns if c != text or keep_text]
    words, hashed = hashed_words(F.col(text))
    w, p = hashed(F.col("__words"))
    return docs.select(*others, words.alias("__words")).select(*others, w.alias("__w"), p.alias("__p"))


@dataclass
class Model:
    words: np.ndarray
    prefixes: np.ndarray
    filters: list[np.ndarray]   # per width: (width, DIM, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    offset: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    fallback: float = 0.5

    @classmethod
    def new(cls, rng: np.random.Generator) -> Model:
        f32 = lambda x: x.astype(np.float32)
        return cls(f32(rng.normal(0, 0.1, (BUCKETS, DIM))), f32(rng.normal(0, 0.1, (BUCKETS, DIM))),
                   [f32(rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS))) for w in WIDTHS],
                   np.zeros(FILTERS * len(WIDTHS), np.float32), f32(rng.normal(0, 0.1, FILTERS * len(WIDTHS))))

    def vectors(self, w: np.ndarray, p: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors of all texts with empty rows between, and where each text begins."""
        at = starts - starts[0] + GAP * np.arange(len(starts)) if len(starts) else starts
        x = np.zeros((int(lengths.sum()) + GAP * len(lengths), DIM), np.float32)
        place = np.repeat(at - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        x[place] = self.words[w] + self.prefixes[p]
        return x, at

    def pooled(self, x: np.ndarray, at: np.ndarray, lengths: np.ndarray, where: bool = False):
        """Per text and filter the largest response over its windows (an empty text has one empty window)."""
        ends = np.stack([at, at + np.maximum(lengths, 1)], 1).ravel()
        best, places = [], []
        for width, weight in zip(WIDTHS, self.filters):
            y = x @ weight[0]
            for j in range(1, width):
                y[:-j] += x[j:] @ weight[j]
            top = np.maximum.reduceat(y, ends, axis=0)[::2] if len(at) else np.zeros((0, FILTERS), np.float32)
            best.append(top)
            if where:
                places.append(np.stack([a + y[a:b].argmax(0) for a, b in zip(ends[::2], ends[1::2])]))
        best = np.concatenate(best, 1)
        return (best, np.concatenate(places, 1)) if where else best

    def logits(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best + self.bias, 0) @ self.dense + self.offset

    def score(self, w: np.ndarray, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Scores of texts bounds[i]:bounds[i + 1]; long ones in overlapping stretches whose maxima are joined."""
        out, i = np.zeros((len(bounds) - 1, FILTERS * len(WIDTHS)), np.float32), 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SPAN, "right")) - 1)
            lo, hi = bounds[i], bounds[j]
            if j == i + 1 and hi - lo > SPAN:
                cuts = np.arange(lo, hi, SPAN - max(WIDTHS) + 1)
                parts = [self._pool(w, p, np.array([c, min(c + SPAN, hi)])) for c in cuts]
                out[i] = np.max(np.concatenate(parts), axis=0)
            else:
                out[i:j] = self._pool(w, p, bounds[i:j + 1])
            i = j
        return 1 / (1 + np.exp(-(self.scale * self.logits(out).astype(float) + self.shift)))

    def _pool(self, w, p, bounds):
        lengths = np.diff(bounds)
        x, at = self.vectors(w[bounds[0]:bounds[-1]], p[bounds[0]:bounds[-1]], bounds[:-1], lengths)
        return self.pooled(x, at, lengths)


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Model:
    """Adagrad on the logistic loss; words are dropped at random, so that no single one carries a text."""
    rng = np.random.default_rng(seed)
    m = Model.new(rng)
    # The memory of Adagrad, one per parameter; embeddings keep one per row.
    seen_w, seen_p = np.full(BUCKETS, 1e-2, np.float32), np.full(BUCKETS, 1e-2, np.float32)
    seen = {"filters": [np.full(f.shape, 1e-2, np.float32) for f in m.filters], "bias": np.full(m.bias.shape, 1e-2, np.float32),
            "dense": np.full(m.dense.shape, 1e-2, np.float32), "offset": 1e-2}
    weight = np.where(labels == 1, max(1.0, (labels == 0).sum() / max(1, 2 * (labels == 1).sum())), 1.0)
    for _ in range(min(12, max(4, VISITS // len(texts)))):
        order = rng.permutation(len(texts))
        for batch in np.array_split(order, max(1, len(order) // BATCH)):
            kept = [rng.random(len(texts[i][0])) >= DROP for i in batch]
            lengths = np.array([k.sum() for k in kept])
            w = np.concatenate([texts[i][0][k] for i, k in zip(batch, kept)])
            p = np.concatenate([texts[i][1][k] for i, k in zip(batch, kept)])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            x, at = m.vectors(w, p, starts, lengths)
            best, places = m.pooled(x, at, lengths, where=True)
            hidden = np.maximum(best + m.bias, 0)
            prob = 1 / (1 + np.exp(-np.clip(hidden @ m.dense + m.offset, -30, 30)))
            delta = ((prob - labels[batch]) * weight[batch] / len(batch)).astype(np.float32)
            g_dense, g_hidden = hidden.T @ delta, (delta[:, None] * m.dense) * (hidden > 0)
            step = lambda name, grad: _adagrad(getattr(m, name), grad, seen[name])
            ids_w, ids_p = np.full(len(x), -1), np.full(len(x), -1)
            place = np.repeat(at - starts, lengths) + np.arange(len(w))
            ids_w[place], ids_p[place] = w, p
            rows, grads = [], []
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                g, pl = g_hidden[:, cols], places[:, cols]
                for j in range(width):
                    near = np.minimum(pl + j, len(x) - 1)
                    g_filter = np.einsum("bfd,bf->df", x[near], g)
                    rows.append(near.ravel())
                    grads.append((g[:, :, None] * m.filters[k][j].T[None]).reshape(-1, DIM))
                    _adagrad(m.filters[k][j], g_filter, seen["filters"][k][j])
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            for table, ids, memory in ((m.words, ids_w, seen_w), (m.prefixes, ids_p, seen_p)):
                real = (ids[rows] >= 0) & grads.any(1)
                touched, where = np.unique(ids[rows][real], return_inverse=True)
                total = np.zeros((len(touched), DIM), np.float32)
                np.add.at(total, where, grads[real])
                memory[touched] += (total ** 2).mean(1)
                table[touched] -= RATE * total / np.sqrt(memory[touched])[:, None]
            step("bias", g_hidden.sum(0)), step("dense", g_dense)
            seen["offset"] += float(delta.sum()) ** 2
            m.offset -= RATE * float(delta.sum()) / seen["offset"] ** 0.5
    return m


def _adagrad(value: np.ndarray, grad: np.ndarray, memory: np.ndarray) -> None:
    memory += grad ** 2
    value -= RATE * grad / np.sqrt(memory)


def calibrate(m: Model, logits: np.ndarray, labels: np.ndarray, prior: float) -> None:
    """Platt scaling at the labelled share of toxic rows."""
    share = labels.mean() if len(labels) else 0.5
    weight = np.where(labels == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    # Targets a little inside 0 and 1, as in Platt's method, keep the slope finite on separable rows.
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps on two numbers
        q = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        r, h = weight * (q - target), weight * q * (1 - q) + 1e-9
        grad = np.array([(r * logits).sum(), r.sum()])
        hess = np.array([[(h * logits ** 2).sum() + 1e-3, (h * logits).sum()], [(h * logits).sum(), h.sum() + 1e-3]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - move[0], b - move[1]
    m.scale, m.shift = float(max(a, 1e-3)), float(b)


def set_thresholds(m: Model, counts: pd.DataFrame) -> None:
    """Per language the threshold with the best F1, from labelled rows counted by ``lang``, ``y``, ``trained`` and ``bin``.

    Rows that were trained on have no say but in how many rows of a class there are: the others stand for them, too, so
    that the share of toxic rows is that of all labelled ones. A language with under ``MIN_CLASS`` rows of a class that were
    not trained on keeps the threshold of all languages, and that one is 0.5 if there are no more rows altogether.
    """
    def best(rows: pd.DataFrame) -> float | None:
        every, fresh = rows.groupby("y")["n"].sum(), rows[~rows["trained"]]
        judged = fresh.groupby("y")["n"].sum()
        if min(judged.get(0, 0), judged.get(1, 0)) < MIN_CLASS:
            return None
        weight = fresh["n"] * fresh["y"].map(every / judged)
        return best_threshold(fresh["bin"].to_numpy(), fresh["y"].to_numpy(), weight.to_numpy())

    general = best(counts)
    m.fallback = 0.5 if general is None else general
    found = {lang: best(rows) for lang, rows in counts.groupby("lang")}
    m.thresholds.update({lang: value for lang, value in found.items() if value is not None})


def best_threshold(bins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """Where a range of thresholds is equally good, its middle is taken; all rows of a bin are on the same side."""
    steps, where = np.unique(-bins, return_inverse=True)
    rows, hits = (np.cumsum(np.bincount(where, w, len(steps))) for w in (weight, weight * labels))
    f1 = 2 * hits / (rows + hits[-1])
    best = np.flatnonzero(f1 == f1.max())
    edge = lambda b: 1 / (1 + np.exp(-b * STEP))
    below = edge(1 - steps[best[-1] + 1]) if best[-1] + 1 < len(steps) else 0.0
    return float((edge(-steps[best[0]]) + below) / 2)


def count_scores(docs: DataFrame, known: DataFrame, trained: DataFrame, model: Model, doc_id: str, text: str, lang: str) -> DataFrame:
    """(lang, y, trained, bin, n): the labelled rows of ``docs`` by steps of their score's logit."""
    flagged = shared_table(known.join(F.broadcast(trained.withColumn("__t", F.lit(True))), doc_id, "left"), "known")
    langs = F.col(lang) if lang in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id), F.col(text), langs.alias("__lang")).join(broadcast_below(flagged, SMALL), doc_id)
    scored = score(rows.drop(doc_id), model, text, prefix="__s_").select("__lang", "__y", "__t", F.least(F.greatest("__s_score", F.lit(1e-12)), F.lit(
        1 - 1e-12)).alias("q"))
    return scored.groupBy(F.coalesce("__lang", F.lit("")).alias("lang"), F.col("__y").cast("int").alias("y"), F.coalesce("__t", F.lit(False)).alias(
        "trained"), F.floor(F.ln(F.col("q") / (1 - F.col("q"))) / STEP).alias("bin")).agg(F.count("*").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, max_words: int = MAX_WORDS) -> Model:
    """Learn from the labelled rows given: per class the first ``max_*`` rows in the order of a hash of their ids, and of
    those as many as have ``max_words`` words together (a longer text alone is left out). Every fifth of them scales the
    scores only. The thresholds come from all labelled rows given that the classifier has not seen, scored in Spark.

    Without rows of both classes the model scores every text with the share of toxic labels.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(doc_id, F.col(label).alias("__y")).dropDuplicates([doc_id])
    shares = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    drawn = [known.where(F.col("__y") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(n) for y, n in ((1, max_positive), (0, max_negative))]
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most max_positive + max_negative rows of two numbers
    rows = docs.select(F.col(doc_id), F.col(text)).join(chosen, doc_id)
    stored = shared_table(with_hashed_words(rows, text).withColumn("__n", F.size("__w")), "labelled")
    sizes = stored.select(doc_id, "__n").orderBy(F.xxhash64(doc_id), doc_id).collect()
    taken, total = [], 0
    for r in sizes:
        if total + r["__n"] <= max_words:
            total += r["__n"]
            taken.append(r[doc_id])
    learned = stored.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in taken], f"{doc_id} bigint")), doc_id) if len(
        taken) < len(sizes) else stored
    got = learned.select(doc_id, "__y", "__w", "__p").toArrow()
    ids = got.column(doc_id).to_numpy()
    order = np.argsort(ids, kind="stable")
    got = got.take(pa.array(order)).combine_chunks()
    y = got.column("__y").to_numpy().astype(int)

    def arrays(name: str) -> list[np.ndarray]:
        lists = got.column(name).combine_chunks()
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]

    texts = list(zip(arrays("__w"), arrays("__p"))) if len(y) else []
    if not len(y) or y.min() == y.max():
        m = Model.new(np.random.default_rng(0))
        m.dense[:] = 0
        m.shift = float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
        return m
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    m = train([t for t, h in zip(texts, held) if not h], y[~held])
    judged = held if held.any() else ~held
    some = [t for t, h in zip(texts, judged) if h]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w, _ in some])])
    m.scale, m.shift = 1.0, 0.0
    raw = m.score(np.concatenate([w for w, _ in some]), np.concatenate([p for _, p in some]), bounds)
    raw = np.log(np.clip(raw, 1e-12, 1 - 1e-12) / (1 - np.clip(raw, 1e-12, 1 - 1e-12)))
    calibrate(m, raw, y[judged], prior)
    seen = np.sort(ids)[~held] if held.any() else []  # of too few rows to spare some, all are judged
    trained = docs.sparkSession.createDataFrame([(int(i),) for i in seen], f"{doc_id} {known.schema[doc_id].dataType.simpleString()}").distinct()
    set_thresholds(m, count_scores(docs, known, trained, m, doc_id, text, lang).toPandas())
    return m


def score(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", keep_text: bool = False,
          prefix: str = "") -> DataFrame:
    """``docs``, without the text unless it is kept, with ``score`` (0 to 1), ``threshold`` of the row's language and ``toxic``.

    Only the text is an input of the score. Null and empty texts have the score of no words; repeated rows stay, each
    with the same score; an empty table gives no rows; an unknown or missing language takes the general threshold. The new
    columns have ``prefix`` before their names and replace columns of the same names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def scored(w: pa.Array, p: pa.Array) -> pa.Array:
        bounds = w.offsets.to_numpy().astype(np.int64)
        return pa.array(shared.value.score(w.values.to_numpy(zero_copy_only=False), p.values.to_numpy(zero_copy_only=False), bounds))

    new = [prefix + n for n in ("score", "threshold", "toxic")]
    others = [c for c in docs.columns if c not in (new if keep_text else [text, *new])]
    limit = F.lit(model.fallback)
    for name, value in sorted(model.thresholds.items()):
        limit = F.when(F.col(lang) == name, F.lit(value)).otherwise(limit) if lang in docs.columns and name else limit
    out = with_hashed_words(docs.select(*others, *([] if keep_text else [text])), text, keep_text).select(*others, scored("__w", "__p").alias(new[0]))
    return out.withColumn(new[1], limit).withColumn(new[2], F.col(new[0]) >= F.col(new[1]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
