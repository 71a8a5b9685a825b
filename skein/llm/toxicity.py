"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import keep_batches, map_batches, table, text_bytes
from skein.llm.winnow import Words, split_words

#: Words of a window and the step between windows: every run of 16 words lies whole in some window.
WINDOW, STEP = 32, 16
#: Labelled rows of each class, and characters of a text, that training uses at most.
TRAIN_POSITIVE, TRAIN_NEGATIVE, TRAIN_CHARS = 1000, 1300, 4_000
#: Score from which a text is rejected.
THRESHOLD = 0.7
#: Hidden units of each direction, of the attention; sizes of the embeddings and of their tables.
HIDDEN, ATTEND, WORD_DIM, EDGE_DIM = 6, 6, 4, 3
WORD_ROWS, EDGE_ROWS, EVIDENCE_ROWS = 1 << 14, 1 << 13, 1 << 18
#: Letters (bytes) of the character n-grams.
NGRAM = 4
#: Parts of the training texts, each seen with log odds from the others.
FOLDS = 5


def _bucket(h: np.ndarray, rows: int) -> np.ndarray:
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - rows.bit_length() + 1)).astype(np.int32)


@dataclass
class Tokens:
    """What the network sees of the words of many texts: rows of its tables for each word and for each letter's n-gram.

    ``gram`` has a row for each byte of a word, ``whole`` says where the n-gram
    lies inside the word, ``letter`` is the first byte of each word there, and
    ``first`` the first word of each text.
    """

    word: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    evidence: np.ndarray
    gram: np.ndarray
    whole: np.ndarray
    letter: np.ndarray
    first: np.ndarray


def tokens(words: Words) -> Tokens:
    """Characters enter as the first four and last three bytes of a word and as all its byte 4-grams, words by their hash."""
    length = words.end - words.start
    pad = np.zeros(NGRAM, np.uint8)
    data = np.concatenate([pad, words.data, pad])

    def piece(at: np.ndarray, most: np.ndarray, size: int, seed: int) -> np.ndarray:
        h = np.full(len(at), seed, np.uint32)
        for j in range(size):
            h = h * np.uint32(257) + np.where(j < most, data[at + (NGRAM + j)], 0).astype(np.uint32)
        return h

    prefix = piece(words.start, length, 4, 1)
    suffix = piece(np.maximum(words.start, words.end - 3), np.minimum(length, 3), 3, 2)
    fold = (words.hash ^ (words.hash >> np.uint64(32))).astype(np.uint32)
    letter = np.cumsum(length) - length
    n = int(length.sum())
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    letters = np.concatenate([words.data[np.cumsum(inside[:-1], dtype=np.int8) > 0] if n else words.data[:0], pad]).astype(np.uint32)
    gram = np.full(n, 3, np.uint32)
    for j in range(NGRAM):
        gram = gram * np.uint32(257) + letters[j : j + n]
    whole = np.ones(n, bool)
    for j in range(1, NGRAM):
        ends = letter + length - j
        whole[ends[length >= j]] = False
    return Tokens(_bucket(fold, WORD_ROWS), _bucket(prefix, EDGE_ROWS), _bucket(suffix, EDGE_ROWS), _bucket(fold + np.uint32(5), EVIDENCE_ROWS), _bucket(gram, EVIDENCE_ROWS), whole, letter, words.first)


def _best_gram(odds: np.ndarray, t: Tokens) -> np.ndarray:
    """The largest log odds among the n-grams of each word; 0 for a word without one."""
    if not len(t.word):
        return np.zeros(0, np.float32)
    best = np.maximum.reduceat(np.where(t.whole, odds[t.gram], np.float32(-9)), t.letter)
    return np.where(best > -9, best, np.float32(0))


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window: they start each ``STEP`` words and cover each text wholly; an empty text has one empty window."""
    n = np.diff(first)
    many = np.maximum(1, -(-(n - WINDOW) // STEP) + 1)
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = first[:-1][text] + k * STEP
    return text, start, np.minimum(WINDOW, first[1:][text] - start)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """Tables of log odds (``odds`` of words, ``gram_odds`` of character n-grams) and the network's parameters."""

    odds: np.ndarray
    gram_odds: np.ndarray
    params: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float | None = None

    def inputs(self, t: Tokens, odds: np.ndarray | None = None, best: np.ndarray | None = None) -> np.ndarray:
        """One row per word: embeddings of word, prefix and suffix, log odds of the word and the largest of its n-grams; one row of zeros at the end."""
        p, n = self.params, len(t.word)
        x = np.zeros((n + 1, WORD_DIM + 2 * EDGE_DIM + 2), np.float32)
        x[:n, :WORD_DIM] = p["Ew"][t.word]
        x[:n, WORD_DIM : WORD_DIM + EDGE_DIM] = p["Ep"][t.prefix]
        x[:n, WORD_DIM + EDGE_DIM : -2] = p["Es"][t.suffix]
        x[:n, -2] = self.odds[t.evidence] if odds is None else odds
        x[:n, -1] = _best_gram(self.gram_odds, t) if best is None else best
        return x

    def logits(self, x: np.ndarray, start: np.ndarray, size: np.ndarray, block: int = 2048) -> np.ndarray:
        """A logit per window of the words ``x``; windows are taken in order of their length, so that only shorter ones are masked."""
        p, H = self.params, HIDDEN
        out = np.empty(len(start), np.float32)
        project = {d: x @ p["Wx" + d] + p["bx" + d] for d in "fb"}
        none = len(x) - 1
        for rows in np.array_split(np.argsort(size, kind="stable"), max(1, -(-len(start) // block))):
            s, n = start[rows], size[rows]
            long, short = int(n.max()), int(n.min())
            hs = np.zeros((max(1, long), len(s), 2 * H), np.float32)
            for d, order in (("f", range(long)), ("b", range(long - 1, -1, -1))):
                h = np.zeros((len(s), H), np.float32)
                wh, bh, g = p["Wh" + d], p["bh" + d], project[d]
                for j in order:
                    full = j < short
                    inside = None if full else j < n
                    now = g[s + j] if full else g[np.where(inside, s + j, none)]
                    u = h @ wh
                    now[:, : 2 * H] += u[:, : 2 * H]
                    rz = np.tanh(np.float32(0.5) * now[:, : 2 * H])
                    rz += 1
                    rz *= np.float32(0.5)
                    u = u[:, 2 * H :] + bh
                    u *= rz[:, :H]
                    u += now[:, 2 * H :]
                    new = np.tanh(u, out=u)
                    new += rz[:, H:] * (h - new)
                    h = new if full else np.where(inside[:, None], new, h)
                    hs[j, :, H * (d == "b") : H * (d == "b") + H] = h
            e = np.tanh(hs @ p["A"] + p["a"]) @ p["v"]
            if short < long or not long:
                e[np.arange(len(e))[:, None] >= n[None, :]] = -np.inf
            e -= np.maximum(e.max(axis=0), np.float32(-1e30))
            np.exp(e, out=e)
            e /= np.maximum(e.sum(axis=0), np.float32(1e-30))
            out[rows] = ((hs @ p["w"]) * e).sum(axis=0) + p["b"]
        return out

    def score(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The largest probability among the windows of each text."""
        if self.prior is not None:
            return np.full(len(ends) - 1, self.prior)
        t = tokens(split_words(raw, ends))
        text, start, size = windows_of(t.first)
        logits = self.logits(self.inputs(t), start, size)
        best = np.full(len(ends) - 1, -np.inf)
        np.maximum.at(best, text, logits)
        return _sigmoid(np.clip(best, -60, 60))


def _step(p: dict, x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Loss, gradients of the parameters and of the inputs for windows ``x`` (N, T, D) of ``n`` words."""
    rows, long, _ = x.shape
    H, keep = HIDDEN, np.arange(long)[None, :] < n[:, None]
    hs = np.zeros((rows, long, 2 * H), x.dtype)
    tape = {}
    for d, order in (("f", list(range(long))), ("b", list(range(long - 1, -1, -1)))):
        h = np.zeros((rows, H), x.dtype)
        g = x @ p["Wx" + d] + p["bx" + d]
        for j in order:
            u = h @ p["Wh" + d]
            rz = _sigmoid(g[:, j, : 2 * H] + u[:, : 2 * H])
            un = u[:, 2 * H :] + p["bh" + d]
            new = np.tanh(g[:, j, 2 * H :] + rz[:, :H] * un)
            m = keep[:, j, None]
            tape[d, j] = (h, rz, un, new)
            h = np.where(m, new + rz[:, H:] * (h - new), h)
            hs[:, j, H * (d == "b") : H * (d == "b") + H] = h
    t = np.tanh(hs @ p["A"] + p["a"])
    e = np.where(keep, t @ p["v"], -np.inf)
    alpha = np.exp(e - np.maximum(e.max(axis=1, keepdims=True), -1e30))
    alpha /= np.maximum(alpha.sum(axis=1, keepdims=True), 1e-30)
    c = np.einsum("nt,nth->nh", alpha, hs)
    z = c @ p["w"] + p["b"]
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
    dz = weight * (_sigmoid(z) - y)
    grad = {"w": c.T @ dz, "b": dz.sum()}
    dc = dz[:, None] * p["w"]
    dalpha = np.einsum("nh,nth->nt", dc, hs)
    dhs = alpha[:, :, None] * dc[:, None, :]
    de = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
    grad["v"] = np.einsum("nt,ntk->k", de, t)
    dt = de[:, :, None] * p["v"] * (1 - t * t)
    grad["A"], grad["a"] = np.einsum("nth,ntk->hk", hs, dt), dt.sum(axis=(0, 1))
    dhs += dt @ p["A"].T
    dx = np.zeros_like(x)
    for d, order in (("f", range(long - 1, -1, -1)), ("b", range(long))):
        dg, dwh, dbh = np.zeros((rows, long, 3 * H), x.dtype), np.zeros_like(p["Wh" + d]), np.zeros(H, x.dtype)
        dh = np.zeros((rows, H), x.dtype)
        for j in order:
            dh = dh + dhs[:, j, H * (d == "b") : H * (d == "b") + H]
            h, rz, un, new = tape[d, j]
            r, zg = rz[:, :H], rz[:, H:]
            m = keep[:, j, None]
            dnew = np.where(m, dh * (1 - zg), 0) * (1 - new * new)
            dzg = np.where(m, dh * (h - new), 0) * zg * (1 - zg)
            dr = dnew * un * r * (1 - r)
            du = np.concatenate([dr, dzg, dnew * r], axis=1)
            dg[:, j] = np.concatenate([dr, dzg, dnew], axis=1)
            dwh += h.T @ du
            dbh += (dnew * r).sum(axis=0)
            dh = np.where(m, dh * zg, dh) + du @ p["Wh" + d].T
        grad["Wh" + d], grad["bh" + d] = dwh, dbh
        grad["Wx" + d], grad["bx" + d] = np.einsum("ntd,ntg->dg", x, dg), dg.sum(axis=(0, 1))
        dx += dg @ p["Wx" + d].T
    return loss, grad, dx


def _fresh(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    width = WORD_DIM + 2 * EDGE_DIM + 2
    p = {"Ew": rng.normal(0, 0.05, (WORD_ROWS, WORD_DIM)), "Ep": rng.normal(0, 0.05, (EDGE_ROWS, EDGE_DIM)), "Es": rng.normal(0, 0.05, (EDGE_ROWS, EDGE_DIM))}
    for d in "fb":
        p |= {"Wx" + d: rng.normal(0, 0.3, (width, 3 * HIDDEN)), "bx" + d: np.zeros(3 * HIDDEN), "Wh" + d: rng.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)), "bh" + d: np.zeros(HIDDEN)}
    p |= {"A": rng.normal(0, 0.3, (2 * HIDDEN, ATTEND)), "a": np.zeros(ATTEND), "v": rng.normal(0, 0.3, ATTEND), "w": rng.normal(0, 0.3, 2 * HIDDEN), "b": np.array(-1.0)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _held(rows: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (table row, text) pairs."""
    pairs = np.unique(text.astype(np.int64) * EVIDENCE_ROWS + rows)
    return (pairs % EVIDENCE_ROWS).astype(np.int32), (pairs // EVIDENCE_ROWS).astype(np.int32)


def _log_odds(rows: np.ndarray, text: np.ndarray, toxic: np.ndarray, use: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """Shrunken log odds of each table row by the numbers of toxic and other texts that hold it, from :func:`_held` pairs."""
    pos, neg = (np.bincount(rows[(use & side)[text]], minlength=EVIDENCE_ROWS) for side in (toxic, ~toxic))
    share = min(max((toxic & use).sum() / max(1, use.sum()), 1e-3), 1 - 1e-3)
    odds = np.log((pos + strength * share) / (neg + strength * (1 - share))) - np.log(share / (1 - share))
    return np.clip(odds, -1.5, 4).astype(np.float32)


def train(texts: list[str], labels: list[int], steps: int = 320, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Model:
    """Fits the network by multiple-instance learning: a toxic text has a toxic window, another text has none.

    Log odds are cross-fitted, so a training text is seen with tables that do
    not know it.  In each pass every toxic text gives its highest-scoring
    window, every other text its two highest and a random one.
    """
    y = np.array(labels, bool)
    if not len(y) or y.all() or not y.any():
        return Model(np.zeros(EVIDENCE_ROWS, np.float32), np.zeros(EVIDENCE_ROWS, np.float32), prior=float(y.mean()) if len(y) else 0.0)
    t = tokens(split_words(*text_bytes(pa.array(texts, pa.large_string()))))
    of_word = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(t.first))
    held_words = _held(t.evidence, of_word)
    held_grams = _held(t.gram[t.whole], np.repeat(of_word, np.diff(np.append(t.letter, len(t.gram))))[t.whole])
    everyone = np.ones(len(y), bool)
    model = Model(_log_odds(*held_words, y, everyone), _log_odds(*held_grams, y, everyone), _fresh(seed))
    fold = np.arange(len(y)) % FOLDS
    word_odds, gram_best = np.zeros(len(of_word), np.float32), np.zeros(len(of_word), np.float32)
    for k in range(FOLDS):
        side = fold == k
        mine = side[of_word]
        word_odds[mine] = _log_odds(*held_words, y, ~side)[t.evidence][mine]
        gram_best[mine] = _best_gram(_log_odds(*held_grams, y, ~side), t)[mine]
    text, start, size = windows_of(t.first)
    p, rng = model.params, np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    count = 0
    upto = np.concatenate([[0], np.cumsum(word_odds + gram_best)])
    while count < steps and len(of_word):
        if count:
            rank = model.logits(model.inputs(t, word_odds, gram_best), start, size)
        else:
            both = np.append(word_odds + gram_best, 0)
            rank = np.array([both[s : s + n].max() if n else 0 for s, n in zip(start, size, strict=True)]) + 1e-3 * (upto[start + size] - upto[start])
        order = np.lexsort((-rank, text))
        place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        picked = order[place < np.where(y[text[order]], 1, 2)]
        random = rng.permutation(len(text))[: len(y)]
        picked = rng.permutation(np.unique(np.concatenate([picked, random[~y[text[random]]]])))
        goal = y[text[picked]].astype(np.float32)
        heavy = np.where(goal > 0, 0.5 / max(1, goal.sum()), 0.5 / max(1, (1 - goal).sum())).astype(np.float32)
        for a in range(0, len(picked), batch):
            at = picked[a : a + batch]
            n = size[at]
            long = max(1, int(n.max()))
            inside = np.arange(long)[None, :] < n[:, None]
            idx = np.where(inside, start[at][:, None] + np.arange(long)[None, :], 0)
            w, pre, suf = t.word[idx], t.prefix[idx], t.suffix[idx]
            x = np.concatenate([p["Ew"][w], p["Ep"][pre], p["Es"][suf], word_odds[idx][:, :, None], gram_best[idx][:, :, None]], axis=2)
            x = np.where(inside[:, :, None], x, 0).astype(np.float32)
            scale = heavy[a : a + batch] * (len(picked) / len(at))
            _, grad, dx = _step(p, x, n, goal[a : a + batch], scale)
            dx = np.where(inside[:, :, None], dx, 0)
            for name, rows, lo, hi in (("Ew", w, 0, WORD_DIM), ("Ep", pre, WORD_DIM, WORD_DIM + EDGE_DIM), ("Es", suf, WORD_DIM + EDGE_DIM, WORD_DIM + 2 * EDGE_DIM)):
                g = np.zeros_like(p[name])
                np.add.at(g, rows.ravel(), dx[:, :, lo:hi].reshape(-1, hi - lo))
                grad[name] = g
            count += 1
            for name, g in grad.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p[name] = (p[name] - rate * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.99**count)) + 1e-6)).astype(np.float32)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = TRAIN_POSITIVE, negatives: int = TRAIN_NEGATIVE, chars: int = TRAIN_CHARS) -> Model:
    """A model from at most ``positives`` and ``negatives`` labelled rows that are not held out, chosen by a hash of their id.

    Ids without a text, without a label, or with one longer than ``chars`` are not used.
    """
    usable = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_skein_id"), F.col(label_col).cast("int").alias("y"))
    texts = docs.where(F.length(text_col) <= chars).select(F.col(id_col).alias("_skein_id"), F.col(text_col).alias("x"))
    ids = texts.select("_skein_id").join(usable, "_skein_id").withColumn("h", F.xxhash64("_skein_id"))
    some = [ids.where(f"y = {v}").orderBy("h", "_skein_id").limit(n) for v, n in ((1, positives), (0, negatives))]
    rows = some[0].union(some[1]).select("_skein_id", "y").collect()  # bounded by the two limits
    if not rows:
        return train([], [])
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(rows, ids.select("_skein_id", "y").schema).distinct())
    # of texts that share an id and a label, one: at most one row for each wanted pair
    got = texts.join(wanted, "_skein_id").groupBy("_skein_id", "y").agg(F.min("x").alias("x")).select("_skein_id", "x", "y").collect()
    got.sort(key=lambda r: (r[0], r[2], r[1]))
    return train([r[1] for r in got], [r[2] for r in got])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row; null and empty texts are scored like any text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "score": shared.value.score(*text_bytes(batch.column(1))).astype(np.float64)}

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(id_col, text_col), make, f"id {kind}, score double", text_at=1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    out = scored(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold.

    A null or empty text is scored like any text without words, rows without an
    id like others, repeated rows each by itself; without usable labels nothing
    is rejected, and an empty table stays empty.  Columns of any name are kept
    as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    return keep_batches(docs, text_col, lambda texts: shared.value.score(*text_bytes(texts)) < THRESHOLD)
