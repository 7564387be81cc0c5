"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the mean of the vectors of its hashed whole form and its hashed four-letter beginning, so that
inflected forms share what they learn. Filters of widths 1, 2 and 3 slide over the words; each keeps its largest
response in the text; a logistic layer scores these. For scoring, filters times vectors are multiplied out once
into a table of responses per bucket, so that a text costs look-ups, sums and maxima only, whatever its length.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BUCKETS = 1 << 16
WIDTHS = (1, 2, 3)
_WORD = re.compile(r"[^\W\d_]+")
#: Words that a task keeps the numbers of.
CACHE = 200_000


def _buckets(word: str) -> int:
    """Both buckets of a word in one number: whole form, and first four letters (a kind of its own)."""
    whole = zlib.crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1
    start = zlib.crc32(("^" + word[:4]).encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1
    return whole * BUCKETS + start


class Words:
    """Word numbers of texts, with a cache of bounded size per task."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words, seen = _WORD.findall(text.lower()), self.seen
        try:
            ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(seen) > CACHE:
                seen.clear()
            for w in words:
                if w not in seen:
                    seen[w] = _buckets(w)
            ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        return ids


def _slots(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' words in one array, each text between enough blanks (bucket 0) for the widest filter, and where each begins."""
    gap = max(WIDTHS) - 1
    size = np.array([len(t) + gap + 1 for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(size)))
    ids = np.zeros(first[-1] + gap, np.int64)
    for a, t in zip(first, texts):  # noqa: B905
        ids[a + 1 : a + 1 + len(t)] = t
    return ids, first[:-1]


class Classifier:
    def __init__(self, width: int = 12, filters: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.emb = (rng.standard_normal((BUCKETS, width)) * 0.3).astype(np.float32)
        self.emb[0] = 0
        self.conv = {w: (rng.standard_normal((w, width, filters)) / np.sqrt(w * width)).astype(np.float32) for w in WIDTHS}
        self.out = np.zeros(filters * len(WIDTHS), np.float32)
        self.bias = np.float32(0)
        self.scale, self.shift = 1.0, 0.0
        self.cut: dict[str | None, float] = {None: 0.5}

    def _pool(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of every filter in every text (0 at least), and where it stands."""
        v = (self.emb[ids // BUCKETS] + self.emb[ids % BUCKETS]) / 2
        pooled, where = [], []
        text = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        for w, k in self.conv.items():
            n = len(ids) - w + 1
            r = sum(v[j : j + n] @ k[j] for j in range(w))
            top = np.maximum.reduceat(r, first, axis=0)
            hit = np.zeros(top.shape, np.int64)
            for f in range(r.shape[1]):
                at = np.flatnonzero(r[:, f] == top[text[:n], f])
                hit[text[at[::-1]], f] = at[::-1]
            pooled.append(np.maximum(top, 0))
            where.append(hit)
        return np.concatenate(pooled, axis=1), where

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1) -> None:
        """Adagrad on the logistic loss, toxic texts weighted up to half of the mass. The same rows give the same model."""
        rng = np.random.default_rng(1)
        share = max(labels.mean(), 1e-3)
        heft = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1e-3))
        g_emb = np.full(BUCKETS, 1e-3, np.float32)
        g_conv = {w: np.full(k.shape, 1e-3, np.float32) for w, k in self.conv.items()}
        g_out, g_bias = np.full(len(self.out), 1e-3, np.float32), 1e-3
        self.out = (np.random.default_rng(2).standard_normal(len(self.out)) * 0.3).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                ids, first = _slots([texts[i] for i in pick])
                p, where = self._pool(ids, first)
                s = 1 / (1 + np.exp(-(p @ self.out + self.bias)))
                d = ((s - labels[pick]) * heft[pick] / len(pick)).astype(np.float32)
                dp = d[:, None] * self.out * (p > 0)
                go, gb = p.T @ d, d.sum()
                rows, cols, grads = [], [], []
                n_f = p.shape[1] // len(WIDTHS)
                for i, (w, k) in enumerate(self.conv.items()):
                    g = dp[:, i * n_f : (i + 1) * n_f]
                    gk = np.zeros_like(k)
                    for j in range(w):
                        at = ids[where[i] + j]  # text, filter
                        v = (self.emb[at // BUCKETS] + self.emb[at % BUCKETS]) / 2
                        gk[j] = np.einsum("nfd,nf->df", v, g)
                        gv = np.einsum("nf,df->nfd", g, k[j]) / 2
                        for b in (at // BUCKETS, at % BUCKETS):
                            rows.append(b.ravel())
                            grads.append(gv.reshape(-1, gv.shape[2]))
                    g_conv[w] += gk * gk
                    cols.append((w, gk))
                for w, gk in cols:
                    self.conv[w] -= rate * gk / np.sqrt(g_conv[w])
                ge_rows, inv = np.unique(np.concatenate(rows), return_inverse=True)
                ge = np.zeros((len(ge_rows), self.emb.shape[1]), np.float32)
                np.add.at(ge, inv, np.concatenate(grads))
                g_emb[ge_rows] += (ge * ge).mean(1)
                self.emb[ge_rows] -= rate * ge / np.sqrt(g_emb[ge_rows])[:, None]
                self.emb[0] = 0
                g_out += go * go
                g_bias += gb * gb
                self.out -= rate * go / np.sqrt(g_out)
                self.bias -= np.float32(rate * gb / np.sqrt(g_bias))

    def freeze(self) -> None:
        """Multiply filters and bucket vectors out, once the weights stand."""
        self.table = {w: [(self.emb @ k[j] / 2).astype(np.float32) for j in range(w)] for w, k in self.conv.items()}

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        """Logits before calibration."""
        ids, first = _slots(texts)
        a, b = ids // BUCKETS, ids % BUCKETS
        z = np.full(len(first), self.bias, np.float64)
        at = 0
        for w, parts in self.table.items():
            n = len(ids) - w + 1
            r = np.zeros((n, parts[0].shape[1]), np.float32)
            for j, t in enumerate(parts):
                r += t[a[j : j + n]]
                r += t[b[j : j + n]]
            top = np.maximum(np.maximum.reduceat(r, first, axis=0), 0)
            z += top @ self.out[at : at + top.shape[1]].astype(np.float64)
            at += top.shape[1]
        return z

    def calibrate(self, z: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> None:
        """Shift logits so that 0.5 is the best cut over all, then a cut for each language with enough rows of both labels."""
        best = _best_cut(z, labels)
        self.shift, self.scale = -best, 1.0 / max(1.0, float(np.std(z)) / 4)
        s = self.probability(z)
        self.cut = {None: 0.5}
        langs = np.array([x if x is not None else "" for x in langs], dtype=object)
        for lang in set(langs):
            m = langs == lang
            if lang and labels[m].sum() >= 20 and (labels[m] == 0).sum() >= 20:
                self.cut[lang] = float(np.clip(_best_cut(s[m], labels[m]), 0.05, 0.95))

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((z + self.shift) * self.scale, -50, 50)))


def _best_cut(z: np.ndarray, labels: np.ndarray) -> float:
    """The cut with fewest errors (of equal ones the middle): rows at or above it are called toxic."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], labels[order]
    if not len(z):
        return 0.5
    errors = np.concatenate(([(y == 0).sum()], (y == 0).sum() + np.cumsum(np.where(y == 1, 1, -1))))
    edges = np.concatenate(([z[0] - 1], (z[:-1] + z[1:]) / 2, [z[-1] + 1]))
    usable = np.concatenate(([True], z[:-1] < z[1:], [True]))
    best = np.flatnonzero(usable & (errors == errors[usable].min()))
    return float(edges[best[len(best) // 2]])


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> DataFrame:
    """Up to `most` labelled rows of each label, chosen by a hash of doc_id, never one whose crc32(doc_id) mod 5 is 0."""
    known = labels.select(F.col(f"`{doc_id}`").alias("k"), F.col(f"`{label}`").alias("y")).where("k IS NOT NULL AND y IN (0, 1) AND crc32(cast(k AS string)) % 5 <> 0")
    known = known.groupBy("k").agg(F.max("y").cast("int").alias("y"))
    sides = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(most) for y in (0, 1)]
    rows = docs.select(F.col(f"`{doc_id}`").alias("k"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    return rows.join(sides[0].unionByName(sides[1]), "k").select("k", "y", "lang", "text")


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> Classifier:
    """Train on a bounded sample: the numbers of all words (4 bytes a word) of at most `most` rows of each label reach the driver.

    A quarter of the sample is held back from the weights and used to calibrate the cuts. Without rows of both
    labels the model scores everything 0.
    """
    rows = labelled_rows(docs, labels, most, doc_id, text, lang, label)

    def number(words, texts):
        return [[words(t).astype("<u4").tobytes() for t in texts]]

    got = map_texts(rows, "words binary", number, setup=Words).orderBy(F.xxhash64("k"), "k").toPandas()
    model = Classifier()
    y = got["y"].to_numpy(np.int64) if len(got) else np.zeros(0, np.int64)
    if len(set(y)) < 2:
        model.shift, model.bias = -1e3, np.float32(0)
        model.freeze()
        return model
    texts = [np.frombuffer(w, "<u4") for w in got["words"]]
    hold = np.arange(len(y)) % 4 == 3
    if len(set(y[~hold])) < 2 or len(set(y[hold])) < 2:
        hold[:] = False
    model.train([t for t, h in zip(texts, hold, strict=True) if not h], y[~hold])
    model.freeze()
    if not hold.any():
        hold[:] = True
    model.calibrate(model.raw([t for t, h in zip(texts, hold, strict=True) if h]), y[hold], [x for x, h in zip(got["lang"], hold, strict=True) if h])
    return model


def _scored(df: DataFrame, model: Classifier, text: str, keep_text: bool, name: str = "_tox_score") -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(model)

    def score(words, texts):
        return [held.value.probability(held.value.raw([words(t) for t in texts]))]

    return map_texts(df, f"{name} double", score, text, keep_text=keep_text, setup=Words)


def score(docs: DataFrame, model: Classifier, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted (cut 0.5), flagged (by the language's own cut).

    Null and empty texts are scored like texts without words; repeated rows and null ids give their own rows
    (held_out is false for a null id). Scores come from the text alone, whole at any length. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    out = _scored(rows, model, "text", False)
    return out.select(
        "doc_id", F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 5 = 0"), F.lit(False)).alias("held_out"), F.col("_tox_score").alias("score"),
        (F.col("_tox_score") >= 0.5).cast("int").alias("predicted"), (F.col("_tox_score") >= cuts(model, F.col("lang"))).alias("flagged"),
    )


def cuts(model: Classifier, lang):
    """The cut of a language; that over all where it has none or is null."""
    out = F.lit(model.cut[None])
    for k, v in model.cut.items():
        if k is not None:
            out = F.when(lang == k, F.lit(v)).otherwise(out)
    return out


def filter_documents(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", most: int = 3000) -> DataFrame:
    """The documents that aren't flagged, with the columns they came with.

    Null and empty texts are scored like texts without words, a null language by the cut over all; repeated rows each
    get their verdict. An empty table gives an empty one.
    """
    model = fit(docs, labels, most, text=text, lang=lang)
    name = "_tox_score"
    while name in docs.columns:
        name += "_"
    out = _scored(docs, model, text, True, name)
    return out.where(F.col(name) < cuts(model, F.col(f"`{lang}`"))).select(*(f"`{c}`" for c in docs.columns))
