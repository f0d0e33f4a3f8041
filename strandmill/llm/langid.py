"""Languages of documents and of stretches inside them.

A byte convolutional network, trained here in numpy on labelled prose: bytes
are embedded, filters of several widths slide over a window of fixed length,
their maxima over the window feed a softmax over the languages. The running
prose of a document (no templates, tables, headings, bare lists, references) is
cut at sentence ends into windows of at most ``WINDOW`` bytes, windows of all
documents in an Arrow batch go through the network together, equal windows once.
A document's windows are then smoothed to stretches: changing the language
costs, so one odd window changes nothing.

The network is fitted on a bounded sample: at most ``per_language`` documents of
each language whose delivered label names it, those with the least hash of
their id. Labels may be wrong for some; the majority decides. Everything else
covers every row and the whole text.

Defined results: null or empty text, and texts with fewer than ``MIN_WORDS``
words of prose, have no language; ties between languages go to the first by
code; a label that is null, blank or no language's name counts as missing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix64, seeds
from .wikitext import WORD, prose_blocks

WINDOW, MIN_WORDS, MIN_CONFIDENCE = 96, 20, 0.45
WIDTHS, FILTERS, EMBED, STRIDE = (4, 6), 64, 8, 2
SWITCH = 3.0
_SENTENCE = re.compile(r"[^.!?]*(?:[.!?]+(?=\s|$)\s*|[.!?]+|$)")

# fixed values: the ten languages with their three-letter codes and English names
NAMES = {
    "de": ("deu", "ger", "german"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish", "castilian"),
    "fr": ("fra", "fre", "french"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch", "flemish"),
    "pl": ("pol", "polish"),
    "pt": ("por", "portuguese"),
    "ru": ("rus", "russian"),
    "sv": ("swe", "swedish"),
}
CODES = sorted(NAMES)
#: fixed values: labels that name no language
NO_LANGUAGE = frozenset("und unk unknown undefined undetermined unspecified unlabelled xx zz xxx zxx mis mul misc mixed multi various other na nil non null none nan auto default test text lang language".split())
_SPELLINGS = {s: code for code, more in NAMES.items() for s in (code, *more)}


def label_language(label: str | None) -> str | None:
    """The code a label names: one of ``CODES``, "other", or None for no language."""
    s = (label or "").strip().lower()
    base = re.split(r"[-_ .;,/]", s, maxsplit=1)[0]
    if s in _SPELLINGS or base in _SPELLINGS:
        return _SPELLINGS.get(s) or _SPELLINGS[base]
    if len(base) < 2 or not base.isalpha() or base in NO_LANGUAGE or s in ("n/a", "n.a."):
        return None
    return "other"


# ------------------------------------------------------------------ windows
def sentence_windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    """Prose as byte strings of at most ``window`` bytes, cut at sentences, then at words."""
    out: list[bytes] = []
    for block in prose_blocks(text):
        for sentence in _SENTENCE.findall(block):
            b = sentence.strip().encode()
            while len(b) > window:
                even = -(-len(b) // -(-len(b) // window))  # pieces of about equal length
                cut = b.find(b" ", even, window + 1)
                if cut < 0:
                    cut = b.rfind(b" ", 1, window + 1)
                if cut <= 0:  # no blank: cut before a character's first byte
                    cut = window
                    while cut > 1 and b[cut] & 0xC0 == 0x80:
                        cut -= 1
                out.append(b[:cut])
                b = b[cut:].lstrip(b" ")
            if b:
                out.append(b)
    return out


def as_matrix(windows: list[bytes], window: int = WINDOW) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(window, b"\0") for w in windows), np.uint8).reshape(len(windows), window)


# ------------------------------------------------------------------ network
class ByteNet:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"emb": (r.standard_normal((256, EMBED)) * 0.5).astype(np.float32), "out": f(len(WIDTHS) * FILTERS, len(CODES)), "bias": np.zeros(len(CODES), np.float32)}
        self.p["emb"][0] = 0
        for w in WIDTHS:
            self.p[f"w{w}"] = f(w * EMBED, FILTERS)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def _columns(self, e: np.ndarray, w: int) -> np.ndarray:
        n, length, d = e.shape
        steps = (length - w) // STRIDE + 1
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (n, steps, w * d), (s[0], s[1] * STRIDE, s[2]))
        return view.reshape(n * steps, w * d)

    def features(self, x: np.ndarray, keep: bool = False):
        e = self.p["emb"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            c = self._columns(e, w)
            z = (c @ self.p[f"w{w}"]).reshape(len(x), -1, FILTERS)
            if keep:
                at = z.argmax(axis=1)
                kept.append((c.reshape(len(x), -1, w * EMBED), at))
                top = np.take_along_axis(z, at[:, None], axis=1)[:, 0]
            else:
                top = z.max(axis=1)
            pooled.append(np.maximum(top + self.p[f"b{w}"], 0))
        return np.concatenate(pooled, axis=1), kept

    def log_probs(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.empty((len(x), len(CODES)), np.float32)
        for a in range(0, len(x), block):
            h, _ = self.features(x[a : a + block])
            z = h @ self.p["out"] + self.p["bias"]
            z -= z.max(axis=1, keepdims=True)
            out[a : a + block] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 192, rate: float = 8e-3, seed: int = 11) -> "ByteNet":
        """Adam with falling rate on cross-entropy; labels are smoothed, some being wrong."""
        r = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        last = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(order), batch):
                at = order[a : a + batch]
                g = self._gradients(x[at], y[at])
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (rate * (1 - (t - 1) / last) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
                self.p["emb"][0] = 0
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, h, kept = len(x), *self.features(x, keep=True)
        z = h @ self.p["out"] + self.p["bias"]
        z -= z.max(axis=1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(axis=1, keepdims=True)
        want = np.full_like(q, 0.05 / len(CODES))
        want[np.arange(n), y] += 0.95
        d = (q - want) / n
        g = {"out": h.T @ d, "bias": d.sum(axis=0), "emb": np.zeros_like(self.p["emb"])}
        back = (d @ self.p["out"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            columns, at = kept[i]
            b = back[:, i * FILTERS : (i + 1) * FILTERS]
            best = columns[np.arange(n)[:, None], at]
            g[f"w{w}"] = np.einsum("nfc,nf->cf", best, b)
            g[f"b{w}"] = b.sum(axis=0)
            to = b[:, :, None] * self.p[f"w{w}"].T[None]
            where = x[np.arange(n)[:, None, None], at[:, :, None] * STRIDE + np.arange(w)]
            where, to = where.ravel(), to.reshape(-1, EMBED)
            for k in range(EMBED):
                g["emb"][:, k] += np.bincount(where, to[:, k], 256)
        return g


# ----------------------------------------------------------------- training
def training_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text): at most ``per_language`` documents a language, by least hash of the id."""
    from pyspark.sql import Window

    spellings = docs.sparkSession.createDataFrame([(s, c) for s, c in _SPELLINGS.items()], "spelling string, code string")
    named = docs.where("text is not null and doc_id is not null").select("doc_id", F.lower(F.trim("lang")).alias("spelling"))
    w = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    picks = named.join(F.broadcast(spellings), "spelling").withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language).select("doc_id", "code")
    # at most per_language rows for each of ten languages
    return docs.join(F.broadcast(picks), "doc_id").select("doc_id", "code", "text")


def train(docs: DataFrame, per_language: int = 160, windows_a_document: int = 16) -> ByteNet:
    """Fit on the bounded sample; at most 10 * per_language * windows_a_document windows."""

    def cut(batches):
        for batch in batches:
            ids, code, window = [], [], []
            for i, c, t in zip(*(batch.column(j).to_pylist() for j in range(3))):
                own = [w for w in sentence_windows(t) if len(w) >= 24]
                step = max(1, len(own) // windows_a_document)
                for w in own[::step][:windows_a_document]:
                    ids.append(i)
                    code.append(c)
                    window.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(code, pa.string()), pa.array(window, pa.binary())], names=["doc_id", "code", "window"])

    rows = training_sample(docs, per_language).mapInArrow(cut, "doc_id long, code string, window binary").toPandas()
    rows = rows.sort_values(["doc_id", "window"])
    net = ByteNet()
    if not len(rows):
        return net
    x = as_matrix([bytes(w) for w in rows["window"]])
    y = rows["code"].map(CODES.index).to_numpy()
    return net.fit(x, y)


_FITTED: dict[tuple, ByteNet] = {}


def fitted(docs: DataFrame, **params) -> ByteNet:
    """The network for a table, fitted once in a session.

    The first call runs the training (two jobs, then numpy on the driver); what
    asks again for the same table and parameters gets the same weights.
    """
    key = (docs.sparkSession.sparkContext.applicationId, docs.semanticHash(), tuple(sorted(params.items())))
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = train(docs, **params)
    return _FITTED[key]


# ------------------------------------------------------------------ labelling
def smooth(lp: np.ndarray, weight: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Most likely language of each window when every change costs ``switch``."""
    n, k = lp.shape
    score, back = lp[0] * weight[0], np.zeros((n, k), np.int16)
    for i in range(1, n):
        j = int(score.argmax())
        move = score[j] - switch > score
        back[i] = np.where(move, j, np.arange(k))
        score = np.where(move, score[j] - switch, score) + lp[i] * weight[i]
    path = np.empty(n, np.int64)
    path[-1] = int(score.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def document_stretches(net: ByteNet, texts: list[str | None], window: int = WINDOW) -> list[list[tuple[int, int, float]]]:
    """For each text its stretches (language, words, confidence), in order."""
    cut = [sentence_windows(t, window) for t in texts]
    flat = [w for c in cut for w in c]
    if not flat:
        return [[] for _ in texts]
    x = as_matrix(flat, window)
    lanes = x.view(np.uint64)
    key = mix64((lanes * (seeds(lanes.shape[1], 0x2545F491) | np.uint64(1))).sum(axis=1, dtype=np.uint64))
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    lp = net.log_probs(x[first])[inverse]
    n_words = np.array([len(WORD.findall(flat[i].decode("utf-8", "replace"))) for i in first])[inverse]
    lens = np.fromiter(map(len, flat), np.int64, len(flat))
    weight = np.minimum(1.0, lens / 40.0)
    best, out, a = lp.argmax(axis=1), [], 0
    for c in cut:
        b = a + len(c)
        if a == b:
            out.append([])
            continue
        lang = best[a:b]
        if (lang != lang[0]).any():
            lang = smooth(lp[a:b], weight[a:b])
        edge = np.flatnonzero(np.diff(lang, prepend=-1))
        w = n_words[a:b]
        sure = np.exp(lp[a:b][np.arange(b - a), lang]) * np.maximum(w, 1e-3)
        words, conf = np.add.reduceat(w, edge), np.add.reduceat(sure, edge) / np.add.reduceat(np.maximum(w, 1e-3), edge)
        out.append(list(zip(lang[edge].tolist(), words.tolist(), conf.tolist())))
        a = b
    return out


STRETCHES = "doc_id long, label string, stretch_no int, lang string, words int, confidence double"


def stretches(docs: DataFrame, net: ByteNet) -> DataFrame:
    """One row a stretch of one language, with the document's delivered label."""
    weights = net.p

    def run(batches):
        own = ByteNet()
        own.p = weights
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, labels = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [(i, label, k, CODES[lang], words, conf) for i, label, found in zip(ids, labels, document_stretches(own, part.column(2).to_pylist())) for k, (lang, words, conf) in enumerate(found)]
                columns = list(zip(*rows)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "label", "stretch_no", "lang", "words", "confidence"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("label"), "text")
    return rows.mapInArrow(run, STRETCHES)


def document_languages(found: DataFrame, min_words: int = MIN_WORDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(doc_id, label, lang, words, confidence, main_words, others): the main language.

    The main language has most words in stretches of at least ``min_confidence``
    (keyboard noise stays below it), or most words where there are none.
    ``others`` are the further languages with ``min_words`` in one stretch of at
    least ``min_confidence``.
    """
    per = found.groupBy("doc_id", "label", "lang").agg(F.sum("words").alias("w"), F.sum(F.when(F.col("confidence") >= min_confidence, F.col("words")).otherwise(0)).alias("told"), F.max(F.when(F.col("confidence") >= min_confidence, F.col("words"))).alias("longest"), F.sum(F.col("words") * F.col("confidence")).alias("sure"))
    best = F.max_by(F.struct("lang", "w", "sure"), F.struct(F.col("told"), F.col("w"), F.negate(F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1)))))
    doc = per.groupBy("doc_id", "label").agg(F.sum("w").alias("words"), best.alias("m"), F.collect_list(F.when(F.col("longest") >= min_words, F.col("lang"))).alias("long_in"))
    doc = doc.where(F.col("words") >= min_words)
    return doc.select(
        "doc_id", "label", F.col("m.lang").alias("lang"), "words", F.try_divide(F.col("m.sure"), F.col("m.w")).alias("confidence"), F.col("m.w").alias("main_words"), F.array_except("long_in", F.array("m.lang")).alias("others")
    )


def label_cases(doc: DataFrame) -> DataFrame:
    """(doc_id, kind, lang): missing and wrong labels, further languages."""

    @F.pandas_udf("string")
    def names(label):
        return label.map(label_language, na_action=None)

    # one pass over the documents: a row's cases are put side by side, then unfolded
    told = F.when(F.col("named").isNull(), "missing").when(F.col("named") != F.col("lang"), "wrong")
    case = lambda kind, lang: F.struct(kind.alias("kind"), lang.alias("lang"))
    cases = F.concat(F.array(case(told, F.col("lang"))), F.transform("others", lambda x: case(F.lit("mixed"), x)))
    every = doc.withColumn("named", names("label")).select("doc_id", F.explode(cases).alias("c"))
    return every.where("c.kind is not null").select("doc_id", "c.kind", "c.lang")
