"""Toxicity by a subsequence string kernel and a linear SVM on Nyström features.

A sentence is seen through its words.  The kernel of a word and a landmark sums
over their common subsequences of ``ORDER`` characters, each weighed down by the
gaps it spans, so that an insult with inserted or spaced characters stays close
to its plain form.  Landmarks are word stems that mark toxic training documents,
and ordinary words that come close to them.  A sentence has the largest kernel
of its words for each landmark; the Nyström map of these values goes to an SVM
trained on labelled sentences.  A document's score is that of its worst one.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.common import hash_sample

ORDER, DECAY = 3, 0.75
#: Bounds of the training sample: documents of either label.
MAX_TOXIC, MAX_OTHER = 1000, 2500
MAX_STEMS, MAX_PLAIN = 48, 16
#: Letters of a word that are compared at once; longer words are seen in parts, each ``STEP`` letters on.
LONGEST, STEP = 23, 12
#: Words whose kernel with every stem is lower count as unlike all.
CLOSE = 0.45

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPACED_OUT = re.compile(r"(?<!\S)(?:[^\W\d_]\s){2,}[^\W\d_](?!\S)")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def words_of(sentence: str) -> list[str]:
    """Words of a lower-cased text as letters only; single letters in a row are one word."""
    out = [w for t in sentence.split() for w in parts(letters(t)) if len(w) > 1]
    return out + [w for m in _SPACED_OUT.findall(sentence) for w in parts(re.sub(r"\s", "", m))]


def parts(word: str) -> tuple[str, ...]:
    """A word, or if it is long its parts: every run of ``LONGEST - STEP`` letters is inside one."""
    if len(word) <= LONGEST:
        return (word,)
    return tuple(word[a : a + LONGEST] for a in range(0, len(word) - LONGEST + STEP, STEP))


def letters(token: str) -> str:
    return token if token.isalpha() else _NOT_LETTER.sub("", token)


# --- kernel ---------------------------------------------------------------


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters with a start mark, as numbers padded by 0; lengths."""
    marked = ["^" + w for w in words]
    n = np.array([len(w) for w in marked], dtype=np.int64)
    x = np.zeros((len(marked), int(n.max()) if len(n) else 1), dtype=np.int32)
    for i, w in enumerate(marked):
        x[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), dtype=np.int32)
    return x, n


def raw_kernel(x: np.ndarray, y: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of ``x`` with the row of ``y`` beside it."""
    n, a, b = len(x), x.shape[1], y.shape[1]
    same = (x[:, :, None] == y[:, None, :]) & (x[:, :, None] > 0)
    hit = np.where(same, decay * decay, 0.0)
    ends = hit  # weights of common subsequences that end at a pair of places
    for _ in range(order - 1):
        # sums of `ends` over all earlier pairs, decayed by the distance
        run = np.zeros((n, a + 1, b + 1))
        for i in range(a):
            row = np.zeros(n)
            for j in range(b):
                row = ends[:, i, j] + decay * row
                run[:, i + 1, j + 1] = row + decay * run[:, i, j + 1]
        ends = hit * run[:, :-1, :-1]
    return ends.sum(axis=(1, 2))


def letter_sets(x: np.ndarray) -> np.ndarray:
    """A bitmap of the characters of each row; a few characters share a bit."""
    bit = np.left_shift(np.uint64(1), (x & 63).astype(np.uint64))
    return np.bitwise_or.reduce(np.where(x > 0, bit, np.uint64(0)), axis=1)


def lcs_lengths(x: np.ndarray, stem: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each row of ``x`` with ``stem``, by bit-parallel steps over all rows."""
    m = len(stem)
    full = np.uint64((1 << m) - 1)
    masks = {int(c): np.uint64(sum(1 << i for i in range(m) if stem[i] == c)) for c in set(stem.tolist())}
    v = np.full(len(x), full, dtype=np.uint64)
    for j in range(x.shape[1]):
        col = x[:, j]
        mask = np.zeros(len(x), dtype=np.uint64)
        for c, bits in masks.items():
            mask[col == c] = bits
        u = v & mask
        v = ((v + u) | (v - u)) & full
    return m - np.bitwise_count(v).astype(np.int64)


def allowance(stem: str) -> int:
    """Letters of a stem that a word may lack and still be compared with it."""
    return 0 if len(stem) < 7 else 1


# --- model ----------------------------------------------------------------


@dataclass
class ToxicityModel:
    stems: list[str]  # landmarks of toxic training documents
    landmarks: list[str]  # these and ordinary words near them
    to_map: np.ndarray  # inverse square root of the landmarks' kernel
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def near_words(self, words: list[str]) -> list[str]:
        """Words that hold the letters of a stem in order, but for its allowance, and whose kernel with it is ``CLOSE`` at least."""
        out: set[str] = set()
        for a in range(0, len(words), 8192):
            part = words[a : a + 8192]
            x, _ = _codes(part)
            held = letter_sets(x)
            for s in self.stems:
                code = np.frombuffer(s.encode("utf-32-le"), dtype=np.int32)
                lacking = np.bitwise_count(letter_sets(code[None, :]) & ~held)
                at = np.flatnonzero(lacking <= allowance(s))
                at = at[lcs_lengths(x[at], code) >= len(code) - allowance(s)]
                if len(at):
                    y, _ = _codes([s])
                    k = raw_kernel(x[at], np.repeat(y, len(at), axis=0))
                    self_x, self_y = raw_kernel(x[at], x[at]), raw_kernel(y, y)
                    at = at[k >= CLOSE * np.sqrt(self_x * self_y)]
                    out.update(part[i] for i in at)
        return sorted(out)

    def kernels(self, words: list[str]) -> dict[str, np.ndarray]:
        """Normalised kernels with the landmarks of those words that come near a stem."""
        near = self.near_words(words)
        return dict(zip(near, kernel_matrix(near, self.landmarks), strict=True)) if near else {}

    def decide(self, k: np.ndarray) -> np.ndarray:
        return k @ self.to_map @ self.weights + self.bias

    def score(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -40, 40)))


def kernel_matrix(words: list[str], landmarks: list[str]) -> np.ndarray:
    x, _ = _codes(words)
    y, _ = _codes(landmarks)
    own_x, own_y = raw_kernel(x, x), raw_kernel(y, y)
    out = np.zeros((len(words), len(landmarks)))
    for a in range(0, len(words), 4096):
        part = x[a : a + 4096]
        for j in range(len(landmarks)):
            size = len(landmarks[j]) + 1
            out[a : a + 4096, j] = raw_kernel(part, np.repeat(y[j : j + 1, :size], len(part), axis=0))
    norm = np.sqrt(np.outer(np.maximum(own_x, 1e-12), np.maximum(own_y, 1e-12)))
    return out / norm


def kin_of(listed: list[list[str]], samples: int = 8) -> list[int]:
    """A cluster number of each document: near copies share one of several smallest hashes of three-word runs."""
    salts = np.random.default_rng(1).integers(0, 1 << 63, samples).astype(np.uint64)
    parent = list(range(len(listed)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first: dict[tuple[int, int], int] = {}
    for d, words in enumerate(listed):
        runs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))]
        h = np.array(runs, dtype=np.uint64)
        for j, salt in enumerate(salts):
            low = int(((h ^ salt) * np.uint64(0x9E3779B97F4A7C15)).min())
            a, b = root(first.setdefault((j, low), d)), root(d)
            parent[max(a, b)] = min(a, b)
    return [root(d) for d in range(len(listed))]


def find_stems(docs: list[set[str]], kin: list[int], toxic: np.ndarray) -> list[str]:
    """Words and word beginnings that mark toxic documents.

    One counts once for near copies, occurs in one of fifty toxic documents
    at least, hardly in others, and in so few others that among all words that
    were tried none is likely to do so by chance.  Of related ones the most frequent is taken,
    the longest if several are as frequent.
    """
    def features(words):
        return {w[:n] for w in words for n in (4, 5, 6) if len(w) > n} | {w for w in words if len(w) > 3}

    where: dict[str, set[int]] = defaultdict(set)
    for words, k, t in zip(docs, kin, toxic, strict=True):
        if t:
            for f in features(words):
                where[f].add(k)
    n_toxic, n_other = len({k for k, t in zip(kin, toxic, strict=True) if t}), int((~toxic).sum())
    least = max(3, n_toxic / 50)
    tried, share = len(where), n_toxic / max(1, n_toxic + n_other)
    where = {f: s for f, s in where.items() if len(s) >= least}
    misses: Counter[str] = Counter()
    for words, t in zip(docs, toxic, strict=True):
        if not t:
            misses.update(features(words) & where.keys())

    def by_chance(hits, other):
        n = hits + other
        return sum(math.comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(hits, n + 1))

    good = [f for f, s in where.items() if misses[f] / n_other <= 0.02 * len(s) / n_toxic and tried * by_chance(len(s), misses[f]) < 1]
    stems: list[str] = []
    for f in sorted(good, key=lambda f: (-len(where[f]), -len(f), f)):
        if len(stems) < MAX_STEMS and not any(f.startswith(s) or s.startswith(f) for s in stems):
            stems.append(f)
    return stems


def _variants(word: str, seed: int) -> list[str]:
    """A word with a character inserted, and with one doubled."""
    a = 1 + seed % max(1, len(word) - 1)
    return [word[:a] + "xqzkw"[seed % 5] + word[a:], word[:a] + word[a - 1] + word[a:]]


def train(texts: list[str], toxic: np.ndarray) -> ToxicityModel:
    low = [t.lower() for t in texts]
    listed = [words_of(t) for t in low]
    words = [set(w) for w in listed]
    stems = find_stems(words, kin_of(listed), toxic) if toxic.any() and not toxic.all() else []
    model = ToxicityModel(stems, list(stems), np.eye(len(stems)), np.zeros(len(stems)), -1.0, 1.0, 0.0)
    if not stems:
        return model
    every = sorted(set().union(*words), key=lambda w: (len(w), w))
    plain = set().union(*(w for w, t in zip(words, toxic, strict=True) if not t))
    close = {w: k.max() for w, k in model.kernels([w for w in every if w in plain]).items()}
    model.landmarks = stems + sorted(close, key=lambda w: (-close[w], w))[: 20 * MAX_PLAIN : 20]
    kmm = kernel_matrix(model.landmarks, model.landmarks)
    value, vector = np.linalg.eigh((kmm + kmm.T) / 2)
    model.to_map = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T

    def marked(w):
        return any(w.startswith(s) for s in stems)

    known = model.kernels(every)
    rows, label = [], []
    insults = set()
    for text, w, t in zip(low, words, toxic, strict=True):
        for sentence in _SENTENCE.split(text) if w & known.keys() else ():
            ws = words_of(sentence)
            k = [known[w] for w in ws if w in known]
            if not k:
                continue
            bad = [w for w in ws if marked(w)] if t else []
            if t and not bad:
                continue
            insults.update(bad if t else ())
            rows.append(np.max(k, axis=0))
            label.append(1.0 if t else -1.0)
    bent = [v for i, w in enumerate(sorted(insults)) for v in _variants(w, i)]
    bent = model.kernels(bent)
    rows += list(bent.values())
    label += [1.0] * len(bent)
    rows.append(np.zeros(len(model.landmarks)))
    label.append(-1.0)
    x, y = np.array(rows) @ model.to_map, np.array(label)
    share = np.ones(len(y))
    share[len(y) - 1 - len(bent) : len(y) - 1] = max(1.0, (y > 0).sum() / max(1, len(bent)))  # bent words weigh as much as all others
    model.weights, model.bias = fit_svm(x, y, share)
    top = np.array([document_decision(model, t, known if w & known.keys() else {}) for t, w in zip(low, words, strict=True)])
    model.slope, model.shift = fit_sigmoid(top, toxic.astype(float))
    return model


def fit_svm(x: np.ndarray, y: np.ndarray, share: np.ndarray, c: float = 20.0, steps: int = 600) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss and balanced classes, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    cost = 0.5 * c * share * np.where(y > 0, 1 / share[y > 0].sum(), 1 / share[y < 0].sum())
    reg = np.full(x.shape[1], 1e-3)
    reg[-1] = 1e-6
    step = 1 / (2 * np.linalg.eigvalsh((x * cost[:, None]).T @ x).max() + reg.max())
    w = v = np.zeros(x.shape[1])
    for i in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (reg * v - 2 * x.T @ (cost * y * slack))
        v = new + i / (i + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit_sigmoid(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a little ridge."""
    x = np.stack([s, np.ones(len(s))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.1 * w * [1, 0]
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.1, 1e-6])
        w = w - np.linalg.solve(h, g)
    return float(w[0]), float(w[1])


def document_decision(model: ToxicityModel, low: str, known: dict[str, np.ndarray]) -> float:
    """The largest decision value of the sentences of a lower-cased text that hold a word near a stem."""
    best = model.bias
    if known:
        rows = []
        for sentence in _SENTENCE.split(low):
            k = [known[w] for w in words_of(sentence) if w in known]
            if k:
                rows.append(np.max(k, axis=0))
        if rows:
            best = max(best, float(model.decide(np.array(rows)).max()))
    return best


# --- jobs -----------------------------------------------------------------

#: Words whose kernels a task keeps at a time.
_CACHE = 200_000


def _scores(model: ToxicityModel, keep_below: float | None = None):
    """Batches of (doc_id, text) to ids and scores; with a limit, batches with a text column to their rows below it."""

    def run(batches):
        done: set[str] = set()  # words seen lately
        close: dict[str, np.ndarray] = {}  # those near a stem
        for batch in batches:
            out = np.empty(batch.num_rows)
            texts = batch.column("text").to_pylist()
            for a in range(0, len(texts), 512):
                low = [(t or "").lower() for t in texts[a : a + 512]]
                tokens = [set(t.split()) for t in low]
                words = {t: parts(letters(t)) for t in set().union(*tokens)}
                spaced = [words_of(" ".join(m)) if (m := _SPACED_OUT.findall(t)) else () for t in low]
                if len(done) > _CACHE:
                    done, close = set(), {}
                new = set().union(*words.values(), *spaced) - done
                close.update(model.kernels(sorted((w for w in new if len(w) > 1), key=len)))  # short words need few columns
                done |= new
                hot = {t for t, ws in words.items() if any(w in close for w in ws)}
                for i, t in enumerate(low):
                    known = {w for x in tokens[i] & hot for w in words[x] if w in close}.union(w for w in spaced[i] if w in close)
                    out[a + i] = document_decision(model, t, {w: close[w] for w in known})
            if keep_below is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(out))], names=["doc_id", "score"])
            else:
                yield batch.filter(pa.array(model.score(out) < keep_below))

    return run


def _trained(batches):
    """The model of all rows (h, text, toxic), in one task; a text of several ids counts once, as not toxic if one label says so."""
    rows = [r for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: (-r["toxic"], r["h"], r["text"]))
    rows = list({r["text"]: r for r in rows}.values())
    model = train([r["text"] for r in rows], np.array([r["toxic"] == 1 for r in rows], dtype=bool))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> ToxicityModel:
    """Fit on labelled rows ``labels(doc_id, toxic)``: at most ``max_toxic`` and ``max_other`` of either label, in hash order.

    Null ids, labels and texts are left out; a document labelled twice counts as
    toxic if one label says so.  Without toxic rows, or without others, the
    model finds nothing.  One task trains; the driver gets the model alone.
    """
    one = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = hash_sample(one.where("toxic = 1"), max_toxic, "doc_id").union(hash_sample(one.where("toxic <> 1"), max_other, "doc_id")).withColumn("h", F.xxhash64("doc_id"))
    # the picked ids are bounded by the two limits, and so are the texts of ids that rows repeat
    x = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").select("h", "text", "toxic")
    x = hash_sample(x.distinct(), max_toxic + max_other, "text")
    made = x.repartition(1).mapInArrow(_trained, "model binary").first()
    return pickle.loads(made[0]) if made else train([], np.zeros(0, dtype=bool))


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` of every row of ``docs(doc_id, text)``.

    Null and empty texts get the score of a text without any word near a stem.
    Repeated rows get a row each; other columns are ignored.
    """
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(_scores(model), "doc_id long, score double")


def without_toxic(docs: DataFrame, model: ToxicityModel, limit: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns, in one pass."""
    return docs.mapInArrow(_scores(model, limit), docs.schema)
