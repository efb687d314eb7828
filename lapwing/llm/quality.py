"""Quality classifier: a sparse rule ensemble.

Shallow boosted trees over document statistics are cut into their paths; each
path is a conjunctive rule, a lasso logistic regression gives the rules their
weights, and the rules with a weight are compiled into one Spark column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.llm import bytewords as bw
from lapwing.llm.common import cut, hash_sample

#: Bound of the training sample, in rows.
MAX_ROWS = 20_000
TREES, DEPTH, CUTS, SHRINK = 24, 3, 24, 0.3
LASSO = 0.002

STATS = ("n_words", "word_bytes", "symbols", "upper", "digits", "marks", "stops", "foreign", "distinct", "repeats", "again", "line_words", "dup_lines")
_UPPER = (bw.BYTES >= 0x41) & (bw.BYTES <= 0x5A)
_DIGIT = (bw.BYTES >= 0x30) & (bw.BYTES <= 0x39)
_SYMBOL = np.isin(bw.BYTES, list(b"#*$%&|<>@^~_={}[]\\"))
_MARK = np.isin(bw.BYTES, list(b"!?"))
_STOP = np.isin(bw.BYTES, list(b".,;:"))
_LINE = bw.BYTES != 0x0A


def _stats(batches):
    for batch in batches:
        for a, b, buf, offs in bw.chunks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x) for x in statistics(buf, offs))], names=["doc_id", *STATS])


def statistics(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The columns ``STATS`` for the texts of a chunk; ratios are of the words, bytes or lines, 0 without any."""
    rows = len(offs) - 1
    row, _, size, h = bw.find_words(buf, offs)
    n = np.bincount(row, minlength=rows).astype(float)
    words, nbytes = np.maximum(n, 1), np.maximum(np.diff(offs), 1)

    def count(lut):
        edge = np.concatenate([[0], np.cumsum(lut[buf])])
        return edge[offs[1:]] - edge[offs[:-1]]

    def unequal(hashes, where):
        bits = bw.bits_of(rows)
        return np.bincount((bw.distinct(bw.keyed(where, hashes, bits)) >> np.uint64(64 - bits)).astype(np.int64), minlength=rows)

    tri, at = bw.windows(h, row, 3)
    n_tri = np.bincount(row[at], minlength=rows)
    same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) if len(h) else []
    line_row, _, _, line = bw.find_words(buf, offs, _LINE)
    lines = np.bincount(line_row, minlength=rows)
    return [
        n,
        np.bincount(row, size, minlength=rows) / words,
        count(_SYMBOL) / words,
        count(_UPPER) / nbytes,
        count(_DIGIT) / nbytes,
        count(_MARK) / words,
        count(_STOP) / words,
        count(bw.BYTES >= 0x80) / nbytes,
        unequal(h, row) / words,
        1 - unequal(tri, row[at]) / np.maximum(n_tri, 1) * (n_tri > 0) - (n_tri == 0),
        np.bincount(row[same], minlength=rows) / words if len(h) else n,
        n / np.maximum(lines, 1),
        1 - unequal(line, line_row) / np.maximum(lines, 1) * (lines > 0) - (lines == 0),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``STATS`` of every row; null text counts as empty."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(_stats, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, greater, limit) ...


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule, rules: list[Rule], f: np.ndarray, rows: np.ndarray) -> None:
    """Split on the best gain; add every node's path as a rule and the leaf's step to ``f``."""
    best = (1e-6, 0, 0.0)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 20:
        whole = total_g**2 / (total_h + 1)
        for j, limits in enumerate(cuts):
            if not len(limits):
                continue
            place = np.searchsorted(limits, x[rows, j], side="left")  # value > limits[place - 1]
            sg = np.cumsum(np.bincount(place, g[rows], minlength=len(limits) + 1))[:-1]
            sh = np.cumsum(np.bincount(place, h[rows], minlength=len(limits) + 1))[:-1]
            gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - whole
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(limits[k]))
    if best[2:] == (0.0,) and best[0] <= 1e-6:
        f[rows] += SHRINK * -total_g / (total_h + 1)
        return
    _, j, limit = best
    over = x[rows, j] > limit
    for greater, part in ((False, rows[~over]), (True, rows[over])):
        step = (*path, (j, greater, limit))
        rules.append(step)
        _grow(x, g, h, cuts, depth - 1, step, rules, f, part)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct paths of boosted trees for the logistic loss."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    cuts = [np.unique(np.concatenate([c, [(c[i] + c[i + 1]) / 2 for i in range(len(c) - 1)]])) for c in cuts]
    f, rules = np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        _grow(x, p - y, np.maximum(p * (1 - p), 1e-6), cuts, DEPTH, (), rules, f, np.arange(len(x)))
    return sorted({tuple(sorted(r)) for r in rules})


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, greater, limit in rule:
        out &= (x[:, j] > limit) == greater
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = 800) -> tuple[np.ndarray, float]:
    """Weights by accelerated proximal steps; the intercept is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    step = 4 / max(np.linalg.eigvalsh(x.T @ x / len(x)).max(), 1e-9)
    w = v = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], step * penalty)
    shrink[-1] = 0
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        new = v - step * (x.T @ (p - y) / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        v = new + i / (i + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The probability of label 1 as a Spark column over ``STATS``."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            cond = F.lit(True)
            for j, greater, limit in rule:
                cond &= F.col(STATS[j]) > limit if greater else F.col(STATS[j]) <= limit
            total += F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATS[j]} {'>' if up else '<='} {v:.4g}" for j, up, v in r) for r, w in zip(self.rules, self.weights, strict=True)]


def train_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """One label only, no rows, or no split: a model without rules that gives label 1's share, 0.5 for no rows."""
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return RuleModel([], [], float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    if not rules:  # too few rows, or none that statistics tell apart
        return RuleModel([], [], float(np.log(share / (1 - share))))
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    _, first = np.unique(z, axis=1, return_index=True)  # rules that hold on the same rows
    first = np.sort(first)
    w, bias = lasso_logistic(z[:, first], y)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([rules[first[k]] for k in keep], [float(w[k]) for k in keep], bias)


def fit_quality(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleModel:
    """Fit on ``labels(doc_id, quality)`` joined to ``stats``: at most ``max_rows`` labelled ids, in hash order; equal rows count once."""
    one = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    picked = hash_sample(one, max_rows, "doc_id")
    x = stats.join(F.broadcast(picked), "doc_id").select("quality", *STATS).distinct()
    x = hash_sample(x, max_rows, "quality", *STATS).toPandas().sort_values(["quality", *STATS])
    return train_rules(x[list(STATS)].to_numpy(float), x["quality"].to_numpy(float))


def quality(docs: DataFrame, labels: DataFrame, train: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, score`` of every row of ``docs(doc_id, text)``; labels are read where ``train`` holds on their ``doc_id``.

    Null text scores as an empty one.  Repeated rows get a row each; a document
    labelled more than once has its largest label; null ids have none, and are
    scored.  Without a label of either kind, all rows get one score.  Other
    columns are ignored.
    """
    stats = cut(document_statistics(docs), "stats")
    model = fit_quality(stats, labels.where(train), max_rows)
    return stats.select("doc_id", model.column().alias("score"))
