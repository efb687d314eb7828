"""Plain versions and edge cases of the manifest, the trie and the language model."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lapwing.llm import language_model, merkle, prefix_trie
from lapwing.llm.merkle import Manifest, document_items, document_proofs

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, pos string, leaf string, block string"
CHAT = "conv_id long, turn long, role string, text string, depth string, rank string, start string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for nodes in levels[:-1]:
        a = i // 8 * 8
        yield "".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])
        i //= 8


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_proofs(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of each of ``rows(doc_id, text, lang, source, n_chars)``."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(field(v) for v in (r[0], r[3], r[2], r[4], t)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    for v in langs:
        groups[v].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {v: climb([leaf(r, r[1]) for r in groups[v]]) for v in langs}
    top = climb([trees[v][-1][0] for v in langs])
    out = []
    for k, v in enumerate(langs):
        for i, r in enumerate(groups[v]):
            steps = [*siblings(trees[v], i), *siblings(top, k)]
            x = trees[v][0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                x = leaf(r, None if r[1] is None else r[1].translate(LOW))
            for a, b in steps:
                x = sha(a + x + b)
            out.append((r[0], trees[v][0][i], trees[v][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), x))
    return sorted(out, key=str)


def documents(n):
    rng = random.Random(4)
    rows = [(i, f"Text {rng.random()}" + " A" * rng.randint(0, 4), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", None]), i % 7) for i in range(n)]
    rows += [(None, "no id", "en", "a", 1), (None, "no id", "en", "a", 1), (5, "again", "en", "a", None), (9, None, "é", "a", 3), (12, "", "Z", None, None), (3, "Q" * 300_000, "fr", "a", 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], DOCS)


CRC3 = "crc32(string(doc_id)) % 3 = 0"


def test_document_proofs(spark):
    rows = documents(1500)  # more than two blocks of one lang
    got = document_proofs(frame(spark, rows), F.expr(CRC3)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == plain_proofs(rows)
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    assert any(not r["verified"] for r in got)
    assert document_proofs(frame(spark, []), F.expr(CRC3)).count() == 0


def test_manifest_grows_by_batches(spark, tmp_path):
    """Batches of a stream, one of them offered twice, and a manifest opened anew, give the tree of all rows at once."""
    rows = [(i, f"t{i}", "en" if i % 3 else "de", "a", i) for i in range(1300)]
    where = str(tmp_path / "manifest")
    for k, (a, b) in enumerate([(0, 1), (1, 600), (600, 601), (601, 1300)]):
        m = Manifest(spark, where)
        items = document_items(frame(spark, rows[a:b]), F.expr(CRC3)).cache()
        for _ in range(2):
            m.append(items, [F.col("id").cast("long"), F.col("digest"), F.col("row")], f"b{k}")
    got = [(int(r["id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in Manifest(spark, where).proofs().collect()]
    assert sorted(got, key=str) == plain_proofs(rows)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 512])
def test_frontier(n):
    leaves = [sha(str(i)) for i in range(n)]
    f = merkle.Frontier()
    for x in leaves:
        f.append(x)
    assert f.finish(alone=True) == climb(leaves)[-1][0]
    assert [list(siblings(climb(leaves), i)) for i in range(n)] == f.witness


def plain_trie(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [x[1:] for x in sorted(v)] for c, v in turns.items()}
    paths, nodes, kids = {}, {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = turns.get(c - c % 5, [])[:h] + own[h:]
        for d in range(len(paths[c]) + 1):
            nodes.setdefault(tuple(paths[c][:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    below = {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        under = [below[q] for q in kids.get(p, [])]
        below[p] = (sum(u[0] for u in under) or 1, own + sum(u[1] for u in under))
    return sorted(
        (
            (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *below[p], sha(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))))
            for p, m in nodes.items()
        ),
        key=str,
    )


def chat(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CHAT)


def trie(spark, rows):
    c = F.col("conv_id")
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(chat(spark, rows), c - c % 5, F.crc32(c.cast("string")) % 9, 8).collect()), key=str)


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CELL", 3)  # conversations in several cells, lists in several pieces
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "tool"]), rng.choice("ab")) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(100 + c, t, "user", "é" * t) for c in range(20) for t in range(10)]  # copies
    rows += [(7, None, None, "x"), (7, 0, "user", None), (None, 1, "user", "lost"), (503, 1, "a", "b"), (503, 1, "a", "b"), (601, 3, None, None), (77, 1, "u", "v" * 200_000)]
    assert trie(spark, rows) == plain_trie(rows)
    assert trie(spark, []) == []


def test_prefix_trie_tries_another_seed(spark, monkeypatch):
    """Hashes that clash for one seed only: the trie is built from the next."""
    real = prefix_trie._hashed

    def clash(turns, seed):
        x = real(turns, seed)
        return x.withColumns({"t0": F.lit(1).cast("long"), "t1": F.lit(2).cast("long")}) if seed == 0 else x

    monkeypatch.setattr(prefix_trie, "_hashed", clash)
    rows = [(0, 0, "user", "a"), (5, 0, "user", "b"), (10, 0, "user", "a"), (10, 1, "user", "c")]
    assert trie(spark, rows) == plain_trie(rows)


class PlainModel:
    """Dictionaries of n-grams, one token at a time."""

    def __init__(self, texts, order=3):
        self.order = order
        self.grams = [Counter() for _ in range(order)]
        self.states = [Counter() for _ in range(order)]
        for t in texts:
            for h, w in self.steps(t):
                for n in range(order):
                    self.grams[n][h[len(h) - n :] + (w,)] += 1
                    self.states[n][h[len(h) - n :]] += 1
        self.size, self.types = self.states[0][()], len(self.grams[0])
        have, once = Counter(), Counter()
        for n in range(order):
            for g, c in self.grams[n].items():
                k = (n, self.level(self.states[n][g[:-1]]))
                have[k] += c
                once[k] += c == 1
        self.fail = {k: (once[k] + 1) / (have[k] + 2) for k in have}

    def steps(self, text):
        words = [*text.translate(LOW).split(), "</s>"]
        past = tuple(f"<s{i}>" for i in range(self.order - 1))
        for w in words:
            yield past, w
            past = (past + (w,))[1:] if self.order > 1 else ()

    @staticmethod
    def level(c):
        return c if c < 8 else 5 + int(math.log2(c))

    def p(self, h, w, n):
        if n < 0:
            return 1 / (self.types + 1)
        state = h[len(h) - n :]
        c = self.states[n][state]
        if not c:
            return self.p(h, w, n - 1)
        m = self.fail[(n, self.level(c))]
        return (1 - m) * self.grams[n][state + (w,)] / c + m * self.p(h, w, n - 1)

    def score(self, text):
        return sum(math.log10(self.p(h, w, self.order - 1)) for h, w in self.steps(text))

    def base(self, text):
        return sum(math.log10((self.grams[0][(w,)] + 1) / (self.size + self.types + 1)) for _, w in self.steps(text))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "B", "c", "dd", "é", "漢"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += [None, "", " \t\n", "a b c " * 20_000, "never seen", texts[3], texts[3]]
    rows = [(i if i != 8 else None, t, "en", "s", None) for i, t in enumerate(texts)]
    learn = F.col("doc_id") % 4 != 1
    got = language_model.scores(frame(spark, rows), learn, order, block_bytes=300, bucket_bytes=1000).collect()
    plain = PlainModel([t or "" for i, t, *_ in rows if i is not None and i % 4 != 1], order)
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r, words = by[i], [w for _, w in plain.steps(t or "")]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum((w,) in plain.grams[0] for w in words), plain.size)
        assert r["base_score"] == pytest.approx(plain.base(t or ""), rel=1e-9)
        assert r["score"] == pytest.approx(plain.score(t or ""), rel=1e-9)
    # after any context the tokens, an unknown one among them, have probabilities that sum to one
    for h in [("a", "b"), ("zz", "a"), ("zz", "zz")]:
        assert sum(plain.p(h[3 - order :], w, order - 1) for w in [*{g[0] for g in plain.grams[0]}, "unknown"]) == pytest.approx(1)


def test_scores_without_training(spark):
    rows = [(1, "a b", "en", "s", None), (1, "a b", "en", "s", None)]
    got = language_model.scores(frame(spark, rows), F.lit(False)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 2
    assert language_model.scores(frame(spark, []), F.lit(True)).count() == 0
