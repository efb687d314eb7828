"""Token ids in binary files compressed by Re-Pair grammars.

Documents are put in ascending ``doc_id`` order and their ids are cut into
shards of whole documents.  In each shard frequent pairs of ids are replaced by
nonterminals until no pair occurs twice; a shard stores its rules, their
expansion lengths and the remaining symbols.  No rule spans an end id, so that
any document can be decoded alone.

A file is a Parquet table of shards in the shared folder.  Grammar layout,
little-endian: magic ``RPG2``, base (u4; below it are tokens, the last
of them the end of a document), end id (u4), rules (u4), symbols (u4), documents
(u4); then the rules' left and right symbols, their expansion lengths, the first
symbol of each document and one end offset, and the symbols.  Each of the five
is a byte that tells how many bytes a number takes, and then the numbers' lowest
bytes, their second ones, and so on, which the file's compression shrinks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.llm.common import new_path

END_ID = 2
SHARD_TOKENS = 1 << 17
MAGIC = b"RPG2"

# --- encoding -------------------------------------------------------------

#: Words that an encoder keeps in either of two generations, and between tasks.
CACHE, KEPT = 300_000, 100_000
#: A run of Latin letters, a run of punctuation, or both, of lower-cased UTF-8 bytes.
_SIMPLE = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)?([!-/:-@\[-`{-~]+)?")
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_encoders: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The visible character that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Bytes of a word to the bytes of its ids (u4); texts are split at ASCII white space.

    No pre-token of this vocabulary spans white space, so the ids of a text are
    those of its words.  Words seen lately are looked up; of new ones, a run of
    Latin letters, a run of punctuation, or both go to the vocabulary's merges
    directly, all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.letters = _byte_letters()
        self.before: dict[bytes, bytes] = {}  # the words of the last generation

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            core = word.rstrip(_MARKS)
            if core.isalpha():  # bytes: ASCII letters only
                ids = self[core] + self[word[len(core) :]] if len(core) < len(word) else self._run(word)
            elif (simple := _SIMPLE.fullmatch(word)) is None:
                ids = array("I", self.whole.encode(word.decode(), add_special_tokens=False).ids).tobytes()
            else:
                a, b = simple.groups()
                ids = self[a] + self[b] if a and b else self._run(word)
        if len(self) >= CACHE:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def rest(self) -> None:
        """Keep the words seen first, mostly frequent ones, and let the others go: a worker outlives its task."""
        self.before = dict(islice(chain(self.before.items(), self.items()), KEPT))
        self.clear()

    def _run(self, run: bytes) -> bytes:
        """The ids of letters or punctuation alone, by the vocabulary's merges."""
        shown = run.decode() if run.isascii() else "".join([self.letters[b] for b in run.decode().lower().encode()])
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def ids(self, text: str) -> np.ndarray:
        raw = text.encode()
        if b"<|" not in raw:  # else case tells a special token from plain text
            raw = raw.lower()
        return np.frombuffer(b"".join(map(self.__getitem__, raw.split())), dtype="<u4")


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- grammar --------------------------------------------------------------


def _packed(a: np.ndarray) -> bytes:
    wide = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
    return bytes([wide]) + a.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide].T.tobytes()


def _unpacked(blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """``n`` numbers that :func:`_packed` put at ``at``, and where they end."""
    wide = blob[at]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :wide] = np.frombuffer(blob, np.uint8, n * wide, at + 1).reshape(wide, n).T
    return out.view("<i8")[:, 0], at + 1 + n * wide


def _sorted_pairs(x: np.ndarray, at: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of symbols below ``top`` at the places ``at``, left one in the upper 32 bits, sorted, and their places."""
    wide, tall = int(top).bit_length(), len(x).bit_length()
    if 2 * wide + tall > 63:
        code = (x[at] << 32) | x[at + 1]
        order = np.argsort(code, kind="stable")
        return code[order], at[order]
    both = (((x[at] << wide) | x[at + 1]) << tall) | at  # sorting one array of numbers is several times as fast
    both.sort()
    code = both >> tall
    return ((code >> wide) << 32) | (code & ((1 << wide) - 1)), both & ((1 << tall) - 1)


def replace_pairs(x: np.ndarray, end: int, top: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Re-Pair: left and right symbols of the rules of each round, numbered from ``top``, and what is left of ``x``.

    A round counts all pairs, occurrences that overlap once, and ranks them by
    their number; an occurrence is replaced if it outranks the ones it overlaps
    with, so that the most frequent pair goes entirely and many others with it.
    Rounds follow until no pair occurs twice.  No pair holds the symbol ``end``.

    Pairs of old symbols only get rarer, so a pair found once is not counted again.
    """
    lefts, rights = [], []
    open_ = np.ones(len(x), dtype=bool)  # first places of pairs to be counted
    while True:
        at = np.flatnonzero(open_[:-1] & (x[:-1] != end) & (x[1:] != end))
        if len(at) < 2:
            break
        code, at = _sorted_pairs(x, at, top)
        head = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        count = np.diff(np.append(head, len(code)))
        often = np.repeat(count >= 2, count)
        pair = np.full(len(x) + 1, -1, dtype=np.int64)  # the last place is before the first one, too
        pair[at[often]] = np.repeat(np.arange(len(head)), count)[often]
        place = np.flatnonzero(pair[:-1] >= 0)
        own = pair[place]
        if not len(place):
            break
        # of a run of one pair that overlaps itself, the first, third, ... count
        begins = pair[place - 1] != own
        start = place[begins][np.cumsum(begins) - 1]
        counts = (place - start) % 2 == 0
        n = np.bincount(own[counts], minlength=len(head))
        live = n[own] >= 2
        rank = np.zeros(len(x) + 1, dtype=np.int64)
        rank[place] = np.where(live, (n[own] << 32) | (own + 1), 0)
        mine = rank[place]
        take = live & counts & (mine >= rank[place - 1]) & (mine >= rank[place + 1])
        n = np.bincount(own[take], minlength=len(head))
        take &= n[own] >= 2
        if not take.any():
            break
        used = np.flatnonzero(n >= 2)
        new = np.zeros(len(head), dtype=np.int64)
        new[used] = top + np.arange(len(used))
        top += len(used)
        lefts.append(code[head[used]] >> 32)
        rights.append(code[head[used]] & 0xFFFFFFFF)
        open_[:] = False
        open_[place[live]] = True
        at = place[take]
        x[at] = new[own[take]]
        open_[at] = open_[at - 1] = True
        rest = np.ones(len(x), dtype=bool)
        rest[at + 1] = False
        x, open_ = x[rest], open_[rest]
    return lefts, rights, x


def compress(docs: list[np.ndarray], end_id: int = END_ID) -> bytes:
    """The grammar of a shard of documents, to each of which decoding appends ``end_id``.

    The end has a symbol of its own, ``base - 1``: ``end_id`` may occur in texts.
    """
    end = max((int(d.max()) for d in docs if len(d)), default=0) + 1
    x = np.concatenate([y for d in docs for y in (d, [end])]).astype(np.int64) if docs else np.zeros(0, np.int64)
    base = end + 1
    lefts, rights, x = replace_pairs(x, end, base)
    left = np.concatenate(lefts) if lefts else np.zeros(0, np.int64)
    right = np.concatenate(rights) if rights else np.zeros(0, np.int64)
    top = base + len(left)
    length = np.ones(top, np.int64)
    done = base
    for a, b in zip(lefts, rights, strict=True):
        length[done : done + len(a)] = length[a] + length[b]
        done += len(a)
    first = np.append(0, np.flatnonzero(x == end) + 1)
    head = np.array([base, end_id, len(left), len(x), len(docs)], dtype="<u4").tobytes()
    return MAGIC + head + b"".join(map(_packed, (left, right, length[base:], first, x)))


class Grammar:
    """A shard's grammar: ``ids(k)`` decodes document ``k`` alone, ``count(k)`` gives its length without decoding."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a grammar file")
        self.base, self.end_id, rules, symbols, self.docs = (int(v) for v in np.frombuffer(blob, "<u4", 5, 4))
        at, parts = 24, []
        for n in (rules, rules, rules, self.docs + 1, symbols):
            part, at = _unpacked(blob, at, n)
            parts.append(part)
        self.left, self.right, self.length, self.first, self.symbols = parts

    def _lengths(self, x: np.ndarray) -> np.ndarray:
        n = np.ones(len(x), np.int64)
        rule = x >= self.base
        n[rule] = self.length[x[rule] - self.base]
        return n

    def count(self, k: int) -> int:
        return int(self._lengths(self.symbols[self.first[k] : self.first[k + 1]]).sum())

    def expand(self, x: np.ndarray) -> np.ndarray:
        """The ids of symbols: each rule puts its left symbol at its own place and its right one behind that one's ids."""
        wide = self._lengths(x)
        to = np.cumsum(wide) - wide
        out = np.empty(int(wide.sum()), np.int64)
        out[to] = x
        at = to[x >= self.base]
        while len(at):
            rule = out[at] - self.base
            a, b = self.left[rule], self.right[rule]
            behind = at + self._lengths(a)
            out[at] = a
            out[behind] = b
            at = np.concatenate([at[a >= self.base], behind[b >= self.base]])
        return np.where(out == self.base - 1, self.end_id, out).astype("<u4")

    def ids(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.first[k] : self.first[k + 1]])


# --- jobs -----------------------------------------------------------------

SHARD = "part int, seq int, doc_ids array<long>, n_tokens long, grammar binary"


def _shards(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]):
        enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        ids, docs, held = [], [], 0

        def shard():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.int64()), pa.array([compress(docs, end_id)], pa.binary())], names=["part", "seq", "doc_ids", "n_tokens", "grammar"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = enc.ids(text.as_py() or "")
                ids.append(doc_id)
                docs.append(got)
                held += len(got) + 1
                if held >= shard_tokens:
                    yield shard()
                    ids, docs, held, seq = [], [], 0, seq + 1
        if docs:
            yield shard()
        enc.rest()

    return run


def write_token_files(docs: DataFrame, where: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs(doc_id, text)`` and write the shards to the folder ``where``.

    Null text is empty: only the end id.  Null ids come first; rows that repeat
    an id follow each other by their text.  Other columns are ignored.
    """
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    x = x.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    x.mapInArrow(_shards(tokenizer, end_id, shard_tokens), SHARD).write.option("compression", "zstd").parquet(where)


def read_token_files(spark, where: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files; ``ids`` too if asked."""
    files = spark.read.schema(SHARD).parquet(where)
    size = files.select("part", "seq", "n_tokens")
    parts = size.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a written file
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = size.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("off")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("off")).alias("start"))

    def decode(batches):
        for batch in batches:
            for part, seq, doc_ids, blob in zip(batch.column("part"), batch.column("seq"), batch.column("doc_ids"), batch.column("grammar"), strict=True):
                g = Grammar(blob.as_py())
                all_ids = g.expand(g.symbols)
                n = np.add.reduceat(g._lengths(g.symbols), g.first[:-1]) if g.docs else np.zeros(0, np.int64)
                ends = np.cumsum(n)
                raw = all_ids.tobytes()
                cols = {
                    "doc_id": pa.array(doc_ids.as_py(), pa.int64()),
                    "part": pa.array([part.as_py()] * g.docs, pa.int32()),
                    "seq": pa.array([seq.as_py()] * g.docs, pa.int32()),
                    "off": pa.array(ends - n),
                    "n_tokens": pa.array(n),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends, n, strict=True)], pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.array([all_ids[e - k : e] for e, k in zip(ends, n, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, part int, seq int, off long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    out = files.select("part", "seq", "doc_ids", "grammar").mapInArrow(decode, schema).join(start, ["part", "seq"])
    return out.select("doc_id", (F.col("start") + F.col("off")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return what they hold, document by document."""
    where = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, where, tokenizer, end_id, shard_tokens)
    return read_token_files(docs.sparkSession, where)
