"""Quality rules with cross-document line frequency.

Normalised lines are hashed and counted by the distinct documents of a host that
hold them; rows of equal text are one document there, or a text would become
boilerplate by being copied.  Lines above the limits are boilerplate: they are removed, and a
document that is depleted thereby is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm import bytewords as bw
from lapwing.llm.common import cut

#: A line is boilerplate if at least so many texts of its host hold it, and at least this share of them.
MIN_TEXTS, MIN_SHARE = 20, 0.02
#: A document is depleted if a larger share of its words goes with such lines.
MAX_REMOVED = 0.7
MIN_WORDS = 50

STATS = "doc_id long, host string, tk long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:long>>"
_SYMBOL = np.isin(bw.BYTES, list(b"#*$%&|<>"))
_FOLLOWS = (bw.BYTES & 0xC0) == 0x80


def line_key(line: bytes) -> int:
    """Hash of a line with case and white space folded, as a signed 64-bit number."""
    return xxhash.xxh64_intdigest(b" ".join(line.lower().split())) - (1 << 63)


def _repeats(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Words of each row inside 3-word windows that the row holds twice or more."""
    s, at = bw.windows(h, row, 3)
    if not len(at):
        return np.zeros(rows, np.int64)
    key = bw.keyed(row[at], s, bw.bits_of(rows))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.append(same, False) | np.append(False, same)
    at = at[order[twice]]
    covered = np.zeros(len(h), dtype=bool)
    for j in range(3):
        covered[at + j] = True
    return np.bincount(row[covered], minlength=rows)


def _stats(batches):
    for batch in batches:
        for a, b, buf, offs in bw.chunks(batch.column("text")):
            n = b - a
            row, begin, size, h = bw.find_words(buf, offs)
            words = np.bincount(row, minlength=n)
            edge = np.concatenate([[0], np.cumsum(bw.SPACED[buf] & ~_FOLLOWS[buf])])
            chars = edge[offs[1:]] - edge[offs[:-1]]
            edge = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
            symbols = edge[offs[1:]] - edge[offs[:-1]]
            repeated = _repeats(row, h, n)
            raw, dup, lines = buf.tobytes(), np.zeros(n, np.int64), []
            for i in range(n):
                seen: set[bytes] = set()
                counts: dict[int, int] = {}
                for line in raw[offs[i] : offs[i + 1]].split(b"\n"):
                    w = len(line.split())
                    if w:
                        dup[i] += line in seen
                        seen.add(line)
                        k = line_key(line)
                        counts[k] = counts.get(k, 0) + w
                lines.append([{"line": k, "words": w} for k, w in counts.items()])
            cols = [batch.column(c).slice(a, n) for c in ("doc_id", "host", "tk")]
            cols += [pa.array(x.astype(np.int64)) for x in (words, chars, symbols, dup, repeated)]
            cols.append(pa.array(lines, pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "host", "tk", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def frequent_lines(stats: DataFrame, min_texts: int = MIN_TEXTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, line, texts``: lines above the limits.  Copies of a text count once."""
    texts = stats.where("n_words > 0").groupBy("host", "tk").agg(F.first("lines").alias("lines"))
    total = texts.groupBy("host").agg(F.count("*").alias("total"))
    line = texts.select("host", F.explode("lines").alias("l")).groupBy("host", F.col("l.line").alias("line")).agg(F.count("*").alias("texts")).where(F.col("texts") >= min_texts)
    return line.join(total, line["host"].eqNullSafe(total["host"])).where(F.col("texts") >= min_share * F.col("total")).select(line["host"], "line", "texts")


def line_statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    """The base figures and the hashed lines of every document, made durable."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"))
    src = src.withColumn("tk", F.xxhash64("text", F.length("text")))
    return cut(src.mapInArrow(_stats, STATS), "lines")


def quality_rules(docs: DataFrame, host: str = "source", min_texts: int = MIN_TEXTS, min_share: float = MIN_SHARE, max_removed: float = MAX_REMOVED, min_words: int = MIN_WORDS) -> DataFrame:
    """Base figures and the verdict of every row of ``docs(doc_id, text, <host>)``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_removed_words``.  ``base_failed``:
    fewer than ``min_words`` words, or more than half of them in repeated 3-word
    windows.  ``kept``: not ``base_failed``, and at most ``max_removed`` of the
    words are in frequent lines of the document's host.

    Null text counts as empty and fails the base rules.  A null host is a host.
    Repeated rows each get their own row.  Other columns are ignored.
    """
    stats = line_statistics(docs, host)
    often = frequent_lines(stats, min_texts, min_share)
    # documents share a line list per (host, text); the lines of each pair are looked up once
    texts = stats.where("n_words > 0").groupBy("host", "tk").agg(F.first("lines").alias("lines")).select("host", "tk", F.explode("lines").alias("l")).select("host", "tk", "l.line", "l.words")
    often = often.select(F.col("host").alias("h"), F.col("line").alias("k"))
    gone = texts.join(often, texts["host"].eqNullSafe(often["h"]) & (texts["line"] == often["k"])).groupBy("host", "tk").agg(F.sum("words").alias("gone"))
    gone = gone.select(F.col("host").alias("h"), F.col("tk").alias("t"), "gone")
    x = stats.join(gone, stats["host"].eqNullSafe(gone["h"]) & (stats["tk"] == gone["t"]), "left")
    removed = F.coalesce("gone", F.lit(0).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (removed <= max_removed * F.col("n_words"))).alias("kept"), removed.alias("n_removed_words"))


def without_lines(docs: DataFrame, stats: DataFrame, often: DataFrame, host: str = "source") -> DataFrame:
    """``docs`` with the frequent lines of each document's host removed from ``text``.

    A null text stays null, lines without words stay, and rows of one id are
    judged by their own text and host.  All columns are kept, whatever their names.
    """
    hit = stats.groupBy("host", "tk").agg(F.first("lines").alias("lines")).select("host", "tk", F.explode("lines").alias("l")).select("host", "tk", "l.line")
    o = often.select(F.col("host").alias("h"), F.col("line").alias("k"))
    drop = hit.join(o, hit["host"].eqNullSafe(o["h"]) & (hit["line"] == o["k"])).groupBy("host", "tk").agg(F.collect_set("line").alias("drop"))
    text = F.col(f"row.{docs.columns[[c.lower() for c in docs.columns].index('text')]}").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(host).cast("string").alias("own_host"))
    rows = rows.withColumn("own_tk", F.xxhash64(text, F.length(text)))
    joined = rows.join(drop, rows["own_host"].eqNullSafe(drop["host"]) & (rows["own_tk"] == drop["tk"]), "left")

    def strip(batches):
        for batch in batches:
            row = batch.column("row")
            names = [f.name for f in row.type]
            cols = {n: row.field(i) for i, n in enumerate(names)}
            out = []
            for text, gone in zip(cols["text"].to_pylist(), batch.column("drop").to_pylist(), strict=True):
                if text is not None and gone:
                    bad = set(gone)
                    text = "\n".join(x for x in text.split("\n") if not x.strip() or line_key(x.encode()) not in bad)
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, cols[n].type) if n == "text" else cols[n] for n in names], names=names)

    return joined.select("row", "drop").mapInArrow(strip, docs.schema)
