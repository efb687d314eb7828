"""Sentences, paragraphs, headings and other pieces of a text, with their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lapwing.functions import text as t
from lapwing.operators.phrases import mostly_common

_DOT, _END = "\ue000", "\ue001"  # of a private range; dropped from the input
#: The dot of an abbreviation, looked back from; that of ``e.g.`` is none where its first letter ends ``i.e.``.
ABBREVIATED = r"(?i)\.(?<=(?:i\.e|al|vs|dr|mr|ms|prof|fig|tab)\.|(?<!i\.)e\.g\.)"
REFERENCES = r"(?is)([\r\n]+|^)\s*(references|bibliography|works cited)\s*[\r\n]+.*$"


def body(c: Column) -> Column:
    """The text before the first line that opens a reference section."""
    cut = F.regexp_replace(c, REFERENCES, "")
    return F.when(F.length(cut) < F.length(c), t.strip_space(cut)).otherwise(c)


def references(c: Column) -> Column:
    cut = F.regexp_replace(c, REFERENCES, "")
    return F.when(F.length(cut) < F.length(c), t.strip_space(F.substr(c, F.length(cut) + 1))).otherwise(F.lit(""))


def sentence_pieces(c: Column) -> Column:
    """A text cut after sentence ends and before blank lines; joined again, the pieces are the text."""
    x = F.translate(c, _DOT + _END, "")
    for _ in range(2):
        x = F.regexp_replace(x, r"([0-9])\.([0-9])", f"$1{_DOT}$2")
    x = F.regexp_replace(x, ABBREVIATED, _DOT)
    x = F.regexp_replace(x, r"([.!?][.!?)\"'\]”]*)", f"$1{_END}")
    x = F.regexp_replace(x, r"(:)(\s[A-Z])", f"$1{_END}$2")
    x = F.regexp_replace(x, r"(\n\s*\n)", f"{_END}$1")
    return F.transform(F.split(x, _END), lambda p: F.translate(p, _DOT, "."))


def sentence_spans(docs: DataFrame, least: int = 3) -> DataFrame:
    """``doc_id, idx, text, start_char, end_char, paragraph`` of the sentences of ``docs(doc_id, text)``.

    Offsets are running sums of the pieces' lengths.  Pieces of fewer than
    ``least`` characters are left out.
    """
    p = docs.select("doc_id", F.posexplode(sentence_pieces(F.col("text"))).alias("piece", "p"))
    before = Window.partitionBy("doc_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("at", F.coalesce(F.sum(F.length("p")).over(before), F.lit(0)))
    p = p.withColumn("paragraph", F.sum(F.col("p").rlike(r"^\n\s*\n").cast("int")).over(Window.partitionBy("doc_id").orderBy("piece")))
    start = F.col("at") + F.length("p") - F.length(F.ltrim("p", F.lit(t.SPACE)))
    p = p.select("doc_id", "piece", t.fold_space(F.col("p")).alias("text"), start.alias("start_char"), (F.col("at") + F.length(F.rtrim("p", F.lit(t.SPACE)))).alias("end_char"), "paragraph").where(F.length("text") >= least)
    idx = (F.row_number().over(Window.partitionBy("doc_id").orderBy("piece")) - 1).alias("idx")
    return p.select("doc_id", idx, "text", "start_char", "end_char", "paragraph")


def quote_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, start_char, end_char`` of the quotations of ``docs(doc_id, text)``: the quotes and the text between them, cut out, are the text."""
    c = F.col("text")
    marked = F.regexp_replace(F.translate(c, _DOT + _END, ""), f"({t.QUOTE_SPANS})", f"{_END}{_DOT}$1{_END}")
    p = docs.select("doc_id", F.posexplode(F.split(marked, _END)).alias("piece", "p"))
    p = p.withColumn("is_quote", F.startswith("p", F.lit(_DOT))).withColumn("n", F.length("p") - F.col("is_quote").cast("int"))
    before = Window.partitionBy("doc_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("start_char", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return p.where("is_quote").select("doc_id", "start_char", (F.col("start_char") + F.col("n")).alias("end_char"))


def in_quotes(spans: DataFrame, quotes: DataFrame) -> DataFrame:
    """``spans`` with ``in_quote``: whether they overlap a quotation.

    Quotations of a document do not overlap each other, so of those that begin
    before a span's end only the last can: a running value finds it in one sort.
    """
    q = quotes.select("doc_id", F.col("start_char").alias("at"), F.lit(0).alias("kind"), F.col("end_char").alias("quote_end"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("long").alias("from"))
    e = spans.select("doc_id", F.col("end_char").cast("long").alias("at"), F.lit(-1).alias("kind"), F.lit(None).cast("long").alias("quote_end"), F.col("idx").cast("int").alias("idx"), F.col("start_char").cast("long").alias("from"))
    w = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = q.unionByName(e).withColumn("last", F.last("quote_end", True).over(w)).where("kind = -1")
    hit = x.select("doc_id", "idx", F.coalesce(F.col("last") > F.col("from"), F.lit(False)).alias("in_quote"))
    return spans.join(hit, ["doc_id", "idx"])


def span_flags(spans: DataFrame, prompt: Column | None = None) -> DataFrame:
    """The spans with their tests as columns; with ``in_quote``, such spans are quoted, too."""
    c = F.col("text")
    quoted = t.is_quoted_or_cited(c)
    if "in_quote" in spans.columns:
        quoted = quoted | F.col("in_quote")
    x = mostly_common(spans.withColumn("tokens", t.tokens(c)), ["doc_id", "idx"])
    common = F.col("mostly") | t.is_definition(c)
    return x.select(*spans.columns, t.is_heading(c).alias("is_heading"), t.is_prompt(c, prompt).alias("is_prompt"), t.is_formula(c).alias("is_formula"), quoted.alias("is_quoted"), c.rlike(t.CITED).alias("is_cited"), common.alias("is_common"))


def rechunked(spans: DataFrame, most: int = 50, size: int = 40, overlap: int = 10, most_chars: int = 250, chars: int = 180, char_overlap: int = 30, least: int = 5) -> DataFrame:
    """Spans of more than ``most`` tokens cut into runs of ``size`` words, and dense ones of more than ``most_chars`` characters into
    runs of ``chars``; each begins ``overlap`` before the last one's end and keeps the flags; ``idx`` counts anew.
    """
    def starts(n, step, back):
        last = F.greatest(F.lit(0), F.ceil((n - back) / step).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)

    x = spans.withColumn("_w", F.split("text", " ")).withColumn("_n", F.size(t.tokens(F.col("text"))))
    wide, long_ = F.size("_w"), F.length("text")
    n_chars = F.col("end_char") - F.col("start_char")

    def at(i):
        return F.least(F.col("end_char"), F.col("start_char") + t.js_round(i / wide * n_chars).cast("long"))

    by_word = F.transform(starts(wide, size - overlap, overlap), lambda i: F.struct(F.array_join(F.slice("_w", i + 1, F.lit(size)), " ").alias("text"), at(i).cast("long").alias("s"), at(F.least(wide, i + size)).cast("long").alias("e")))
    by_char = F.transform(starts(long_, chars - char_overlap, char_overlap), lambda i: F.struct(F.substring("text", i + 1, F.lit(chars)).alias("text"), (F.col("start_char") + i).cast("long").alias("s"), (F.col("start_char") + F.least(long_, i + chars)).cast("long").alias("e")))
    whole = F.array(F.struct(F.col("text"), F.col("start_char").cast("long").alias("s"), F.col("end_char").cast("long").alias("e")))
    parts = F.when(F.col("_n") > most, F.filter(by_word, lambda c: F.length(c["text"]) >= least)).when((long_ > most_chars) & (F.col("_n") <= 3), F.filter(by_char, lambda c: F.length(c["text"]) >= least)).otherwise(whole)
    rest = [c for c in spans.columns if c not in ("doc_id", "idx", "text", "start_char", "end_char")]
    x = x.select("doc_id", F.col("idx").alias("_idx"), *rest, F.posexplode(parts).alias("_part", "_c"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("_idx", "_part")) - 1
    return x.select("doc_id", idx.alias("idx"), F.col("_c.text").alias("text"), F.col("_c.s").alias("start_char"), F.col("_c.e").alias("end_char"), *rest)


def segmented(docs: DataFrame, prompt: Column | None = None) -> DataFrame:
    """All spans of the bodies of ``docs(doc_id, text)`` with tokens and flags: the input of alignment."""
    b = docs.select("doc_id", body(F.col("text")).alias("text"))
    s = span_flags(in_quotes(sentence_spans(b), quote_spans(b)), prompt)
    return rechunked(s).withColumn("tokens", t.tokens(F.col("text")))


def _overlapping(b: DataFrame, p: DataFrame, width: int) -> DataFrame:
    """``doc_id, idx, passage`` of blocks and placed passages that share characters.

    Both lie in bins of ``width`` characters of their document, and meet in each
    that they share; the first of these decides, so that a pair comes once.
    """
    def binned(x, first, last):
        return x.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor((F.col(last) - 1) / width))))

    x = binned(b.where("_bs < _be"), "_bs", "_be").select("doc_id", "_bin", "idx", "_bs", "_be")
    y = binned(p.where("start_char < end_char"), "start_char", "end_char").select("doc_id", "_bin", "passage", "start_char", "end_char")
    met = x.join(y, ["doc_id", "_bin"]).where(F.col("_bin") == F.floor(F.greatest("_bs", "start_char") / width))
    return met.where(F.greatest("_bs", "start_char") < F.least("_be", "end_char")).select("doc_id", "idx", "passage")


#: Texts times openings of a document up to which each is held against each.
FEW = 10_000


def _holding(texts: DataFrame, openings: DataFrame, few: int = FEW) -> DataFrame:
    """``doc_id, t, o`` of ``texts(doc_id, t, text)`` that hold one of their document's ``openings(doc_id, o, opening)``.

    A document of ``few`` pairs is looked through pair by pair, one of more by :func:`_holding_by_grams`.
    """
    n = texts.groupBy("doc_id").agg(F.count("*").alias("_n")).join(openings.groupBy("doc_id").agg(F.count("*").alias("_m")), "doc_id")
    small, large = (n.where((F.col("_n") * F.col("_m") <= few) == F.lit(v)).select("doc_id") for v in (True, False))
    near = texts.join(small, "doc_id").join(openings, "doc_id").where(F.contains("text", "opening")).select("doc_id", "t", "o")
    return near.union(_holding_by_grams(texts.join(large, "doc_id"), openings.join(large, "doc_id")))


def _holding_by_grams(texts: DataFrame, openings: DataFrame, gram: int = 15) -> DataFrame:
    """An opening is looked up by its first ``gram`` characters among all stretches of that length in the texts, or by all of
    it where it is shorter; then the whole decides.
    """
    o = openings.withColumn("_n", F.least(F.length("opening"), F.lit(gram))).withColumn("_key", F.substring("opening", F.lit(1), F.col("_n")))
    sizes = o.groupBy("doc_id").agg(F.collect_set("_n").alias("_sizes"))  # `gram` numbers at most
    x = texts.join(sizes, "doc_id").withColumn("_n", F.explode("_sizes"))
    places = F.when(F.length("text") >= F.col("_n"), F.sequence(F.lit(1), F.length("text") - F.greatest("_n", F.lit(1)) + 1)).otherwise(F.array().cast("array<int>"))
    x = x.withColumn("_key", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("text"), i, F.col("_n"))))))
    return x.join(o, ["doc_id", "_n", "_key"]).where(F.contains("text", "opening")).select("doc_id", "t", "o")


def attributed(blocks: DataFrame, passages: DataFrame, shown: int = 35, least: int = 15, width: int = 1024, few: int = FEW) -> DataFrame:
    """``doc_id, idx, passage``: of each block the first passage that overlaps its characters or, if a passage has no
    place, whose opening the block holds, or the other way round.

    ``blocks``: doc_id, idx, text, start_char, end_char.  ``passages``: doc_id, passage, start_char, end_char, text.
    Neither way compares all blocks of a large document with all of its passages.
    """
    b = blocks.select("doc_id", "idx", F.lower(t.strip_space(F.col("text"))).alias("_b"), F.col("start_char").alias("_bs"), F.col("end_char").alias("_be"))
    placed = F.col("start_char").isNotNull() & F.col("end_char").isNotNull()
    hit = _overlapping(b, passages.where(placed), width)
    q = passages.where(~placed).select("doc_id", "passage", F.lower(t.strip_space(F.col("text"))).alias("_q")).where(F.length("_q") >= least)
    held = _holding(b.select("doc_id", F.col("idx").alias("t"), F.col("_b").alias("text")), q.select("doc_id", F.col("passage").alias("o"), F.substring("_q", 1, shown).alias("opening")), few)
    hit = hit.union(held.select("doc_id", F.col("t").alias("idx"), F.col("o").alias("passage")))
    held = _holding(q.select("doc_id", F.col("passage").alias("t"), F.col("_q").alias("text")), b.select("doc_id", F.col("idx").alias("o"), F.substring("_b", 1, shown).alias("opening")), few)
    hit = hit.union(held.select("doc_id", F.col("o").alias("idx"), F.col("t").alias("passage")))
    return hit.groupBy("doc_id", "idx").agg(F.min("passage").alias("passage"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, idx, text, is_heading`` of the blocks between blank lines; :func:`placed` adds where they stand."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), t.strip_space), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(parts).alias("idx", "text")).withColumn("is_heading", t.is_heading(F.col("text")))


def placed(docs: DataFrame) -> DataFrame:
    """``doc_id, idx, text, start_char, end_char`` of the blocks between blank lines."""
    p = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"(\n\s*\n)", f"{_END}$1{_END}"), _END)).alias("piece", "p"))
    before = Window.partitionBy("doc_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("at", F.coalesce(F.sum(F.length("p")).over(before), F.lit(0))).withColumn("text", t.strip_space(F.col("p"))).where("text <> ''")
    start = F.col("at") + F.length("p") - F.length(F.ltrim("p", F.lit(t.SPACE)))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("piece")) - 1
    return p.select("doc_id", idx.alias("idx"), "text", start.alias("start_char"), (start + F.length("text")).alias("end_char"))


def heading_lines(c: Column) -> Column:
    """The lines of a text that are headings, in order."""
    return F.filter(F.transform(F.split(c, r"[\r\n]+"), t.strip_space), lambda p: (p != "") & t.is_heading(p))


def headings(docs: DataFrame) -> DataFrame:
    """``doc_id, idx, heading`` of the lines that are headings, in order."""
    return docs.select("doc_id", F.posexplode(heading_lines(F.col("text"))).alias("idx", "heading"))


def figure_references(c: Column) -> Column:
    """Distinct mentions like ``figure 3``, lower-cased and sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(t.FIGURES), F.lit(0)), lambda x: F.lower(x))))


def page_groups(blocks: DataFrame, per_page: int = 4) -> DataFrame:
    """``doc_id, page, n`` of consecutive blocks, ``per_page`` to a page."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    return blocks.select("doc_id", F.floor((F.row_number().over(w) - 1) / per_page).alias("page")).groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def evidence_category(score: Column, ignored: Column, attributed: Column, common: Column) -> Column:
    return F.when(ignored, "ignored").when(attributed, "weak").when(common, F.when(score >= 85, "weak").otherwise("ignored")).when(score >= 75, "strong").when(score >= 45, "moderate").otherwise("weak")
