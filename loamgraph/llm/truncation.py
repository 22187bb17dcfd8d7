"""Texts that were cut, by a length limit or in transfer.

Per source and column, the histograms of lengths in characters and in bytes are tested for spikes at the maximum. A text
without a terminal end is cut: by a limit if its length lies at a spike of its source, else in transfer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A spike: at least so many texts at one length, and so many times as many as at each of the lengths near it. It lies at
#: the maximum if no more than SPIKE_LONGER of the source's texts are longer.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_NEAR, SPIKE_LONGER = 5, 4.0, 16, 0.02
SUBJECT_CHARS = 72
TRAILER = r"^[A-Z][A-Za-z]*(?:-[A-Za-z]+)*: "

# Signs put after a cut, and closers that may follow the end of a sentence.
CUT_SIGNS = r"(?:…|\.\.\.|�|\[(?:cut|truncated|…|\.\.\.)\]|\((?:cut|truncated|continued|…|\.\.\.)\)|<(?:cut|truncated)\s*/?>)"
CLOSERS = r"[\"'”’»)\]}*_]"
CLOSING_TAG = r"</[A-Za-z][\w:-]*>"
SENTENCE_END = r"[.!?。！？]"


BLANKS = " \t\n\x0b\f\r"


def with_ends(texts: DataFrame) -> DataFrame:
    """texts (..., source, text) with `end`, how a text ends: `full`, `weak` or `cut`; null for null or blank texts.

    `full`: a full sentence (perhaps inside quotes, brackets or emphasis), a closed code block or a complete table row.
    `weak`: a trailer line `Key: value` or, in `commits/` sources, a short subject line; such an end is whole only where no
    limit can have made it. Signs and tags after a cut do not make it whole. Patterns run on the last lines only; of the whole
    text just its fences are counted, if it has any.
    """
    bare = F.rtrim("text", F.lit(BLANKS))
    closed = F.when(F.endswith("_bare", F.lit(">")), F.regexp_replace("_bare", rf"(?:\s|{CLOSING_TAG})+\z", "")).otherwise(F.col("_bare"))
    two = F.substring_index("_body", "\n", -2)
    parts = texts.withColumn("_bare", bare).withColumn("_body", closed)
    parts = parts.withColumn("_line", F.substring_index("_body", "\n", -1)).withColumn("_above", F.when(F.contains(two, F.lit("\n")), F.substring_index(two, "\n", 1)))
    body, line, above = F.col("_body"), F.col("_line"), F.col("_above")
    open_code = F.contains(body, F.lit("```")) & (F.regexp_count(body, F.lit(r"(?m)^\s*(?:>\s*)?```")) % 2 == 1)
    marked = line.rlike(rf"{CUT_SIGNS}{CLOSERS}*\z")
    sentence = line.rlike(rf"{SENTENCE_END}{CLOSERS}*\z") & ~line.rlike(r"(?:^|\s)\S*/[\w/-]*\.\z") & ~_open_pair(line)
    closed_code = line.rlike(r"^\s*(?:>\s*)?```\z")
    cells = F.regexp_count(line, F.lit(r"\|"))
    row = line.rlike(r"^\s*\|.*\|\z") & F.coalesce(~above.rlike(r"^\s*\|.*\|\s*\z") | (F.regexp_count(above, F.lit(r"\|")) <= cells), F.lit(True))
    apart = F.coalesce((F.trim(above) == "") | above.rlike(rf"{TRAILER}\S+\z"), F.lit(True))
    trailer = (line.rlike(rf"{TRAILER}\S+\z") | line.rlike(rf"^[A-Z][A-Za-z-]*-[Bb]y: .+[\w>]\z")) & apart
    subject = F.coalesce(F.col("source").startswith("commits/"), F.lit(False)) & above.isNull() & F.length(body).between(1, SUBJECT_CHARS) & line.rlike(r"[\p{L}\p{N})`]\z")
    end = F.when(marked | open_code, "cut").when(sentence | closed_code | row, "full").when(trailer | subject, "weak").otherwise("cut")
    return parts.withColumn("end", F.when(F.col("_bare") != "", end)).drop("_bare", "_body", "_line", "_above")


def _open_pair(line: Column) -> Column:
    """An inline code span that is still open: the end is inside a name or path, whatever sign it shows."""
    return F.contains(line, F.lit("`")) & (F.regexp_count(F.replace(line, F.lit("```"), F.lit("")), F.lit("`")) % 2 == 1)


def length_histogram(texts: DataFrame) -> DataFrame:
    """(source, field, unit, length, n) of texts (source, field, text), in characters and in bytes; null sources count as ''."""
    sizes = F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("length")))
    rows = texts.where("text is not null").select(F.coalesce("source", F.lit("")).alias("source"), "field", F.explode(sizes).alias("s"))
    return rows.groupBy("source", "field", "s.unit", "s.length").agg(F.count("*").alias("n"))


def length_spikes(histogram: DataFrame) -> DataFrame:
    """Lengths at which a source's texts pile up as under a limit: source, field, unit, length, n, at_maximum, sure (the share
    of them beyond the number at the lengths near it).

    A limit in bytes may cut up to three bytes earlier (inside a letter), so the three lengths just below a spike are not
    compared with it. The windows run over the lengths that occur, not over the texts.
    """
    per = Window.partitionBy("source", "field", "unit").orderBy("length")
    near = F.greatest(F.max("n").over(per.rangeBetween(-SPIKE_NEAR, -4)), F.max("n").over(per.rangeBetween(1, SPIKE_NEAR)))
    upto = F.sum("n").over(per.rangeBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy("source", "field", "unit"))
    rows = histogram.select("*", F.coalesce(near, F.lit(0)).alias("near"), (total - upto <= SPIKE_LONGER * total).alias("at_maximum"))
    return rows.where((F.col("n") >= SPIKE_LEAST) & (F.col("n") >= SPIKE_TIMES * F.col("near"))).withColumn("sure", 1 - F.col("near") / F.col("n")).drop("near")


def flagged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, is_text, at_limit, end, cut, cause, confidence) of every document: cause is `limit`, `transfer` or null.

    `limit`: the length lies at a spike at the maximum of its source (in bytes: up to three below) and the text has no full
    end; the confidence is the spike's share of texts beyond the lengths near it. `transfer`: elsewhere, and the text has no
    whole end (full or weak); the histogram tells nothing of it, the confidence is null. So a weak end, which is whole by
    itself, is cut at a spike. Blank and null texts are no texts and not cut; a null source counts as one source. A source has
    few limits; they are joined by source.
    """
    texts = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    spikes = length_spikes(length_histogram(texts.withColumn("field", F.lit("text")))).where("at_maximum")
    limits = spikes.groupBy("source").agg(F.collect_set(F.struct("unit", "length", "sure")).alias("limits"))
    rows = with_ends(texts).select("doc_id", "source", "end", F.length("text").alias("chars"), F.octet_length("text").alias("octets"))
    at = lambda s: F.when(s["unit"] == "chars", s["length"] == F.col("chars")).otherwise((F.col("octets") <= s["length"]) & (F.col("octets") > s["length"] - 4))
    sure = F.array_max(F.transform(F.filter("limits", at), lambda s: s["sure"]))
    joined = rows.join(limits, "source", "left").withColumn("sure", sure)
    cause = F.when(F.col("sure").isNotNull() & (F.col("end") != "full"), "limit").when(F.col("end") == "cut", "transfer")
    whole = joined.withColumn("cause", cause)
    return whole.select(
        "doc_id", "source", F.col("end").isNotNull().alias("is_text"), (F.col("end").isNotNull() & F.col("sure").isNotNull()).alias("at_limit"), "end",
        F.col("cause").isNotNull().alias("cut"), "cause", F.when(F.col("cause") == "limit", F.col("sure")).alias("confidence"),
    )


def truncation_report(rows: DataFrame) -> DataFrame:
    """Per source: texts, texts at a limit's length, cut texts by cause, those of them that only the histogram shows (weak ends
    at a limit), the mean confidence of the limit's cuts, and the share of cut texts."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    limit = F.coalesce(F.col("cause") == "limit", F.lit(False))
    out = rows.groupBy("source").agg(
        count(F.col("is_text")).alias("n_texts"), count(F.col("at_limit")).alias("n_at_limit"), count(F.col("cut")).alias("n_cut"), count(limit).alias("n_limit"),
        count(limit & (F.col("end") == "weak")).alias("n_limit_only"), count(F.coalesce(F.col("cause") == "transfer", F.lit(False))).alias("n_transfer"), F.round(F.avg("confidence"), 6).alias("confidence"),
    )
    return out.withColumn("share_cut", F.round(F.when(F.col("n_texts") > 0, F.col("n_cut") / F.col("n_texts")), 6))
