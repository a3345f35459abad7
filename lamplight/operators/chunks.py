"""Cleaning and chunking of long texts, and what is told about chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamplight.functions.text import NEAR_WS, WS, by_space, first_nonempty, trim_all, word_list


#: White space without line ends, and line ends, by the class of white space.
BLANK = {WS: r"[ \t\x0B\f\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000\uFEFF]", NEAR_WS: r"[ \t\x0B\f\xA0]"}
ENDS = {WS: r"[\n\r\u2028\u2029]", NEAR_WS: r"[\n\r]"}


def clean_scan(c: Column, keep_paragraphs: bool = False) -> Column:
    """Undo what scanning does to a text. As given, blank lines vanish with the space around lines; ``keep_paragraphs`` keeps one.

    A run of white space within the text is looked at once: it goes if its last line end follows another, else that line end stays.
    """

    def lines(ws: str) -> Column:
        t, end, blank = trim_all(F.regexp_replace(c, "  +", " ")), ENDS[ws], BLANK[ws]
        if keep_paragraphs:
            wide = ws.replace(r"\s", r" \t\x0B\f\r").replace(r"\n", "")
            return F.regexp_replace(t, rf"(?m)^{wide}++|(?={wide})(?<!{wide}){wide}++$", "")
        t = F.regexp_replace(t, rf"(?={ws})(?<!{ws}){ws}*{end}{end}{blank}*+(?!{ws})", "")
        return F.regexp_replace(t, rf"(?={ws})(?<!{ws}){ws}*({end}){blank}*+(?!{ws})", "$1")

    t = F.regexp_replace(by_space(c, lines), r"([а-яё])\n([а-яё])", "$1 $2")
    return trim_all(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def words_of(c: Column) -> Column:
    return F.filter(word_list(c), lambda w: w != "")


def token_estimate(n_words: Column) -> Column:
    """Tokens by the rule of three quarters of a word each."""
    return F.ceil(n_words / 0.75)


def chunked(docs: DataFrame, max_words: int, text_col: str = "text") -> DataFrame:
    """Chunks of at most ``max_words`` words joined by single spaces: chunk_index (from 1), total_chunks, text. One array
    of words per document and slices of it: no shuffle. A null text has no chunks; ``quarantined`` keeps such rows."""
    ws = word_list(F.col(text_col))
    total = F.ceil(F.size("__w") / max_words).cast("int")
    out = docs.withColumn("__w", ws).withColumn("__n", total)
    out = out.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    piece = F.array_join(F.slice("__w", F.col("__k") * max_words + 1, F.lit(max_words)), " ")
    keep = [c for c in docs.columns if c != text_col]
    return out.select(*keep, (F.col("__k") + 1).alias("chunk_index"), F.col("__n").alias("total_chunks"), piece.alias("text"), F.char_length(F.col(text_col)).alias("original_length"))


def described(chunks: DataFrame) -> DataFrame:
    n = F.size(words_of(F.col("text")))
    return chunks.withColumns({
        "word_count": n, "estimated_tokens": token_estimate(n), "character_count": F.char_length("text"),
        "compression_ratio": F.round(F.try_divide(F.lit(100.0) * F.char_length("text"), F.col("original_length"))).cast("int"),
    })


def scan_metadata(info: Column, meta: Column) -> dict[str, Column]:
    """What a scan tells of itself, from either of its two maps."""
    return {
        "producer": F.coalesce(first_nonempty(F.try_element_at(info, F.lit("Producer")), F.try_element_at(meta, F.lit("pdf:producer"))), F.lit("Unknown")),
        "creation_date": first_nonempty(F.try_element_at(info, F.lit("CreationDate"))),
        "modification_date": first_nonempty(F.try_element_at(info, F.lit("ModDate"))),
        "format": F.coalesce(first_nonempty(F.try_element_at(meta, F.lit("dc:format"))), F.lit("application/pdf")),
        "document_id": first_nonempty(F.try_element_at(meta, F.lit("xapmm:documentid"))),
    }
