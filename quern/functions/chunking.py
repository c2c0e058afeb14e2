"""Paragraph chunks of at most 512 bytes, in Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.hashing import content_hash

MOST_BYTES = 512
_TRIM = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z"


def split_paragraphs(text: Column) -> Column:
    """What two or more newlines part, trimmed of Unicode white space, without the empty."""
    return F.filter(F.transform(F.split(text, r"\n{2,}", -1), lambda p: F.regexp_replace(p, _TRIM, "")), lambda p: p != "")


def split_fixed(paragraph: Column, most: int = MOST_BYTES) -> Column:
    """Pieces of at most ``most`` bytes, cut at the last ASCII white space that allows it.

    Bytes are looked at as Latin-1 characters. A word of more than ``most`` bytes is cut
    where a character begins.
    """
    ws = r"[ \t\n\f\r]"
    # a continuation byte must not come first in what is left
    pattern = rf"(?s)(.{{1,{most}}}(?={ws}|\z)|.{{1,{most}}}(?![\x80-\xBF])){ws}*"
    as_bytes = F.decode(F.encode(paragraph, "UTF-8"), "ISO-8859-1")
    return F.transform(F.regexp_extract_all(as_bytes, F.lit(pattern), F.lit(1)), lambda c: F.decode(F.encode(c, "ISO-8859-1"), "UTF-8"))


def chunk_text(text: Column, most: int = MOST_BYTES) -> Column:
    """The chunks of a text, in order; none for a null or blank one."""
    paragraphs = split_paragraphs(F.coalesce(text, F.lit("")))
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.octet_length(p) <= most, F.array(p)).otherwise(split_fixed(p, most))))


def chunk_documents(documents: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """``document_id, chunk_id, content, content_hash`` of ``documents(document_id, content)``."""
    chunks = documents.select("document_id", F.posexplode(chunk_text(F.col("content"), most)).alias("chunk_id", "content"))
    return chunks.withColumn("content_hash", content_hash(F.col("content")))
