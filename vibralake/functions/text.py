"""Text expressions: stripping, paragraph chunking, tokens, labels for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vibralake import domain

# The characters a Unicode-aware strip removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Stripped, non-empty paragraphs. The separator is taken literally."""
    parts = F.split(text, "\\Q" + separator + "\\E", -1)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def chunk_spans(lengths: Column, size: int) -> Column:
    """Spans ``(first, count)`` over an array of paragraph lengths.

    One pass: a paragraph that would push the running length over ``size``
    closes the open span. The next span starts with the previous paragraph
    again when the closed one held more than one. Only closed spans are
    appended, so paragraph texts are never copied while folding.
    """
    span = "struct<first:int,count:int>"
    start = F.struct(
        F.lit(None).cast(f"array<{span}>").alias("closed"),
        F.lit(0).alias("index"),
        F.lit(0).alias("first"),
        F.lit(0).alias("count"),
        F.lit(0).alias("length"),
        F.lit(0).alias("last"),
    )
    start = start.withField("closed", F.array().cast(f"array<{span}>"))

    def step(acc: Column, length: Column) -> Column:
        close = (acc["length"] + length > size) & (acc["count"] > 0)
        carry = close & (acc["count"] > 1)
        done = F.struct(acc["first"].alias("first"), acc["count"].alias("count"))
        return F.struct(
            F.when(close, F.concat(acc["closed"], F.array(done))).otherwise(acc["closed"]).alias("closed"),
            (acc["index"] + 1).alias("index"),
            F.when(carry, acc["index"] - 1).when(close, acc["index"]).otherwise(acc["first"]).alias("first"),
            F.when(carry, 2).when(close, 1).otherwise(acc["count"] + 1).alias("count"),
            F.when(carry, acc["last"] + length).when(close, length).otherwise(acc["length"] + length).alias("length"),
            length.alias("last"),
        )

    def finish(acc: Column) -> Column:
        open_span = F.struct(acc["first"].alias("first"), acc["count"].alias("count"))
        return F.when(acc["count"] > 0, F.concat(acc["closed"], F.array(open_span))).otherwise(acc["closed"])

    return F.aggregate(lengths, start, step, finish)


def window_chunks(text: Column, size: int, overlap: int) -> Column:
    """Fixed windows of ``size`` characters, stepping ``size - overlap``."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


def tokens(text: Column, pattern: str = r"[^\p{L}]+") -> Column:
    """Lower-cased words; the pattern names what separates them."""
    return F.filter(F.split(F.lower(text), pattern, -1), lambda t: t != "")


def title_case(category: Column) -> Column:
    return F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))


def upper_case(category: Column) -> Column:
    return F.replace(F.upper(category), F.lit("_"), F.lit(" "))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def one_decimal(number: Column) -> Column:
    return F.format_string("%.1f", number)


def fill(template: str, **values: Column) -> Column:
    """Put columns into a ``{name}`` template; one concat, no text search."""
    from string import Formatter

    parts: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field:
            parts.append(values[field].cast("string"))
    return F.concat(*parts)


def page_header(number: Column, ocr: Column) -> Column:
    return F.when(ocr, fill(domain.PAGE_HEADER_OCR, number=number)).otherwise(
        fill(domain.PAGE_HEADER, number=number)
    )
