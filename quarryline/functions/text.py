"""Document clean-up and profiling as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The Unicode White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(t: Column) -> Column:
    return F.trim(t, F.lit(WHITE_SPACE))


def squeezed(t: Column) -> Column:
    return trimmed(F.regexp_replace(t, r"(?U)\s+", " "))


def slug(t: Column) -> Column:
    """Lower case, runs of other characters as one dash, one dash less at each edge."""
    return F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-|-$", "")


def sentences(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), trimmed), lambda s: s != "")


def transcript_lines(t: Column) -> Column:
    """Lines trimmed, empties dropped, first occurrence kept, inaudible marks as an ellipsis, white space squeezed, fillers removed."""
    lines = F.array_distinct(F.filter(F.transform(F.split(t, "\r?\n"), trimmed), lambda s: s != ""))
    fillers = r"(?i)(?<![A-Za-z0-9_])(?:um|uh|er)(?![A-Za-z0-9_])"
    clean = lambda s: trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(?i)\[inaudible\]", "\u2026"), r"(?U)\s+", " "), fillers, ""))
    return F.filter(F.transform(lines, clean), lambda s: s != "")


def clips(df: DataFrame, key: str, text: str, least: int, most: int) -> DataFrame:
    """Sentences of a length between the bounds, numbered from 1 within their text, with a short content hash."""
    # a sentence starts where its run of characters does, so an end without a mark is looked at once
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![^.!?\n])[^.!?\n]++[.!?\n]++"), F.lit(0)), trimmed)
    kept = F.filter(found, lambda s: (F.length(s) >= least) & (F.length(s) <= most))
    out = df.select(key, F.posexplode(kept).alias("pos", "clip"))
    return out.select(key, (F.col("pos") + 1).alias("clip_id"), "clip", F.concat(F.lit("sha256:"), F.substring(F.sha2("clip", 256), 1, 13)).alias("clip_hash"))


def profile(text: str) -> dict[str, Column]:
    """Counts of lines, words, characters, headings, list items and code fences."""
    lines = F.split(text, "\n")
    n = lambda rx: F.size(F.filter(lines, lambda s: s.rlike(rx)))
    return {
        "lines": F.size(lines), "words": F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), "chars": F.length(text),
        "headings": n(r"^#{1,6} "), "list_items": n(r"^\s*([-*+]|[0-9]+\.) "), "code_blocks": F.floor(n("^```") / 2).cast("int"),
    }


def narration(title: Column, profile_text: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), profile_text)


def html_escaped(t: Column) -> Column:
    return F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def reflow(words: list[str], width: int) -> list[str]:
    """Lines filled greedily; a word goes to the next line where the line, a blank and the word are above the width."""
    lines, line = [], ""
    for w in words:
        if line and len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}" if line else w
    return [*lines, line] if line else lines


def reflowed(df: DataFrame, key: str, text: str, width: int = 80) -> DataFrame:
    """Paragraphs (between blank lines) filled to ``width``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for pdf in batches:
            made = ["\n\n".join("\n".join(reflow(p.split(), width)) for p in re.split(r"\n\s*\n", t or "") if p.strip()) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "reflowed": made})

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, "key long, reflowed string")
