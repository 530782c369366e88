"""Documents to lines, sentences and paragraphs, all within the row of their document.

Arrays keep a document together, so that no detector shuffles. Tables of lines or sentences are one
``explode`` away.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import WS, blank, blanked, strip
from loomtext.plans.profiles import LATIN, Profile

HEADING = f"^[{WS}]*#{{1,6}}(?:[{WS}]|$)"
LIST_ITEM = f"^[{WS}]*(?:[-*+]|[0-9]+[.)])(?:[{WS}]|$)"
QUOTE = f"^[{WS}]*>"
TABLE = f"^[{WS}]*\\|.*\\||^[{WS}]*\\|?[{WS}:|-]+\\|[{WS}:|-]*\\|?[{WS}]*$"
STRUCTURE = f"{HEADING}|{LIST_ITEM}|{QUOTE}|{TABLE}"
COMMENT = r"(?s)<!(?:-->|--->|--.*?(?:-->|\z))"
LINK = r"(?<=\]\()[^)\n]+(?=\))"
#: Texts with any of these need the sequential mask; all others are masked line by line in SQL.
SEQUENTIAL = f"\\A---[{WS}]*(?:\n|\\z)|```|~~~|<!--|`"


def keep(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is evaluated once for each row: what is built on it refers to the value, where
    the optimizer would else put the whole expression into every lambda."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def settled(base: DataFrame, df: DataFrame, **values: Column) -> DataFrame:
    """``base``'s columns and ``values``, each evaluated once; the columns that df has besides go."""
    for name, value in values.items():
        df = keep(df, name, value)
    return df.select(*base.columns, *values)


def split_lines(text: Column) -> Column:
    """Lines by line feeds only; one at the end makes no line; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\n\\z", ""), "\n", -1))


def mask_comments(text: Column) -> Column:
    """HTML comments as spaces, whole text; one that is not closed runs to the end."""
    return blanked(text, COMMENT)


def mask_line(line: Column) -> Column:
    """Structural lines are emptied; link targets become spaces."""
    return F.when(line.rlike(STRUCTURE), "").otherwise(blanked(line, LINK))


FENCE = re.compile(f"^[{WS}]*(`{{3,}}|~{{3,}})")
FRONT = re.compile(f"^---[{WS}]*$")
_SPAN = re.compile(r"``.+?``(?!`)|`[^`\n]+`")
_LINK = re.compile(LINK)
_SPACES = lambda m: " " * len(m[0])


def closes(fence: str, line: str) -> bool:
    """Whether a line ends the code that ``fence`` opened: the same mark, as often at least, alone."""
    return bool(re.match(f"[{WS}]*{re.escape(fence[0])}{{{len(fence)},}}[{WS}]*$", line))


def mask_lines(text: str) -> list[str]:
    """The sequential mask: front matter, then fences, then comments (their state moves only outside the
    other two), then structural lines, code spans and link targets."""
    lines = (text[:-1] if text.endswith("\n") else text).split("\n") if text else []
    out, fence, comment, front = [], None, False, False
    for i, line in enumerate(lines):
        if i == 0 and FRONT.match(line):
            front = True
            out.append("")
            continue
        if front:
            front = not FRONT.match(line)
            out.append("")
            continue
        if fence:
            if closes(fence, line):
                fence = None
            out.append("")
            continue
        if not comment and (m := FENCE.match(line)):
            fence = m[1]
            out.append("")
            continue
        masked, at = [], 0
        while at < len(line):
            if comment:
                end = line.find("-->", at)
                stop = len(line) if end < 0 else end + 3
                masked.append(" " * (stop - at))
                comment = end < 0
                at = stop
            else:
                start = line.find("<!--", at)
                if start < 0:
                    masked.append(line[at:])
                    break
                masked.append(line[at:start])
                end = line.find("-->", start + 2)  # the opener's own dashes may close it
                stop = len(line) if end < 0 else end + 3
                masked.append(" " * (stop - start))
                comment = end < 0
                at = stop
        line = "".join(masked)
        if re.search(STRUCTURE, line):
            line = ""
        line = _LINK.sub(_SPACES, _SPAN.sub(_SPACES, line))
        out.append(line)
    return out


def mask_sequential(texts: pa.Array) -> pa.Array:
    return pa.array([None if (t := x.as_py()) is None else mask_lines(t) for x in texts], pa.list_(pa.string()))


def parse(docs: DataFrame, profile: Profile = LATIN, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``carry``, text, lines (line, masked, raw), sentences (line, text, raw, raw_offset: where
    text begins in raw), paragraphs (first, text). Null texts are dropped. Only rows that need it pass through Python."""
    clean = F.regexp_replace(F.col(text), "\r\n?", "\n")
    df = docs.select(F.col(doc_id).alias("doc_id"), *carry, clean.alias("text")).where("text is not null")
    hard = F.arrow_udf(mask_sequential, "array<string>")(F.when(F.col("text").rlike(SEQUENTIAL), F.col("text")))
    df = df.withColumn("__hard", hard)
    df = keep(df, "__raw", split_lines(F.col("text")))
    df = keep(df, "__masked", F.coalesce("__hard", F.transform("__raw", mask_line)))
    lines = F.zip_with("__masked", "__raw", lambda m, r: F.struct(m.alias("masked"), r.alias("raw")))
    df = keep(df, "lines", F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x["masked"].alias("masked"), x["raw"].alias("raw"))))
    pattern = f"[{profile.delimiters}]"

    def pieces(x: Column) -> Column:
        masked = F.split(x["masked"], pattern, -1)
        same = F.transform(masked, lambda p: F.struct(x["line"].alias("line"), strip(p).alias("text"), strip(p).alias("raw"), F.lit(0).alias("raw_offset")))

        def apart(p: Column, i: Column) -> Column:
            raw = F.substr(x["raw"], F.length(F.array_join(F.slice(masked, F.lit(1), i), ".")) + F.when(i > 0, 2).otherwise(1), F.length(p))
            lead = lambda s: F.length(s) - F.length(F.regexp_replace(s, f"\\A[{WS}]+", ""))
            return F.struct(x["line"].alias("line"), strip(p).alias("text"), strip(raw).alias("raw"), (lead(p) - lead(raw)).alias("raw_offset"))

        return F.when((x["masked"] == x["raw"]) | (F.length(x["masked"]) != F.length(x["raw"])), same).otherwise(F.transform(masked, apart))

    df = keep(df, "sentences", F.filter(F.flatten(F.transform("lines", pieces)), lambda s: s["text"] != ""))
    starts = F.filter("lines", lambda x, i: ~blank(x["masked"]) & ((i == 0) | blank(F.get("lines", i - 1)["masked"])))
    ends = F.filter("lines", lambda x, i: ~blank(x["masked"]) & ((i + 1 == F.size("lines")) | blank(F.get("lines", i + 1)["masked"])))
    df = keep(df, "__p", F.zip_with(starts, ends, lambda a, b: F.struct(a["line"].alias("a"), b["line"].alias("b"))))
    paragraphs = F.transform(
        "__p",
        lambda p: F.struct(
            p["a"].alias("first"),
            F.array_join(F.transform(F.slice("lines", p["a"], p["b"] - p["a"] + 1), lambda x: x["masked"]), "\n").alias("text"),
        ),
    )
    df = keep(df, "paragraphs", paragraphs)
    return df.select("doc_id", *carry, "text", "lines", "sentences", "paragraphs")


def lines_table(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.line", "x.masked", "x.raw")


def sentences_table(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.posexplode("sentences").alias("i", "x")).select(
        "doc_id", (F.col("i") + 1).alias("sent_no"), "x.line", "x.text", "x.raw"
    )


def piece_count(text: Column, profile: Profile = LATIN) -> Column:
    """Pieces between delimiters and line feeds that are not blank."""
    return F.size(F.filter(F.split(text, f"[{profile.delimiters}\n]", -1), lambda p: ~blank(p)))


def paragraphs_table(parsed: DataFrame, profile: Profile = LATIN) -> DataFrame:
    return parsed.select("doc_id", F.posexplode("paragraphs").alias("i", "x")).select(
        "doc_id", (F.col("i") + 1).alias("para_no"), F.col("x.first").alias("first_line"), "x.text", piece_count(F.col("x.text"), profile).alias("sentences")
    )


def headings_table(parsed: DataFrame) -> DataFrame:
    """Headings with level and text; a closing run of # goes only after a space."""
    rows = lines_table(parsed).where(F.col("raw").rlike(HEADING))
    body = strip(F.regexp_extract("raw", f"^[{WS}]*#{{1,6}}(?:[{WS}](.*))?$", 1))
    return rows.select(
        "doc_id",
        "line",
        F.length(F.regexp_extract("raw", f"^[{WS}]*(#{{1,6}})", 1)).alias("level"),
        strip(F.regexp_replace(body, f"(?:\\A|[{WS}]+)#+\\z", "")).alias("heading"),
    )

