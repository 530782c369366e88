"""The findings table: one schema for all detectors, their order, filters and counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.parse import settled
from loomtext.plans.profiles import BUSINESS_DISABLED, EXPERIMENTAL

COLUMNS = ("doc_id", "line", "category", "excerpt", "severity", "detail", "related_lines", "rank", "seq")
#: Most lines that one finding lists.
RELATED = 20


def finding(line: Column, excerpt: Column, detail: Column, severity: Column | str, related: Column | None = None, seq: Column | None = None) -> Column:
    return F.struct(
        line.cast("int").alias("line"),
        excerpt.alias("excerpt"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        detail.alias("detail"),
        (related if related is not None else F.lit(None)).cast("array<int>").alias("related_lines"),
        (seq if seq is not None else F.lit(0)).cast("int").alias("seq"),
    )


#: A table with a row for each document or sentence, and what detectors find in it: (category, rank, array of findings).
Parts = tuple[DataFrame, list[tuple[str, int, Column]]]


def grouped(parts: list[tuple[str, int, Column]]) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("category"), F.lit(rank).alias("rank"), found.alias("found")) for c, rank, found in parts])


def emit(df: DataFrame, groups: Column) -> DataFrame:
    """A row for each finding of the array ``groups`` (of :func:`grouped`)."""
    each = df.select("doc_id", F.explode(groups).alias("g")).select("doc_id", "g.category", "g.rank", F.explode("g.found").alias("f"))
    return each.select("doc_id", "f.line", "category", "f.excerpt", "f.severity", "f.detail", "f.related_lines", "rank", "f.seq")


def detector(parts: Callable[..., Parts]) -> Callable[..., DataFrame]:
    """A detector alone gives its findings as a table; ``parts`` gives arrays in the rows of its input, so that
    many detectors share one pass over it."""

    @wraps(parts)
    def run(*args, **options) -> DataFrame:
        df, found = parts(*args, **options)
        return emit(df, grouped(found))

    run.parts = parts
    return run


def gathered(df: DataFrame, steps: list[Callable[[DataFrame], Parts]]) -> Parts:
    """What all the detectors find in each row of df, in one pass and with nothing kept between rows."""
    all_parts = []
    for step in steps:
        after, parts = step(df)
        df = settled(df, after, **{f"__{c}": found for c, _, found in parts})
        all_parts += [(c, rank, F.col(f"__{c}")) for c, rank, _ in parts]
    return df, all_parts


def one_if(condition: Column, found: Column) -> Column:
    return F.filter(F.array(found), lambda _: F.coalesce(condition, F.lit(False)))


def capped(lines: Column) -> Column:
    """Distinct, sorted, the first RELATED."""
    return F.slice(F.array_sort(F.array_distinct(lines)), 1, RELATED)


def related_text(lines: Column) -> Column:
    all_lines = F.array_sort(F.array_distinct(lines))
    rest = F.size(all_lines) - RELATED
    shown = F.array_join(F.transform(F.slice(all_lines, 1, RELATED), lambda n: F.concat(F.lit("L"), n.cast("string"))), ", ")
    return F.concat(F.lit("対応箇所: "), shown, F.when(rest > 0, F.concat(F.lit(" ほか"), rest.cast("string"), F.lit("箇所"))).otherwise(""))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ordered(findings: DataFrame) -> DataFrame:
    """Within a document by line; detectors in their fixed order within a line, then as found. Documents
    are dealt by id: an order of all findings would run the detectors twice, once for a sample of the keys."""
    return findings.repartition("doc_id").sortWithinPartitions("doc_id", "line", "rank", "seq")


def filtered(findings: DataFrame, experimental: bool = False, genre: str | None = None) -> DataFrame:
    out = findings if experimental else findings.where(~F.col("category").isin(*EXPERIMENTAL))
    return out.where(~F.col("category").isin(*BUSINESS_DISABLED)) if genre == "business" else out


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"))
