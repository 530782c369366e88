"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.common import SPACE_CHARS, any_names, materialize, trimmed

#: Hex digits of the seeded order that make a bucket: 4096 buckets for each source.
BUCKET_DIGITS = 3


def seeded(doc_id: Column, seed: int) -> Column:
    """The order in which a source's documents get one more repetition."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), doc_id.cast("string")).cast("binary"))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row a source).

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes.
    A source whose share exceeds ``max_epochs`` times its size is clamped there and the excess is
    shared by weight among the others until no share is above: the level at which that ends is found
    in one pass over the sources in the order of clamp by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("__i", F.row_number().over(by_name) - 1).withColumn(
        "__w",
        F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int")).cast("long"),
    )
    order = Window.orderBy(F.col("source_size") / F.col("__w"), "__i")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    cap = F.col("source_size") * max_epochs
    level = weighed.select(
        "source",
        "source_size",
        "__w",
        cap.alias("__cap"),
        F.sum("source_size").over(whole).alias("__total"),
        # the state before this source: those with a smaller clamp by weight are clamped already
        (F.sum(cap).over(upto) - cap).alias("__clamped"),
        (F.sum("__w").over(whole) - F.sum("__w").over(upto) + F.col("__w")).alias("__left"),
    ).withColumn("__share", F.col("__w") * (F.col("__total") - F.col("__clamped")) / F.col("__left"))
    # the first source that its share does not overfill sets the level for itself and all after it
    fits = F.col("__share") <= F.col("__cap")
    first = F.min(F.when(fits, F.struct(F.col("__clamped").alias("c"), F.col("__left").alias("l")))).over(whole)
    return level.withColumn("__f", first).select(
        "source",
        "source_size",
        F.when(
            F.col("__f").isNotNull() & (F.col("__clamped") >= F.col("__f.c")) & (F.col("__left") <= F.col("__f.l")),
            F.col("__w") * (F.col("__total") - F.col("__f.c")) / F.col("__f.l"),
        )
        .otherwise(F.col("__cap").cast("double"))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 42,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, __h``: one row for each row of ``docs``.

    Each document is taken ``floor(target / source_size)`` times. What then lacks to the target is
    filled by documents in the order of a seeded hash, one more time each; the document at the
    boundary gives only its first words, so that a source's taken words are its target rounded.

    The boundary is found by buckets: sums by (source, bucket of the hash), then running sums within
    the one bucket of each source where the boundary lies. No task sorts a whole source.

    Null text or no word: size 0, taken 0. Null source: a source of its own, the last. Equal rows are
    interchangeable. No rows: no rows. A source of only empty documents has target 0.
    """
    base = materialize(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            F.xxhash64(F.col(text)).alias("__h"),
            seeded(F.col(doc_id), seed).alias("__o"),
        ).withColumn("__b", F.substring("__o", 1, BUCKET_DIGITS)),
        "mix",
    )
    cells = base.groupBy("source", "__b").agg(F.sum("size").alias("__n"))
    sizes = cells.groupBy("source").agg(F.sum("__n").alias("source_size"))
    plan = source_targets(sizes, weights, max_epochs).select(
        F.col("source").alias("__s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("__whole"),
    )
    plan = plan.withColumn("__need", F.round("target").cast("long") - F.col("__whole") * F.col("source_size"))
    along = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        cells.withColumn("__end", F.sum("__n").over(along))
        .join(plan, F.col("source").eqNullSafe(F.col("__s")))
        .groupBy("__s", "source_size", "target", "__whole", "__need")
        .agg(
            # first bucket whose end passes what is needed, and what the buckets before it hold
            F.min(F.when(F.col("__end") > F.col("__need"), F.col("__b"))).alias("__edge"),
            F.max(F.when(F.col("__end") <= F.col("__need"), F.col("__end"))).alias("__before"),
        )
    )
    all_rows = base.join(edge, F.col("source").eqNullSafe(F.col("__s")))
    full = F.col("__edge").isNull() | (F.col("__b") < F.col("__edge"))
    at_edge = ~full & (F.col("__b") == F.col("__edge"))
    keep = ["doc_id", "size", "source_size", "target"]
    taken = F.col("__whole") * F.col("size")
    plain = all_rows.where(~at_edge).select(*keep, (taken + F.when(full, F.col("size")).otherwise(0)).cast("long").alias("taken"), "__h")
    inside = Window.partitionBy("__s").orderBy("__o", "doc_id", "size", "__h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.col("__need") - F.coalesce("__before", F.lit(0)) - (F.sum("size").over(inside) - F.col("size"))
    cut = all_rows.where(at_edge).select(
        *keep, (taken + F.greatest(F.lit(0), F.least(F.col("size"), room))).cast("long").alias("taken"), "__h"
    )
    return plain.unionByName(cut)


@any_names("doc_id", "text", "source")
def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: a document taken k times is k rows.

    The one document of a source that is taken in part is a row with its first words, joined by one
    space. Rows that are alike in id and text take the mean of their shares, rounded up for the first.
    """
    cols = docs.columns
    shares = mix(docs, doc_id=doc_id, text=text, source=source, **options)
    shares = shares.groupBy("doc_id", "__h").agg(F.sum("taken").alias("__taken"), F.max("size").alias("__size"), F.count(F.lit(1)).alias("__rows"))
    key = F.xxhash64(F.col(text))
    shares = shares.select(F.col("doc_id").alias("__i"), F.col("__h").alias("__j"), "__taken", "__size", "__rows").where("__taken > 0")
    first = docs.withColumn("__key", key)
    repeated = first.join(shares, F.col(doc_id).eqNullSafe(F.col("__i")) & (F.col("__key") == F.col("__j")))
    if_many = Window.partitionBy("__i", "__key").orderBy("__i")
    # equal rows: shares are dealt out in turn; alone in its group in all other cases
    nth = repeated.withColumn("__n", F.row_number().over(if_many))
    whole = F.floor(F.col("__taken") / F.col("__size"))
    rest = F.col("__taken") % F.col("__size")
    per, more = F.floor(whole / F.col("__rows")), whole % F.col("__rows")
    times = (per + F.when(F.col("__n") <= more, 1).otherwise(0)).cast("int")
    partly = (F.col("__n") == F.col("__rows")) & (rest > 0)
    marks = F.concat(
        F.when(times > 0, F.array_repeat(F.lit(-1).cast("long"), times)).otherwise(F.array().cast("array<bigint>")),
        F.when(partly, F.array(rest)).otherwise(F.array().cast("array<bigint>")),
    )
    head = F.array_join(
        F.slice(F.split(trimmed(F.col(text)), f"[{SPACE_CHARS}]+"), 1, F.greatest(F.col("__m"), F.lit(1)).cast("int")), " "
    )
    return nth.withColumn("__m", F.explode(marks)).select(
        *[F.when(F.col("__m") > 0, head).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in cols]
    )
