"""The registered queries of the library over the tables at ``sf_dir``, and their SQL.

All but the calibration queries use the LATIN profile, since the tables hold no Japanese.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import mean, pstdev, rounded
from loomtext.operators import calibrate, documents, findings, lint, morph, parse, semantic, tokens
from loomtext.oracle import SQL
from loomtext.plans.profiles import CATEGORIES, LATIN

#: Part of LATIN's phrases, as if an earlier run had known only these.
EARLIER = LATIN.forbidden[:3]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt to all cores where the table has fewer splits than that. At scale it has more, and
    nothing is moved."""
    docs, cores = read(spark, sf_dir, "documents").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    splits = docs._jdf.queryExecution().toRdd().getNumPartitions()
    return docs.repartition(cores) if splits < cores else docs


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse(texts(spark, sf_dir), LATIN)


def spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line feed doubled: the tables have no blank lines, so else a document is one paragraph."""
    docs = texts(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return parse.parse(docs, LATIN)


def lines(spark, sf_dir):
    return parse.lines_table(parsed(spark, sf_dir))


def sentences(spark, sf_dir):
    return parse.sentences_table(parsed(spark, sf_dir)).select("doc_id", "sent_no", "line", "text")


def paragraphs(spark, sf_dir):
    return parse.paragraphs_table(spaced(spark, sf_dir), LATIN)


def mask_comments(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", parse.mask_comments(F.col("html")).alias("masked"))


def mask_structure(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    return parse.lines_table(parse.parse(pages, LATIN, text="html", doc_id="page_id")).select(F.col("doc_id").alias("page_id"), "line", "masked")


def token_table(spark, sf_dir):
    rows = parse.sentences_table(parsed(spark, sf_dir))
    return rows.select("doc_id", "sent_no", F.posexplode(tokens.surfaces(F.col("text"), LATIN)).alias("pos_no", "token"))


def forbidden_phrase(spark, sf_dir):
    return lint.forbidden_phrases(parsed(spark, sf_dir), LATIN).select("doc_id", "line", "category", "excerpt", "severity")


def findings_by_category(spark, sf_dir):
    found = lint.forbidden_phrases(parsed(spark, sf_dir), LATIN)
    return found.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


def _per_line(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "line", "category").agg(F.count(F.lit(1)).alias("n"))


def translationese(spark, sf_dir):
    return _per_line(lint.translationese(parsed(spark, sf_dir), LATIN))


def inanimate_subject(spark, sf_dir):
    return _per_line(lint.inanimate_subject(parsed(spark, sf_dir), LATIN))


def antithesis_repetition(spark, sf_dir):
    return lint.antithesis(parsed(spark, sf_dir), LATIN).groupBy("doc_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def cleft_pairs(spark, sf_dir):
    return lint.cleft_because(parsed(spark, sf_dir), LATIN).select("doc_id", "line", "excerpt")


def paragraph_lead(spark, sf_dir):
    return lint.paragraph_leads(spaced(spark, sf_dir), LATIN).select("doc_id", "line", "excerpt")


def related_lines(spark, sf_dir):
    found = lint.paragraph_leads(spaced(spark, sf_dir), LATIN)
    return found.groupBy("doc_id").agg(F.array_join(F.first("related_lines"), ",").alias("related"))


def sentence_variance_stats(spark, sf_dir):
    df = parse.keep(parsed(spark, sf_dir), "n", F.transform("sentences", lambda s: F.length(s["text"])))
    return df.where(F.size("n") >= 5).select("doc_id", F.size("n").cast("bigint").alias("sentences"), (pstdev(F.col("n")) / mean(F.col("n"))).alias("cv"))


def low_sentence_variance(spark, sf_dir):
    wide = lint.replace_params(LATIN, variance_cv=0.4)
    return lint.sentence_variance(parsed(spark, sf_dir), wide).select("doc_id", "line", "excerpt")


def uniform_paragraph(spark, sf_dir):
    wide = lint.replace_params(LATIN, uniform_cv=0.5)
    return lint.uniform_paragraphs(spaced(spark, sf_dir), wide).select("doc_id", "line", "excerpt")


def structure_stats(spark, sf_dir):
    return lint.structure_stats(read(spark, sf_dir, "documents").select("doc_id", "text"), LATIN)


def bold_density(spark, sf_dir):
    found = lint.structural(parsed(spark, sf_dir), LATIN).where("category = 'high_bold_density'")
    return found.select("doc_id", "line", "excerpt")


def burstiness(spark, sf_dir):
    return lint.rhythm(tokens.with_tokens(parsed(spark, sf_dir), LATIN), LATIN).select("doc_id", F.col("n").cast("bigint").alias("n"), "mean", "stdev", "burstiness", "autocorr")


def repeated_lead(spark, sf_dir):
    found = lint.repeated_leads(tokens.with_tokens(parsed(spark, sf_dir), LATIN), LATIN)
    return found.groupBy("doc_id", "detail").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"))


def syntax_template(spark, sf_dir):
    p = lint.replace_params(LATIN, template_ratio=0.4).params
    return morph.syntax_template(tokens.with_morphemes(parsed(spark, sf_dir), LATIN), p).select("doc_id", "line", "detail")


def lexical_diversity(spark, sf_dir):
    d = lint.lexical_diversity(tokens.with_tokens(parsed(spark, sf_dir), LATIN), LATIN)
    return d.select("doc_id", F.col("chars").cast("bigint").alias("chars"), F.col("tokens").cast("bigint").alias("tokens"), F.col("types").cast("bigint").alias("types"), "ttr")


def mtld(spark, sf_dir):
    return lint.lexical_diversity(tokens.with_tokens(parsed(spark, sf_dir), LATIN), LATIN).select("doc_id", "mtld").where("mtld is not null")


def nominal_ratio(spark, sf_dir):
    r = morph.nominal_ratio(tokens.with_morphemes(parsed(spark, sf_dir), LATIN))
    return r.select("doc_id", F.col("sentences").cast("bigint").alias("sentences"), F.col("nominal").cast("bigint").alias("nominal"))


def specificity(spark, sf_dir):
    return lint.specificity(spaced(spark, sf_dir), LATIN).drop("head")


def low_specificity(spark, sf_dir):
    wide = lint.replace_params(LATIN, specificity_score=0.02)
    return lint.low_specificity(spaced(spark, sf_dir), wide).select("doc_id", "line", "excerpt", "detail")


def rhythm_findings(spark, sf_dir):
    wide = lint.replace_params(LATIN, burst=-0.4, autocorr=0.2)
    return lint.burstiness(tokens.with_tokens(parsed(spark, sf_dir), LATIN), wide).select("doc_id", "line", "category", "excerpt", "severity")


def low_ttr(spark, sf_dir):
    found = lint.diversity(tokens.with_tokens(parsed(spark, sf_dir), LATIN), LATIN)
    return found.where("category = 'low_lexical_diversity_ttr'").select("doc_id", "line", "excerpt")


def sentence_too_long(spark, sf_dir):
    rows = morph.each_sentence(tokens.with_morphemes(parsed(spark, sf_dir), LATIN))
    return _per_line(morph.too_long(rows, LATIN.params))


def long_run(spark, sf_dir):
    rows = morph.each_sentence(tokens.with_morphemes(parsed(spark, sf_dir), LATIN))
    return _per_line(morph.kanji_run(rows, "[a-z]{14,}")).withColumn("category", F.lit("long_run"))


def no_chain(spark, sf_dir):
    rows = morph.each_sentence(tokens.with_morphemes(parsed(spark, sf_dir), LATIN))
    return morph.no_chain(rows, lambda x, i: x["surface"] == "the").select("doc_id", "line", "excerpt")


def reading_load(spark, sf_dir):
    return morph.reading_load(parsed(spark, sf_dir), LATIN).select("doc_id", "line", "category", "excerpt")


def findings_union(spark, sf_dir):
    return findings.ordered(lint.lint(parsed(spark, sf_dir), LATIN)).select("doc_id", "line", "category", "severity", "excerpt")


def genre_filter(spark, sf_dir):
    found = lint.structural(parsed(spark, sf_dir), LATIN)
    return findings.filtered(found, experimental=True, genre="business").select("doc_id", "line", "category")


def baseline_diff(spark, sf_dir):
    p = parsed(spark, sf_dir)
    old = lint.forbidden_phrases(p, lint.replace_lists(LATIN, forbidden=EARLIER))
    return documents.compare(lint.forbidden_phrases(p, LATIN), old).groupBy("doc_id", "status").agg(F.count(F.lit(1)).alias("n"))


def outline(spark, sf_dir):
    return documents.outline(read(spark, sf_dir, "documents").select("doc_id", "text"), LATIN).select("doc_id", "line", "kind", "text")


def heading_stats(spark, sf_dir):
    rows = parse.lines_table(parsed(spark, sf_dir)).where("masked <> ''")
    heads = rows.select("doc_id", (F.col("line") % 3 + 1).alias("level"), F.col("masked").alias("heading"))
    return documents.heading_stats(heads, LATIN).select("doc_id", "level", "count", "length_mean", "length_cv", "structural_ratio")


def terms(spark, sf_dir):
    return documents.terms(parsed(spark, sf_dir)).select("doc_id", "term", "first_line", "count")


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("sent_no"), "embedding")


def semantic_metrics(spark, sf_dir):
    m = semantic.metrics(_vectors(spark, sf_dir))
    return m.select("doc_id", "n", *[rounded(F.col(c), 6).alias(c) for c in ("adjacent_range", "adjacent_min", "other_max")])


def semantic_findings(spark, sf_dir):
    return semantic.findings(semantic.metrics(_vectors(spark, sf_dir))).select("doc_id", "category", "severity")


def _sides(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"))
    side = F.when(F.col("quality") == 1, "human").otherwise("ai")  # the labels stand for the two sides
    return read(spark, sf_dir, "labels").select("doc_id", side.alias("side")).join(docs, "doc_id")


def fire_matrix(spark, sf_dir):
    p = parsed(spark, sf_dir)
    found = lint.forbidden_phrases(p, LATIN).select("doc_id", "category").unionByName(lint.translationese(p, LATIN).select("doc_id", "category"))
    docs = _sides(spark, sf_dir).withColumnRenamed("side", "grp")
    return calibrate.fire_matrix(spark, found, docs, CATEGORIES).select("category", "grp", "docs", "fired", "fire_rate", "per_1000")


def fire_matrix_whole(spark, sf_dir):
    """As fire_matrix, over the findings of all detectors; its SQL knows two, so this one has none."""
    docs = _sides(spark, sf_dir).withColumnRenamed("side", "grp")
    found = lint.lint(parsed(spark, sf_dir), LATIN).select("doc_id", "category")
    return calibrate.fire_matrix(spark, found, docs, CATEGORIES).select("category", "grp", "docs", "fired", "fire_rate", "per_1000")


def length_bins(spark, sf_dir):
    found = lint.forbidden_phrases(parsed(spark, sf_dir), LATIN).select("doc_id").distinct().withColumn("f", F.lit(True))
    fired = _sides(spark, sf_dir).join(found, "doc_id", "left").withColumn("fired", F.coalesce("f", F.lit(False)))
    return calibrate.length_bins(fired)


def _curve(spark, sf_dir):
    metric = sentence_variance_stats(spark, sf_dir).select("doc_id", F.col("cv").alias("x"))
    sides = _sides(spark, sf_dir).select("doc_id", "side").join(metric, "doc_id", "left")
    return calibrate.sweep(sides, calibrate.grid(0.05, 0.6, 0.02))


def sweep_curve(spark, sf_dir):
    return _curve(spark, sf_dir)


def sweep_recommend(spark, sf_dir):
    return calibrate.recommend(_curve(spark, sf_dir), most_fp=0.5)


def sweep_curves(spark, sf_dir):
    """All twelve sweeps; paragraphs need the doubled line feeds."""
    return calibrate.sweeps(calibrate.metrics(spaced(spark, sf_dir), LATIN), _sides(spark, sf_dir).select("doc_id", "side"))


def sweep_recommendations(spark, sf_dir):
    return calibrate.recommend(sweep_curves(spark, sf_dir), by=("detector",))


def naturalness_score(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.naturalness(lint.forbidden_phrases(parsed(spark, sf_dir), LATIN), docs).select("doc_id", F.col("chars").cast("bigint").alias("chars"), "score", "band")


def naturalness_score_whole(spark, sf_dir):
    """As naturalness_score, over the findings of all detectors; the SQL weighs one, so this one has none."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.naturalness(lint.lint(parsed(spark, sf_dir), LATIN), docs).select("doc_id", F.col("chars").cast("bigint").alias("chars"), "score", "band")


_OWN = (
    lines, sentences, paragraphs, mask_comments, mask_structure, token_table, forbidden_phrase, findings_by_category, translationese, inanimate_subject,
    antithesis_repetition, cleft_pairs, paragraph_lead, related_lines, sentence_variance_stats, low_sentence_variance, uniform_paragraph, structure_stats,
    bold_density, burstiness, repeated_lead, syntax_template, lexical_diversity, mtld, nominal_ratio, specificity, low_specificity, rhythm_findings, low_ttr, sentence_too_long, long_run, no_chain,
    reading_load, findings_union, genre_filter, baseline_diff, outline, heading_stats, terms, semantic_metrics, semantic_findings, fire_matrix, length_bins,
    sweep_curve, sweep_recommend, naturalness_score, fire_matrix_whole, naturalness_score_whole,
    sweep_curves, sweep_recommendations,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OWN}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
