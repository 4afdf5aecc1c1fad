"""Catalog candidate scoring and best-candidate choice.

The rule is ``kb in title`` for every (target, candidate) pair. Here each title
is turned into the KB ids that can occur in it as a substring ('KB' + prefixes of a
digit run that follows 'kb'), of the lengths that target ids have, so the pair
search becomes an equi-join on kb_id with the same answers and no nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: scoring weights and thresholds
REJECT_SCORE = -10_000
MIN_CONFIDENCE_SCORE = 90
KB_IN_TITLE = 50
FAMILY_MATCH = 40
ARCH_MATCH = 25
VERSION_MATCH = 25
OTHER_VERSION_PENALTY = -15
BUILD_MATCH = 10
BUILD_MISMATCH = -5
TOP_CANDIDATES = 3
NO_CANDIDATE_REASON = "No candidate matched baseline constraints"
AMBIGUOUS_REASON = "Ambiguous match below confidence threshold ({score})"


def title_kb_keys(title, lengths: list[int] | None = None) -> Column:
    """The 'KB<digits>' strings that are substrings of the title (case-insensitive).

    ``lengths`` keeps ids with so many digits; short prefixes that no target has would
    be keys that nearly all titles share.
    """
    runs = F.regexp_extract_all(F.lower(title), F.lit(r"kb([0-9]+)"), 1)
    wanted = (lambda d: F.sequence(F.lit(1), F.length(d))) if lengths is None else (
        lambda d: F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(d)))
    prefixes = F.transform(runs, lambda d: F.transform(
        wanted(d), lambda j: F.concat(F.lit("KB"), F.substring(d, F.lit(1), j))))
    return F.array_distinct(F.flatten(prefixes))


def _has_any(t: Column, tokens) -> Column:
    out = F.lit(False)
    for tok in tokens:
        out = out | t.contains(tok)
    return out


def score_expr(title: Column, gen: Column, version: Column, build_major: Column, arch: Column) -> Column:
    """Candidate score for one (target, candidate) pair whose KB is in the title."""
    t = F.lower(title)
    g = F.coalesce(gen, F.lit(""))
    dv = F.lower(F.coalesce(version, F.lit("")))
    bm = F.coalesce(build_major, F.lit(""))
    a = F.coalesce(arch, F.lit("x64"))
    reject = (
        ((g == "windows 10") & t.contains("windows 11"))
        | ((g == "windows 11") & t.contains("windows 10"))
        | (g.startswith("windows") & t.contains("server"))
        | ((a == "x64") & _has_any(t, ("arm64-based", "x86-based", "32-bit")))
        | ((a == "arm64") & _has_any(t, ("x64-based", "x86-based", "32-bit")))
        | ((a == "x86") & _has_any(t, ("x64-based", "arm64-based"))))
    arch_hit = (((a == "x64") & t.contains("x64-based"))
                | ((a == "arm64") & t.contains("arm64-based"))
                | ((a == "x86") & (t.contains("x86-based") | t.contains("32-bit"))))
    build = F.regexp_extract(t, r"\(\s*(\d{5})\.", 1)
    score = (F.lit(KB_IN_TITLE)
             + F.when((g != "") & t.contains(g), FAMILY_MATCH).otherwise(0)
             + F.when(arch_hit, ARCH_MATCH).otherwise(0)
             + F.when((dv != "") & t.contains(dv), VERSION_MATCH).otherwise(0)
             + F.when((dv != "") & t.rlike(r"\b\d{2}h[12]\b") & ~t.contains(dv), OTHER_VERSION_PENALTY).otherwise(0)
             + F.when((bm != "") & (build != ""),
                      F.when(build == bm, BUILD_MATCH).otherwise(BUILD_MISMATCH)).otherwise(0))
    return F.when(reject, F.lit(REJECT_SCORE)).otherwise(score)


def score_candidates(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every (target, candidate) pair whose target KB occurs in the title, with its score.

    targets: kb_id, windows_gen, display_version, build_major, catalog_arch (+ any keys)
    candidates: update_id, title, candidate_pos (+ other catalog fields)
    """
    # a handful of numbers: how many digits target ids have
    lengths = [r["n"] for r in targets.select((F.length("kb_id") - 2).alias("n")).where("n > 0").distinct().orderBy("n").collect()]
    keyed = candidates.withColumn("kb_id", F.explode(title_kb_keys(F.col("title"), lengths)))
    # both sides grow with the catalog, and Spark's estimate of a derived title is far below its bytes: no broadcast
    pairs = targets.join(keyed.hint("merge"), "kb_id")
    return pairs.withColumn("score", score_expr(F.col("title"), F.col("windows_gen"), F.col("display_version"),
                                                F.col("build_major"), F.col("catalog_arch")))


def _catalog_order(scored: DataFrame) -> list[str]:
    """Position of a candidate: its page, if it comes from pages, and its place there."""
    return [c for c in ("candidate_pos", "page_id") if c in scored.columns]


def best_candidates(targets: DataFrame, scored: DataFrame, keys=("kb_id",)) -> DataFrame:
    """Per target: best accepted candidate (score >= 0, ties by catalog order),
    rejected as ambiguous below the confidence threshold, or a reason when none."""
    keys = list(keys)
    accepted = scored.where(F.col("score") >= 0)
    # top-1 as an aggregate (highest score, then earliest catalog position, page and id):
    # partial aggregation before the shuffle, so a target with very many candidates stays cheap
    best = accepted.groupBy(*keys).agg(
        F.max_by(F.struct("update_id", "title", "score"),
                 F.struct(F.col("score"), *[(-F.col(c)).alias(f"p{i}") for i, c in enumerate(_catalog_order(scored))],
                          F.col("update_id").alias("u"))).alias("_b"),
        F.count(F.lit(1)).alias("candidates_matching"))
    best = best.select(*keys, "_b.*", "candidates_matching")
    out = targets.select(*keys).join(best.hint("merge"), keys, "left")  # a row per target: not to be broadcast by estimate
    confident = F.col("score") >= MIN_CONFIDENCE_SCORE
    return out.select(
        *keys,
        F.when(confident, F.col("update_id")).alias("update_id"),
        F.when(confident, F.col("title")).alias("title"),
        F.col("score").cast("double").alias("best_score"),
        F.coalesce(F.col("candidates_matching"), F.lit(0)).alias("candidates_matching"),
        F.when(F.col("score").isNull(), F.lit(NO_CANDIDATE_REASON))
         .when(~confident, F.format_string(AMBIGUOUS_REASON.replace("{score}", "%d"), F.col("score")))
         .alias("reason"))


def top_candidates(scored: DataFrame, keys=("kb_id",), k: int = TOP_CANDIDATES) -> DataFrame:
    """The k highest-scoring accepted candidates per target (listing)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), *_catalog_order(scored), F.col("update_id").desc())
    return (scored.where(F.col("score") >= 0).withColumn("pos", F.row_number().over(w))
            .where(F.col("pos") <= k).select(*keys, "pos", "score", "update_id", "title"))
