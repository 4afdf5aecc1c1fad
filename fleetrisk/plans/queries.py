"""Registered queries: each takes (spark, folder of the driver's tables) -> DataFrame.

The domain tables are derived from the given tables by Spark jobs
(sources.derived), so every query's work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetrisk.operators import baseline as bl
from fleetrisk.operators import enrich as en
from fleetrisk.operators import flatten as fl
from fleetrisk.operators import policy as po
from fleetrisk.operators import rank as rk
from fleetrisk.operators.joins import saved, saved_alone
from fleetrisk.session import free_shuffles
from fleetrisk.sources import derived as dv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, d: str) -> DataFrame:
        free_shuffles(spark)
        return fn(spark, d)
    QUERIES[fn.__name__] = run
    return fn


# ---------------------------------------------------------------- shared stages

def training_flat(spark: SparkSession, d: str) -> DataFrame:
    entries = dv.kb_entries(spark, d)
    return fl.dedupe(fl.flatten(entries), fl.TRAINING_KEYS)


def cve_dim(spark: SparkSession, d: str) -> DataFrame:
    return en.score_dimension(en.prepare_dimension(dv.cve_meta(spark, d), dv.as_of()))


def training_enriched(spark: SparkSession, d: str) -> DataFrame:
    return en.enrich(training_flat(spark, d), cve_dim(spark, d), scored=True)


def training_validated(spark: SparkSession, d: str) -> DataFrame:
    # flat rows are distinct on (kb, cve, month) and the dimension join is many-to-one
    return po.validate(po.label(training_enriched(spark, d)), assume_unique=True, ids_checked=True)


def _drivers_text(df: DataFrame) -> DataFrame:
    """Output form: drivers as text, the nullable age as a double."""
    return df.withColumns({"policy_drivers": F.array_join("policy_drivers", ", "), "patch_age_days": F.col("patch_age_days").cast("double")})


# ---------------------------------------------------------------- flatten

@query
def flatten_training(spark, d):
    """A1 + J13: all scans' KB entries -> distinct (kb_id, cve_id, month)."""
    return training_flat(spark, d)


@query
def flatten_counters(spark, d):
    """Raw rows, skipped entries / ids, duplicates (long table)."""
    entries = dv.kb_entries(spark, d).checkpoint(eager=True)  # read twice below
    return fl.flatten_counters(entries, fl.dedupe(fl.flatten(entries)))


@query
def scope_counts(spark, d):
    """G1: distinct KBs, CVEs, months and rows."""
    return fl.scope_counts(training_flat(spark, d))


# ---------------------------------------------------------------- enrich / policy

@query
def cve_dimension(spark, d):
    """P7, P8, P11, K1-K5 on the CVE dimension (dimension-first scoring)."""
    return _drivers_text(cve_dim(spark, d))


@query
def enriched(spark, d):
    """Flattened rows LEFT JOIN scored CVE metadata."""
    return _drivers_text(training_enriched(spark, d))


@query
def enrich_counters(spark, d):
    """G4 + J2: requested / matched / missing CVEs and metadata row counts."""
    flat = training_flat(spark, d)
    dim = cve_dim(spark, d)
    return en.enrich_counters(flat, dim)


@query
def unmatched_cves(spark, d):
    """First 10 requested CVEs without metadata, sorted."""
    return en.first_missing(training_flat(spark, d), cve_dim(spark, d), 10)


@query
def validated(spark, d):
    """K6 + K7: labelled rows that pass validation."""
    return _drivers_text(training_validated(spark, d))


@query
def validation_counters(spark, d):
    """Rows before/after, dropped, non-CVE, missing required, duplicates."""
    labelled = po.label(training_enriched(spark, d))
    return po.validation_counters(labelled)


@query
def label_distribution(spark, d):
    """Priority label counts."""
    return rk.label_distribution(training_validated(spark, d), "priority_label")


@query
def score_range(spark, d):
    """Min / max / mean policy risk per priority label."""
    return rk.score_range(training_validated(spark, d), "policy_risk", by=["priority_label"])


@query
def kb_ranking(spark, d):
    """G7 + R1 at training grain: KBs ranked by max policy risk (ties by kb_id)."""
    rolled = rk.kb_rollup(training_validated(spark, d), keys=())
    return rk.rank_kbs(rolled, keys=()).select(
        "rank", "kb_id", "policy_risk", "policy_priority", "cve_count", "top_driver", "review_reason")


# ---------------------------------------------------------------- closure and correlation

from fleetrisk.operators import correlate as co  # noqa: E402


def fleet_correlation(spark: SparkSession, d: str) -> tuple[DataFrame, co.Correlation]:
    """KB entries and installed sets are read by the closure rounds, the status join
    and the flatten: both come from one (scan, part) aggregate over the three-way
    link join (one pass), saved once with the columns of the part instead of
    recomputing the join for every use."""
    both = saved(dv.described(spark, d, dv.text_groups(dv.link(spark, d))))
    entries = both.select(*dv.ENTRY_COLUMNS)
    return entries, co.correlate(entries, dv.installed(spark, d, groups=both))


@query
def closure_pairs(spark, d):
    """(scan, installed root, KB reachable through >= 1 supersedence edge)."""
    return fleet_correlation(spark, d)[1]["reached"]


@query
def logical_present(spark, d):
    """Installed KBs plus everything they transitively replace."""
    return fleet_correlation(spark, d)[1]["present"]


@query
def missing_kbs(spark, d):
    """J4 + J8: expected minus logically present, with update type."""
    entries, c = fleet_correlation(spark, d)
    return co.missing_list(c, entries)


@query
def kb_status(spark, d):
    """J6 + J7: per expected KB its type, status, months and CVE count."""
    return fleet_correlation(spark, d)[1]["status"]


@query
def kb_table_top10(spark, d):
    """First 10 correlation rows per scan (KB order) and the remaining count."""
    status = fleet_correlation(spark, d)[1]["status"]
    top = rk.top_per_group(status, ["scan_id"], [F.col("kb_id")], rk.KB_TABLE_LIMIT, "pos")
    totals = status.groupBy("scan_id").agg(F.count(F.lit(1)).alias("_n"))
    return (top.join(totals, "scan_id")
            .withColumn("remaining", F.greatest(F.col("_n") - rk.KB_TABLE_LIMIT, F.lit(0)))
            .drop("_n"))


@query
def scan_summary(spark, d):
    """Per scan expected / installed / present / superseded / missing counts."""
    return co.scan_summary(fleet_correlation(spark, d)[1])


@query
def missing_breakdown(spark, d):
    """Missing KBs per scan split by update type."""
    entries, c = fleet_correlation(spark, d)
    return co.missing_breakdown(co.missing_list(c, entries))


@query
def source_summary(spark, d):
    """Per scan, KB entries and missing KBs."""
    entries, c = fleet_correlation(spark, d)
    return fl.source_summary(entries, c["missing"])


@query
def months_with_entries(spark, d):
    """Per scan, sorted months that returned KB entries."""
    out = co.months_with_entries(dv.kb_entries(spark, d))
    return out.withColumn("months_with_entries", F.array_join("months_with_entries", ", "))


from fleetrisk.session import shared_folder  # noqa: E402
from fleetrisk.sources import scan_files as sf  # noqa: E402
from fleetrisk.sources import scans as sc  # noqa: E402


def exported_scans(spark: SparkSession, d: str) -> str:
    """A folder of scan documents: every host's correlation, and an older scan without its installed KBs."""
    entries, c = fleet_correlation(spark, d)
    b = dv.baselines(spark, d).checkpoint(eager=True)
    months = bl.month_window(b)[0]
    folder = shared_folder(spark, "scans")
    old, new = (F.lit(t).cast("timestamp") for t in ("2001-08-01 00:00:00", dv.AS_OF))
    sc.export_scans(entries, c["installed"].limit(0), c["missing"].limit(0), b, months, folder, old, packed=True)
    sc.export_scans(entries, c["installed"], c["missing"], b, months, folder, new, segment_rows=5_000, packed=True)
    return folder


@query
def scan_documents(spark, d):
    """S4 + S1 + S2: correlations exported as nested documents, each host's newest scan read back from JSON."""
    docs = sf.read(spark, exported_scans(spark, d), latest=True).where("valid")
    missing = sc.stored_missing(docs).withColumn("missing", F.lit(True))
    entries = sc.kb_entries(docs).where("kb_id <> ''")
    return (entries.join(missing, ["scan_id", "kb_id"], "left")
            .select(F.split("scan_id", "/")[0].cast("int").alias("scan_id"), "kb_id", F.array_join("months", ", ").alias("months"),
                    F.size("cves").alias("cve_count"), F.coalesce("missing", F.lit(False)).alias("missing")))


# ---------------------------------------------------------------- runtime (per scan)

def runtime_validated(spark: SparkSession, d: str) -> DataFrame:
    entries, c = fleet_correlation(spark, d)
    flat = fl.dedupe(fl.flatten(entries, c["missing"]), fl.RUNTIME_KEYS)
    enriched_rows = en.enrich(flat, cve_dim(spark, d), scored=True)
    return po.validate(enriched_rows, keys=fl.RUNTIME_KEYS, assume_unique=True, ids_checked=True)


#: columns of the scored rows that rankings and reports show
SHOWN = ("scan_id", "kb_id", "cve_id", "month", "policy_risk", "policy_priority", "top_driver", "policy_drivers")


def runtime_shown(spark: SparkSession, d: str) -> DataFrame:
    """The scored rows with what rankings and reports show, saved: they are read more than once."""
    return saved_alone(spark, lambda: runtime_validated(spark, d).select(*SHOWN))


def runtime_ranking(spark: SparkSession, d: str) -> DataFrame:
    rolled = rk.kb_rollup(runtime_validated(spark, d), keys=("scan_id",))
    return rk.rank_kbs(rolled, keys=("scan_id",)).select(
        "scan_id", "rank", "kb_id", "policy_risk", "policy_priority", "cve_count", "top_driver", "review_reason")


@query
def runtime_flatten(spark, d):
    """Per scan flatten restricted to the scan's missing KBs."""
    entries, c = fleet_correlation(spark, d)
    return fl.dedupe(fl.flatten(entries, c["missing"]), fl.RUNTIME_KEYS)


@query
def fleet_ranking(spark, d):
    """C5 (policy): per scan, missing KBs ranked by max policy risk."""
    return runtime_ranking(spark, d)


@query
def cve_counts(spark, d):
    """Per scan and missing KB: CVE rows and distinct CVEs."""
    return rk.cve_counts(runtime_validated(spark, d))


@query
def nested_ranking(spark, d):
    """R2: each ranked KB with its CVE list by risk, written as text for comparison."""
    scored = runtime_shown(spark, d)
    ranking = saved_alone(spark, lambda: rk.rank_kbs(rk.kb_rollup(scored, keys=("scan_id",)), keys=("scan_id",)))
    nested = rk.nested_ranking(ranking, scored)
    cves = F.array_join(F.transform("cves", lambda x: F.concat_ws("|", x["cve_id"], F.format_string("%.2f", x["policy_risk"]),
                                                                  x["policy_priority"], x["drivers"])), "; ")
    return nested.select("scan_id", "rank", "kb_id", F.size("cves").cast("long").alias("cve_rows"), cves.alias("cves"))


@query
def runtime_flatten_counters(spark, d):
    """G2 with the missing sets: entries that are not missing are skipped."""
    entries, c = fleet_correlation(spark, d)
    flat = fl.flatten(entries, c["missing"])
    return fl.flatten_counters(entries, fl.dedupe(flat, fl.RUNTIME_KEYS), c["missing"])


@query
def ranking_summary(spark, d):
    """Per scan KB count, CVE rows reviewed, highest risk and priority."""
    return rk.ranking_summary(runtime_ranking(spark, d))


@query
def cve_preview(spark, d):
    """Top 10 CVE rows per missing KB and the hidden count."""
    shown = ["cve_id", "month", "policy_risk", "policy_priority", "top_driver"]
    out = rk.cve_preview(runtime_validated(spark, d).select("scan_id", "kb_id", *shown), keys=("scan_id",))
    return out.select("scan_id", "kb_id", "cve_rank", *shown, "cve_total", "hidden_count")


# ---------------------------------------------------------------- hosts, months, candidates, text

from fleetrisk.functions import platform as pf  # noqa: E402
from fleetrisk.operators import match as mt  # noqa: E402
from fleetrisk.operators import text as tx  # noqa: E402
from fleetrisk.sources.tables import read_ranking, read_table, write_ranking, write_stage  # noqa: E402


@query
def host_constraints(spark, d):
    """Per host OS family, display version, build major and architecture tokens."""
    b = dv.baselines(spark, d)
    return pf.constraints(b).join(b.select("scan_id", pf.display_arch("Architecture").alias("arch_label"),
                                           pf.feed_arch_token("Architecture").alias("feed_arch")), "scan_id")


@query
def month_window(spark, d):
    """A5 + A7: per admitted host the LCU-to-latest month ids (oldest 48 kept)."""
    return bl.month_window(dv.baselines(spark, d))[0]


@query
def month_window_rejects(spark, d):
    """A5: hosts whose window cannot be built, with the reason."""
    return bl.month_window(dv.baselines(spark, d))[1]


@query
def latest_month(spark, d):
    """Per host the newest month id among its entries, by date not text."""
    months = dv.kb_entries(spark, d).select("scan_id", F.explode("months").alias("month"))
    return bl.latest_month(months)


def _scored_candidates(spark, d):
    return mt.score_candidates(dv.targets(spark, d), dv.candidates(spark, d))


@query
def candidate_scores(spark, d):
    """Score of every (target KB, catalog candidate) pair whose KB is in the title."""
    return _scored_candidates(spark, d).select("kb_id", "update_id", "candidate_pos", "score")


@query
def best_candidate(spark, d):
    """Best candidate per target, ambiguous below 90, reason when none."""
    return mt.best_candidates(dv.targets(spark, d), _scored_candidates(spark, d))


@query
def candidate_top3(spark, d):
    """R5 listing: three highest-scoring accepted candidates per target."""
    return mt.top_candidates(_scored_candidates(spark, d))


@query
def package_urls(spark, d):
    """.msu / .cab package links per stored page, first-seen order, file names."""
    return tx.extract_urls(read_table(spark, d, "pages"))


@query
def download_urls(spark, d):
    """Package links of derived download dialogs, first-seen order, file names."""
    return tx.extract_urls(dv.download_pages(spark, d))


@query
def page_links(spark, d):
    """T2 operator with an href pattern: distinct links per page in first-seen order."""
    return tx.extract_urls(read_table(spark, d, "pages"), pattern=tx.HREF_PATTERN, group=1)


@query
def result_rows(spark, d):
    """Catalog result-table rows extracted from derived catalog pages."""
    return tx.result_rows(dv.catalog_pages(spark, d))


def missing_targets(spark: SparkSession, d: str) -> DataFrame:
    """P14 x J8: each host's missing KBs with the constraints a candidate must satisfy."""
    entries, c = fleet_correlation(spark, d)
    hosts = pf.constraints(dv.baselines(spark, d)).select(
        "scan_id", "windows_gen", F.lower("display_version").alias("display_version"), "build_major", "catalog_arch")
    return co.missing_list(c, entries).select("scan_id", "kb_id").join(hosts, "scan_id")


@query
def missing_update_candidates(spark, d):
    """Constraints and missing KBs of every host matched with the rows of the catalog pages."""
    # hosts share constraints: candidates are scored once per KB and constraint set
    targets = saved(missing_targets(spark, d))
    keys = ["kb_id", "windows_gen", "display_version", "build_major", "catalog_arch"]
    distinct = targets.select(*keys).distinct()
    scored = mt.score_candidates(distinct, tx.result_rows(dv.catalog_pages(spark, d)))
    best = mt.best_candidates(distinct, scored, keys)
    return targets.join(best.hint("merge"), keys).select("scan_id", "kb_id", "update_id", "best_score", "candidates_matching", "reason")


@query
def months_with_entries_batch(spark, d):
    """A6 at batch grain: months of every request of three that returned an entry."""
    lnk = dv.link(spark, d)
    months = bl.month_window(dv.baselines(spark, d, lnk))[0]
    out = co.months_with_entries(dv.kb_entries(spark, d, lnk), grain="batch", requested=months)
    return out.withColumn("months_with_entries", F.array_join("months_with_entries", ", "))


# ---------------------------------------------------------------- models

from fleetrisk.operators import ml  # noqa: E402


def _model_input(spark, d):
    """Row key, model inputs and labels of the labelled rows: all that a split or a fit needs."""
    return ml.model_frame(training_validated(spark, d)).select(*ml.ROW_KEY, *ml.MODEL_INPUTS, *ml.LABELS)


@query
def ml_scaling(spark, d):
    """M1, M2: median, mean and deviation of the numeric inputs, from compacted rows with weights."""
    medians, means, deviations = ml.scaling(ml.training_set(training_validated(spark, d)))
    rows = [(c, round(medians[c], 6), round(means[c], 6), round(deviations[c], 6)) for c in ml.NUMERIC]
    return spark.createDataFrame(rows, "feature string, median double, mean double, deviation double")


@query
def ml_split_sizes(spark, d):
    """M4: rows of each label on both sides of the stratified split."""
    train, test = ml.stratified_split(_model_input(spark, d), "priority_label")
    both = train.select("priority_label", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        test.select("priority_label", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("priority_label").agg(F.sum("a").alias("train_rows"), F.sum("b").alias("test_rows"))


@query
def ml_total_sum_of_squares(spark, d):
    """M8 at k = 1: sum of squares of the scaled, one-hot encoded features around their mean."""
    rows = ml.training_set(training_validated(spark, d))
    feats = ml.Pipeline(stages=ml.preprocessing(rows, scale=True)).fit(rows).transform(rows)
    return spark.createDataFrame([(round(ml.total_sum_of_squares(feats), 3),)], "wcss double")


@query
def ml_regression_eval(spark, d):
    """M1, M3, M5, M9: forest on the policy score, hash 80/20 split, MAE / RMSE / R2."""
    train, test = ml.hash_split(_model_input(spark, d))
    model = ml.fit_regression(saved(ml.compact(train, ml.LABELS)))
    # evaluated on the compacted test rows (inputs + labels, with counts): same metrics
    return ml.regression_metrics(model.transform(ml.compact(test, ml.LABELS)), "risk_score", "ml_risk", "row_weight")


@query
def ml_classification_eval(spark, d):
    """Weighted logistic regression, stratified split, accuracy / weighted F1."""
    train, test = ml.stratified_split(_model_input(spark, d), "priority_label")
    model = ml.fit_classification(saved(ml.compact(train, ml.LABELS)))
    return ml.classification_metrics(model.transform(ml.compact(test, ml.LABELS)), "priority_label", "ml_priority",
                                      "row_weight")


@query
def ml_cluster_profile(spark, d):
    """M7 + G14: k-means (5 clusters, 10 restarts) sizes and mean risk per cluster.

    Clusters depend only on the model inputs, and the compacted training set groups
    on exactly those (plus the labels), so the profile is a weighted aggregate over
    it: one pass over the labelled rows, not a second one to assign clusters."""
    frame = ml.training_set(training_validated(spark, d))
    return ml.cluster_profile(ml.fit_clustering(frame).transform(frame), weight="row_weight")


@query
def ml_elbow(spark, d):
    """M8 + M14: within-cluster sum of squares for k = 1..10."""
    return ml.elbow(ml.training_set(training_validated(spark, d)))


@query
def ml_feature_importance(spark, d):
    """Ten most important forest features."""
    frame = ml.training_set(training_validated(spark, d))
    return ml.feature_importance(ml.fit_regression(frame), frame)


@query
def ml_fleet_ranking(spark, d):
    """M11 + G7 + R1: per scan ranking with model risk, model priority and modal cluster; models of the training side."""
    models = ml.evaluated_models(_model_input(spark, d)).models
    scored = ml.predict(models, runtime_validated(spark, d))
    rolled = rk.kb_rollup(scored, keys=("scan_id",), with_ml=True)
    return rk.rank_kbs(rolled, keys=("scan_id",)).select(
        "scan_id", "rank", "kb_id", "policy_risk", "ml_risk", "policy_priority", "ml_priority", "cluster",
        "cve_count", "top_driver", "review_reason")


@query
def regression_metrics_baseline(spark, d):
    """M9 on a fixed pair: CVSS score as a predictor of the policy score."""
    return ml.regression_metrics(training_validated(spark, d), "policy_risk", "cvss_score")


@query
def classification_metrics_baseline(spark, d):
    """M10 on a fixed pair: vendor severity mapped to a priority, against the policy priority."""
    v = training_validated(spark, d).withColumn(
        "severity_priority", F.when(F.col("severity") == "Critical", "High")
        .when(F.col("severity") == "Important", "Medium").otherwise("Low"))
    return ml.classification_metrics(v, "priority_label", "severity_priority")


# ---------------------------------------------------------------- report

from fleetrisk.plans import report as rp  # noqa: E402


@query
def report_lines(spark, d):
    """S10 + C7: per-scan Markdown report lines (summary, ranked table, drivers, CVE review)."""
    scored = runtime_shown(spark, d)
    ranking = saved_alone(spark, lambda: rk.rank_kbs(rk.kb_rollup(scored, keys=("scan_id",)), keys=("scan_id",)))
    return rp.scan_report(ranking, scored, rk.ranking_summary(ranking))


@query
def saved_report(spark, d):
    """C7 + S10 sink: report documents written as text, one folder per scan, and their lines read back."""
    path = f"{shared_folder(spark, 'reports')}/report"
    rp.write_report(report_lines(spark, d), path)
    return spark.read.schema("line string, scan_id string").text(path).select("scan_id", "line")


@query
def feature_profiles(spark, d):
    """What is left of the labelled rows as features (no ids, dates, labels or policy outputs), and how often each profile occurs."""
    features = ml.feature_columns(training_validated(spark, d))
    return features.groupBy(*features.columns).agg(F.count(F.lit(1)).alias("rows")).withColumn("patch_age_days", F.col("patch_age_days").cast("double"))


@query
def fleet_report(spark, d):
    """C7 with models: per-scan report lines with model risk, priority and cluster, and the fleet document.

    Models are fitted on one side of a split, and the evaluation is that of the other side."""
    fitted = ml.evaluated_models(_model_input(spark, d))
    scored = saved_alone(spark, lambda: ml.predict(fitted.models, runtime_validated(spark, d)).select(*SHOWN, "ml_risk", "ml_priority", "cluster"))
    ranking = saved_alone(spark, lambda: rk.rank_kbs(rk.kb_rollup(scored, keys=("scan_id",), with_ml=True), keys=("scan_id",)))
    summary = ml.run_summary("run", {"regression": fitted.regression, "classification": fitted.classification})
    return rp.scan_report(ranking, scored, rk.ranking_summary(ranking)).unionByName(rp.fleet_report(spark, summary))


@query
def cluster_scatter(spark, d):
    """Rows per rounded score, rounded risk and cluster."""
    frame = ml.training_set(training_validated(spark, d))
    return ml.cluster_scatter(ml.fit_clustering(frame).transform(frame), weight="row_weight")


def _fixed_predictions(scored: DataFrame) -> DataFrame:
    """Columns of model predictions by a fixed rule of the CVE number, so that what is built on them can be compared."""
    number = F.substring_index("cve_id", "-", -1).cast("long")
    priority = F.when(number % 4 == 0, "High").when(number % 4 == 1, "Medium").when(number % 4 == 2, "Low")
    return scored.withColumns({"ml_risk": F.col("cvss_score").cast("double"), "ml_priority": priority, "cluster": (number % 5).cast("int")})


@query
def fixed_model_ranking(spark, d):
    """G7, G9, R7 with model columns: ranking over fixed predictions (highest risk and priority, modal cluster)."""
    rolled = rk.kb_rollup(_fixed_predictions(runtime_validated(spark, d)), keys=("scan_id",), with_ml=True)
    return rk.rank_kbs(rolled, keys=("scan_id",)).select("scan_id", "rank", "kb_id", "policy_risk", "ml_risk", "ml_priority", "cluster")


@query
def fixed_model_summary(spark, d):
    """G15 with model columns: highest model risk and priority of each scan's ranking over fixed predictions."""
    rolled = rk.kb_rollup(_fixed_predictions(runtime_validated(spark, d)), keys=("scan_id",), with_ml=True)
    return rk.ranking_summary(rk.rank_kbs(rolled, keys=("scan_id",))).select("scan_id", "kb_count", "highest_ml_risk", "highest_ml_priority")


@query
def fixed_cluster_profile(spark, d):
    """G14 on fixed clusters, over compacted rows: size and mean risk of each cluster."""
    rows = _fixed_predictions(training_validated(spark, d)).withColumn("risk_score", F.col("risk_score").cast("double"))
    compacted = rows.groupBy("cluster", "risk_score", "cvss_score").agg(F.count(F.lit(1)).cast("double").alias("row_weight"))
    return ml.cluster_profile(compacted, weight="row_weight")


@query
def fixed_cluster_scatter(spark, d):
    """M14 on fixed clusters: rows per rounded score, rounded risk and cluster."""
    return ml.cluster_scatter(_fixed_predictions(training_validated(spark, d)))


@query
def saved_ranking(spark, d):
    """C5 export + S5 + S6: nested rankings written as JSON, one folder per scan, and read back."""
    scored = runtime_shown(spark, d)
    ranking = saved_alone(spark, lambda: rk.rank_kbs(rk.kb_rollup(scored, keys=("scan_id",)), keys=("scan_id",)))
    path = f"{shared_folder(spark, 'rankings')}/ranking"
    write_ranking(rk.nested_ranking(ranking, scored, segment_rows=500), path)
    back = read_ranking(spark, path).where("_corrupt_record IS NULL OR kb_id IS NOT NULL")
    return back.groupBy("scan_id", "rank", "kb_id", "policy_risk", "cve_count").agg(
        F.sum(F.size("cves")).alias("cve_rows"), F.max(F.array_max(F.transform("cves", lambda x: x["policy_risk"]))).alias("highest_cve_risk")).select(
        F.col("scan_id").cast("int").alias("scan_id"), "rank", "kb_id", "policy_risk", "cve_count", "cve_rows", "highest_cve_risk")


# ---------------------------------------------------------------- feed products, inventory, product names

from fleetrisk.functions.months import parse_month_id  # noqa: E402

PRODUCT = "Windows 10 Version 23H2 for ARM64-based Systems"


@query
def product_kb_map(spark, d):
    """A2 + A4 + P16: KB entries of one product from the affected-software rows."""
    out = co.product_kb_map(dv.product_rows(spark, d), PRODUCT)
    return out.select("scan_id", "kb_id", F.array_join("months", ", ").alias("months"),
                      F.array_join("cves", ", ").alias("cves"), F.array_join("supersedes", ", ").alias("supersedes"),
                      "update_type")


@query
def installed_inventory(spark, d):
    """Hot-fix KBs union package KBs (name, else description), packages only with admin rights."""
    lnk = dv.link(spark, d)
    return bl.inventory(dv.hotfixes(spark, d, lnk), dv.packages(spark, d, lnk), dv.baselines(spark, d, lnk))


@query
def lcu_context(spark, d):
    """Newest cumulative-update package per host (month id, name, install time)."""
    lnk = dv.link(spark, d)
    return bl.lcu_context(dv.packages(spark, d, lnk), dv.baselines(spark, d, lnk))


def _product_hints(spark: SparkSession, d: str, lnk: DataFrame, b: DataFrame) -> DataFrame:
    known = F.col("scan_id") % 23 != 9  # a host without a recognised family keeps its row
    hosts = b.select("scan_id", F.when(known, F.initcap(pf.os_family("OsName"))).alias("family"),
                     F.col("DisplayVersion").alias("display_version"),
                     pf.feed_arch_token("Architecture").alias("arch_token"),
                     parse_month_id("MsrcLatestMonthId").alias("latest_month"))
    products = dv.product_rows(spark, d, lnk).select(F.col("month_start").alias("month"),
                                                      F.col("full_product_name").alias("product_name"))
    return bl.resolve_product(hosts, products)


@query
def product_name_hint(spark, d):
    """J10 + J11: best feed product name per host within six months of its latest month."""
    lnk = dv.link(spark, d)
    hints = _product_hints(spark, d, lnk, dv.baselines(spark, d, lnk))
    return hints.withColumn("match_rank", F.col("match_rank").cast("double"))


def scanner_run(spark: SparkSession, d: str) -> tuple[co.Correlation, DataFrame, DataFrame]:
    """C1, each step on the step before: baseline and inventory, product resolution, month window, requests of
    three months, the entries of each request, merged entries, closure.

    Returns the correlation, the entries of each request, and (scan_id, reason) of every host:
    why it has no entries, or null.
    """
    lnk = dv.saved_link(spark, d)  # read five times below
    b = dv.baselines(spark, d, lnk).checkpoint(eager=True)
    inventory = bl.inventory(dv.hotfixes(spark, d, lnk), dv.packages(spark, d, lnk), b)
    hints = _product_hints(spark, d, lnk, b).checkpoint(eager=True)
    months, rejects = bl.month_window(b)
    product = hints.where("product_name_hint IS NOT NULL").select("scan_id", F.lower("product_name_hint").alias("_product"))
    rows = (dv.product_rows(spark, d, lnk).withColumn("_product", F.lower("full_product_name")).join(product, ["scan_id", "_product"], "left_semi"))
    returned = saved(co.requested_entries(rows, co.requests(months)))
    entries = saved(co.merge_entries(returned))
    have = entries.select("scan_id").distinct().withColumn("_have", F.lit(True))
    hosts = (b.select("scan_id").join(rejects, "scan_id", "left").join(hints, "scan_id", "left").join(have, "scan_id", "left")
             .select("scan_id", F.coalesce("reason", F.when(F.col("product_name_hint").isNull(), co.REASON_NO_PRODUCT),
                                           F.when(F.col("_have").isNull(), co.REASON_NO_ENTRIES)).alias("reason")))
    return co.correlate(entries, inventory), returned, hosts


@query
def scanner_summary(spark, d):
    """C1 + A3 + G17: every host's scan summary over merged requests, or the reason why it has no entries."""
    c, returned, hosts = scanner_run(spark, d)
    return co.scan_summary(c, hosts=hosts, raw=returned)


# ---------------------------------------------------------------- advisories

from fleetrisk.sources import advisory as adv  # noqa: E402


@query
def advisory_metadata(spark, d):
    """S9 + G10 + G11: CVE metadata from advisory rows, last month wins (chronological)."""
    return adv.last_wins(adv.metadata_rows(dv.advisory_vulnerabilities(spark, d)), order="time")


@query
def advisory_metadata_text_order(spark, d):
    """G11 parity mode: last month wins in text order of month ids."""
    return adv.last_wins(adv.metadata_rows(dv.advisory_vulnerabilities(spark, d)), order="text")


from fleetrisk.sources import advisory_store as av  # noqa: E402
from fleetrisk.sources import run_log as rl  # noqa: E402

#: the first load of the store lacks every third row of the later months, the second brings them
LATE_MONTH = "1994-01-01"


def advisory_store(spark: SparkSession, d: str) -> str:
    """A store of the advisory rows, filled by two loads."""
    rows = adv.metadata_rows(dv.advisory_vulnerabilities(spark, d))
    late = (parse_month_id("month") >= F.lit(LATE_MONTH).cast("date")) & (F.col("pos") % 3 == 0)
    path = f"{shared_folder(spark, 'advisories')}/store"
    av.upsert(rows.where(~late), path, 1)
    av.upsert(rows.where(late), path, 2)
    return path


@query
def window_advisories(spark, d):
    """S8 + G11 + A5: CVEs of each host's month window in the advisory store, last month wins."""
    store = av.read(spark, advisory_store(spark, d))
    found = av.for_windows(store, bl.month_window(dv.baselines(spark, d))[0])
    return found.groupBy("scan_id").agg(F.count(F.lit(1)).alias("cves"), F.count_if(F.col("exploitation") == dv.EXPLOITED_TEXT).alias("exploited"),
                                        F.sum(F.round(F.col("base_score") * 10).cast("long")).alias("score_tenths"))


@query
def run_status(spark, d):
    """S7 + M15: stages of a run logged with a failed and a repeated attempt; status and metrics looked up."""
    path = shared_folder(spark, "runs")
    entries = dv.kb_entries(spark, d).checkpoint(eager=True)
    stage = f"{shared_folder(spark, 'stages')}/flat.parquet"
    write_stage(fl.dedupe(fl.flatten(entries)), stage)
    flat = spark.read.parquet(stage)
    counters = fl.flatten_counters(entries, flat).checkpoint(eager=True)
    for _ in range(2):  # the second time adds nothing
        rl.record(spark, path, "fleet", "flatten", counters, artefacts={"rows": stage})
    rl.record(spark, path, "fleet", "enrich", status=rl.FAILED, message="no metadata")
    rl.record(spark, path, "fleet", "enrich", en.enrich_counters(flat, cve_dim(spark, d)), attempt=2)
    log = rl.read(spark, path).checkpoint(eager=True)
    stages = rl.statuses(log, ["flatten", "enrich", "report"])
    return stages.join(rl.metrics(log), ["run_id", "stage"], "left").select("stage", "status", "attempts", "metric", "value")


from fleetrisk.operators import sketches as sk  # noqa: E402


@query
def scope_estimates(spark, d):
    """G1 with sketches: distinct KBs and CVEs of each month and of the fleet, rolled up from (host, month), beside exact counts."""
    flat = fl.dedupe(fl.flatten(dv.kb_entries(spark, d)), fl.RUNTIME_KEYS).checkpoint(eager=True)
    parts = sk.sketch(flat).checkpoint(eager=True)
    bound = sk.error_bound()
    near = lambda c: (F.abs(F.col(f"{c}_estimate") - F.col(c)) <= bound * F.col(c)).alias(f"{c}_near")
    exact = lambda *keys: flat.groupBy(*keys).agg(*[F.countDistinct(c).alias(c) for c in sk.COUNTED])
    by_month = sk.estimates(sk.roll_up(parts, ["month"])).join(exact("month"), "month")
    fleet = sk.estimates(sk.roll_up(parts)).withColumn("month", F.lit("all")).join(exact().withColumn("month", F.lit("all")), "month")
    return by_month.unionByName(fleet).select("month", "rows", *[F.col(c).alias(f"unique_{c[:-3]}s") for c in sk.COUNTED], *[near(c) for c in sk.COUNTED])


@query
def ml_run_summary(spark, d):
    """C4 + M15: one model run, metrics of the three stages in a long table."""
    fitted = ml.evaluated_models(_model_input(spark, d))
    sizes = ml.cluster_profile(fitted.models.clustering.transform(fitted.everything), weight="row_weight").select(
        F.concat(F.lit("cluster_"), F.col("cluster").cast("string"), F.lit("_size")).alias("metric"),
        F.col("size").cast("double").alias("value"))
    return ml.run_summary("run", {"regression": fitted.regression, "classification": fitted.classification, "clustering": sizes})
