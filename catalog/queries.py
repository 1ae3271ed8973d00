"""One query per operator, over the whole of the given tables.

Names follow the operator inventory. Results shared by several queries (trained
model, clusters, severity groups) are computed once per session and folder.
"""

from __future__ import annotations

from datetime import timedelta
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens.config import DEFAULT
from herdlens.functions.numeric import literal_map, round_exact, round_scaled
from herdlens.operators import context, dashboard, features, metrics, outbreak, preprocess, risk, rollup
from herdlens.operators.explain import with_final_risk, with_report_reasons
from herdlens.operators.order_stats import exact_medians
from herdlens.operators.rules import with_rules
from herdlens.operators.split import with_split
from herdlens.operators.stdbscan import Neighbourhood, adjacent_boxes, cells_of, neighbour_weight
from herdlens.operators.tmixture import fit_t_mixture
from herdlens.operators.validation import split_valid, with_errors
from herdlens.plans import training
from herdlens.plans.triage import forest_scorer, triage
from herdlens.session import materialize, new_path
from herdlens.sources import driver_tables, models, tables
from herdlens.sources.report_log import ReportLog
from herdlens.streaming import trends
from herdlens.streaming.triage import TriageStream

# All villages of the test tables report daily, so a cluster needs more rows
# than the default to stand out.
MIN_SAMPLES = 40
SHOWN = {
    "districts": ["ASIA", "EUROPE", "AFRICA"],
    "species": ["cattle", "goat", "poultry"],
    "start": "2024-01-05",
    "end": "2024-01-24",
}
NEW_DAYS = 2  # the last days of the table play the incoming reports


def reports(spark, sf):
    return driver_tables.reports(spark, sf)


def regions(spark, sf):
    return driver_tables.regions(spark, sf)


def label_scorer(df: DataFrame) -> DataFrame:
    """Weak label in place of the forest, so that SQL can check all around it."""
    labelled = features.with_label(df).withColumnRenamed("risk_level", "ml_prediction")
    return labelled.withColumn("ml_confidence", F.lit(1.0)).withColumn(
        "ml_probabilities", F.create_map(F.col("ml_prediction"), F.lit(1.0))
    )


def _per_session(build):
    @lru_cache(maxsize=None)
    def cached(application, sf):
        return build(SparkSession.getActiveSession(), sf)

    def get(spark, sf):
        return cached(spark.sparkContext.applicationId, sf)

    get.fresh = build
    get.forget = cached.cache_clear
    return get


def _cut(spark, sf):
    """First day of the incoming reports."""
    last = driver_tables.event_table(spark, sf).agg(F.max("ts").cast("date")).first()[0]
    return last - timedelta(days=NEW_DAYS - 1)


def _incoming(df: DataFrame) -> DataFrame:
    return df.drop("mortality_rate", "risk_level")


def _history_and_new(spark, sf):
    rows, cut = reports(spark, sf), F.lit(_cut(spark, sf))
    return rows.where(F.col("date") < cut), _incoming(rows.where(F.col("date") >= cut))


def _clustered(spark, sf):
    return materialize(
        outbreak.clustered_reports(reports(spark, sf), regions(spark, sf), min_samples=MIN_SAMPLES), "clustered"
    )


def _trained(spark, sf):
    return training.train(reports(spark, sf), path=new_path(spark, "model"))


def _detected(spark, sf):
    return outbreak.detect_outbreaks(reports(spark, sf), regions(spark, sf), min_samples=MIN_SAMPLES)


clustered = _per_session(_clustered)
trained = _per_session(_trained)
detected = _per_session(_detected)


# --- sources and sinks ------------------------------------------------------
def src_reports(spark, sf):
    path = new_path(spark, "reports-csv")
    tables.write_reports(reports(spark, sf), path, "csv", by_date=False)
    return tables.read_reports(spark, path, "csv")


def src_regions(spark, sf):
    path = new_path(spark, "regions-csv")
    tables.write_regions(regions(spark, sf), path, "csv")
    return tables.read_regions(spark, path, "csv")


def src_date_norm(spark, sf):
    text = reports(spark, sf).select("report_id", F.col("date").cast("string").alias("date"))
    return tables.with_dates(text)


def snk_tables(spark, sf):
    path = new_path(spark, "reports")
    tables.write_reports(reports(spark, sf), path)
    back = tables.read_reports(spark, path)
    return back.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("number_affected").alias("affected"))


def _agreement(spark, sf, path):
    """Per report whether the saved model predicts what the fitted one does."""
    rows = materialize(_feature_rows(spark, sf), "feature-rows")
    fitted = training.with_predictions(rows, trained(spark, sf).model).select("report_id", "ml_prediction", "ml_confidence")
    saved = training.with_predictions(rows, models.load_model(path)).select(
        "report_id", F.col("ml_prediction").alias("_p"), F.col("ml_confidence").alias("_c")
    )
    same = (F.col("ml_prediction") == F.col("_p")) & (F.col("ml_confidence") == F.col("_c"))
    return fitted.join(saved, "report_id").select("report_id", same.alias("agrees"))


def snk_model(spark, sf):
    path = new_path(spark, "model")
    models.save_model(trained(spark, sf).model, path)
    return _agreement(spark, sf, path)


def src_model(spark, sf):
    path, reported = new_path(spark, "absent"), False
    try:
        models.load_model(path)
    except models.ModelNotTrainedError:
        reported = True
        models.save_model(trained(spark, sf).model, path)
    return _agreement(spark, sf, path).withColumn("absence_reported", F.lit(reported))


def _feature_rows(spark, sf):
    return features.feature_frame(features.engineer_features(reports(spark, sf)), keep=("report_id", "risk_level"))


def snk_append(spark, sf):
    history, new = _history_and_new(spark, sf)
    scored, _ = triage(new.withColumnRenamed("report_id", "arrival"), history, label_scorer)
    log = ReportLog(spark, new_path(spark, "report-log"))
    log.load(history)
    for _ in range(2):  # a repeated append adds nothing
        log.append(scored, "last-days", ["date", "arrival"])
    return log.read().select(
        "report_id", "date", "village", "number_affected", "mortality_rate", "risk_level"
    )


# --- projections and predicates ---------------------------------------------
def proj_mortality(spark, sf):
    rate = F.col("rate")
    return reports(spark, sf).select("report_id", features.mortality().alias("rate")).select(
        "report_id", "rate", round_scaled(rate, 3).alias("rate_loaded"), round_exact("rate", 4).alias("rate_appended")
    )


def proj_symptoms(spark, sf):
    return features.with_symptoms(reports(spark, sf)).select("report_id", "symptom_count", "symptom_severity")


def proj_features(spark, sf):
    return features.engineer_features(reports(spark, sf)).select(
        "report_id", "mortality_rate", "symptom_count", "symptom_severity",
        "recent_reports", "historical_incidence", "spread_velocity", "rapid_spread",
    )


def proj_feature_frame(spark, sf):
    return features.feature_frame(features.engineer_features(reports(spark, sf)), keep=("report_id",))


def doubtful(spark, sf):
    """Reports with the kinds of mistakes that validation is for."""
    e = F.col("report_id")
    return reports(spark, sf).withColumns(
        {
            "number_affected": F.col("number_affected") - 3,
            "number_deaths": F.when(e % 11 == 0, F.lit(None)).when(e % 23 == 0, -1).otherwise(F.col("number_deaths") * 2).cast("int"),
            "species": F.when(e % 13 == 0, "dragon").otherwise(F.col("species")),
            "block": F.when(e % 17 == 0, "").otherwise(F.col("block")),
            "date": F.when(e % 19 != 0, F.col("date")),
        }
    )


def pred_validate(spark, sf):
    return with_errors(doubtful(spark, sf)).select(
        "report_id", "valid", F.array_join("errors", " | ").alias("errors")
    )


def proj_defaults(spark, sf):
    e = F.col("report_id")
    gaps = reports(spark, sf).select(
        "report_id",
        F.when(e % 3 != 0, F.col("duration_days")).alias("duration_days"),
        F.when(e % 5 != 0, F.col("number_deaths")).alias("number_deaths"),
        F.when(e % 7 != 0, F.col("symptom_fever")).alias("symptom_fever"),
    )
    return features.fill_defaults(gaps).select(
        "report_id", "number_deaths", "duration_days", "temperature", "symptom_fever", "symptom_swelling"
    )


def pred_rules(spark, sf):
    return with_rules(context.with_context(reports(spark, sf))).select(
        "report_id", "rule_triggered", "rule_name", "rule_explanation"
    )


def _judged(spark, sf):
    known = features.engineer_features(reports(spark, sf)).drop("risk_level")
    return with_final_risk(with_rules(label_scorer(known)))


def proj_final_risk(spark, sf):
    return _judged(spark, sf).select("report_id", "ml_prediction", "rule_triggered", "final_risk")


def proj_action(spark, sf):
    return _judged(spark, sf).select("report_id", "final_risk", "recommended_action")


def proj_explain_report(spark, sf):
    return with_report_reasons(_judged(spark, sf)).select(
        "report_id", F.array_join("explanation", " | ").alias("explanation")
    )


def proj_explain_region(spark, sf):
    return risk.with_region_reasons(risk.region_risk(reports(spark, sf), "village")).select(
        "village", F.array_join("reasons", " | ").alias("reasons")
    )


SUB_SCORES = ("sub_score_volume", "sub_score_growth", "sub_score_mortality", "sub_score_high_concern", "sub_score_historical")


def _scored(spark, sf):
    return risk.with_risk_score(rollup.region_rollup(reports(spark, sf), "village"))


def proj_normalize(spark, sf):
    return _scored(spark, sf).select("village", *SUB_SCORES)


def proj_score(spark, sf):
    return _scored(spark, sf).select("village", "risk_score")


def proj_category(spark, sf):
    return _scored(spark, sf).select("village", "risk_category")


def proj_day_offset(spark, sf):
    return outbreak.with_day_offset(reports(spark, sf)).select("report_id", "day_offset")


def shown(spark, sf):
    return dashboard.filter_reports(reports(spark, sf), **SHOWN)


def filt_dashboard(spark, sf):
    return shown(spark, sf).select("report_id", "date", "district", "block", "species")


def filt_risk_level(spark, sf):
    return dashboard.filter_risk_levels(reports(spark, sf), ["MEDIUM", "HIGH"]).select("report_id", "risk_level")


def gappy_regions(spark, sf):
    """Villages of which every fifth on a line lacks a coordinate."""
    line = F.substring("village", 2, 20).cast("bigint")
    return regions(spark, sf).withColumn("latitude", F.when(line % 5 != 0, F.col("latitude")))


def filt_coords(spark, sf):
    return outbreak.drop_unlocated(gappy_regions(spark, sf)).select("village", "latitude", "longitude")


def proj_label(spark, sf):
    return reports(spark, sf).select("report_id", "risk_level")


def proj_marker(spark, sf):
    return dashboard.hotspot_markers(_scored(spark, sf), gappy_regions(spark, sf))


def proj_badge(spark, sf):
    return dashboard.ranking(_scored(spark, sf), "village")


# --- joins ------------------------------------------------------------------
def join_risk_regions(spark, sf):
    return dashboard.with_region_places(_scored(spark, sf), regions(spark, sf)).select(
        "village", "risk_score", "block", "district", "latitude", "longitude"
    )


def join_report_coords(spark, sf):
    return outbreak.with_coordinates(reports(spark, sf), gappy_regions(spark, sf)).select(
        "report_id", "village", "latitude", "longitude"
    )


def join_context(spark, sf):
    history, new = _history_and_new(spark, sf)
    return context.with_history_context(new, history).select("report_id", *context.CONTEXT_COLUMNS)


def join_st_neighbors(spark, sf):
    located = outbreak.with_day_offset(outbreak.with_coordinates(reports(spark, sf), regions(spark, sf)))
    hood = Neighbourhood.of(DEFAULT.eps_km, DEFAULT.eps_days)
    cells = materialize(cells_of(located, "latitude", "longitude", "day_offset", "report_id", hood.grid), "cells")
    near = adjacent_boxes(cells, hood.grid)
    counts = neighbour_weight(cells, near, hood)
    return cells.join(counts, "first").select(
        F.col("first").alias("first_report"), F.col("day").alias("day_offset"), F.col("near_weight").alias("neighbours")
    )


def semi_filter_lists(spark, sf):
    rows = reports(spark, sf)
    chosen = rows.where(F.col("district").isin(SHOWN["districts"])).select("block")
    return dashboard.options(dashboard.in_chosen(rows, chosen, "block"), "block")


def known_villages(spark, sf):
    """Villages with at least two dozen deaths: stands in for a table of known outbreaks."""
    totals = reports(spark, sf).groupBy("village").agg(F.sum("number_deaths").alias("d"))
    return totals.where("d >= 24").select("village")


def summary(spark, sf):
    severity = literal_map({"LOW": "Mild", "MEDIUM": "Moderate", "HIGH": "Severe"})[F.col("risk_level")]
    graded = clustered(spark, sf).withColumn("severity_group", severity).withColumn(
        "severity_confidence", round_scaled(F.lit(1.0) - F.col("mortality_rate") / F.lit(2.0), 3)
    )
    return outbreak.cluster_summary(graded)


def join_validate_seed(spark, sf):
    return outbreak.validate_outbreaks(summary(spark, sf), known_villages(spark, sf))


# --- aggregations -----------------------------------------------------------
def agg_region_rollup(spark, sf):
    return rollup.region_rollup(reports(spark, sf), "village")


def agg_village_context(spark, sf):
    rows = reports(spark, sf)
    targets = rows.groupBy("village").agg(
        F.max("date").alias("date"), F.max("report_id").alias("exclude_report_id")
    )
    return context.village_context(rows, targets)


def risk_village(spark, sf):
    return risk.region_risk(reports(spark, sf), "village")


def risk_block(spark, sf):
    return risk.region_risk(reports(spark, sf), "block", as_of="2024-01-28")


def risk_district(spark, sf):
    return risk.region_risk(reports(spark, sf), "district")


def risk_all_levels(spark, sf):
    levels = risk.all_levels(reports(spark, sf))
    out = None
    for name, scored in levels.items():
        part = scored.withColumnRenamed(name, "region").select(F.lit(name).alias("level"), *["region", "risk_score", "risk_category", "report_count_7d", "deaths"])
        out = part if out is None else out.unionByName(part)
    return out


def agg_kpi(spark, sf):
    rows = shown(spark, sf)
    return dashboard.kpis(rows, risk.region_risk(rows, "village", ordered=False))


def agg_shown_of_total(spark, sf):
    return dashboard.shown_of_total(shown(spark, sf), reports(spark, sf))


def agg_date_bounds(spark, sf):
    return dashboard.date_bounds(reports(spark, sf))


def agg_daily_trend(spark, sf):
    return dashboard.daily_trend(reports(spark, sf))


def agg_cluster_summary(spark, sf):
    return summary(spark, sf)


def agg_cluster_totals(spark, sf):
    return outbreak.cluster_totals(clustered(spark, sf))


def agg_class_balance(spark, sf):
    return metrics.class_balance(reports(spark, sf))


def agg_score_histogram(spark, sf):
    return dashboard.score_histogram(_scored(spark, sf))


def _split(spark, sf, *columns):
    """Labelled reports (all columns or those named) with their split; written first, as the training table is."""
    events = driver_tables.dealt(driver_tables.event_table(spark, sf))
    return with_split(materialize(driver_tables.reports(spark, sf, events=events).select(*columns or "*"), "labelled"))


def agg_median_impute(spark, sf):
    train = features.with_symptoms(_split(spark, sf)).where("is_train")
    names = [c for c in preprocess.NUMERIC if c in train.columns]
    medians = exact_medians(train, names)
    return spark.createDataFrame([(c, medians[c]) for c in names], "feature string, median double")


def agg_standardize(spark, sf):
    rows = features.with_symptoms(reports(spark, sf))
    scaled = outbreak.standardized(rows, ["mortality_rate", "symptom_severity", "number_affected"])

    def short(name):
        return (F.floor(F.col(name) * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)).alias(name)

    return scaled.select("report_id", short("z_mortality_rate"), short("z_symptom_severity"), short("z_number_affected"))


def agg_class_weight(spark, sf):
    return metrics.class_weights(reports(spark, sf))


def guessed(spark, sf):
    """Reports with a simple guess next to their label."""
    rows = features.with_symptoms(reports(spark, sf))
    guess = F.when(F.col("number_deaths") >= 3, "HIGH").when(F.col("symptom_severity") >= 6, "MEDIUM").otherwise("LOW")
    return rows.withColumn("ml_prediction", guess)


def agg_confusion(spark, sf):
    return metrics.confusion(guessed(spark, sf))


def agg_metrics(spark, sf):
    return metrics.summary_metrics(metrics.confusion(guessed(spark, sf)))


def agg_class_metrics(spark, sf):
    return metrics.class_metrics(metrics.confusion(guessed(spark, sf)))


# --- windows ----------------------------------------------------------------
def _context_column(name):
    def query(spark, sf):
        return context.with_context(reports(spark, sf)).select("report_id", name)

    return query


def win_context_all(spark, sf):
    return context.with_context(reports(spark, sf)).select(
        "report_id", "village", "date", *context.CONTEXT_COLUMNS
    ).orderBy("village", "date", "report_id")


def win_context_batch(spark, sf):
    """Every report's day asked against the whole table as history."""
    rows = reports(spark, sf)
    return context.with_history_context(rows.select("report_id", "village", "date"), rows).select(
        "report_id", *context.CONTEXT_COLUMNS
    )


def win_severity_rank(spark, sf):
    found = detected(spark, sf)
    return found.severity_groups.select("raw_component", "rank")


def win_cluster_id(spark, sf):
    firsts = clustered(spark, sf).where("st_cluster >= 0").groupBy("st_cluster")
    return firsts.agg(F.count(F.lit(1)).alias("n"), F.min("day_offset").alias("first_day"))


def win_stratified_split(spark, sf):
    return _split(spark, sf, "report_id", "risk_level")


# --- sorts, limits, top-k ---------------------------------------------------
def sort_risk(spark, sf):
    return risk.by_score(_scored(spark, sf), "village").select("village", "risk_score")


def topk_regions(spark, sf):
    return dashboard.top_regions(_scored(spark, sf), "village")


def topk_recent_reports(spark, sf):
    return dashboard.recent_reports(shown(spark, sf), ["MEDIUM", "HIGH"])


def topk_recent_total(spark, sf):
    return dashboard.matching_count(shown(spark, sf), ["MEDIUM", "HIGH"])


def sort_clusters(spark, sf):
    return summary(spark, sf).select("st_cluster", "flagged_as_outbreak", "total_deaths", "n_reports")


def filt_flagged_clusters(spark, sf):
    return outbreak.flagged_clusters(summary(spark, sf))


def sort_reports_renumber(spark, sf):
    """Ids in date order; ids are first turned around so that there is work to do."""
    rows = reports(spark, sf).select((F.lit(10**12) - F.col("report_id")).alias("report_id"), "date", "village")
    return tables.renumbered_by_date(rows)


def topk_importance(spark, sf):
    """The ten most important features: their number, and whether they are the first of all."""
    found = trained(spark, sf)
    names = found.imputation.vocabulary
    top = training.importances(found.model, reports(spark, sf), names, 10)
    every = training.importances(found.model, reports(spark, sf), names)
    rest = every.join(top.select("feature"), "feature", "left_anti").agg(F.max("importance").alias("rest"))
    known = top.join(every.select("feature"), "feature", "left_semi")
    return known.agg(F.count(F.lit(1)).alias("n"), F.min("importance").alias("least")).crossJoin(rest).select(
        "n", (F.col("least") >= F.col("rest")).alias("above_the_rest")
    )


def sort_severity_groups(spark, sf):
    return clu_severity_summary(spark, sf).orderBy("rank")


# --- sets -------------------------------------------------------------------
def set_union_reports(spark, sf):
    history, new = _history_and_new(spark, sf)
    return tables.union_reports(history, new).select("report_id", "village", "mortality_rate", "risk_level")


def _flagged_villages(spark, sf):
    return outbreak.flagged_clusters(summary(spark, sf)).select(F.col("dominant_village").alias("village"))


def set_intersect_villages(spark, sf):
    return _flagged_villages(spark, sf).intersect(known_villages(spark, sf))


def set_except_villages(spark, sf):
    flagged, known = _flagged_villages(spark, sf), known_villages(spark, sf)
    false = flagged.subtract(known).withColumn("side", F.lit("false alarm"))
    return false.unionByName(known.subtract(flagged).withColumn("side", F.lit("missed")))


def set_distinct_options(spark, sf):
    return dashboard.options(reports(spark, sf), "village")


# --- streaming --------------------------------------------------------------
def _report_stream(spark, sf):
    return driver_tables.reports(spark, sf, events=driver_tables.event_stream(spark, sf))


def _triaged(spark, sf, arrival):
    cut = F.lit(_cut(spark, sf))
    stream = TriageStream(spark, new_path(spark, "triage"), label_scorer)
    stream.start_from(reports(spark, sf).where(F.col("date") < cut))
    arriving = _report_stream(spark, sf).where(F.col("date") >= cut).withColumn("arrival", arrival)
    stream.run(_incoming(arriving).drop("report_id")).awaitTermination()
    return stream.accepted().select(
        "report_id", "village", "date", "mortality_rate", "risk_level", "rule_name",
        *[F.col(f"context.{c}").alias(c) for c in context.CONTEXT_COLUMNS],
    )


def stream_triage(spark, sf):
    """Reports that arrive in the order of their dates."""
    return _triaged(spark, sf, F.struct("date", "report_id"))


def stream_triage_late(spark, sf):
    """Reports that arrive in an order that has nothing to do with their dates."""
    return _triaged(spark, sf, (F.col("report_id") * 1103515245 + 12345) % 2147483648)


def stream_daily_trend(spark, sf):
    updates = trends.daily_trend_stream(_report_stream(spark, sf))
    folder = new_path(spark, "trend")
    trends.run_updates(updates, folder).awaitTermination()
    return trends.current(spark, folder, updates, ["date"])


def stream_rapid_spread(spark, sf):
    updates = trends.rapid_spread_stream(_report_stream(spark, sf), min_reports=4)
    folder = new_path(spark, "rapid")
    trends.run_updates(updates, folder).awaitTermination()
    return trends.current(spark, folder, updates, ["village", "date"])


# --- models and clusters ----------------------------------------------------
def ml_preprocess(spark, sf):
    rows = features.with_symptoms(_split(spark, sf)).withColumns(
        {c: F.lit(0.0) for c in ("recent_reports", "historical_incidence", "spread_velocity")}
    )
    found = preprocess.fit_imputation(rows.where("is_train"))
    return preprocess.encoded(rows, found).select("report_id", *preprocess.slot_columns(found))


def ml_train(spark, sf):
    """Held-out rows of each class, and whether the figures are those of the confusion table."""
    found = trained(spark, sf)
    total = found.confusion.agg(
        F.sum(F.col("pred_LOW") + F.col("pred_MEDIUM") + F.col("pred_HIGH")).alias("n"),
        F.sum(F.coalesce(*[F.when(F.col("actual") == c, F.col(f"pred_{c}")) for c in DEFAULT.risk_levels])).alias("hit"),
    )
    accuracy = found.metrics.select("accuracy").crossJoin(total).select(
        (F.abs(F.col("accuracy") - F.col("hit") / F.col("n")) < 0.001).alias("accuracy_follows"),
        (F.col("accuracy") > 0.5).alias("better_than_half"),
    )
    return found.classes.select("label", "support").crossJoin(accuracy)


def ml_predict(spark, sf):
    history, new = _history_and_new(spark, sf)
    scored, _ = triage(new, history, forest_scorer(trained(spark, sf).model))
    return scored.select(
        "report_id", "ml_prediction", "ml_confidence", "rule_name", "final_risk", "recommended_action",
        F.array_join("explanation", " | ").alias("explanation"),
    )


def ml_importance(spark, sf):
    """Every feature, whether its share is one, and whether all shares sum to one."""
    found = trained(spark, sf)
    every = training.importances(found.model, reports(spark, sf), found.imputation.vocabulary)
    total = every.agg((F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"))
    return every.select("feature", F.col("importance").between(0, 1).alias("is_share")).crossJoin(total)


def ml_evaluate_saved(spark, sf):
    """Held-out rows of each actual class, over all predicted ones."""
    table = training.evaluate_saved(reports(spark, sf), trained(spark, sf).model)
    return table.select("actual", (F.col("pred_LOW") + F.col("pred_MEDIUM") + F.col("pred_HIGH")).alias("n"))


def clu_st_dbscan(spark, sf):
    return clustered(spark, sf).select("report_id", "st_cluster")


def clu_t_mixture(spark, sf):
    """Components after the last step, to six places, and how the fit went."""
    rows = features.with_symptoms(reports(spark, sf))
    names = ["mortality_rate", "symptom_severity", "number_affected"]
    z = outbreak.standardized(rows, names)
    model = fit_t_mixture(z, [f"z_{n}" for n in names])
    table = spark.createDataFrame(
        [
            (k, float(model.fitted.weights[k]), *[float(v) for v in model.fitted.means[k]], model.log_likelihood, model.n_iter)
            for k in range(model.fitted.k)
        ],
        "component int, weight double, " + ", ".join(f"mean_{n} double" for n in names) + ", log_likelihood double, n_iter int",
    )
    return _to_places(table, 6, ["weight", *[f"mean_{n}" for n in names]]).withColumns(
        {"log_likelihood": F.floor(F.col("log_likelihood") * 1e3 + 0.5) / 1e3}
    )


def _to_places(df: DataFrame, places: int, columns: list) -> DataFrame:
    scale = float(10**places)
    return df.withColumns({c: F.floor(F.col(c) * scale + 0.5) / scale for c in columns})


def clu_severity_assign(spark, sf):
    return detected(spark, sf).reports.select(
        "report_id", "severity_group_raw", "severity_group_rank", "severity_confidence", "severity_group"
    )


def clu_severity_summary(spark, sf):
    groups = detected(spark, sf).severity_groups
    return _to_places(groups, 6, ["mortality_rate", "symptom_severity", "number_affected", "mixture_weight"])


def clu_detect(spark, sf):
    """Clusters of the whole detection, with the severity of their reports."""
    return detected(spark, sf).cluster_summary


def clu_validate(spark, sf):
    return outbreak.validate_outbreaks(summary(spark, sf), known_villages(spark, sf))


def clu_report(spark, sf):
    return outbreak.flagged_clusters(summary(spark, sf))


def triage_rejected(spark, sf):
    _, rejected = split_valid(doubtful(spark, sf))
    return rejected.select("report_id", F.size("errors").alias("n_errors"))


_CONTEXT = {
    "win_recent_reports": "recent_reports",
    "win_prev_reports": "recent_reports_prev",
    "win_hist_incidence": "historical_incidence",
    "win_spread_velocity": "spread_velocity",
    "win_rapid_spread": "rapid_spread",
}

_NAMES = (
    "src_reports", "src_regions", "src_date_norm", "snk_tables", "snk_model", "src_model", "snk_append",
    "proj_mortality", "proj_symptoms", "proj_features", "proj_feature_frame", "pred_validate", "proj_defaults",
    "pred_rules", "proj_final_risk", "proj_action", "proj_explain_report", "proj_explain_region",
    "proj_normalize", "proj_score", "proj_category", "proj_day_offset", "filt_dashboard", "filt_risk_level",
    "filt_coords", "proj_label", "proj_marker", "proj_badge", "triage_rejected",
    "join_risk_regions", "join_report_coords", "join_context", "join_st_neighbors", "semi_filter_lists",
    "join_validate_seed",
    "agg_region_rollup", "agg_village_context", "risk_village", "risk_block", "risk_district", "risk_all_levels",
    "agg_kpi", "agg_shown_of_total", "agg_date_bounds", "agg_daily_trend", "agg_cluster_summary",
    "agg_cluster_totals", "agg_class_balance", "agg_score_histogram", "agg_median_impute", "agg_standardize",
    "agg_class_weight", "agg_confusion", "agg_metrics", "agg_class_metrics",
    "win_context_all", "win_context_batch", "win_severity_rank", "win_cluster_id", "win_stratified_split",
    "sort_risk", "topk_regions", "topk_recent_reports", "topk_recent_total", "sort_clusters",
    "filt_flagged_clusters", "sort_reports_renumber", "topk_importance", "sort_severity_groups",
    "set_union_reports", "set_intersect_villages", "set_except_villages", "set_distinct_options",
    "stream_triage", "stream_triage_late", "stream_daily_trend", "stream_rapid_spread",
    "ml_preprocess", "ml_train", "ml_predict", "ml_importance", "ml_evaluate_saved",
    "clu_st_dbscan", "clu_t_mixture", "clu_severity_assign", "clu_severity_summary", "clu_detect",
    "clu_validate", "clu_report",
)


def all_queries() -> dict:
    found = {name: globals()[name] for name in _NAMES}
    return found | {name: _context_column(column) for name, column in _CONTEXT.items()}
