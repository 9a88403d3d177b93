"""Registry of the queries the engine exposes, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or data Spark derives from them)
in full; nothing is capped, sampled or restricted to an id subset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import encoders as E
from ..functions.display import question_text
from ..operators import applications as A
from ..operators import curves as C
from ..operators import drift as X
from ..operators import dynamic as P
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import retrieval as RT
from ..operators.explain import explain_denials, with_prompt
from ..operators.policy import policy_reasons
from ..operators.text_index import TextIndex
from ..operators import sketch_drift as K
from ..operators import split as T
from ..operators import staging as S
from ..schemas import (
    FEATURE_ORDER, HOME_VALUES, MART_FEATURES, NULL_DEFAULT_COLUMNS, PURPOSE_VALUES, SYSTEM_TEMPLATE,
)
from ..session import scratch_path
from ..sources import files
from .denials import denial_context, embedded_context
from ..sources.fixture import raw_loans
from ..sources.tables import read_table
from ..streaming.drift_stream import start_drift_stream

#: Share of defaults that a threshold should find, the published recall on denials.
TARGET_RECALL = 0.82

#: Features that the drift stream counts.
DRIFT_STREAM_FEATURES = ["loan_amnt", "int_rate", "annual_inc", "dti", "revol_util"]

QueryFn = Callable[[SparkSession, str], DataFrame]


def _raw(fn):
    return lambda spark, sf_dir: fn(raw_loans(spark, sf_dir))


def _apps(spark, sf_dir) -> DataFrame:
    return A.applications_from_loans(raw_loans(spark, sf_dir))


def _apps_fn(fn):
    return lambda spark, sf_dir: fn(_apps(spark, sf_dir))


def _encode(col: str, enc, out: str):
    return _raw(lambda raw: raw.select("loan_id", col, enc(col).alias(out)))


# --- sources -----------------------------------------------------------------

def scan_loans_csv(spark, sf_dir):
    path = scratch_path(spark, "loans-csv")
    files.write_loans_csv(raw_loans(spark, sf_dir), path)
    return files.read_loans_csv(spark, path)


def scan_policies(spark, sf_dir):
    """Whole documents with their source path, over files of many documents each (written by Spark
    from the given table)."""
    path = scratch_path(spark, "text-files")
    files.write_policies(read_table(spark, sf_dir, "benchmark"), path, "item_id", "text")
    docs = files.read_policies(spark, path, files.RECORD_SEPARATOR)
    parts = F.split("text", "\n", 2)
    return docs.select(parts[0].cast("long").alias("item_id"), parts[1].alias("text"),
                       (F.length("path") > 0).alias("has_path"))


def build_layers_q(spark, sf_dir):
    """The layers as the session's views, the mart written; the result is read through its view."""
    S.materialize_layers(raw_loans(spark, sf_dir), scratch_path(spark, "mart"))
    return spark.table("mart_training")


def reject_records_q(spark, sf_dir):
    """Application lines, some cut off and some with a wrong type, with the reasons of each."""
    path = scratch_path(spark, "application-lines")
    line = F.to_json(F.struct("*"))
    damaged = (F.when(F.col("app_id") % 13 == 0, F.substring(line, F.lit(1), F.length(line) - 1))
               .when(F.col("app_id") % 11 == 0, F.regexp_replace(line, '"fico":[0-9]+', '"fico":"high"')).otherwise(line))
    _apps(spark, sf_dir).select(damaged.alias("value")).write.text(path)
    checked = A.checked_records(files.read_application_records(spark, path))
    return checked.select("app_id", F.array_join("violations", ",").alias("violations"),
                          (F.length("record") > 0).alias("has_record"))


def reject_loans_q(spark, sf_dir):
    """Loan lines, some cut off and some with cells of a wrong type, with the problems of each."""
    path = scratch_path(spark, "loan-lines")
    raw = raw_loans(spark, sf_dir)
    cells = [F.col(c).cast("string") for c in raw.columns]
    cells = [F.when(F.col("loan_id") % 13 == 0, F.lit("n/a")).otherwise(x) if c == "annual_inc" else
             F.when(F.col("loan_id") % 17 == 0, F.lit("soon")).otherwise(x) if c == "issue_d" else x
             for c, x in zip(raw.columns, cells)]
    line = F.to_csv(F.struct(*[x.alias(c) for c, x in zip(raw.columns, cells)]))
    cut = F.when(F.col("loan_id") % 19 == 0, F.substring_index(line, ",", 3)).otherwise(line)
    raw.select(cut.alias("value")).write.text(path)
    found = files.read_loan_records(spark, path, header=False)
    return found.select("loan_id", F.array_join("problems", ",").alias("problems"), F.col("record").isNotNull().alias("has_record"),
                        F.when(F.size("problems") == 0, F.col("annual_inc")).alias("annual_inc"))


def scan_applications(spark, sf_dir):
    path = scratch_path(spark, "applications-json")
    files.write_applications_json(_apps(spark, sf_dir), path)
    return files.read_applications(spark, path, "json")


# --- scored applications (deterministic rule score) ---------------------------

def scored_apps(spark, sf_dir) -> DataFrame:
    apps = _apps(spark, sf_dir)
    return apps.withColumn(
        "default_risk", A.rule_score(E.grade_ordinal("grade"), F.col("dti")))


def decision_q(spark, sf_dir):
    return A.with_decision(scored_apps(spark, sf_dir)).select(
        "app_id", "default_risk", "decision", "prediction")


def denied_only_q(spark, sf_dir):
    return A.denied_only(A.with_decision(scored_apps(spark, sf_dir))).select(
        "app_id", "default_risk", "decision")


def risk_display_q(spark, sf_dir):
    return scored_apps(spark, sf_dir).select(
        "app_id", "default_risk", D.risk_percent("default_risk").alias("risk_text"))


def money_display_q(spark, sf_dir):
    return _apps(spark, sf_dir).select(
        "app_id", D.money("loan_amnt").alias("loan_amnt_text"),
        D.money("annual_inc").alias("annual_inc_text"))


def question_text_q(spark, sf_dir):
    valid, _ = A.split_rejects(_apps(spark, sf_dir))
    return valid.select("app_id", D.question_text().alias("question"))


def split_rejects_q(spark, sf_dir):
    checked = A.with_violations(_apps(spark, sf_dir))
    return checked.select(
        "app_id",
        (F.size("violations") == 0).alias("is_valid"),
        F.size("violations").alias("n_violations"),
        F.array_join("violations", ",").alias("violations"),
    )


# --- split and metrics on the mart (deterministic rule score) -----------------

def mart_split(spark, sf_dir) -> DataFrame:
    mart = S.build_layers(raw_loans(spark, sf_dir))["mart_training"]
    return T.stratified_split(mart)


def scored_test_fold(spark, sf_dir) -> DataFrame:
    test = mart_split(spark, sf_dir).filter(F.col("fold") == "test")
    return test.select("loan_id", "target", A.rule_score(F.col("grade"), F.col("dti")).alias("score"))


def metrics_row(spark, sf_dir) -> DataFrame:
    test = scored_test_fold(spark, sf_dir)
    auc = M.auc_roc(test)
    row = M.accuracy(test).withColumn("auc_roc", F.round(F.lit(auc), 4))
    out = M.evaluation_gate(row).select("auc_roc", "accuracy", "auc_threshold", "passed", "status")
    return out


def threshold_choice_q(spark, sf_dir):
    """Thresholds by a recall to reach on denials, and by what a missed default costs against a refused good loan."""
    curve = C.threshold_curve(scored_test_fold(spark, sf_dir))
    rules = [C.threshold_for_recall(curve, r) for r in (0.5, TARGET_RECALL, 0.95)]
    rules += [C.threshold_for_cost(curve, cost, 1.0) for cost in (1.0, 5.0)]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def drift_frame(raw: DataFrame, *more: str) -> DataFrame:
    period = F.when(F.col("issue_d") < F.lit("1995-06-01").cast("date"), F.lit("base")).otherwise(
        F.lit("current"))
    return raw.select(
        period.alias("period"), *more, "loan_amnt", "int_rate", "installment", "annual_inc", "dti",
        F.col("fico_range_low").alias("fico"), "open_acc", "pub_rec", "revol_bal", "revol_util",
        "total_acc", "mort_acc", "pub_rec_bankruptcies")


def drift_sketches_q(spark, sf_dir):
    """Drift by merged monthly sketches; of each feature whether the edges keep the sketch's rank bound and
    the shares of both periods add up.  (Three times the bound, which a single rank keeps with 99 %.)"""
    frame = drift_frame(raw_loans(spark, sf_dir).withColumn("month", F.date_format("issue_d", "yyyy-MM")), "month")
    feats = [c for c in frame.columns if c not in ("period", "month")]
    path = scratch_path(spark, "sketches")
    K.feature_sketches(frame, F.concat_ws(" ", "period", "month"), feats).write.parquet(path)
    periods = K.merged(spark.read.parquet(path), F.split("period", " ")[0])
    drift = K.drift_between(periods, "base", "current")
    base = frame.filter("period = 'base'").select(*[F.col(f).cast("double").alias(f) for f in feats]).unpivot([], feats, "feature", "x")
    ranks = F.array(*[F.lit(j / K.BINS) for j in range(1, K.BINS)])
    edges = periods.filter("period = 'base'").select(
        "feature", F.kll_sketch_get_quantile_double("sketch", ranks).alias("edges"), ranks.alias("quantiles"))

    def whole(c):
        return F.abs(F.aggregate(c, F.lit(0.0), lambda a, v: a + v) - 1) < 1e-9

    return drift.join(K.rank_errors(base, edges), "feature").select(
        "feature", (F.col("error") <= 3 * K.RANK_ERROR).alias("edges_in_bound"),
        (whole("base_shares") & whole("current_shares")).alias("shares_whole"), (F.col("psi") >= 0).alias("psi_not_negative"))


def drift_stream_q(spark, sf_dir):
    """The windows of the loans' stream that its watermark has closed, with their counts."""
    loans = raw_loans(spark, sf_dir).select("loan_id", "issue_d", *DRIFT_STREAM_FEATURES)
    src, out, chk = (scratch_path(spark, n) for n in ("drift-in", "drift-out", "drift-chk"))
    loans.write.parquet(src)
    start_drift_stream(spark, loans.schema, src, out, chk, DRIFT_STREAM_FEATURES).awaitTermination()
    schema = "window_start timestamp, feature string, bin int, n long"
    return spark.read.schema(schema).parquet(out).withColumn("window_start", F.col("window_start").cast("date"))


# --- synthetic contributions for the ranking operators ---------------------------

SYNTHETIC_BASE = -0.5


def synthetic_contributions(spark, sf_dir) -> DataFrame:
    """Contributions from a fixed formula over real serving features, so the
    ranking operators can be checked against SQL."""
    feats = A.serving_features(_apps(spark, sf_dir))
    shap = {name: ((F.col("app_id") * (j + 3)) % 17 - 8).cast("double") / 4.0
            for j, name in enumerate(FEATURE_ORDER)}
    arr = R.keyed_contributions(FEATURE_ORDER, shap_of=lambda c: shap[c])
    return feats.select("app_id", F.lit(SYNTHETIC_BASE).alias("base_value"), arr.alias("contributions"))


def top_features_q(spark, sf_dir):
    c = synthetic_contributions(spark, sf_dir)
    top = c.select("app_id", R.top_features(F.col("contributions")).alias("top"))
    return top.select("app_id", F.posexplode("top").alias("rank", "f")).select(
        "app_id", (F.col("rank") + 1).alias("rank"), "f.feature", "f.value", "f.shap")


def waterfall_q(spark, sf_dir):
    w = R.waterfall_steps(synthetic_contributions(spark, sf_dir), "app_id")
    return w.select("app_id", "step", "feature", "shap", F.round("start", 6).alias("start"),
                    F.round("end", 6).alias("end"), "direction")


# --- retrieval over the driver's text and vector tables ---------------------------

def nearest_chunks_q(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return RT.nearest_neighbors(emb, emb, "vec_id", "vec_id", exclude_self=True)


def _tfidf_hits(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return RT.tfidf_topk(bench, docs, "item_id", "doc_id"), docs, bench


def retrieve_tfidf_q(spark, sf_dir):
    hits, _, _ = _tfidf_hits(spark, sf_dir)
    return hits


def _written_hits(spark, sf_dir):
    """The hits, written: Spark knows how few they are before it plans the join with the texts."""
    hits, docs, bench = _tfidf_hits(spark, sf_dir)
    path = scratch_path(spark, "hits")
    hits.select("item_id", "rank", "doc_id").write.parquet(path)
    return spark.read.parquet(path), docs, bench


def context_text_q(spark, sf_dir):
    hits, docs, _ = _written_hits(spark, sf_dir)
    return RT.context_text(hits, docs, "item_id", "doc_id")


def prompt_messages_q(spark, sf_dir):
    hits, docs, bench = _written_hits(spark, sf_dir)
    ctx = RT.context_text(hits, docs, "item_id", "doc_id", queries=bench)  # no hit: an empty context
    q = ctx.join(bench.withColumnRenamed("text", "question"), "item_id")
    return RT.prompt_messages(q, "item_id")


def index_deltas_q(spark, sf_dir):
    """Hits in an index that was built from all documents and then changed: repeats of a text removed, a base
    written, texts of odd length replaced, the benchmark's items added; the same as in a new index."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    bench = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    index = TextIndex.create(docs, scratch_path(spark, "text-index"))
    first = docs.groupBy(F.xxhash64("text").alias("hash"), "text").agg(F.min("doc_id").alias("first"))
    repeats = docs.withColumn("hash", F.xxhash64("text")).join(first, ["hash", "text"]).filter("doc_id > first")
    index.remove(repeats)
    index.compact()
    longer = docs.filter("n_chars % 2 = 1").join(repeats.select("doc_id"), "doc_id", "left_anti")
    index.add(longer.withColumn("text", F.concat_ws(" ", "text", "lang")))
    index.add(bench.withColumn("item_id", -1 - F.col("item_id")), "item_id")
    return index.search(bench, "item_id").withColumnRenamed("doc", "doc_id")


def _denied(spark, sf_dir) -> DataFrame:
    valid, _ = A.split_rejects(_apps(spark, sf_dir))
    scored = valid.withColumn("default_risk", A.rule_score(E.grade_ordinal("grade"), F.col("dti")))
    return A.denied_only(A.with_decision(scored))


def denial_messages_q(spark, sf_dir):
    """The messages of every denied valid application; of the system message, whether the template
    holds its context together, and of how many different chunks the context is."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = denial_context(_denied(spark, sf_dir), docs)
    facts = found.select("app_id", F.length("context").alias("n"), F.size(F.array_distinct("chunks")).alias("n_chunks"))
    m = RT.prompt_messages(found, "app_id")
    head, tail = SYSTEM_TEMPLATE.split("{context}")
    framed = F.startswith("content", F.lit(head)) & F.endswith("content", F.lit(tail))
    system = F.col("role") == "system"
    # only what is checked of a system message is shuffled, not the message
    m = m.select("app_id", "position", "role", system.alias("system"), framed.alias("framed"), F.length("content").alias("length"),
                 F.when(~system, F.col("content")).alias("question")).join(facts, "app_id")
    whole = F.col("length") == F.col("n") + len(head) + len(tail)
    return m.select("app_id", "position", "role", "question", F.when(F.col("system"), F.col("framed") & whole).alias("grounded"),
                    F.when(F.col("system"), F.col("n_chunks")).alias("n_chunks"))


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A caller's embedding function: how often each letter a to z occurs."""
    return [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def embedded_context_q(spark, sf_dir):
    """The documents nearest each benchmark item by a caller's vectors, and the context that they make."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = embedded_context(bench, docs, letter_counts, "item_id", "doc_id")
    return found.select("item_id", F.sha2("context", 256).alias("context_sha256"),
                        F.array_join(F.transform("nearest", lambda x: x.cast("string")), ",").alias("nearest"))


def answers(prompts: list[list[dict]]) -> list[str]:
    """A completion function that fails for one purpose."""
    if any("Purpose: wedding" in p[1]["content"] for p in prompts):
        raise ValueError("no answer for this purpose")
    return [f"{p[0]['role']}: {len(p[0]['content'])} characters; {p[1]['content']}" for p in prompts]


def explain_calls_q(spark, sf_dir):
    """Every valid application's explanation by a caller's function that fails for some: the others of a
    batch are answered, and applications that were not denied are not asked about."""
    valid, _ = A.split_rejects(_apps(spark, sf_dir))
    scored = A.with_decision(valid.withColumn("default_risk", A.rule_score(E.grade_ordinal("grade"), F.col("dti"))))
    asked = with_prompt(scored.select("app_id", "decision", question_text().alias("question"), F.lit("rules").alias("context")))
    out = explain_denials(asked.withColumn("denied", F.col("decision") == "DENIED"), answers, only_when="denied")
    return out.select("app_id", "decision", "explanation", "explanation_error")


def policy_reasons_q(spark, sf_dir):
    denied = A.denied_only(A.with_decision(scored_apps(spark, sf_dir)))
    return policy_reasons(denied).select("app_id", "rule_id", "policy", "line", "severity", "reason")


def one_hot_sparse_q(spark, sf_dir):
    """The numbers of each completed loan's flags by the written dictionary of three columns, the dates being of many values."""
    loans = S.completed_loans(raw_loans(spark, sf_dir)).select("loan_id", "home_ownership", "purpose", "issue_d")
    return P.one_hot_sparse(loans, ["home_ownership", "purpose", "issue_d"]).select(
        "loan_id", F.array_join(F.transform("flags", lambda x: x.cast("string")), ",").alias("flags"))


def _dynamic_flags(raw: DataFrame) -> DataFrame:
    df = P.training_frame(raw)
    return df.select("loan_id", *[c for c in df.columns
                                  if c.startswith("home_ownership_") or c.startswith("purpose_")])


def registry() -> dict[str, QueryFn]:
    q: dict[str, QueryFn] = {}
    q["default_rate_by_grade"] = _raw(Q.default_rate_by_grade)
    # sources
    q["scan_loans_csv"] = scan_loans_csv
    q["load_validation"] = _raw(files.load_validation)
    q["load_profile"] = _raw(files.load_profile)
    q["scan_applications"] = scan_applications
    q["scan_policies"] = scan_policies
    # SQL pipeline
    q["stg_project"] = _raw(S.stg_project)
    q["stg_filter"] = _raw(S.stg_filter)
    q["completed_loans"] = _raw(S.completed_loans)
    q["mart_filter"] = _raw(lambda r: S.mart_filter(S.loan_features(S.staging(r))))
    q["mart_project"] = _raw(lambda r: S.mart_project(S.loan_features(S.staging(r))))
    q["build_layers"] = build_layers_q
    q["reject_loans"] = reject_loans_q
    q["reject_records"] = reject_records_q
    q["denial_messages"] = denial_messages_q
    q["label_target"] = _encode("loan_status", E.label_target, "target")
    # encoders
    q["term_like"] = _encode("term", E.term_like, "term_months")
    q["term_contains"] = _encode("term", E.term_contains, "term_months")
    q["term_exact"] = _raw(lambda r: A.applications_from_loans(r).select(
        "app_id", "term", E.term_exact("term").alias("term_months")))
    q["grade_ordinal"] = _encode("grade", E.grade_ordinal, "grade_code")
    q["sub_grade_ordinal"] = _encode("sub_grade", E.sub_grade_ordinal, "sub_grade_code")
    q["emp_length_like"] = _encode("emp_length", E.emp_length_like, "emp_years")
    q["emp_length_map"] = _encode("emp_length", E.emp_length_map, "emp_years")
    q["null_defaults"] = _raw(lambda r: r.select("loan_id", *NULL_DEFAULT_COLUMNS).fillna(
        NULL_DEFAULT_COLUMNS))
    q["one_hot_home"] = _raw(lambda r: r.select(
        "loan_id", "home_ownership", *E.one_hot_columns("home_ownership", HOME_VALUES,
                                                       "home_ownership_")))
    q["one_hot_purpose"] = _raw(lambda r: r.select(
        "loan_id", "purpose", *E.one_hot_columns("purpose", PURPOSE_VALUES, "purpose_")))
    # data quality and accounting
    q["dq_not_null"] = _raw(Q.dq_not_null)
    q["dq_accepted_values"] = _raw(Q.dq_accepted_values)
    q["dq_report"] = _raw(Q.dq_report)
    q["rows_dropped"] = _raw(Q.rows_dropped)
    q["target_distribution"] = _raw(Q.target_distribution)
    # applications
    q["fico_range"] = _apps_fn(lambda a: A.fico_range(a).select(
        "app_id", "fico_range_low", "fico_range_high"))
    q["serving_project"] = _apps_fn(A.serving_features)
    q["validate_ranges"] = _apps_fn(A.range_checks)
    q["validate_enums"] = _apps_fn(A.enum_checks)
    q["split_rejects"] = split_rejects_q
    q["decision"] = decision_q
    q["denied_only"] = denied_only_q
    q["risk_display"] = risk_display_q
    q["money_display"] = money_display_q
    q["question_text"] = question_text_q
    # split, metrics, gate
    q["stratified_split"] = lambda spark, d: mart_split(spark, d).select("loan_id", "target", "fold")
    q["dataset_sizes"] = lambda spark, d: T.dataset_sizes(mart_split(spark, d), len(MART_FEATURES))
    q["auc_roc"] = lambda spark, d: M.auc_frame(scored_test_fold(spark, d))
    q["accuracy"] = lambda spark, d: M.accuracy(scored_test_fold(spark, d))
    q["confusion"] = lambda spark, d: M.confusion(scored_test_fold(spark, d))
    q["evaluation_gate"] = metrics_row
    q["threshold_sweep"] = lambda spark, d: M.threshold_sweep(scored_test_fold(spark, d))
    q["drift_sketches"] = drift_sketches_q
    q["drift_stream"] = drift_stream_q
    q["threshold_curve"] = lambda spark, d: C.threshold_curve(scored_test_fold(spark, d))
    q["threshold_choice"] = threshold_choice_q
    q["feature_drift"] = _raw(lambda r: X.feature_drift(drift_frame(r), "period", "base", "current"))
    # training flow's dynamic encoding
    q["one_hot_dynamic"] = _raw(_dynamic_flags)
    q["one_hot_sparse"] = one_hot_sparse_q
    q["numeric_columns"] = _raw(P.training_matrix)
    # ranking of contributions
    q["top_features"] = top_features_q
    q["waterfall_steps"] = waterfall_q
    # retrieval and policy grounding
    q["nearest_chunks"] = nearest_chunks_q
    q["retrieve_tfidf"] = retrieve_tfidf_q
    q["index_deltas"] = index_deltas_q
    q["embedded_context"] = embedded_context_q
    q["explain_calls"] = explain_calls_q
    q["context_text"] = context_text_q
    q["prompt_messages"] = prompt_messages_q
    q["policy_reasons"] = policy_reasons_q
    # model, text pipeline and stream (row-count checks; invariants in tests)
    from .model_queries import registry as model_registry
    q.update(model_registry())
    return q
