"""Whole runs put together from operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave import fixed_values as FV
from threadweave.functions.judging import RUBRIC, evidence_ids, judge_prompt, judge_status, parse_judgements
from threadweave.functions.normalize import has_text, strip
from threadweave.functions.policy import decide_escalation, top_similarity
from threadweave.functions.reply import draft_replies
from threadweave.operators import classifiers as C
from threadweave.operators import metrics as M
from threadweave.operators.linear import LinearScorer
from threadweave.operators.pairs import pair_quality_counters, support_pairs
from threadweave.operators.retrieval import RetrievalIndex, evidence_arrays, retrieve_similar
from threadweave.operators.threads import assign_conversation_ids, brand_conversations, conversation_table
from threadweave.operators.weak_training import weak_labels, weak_training_rows
from threadweave.session import cut_lineage
from threadweave.sources.posts import load_posts
from threadweave.sources.sinks import write_table
from threadweave.sources.tables import deal


def prepare_conversations(
    spark: SparkSession, csv: str, brand: str, multiline: bool = True
) -> tuple[DataFrame, DataFrame]:
    """G7. Brand threads at post level, and one row per thread."""
    posts = cut_lineage(load_posts(spark, csv, brand, multiline))
    threads = brand_conversations(assign_conversation_ids(posts), brand)
    return threads, conversation_table(threads)


def prepare_pairs(
    spark: SparkSession, csv: str, brand: str, multiline: bool = True
) -> tuple[DataFrame, DataFrame]:
    """A3. Pairs and their quality counters."""
    posts = cut_lineage(load_posts(spark, csv, brand, multiline))
    return support_pairs(posts, brand, ordered=True), pair_quality_counters(posts, brand)


def prepare_weak_training(pairs: DataFrame, reserved: DataFrame, out: str | None = None) -> DataFrame:
    """W8. Labelled rows without the reserved ids, written when a path is given."""
    rows = weak_training_rows(weak_labels(pairs, reserved))
    if out:
        write_table(rows, out, FV.WEAK_COLUMNS)
    return rows


def train_and_validate(
    weak: DataFrame, kind: str = "logreg", key: str = "customer_tweet_id", text: str = "customer_text",
    fraction: float = FV.VALIDATION_FRACTION, seed: int = FV.SEED, path: str | None = None, **fit_options,
) -> tuple[C.IntentModel, DataFrame]:
    """M6/M8. Split, fit, and the overall metrics on the held-out rows; saved on request.

    The metrics are on weak labels, not on annotated truth. With a path the overall row, the per-label
    table and the report are written beside the model.
    """
    rows = cut_lineage(C.split_rows(C.load_weak_training(weak), key, fraction, seed))
    train, held_out = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    fit = C.fit_logreg if kind == "logreg" else C.fit_svm
    model = fit(train, text, **fit_options)
    held_out = deal(held_out.select(text, "weak_intent"), C.ROWS_A_TASK)
    predicted = cut_lineage(model.predict(held_out, text).select("weak_intent", "predicted_intent"))
    reports = label_reports(predicted, "weak_intent")
    result = reports["metrics"]
    model.meta.update({"seed": seed, "val_fraction": fraction, "classes": model.labels})
    if path:
        figures = result.first().asDict()
        model.meta.update({
            "validation_size": figures["n_examples"], "validation_accuracy": figures["accuracy"],
            "validation_macro_f1": figures["macro_f1"],
        })
        model.save(path)
        for name, table in reports.items():
            write_table(table, f"{path}/{name}")
    return model, result


def evaluate_model(model: C.IntentModel, golden: DataFrame, truth: str = "annotator_label") -> dict[str, DataFrame]:
    """E4. Overall metrics, per-label table and report of one model on the golden set."""
    return label_reports(cut_lineage(model.predict(golden).select(truth, "predicted_intent")), truth)


def label_reports(predicted: DataFrame, truth: str, labels: Sequence[str] = tuple(FV.TAXONOMY)) -> dict[str, DataFrame]:
    """E1/E2/E8. Overall row, one row per label, and the report with its averages."""
    return {
        "metrics": M.overall_metrics(predicted, truth, "predicted_intent"),
        "per_label": M.per_label_metrics(predicted, truth, "predicted_intent", list(labels)),
        "report": M.classification_report(predicted, truth, "predicted_intent", list(labels)),
    }


def evaluate_models(first: C.IntentModel, second: C.IntentModel, golden: DataFrame) -> DataFrame:
    """E5. The predictions table of two models with its agreement flags."""
    def labelled(model: C.IntentModel) -> DataFrame:
        return model.predict(golden.select("example_id", "customer_text")).select(
            "example_id", F.col("predicted_intent").alias("prediction_label")
        )

    return M.prediction_table(
        golden.select("example_id", "customer_tweet_id", "customer_text", "annotator_label"),
        labelled(first), labelled(second),
    )


def score_messages(
    messages: DataFrame, model: C.IntentModel | LinearScorer, index: RetrievalIndex, key: str = "example_id",
    text: str = "customer_text", k: int = 5, confidence_threshold: float = FV.CONFIDENCE_THRESHOLD,
    similarity_threshold: float = FV.SIMILARITY_THRESHOLD,
) -> DataFrame:
    """X5. Classify, retrieve, draft and decide for a whole table of messages.

    Every message has a row: one without text only an ``error``, all others a null one. Messages with a
    ``customer_tweet_id`` never retrieve their own pairs.
    """
    blank = messages.filter(~has_text(text)).withColumn("error", F.lit("blank_message"))
    usable = messages.filter(has_text(text)).withColumn(text, strip(text))
    classified = model.predict(usable, text)
    own = "customer_tweet_id" if "customer_tweet_id" in messages.columns else None
    found = evidence_arrays(retrieve_similar(usable, index, k, key, text, own=own)).withColumnRenamed("query_id", "_qid")
    joined = classified.join(found, F.col(key).cast("string") == F.col("_qid"), "left").drop("_qid")
    drafted = draft_replies(joined).withColumns(
        {"top_similarity": top_similarity("evidence"), "reply_status": F.col("draft_style")}
    )
    decided = decide_escalation(
        drafted, confidence_threshold=confidence_threshold, similarity_threshold=similarity_threshold
    )
    return decided.withColumn("error", F.lit(None).cast("string")).unionByName(blank, allowMissingColumns=True)


def decision_report(scored: DataFrame, truth: str = "annotator_label") -> dict[str, DataFrame]:
    """X6. The tables of the end-to-end report; messages with an error take no part."""
    scored = scored.filter("error IS NULL") if "error" in scored.columns else scored
    return {
        "metrics": M.overall_metrics(scored, truth, "predicted_intent"),
        "decisions": M.value_shares(scored, "decision"),
        "reasons": M.value_shares(scored, "reason_code"),
        "rates_by_intent": M.escalation_rates(scored),
        "lowest_confidence": M.lowest_rows(scored, "classifier_confidence"),
        "lowest_similarity": M.lowest_rows(scored, "top_similarity"),
    }


SHOWN_IDS = 20  # in an error text


def judge_requests(
    scored: DataFrame, key: str = "example_id", limit: int | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """Q3/Q5/L10. Prompts to send out, with the judge's instructions and the ids it may cite.

    ``ids`` asks for these messages only; one that was never scored is an error.
    """
    rows = scored
    if ids is not None:
        wanted = ids.select(F.col(key).cast("string").alias(key)).distinct()
        have = scored.withColumn(key, F.col(key).cast("string"))
        unknown = wanted.join(have, key, "left_anti")
        first = unknown.orderBy(key).take(SHOWN_IDS)
        if first:
            raise ValueError(f"{unknown.count()} unknown ids to judge, first of them {[r[key] for r in first]}")
        rows = have.join(wanted, key, "left_semi")
    rows = rows.orderBy(key).limit(limit) if limit else rows
    return rows.select(
        key, F.lit(RUBRIC).alias("system_prompt"),
        judge_prompt(
            F.col("customer_text"), F.col("predicted_intent"), F.col("reply_status"), F.col("decision"),
            F.col("reply_text"), F.col("evidence"),
        ).alias("prompt"),
        evidence_ids(F.col("evidence")).alias("valid_evidence_ids"),
    )


def judged_replies(requests: DataFrame, responses: DataFrame, key: str = "example_id") -> DataFrame:
    """Q4. Answers joined to their requests, checked and scored; missing answers marked."""
    return judge_status(parse_judgements(requests.join(responses.select(key, "response"), key, "left")))
