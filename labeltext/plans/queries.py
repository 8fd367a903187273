"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the whole
driver tables. The matching DuckDB SQL lives in ``oracle.py`` under the same key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clean as C
from ..sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


MIN_WORDS = 50


# --- 1. cleaning -------------------------------------------------------------

@query("clean_text")
def q_clean_text(spark, sf):
    """STR2 over raw HTML pages: title and body cleaned."""
    p = S.postings_from_pages(spark, sf)
    return p.select("job_id", T.clean_text("title").alias("title"),
                    T.clean_text("description").alias("description"))


@query("unescape_all_forms")
def q_unescape_all_forms(spark, sf):
    """STR3 where SQL can follow: names with and without ';', as beginnings of
    words, nested, and numbers, put around every document's text."""
    d = S.table(spark, sf, "documents")
    forms = "&amp;lt; &ampx &AMP &ltgt; &notit; &copy2 &#65;&#x42;&#0067; &#128; &#xD800; & a &; &nosuch; &lang;"
    return d.select("doc_id", T.unescape_html(F.concat(F.lit(forms + " "), F.replace("text", F.lit("&"), F.lit(" & ")), F.lit("&#38;#38;"))).alias("decoded"))


@query("unescape_html")
def q_unescape_html(spark, sf):
    """STR3 over raw HTML pages (entity decoding only)."""
    p = S.table(spark, sf, "pages")
    return p.select("page_id", T.decode_entities("html").alias("html"))


@query("text_lengths")
def q_text_lengths(spark, sf):
    """PRJ2 / STR4 / STR5: raw and cleaned character and word counts."""
    p = S.postings_from_documents(spark, sf)
    clean = T.clean_text("description")
    return p.select(
        "job_id",
        T.char_count("description").alias("raw_character_count"),
        T.word_count(F.coalesce(F.col("description"), F.lit(""))).alias("raw_word_count"),
        T.char_count(clean).alias("description_character_count"),
        T.word_count_clean(clean).alias("description_word_count"),
    )


@query("drop_missing")
def q_drop_missing(spark, sf):
    """FIL1 after cleaning: rows whose cleaned title and description are present."""
    p = S.postings_from_documents(spark, sf).dropna(subset=["title", "description"])
    c = C.clean_fields(p).dropna(subset=["title", "description"])
    return c.select("job_id", "title")


@query("min_words")
def q_min_words(spark, sf):
    """FIL2: cleaned descriptions with at least 50 words."""
    p = S.postings_from_documents(spark, sf)
    c = C.with_lengths(C.clean_fields(p).dropna(subset=["title", "description"]))
    return c.filter(F.col("description_word_count") >= MIN_WORDS).select("job_id", "description_word_count")


@query("dedup_first")
def q_dedup_first(spark, sf):
    """DUP1: first (smallest job_id) row per cleaned (title, description)."""
    p = S.postings_from_documents(spark, sf)
    c = C.clean_fields(p).dropna(subset=["title", "description"]).drop("_missing_raw")
    return C.dedup_first(c, ["title", "description"]).select("job_id", "title")


@query("dedup_ties")
def q_dedup_ties(spark, sf):
    """DUP1 with repeated and missing ids: NULL ids last, ties by the rest."""
    d = S.table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 50).alias("job_id"), "lang", "source", "n_chars")
    return C.dedup_first(d, ["source"])


@query("duplicate_counts")
def q_duplicate_counts(spark, sf):
    """DUP3: repeated rows on the whole row, the description, and the pair."""
    p = S.postings_from_documents(spark, sf)
    return C.duplicate_counts(p, {
        "all_columns": list(p.columns),
        "description": ["description"],
        "title_description": ["title", "description"],
    })


@query("clean_postings")
def q_clean_postings(spark, sf):
    """PIP2: the cleaned postings table."""
    return C.preprocess_postings(S.postings_from_documents(spark, sf), MIN_WORDS)


@query("cleaning_report")
def q_cleaning_report(spark, sf):
    """AGG3: eight-row cleaning report."""
    return C.cleaning_report(S.postings_from_documents(spark, sf), MIN_WORDS)


@query("drop_funnel")
def q_drop_funnel(spark, sf):
    """AGG4: rows removed at each cleaning step."""
    return C.drop_funnel(S.postings_from_documents(spark, sf), MIN_WORDS)


# --- 3. labels ---------------------------------------------------------------

from ..operators import labels as L  # noqa: E402
from ..operators import rank as R  # noqa: E402
from ..session import scratch_path, stage_table  # noqa: E402


def _clean(spark, sf):
    return C.preprocess_postings(S.postings_from_documents(spark, sf), MIN_WORDS)


def _labelled(spark, sf):
    return L.build_training_dataset(_clean(spark, sf), S.bridge_from_labels(spark, sf),
                                    S.skill_dimension(spark))


@query("map_labels")
def q_map_labels(spark, sf):
    """JON1: bridge rows with their label name (unmapped dropped)."""
    return L.map_labels(S.bridge_from_labels(spark, sf), S.skill_dimension(spark))


@query("map_labels_at_size")
def q_map_labels_at_size(spark, sf):
    """JON1 at size: lineitem (order -> part) joined to part types."""
    return L.map_labels(S.bridge_from_lineitem(spark, sf), S.dimension_from_part(spark, sf))


@query("unmapped_codes")
def q_unmapped_codes(spark, sf):
    """JON4: bridge rows per code without a name."""
    return L.unmapped_codes(S.bridge_from_labels(spark, sf), S.skill_dimension(spark))


@query("fold_labels")
def q_fold_labels(spark, sf):
    """AGG1: one sorted, comma-joined label string per record."""
    return L.fold_labels(L.map_labels(S.bridge_from_labels(spark, sf), S.skill_dimension(spark)))


@query("fold_labels_at_size")
def q_fold_labels_at_size(spark, sf):
    """AGG1 at size: distinct part types per order."""
    return L.fold_labels(L.map_labels(S.bridge_from_lineitem(spark, sf), S.dimension_from_part(spark, sf)))


@query("attach_labels")
def q_attach_labels(spark, sf):
    """JON2 at size: every order with its folded part types (NULL when none)."""
    folded = L.fold_labels(L.map_labels(S.bridge_from_lineitem(spark, sf), S.dimension_from_part(spark, sf)))
    return L.attach_labels(S.records_from_orders(spark, sf), folded)


@query("labeled_dataset")
def q_labeled_dataset(spark, sf):
    """PIP3: cleaned postings with their folded labels."""
    return _labelled(spark, sf)


@query("label_coverage")
def q_label_coverage(spark, sf):
    """AGG2: labelled share of the cleaned postings."""
    return L.label_coverage(_labelled(spark, sf))


@query("label_distribution")
def q_label_distribution(spark, sf):
    """Records per folded label over all documents."""
    docs = S.table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"))
    return L.label_distribution(L.build_training_dataset(docs, S.bridge_from_labels(spark, sf),
                                                         S.skill_dimension(spark)))


# --- 4. rank, split, sample --------------------------------------------------

@query("global_rank")
def q_global_rank(spark, sf):
    """RNK1: position of every document in the seeded order."""
    docs = S.table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"))
    return R.rank_table(docs, "job_id", 42).select("job_id", "rank")


def _labelled_table(spark, sf):
    """The labelled set written once (as the preprocessing job does), so the
    seeded cut's passes read a table, not the cleaning plan."""
    return stage_table(_labelled(spark, sf), "labelled")


@query("split_dataset")
def q_split_dataset(spark, sf):
    """SPL1: labelled postings cut 80/10/10 in the seeded order."""
    return R.split_dataset(_labelled_table(spark, sf)).select("job_id", "skill_name", "split")


@query("split_null_ids")
def q_split_null_ids(spark, sf):
    """SPL1 where every seventh document has no id: all rows are cut."""
    rows = S.table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("job_id"), F.col("source").alias("skill_name"))
    return R.split_dataset(rows).select("job_id", "skill_name", "split")


@query("split_sizes")
def q_split_sizes(spark, sf):
    """SPL2: rows and share per split."""
    return R.split_sizes(R.split_dataset(_labelled_table(spark, sf)))


@query("sample_exact")
def q_sample_exact(spark, sf):
    """SMP1: exactly 20 labelled postings (seed 42), the evaluation sample size."""
    return R.sample_exact(R.labeled_rows(_labelled_table(spark, sf)), 20, 42).select("job_id", "skill_name")


@query("sample_approximate")
def q_sample_approximate(spark, sf):
    """SMP2 without a count pass: about a tenth of the documents."""
    docs = S.table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), "source")
    return R.sample_approximate(docs, 0.1)


@query("rank_repeated_ids")
def q_rank_repeated_ids(spark, sf):
    """RNK1 where a third of the rows have no id and equal columns, and other
    ids repeat: the multiset of (id, source, rank) does not depend on partitions."""
    rows = S.table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 100).alias("job_id"),
        F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"))
    return R.global_rank(rows)


# --- 2. profiling ------------------------------------------------------------

from ..operators import evaluate as V  # noqa: E402
from ..operators import pairing as PA  # noqa: E402
from ..operators import profile as P  # noqa: E402
from ..operators import validate as VAL  # noqa: E402


@query("missing_summary")
def q_missing_summary(spark, sf):
    """AGG5: missing count and percent per posting column."""
    return P.missing_summary(S.postings_from_documents(spark, sf))


@query("column_types")
def q_column_types(spark, sf):
    """AGG14: type and missing values of every column of two inputs."""
    return P.column_types({"postings": S.postings_from_documents(spark, sf), "job_skills": S.bridge_from_labels(spark, sf)})


@query("length_sketch")
def q_length_sketch(spark, sf):
    """AGG6 from KLL sketches kept per source and merged: for each percentile,
    whether the rank of the sketch's value is within twice the stated error."""
    docs = S.table(spark, sf, "documents").select("source", F.length("text").alias("n"))
    stored = stage_table(P.length_sketches(docs, "n", ["source"]), "length-sketches")
    stats = P.length_stats_of(stored).first()  # nine numbers
    checks = []
    for p in P.PERCENTILES:
        value, slack = stats[f"p{int(round(p * 100)):02d}"], 2 * P.KLL_RANK_ERROR
        low, high = F.count_if(F.col("n") < value), F.count_if(F.col("n") <= value)
        ok = (low <= (p + slack) * F.count("n")) & (high >= (p - slack) * F.count("n"))
        checks.append(F.struct(F.lit(p).alias("p"), F.lit(stats["count"]).alias("count"), ok.alias("within")))
    return docs.agg(F.array(*checks).alias("checks")).select(F.explode("checks").alias("c")).select("c.*")


@query("class_count_sketch")
def q_class_count_sketch(spark, sf):
    """AGG8 from HLL sketches kept per source and merged: whether each
    estimate is within four standard errors of the exact count."""
    docs = S.table(spark, sf, "documents").select("source", "lang", "text", F.substring_index("text", "\n", 1).alias("title"))
    cols = ["lang", "text", "title"]
    estimate = P.class_count_of(stage_table(P.distinct_sketches(docs, cols, ["source"]), "distinct-sketches"), cols)
    # The exact count of long texts goes over their hashes.
    exact = docs.agg(*[F.count_distinct(F.unhex(F.sha2(c, 256))).alias(f"exact_{c}") for c in cols])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"exact_{c}").alias("exact"),
                     (F.abs(estimate.select(f"{c}_classes").scalar() - F.col(f"exact_{c}")) <= 4 * P.HLL_RELATIVE_ERROR * F.col(f"exact_{c}") + 1).alias("within")) for c in cols]
    return exact.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("length_stats")
def q_length_stats(spark, sf):
    """AGG6: distribution of raw description word counts (missing = 0)."""
    p = S.postings_from_documents(spark, sf)
    wc = p.select(T.word_count(F.coalesce(F.col("description"), F.lit(""))).alias("wc"))
    return P.length_stats(wc, "wc")


@query("category_distribution")
def q_category_distribution(spark, sf):
    """AGG7: experience level and work type, NULL included."""
    return P.category_distribution(S.postings_from_documents(spark, sf),
                                   ["formatted_experience_level", "formatted_work_type"])


@query("shortest_rows")
def q_shortest_rows(spark, sf):
    """TOP1: 20 shortest cleaned postings by word count."""
    return P.shortest_rows(_clean(spark, sf), "description_word_count").select(
        "job_id", "title", "description_word_count")


@query("longest_rows")
def q_longest_rows(spark, sf):
    """TOP2: 20 longest cleaned postings by word count."""
    return P.longest_rows(_clean(spark, sf), "description_word_count").select(
        "job_id", "title", "description_word_count")


@query("table_profile")
def q_table_profile(spark, sf):
    """AGG14: rows and columns of the three inputs."""
    return P.table_profile({
        "postings": S.postings_from_documents(spark, sf),
        "job_skills": S.bridge_from_labels(spark, sf),
        "skills": S.skill_dimension(spark),
    })


# --- 5. evaluation -----------------------------------------------------------

def _predictions(spark, sf):
    return S.predictions_from_documents(spark, sf)


def _results(spark, sf):
    return V.prediction_results(_predictions(spark, sf))


@query("normalize_label")
def q_normalize_label(spark, sf):
    """STR7: normalised truth and raw prediction labels."""
    p = _predictions(spark, sf)
    return p.select("job_id", T.normalize_label("ground_truth").alias("truth_norm"),
                    T.normalize_label("finetuned_prediction").alias("prediction_norm"))


@query("clean_prediction")
def q_clean_prediction(spark, sf):
    """STR9: one label kept from each generated answer."""
    p = _predictions(spark, sf)
    return p.select("job_id", T.clean_prediction("finetuned_prediction").alias("finetuned_prediction"),
                    T.clean_prediction("baseline_prediction").alias("baseline_prediction"))


@query("prediction_results")
def q_prediction_results(spark, sf):
    """EVL2 / STR10 / JON3: row results with correct flags."""
    return _results(spark, sf)


@query("prediction_parity")
def q_prediction_parity(spark, sf):
    """COL5 (keyed): label rows vs document predictions."""
    truths = S.table(spark, sf, "labels").select(F.col("doc_id").alias("job_id"))
    return VAL.prediction_parity(truths, _predictions(spark, sf).select("job_id"))


def _apart(spark, sf):
    """Truths and predictions as two tables: some keys on one side only, some twice."""
    p = _predictions(spark, sf)
    truths = p.filter("job_id % 9 <> 0").select("job_id", "ground_truth", F.explode(
        F.when(F.col("job_id") % 10 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return truths.drop("copy"), p.filter("job_id % 7 <> 0").select("job_id", "finetuned_prediction")


@query("pair_predictions")
def q_pair_predictions(spark, sf):
    """JON3 + COL5: two tables paired by key, with what is wrong with each key."""
    return PA.pair_by_key(*_apart(spark, sf))


@query("pairing_verdict")
def q_pairing_verdict(spark, sf):
    """COL5: keys by status over the same join."""
    return PA.pairing_verdict(PA.pair_by_key(*_apart(spark, sf)))


@query("class_count")
def q_class_count(spark, sf):
    """AGG8: distinct truth and predicted classes."""
    return P.class_count(_results(spark, sf), ["ground_truth", "finetuned_prediction"])


@query("sample_accuracy")
def q_sample_accuracy(spark, sf):
    """AGG9: mean of the fine-tuned correct flag."""
    return V.sample_accuracy(_results(spark, sf))


@query("classification_metrics")
def q_classification_metrics(spark, sf):
    """AGG10: weighted metrics of the fine-tuned model."""
    counts = V.confusion_counts(V.long_predictions(_results(spark, sf), models={V.FINETUNED: "Fine-tuned"}))
    return V.metrics(counts, "weighted")


@query("classification_metrics_macro")
def q_classification_metrics_macro(spark, sf):
    """AGG10 with average='macro'."""
    return V.metrics(V.confusion_counts(V.long_predictions(_results(spark, sf))), "macro")


@query("compare_models")
def q_compare_models(spark, sf):
    """AGG11 / EVL1: baseline vs fine-tuned."""
    return V.evaluate_predictions(_predictions(spark, sf))[1]


@query("metric_long")
def q_metric_long(spark, sf):
    """PLT2: model x metric values for the bar chart."""
    return V.metric_long(V.evaluate_predictions(_predictions(spark, sf))[1])


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    """AGG12 / PLT1: non-zero confusion cells over the truth classes."""
    return V.confusion_matrix(V.confusion_counts(V.long_predictions(_results(spark, sf))))


@query("confusion_matrix_wide")
def q_confusion_matrix_wide(spark, sf):
    """AGG12 (wide): rows truth, one column per given class, both models; the
    classes come unnormalised, and one of them has no rows."""
    counts = V.confusion_counts(V.long_predictions(_results(spark, sf)))
    return V.confusion_matrix_wide(counts, [" DE", "en", "Es", "fr", "it"])


@query("confusion_matrix_observed")
def q_confusion_matrix_observed(spark, sf):
    """AGG12 (wide) over the observed truths of the fine-tuned model's rows; the
    truth of every eleventh row is missing, predictions of no truth class count as other."""
    p = _predictions(spark, sf)
    frame = p.select(F.when(F.col("ground_truth") == "de", "en").otherwise(F.col("ground_truth")).alias(V.TRUTH), T.clean_prediction(V.FINETUNED).alias(V.FINETUNED))
    return V.confusion_matrix_observed(V.confusion_counts(V.long_predictions(frame)))


@query("confusion_matrix_other")
def q_confusion_matrix_other(spark, sf):
    """AGG12 (wide) over two given classes: all other rows count under other."""
    counts = V.confusion_counts(V.long_predictions(_results(spark, sf)))
    return V.confusion_matrix_observed(counts, ["FR", "es."])


@query("classification_report")
def q_classification_report(spark, sf):
    """AGG13: per-class and summary rows for both models."""
    return V.classification_report(V.confusion_counts(V.long_predictions(_results(spark, sf))))


# --- 6. prompts, chat, examples ---------------------------------------------

from ..functions import prompts as PR  # noqa: E402
from ..operators import chat as CH  # noqa: E402
from ..operators import examples as X  # noqa: E402


def _labelled_docs(spark, sf):
    return S.labelled_documents(spark, sf)


@query("load_eval_set")
def q_load_eval_set(spark, sf):
    """SRC5: evaluation rows with their instruction, one per (instruction, label)."""
    return X.load_eval_set(_labelled_docs(spark, sf))


@query("training_rows")
def q_training_rows(spark, sf):
    """COL2: rows usable for training (title or description, non-blank label)."""
    return VAL.validate_training_frame(_labelled_docs(spark, sf)).select("job_id", "title", "skill_name")


@query("label_nulls")
def q_label_nulls(spark, sf):
    """COL3: missing title / description / label counts."""
    return VAL.label_nulls(_labelled_docs(spark, sf))


@query("build_prompts")
def q_build_prompts(spark, sf):
    """PRM1: instruction prompt per document."""
    return _labelled_docs(spark, sf).select("job_id", PR.build_prompt("title", "description").alias("instruction"))


@query("chat_messages")
def q_chat_messages(spark, sf):
    """PRM2: user + assistant messages for every labelled document."""
    d = VAL.validate_training_frame(_labelled_docs(spark, sf))
    return d.select("job_id", PR.chat_messages(PR.build_prompt("title", "description"), "skill_name")
                    .alias("messages"))


@query("render_chat")
def q_render_chat(spark, sf):
    """PRM3: every conversation turn rendered with the chat template."""
    c = S.conversations(spark, sf)
    msg = F.struct(F.col("role"), F.col("text").alias("content"))
    return c.select("conv_id", "turn", PR.DEFAULT_TEMPLATE.render_message(msg).alias("rendered"))


@query("render_conversation")
def q_render_conversation(spark, sf):
    """PRM2 / PRM3: every conversation folded in order of its turns and rendered
    whole, and as the prompt for its last answer."""
    return CH.render_conversation(CH.fold_conversation(S.conversations(spark, sf)))


@query("conversation_roles")
def q_conversation_roles(spark, sf):
    """Messages per role in the conversations."""
    return S.conversations(spark, sf).groupBy("role").agg(F.count("*").alias("messages"))


@query("truncate_tokens")
def q_truncate_tokens(spark, sf):
    """PRM4: descriptions cut to their first 400 whitespace tokens."""
    d = S.table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("job_id"), PR.truncate_tokens("text", 400).alias("description"))


@query("encode_examples")
def q_encode_examples(spark, sf):
    """PRM5: fixed-length ids, mask and masked labels per training row."""
    return X.encode_examples(VAL.validate_training_frame(_labelled_docs(spark, sf))).select(
        "job_id", "input_ids", "attention_mask", "labels")


@query("encode_examples_md5")
def q_encode_examples_md5(spark, sf):
    """PRM5 / ARR1 with ids that SQL can compute: the arrays themselves."""
    rows = VAL.validate_training_frame(_labelled_docs(spark, sf))
    return X.encode_examples(rows, max_length=64, max_description_tokens=30, token_ids=PR.md5_ids).select(
        "job_id", "input_ids", "attention_mask", "labels")


@query("loss_tokens")
def q_loss_tokens(spark, sf):
    """AGG16: loss-carrying and real tokens per encoded example."""
    return X.loss_tokens(X.encode_examples(VAL.validate_training_frame(_labelled_docs(spark, sf))))


@query("training_sample")
def q_training_sample(spark, sf):
    """PRM6: exact 1,000-row sample of the validated train split."""
    return X.training_sample(R.split_dataset(_labelled_table(spark, sf)), "train", 1000, 42).select(
        "job_id", "skill_name")


# --- 7. inference and classifier ---------------------------------------------

from ..operators import infer as I  # noqa: E402


@query("batch_predict")
def q_batch_predict(spark, sf):
    """INF1: keyword predictor over every document prompt, cleaned."""
    d = _labelled_docs(spark, sf).select("job_id", PR.build_prompt("title", "description").alias("instruction"))
    preds = I.batch_predict(d, I.AccentPredictor, batch_size=2)
    return preds.select("job_id", T.clean_prediction("raw_prediction").alias("prediction"))


@query("generate_answers")
def q_generate_answers(spark, sf):
    """INF1 with limits: inputs over 60 tokens lose their beginning, answers
    have two tokens at most; the end of each input is shown."""
    d = _labelled_docs(spark, sf).select("job_id", PR.build_prompt("title", "description").alias("instruction"))
    out = I.generate_answers(d, I.AccentPredictor, max_input_length=60, max_new_tokens=2, batch_size=64)
    return out.select("job_id", F.size(F.split("model_input", " ")).alias("input_tokens"),
                      F.substring_index("model_input", " ", -7).alias("input_end"), "raw_prediction")


@query("inference_job")
def q_inference_job(spark, sf):
    """INF2: 20-row exact sample of the evaluation set, predicted and flagged."""
    ev = X.load_eval_set(_labelled_docs(spark, sf))
    return I.inference_job(ev, I.AccentPredictor, 20, 42).select("job_id", "skill_name", "prediction", "correct")


@query("prediction_preview")
def q_prediction_preview(spark, sf):
    """STR11 / TOP4: the inference sample as displayed, titles cut to 60
    characters (the stored results keep the whole title)."""
    ev = X.load_eval_set(_labelled_docs(spark, sf))
    out = I.inference_job(ev, I.AccentPredictor, 20, 42)
    return out.select("job_id", F.substring("title", 1, 60).alias("title"), "skill_name", "prediction", "correct")


@query("train_classifier")
def q_train_classifier(spark, sf):
    """TRN1: TF-IDF + logistic regression on the train split of documents
    (label = language), scored on the test split against a majority baseline."""
    docs = S.table(spark, sf, "documents").select(
        F.col("doc_id").alias("job_id"), F.col("text").alias("description"), F.col("lang").alias("skill_name"))
    split = R.split_dataset(docs)
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    _, scored = I.train_classifier(train, test)
    majority = train.groupBy("skill_name").count().orderBy(F.desc("count"), "skill_name").limit(1) \
        .select("skill_name").scalar()
    frame = scored.select("job_id", F.col("skill_name").alias(V.TRUTH), majority.alias(V.BASELINE),
                          F.col("prediction_label").alias(V.FINETUNED))
    return V.compare_models(frame)


# --- 8. pipeline and I/O -----------------------------------------------------

from ..sinks import writers as W  # noqa: E402
from ..sources import files as FS  # noqa: E402
from ..sources.schema import POSTINGS_SCHEMA  # noqa: E402
from . import preprocessing as PP  # noqa: E402


@query("pipeline_summary")
def q_pipeline_summary(spark, sf):
    """AGG15: stage counts of the preprocessing job."""
    postings = S.postings_from_documents(spark, sf)
    cleaned = C.preprocess_postings(postings, MIN_WORDS)
    training = L.build_training_dataset(cleaned, S.bridge_from_labels(spark, sf), S.skill_dimension(spark))
    return PP.pipeline_summary(postings, training)


def _postings_csv(spark, sf) -> str:
    path = scratch_path(spark, "postings-csv")
    W.write_table(S.postings_from_documents(spark, sf), path, "csv")
    return path


@query("ingest_csv")
def q_ingest_csv(spark, sf):
    """SRC1 + SNK1: postings written as CSV (quoted newlines, doubled
    quotes) and read back with the declared schema and NA tokens."""
    return FS.read_csv(spark, _postings_csv(spark, sf), POSTINGS_SCHEMA)


@query("ingest_csv_reordered")
def q_ingest_csv_reordered(spark, sf):
    """SRC1: columns in another order and one more than the schema has."""
    path = scratch_path(spark, "postings-csv-reordered")
    p = S.postings_from_documents(spark, sf)
    frame = p.select(F.lit("extra").alias("views"), *reversed(p.columns))
    W.write_table(frame, path, "csv")
    return FS.read_csv(spark, path, POSTINGS_SCHEMA)


def _mixed_folder(spark, sf) -> str:
    """The documents' short columns as CSV, as CSV in other column order, as
    Parquet, and two files that cannot be read, all under one folder."""
    root = scratch_path(spark, "mixed")
    d = S.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    part = lambda k: d.filter(F.col("doc_id") % 3 == k)
    W.write_table(part(0), f"{root}/a", "csv")
    W.write_table(part(1).select("n_chars", F.lit("x").alias("more"), "source", "lang", "doc_id"), f"{root}/b", "csv")
    W.write_table(part(2), f"{root}/c", "parquet")
    W.write_table(d.limit(1).select(F.lit("PK\x03\x04 a workbook").alias("value")), f"{root}/d", "text")
    W.write_table(d.limit(1).select("doc_id"), f"{root}/e", "json")
    return root


@query("read_by_content")
def q_read_by_content(spark, sf):
    """SRC2: rows from all readable files of a folder, whatever their names."""
    rows, _ = FS.read_by_content(spark, _mixed_folder(spark, sf), "doc_id BIGINT, lang STRING, source STRING, n_chars BIGINT")
    return rows


@query("sniff_files")
def q_sniff_files(spark, sf):
    """SRC2: the formats in that folder, with why a file is rejected."""
    return FS.sniff_files(spark, _mixed_folder(spark, sf)).select("format", "status", "reason").distinct()


@query("csv_rejects")
def q_csv_rejects(spark, sf):
    """SRC3: a CSV with short rows and bad numbers, read into a table of good rows
    and one of rejects; both, with the causes."""
    path = scratch_path(spark, "damaged-csv")
    d = S.table(spark, sf, "documents")
    title = F.concat(F.lit('"'), F.replace(F.substring_index("text", "\n", 1), F.lit('"'), F.lit('""')), F.lit('"'))
    size = F.when(F.col("doc_id") % 13 == 0, F.concat("n_chars", F.lit("x"))).when(F.col("doc_id") % 17 == 0, "NA").otherwise(F.col("n_chars").cast("string"))
    short = F.concat_ws(",", F.col("doc_id").cast("string"), "lang")
    line = F.when(F.col("doc_id") % 11 == 0, short).otherwise(F.concat_ws(",", F.col("doc_id").cast("string"), "lang", title, size))
    named = d.select(line.alias("doc_id,lang,title,n_chars"))  # the header of every file
    named.write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    checked = FS.read_csv_checked(spark, path, "doc_id BIGINT, lang STRING, title STRING, n_chars BIGINT")
    good, rejects = FS.split_rejects(checked, scratch_path(spark, "checked"))
    return good.select("doc_id", "title", "n_chars", F.lit("").alias("causes"), F.lit(None).cast("string").alias("record")).unionByName(
        rejects.select("doc_id", "title", "n_chars", F.array_join(FS.CAUSES, ",").alias("causes"), F.col(FS.RECORD).alias("record")))


@query("evaluate_predictions")
def q_evaluate_predictions(spark, sf):
    """EVL1 + SNK2: prediction file written as CSV under the reference's
    column names, evaluated by the job; the written metrics table."""
    from . import evaluation as EJ

    src = scratch_path(spark, "predictions-csv")
    frame = _predictions(spark, sf).select(
        "job_id", "title", *[F.col(new).alias(old) for old, new in EJ.FILE_COLUMNS.items()])
    W.write_table(frame, src, "csv")
    schema = "job_id BIGINT, title STRING, " + ", ".join(f"`{c}` STRING" for c in EJ.FILE_COLUMNS)
    paths = EJ.evaluation_job(spark, src, scratch_path(spark, "evaluation"), schema)
    return spark.read.parquet(paths["metrics"])


@query("evaluate_paired_files")
def q_evaluate_paired_files(spark, sf):
    """EVL1 with truths and predictions in two CSV files, paired by key."""
    from . import evaluation as EJ

    p, base = _predictions(spark, sf), scratch_path(spark, "paired")
    old = {new: name for name, new in EJ.FILE_COLUMNS.items()}
    W.write_table(p.select("job_id", F.col(V.TRUTH).alias(old[V.TRUTH])), f"{base}/truths", "csv")
    W.write_table(p.select("job_id", *[F.col(c).alias(old[c]) for c in (V.BASELINE, V.FINETUNED)]), f"{base}/predictions", "csv")
    schema = "job_id BIGINT, " + ", ".join(f"`{old[c]}` STRING" for c in (V.BASELINE, V.FINETUNED))
    paths = EJ.evaluation_job(spark, f"{base}/predictions", f"{base}/out", schema, truths_path=f"{base}/truths",
                              truths_schema=f"job_id BIGINT, `{old[V.TRUTH]}` STRING")
    return spark.read.parquet(paths["metrics"])


@query("preprocessing_job")
def q_preprocessing_job(spark, sf):
    """PIP1 + AGG15: the whole job; its summary, counted on the written tables."""
    done = PP.run_preprocessing_pipeline(spark, S.postings_from_documents(spark, sf), S.bridge_from_labels(spark, sf),
                                         S.skill_dimension(spark), scratch_path(spark, "preprocessing"))
    columns = ["original_postings", "cleaned_postings", "training_dataset_rows", "labeled_rows", "label_coverage",
               "train_rows", "validation_rows", "test_rows"]
    return spark.read.json(done["paths"]["summary"]).select(*columns)


@query("training_job")
def q_training_job(spark, sf):
    """TRN1 + SNK4: the saved model's metrics on both splits, as written."""
    docs = S.table(spark, sf, "documents").select(
        F.col("doc_id").alias("job_id"), F.col("text").alias("description"), F.col("lang").alias("skill_name"))
    split = stage_table(R.split_dataset(docs), "training-split")
    paths = I.training_job(split.filter("split = 'train'"), split.filter("split = 'validation'"), scratch_path(spark, "training"))
    return spark.read.parquet(paths["train_metrics"]).withColumn("split", F.lit("train")).unionByName(
        spark.read.parquet(paths["eval_metrics"]).withColumn("split", F.lit("eval")))


@query("run_manifest")
def q_run_manifest(spark, sf):
    """SNK4: run record with parameters and stage counts."""
    postings = S.postings_from_documents(spark, sf)
    counts = postings.agg(F.count("*").alias("original_postings"))
    return W.run_manifest(spark, {"min_description_words": MIN_WORDS, "sf_dir": sf}, counts).drop("created_at")
