"""Metrics against a brute-force statement of sklearn's definitions."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from labeltext.operators import evaluate as V


def brute(truth, pred):
    classes = sorted(set(truth) | set(pred))
    n = len(truth)
    tp = Counter(t for t, p in zip(truth, pred) if t == p)
    sup = Counter(truth)
    prd = Counter(pred)
    p = {c: tp[c] / prd[c] if prd[c] else 0.0 for c in classes}
    r = {c: tp[c] / sup[c] if sup[c] else 0.0 for c in classes}
    f = {c: 2 * tp[c] / (sup[c] + prd[c]) if sup[c] + prd[c] else 0.0 for c in classes}
    w = lambda m: sum(m[c] * sup[c] for c in classes) / n
    return {"accuracy": sum(tp.values()) / n, "precision": w(p), "recall": w(r), "f1": w(f), "samples": n}


def frame(spark, truth, pred):
    rows = [(i, t, p) for i, (t, p) in enumerate(zip(truth, pred))]
    return spark.createDataFrame(rows, "job_id int, ground_truth string, finetuned_prediction string")


LABELS = st.sampled_from(["a", "b", "c", "A.", " b ", "d"])


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(LABELS, LABELS), min_size=1, max_size=30))
def test_weighted_metrics_match_brute_force(spark, pairs):
    truth, pred = [t for t, _ in pairs], [p for _, p in pairs]
    got = V.compare_models(frame(spark, truth, pred), models={V.FINETUNED: "m"}).first().asDict()
    norm = [V.T.__name__ and x.strip().lower().replace(".", "") for x in truth]
    normp = [x.strip().lower().replace(".", "") for x in pred]
    want = brute(norm, normp)
    for k in ("accuracy", "precision", "recall", "f1"):
        assert abs(got[k] - want[k]) < 1e-9, k
    assert got["samples"] == want["samples"]
    assert abs(got["recall"] - got["accuracy"]) < 1e-9  # weighted recall equals accuracy


def test_predicted_never_true_and_confusion_scope(spark):
    df = frame(spark, ["a", "a", "b"], ["a", "z", "a"])
    counts = V.confusion_counts(V.long_predictions(df, models={V.FINETUNED: "m"}))
    pc = {r["class"]: r for r in V.per_class(counts).collect()}
    assert pc["z"].precision == 0.0 and pc["z"].support == 0
    assert pc["b"].recall == 0.0
    cells = {(r.truth, r.prediction): r.n for r in V.confusion_matrix(counts).collect()}
    assert cells == {("a", "a"): 1, ("b", "a"): 1}  # prediction 'z' is outside the truth classes


def test_report_rows(spark):
    df = frame(spark, ["a", "b", "b"], ["a", "b", "a"])
    counts = V.confusion_counts(V.long_predictions(df, models={V.FINETUNED: "m"}))
    rep = {r["class"]: r for r in V.classification_report(counts).collect()}
    assert rep["accuracy"].f1 == round(2 / 3, 10) and rep["accuracy"].support == 3
    assert rep["macro avg"].precision == round((0.5 + 1.0) / 2, 10)
