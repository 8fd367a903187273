"""DuckDB SQL for every registered query that SQL can express (same keys as
``queries.REGISTRY``). Tables are the driver's pre-registered views."""

from __future__ import annotations

from . import sqltext as Q

ORACLE: dict[str, str] = {}

POSTINGS = """
postings AS (
  SELECT doc_id AS job_id, source AS company_name, split_part(text, chr(10), 1) AS title,
         text AS description, lang AS location,
         CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS formatted_work_type,
         CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS formatted_experience_level
  FROM documents
)"""

PAGES = """
pages_p AS (
  SELECT page_id AS job_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, html AS description
  FROM pages
)"""

TEXT_COLUMNS = ["company_name", "title", "description", "location",
                "formatted_work_type", "formatted_experience_level"]

CLEANED = POSTINGS + """,
cleaned AS (
  SELECT job_id, """ + ", ".join(f"{Q.clean_text(c)} AS {c}" for c in TEXT_COLUMNS) + """
  FROM postings WHERE title IS NOT NULL AND description IS NOT NULL
),
present AS (
  SELECT *, CAST(length(description) AS INTEGER) AS description_character_count,
         CAST(""" + Q.word_count_clean("description") + """ AS INTEGER) AS description_word_count
  FROM cleaned WHERE title IS NOT NULL AND description IS NOT NULL
)"""

CLEAN_POSTINGS = CLEANED + """,
clean_postings AS (
  SELECT job_id, coalesce(company_name, 'Not specified') AS company_name, title, description,
         coalesce(location, 'Not specified') AS location,
         coalesce(formatted_work_type, 'Not specified') AS formatted_work_type,
         coalesce(formatted_experience_level, 'Not specified') AS formatted_experience_level,
         description_character_count, description_word_count
  FROM present
  WHERE description_word_count >= 50
  QUALIFY row_number() OVER (PARTITION BY title, description ORDER BY job_id) = 1
)"""

# The funnel in the reference's order: missing, blank after cleaning,
# duplicate (first = smallest id among present rows), short.
FUNNEL = POSTINGS + """,
f0 AS (
  SELECT job_id, title IS NULL OR description IS NULL AS m,
         """ + Q.clean_text("title") + """ AS ct, """ + Q.clean_text("description") + """ AS cd
  FROM postings
),
f1 AS (
  SELECT *, NOT m AND ct IS NOT NULL AND cd IS NOT NULL AS present,
         coalesce(""" + Q.word_count_clean("cd") + """, 0) AS wc
  FROM f0
),
f2 AS (
  SELECT *, CASE WHEN present THEN min(job_id) OVER (PARTITION BY present, ct, cd) END AS first_id FROM f1
),
funnel AS (
  SELECT job_id, ct, cd,
         CASE WHEN m THEN 'missing' WHEN ct IS NULL OR cd IS NULL THEN 'blank_after_clean'
              WHEN job_id <> first_id THEN 'duplicate' WHEN wc < 50 THEN 'short' END AS drop_reason
  FROM f2
)"""

ORACLE["clean_text"] = "WITH " + PAGES + f"""
SELECT job_id, {Q.clean_text('title')} AS title, {Q.clean_text('description')} AS description FROM pages_p"""

ORACLE["unescape_html"] = f"SELECT page_id, {Q.unescape('html')} AS html FROM pages"

# A chain of plain replacements cannot decode once only; the forms stand in a
# known text, whose decoding is written out here by hand.
ORACLE["unescape_all_forms"] = """
SELECT doc_id, '&lt; &x & <gt; ' || chr(172) || 'it; ' || chr(169) || '2 ABC ' || chr(8364) || ' ' || chr(65533) || ' & a &; &nosuch; ' || chr(10216)
       || ' ' || replace(text, '&', ' & ') || '&#38;' AS decoded FROM documents"""

ORACLE["text_lengths"] = "WITH " + POSTINGS + f""",
t AS (SELECT job_id, description, {Q.clean_text('description')} AS c FROM postings)
SELECT job_id, CAST(length(description) AS INTEGER) AS raw_character_count,
       CAST({Q.word_count("coalesce(description, '')")} AS INTEGER) AS raw_word_count,
       CAST(length(c) AS INTEGER) AS description_character_count,
       CAST({Q.word_count_clean('c')} AS INTEGER) AS description_word_count
FROM t"""

ORACLE["drop_missing"] = "WITH " + CLEANED + "\nSELECT job_id, title FROM present"

ORACLE["min_words"] = "WITH " + CLEANED + """
SELECT job_id, description_word_count FROM present WHERE description_word_count >= 50"""

ORACLE["dedup_first"] = "WITH " + CLEANED + """
SELECT job_id, title FROM present
QUALIFY row_number() OVER (PARTITION BY title, description ORDER BY job_id) = 1"""

ORACLE["dedup_ties"] = """
WITH d AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id % 50 END AS job_id, lang, source, n_chars FROM documents)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY job_id NULLS LAST, lang NULLS FIRST,
                                           n_chars NULLS FIRST) = 1"""

ORACLE["duplicate_counts"] = "WITH " + POSTINGS + """
SELECT 'all_columns' AS subset, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (
  SELECT count(*) AS n FROM postings GROUP BY ALL_COLS)
UNION ALL
SELECT 'description', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM postings GROUP BY description)
UNION ALL
SELECT 'title_description', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM postings GROUP BY title, description)
""".replace("ALL_COLS", "job_id, company_name, title, description, location, formatted_work_type, formatted_experience_level")

ORACLE["clean_postings"] = "WITH " + CLEAN_POSTINGS + "\nSELECT * FROM clean_postings"

ORACLE["cleaning_report"] = "WITH " + FUNNEL + """,
tot AS (
  SELECT CAST(count(*) AS DOUBLE) AS o, CAST(count(*) FILTER (WHERE drop_reason IS NULL) AS DOUBLE) AS f
  FROM funnel
),
dup AS (
  SELECT CAST(coalesce(sum(n - 1), 0) AS DOUBLE) AS d
  FROM (SELECT count(*) AS n FROM funnel WHERE drop_reason IS NULL GROUP BY ct, cd)
),
miss AS (
  SELECT CAST(count(*) FILTER (WHERE ct IS NULL) AS DOUBLE) AS mt,
         CAST(count(*) FILTER (WHERE cd IS NULL) AS DOUBLE) AS md
  FROM funnel WHERE drop_reason IS NULL
)
SELECT 'original_rows' AS metric, o AS value FROM tot
UNION ALL SELECT 'final_rows', f FROM tot
UNION ALL SELECT 'removed_rows', o - f FROM tot
UNION ALL SELECT 'retention_rate_percentage', CASE WHEN o > 0 THEN round(f * 100.0 / o, 2) ELSE 0.0 END FROM tot
UNION ALL SELECT 'minimum_description_words', 50.0
UNION ALL SELECT 'remaining_duplicate_jobs', d FROM dup
UNION ALL SELECT 'missing_titles', mt FROM miss
UNION ALL SELECT 'missing_descriptions', md FROM miss"""

ORACLE["drop_funnel"] = "WITH " + FUNNEL + """,
c AS (
  SELECT count(*) AS n,
         count(*) FILTER (WHERE drop_reason = 'missing') AS s1,
         count(*) FILTER (WHERE drop_reason = 'blank_after_clean') AS s2,
         count(*) FILTER (WHERE drop_reason = 'duplicate') AS s3,
         count(*) FILTER (WHERE drop_reason = 'short') AS s4
  FROM funnel
),
steps AS (
  SELECT 1 AS step_order, 'missing' AS step, n AS b, s1 AS r FROM c
  UNION ALL SELECT 2, 'blank_after_clean', n - s1, s2 FROM c
  UNION ALL SELECT 3, 'duplicate', n - s1 - s2, s3 FROM c
  UNION ALL SELECT 4, 'short', n - s1 - s2 - s3, s4 FROM c
)
SELECT step_order, step, CAST(b AS BIGINT) AS rows_before, CAST(r AS BIGINT) AS rows_removed,
       CAST(b - r AS BIGINT) AS rows_after,
       CASE WHEN b > 0 THEN round(r * 100.0 / b, 2) ELSE 0.0 END AS removed_pct
FROM steps"""

# --- labels ------------------------------------------------------------------

LABELS = """
bridge AS (
  SELECT doc_id AS job_id, 'Q' || CAST(quality AS VARCHAR) AS skill_abr FROM labels
  UNION ALL SELECT doc_id, 'T' || CAST(toxic AS VARCHAR) FROM labels
),
dim(skill_abr, skill_name) AS (VALUES ('Q1', 'High quality'), ('Q0', ' Low quality '), ('T1', 'Toxic')),
mapped AS (
  SELECT b.job_id, b.skill_abr, d.skill_name
  FROM bridge b LEFT JOIN dim d ON b.skill_abr IS NOT DISTINCT FROM d.skill_abr
),
folded AS (
  SELECT job_id, coalesce(array_to_string(list_sort(list_distinct(list(n) FILTER (WHERE n <> ''))), ', '), '') AS skill_name
  FROM (SELECT job_id, """ + Q.strip("skill_name") + """ AS n FROM mapped WHERE skill_name IS NOT NULL AND job_id IS NOT NULL)
  GROUP BY job_id
)"""

LABELS_AT_SIZE = """
mapped AS (
  SELECT l.l_orderkey AS job_id, l.l_partkey AS skill_abr, p.p_type AS skill_name
  FROM lineitem l LEFT JOIN part p ON l.l_partkey IS NOT DISTINCT FROM p.p_partkey
),
folded AS (
  SELECT job_id, coalesce(array_to_string(list_sort(list_distinct(list(n) FILTER (WHERE n <> ''))), ', '), '') AS skill_name
  FROM (SELECT job_id, """ + Q.strip("skill_name") + """ AS n FROM mapped WHERE skill_name IS NOT NULL AND job_id IS NOT NULL)
  GROUP BY job_id
)"""

LABELLED = CLEAN_POSTINGS + "," + LABELS + """,
labelled AS (SELECT c.*, f.skill_name FROM clean_postings c LEFT JOIN folded f USING (job_id))"""

ORACLE["map_labels"] = "WITH " + LABELS + "\nSELECT job_id, skill_abr, skill_name FROM mapped WHERE skill_name IS NOT NULL"
ORACLE["map_labels_at_size"] = "WITH " + LABELS_AT_SIZE + "\nSELECT job_id, skill_abr, skill_name FROM mapped WHERE skill_name IS NOT NULL"
ORACLE["unmapped_codes"] = "WITH " + LABELS + """
SELECT skill_abr, count(*) AS "rows" FROM bridge b
WHERE NOT EXISTS (SELECT 1 FROM dim d WHERE b.skill_abr IS NOT DISTINCT FROM d.skill_abr)
GROUP BY skill_abr"""
ORACLE["fold_labels"] = "WITH " + LABELS + "\nSELECT job_id, skill_name FROM folded"
ORACLE["fold_labels_at_size"] = "WITH " + LABELS_AT_SIZE + "\nSELECT job_id, skill_name FROM folded"
ORACLE["attach_labels"] = "WITH " + LABELS_AT_SIZE + """
SELECT o.o_orderkey AS job_id, o.o_orderstatus, o.o_orderpriority, f.skill_name
FROM orders o LEFT JOIN folded f ON o.o_orderkey = f.job_id"""
ORACLE["labeled_dataset"] = "WITH " + LABELLED + "\nSELECT * FROM labelled"
ORACLE["label_coverage"] = "WITH " + LABELLED + """
SELECT count(*) AS total_rows, count(skill_name) AS labeled_rows,
       CASE WHEN count(*) > 0 THEN count(skill_name) / count(*) ELSE 0.0 END AS label_coverage
FROM labelled"""
ORACLE["label_distribution"] = "WITH " + LABELS + """
SELECT f.skill_name, count(*) AS "rows" FROM documents d LEFT JOIN folded f ON d.doc_id = f.job_id
GROUP BY f.skill_name"""

# --- rank, split, sample -----------------------------------------------------

def _rank_sql(src: str, seed: int = 42) -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || CAST(job_id AS VARCHAR)), job_id) AS "rank",
       count(*) OVER () AS total_rows FROM {src}"""


SPLIT = LABELLED + """,
lab AS (SELECT * REPLACE (""" + Q.strip("CAST(skill_name AS VARCHAR)") + """ AS skill_name) FROM labelled WHERE skill_name IS NOT NULL),
lab2 AS (SELECT * FROM lab WHERE skill_name <> ''),
ranked AS (""" + _rank_sql("lab2") + """),
split AS (
  SELECT *, CASE WHEN "rank" <= floor(total_rows * CAST(0.8 AS DOUBLE)) THEN 'train'
                 WHEN "rank" <= floor(total_rows * CAST(""" + repr(0.8 + 0.1) + """ AS DOUBLE)) THEN 'validation'
                 ELSE 'test' END AS split
  FROM ranked
)"""

ORACLE["global_rank"] = "WITH d AS (SELECT doc_id AS job_id FROM documents)\nSELECT job_id, \"rank\" FROM (" + _rank_sql("d") + ")"
ORACLE["split_dataset"] = "WITH " + SPLIT + "\nSELECT job_id, skill_name, split FROM split"
ORACLE["split_null_ids"] = """
WITH d AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS job_id, source AS skill_name FROM documents),
h AS (SELECT *, md5('42:' || coalesce(CAST(job_id AS VARCHAR), chr(31) || coalesce(skill_name, ''))) AS h FROM d),
r AS (SELECT *, row_number() OVER (ORDER BY h, job_id NULLS FIRST, skill_name NULLS FIRST) AS r, count(*) OVER () AS n FROM h)
SELECT job_id, skill_name, CASE WHEN r <= floor(CAST(n AS DOUBLE) * 0.8) THEN 'train'
       WHEN r <= floor(CAST(n AS DOUBLE) * (CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE))) THEN 'validation' ELSE 'test' END AS split FROM r"""
ORACLE["split_sizes"] = "WITH " + SPLIT + """,
s(split) AS (VALUES ('train'), ('validation'), ('test')),
n AS (SELECT count(*) AS n FROM split)
SELECT s.split, count(x.job_id) AS "rows",
       CASE WHEN max(n.n) > 0 THEN round(count(x.job_id) / max(n.n), 10) ELSE 0.0 END AS share
FROM s CROSS JOIN n LEFT JOIN split x ON x.split = s.split GROUP BY s.split"""
ORACLE["sample_exact"] = "WITH " + SPLIT + "\nSELECT job_id, skill_name FROM ranked WHERE \"rank\" <= 20"

ORACLE["sample_approximate"] = """
SELECT doc_id AS job_id, source FROM documents
WHERE ('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT < """ + str(int(0.1 * 16**13))
ORACLE["rank_repeated_ids"] = """
WITH d AS (SELECT CASE WHEN doc_id % 3 <> 0 THEN doc_id % 100 END AS job_id, CASE WHEN doc_id % 3 <> 0 THEN source END AS source FROM documents),
h AS (SELECT *, md5('42:' || coalesce(CAST(job_id AS VARCHAR), chr(31) || coalesce(source, ''))) AS h FROM d)
SELECT job_id, source, row_number() OVER (ORDER BY h, job_id NULLS FIRST, source NULLS FIRST) AS "rank", count(*) OVER () AS total_rows FROM h"""

# --- profiling ---------------------------------------------------------------

_POST_COLS = ["job_id", "company_name", "title", "description", "location",
              "formatted_work_type", "formatted_experience_level"]
ORACLE["missing_summary"] = "WITH " + POSTINGS + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
    f"CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) ELSE 0.0 END "
    f"AS missing_percent FROM postings" for c in _POST_COLS)

_PCTS = [0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
ORACLE["length_stats"] = "WITH " + POSTINGS + f""",
w AS (SELECT CAST({Q.word_count("coalesce(description, '')")} AS INTEGER) AS wc FROM postings),
a AS (SELECT count(wc) AS "count", round(avg(wc), 6) AS mean, round(stddev_samp(wc), 6) AS std,
             CAST(min(wc) AS DOUBLE) AS "min", quantile_cont(wc, [{', '.join(map(str, _PCTS))}]) AS p,
             CAST(max(wc) AS DOUBLE) AS "max" FROM w)
SELECT "count", mean, std, "min", """ + ", ".join(
    f"p[{i + 1}] AS p{int(round(q * 100)):02d}" for i, q in enumerate(_PCTS)) + ', "max" FROM a'

ORACLE["category_distribution"] = "WITH " + POSTINGS + """,
pairs AS (
  SELECT 'formatted_experience_level' AS "column", formatted_experience_level AS value FROM postings
  UNION ALL SELECT 'formatted_work_type', formatted_work_type FROM postings
)
SELECT "column", value, count(*) AS "count",
       round(count(*) * 100.0 / (SELECT count(*) FROM postings), 2) AS percent
FROM pairs GROUP BY "column", value"""

ORACLE["shortest_rows"] = "WITH " + CLEAN_POSTINGS + """
SELECT job_id, title, description_word_count FROM clean_postings
ORDER BY description_word_count ASC NULLS LAST, job_id LIMIT 20"""
ORACLE["longest_rows"] = "WITH " + CLEAN_POSTINGS + """
SELECT job_id, title, description_word_count FROM clean_postings
ORDER BY description_word_count DESC NULLS LAST, job_id LIMIT 20"""

_TYPES = [("postings", c, "bigint" if c == "job_id" else "string") for c in _POST_COLS] + [
    ("job_skills", "job_id", "bigint"), ("job_skills", "skill_abr", "string")]
ORACLE["column_types"] = "WITH " + POSTINGS + """,
job_skills AS (SELECT doc_id AS job_id, 'Q' || CAST(quality AS VARCHAR) AS skill_abr FROM labels
               UNION ALL SELECT doc_id, 'T' || CAST(toxic AS VARCHAR) FROM labels)
""" + "\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", {[x for x in _TYPES if x[0] == t].index((t, c, k)) + 1} AS position, '{c}' AS \"column\", '{k}' AS type, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS missing FROM {t}" for t, c, k in _TYPES)
ORACLE["length_sketch"] = "\nUNION ALL\n".join(
    f'SELECT CAST({p} AS DOUBLE) AS p, count(length(text)) AS "count", true AS within FROM documents' for p in _PCTS)
ORACLE["class_count_sketch"] = """
SELECT 'lang' AS "column", count(DISTINCT lang) AS exact, true AS within FROM documents
UNION ALL SELECT 'text', count(DISTINCT text), true FROM documents
UNION ALL SELECT 'title', count(DISTINCT split_part(text, chr(10), 1)), true FROM documents"""

ORACLE["table_profile"] = """
SELECT 'postings' AS "table", count(*) AS "rows", 7 AS "columns",
       'job_id, company_name, title, description, location, formatted_work_type, formatted_experience_level' AS column_names
FROM documents
UNION ALL SELECT 'job_skills', 2 * count(*), 2, 'job_id, skill_abr' FROM labels
UNION ALL SELECT 'skills', 3, 2, 'skill_abr, skill_name'"""

# --- evaluation --------------------------------------------------------------

PREDICTIONS = """
preds AS (
  SELECT doc_id AS job_id, split_part(text, chr(10), 1) AS title, lang AS ground_truth,
         'en' AS baseline_prediction,
         CASE WHEN doc_id % 2 = 0 THEN 'Answer: ' || upper(g) || '.' ELSE g END AS finetuned_prediction
  FROM (SELECT *, CASE WHEN regexp_matches(text, '[éèêç]') THEN 'fr'
                       WHEN regexp_matches(text, '[äöüß]') THEN 'de'
                       WHEN regexp_matches(text, '[ñóíá]') THEN 'es' ELSE 'en' END AS g
        FROM documents)
),
results AS (
  SELECT job_id, title, ground_truth,
         """ + Q.clean_prediction("baseline_prediction") + """ AS baseline_prediction,
         """ + Q.clean_prediction("finetuned_prediction") + """ AS finetuned_prediction
  FROM preds
),
results2 AS (
  SELECT *, """ + Q.normalize_label("ground_truth") + " = " + Q.normalize_label("baseline_prediction") + """ AS baseline_correct,
         """ + Q.normalize_label("ground_truth") + " = " + Q.normalize_label("finetuned_prediction") + """ AS finetuned_correct
  FROM results
),
long AS (
  SELECT 'Baseline' AS model, """ + Q.normalize_label("ground_truth") + """ AS truth,
         """ + Q.normalize_label("baseline_prediction") + """ AS prediction FROM results
  UNION ALL
  SELECT 'Fine-tuned', """ + Q.normalize_label("ground_truth") + ", " + Q.normalize_label("finetuned_prediction") + """ FROM results
),
counts AS (SELECT model, truth, prediction, count(*) AS n FROM long GROUP BY ALL),
ts AS (SELECT model, truth AS class, sum(n) AS support, sum(CASE WHEN truth = prediction THEN n ELSE 0 END) AS tp
       FROM counts GROUP BY ALL),
ps AS (SELECT model, prediction AS class, sum(n) AS predicted FROM counts GROUP BY ALL),
pc AS (
  SELECT coalesce(ts.model, ps.model) AS model, coalesce(ts.class, ps.class) AS class,
         coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
  FROM ts FULL OUTER JOIN ps ON ts.model = ps.model AND ts.class = ps.class
),
pcm AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
         CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1
  FROM pc
),
weighted AS (
  SELECT model, round(sum(tp) / sum(support), 10) AS accuracy,
         round(sum(precision * support) / sum(support), 10) AS precision,
         round(sum(recall * support) / sum(support), 10) AS recall,
         round(sum(f1 * support) / sum(support), 10) AS f1, CAST(sum(support) AS BIGINT) AS samples
  FROM pcm GROUP BY model
)"""

ORACLE["normalize_label"] = "WITH " + PREDICTIONS + f"""
SELECT job_id, {Q.normalize_label('ground_truth')} AS truth_norm,
       {Q.normalize_label('finetuned_prediction')} AS prediction_norm FROM preds"""
ORACLE["clean_prediction"] = "WITH " + PREDICTIONS + """
SELECT job_id, finetuned_prediction, baseline_prediction FROM results"""
ORACLE["prediction_results"] = "WITH " + PREDICTIONS + "\nSELECT * FROM results2"
ORACLE["prediction_parity"] = """
WITH t AS (SELECT doc_id AS job_id, count(*) AS t_n FROM labels GROUP BY 1),
     p AS (SELECT doc_id AS job_id, count(*) AS p_n FROM documents GROUP BY 1),
     j AS (SELECT t_n, p_n FROM t FULL OUTER JOIN p ON t.job_id = p.job_id)
SELECT count(*) FILTER (WHERE p_n IS NULL) AS missing_predictions,
       count(*) FILTER (WHERE t_n IS NULL) AS missing_truths,
       CAST(coalesce(sum(greatest(t_n - 1, 0)), 0) AS BIGINT) AS repeated_truth_keys,
       CAST(coalesce(sum(greatest(p_n - 1, 0)), 0) AS BIGINT) AS repeated_prediction_keys
FROM j"""
APART = PREDICTIONS + """,
truths AS (SELECT job_id, ground_truth FROM preds WHERE job_id % 9 <> 0
           UNION ALL SELECT job_id, ground_truth FROM preds WHERE job_id % 9 <> 0 AND job_id % 10 = 1),
t AS (SELECT job_id, min(ground_truth) AS ground_truth, count(*) AS truth_rows FROM truths GROUP BY job_id),
p AS (SELECT job_id, min(finetuned_prediction) AS finetuned_prediction, count(*) AS prediction_rows FROM preds WHERE job_id % 7 <> 0 GROUP BY job_id),
pairs AS (
  SELECT coalesce(t.job_id, p.job_id) AS job_id, ground_truth, finetuned_prediction, coalesce(truth_rows, 0) AS truth_rows,
         coalesce(prediction_rows, 0) AS prediction_rows,
         CASE WHEN prediction_rows IS NULL THEN 'missing_prediction' WHEN truth_rows IS NULL THEN 'missing_truth'
              WHEN truth_rows > 1 OR prediction_rows > 1 THEN 'repeated_key' ELSE 'paired' END AS pair_status
  FROM t FULL OUTER JOIN p ON t.job_id = p.job_id)"""
ORACLE["pair_predictions"] = "WITH " + APART + "\nSELECT * FROM pairs"
ORACLE["pairing_verdict"] = "WITH " + APART + "\nSELECT " + ", ".join(
    f"count(*) FILTER (WHERE pair_status = '{s}') AS {s}" for s in ("paired", "no_key", "missing_prediction", "missing_truth", "repeated_key")) + """,
       CAST(coalesce(sum(truth_rows + prediction_rows) FILTER (WHERE pair_status <> 'paired'), 0) AS BIGINT) AS faulty_rows FROM pairs"""
ORACLE["class_count"] = "WITH " + PREDICTIONS + """
SELECT count(DISTINCT ground_truth) AS ground_truth_classes,
       count(DISTINCT finetuned_prediction) AS finetuned_prediction_classes FROM results2"""
ORACLE["sample_accuracy"] = "WITH " + PREDICTIONS + """
SELECT count(*) AS samples, round(coalesce(avg(CAST(finetuned_correct AS DOUBLE)), 0.0), 10) AS accuracy FROM results2"""
ORACLE["classification_metrics"] = "WITH " + PREDICTIONS + """
SELECT model, accuracy, precision, recall, f1, samples FROM weighted WHERE model = 'Fine-tuned'"""
ORACLE["classification_metrics_macro"] = "WITH " + PREDICTIONS + """
SELECT model, round(sum(tp) / sum(support), 10) AS accuracy, round(avg(precision), 10) AS precision,
       round(avg(recall), 10) AS recall, round(avg(f1), 10) AS f1, CAST(sum(support) AS BIGINT) AS samples
FROM pcm GROUP BY model"""
ORACLE["compare_models"] = "WITH " + PREDICTIONS + "\nSELECT * FROM weighted"
ORACLE["evaluate_predictions"] = ORACLE["compare_models"]
ORACLE["evaluate_paired_files"] = ORACLE["compare_models"]
ORACLE["metric_long"] = "WITH " + PREDICTIONS + """
SELECT model, 'accuracy' AS metric, accuracy AS value FROM weighted
UNION ALL SELECT model, 'precision', precision FROM weighted
UNION ALL SELECT model, 'recall', recall FROM weighted
UNION ALL SELECT model, 'f1', f1 FROM weighted"""
ORACLE["confusion_matrix"] = "WITH " + PREDICTIONS + """
SELECT c.model, c.truth, c.prediction, c.n FROM counts c
WHERE EXISTS (SELECT 1 FROM counts t WHERE t.model = c.model AND t.truth = c.prediction)"""
ORACLE["confusion_matrix_wide"] = "WITH " + PREDICTIONS + """,
wanted(truth) AS (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')),
grid AS (SELECT DISTINCT c.model, w.truth FROM counts c, wanted w)
SELECT g.model, g.truth, """ + ", ".join(
    f"CAST(coalesce(sum(c.n) FILTER (WHERE c.prediction = '{x}'), 0) AS BIGINT) AS {x}"
    for x in ("de", "en", "es", "fr", "it")) + """
FROM grid g LEFT JOIN counts c ON c.model = g.model AND c.truth = g.truth GROUP BY g.model, g.truth"""
ORACLE["confusion_matrix_observed"] = "WITH " + PREDICTIONS + """,
o AS (SELECT CASE WHEN truth = 'de' THEN 'en' ELSE truth END AS truth,
             CASE WHEN prediction IN ('en', 'es', 'fr') THEN prediction ELSE '[other]' END AS prediction FROM long WHERE model = 'Fine-tuned')
SELECT 'Fine-tuned' AS model, * FROM (PIVOT o ON prediction IN ('en', 'es', 'fr', '[other]') USING CAST(count(*) AS BIGINT) GROUP BY truth)"""
ORACLE["confusion_matrix_other"] = "WITH " + PREDICTIONS + """,
o AS (SELECT model, CASE WHEN truth IN ('es', 'fr') THEN truth ELSE '[other]' END AS truth,
             CASE WHEN prediction IN ('es', 'fr') THEN prediction ELSE '[other]' END AS prediction FROM long)
SELECT * FROM (PIVOT o ON prediction IN ('es', 'fr', '[other]') USING CAST(count(*) AS BIGINT) GROUP BY model, truth)"""
ORACLE["classification_report"] = "WITH " + PREDICTIONS + """
SELECT model, class, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1,
       CAST(support AS BIGINT) AS support FROM pcm
UNION ALL
SELECT model, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 10), CAST(sum(support) AS BIGINT) FROM pcm GROUP BY model
UNION ALL
SELECT model, 'macro avg', round(avg(precision), 10), round(avg(recall), 10), round(avg(f1), 10),
       CAST(sum(support) AS BIGINT) FROM pcm GROUP BY model
UNION ALL
SELECT model, 'weighted avg', round(sum(precision * support) / sum(support), 10),
       round(sum(recall * support) / sum(support), 10), round(sum(f1 * support) / sum(support), 10),
       CAST(sum(support) AS BIGINT) FROM pcm GROUP BY model"""

# --- prompts, chat, examples ------------------------------------------------

from ..functions import prompts as _PR  # noqa: E402


def _sql_text(s: str) -> str:
    """A fixed text with newlines as an SQL expression."""
    parts = s.split("\n")
    out = []
    for i, p in enumerate(parts):
        if p:
            out.append(Q.lit(p))
        if i < len(parts) - 1:
            out.append("chr(10)")
    return "(" + " || ".join(out) + ")"


def _prompt(title: str, desc: str) -> str:
    return (f"{_sql_text(_PR.PROMPT_HEAD + _PR.PROMPT_TITLE)} || {Q.strip(Q.as_text(title))} || "
            f"{_sql_text(_PR.PROMPT_DESCRIPTION)} || {Q.strip(Q.as_text(desc))} || {_sql_text(_PR.PROMPT_TAIL)}")


def _tokens(x: str) -> str:
    s = Q.strip(Q.collapse(x))
    return f"CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split({s}, ' ') END"


def _render(role_sql: str, content_sql: str) -> str:
    t = _PR.DEFAULT_TEMPLATE
    head, tail = t.open.split("{role}")
    return f"{_sql_text(head)} || {role_sql} || {_sql_text(tail)} || {content_sql} || {_sql_text(t.close)}"


LABELLED_DOCS = """
ldocs AS (
  SELECT d.doc_id AS job_id, split_part(d.text, chr(10), 1) AS title, d.text AS description,
         CASE WHEN l.quality = 1 THEN 'High quality' WHEN l.quality = 0 THEN 'Low quality' END AS skill_name
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
trows AS (
  SELECT job_id, """ + Q.strip("coalesce(CAST(title AS VARCHAR), '')") + """ AS title,
         """ + Q.strip("coalesce(CAST(description AS VARCHAR), '')") + """ AS description,
         """ + Q.strip("coalesce(CAST(skill_name AS VARCHAR), '')") + """ AS skill_name
  FROM ldocs
),
training AS (SELECT * FROM trows WHERE (title <> '' OR description <> '') AND skill_name <> '')"""

ORACLE["load_eval_set"] = "WITH " + LABELLED_DOCS + """,
e AS (SELECT job_id, """ + Q.strip("coalesce(CAST(title AS VARCHAR), '')") + """ AS title,
             """ + Q.strip("coalesce(CAST(description AS VARCHAR), '')") + """ AS description,
             """ + Q.strip("coalesce(CAST(skill_name AS VARCHAR), '')") + """ AS skill_name
      FROM ldocs WHERE skill_name IS NOT NULL),
e2 AS (SELECT job_id, title, description, """ + _prompt("title", "description") + """ AS instruction, skill_name
       FROM e WHERE title <> '' OR description <> '')
SELECT * FROM e2 QUALIFY row_number() OVER (PARTITION BY instruction, skill_name ORDER BY job_id) = 1"""

ORACLE["training_rows"] = "WITH " + LABELLED_DOCS + "\nSELECT job_id, title, skill_name FROM training"
ORACLE["label_nulls"] = "WITH " + LABELLED_DOCS + """
SELECT count(*) FILTER (WHERE title IS NULL) AS missing_title,
       count(*) FILTER (WHERE description IS NULL) AS missing_description,
       count(*) FILTER (WHERE skill_name IS NULL) AS missing_skill_name FROM ldocs"""
ORACLE["build_prompts"] = "WITH " + LABELLED_DOCS + f"\nSELECT job_id, {_prompt('title', 'description')} AS instruction FROM ldocs"
ORACLE["chat_messages"] = "WITH " + LABELLED_DOCS + f"""
SELECT job_id, [{{'role': 'user', 'content': {_prompt('title', 'description')}}},
                {{'role': 'assistant', 'content': {Q.as_text('skill_name')}}}] AS messages FROM training"""
ORACLE["render_chat"] = f"SELECT conv_id, turn, {_render('role', 'text')} AS rendered FROM conversations"
ORACLE["render_conversation"] = f"""
WITH c AS (SELECT conv_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, role,
                  {_render('role', 'text')} AS r
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, CAST(max(n) AS INTEGER) AS n_messages, string_agg(r, '' ORDER BY i) AS full_text,
       coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE NOT (i = n AND role = 'assistant')), '') || {_sql_text(_PR.DEFAULT_TEMPLATE.generation)} AS prompt_text
FROM c GROUP BY conv_id"""
ORACLE["conversation_roles"] = "SELECT role, count(*) AS messages FROM conversations GROUP BY role"
ORACLE["truncate_tokens"] = f"""
SELECT doc_id AS job_id, array_to_string(({_tokens('text')})[1:400], ' ') AS description FROM documents"""

_GEN = _sql_text(_PR.DEFAULT_TEMPLATE.generation)
ORACLE["loss_tokens"] = "WITH " + LABELLED_DOCS + f""",
p AS (SELECT job_id, skill_name,
             {_prompt('title', "array_to_string((" + _tokens("description") + ")[1:400], ' ')")} AS prompt FROM training),
r AS (SELECT job_id, {_render("'user'", 'prompt')} || {_GEN} AS prompt_text,
             {_render("'user'", 'prompt')} || {_render("'assistant'", Q.as_text('skill_name'))} AS full_text FROM p),
n AS (SELECT job_id, least(len({_tokens('full_text')}), 512) AS n_full,
             least(len({_tokens('prompt_text')}), 512) AS n_prompt FROM r)
SELECT job_id, CAST(greatest(n_full - n_prompt, 0) AS INTEGER) AS loss_tokens, CAST(n_full AS INTEGER) AS tokens FROM n"""

_ID = "CAST(('0x' || substr(md5(t), 1, 15))::BIGINT % 32000 AS INTEGER)"
ORACLE["encode_examples_md5"] = "WITH " + LABELLED_DOCS + f""",
p AS (SELECT job_id, skill_name,
             {_prompt('title', "array_to_string((" + _tokens("description") + ")[1:30], ' ')")} AS prompt FROM training),
r AS (SELECT job_id, {_render("'user'", 'prompt')} || {_GEN} AS prompt_text,
             {_render("'user'", 'prompt')} || {_render("'assistant'", Q.as_text('skill_name'))} AS full_text FROM p),
n AS (SELECT job_id, list_transform(({_tokens('full_text')})[1:64], lambda t: {_ID}) AS ids,
             len({_tokens('prompt_text')}) AS plen FROM r)
SELECT job_id, list_concat(ids, list_resize([]::INTEGER[], 64 - len(ids), 0)) AS input_ids,
       list_concat(list_resize([]::INTEGER[], len(ids), 1), list_resize([]::INTEGER[], 64 - len(ids), 0)) AS attention_mask,
       list_concat(list_resize([]::INTEGER[], least(plen, len(ids)), -100), ids[least(plen, len(ids)) + 1:],
                   list_resize([]::INTEGER[], 64 - len(ids), -100)) AS labels FROM n"""

ORACLE["training_sample"] = "WITH " + SPLIT + """,
tr AS (SELECT job_id, """ + Q.strip("coalesce(CAST(title AS VARCHAR), '')") + """ AS title,
              """ + Q.strip("coalesce(CAST(description AS VARCHAR), '')") + """ AS description,
              """ + Q.strip("coalesce(CAST(skill_name AS VARCHAR), '')") + """ AS skill_name
       FROM split WHERE split = 'train'),
tr2 AS (SELECT * FROM tr WHERE (title <> '' OR description <> '') AND skill_name <> '')
SELECT job_id, skill_name FROM (""" + _rank_sql("tr2") + """) WHERE "rank" <= 1000"""

# --- inference -----------------------------------------------------------------

_ACCENT = """CASE WHEN regexp_matches({x}, '[éèêç]') THEN 'fr' WHEN regexp_matches({x}, '[äöüß]') THEN 'de'
              WHEN regexp_matches({x}, '[ñóíá]') THEN 'es' ELSE 'en' END"""

ORACLE["batch_predict"] = "WITH " + LABELLED_DOCS + f""",
i AS (SELECT job_id, {_prompt('title', 'description')} AS x FROM ldocs)
SELECT job_id, {_ACCENT.format(x='x')} AS prediction FROM i"""

ORACLE["generate_answers"] = "WITH " + LABELLED_DOCS + f""",
i AS (SELECT job_id, {_render("'user'", _prompt('title', 'description'))} || {_GEN} AS x FROM ldocs),
k AS (SELECT job_id, ({_tokens('x')})[-60:] AS k FROM i)
SELECT job_id, CAST(len(k) AS INTEGER) AS input_tokens, array_to_string(k[-7:], ' ') AS input_end,
       'Answer: ' || {_ACCENT.format(x="array_to_string(k, ' ')")} || '.' AS raw_prediction FROM k"""

INFERENCE = LABELLED_DOCS + """,
e AS (SELECT job_id, """ + Q.strip("coalesce(CAST(title AS VARCHAR), '')") + """ AS title,
             """ + Q.strip("coalesce(CAST(description AS VARCHAR), '')") + """ AS description,
             """ + Q.strip("coalesce(CAST(skill_name AS VARCHAR), '')") + """ AS skill_name
      FROM ldocs WHERE skill_name IS NOT NULL),
e2 AS (SELECT job_id, title, description, """ + _prompt("title", "description") + """ AS instruction, skill_name
       FROM e WHERE title <> '' OR description <> ''),
ev AS (SELECT * FROM e2 QUALIFY row_number() OVER (PARTITION BY instruction, skill_name ORDER BY job_id) = 1),
s AS (SELECT * FROM (""" + _rank_sql("ev") + """) WHERE "rank" <= 20),
p AS (SELECT job_id, title, skill_name, """ + _ACCENT.format(x="instruction") + """ AS prediction FROM s),
inferred AS (SELECT job_id, title, skill_name, prediction,
       lower(""" + Q.strip("skill_name") + ") = lower(" + Q.strip("prediction") + """) AS correct FROM p)"""
ORACLE["inference_job"] = "WITH " + INFERENCE + "\nSELECT job_id, skill_name, prediction, correct FROM inferred"
ORACLE["prediction_preview"] = "WITH " + INFERENCE + """
SELECT job_id, substring(title, 1, 60) AS title, skill_name, prediction, correct FROM inferred"""

# --- pipeline and I/O ----------------------------------------------------------

ORACLE["pipeline_summary"] = "WITH " + SPLIT + """
SELECT (SELECT count(*) FROM postings) AS original_postings,
       (SELECT count(*) FROM clean_postings) AS cleaned_postings,
       (SELECT count(*) FROM labelled) AS training_dataset_rows,
       (SELECT count(skill_name) FROM labelled) AS labeled_rows,
       (SELECT CASE WHEN count(*) > 0 THEN count(skill_name) / count(*) ELSE 0.0 END FROM labelled) AS label_coverage,
       (SELECT count(*) FROM split WHERE split = 'train') AS train_rows,
       (SELECT count(*) FROM split WHERE split = 'validation') AS validation_rows,
       (SELECT count(*) FROM split WHERE split = 'test') AS test_rows"""

ORACLE["preprocessing_job"] = ORACLE["pipeline_summary"]
ORACLE["read_by_content"] = "SELECT doc_id, lang, source, n_chars FROM documents"
ORACLE["sniff_files"] = """
SELECT * FROM (VALUES ('csv', 'read', NULL), ('parquet', 'read', NULL),
  ('xlsx', 'rejected', 'as CSV: binary content; as a workbook: xlsx is not decoded'),
  ('unsupported', 'rejected', 'neither a CSV, workbook nor Parquet file by its suffix and first bytes')) AS f(format, status, reason)
WHERE EXISTS (SELECT 1 FROM documents)"""
ORACLE["csv_rejects"] = """
WITH d AS (SELECT doc_id, lang, split_part(text, chr(10), 1) AS title, n_chars, doc_id % 11 = 0 AS short, doc_id % 13 = 0 AS bad FROM documents)
SELECT doc_id, CASE WHEN NOT short AND title NOT IN NA_LIST THEN title END AS title, CASE WHEN NOT short AND NOT bad AND doc_id % 17 <> 0 THEN n_chars END AS n_chars,
       CASE WHEN short THEN 'shape' WHEN bad THEN 'value:n_chars' ELSE '' END AS causes,
       CASE WHEN short THEN CAST(doc_id AS VARCHAR) || ',' || lang END AS record FROM d"""

_NA = "(" + ", ".join(Q.lit(t) for t in __import__("labeltext.sources.schema", fromlist=["NA_TOKENS"]).NA_TOKENS) + ")"
ORACLE["ingest_csv"] = "WITH " + POSTINGS + "\nSELECT job_id, " + ", ".join(
    f"CASE WHEN {c} IN {_NA} THEN NULL ELSE {c} END AS {c}" for c in TEXT_COLUMNS) + " FROM postings"
ORACLE["ingest_csv_reordered"] = ORACLE["ingest_csv"]
ORACLE["csv_rejects"] = ORACLE["csv_rejects"].replace("NA_LIST", _NA)
