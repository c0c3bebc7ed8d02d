"""Queries: features, author profiles, evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import evaluation as E, features as S, profiles as P, statistics as T
from inkwell.plans.corpus_queries import WS, han
from inkwell.plans.registry import Registry, table
from inkwell.session import cut

R = Registry()

FC = X.FUNCTION_CHARS
MARKS_CLASS = "".join("\\" + c if c in "[]\\^-&" else c for c in S.MARKS).replace("'", "''")


@R.query("mark_counts", f"SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^{MARKS_CLASS}]', '', 'g'), '')) AS c FROM documents) WHERE c <> '' GROUP BY 1, 2")
def mark_counts(spark, d):
    """Punctuation marks per document."""
    return S.char_counts(table(spark, d, "documents"), ["doc_id"], "text", S.MARKS)


@R.query("function_char_counts", f"SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^{FC}]', '', 'g'), '')) AS c FROM documents) WHERE c <> '' GROUP BY 1, 2")
def function_char_counts(spark, d):
    """Function characters per document."""
    return S.char_counts(table(spark, d, "documents"), ["doc_id"], "text", FC)


FLOW_SQL = f"""WITH b AS (SELECT doc_id, text AS t, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{WS}|{WS}$', '', 'g')), lambda x: x <> '') AS p,
 list_filter(string_split_regex(text, '[。！？!?]+'), lambda x: regexp_matches(x, '[一-鿿]')) AS s, {han('text')} AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n AS han, len(p) AS paragraphs, len(s) AS sentences,
 coalesce(list_sum(list_transform(p, lambda x: {han('x')})) / nullif(len(p), 0), 0) AS mean_paragraph, coalesce(list_sum(list_transform(s, lambda x: {han('x')})) / nullif(len(s), 0), 0) AS mean_sentence,
 length(regexp_replace(t, '[^{MARKS_CLASS}]', '', 'g')) / greatest(length(t), 1) AS mark_density, length(regexp_replace(t, '[^{S.SPEECH}]', '', 'g')) / greatest(length(t), 1) AS speech_density,
 len(list_filter(p, lambda x: regexp_matches(x, '^[“"「『]'))) / greatest(len(p), 1) AS spoken_share, length(regexp_replace(t, '[^{FC}]', '', 'g')) * 100.0::DOUBLE / greatest(n, 1) AS function_per_100,
 length(regexp_replace(t, '[^，]', '', 'g')) * 100.0::DOUBLE / greatest(n, 1) AS comma_per_100, length(regexp_replace(t, '[^。]', '', 'g')) * 100.0::DOUBLE / greatest(n, 1) AS period_per_100,
 length(regexp_replace(t, '[^；：]', '', 'g')) * 100.0::DOUBLE / greatest(n, 1) AS colon_per_100, length(regexp_replace(t, '[^…—]', '', 'g')) * 100.0::DOUBLE / greatest(n, 1) AS dash_per_100 FROM b"""


@R.query("flow_metrics", FLOW_SQL)
def flow_metrics(spark, d):
    """Flow of every document: lengths, densities, rates."""
    return S.flow_metrics(table(spark, d, "documents"), "doc_id", "text")


def _white(pattern: str) -> str:
    return pattern.replace("'", "''")


_VIEWS_SQL = f"""d AS (SELECT doc_id, text AS t, {han('text')} AS han, list_filter(list_transform(string_split_regex(text, '{S.LINE_END}'), lambda x: regexp_replace(x, '^{S.WHITE}+|{S.WHITE}+$', '', 'g')), lambda x: x <> '') AS lines,
 list_filter(list_transform(string_split_regex(text, '{S.ENDS}'), lambda x: {han('x')}), lambda n: n > 0) AS pieces, regexp_extract_all(text, '[{MARKS_CLASS}]') AS marks, regexp_extract_all(text, '[{S.SPEECH}]') AS speech,
 regexp_extract_all(text, '{S.WORD_PATTERN}') AS words, regexp_extract_all(text, '[{FC}]') AS chars, regexp_replace(text, '[^一-鿿]', '', 'g') AS only_han FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, list_transform(lines, lambda x: {han('x')}) AS line_han, len(list_filter(lines, lambda x: regexp_matches(x, '^[{_white(S.OPENING)}]'))) AS spoken, list_transform(regexp_extract_all(only_han, '某+'), lambda x: length(x)) AS runs, list_transform(list_filter(string_split_regex(only_han, '某+'), lambda x: x <> ''), lambda x: length(x)) AS gaps FROM d),
g(word, grp) AS (VALUES {', '.join(f"('{w}', '{k}')" for w, k in S.WORD_GROUP.items())})"""


def _interval(name: str, value: str, edges: tuple[int, ...]) -> str:
    return f"'{name}:' || CASE " + " ".join(f"WHEN {value} <= {e} THEN 'le_{e}'" for e in edges) + f" ELSE 'gt_{edges[-1]}' END"


def _tokens(prefix: str, items: str) -> str:
    return f"SELECT doc_id, '{prefix}' || x AS feature, 1.0::DOUBLE AS v FROM (SELECT doc_id, unnest({items}) AS x FROM p)"


def _bucket(name: str, value: str, edges: tuple[int, ...], where: str = "true") -> str:
    return f"SELECT doc_id, {_interval(name, value, edges)}, 1.0::DOUBLE FROM p WHERE {where}"


def _buckets(name: str, items: str, edges: tuple[int, ...]) -> str:
    return f"SELECT doc_id, {_interval(name, 'x', edges)}, 1.0::DOUBLE FROM (SELECT doc_id, unnest({items}) AS x FROM p)"


def _number(name: str, value: str, where: str = "true") -> str:
    return f"SELECT doc_id, '{name}' AS feature, ({value})::DOUBLE AS v FROM p WHERE {where}"


_MARKS_SQL = [
    _tokens("punc:", "marks"), _tokens("dialogue_mark:", "speech"), _bucket("dialogue_line_ratio", "100.0 * spoken / greatest(len(lines), 1)", (5, 15, 30, 50, 75)), _bucket("quote_count", "len(speech)", (2, 6, 12, 24, 48)),
    _bucket("colon_count", "length(t) - length(replace(replace(t, '：', ''), ':', ''))", (1, 3, 6, 12, 24)), _bucket("ellipsis_count", "length(t) - length(replace(t, '…', ''))", (1, 2, 4, 8, 16)),
]
_LENGTHS_SQL = [
    _bucket("paragraph_count", "len(lines)", (1, 2, 4, 8, 16, 32)), _bucket("sentence_count", "len(pieces)", (3, 6, 10, 16, 24, 40)),
    _bucket("avg_sentence_cjk", "list_avg(pieces)", (12, 20, 32, 48, 72, 110), "len(pieces) > 0"), _buckets("sentence_cjk", "pieces", (8, 16, 28, 45, 70, 110, 180)),
    _bucket("avg_paragraph_cjk", "list_avg(line_han)", (40, 80, 140, 220, 360, 600), "len(lines) > 0"), _buckets("paragraph_cjk", "line_han", (30, 70, 120, 200, 340, 560, 900)),
]
_CHARS_SQL = [_tokens("function_char:", "chars"), _bucket("function_ratio", "100.0 * len(chars) / greatest(han, 1)", (20, 30, 40, 50, 60, 70))]
_WORDS_SQL = [
    _tokens("function_word:", "words"), "SELECT doc_id, 'function_word_group:' || grp, 1.0::DOUBLE FROM (SELECT doc_id, unnest(words) AS word FROM p) JOIN g USING (word)",
    _bucket("function_word_ratio", "1000.0 * len(words) / greatest(han, 1)", (2, 5, 10, 20, 35, 55, 80, 120)), _bucket("function_word_diversity", "len(list_distinct(words))", (2, 4, 8, 12, 18, 26, 36, 50)),
]
_MASKS_SQL = [
    _number("cjk_count", "han"), _number("mask_fraction", "coalesce(list_sum(runs), 0) / greatest(han, 1)"), _number("run_count_per_1k", "1000.0 * len(runs) / greatest(han, 1)"),
    *[q for k in ("run", "gap") for q in (_number(f"{k}_length_mean", f"list_avg({k}s)", f"len({k}s) > 0"), _number(f"{k}_length_max", f"list_max({k}s)", f"len({k}s) > 0"))],
]
_FAMILY_SQL = {"punctuation_dialogue": _MARKS_SQL, "length_shape": _LENGTHS_SQL, "function_words": _WORDS_SQL, "combined_rich_function_words": [*_MARKS_SQL, *_LENGTHS_SQL, *_CHARS_SQL, *_WORDS_SQL], "mask_topology": _MASKS_SQL}

for _family in ("punctuation_dialogue", "length_shape", "function_words", "combined_rich_function_words", "mask_topology", "sentence_rhythm", "function_grammar", "paragraph_discourse"):

    def _one(spark, d, family=_family):
        """Feature counts of the corpus by family: documents with each feature, and its total."""
        return S.feature_counts(table(spark, d, "documents"), "doc_id", "text", family).groupBy("feature").agg(F.count("*").alias("documents"), F.round(F.sum("value"), 6).alias("total"))

    _sql = f"WITH {_VIEWS_SQL}, f(doc_id, feature, v) AS ({' UNION ALL '.join(_FAMILY_SQL[_family])}) SELECT feature, count(DISTINCT doc_id) AS documents, round(sum(v), 6) AS total FROM f GROUP BY 1" if _family in _FAMILY_SQL else None
    R.query(f"features_{_family}", _sql)(_one)


@R.query("char_ngram_totals", "WITH s AS (SELECT doc_id, regexp_replace(text, '[ \\t\\n\\r\\x0B\\f\\x{3000}\\x{a0}\\x{2003}\\x{2009}\\x{202f}\\x{85}]+', '', 'g') AS s FROM documents WHERE text IS NOT NULL) SELECT 2::BIGINT AS n, count(DISTINCT g) AS grams, count(*) AS total FROM (SELECT substr(s, i, 2) AS g FROM (SELECT s, unnest(range(1, length(s))) AS i FROM s))")
def char_ngram_totals(spark, d):
    """How many different character pairs all documents have, and how many in all."""
    docs = table(spark, d, "documents").where("text is not null").select(F.regexp_replace("text", "[ \\t\\n\\r\\x0B\\f\\u3000\\u00a0\\u2003\\u2009\\u202f\\u0085]+", "").alias("text"))
    pairs = docs.select(F.split("text", "").alias("c")).select(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("b")).alias("z")).select(F.explode("z").alias("z"))
    g = pairs.groupBy("z.a", "z.b").agg(F.count("*").alias("k"))
    return g.agg(F.count("*").alias("grams"), F.sum("k").alias("total")).select(F.lit(2).cast("long").alias("n"), "grams", "total")


COUNTS_SQL = f"""c AS (SELECT rid, author, title, split, c AS feature, count(*) AS n FROM (SELECT md5(concat_ws('|', chunk_id, text, added_at::VARCHAR)) AS rid, author, title, split, unnest(string_split(regexp_replace(text, '[^{FC}]', '', 'g'), '')) AS c FROM (SELECT DISTINCT chunk_id, author, title, split, text, NULL AS added_at FROM records WHERE author IS NOT NULL AND title IS NOT NULL)) WHERE c <> '' GROUP BY ALL),
per AS (SELECT author, feature, sum(n) AS n FROM c WHERE split = 'train' GROUP BY 1, 2), size AS (SELECT author, sum(n) AS total FROM per GROUP BY 1), df AS (SELECT feature, count(*) AS df FROM per GROUP BY 1), k AS (SELECT count(*) AS authors FROM size),
w AS (SELECT author, feature, n / greatest(total, 1) * (ln((authors + 1) / (df + 1)) + 1) AS w, ln((authors + 1) / (df + 1)) + 1 AS idf FROM per JOIN size USING (author) JOIN df USING (feature), k),
kept AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY w DESC, feature) AS r FROM w QUALIFY r <= 40),
prof AS (SELECT author, feature, w / sqrt(sum(w * w) OVER (PARTITION BY author)) AS weight, idf FROM kept)"""


def _texts(spark, d):
    r = table(spark, d, "records").where("author is not null and title is not null").select("chunk_id", "author", "title", "split", "text").distinct()
    return r.withColumn("rid", F.md5(F.concat_ws("|", "chunk_id", "text")))


def _counts(spark, d):
    return S.char_counts(_texts(spark, d), ["rid", "author", "title", "split"], "text", FC).withColumnRenamed("c", "feature")


@R.query("author_profiles", f"WITH {COUNTS_SQL} SELECT author, feature, round(weight, 9) AS weight FROM prof")
def author_profiles(spark, d):
    """Author profiles over function characters, fitted on the training split."""
    return P.fit_profiles(_counts(spark, d).where("split = 'train'"), 40).select("author", "feature", F.round("weight", 9).alias("weight"))


PRED_SQL = f"""{COUNTS_SQL}, q AS (SELECT rid, author AS gold, title, split, feature, n FROM c WHERE split <> 'train'), qt AS (SELECT rid, gold, title, split, sum(n) AS total FROM q GROUP BY ALL), fi AS (SELECT feature, max(idf) AS idf FROM prof GROUP BY 1),
qd AS (SELECT rid, gold, title, split, feature, n / total * idf AS w FROM q JOIN qt USING (rid, gold, title, split) JOIN fi USING (feature)), qn AS (SELECT rid, gold, title, split, sqrt(sum(w * w)) AS norm FROM qd GROUP BY ALL),
sc AS (SELECT rid, gold, title, split, author, sum(w * weight) AS dot FROM qd JOIN prof USING (feature) GROUP BY ALL),
p AS (SELECT rid, gold, title, split, max(ROW(round(dot / norm, 9), author)) AS m FROM sc JOIN qn USING (rid, gold, title, split) GROUP BY ALL), pred AS (SELECT rid, gold, title, split, m[2] AS pred, m[1] AS score FROM p)"""


def _predictions(spark, d):
    kept = F.regexp_replace("text", f"[^{FC}]+", "").alias("kept")
    r = cut(_texts(spark, d).select("rid", "author", "title", "split", kept)).where("kept <> ''")  # so that a text is searched once, for both splits
    train = r.where("split = 'train'").select("author", F.explode(F.split("kept", "")).alias("feature"), F.lit(1).alias("n")).where("feature <> ''")
    rest = r.where("split <> 'train'").groupBy(F.concat_ws("\u0001", "rid", "author", "title", "split").alias("id")).agg(F.split(F.array_join(F.collect_list("kept"), ""), "").alias("f"))
    got = P.best_author_of(rest, P.fit_profiles(train, 40))
    part = F.split("id", "\u0001")
    return got.select(part[0].alias("rid"), part[1].alias("gold"), part[2].alias("title"), part[3].alias("split"), "pred", "score")


@R.query("author_predictions", f"WITH {PRED_SQL} SELECT rid, gold, title, split, pred, score FROM pred")
def author_predictions(spark, d):
    """The author predicted for every record outside the training split."""
    return _predictions(spark, d)


LABEL_SQL = """lab AS (SELECT split, label, sum(tp) AS tp, sum(g) AS g, sum(p) AS p FROM (SELECT split, gold AS label, sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS tp, count(*) AS g, 0 AS p FROM rows GROUP BY 1, 2 UNION ALL SELECT split, pred, 0, 0, count(*) FROM rows GROUP BY 1, 2) GROUP BY 1, 2),
m AS (SELECT split, label, tp::BIGINT AS tp, (p - tp)::BIGINT AS fp, (g - tp)::BIGINT AS fn, coalesce(tp / nullif(p, 0), 0) AS precision, coalesce(tp / nullif(g, 0), 0) AS recall FROM lab),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)"""


@R.query("author_label_metrics", f"WITH {PRED_SQL}, rows AS (SELECT split, gold, pred FROM pred), {LABEL_SQL} SELECT split, label, tp, fp, fn, precision, recall, f1 FROM f")
def author_label_metrics(spark, d):
    """Precision, recall and F1 per split and author."""
    return E.by_label(_predictions(spark, d), ["split"])


@R.query("author_metrics", f"WITH {PRED_SQL}, rows AS (SELECT split, gold, pred FROM pred), {LABEL_SQL} SELECT split, sum(tp + fn)::BIGINT AS rows, sum(tp) / sum(tp + fn) AS accuracy, avg(recall) AS balanced_accuracy, avg(f1) AS macro_f1, max(tp + fn) / sum(tp + fn) AS majority_share FROM f WHERE tp + fn > 0 GROUP BY split")
def author_metrics(spark, d):
    """Accuracy, balanced accuracy and macro F1 per split."""
    return E.summary(_predictions(spark, d), ["split"])


@R.query("author_book_metrics", f"WITH {PRED_SQL}, v AS (SELECT split, gold, title, pred, count(*) AS votes FROM pred GROUP BY ALL), b AS (SELECT split, gold, title, max(ROW(votes, pred)) AS m FROM v GROUP BY 1, 2, 3), rows AS (SELECT split, gold, m[2] AS pred FROM b), {LABEL_SQL} SELECT split, sum(tp + fn)::BIGINT AS rows, sum(tp) / sum(tp + fn) AS accuracy, avg(recall) AS balanced_accuracy, avg(f1) AS macro_f1, max(tp + fn) / sum(tp + fn) AS majority_share FROM f WHERE tp + fn > 0 GROUP BY split")
def author_book_metrics(spark, d):
    """The same for whole books, by majority vote of their records."""
    return E.summary(P.book_vote(_predictions(spark, d), ["split", "gold", "title"]), ["split"])


@R.query("author_confusions", f"WITH {PRED_SQL} SELECT gold, pred, count(*) AS n FROM pred WHERE gold IS DISTINCT FROM pred GROUP BY 1, 2 ORDER BY n DESC, gold, pred LIMIT 10")
def author_confusions(spark, d):
    """The ten most frequent confusions."""
    return E.confusions(_predictions(spark, d))


OBS_SQL = f"SELECT author, title, '，' AS feature, length(text) - length(replace(text, '，', '')) AS num, {han('text')} AS den FROM records WHERE text IS NOT NULL AND author IS NOT NULL AND title IS NOT NULL UNION ALL SELECT author, title, '。', length(text) - length(replace(text, '。', '')), {han('text')} FROM records WHERE text IS NOT NULL AND author IS NOT NULL AND title IS NOT NULL UNION ALL SELECT author, title, '“', length(text) - length(replace(text, '“', '')), {han('text')} FROM records WHERE text IS NOT NULL AND author IS NOT NULL AND title IS NOT NULL"


def _observations(spark, d):
    r = table(spark, d, "records").where("text is not null and author is not null and title is not null")
    return r.select("author", "title", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).alias("num")) for c in "，。“"])).alias("o"), X.han_count("text").alias("den")).select("author", "title", "o.feature", "o.num", "den")


@R.query("author_ratio_profiles", f"SELECT author, feature, sum(num) / nullif(sum(den), 0) AS value, count(*) AS support, count(DISTINCT title) AS books FROM ({OBS_SQL}) GROUP BY 1, 2")
def author_ratio_profiles(spark, d):
    """Mergeable ratio profiles: marks per Han character by author."""
    return P.ratio_profiles(_observations(spark, d), "author", "title")


@R.query("author_contrasts", f"WITH pr AS (SELECT author, feature, sum(num) / nullif(sum(den), 0) AS value, count(*) AS support, count(DISTINCT title) AS books FROM ({OBS_SQL}) GROUP BY 1, 2), o AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS sd, count(*) AS groups FROM pr WHERE author <> '砚边拾萤' AND value IS NOT NULL GROUP BY 1 HAVING count(*) >= 3) SELECT feature, value, mean, value - mean AS delta, CASE WHEN sd > 1e-12 THEN (value - mean) / sd ELSE 0 END AS z, CASE WHEN value >= mean THEN 'higher' ELSE 'lower' END AS direction, support, books, groups FROM pr JOIN o USING (feature) WHERE author = '砚边拾萤' AND value IS NOT NULL")
def author_contrasts(spark, d):
    """The largest author against all others."""
    return P.contrasts(P.ratio_profiles(_observations(spark, d), "author", "title"), "author", "砚边拾萤")


@R.query("author_standard_scores", "WITH m AS (SELECT author, median(chunk_clean_units) AS units, median(length(text)) AS chars FROM (SELECT author, chunk_clean_units, text FROM records WHERE author IS NOT NULL) GROUP BY 1), w AS (SELECT avg(units) AS um, stddev_samp(units) AS us, avg(chars) AS cm, stddev_samp(chars) AS cs FROM m) SELECT author, units, chars, coalesce((units - um) / nullif(us, 0), 0) AS units_z, coalesce((chars - cm) / nullif(cs, 0), 0) AS chars_z FROM m, w")
def author_standard_scores(spark, d):
    """Author medians of record size, standardised over authors."""
    r = table(spark, d, "records").where("author is not null").select("author", F.col("chunk_clean_units").alias("units"), F.length("text").alias("chars"))
    return P.standard_scores(r, "author", ["units", "chars"])


@R.query("dispersed_features", f"WITH {COUNTS_SQL} SELECT feature, count(DISTINCT CASE WHEN author = '砚边拾萤' THEN title END) AS books, count(DISTINCT CASE WHEN author <> '砚边拾萤' THEN author END) AS authors FROM c GROUP BY 1 HAVING books >= 3 OR authors >= 40")
def dispersed_features(spark, d):
    """Function characters that enough books of one author, or enough other authors, have."""
    return P.dispersed(_counts(spark, d), "砚边拾萤", 3, 40)


SCORED = "SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS truth, l_discount * 10 AS score, l_orderkey, l_linenumber FROM lineitem"


def _scored(spark, d):
    return table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("truth"), (F.col("l_discount") * 10).alias("score"), "l_orderkey", "l_linenumber")


THRESHOLD_SQL = f"""WITH s AS ({SCORED}), per AS (SELECT score, sum(truth)::DOUBLE AS pos, sum(1 - truth)::DOUBLE AS neg FROM s GROUP BY 1),
t AS (SELECT score AS threshold, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM per),
x AS (SELECT threshold, tp / p AS sensitivity, (n - fp) / n AS specificity, (tp / p + (n - fp) / n) / 2 AS balanced FROM t)"""


@R.query("threshold_table", THRESHOLD_SQL + " SELECT threshold, sensitivity, specificity, balanced FROM x")
def threshold_table(spark, d):
    """Sensitivity and specificity at every threshold."""
    return E.threshold_table(_scored(spark, d))


@R.query("chosen_threshold", THRESHOLD_SQL + " SELECT threshold, sensitivity, specificity, balanced, sensitivity >= 0.5 AND specificity >= 0.4 AS eligible FROM x ORDER BY eligible DESC, CASE WHEN eligible THEN threshold END NULLS FIRST, balanced DESC, specificity DESC, sensitivity DESC, threshold LIMIT 1")
def chosen_threshold(spark, d):
    """The threshold that meets both floors."""
    return E.choose_threshold(E.threshold_table(_scored(spark, d)), 0.5, 0.4)


@R.query("roc_auc", f"WITH s AS ({SCORED}), per AS (SELECT score, sum(truth) AS p, sum(1 - truth) AS n FROM s GROUP BY 1), b AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM per) SELECT (sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0))::DOUBLE AS auc FROM b")
def roc_auc(spark, d):
    """Area under the ROC curve."""
    return E.auc(_scored(spark, d))


@R.query("calibration_error", f"WITH s AS ({SCORED}) SELECT sum(abs(s - t)) / sum(w) AS ece FROM (SELECT least(floor(score * 10), 9) AS bin, count(*) AS w, sum(score) AS s, sum(truth) AS t FROM s GROUP BY 1)")
def calibration_error(spark, d):
    """Expected calibration error over ten bins."""
    return E.calibration_error(_scored(spark, d))


@R.query("record_weights", "WITH r AS (SELECT author, title, count(*) AS n FROM records WHERE author IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2), b AS (SELECT author, count(*) AS books FROM r GROUP BY 1), k AS (SELECT count(*) AS groups FROM b), z AS (SELECT sum(n)::BIGINT AS rows FROM r) SELECT author, title, n, round(1.0::DOUBLE / groups / books / n * rows, 9) AS weight FROM r JOIN b USING (author), k, z")
def record_weights(spark, d):
    """Weights that give every author, and every book of an author, the same mass."""
    r = table(spark, d, "records").where("author is not null and title is not null").select("author", "title")
    return E.hierarchical_weights(r, "author", "title").groupBy("author", "title").agg(F.count("*").alias("n"), F.round(F.max("weight"), 9).alias("weight"))


Z = 1.959963984540054


@R.query("wilson_intervals", f"WITH s AS (SELECT event_type, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::DOUBLE AS k, count(*)::DOUBLE AS n FROM events GROUP BY 1) SELECT event_type, k / n AS estimate, greatest(0, (k / n + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n) - {Z} * sqrt(k / n * (1 - k / n) / n + {Z * Z} / (4 * n * n)) / (1 + {Z * Z} / n)) AS lower, least(1, (k / n + {Z * Z} / (2 * n)) / (1 + {Z * Z} / n) + {Z} * sqrt(k / n * (1 - k / n) / n + {Z * Z} / (4 * n * n)) / (1 + {Z * Z} / n)) AS upper FROM s")
def wilson_intervals(spark, d):
    """Share of large events by type with its Wilson interval."""
    g = table(spark, d, "events").groupBy("event_type").agg(F.sum((F.col("value") > 50).cast("double")).alias("k"), F.count("*").cast("double").alias("n"))
    lo, hi = T.wilson(F.col("k"), F.col("n"))
    return g.select("event_type", (F.col("k") / F.col("n")).alias("estimate"), lo.alias("lower"), hi.alias("upper"))


@R.query("rank_correlation", "WITH b AS (SELECT l_returnflag AS flag, l_quantity AS a, l_discount AS b FROM lineitem), r AS (SELECT flag, rank() OVER (PARTITION BY flag ORDER BY a) + (count(*) OVER (PARTITION BY flag, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY flag ORDER BY b) + (count(*) OVER (PARTITION BY flag, b) - 1) / 2 AS rb FROM b) SELECT flag, round(corr(ra, rb), 9) AS rho, count(*) AS n FROM r GROUP BY 1")
def rank_correlation(spark, d):
    """Spearman correlation of quantity and discount by return flag."""
    b = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return T.spearman(b, "a", "b", ["flag"]).select("flag", F.round("rho", 9).alias("rho"), "n")


@R.query("quantile_kinds", "SELECT event_type, quantile_cont(value, 0.9) AS linear, (list_sort(list(value)))[greatest(1, ceil(0.9 * count(*)))::INTEGER] AS nearest, median(value) AS median FROM events WHERE value IS NOT NULL GROUP BY 1")
def quantile_kinds(spark, d):
    """The 90 % point by linear interpolation and by nearest rank, and the median."""
    e = table(spark, d, "events").where("value is not null")
    near = T.nearest_rank(e, ["event_type"], "value", 0.9).withColumnRenamed("value", "nearest")
    return e.groupBy("event_type").agg(F.percentile("value", 0.9).alias("linear"), F.median("value").alias("median")).join(near, "event_type")


DRAW = "(('0x' || substr(md5(concat_ws(':', '13', r::VARCHAR, p::VARCHAR)), 1, 8))::BIGINT % k)"


@R.query("cluster_bootstrap", f"""WITH per AS (SELECT user_id, sum(value) AS s, count(*) AS n FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY 1), num AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, s, n FROM per), size AS (SELECT count(*) AS k, sum(s) / sum(n) AS mean FROM per),
draws AS (SELECT r, k, unnest(range(0, k)) AS p FROM range(0, 200) t(r), size), m AS (SELECT r, sum(s) / sum(n) AS m FROM (SELECT r, {DRAW} AS i FROM draws) JOIN num USING (i) GROUP BY 1)
SELECT round(mean, 8) AS mean, round(lower, 8) AS lower, round(upper, 8) AS upper, resamples, k AS clusters FROM (SELECT quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper, count(*) AS resamples FROM m), size""")
def cluster_bootstrap(spark, d):
    """Mean event value with a bootstrap interval over users."""
    r = T.cluster_bootstrap(table(spark, d, "events"), "user_id", "value")
    return r.select(F.round("mean", 8).alias("mean"), F.round("lower", 8).alias("lower"), F.round("upper", 8).alias("upper"), "resamples", "clusters")


@R.query("permutation_test", """WITH b AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS g, c_acctbal AS v FROM customer), size AS (SELECT sum(g) AS ones, avg(CASE WHEN g = 1 THEN v END) - avg(CASE WHEN g = 0 THEN v END) AS observed FROM b),
k AS (SELECT r, v, row_number() OVER (PARTITION BY r ORDER BY md5(concat_ws(':', '13', r::VARCHAR, id::VARCHAR)), id) AS k FROM b, range(0, 200) t(r)), d AS (SELECT r, avg(CASE WHEN k <= ones THEN v END) - avg(CASE WHEN k > ones THEN v END) AS d FROM k, size GROUP BY 1)
SELECT round(max(observed), 8) AS observed, (sum(CASE WHEN abs(d) >= abs(observed) - 1e-12 THEN 1 ELSE 0 END) + 1) / (count(*) + 1) AS p, count(*) AS permutations FROM d, size""")
def permutation_test(spark, d):
    """Is one market segment's balance different: permutation test."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("g"), F.col("c_acctbal").alias("v"))
    return T.permutation_test(c, "g", "v").select(F.round("observed", 8).alias("observed"), "p", "permutations")


@R.query("adjusted_p_values", "WITH p AS (SELECT p_brand, (count(*) % 97 + 1) / 100.0::DOUBLE AS p FROM part GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p, p_brand) AS k, count(*) OVER () AS n FROM p) SELECT p_brand, p, min(least(1, p * n / k)) OVER (ORDER BY k DESC) AS q FROM k")
def adjusted_p_values(spark, d):
    """Benjamini-Hochberg adjustment."""
    p = table(spark, d, "part").groupBy("p_brand").agg(((F.count("*") % 97 + 1) / F.lit(100.0)).alias("p"))
    return T.benjamini_hochberg(p, "p")
