"""Queries: checks of tables against what they must hold, and summaries of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import names as N
from inkwell.operators import contracts as C, evaluation as E, reports as RP
from inkwell.plans.registry import Registry, table
from inkwell.plans.style_queries import COUNTS_SQL, DRAW, SCORED, THRESHOLD_SQL, _counts, _scored
from inkwell.operators import profiles as P

R = Registry()


@R.query("view_gaps", """WITH n AS (SELECT count(DISTINCT view_name) AS k FROM records), g AS (SELECT chunk_id, count(DISTINCT view_name) AS views, count(DISTINCT coalesce('v' || split, '')) AS s, count(DISTINCT coalesce('v' || author, '')) AS a, count(DISTINCT coalesce('v' || title, '')) AS t FROM records WHERE view_name IS NOT NULL GROUP BY 1)
SELECT * FROM (SELECT chunk_id, views, k - views AS missing, array_to_string(list_filter([CASE WHEN s > 1 THEN 'split' END, CASE WHEN a > 1 THEN 'author' END, CASE WHEN t > 1 THEN 'title' END], lambda x: x IS NOT NULL), ',') AS differing FROM g, n) WHERE missing > 0 OR differing <> ''""")
def view_gaps(spark, d):
    """Chunks that not every view has, or for which views differ."""
    return C.misaligned(table(spark, d, "records"), "view_name", ["chunk_id"], ["split", "author", "title"])


@R.query("sources_one_sided", "WITH a AS (SELECT DISTINCT source FROM documents), b AS (SELECT DISTINCT source FROM mix_targets) SELECT source, 'left' AS side FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source IS NOT DISTINCT FROM a.source) UNION ALL SELECT source, 'right' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.source IS NOT DISTINCT FROM a.source)")
def sources_one_sided(spark, d):
    """Sources of documents without a target, and targets without documents."""
    return C.one_sided(table(spark, d, "documents"), table(spark, d, "mix_targets"), ["source"])


@R.query("status_disagreements", "WITH a AS (SELECT o_orderkey AS k, min(o_orderstatus) AS order_status FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, min(l_linestatus) AS line_status FROM lineitem GROUP BY 1) SELECT k AS order_key, order_status, line_status FROM a FULL JOIN b USING (k) WHERE NOT coalesce(order_status = line_status, false)")
def status_disagreements(spark, d):
    """Orders whose status is not that of their lines, or that have no lines."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    return C.disagreements({"order_status": o.select(F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("v")), "line_status": l.select(F.col("l_orderkey").alias("order_key"), F.col("l_linestatus").alias("v"))}, "order_key", "v")


@R.query("chunk_coverage", "SELECT * FROM (SELECT author, title, min(chunk_index) AS least, max(chunk_index) AS most, count(*) AS rows, max(chunk_index) - min(chunk_index) + 1 - count(DISTINCT chunk_index) AS missing, count(*) - count(DISTINCT chunk_index) AS repeated FROM records WHERE chunk_index IS NOT NULL GROUP BY 1, 2) WHERE missing > 0 OR repeated > 0")
def chunk_coverage(spark, d):
    """Books whose chunk numbers do not run through, each once."""
    return C.uncovered(table(spark, d, "records"), ["author", "title"], "chunk_index")


@R.query("exposed_books", "SELECT DISTINCT book_id, 'title' AS reason FROM books WHERE title IN (SELECT title FROM documents WHERE title IS NOT NULL) UNION SELECT book_id, 'link' FROM books WHERE source_url IN (SELECT source_url FROM chapters WHERE source_url IS NOT NULL)")
def exposed_books(spark, d):
    """Books whose title is a document's, or whose link is a chapter's."""
    return C.exposed(table(spark, d, "books"), "book_id", [("title", "title", table(spark, d, "documents").select("title")), ("link", "source_url", table(spark, d, "chapters").select("source_url"))])


@R.query("unexpected_languages", "SELECT lang, count(*) AS rows FROM documents WHERE lang IS NOT NULL AND NOT (starts_with(lang, 'zh') OR starts_with(lang, 'en')) GROUP BY 1")
def unexpected_languages(spark, d):
    """Language marks that begin with none of the known ones."""
    return C.unexpected_features(table(spark, d, "documents"), "lang", ["zh", "en"])


GRAMS_SQL = "SELECT DISTINCT {k} substr(s, i, 4) AS gram FROM (SELECT {k} s, unnest(range(1, length(s) - 2)) AS i FROM (SELECT {k} regexp_replace({t}, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS s FROM {f}) WHERE length(s) >= 4)"


@R.query("introduced_grams", f"WITH c AS ({GRAMS_SQL.format(k='book_id,', t='title', f='chapters')}), r AS ({GRAMS_SQL.format(k='', t='title', f='documents')}), i AS ({GRAMS_SQL.format(k='book_id,', t='title', f='books')}) SELECT book_id, gram FROM c WHERE gram IN (SELECT gram FROM r) AND NOT EXISTS (SELECT 1 FROM i WHERE i.book_id = c.book_id AND i.gram = c.gram)")
def introduced_grams(spark, d):
    """Runs of four characters of chapter titles that some document's title has and the book's own title has not."""
    docs = table(spark, d, "documents").select("title")
    return C.introduced_grams(table(spark, d, "chapters"), docs, table(spark, d, "books"), "book_id", "title", 4)


@R.query("lost_terms", "WITH g AS (SELECT DISTINCT target FROM glossary WHERE length(target) > 0), s AS (SELECT entry_id, array_to_string(zh, chr(10)) AS zh, note FROM sentence_translations) SELECT entry_id, target FROM s, g WHERE contains(zh, target) AND NOT coalesce(contains(note, target), false)")
def lost_terms(spark, d):
    """Glossary terms that a translation has and its note does not mention."""
    s = table(spark, d, "sentence_translations").select("entry_id", F.array_join("zh", "\n").alias("zh"), "note")
    return C.lost_terms(s, table(spark, d, "glossary"), "entry_id", "zh", "note", "target")


@R.query("repeated_openings", """WITH b AS (SELECT book_id, chapter_id, list_filter(paragraphs, lambda x: x IS NOT NULL AND trim(x) <> '') AS l FROM chapters WHERE book_id IS NOT NULL), k AS (SELECT * FROM b WHERE len(l) > 0), f AS (SELECT book_id, min_by(l, chapter_id) AS f, min(chapter_id) AS o FROM k GROUP BY 1)
SELECT book_id, chapter_id, len(list_intersect(l, f)) AS same, len(list_intersect(l, f)) / len(list_distinct(f)) AS share, coalesce(nullif(list_position(list_transform(range(1, least(len(l), len(f)) + 1), lambda i: l[i] = f[i]), false), 0) - 1, least(len(l), len(f)))::BIGINT AS prefix FROM k JOIN f USING (book_id) WHERE chapter_id > o""")
def repeated_openings(spark, d):
    """How much of a book's first chapter its later ones repeat, and how they begin."""
    return C.repeated_openings(table(spark, d, "chapters"), "book_id", "chapter_id", "paragraphs")


@R.query("blank_gaps", "WITH p AS (SELECT doc_id, k - 1 AS pos, l[k] AS l FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))), f AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM p WHERE trim(l) <> '') SELECT doc_id, pos, n - pos - 1 AS blanks FROM f WHERE n - pos > 1")
def blank_gaps(spark, d):
    """Lines with nothing but blank ones before the next."""
    return C.blank_gaps(table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines")), "doc_id", "lines")


@R.query("damage_signals", "WITH p AS (SELECT unnest(paragraphs) AS t FROM chapters), s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS signal FROM p WHERE regexp_matches(t, '{v}')" for k, v in N.SIGNALS.items()) + ") SELECT signal, count(*) AS paragraphs FROM s GROUP BY 1")
def damage_signals(spark, d):
    """How many paragraphs show each signal of damage."""
    p = table(spark, d, "chapters").select(F.explode("paragraphs").alias("t")).where("t is not null")
    return p.select(F.explode(N.damage("t")).alias("signal")).groupBy("signal").agg(F.count("*").alias("paragraphs"))


@R.query("book_paths", "SELECT book_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '[\\\\/:*?\"<>|\\x00]+', '_', 'g'), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'untitled') AS path, 'anchor-' || substr(sha256(identifier || '#' || book_id::VARCHAR), 1, 20) AS anchor FROM books")
def book_paths(spark, d):
    """A file name and a stable anchor per book."""
    return table(spark, d, "books").select("book_id", N.path_name("title", "untitled").alias("path"), N.anchor(F.col("identifier"), F.col("book_id").cast("string")).alias("anchor"))


@R.query("mirror_lines", f"SELECT chapter_id, count(*) AS lines FROM (SELECT chapter_id, unnest(paragraphs) AS t FROM chapters) WHERE regexp_matches(t, '{N.MIRROR_DOMAIN}') OR regexp_matches(t, '{N.MIRROR_PROMO}') OR (contains(t, '域名') AND contains(t, '《') AND regexp_matches(t, '{N.MIRROR_WORDS}')) GROUP BY 1")
def mirror_lines(spark, d):
    """Advertisements of mirror sites per chapter."""
    p = table(spark, d, "chapters").select("chapter_id", F.explode("paragraphs").alias("t"))
    return p.where(N.is_mirror_line("t")).groupBy("chapter_id").agg(F.count("*").alias("lines"))


@R.query("declared_authors", "SELECT doc_id, list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 8), lambda x: regexp_extract(x, '^\\s*作者\\s*[:：]\\s*(\\S.{0,39}?)\\s*$', 1)), lambda x: x <> '')[1] AS author FROM documents WHERE text IS NOT NULL")
def declared_authors(spark, d):
    """The author that a document names in its first lines."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", N.declared_author(F.split("text", "\n")).alias("author"))


@R.query("link_chapters", "SELECT chapter_id, nullif(regexp_extract(source_url, '[?&]id=([^&#]*)', 1), '') AS id FROM chapters")
def link_chapters(spark, d):
    """The id in the query of a chapter's link."""
    return table(spark, d, "chapters").select("chapter_id", N.query_value("source_url", "id").alias("id"))


# ---- summaries -----------------------------------------------------------------------


@R.query("arm_means", "SELECT l_returnflag, count(*) AS units, avg(m) AS mean FROM (SELECT l_returnflag, l_orderkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def arm_means(spark, d):
    """Mean quantity by return flag, every order counting once."""
    return RP.equal_weight_means(table(spark, d, "lineitem"), "l_returnflag", "l_orderkey", "l_quantity")


@R.query("arm_outcomes", "WITH p AS (SELECT l_shipdate IS NULL AS z, l_linestatus || l_returnflag AS arm, l_suppkey AS u, max(l_quantity) AS m FROM lineitem GROUP BY 1, 2, 3) SELECT a.arm AS arm_a, b.arm AS arm_b, sum(CASE WHEN a.m > b.m THEN 1 ELSE 0 END)::BIGINT AS wins, sum(CASE WHEN a.m = b.m THEN 1 ELSE 0 END)::BIGINT AS ties, sum(CASE WHEN a.m < b.m THEN 1 ELSE 0 END)::BIGINT AS losses FROM p a JOIN p b USING (u) WHERE a.arm < b.arm GROUP BY 1, 2")
def arm_outcomes(spark, d):
    """Which kind of line has a supplier's greatest quantity: wins, ties and losses."""
    l = table(spark, d, "lineitem").groupBy(F.concat("l_linestatus", "l_returnflag").alias("arm"), "l_suppkey").agg(F.max("l_quantity").alias("m"))
    return RP.pairwise_outcomes(l, "arm", "l_suppkey", "m")


PENDING = "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_discount > 0.05 THEN 1 ELSE 0 END"


@R.query("arm_bounds", f"SELECT l_returnflag, l_linestatus, count(*) AS rows, count(*) - count(o) AS pending, sum(o) / nullif(count(o), 0) AS share, coalesce(sum(o), 0) / count(*) AS lower, (coalesce(sum(o), 0) + count(*) - count(o)) / count(*) AS upper, avg(l_tax) AS mean_lift, median(l_tax) AS median_lift FROM (SELECT *, {PENDING} AS o FROM lineitem) GROUP BY 1, 2")
def arm_bounds(spark, d):
    """Share of discounted lines by kind, with bounds for the lines left open."""
    return RP.arm_summary(table(spark, d, "lineitem").withColumn("o", F.expr(PENDING)), ["l_returnflag", "l_linestatus"], "o", "l_tax")


@R.query("shares_above", "SELECT event_type, threshold, count(*) AS rows, avg(CASE WHEN value >= threshold THEN 1.0 ELSE 0.0 END) AS share FROM events, (VALUES (25.0::DOUBLE), (50.0), (75.0)) t(threshold) WHERE value IS NOT NULL GROUP BY 1, 2")
def shares_above(spark, d):
    """Share of events of at least each value."""
    return RP.shares_above(table(spark, d, "events"), ["event_type"], "value", [25, 50, 75])


@R.query("stratum_rates", "WITH e AS (SELECT quantile_cont(l_quantity, 1/3::DOUBLE) AS a, quantile_cont(l_quantity, 2/3::DOUBLE) AS b FROM lineitem WHERE l_linestatus = 'F') SELECT ((l_quantity > a)::INTEGER + (l_quantity > b)::INTEGER)::INTEGER AS stratum, count(*) AS rows, sum((l_discount > 0.05)::BIGINT)::BIGINT AS hits, avg((l_discount > 0.05)::INTEGER) AS rate FROM lineitem, e WHERE l_linestatus = 'O' AND l_quantity IS NOT NULL GROUP BY 1")
def stratum_rates(spark, d):
    """Discounts of open lines by terciles of the closed lines' quantity."""
    l = table(spark, d, "lineitem").withColumn("hit", F.col("l_discount") > 0.05)
    return RP.stratum_rates(l.where("l_linestatus = 'F'"), l.where("l_linestatus = 'O'"), "l_quantity", "hit")


POLICY_SQL = THRESHOLD_SQL + ", fl AS (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS floor), pol AS (SELECT floor, min_by({'t': threshold, 's': sensitivity, 'n': specificity}, threshold) AS m FROM x, fl WHERE specificity >= floor GROUP BY 1)"


@R.query("policies", POLICY_SQL + " SELECT floor, m.t AS threshold, m.s AS sensitivity, m.n AS specificity FROM pol")
def policies(spark, d):
    """The least threshold for each floor of specificity."""
    return RP.policies(E.threshold_table(_scored(spark, d)), [0.3, 0.5, 0.7])


@R.query("policy_minima", POLICY_SQL + f", g AS (SELECT floor, l_linenumber, avg(CASE WHEN truth = 1 THEN (score >= m.t)::INTEGER END) AS s, avg(CASE WHEN truth = 0 THEN (score < m.t)::INTEGER END) AS n FROM ({SCORED}), pol GROUP BY 1, 2) SELECT floor, count(*) AS groups, min(s) AS least_sensitivity, min(n) AS least_specificity FROM g GROUP BY 1")
def policy_minima(spark, d):
    """The worst group under each policy."""
    s = _scored(spark, d)
    return RP.group_minima(s, RP.policies(E.threshold_table(s), [0.3, 0.5, 0.7]), "l_linenumber", "score", "truth")


@R.query("best_lines", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount >= 0.05 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_tax, l_linenumber, l_partkey) = 1")
def best_lines(spark, d):
    """Per order the best line that passes."""
    l = RP.best_rows(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_quantity"), F.asc("l_tax"), F.asc("l_linenumber"), F.asc("l_partkey")], F.col("l_discount") >= 0.05)
    return l.select("l_orderkey", "l_linenumber", "l_quantity")


@R.query("brand_terms", "WITH w AS (SELECT p_brand, lower(t) AS term, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_name || ' ' || p_type, ' ')) AS t FROM part) GROUP BY 1, 2), m AS (SELECT p_brand, lower(min(p_type)) AS title FROM part GROUP BY 1) SELECT p_brand, term, row_number() OVER (PARTITION BY p_brand ORDER BY contains(title, term) DESC, n * length(term) DESC, length(term) DESC, term) AS rank FROM w JOIN m USING (p_brand) QUALIFY rank <= 5")
def brand_terms(spark, d):
    """The five leading words of every brand."""
    p = table(spark, d, "part")
    words = p.select("p_brand", F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("t")).groupBy("p_brand", F.lower("t").alias("term")).agg(F.count("*").alias("n"))
    return RP.ranked_terms(words.join(p.groupBy("p_brand").agg(F.lower(F.min("p_type")).alias("title")), "p_brand"), "p_brand", "term", "n", "title", 5)


# Words that tell what kind of scene a text is.
CUES = {
    "action_conflict": tuple("攻击 战斗 冲上 扑向 击中 撞上 躲开 挥剑 拔刀 爆炸 鲜血 追上".split()),
    "dialogue": tuple("说道 问道 回答 开口 没有说话 沉默".split()),
    "internal_reflection": tuple("心想 心里 想到 觉得 意识到 明白 记得 仿佛 似乎".split()),
    "interpersonal_care": tuple("扶住 抱住 握住 伤口 受伤 流血 没事吧 照顾 安慰".split()),
    "travel_transition": tuple("出发 前往 抵达 路上 离开 返回 穿过 走进 走出 上车 下车".split()),
}
_CUE = {k: "|".join(sorted(v, key=lambda w: (-len(w), w))) for k, v in CUES.items()}


@R.query("scene_scores", "SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::INTEGER AS {k}" for k, p in _CUE.items()) + " FROM documents WHERE text IS NOT NULL")
def scene_scores(spark, d):
    """Cues of each kind of scene per document."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", *[c.alias(k) for k, c in RP.cue_scores(F.col("text"), CUES).items()])


@R.query("scene_types", "WITH s AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS no, '{k}' AS scene, len(regexp_extract_all(text, '{p}')) AS v FROM documents WHERE text IS NOT NULL" for i, (k, p) in enumerate(_CUE.items())) + "), c AS (SELECT doc_id, no, scene, cume_dist() OVER (PARTITION BY no ORDER BY v) AS percentile FROM s) SELECT doc_id, scene AS best, percentile FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY percentile DESC, no) = 1")
def scene_types(spark, d):
    """The kind of scene in which a document stands highest among all."""
    return RP.best_percentile(scene_scores(spark, d), "doc_id", list(CUES))


def _segments(spark, d):
    c = table(spark, d, "customer")
    as_map = lambda df, *by: df.groupBy(*by, "c_mktsegment").agg(F.avg("c_acctbal").alias("v")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "v"))).alias("m"))
    return as_map(c, "c_nationkey").crossJoin(F.broadcast(as_map(c).withColumnRenamed("m", "all")))


SEGMENT_SQL = "WITH n AS (SELECT c_nationkey, c_mktsegment AS segment, avg(c_acctbal) AS v FROM customer GROUP BY 1, 2), w AS (SELECT c_mktsegment AS segment, avg(c_acctbal) AS a FROM customer GROUP BY 1)"


@R.query("segment_deltas", SEGMENT_SQL + " SELECT c_nationkey, segment, v - a AS delta FROM n JOIN w USING (segment)")
def segment_deltas(spark, d):
    """How far a nation's mean balance by segment is from the whole."""
    return _segments(spark, d).select("c_nationkey", F.explode(RP.deltas(F.col("m"), F.col("all"))).alias("segment", "delta"))


@R.query("segment_similarity", SEGMENT_SQL + " SELECT c_nationkey, 1 / (1 + sqrt(sum(pow(coalesce(v, 0) - a, 2)))) AS similarity FROM (SELECT DISTINCT c_nationkey FROM n) k CROSS JOIN w LEFT JOIN n USING (c_nationkey, segment) GROUP BY 1")
def segment_similarity(spark, d):
    """How alike a nation's mean balances and those of all are."""
    return _segments(spark, d).select("c_nationkey", RP.map_similarity(F.col("m"), F.col("all")).alias("similarity"))


@R.query("busiest_windows", "WITH r AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id AS first, s AS total FROM r WHERE k <= greatest(1, n - 4) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, k) = 1")
def busiest_windows(spark, d):
    """The five events in a row with the greatest sum, per user."""
    return RP.busiest_window(table(spark, d, "events"), "user_id", "event_id", "value", 5)


@R.query("ablated_profiles", f"WITH {COUNTS_SQL}, l AS (SELECT author, feature, weight FROM prof WHERE feature NOT IN ('的', '了')), n AS (SELECT author, sqrt(sum(weight * weight)) AS n FROM l GROUP BY 1) SELECT author, feature, round(weight / n, 9) AS weight FROM l JOIN n USING (author)")
def ablated_profiles(spark, d):
    """Author profiles without two features, of unit length again."""
    p = P.fit_profiles(_counts(spark, d).where("split = 'train'"), 40)
    return RP.without_features(p, "author", "feature", "weight", F.col("feature").isin("的", "了")).select("author", "feature", F.round("weight", 9).alias("weight"))


@R.query("rate_bootstrap", f"""WITH per AS (SELECT user_id, avg((value > 90)::INTEGER) AS s FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1), num AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, s FROM per), size AS (SELECT count(*) AS k, avg(s) AS mean FROM per), draws AS (SELECT r, k, unnest(range(0, k)) AS p FROM range(0, 200) t(r), size),
m AS (SELECT r, avg(s) AS m, avg((s > 0)::INTEGER) AS q FROM (SELECT r, {DRAW} AS i FROM draws) JOIN num USING (i) GROUP BY 1) SELECT k AS clusters, round(mean, 8) AS mean, round(lower, 8) AS lower, round(positive, 8) AS positive_lower FROM (SELECT quantile_cont(m, 0.05) AS lower, quantile_cont(q, 0.05) AS positive FROM m), size""")
def rate_bootstrap(spark, d):
    """Share of large events, every user counting once, with a lower bound over users."""
    r = RP.rate_bootstrap(table(spark, d, "events").withColumn("hit", F.col("value") > 90), "user_id", "hit")
    return r.select("clusters", F.round("mean", 8).alias("mean"), F.round("lower", 8).alias("lower"), F.round("positive_lower", 8).alias("positive_lower"))
