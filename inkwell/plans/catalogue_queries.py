"""Queries: addresses, search, coverage, strata, quotas, set operations, nested values."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import catalogue as K, features as S
from inkwell.plans.corpus_queries import han
from inkwell.plans.registry import Registry, table
from inkwell.plans.style_queries import FLOW_SQL

R = Registry()

BARE = "regexp_replace(regexp_replace(regexp_replace(trim({c}), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', ''), '[?#].*$', ''), '/+$', '')"
URL_SQL = f"SELECT chapter_id, CASE WHEN h <> '' THEN h || regexp_extract(b, '^[^/]*(/.*)?$', 1) END AS url, h FROM (SELECT chapter_id, b, regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(b, '^([^/]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '^(www|m)\\.', '') AS h FROM (SELECT chapter_id, {BARE.format(c='source_url')} AS b FROM chapters WHERE source_url IS NOT NULL))"


@R.query("canonical_urls", f"SELECT chapter_id, url FROM ({URL_SQL})")
def canonical_urls(spark, d):
    """One form of every chapter's address."""
    return table(spark, d, "chapters").where("source_url is not null").select("chapter_id", K.canonical_url("source_url").alias("url"))


@R.query("provider_counts", f"SELECT split_part(url, '/', 1) AS host, count(*) AS chapters, count(DISTINCT url) AS pages FROM ({URL_SQL}) WHERE url IS NOT NULL GROUP BY 1")
def provider_counts(spark, d):
    """Chapters and different pages by host."""
    u = canonical_urls(spark, d).where("url is not null")
    return u.groupBy(F.split_part("url", F.lit("/"), F.lit(1)).alias("host")).agg(F.count("*").alias("chapters"), F.countDistinct("url").alias("pages"))


@R.query("first_deliveries", f"SELECT chapter_id, url FROM (SELECT chapter_id, url, row_number() OVER (PARTITION BY url ORDER BY chapter_id) AS k FROM ({URL_SQL}) WHERE url IS NOT NULL) WHERE k = 1")
def first_deliveries(spark, d):
    """The first chapter of every address."""
    return K.first_of(canonical_urls(spark, d).where("url is not null"), ["url"], ["chapter_id"])


KEY = "regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@R.query("title_search", f"SELECT book_id, level FROM (SELECT book_id, CASE WHEN t = '猎人' THEN 4 WHEN contains(t, '猎人') THEN 3 WHEN contains(t, '猎人') THEN 2 WHEN coalesce(contains(a, '猎人'), false) THEN 1 ELSE 0 END AS level FROM (SELECT book_id, {KEY.format(c='title')} AS t, {KEY.format(c='creator')} AS a FROM books)) WHERE level > 0 ORDER BY level DESC, book_id LIMIT 50")
def title_search(spark, d):
    """The fifty best books for a query."""
    b = table(spark, d, "books").select("book_id", "title", "creator")
    return K.ranked(b, K.match_level("猎人", F.col("title"), F.col("creator")), [F.col("book_id")], 50).select("book_id", "level")


@R.query("conflicting_records", "SELECT chunk_id, count(*) AS rows, count(DISTINCT ROW(coalesce(author, chr(0)), coalesce(title, chr(0)))) AS versions FROM records WHERE chunk_id IS NOT NULL GROUP BY 1 HAVING versions > 1")
def conflicting_records(spark, d):
    """Records of one id that disagree in author or title."""
    return K.conflicting(table(spark, d, "records"), "chunk_id", ["author", "title"])


@R.query("index_gaps", "SELECT author, title, chunk_index + 1 AS first, n - 1 AS last FROM (SELECT author, title, chunk_index, lead(chunk_index) OVER (PARTITION BY author, title ORDER BY chunk_index) AS n FROM (SELECT DISTINCT author, title, chunk_index FROM records WHERE chunk_index IS NOT NULL)) WHERE n > chunk_index + 1")
def index_gaps(spark, d):
    """Chunks missing inside books."""
    return K.index_gaps(table(spark, d, "records"), ["author", "title"], "chunk_index")


@R.query("orphans", "SELECT 'chapter without book' AS kind, count(*) AS n FROM chapters c WHERE NOT EXISTS (SELECT 1 FROM books b WHERE b.book_id = c.book_id) UNION ALL SELECT 'book without chapter', count(*) FROM books b WHERE NOT EXISTS (SELECT 1 FROM chapters c WHERE c.book_id = b.book_id) UNION ALL SELECT 'translation without book', count(*) FROM sentence_translations s WHERE NOT EXISTS (SELECT 1 FROM books b WHERE b.book_id = s.book_id)")
def orphans(spark, d):
    """Rows whose partner is missing."""
    b, c, s = (table(spark, d, t).select("book_id") for t in ("books", "chapters", "sentence_translations"))
    n = lambda x, kind: x.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(c.join(b, "book_id", "left_anti"), "chapter without book").union(n(b.join(c, "book_id", "left_anti"), "book without chapter")).union(n(s.join(b, "book_id", "left_anti"), "translation without book"))


@R.query("zipped_translations", "SELECT entry_id, i - 1 AS no, source[i] AS source, zh[i] AS zh FROM (SELECT entry_id, coalesce(source, []) AS source, coalesce(zh, []) AS zh, unnest(range(1, greatest(len(coalesce(source, [])), len(coalesce(zh, []))) + 1)) AS i FROM sentence_translations)")
def zipped_translations(spark, d):
    """Both sides of every entry by position."""
    return K.zipped(table(spark, d, "sentence_translations"), "entry_id", "source", "zh")


@R.query("length_strata", "WITH c AS (SELECT quantile_cont(n_chars, 1.0/3) AS a, quantile_cont(n_chars, 2.0/3) AS b FROM documents) SELECT doc_id, CASE WHEN n_chars <= a THEN 'low' WHEN n_chars <= b THEN 'medium' WHEN n_chars IS NOT NULL THEN 'high' END AS stratum, CASE WHEN n_chars IS NOT NULL THEN round((rank() OVER (PARTITION BY n_chars IS NULL ORDER BY n_chars) - 1) / greatest(count(n_chars) OVER () - 1, 1), 9) END AS percent FROM documents, c")
def length_strata(spark, d):
    """Documents by terciles of length, and their percent rank."""
    return K.strata(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "stratum", F.round("percent", 9).alias("percent"))


@R.query("quota_plan", "WITH c AS (SELECT DISTINCT author, title FROM records WHERE author IS NOT NULL AND title IS NOT NULL), h AS (SELECT creator AS author, count(*) AS n FROM books WHERE creator IS NOT NULL AND lang = 'en' GROUP BY 1) SELECT author, title FROM (SELECT c.author, title, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY c.author ORDER BY title) AS k FROM c LEFT JOIN h USING (author)) WHERE k <= 3 - n")
def quota_plan(spark, d):
    """Titles that bring every author to three."""
    c = table(spark, d, "records").where("author is not null and title is not null").select("author", "title").distinct()
    h = table(spark, d, "books").where("creator is not null and lang = 'en'").groupBy(F.col("creator").alias("author")).agg(F.count("*").alias("n"))
    return K.quota(c, h, "author", 3, ["title"])


@R.query("two_level_rates", "SELECT author, avg(r) AS rate, count(*) AS inners FROM (SELECT author, title, avg(CASE WHEN chunk_clean_units >= 60 THEN 1.0::DOUBLE ELSE 0 END) AS r FROM records WHERE author IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def two_level_rates(spark, d):
    """Share of long records by author, every book counting the same."""
    r = table(spark, d, "records").where("author is not null and title is not null")
    return K.two_level_rate(r, "author", "title", F.coalesce(F.col("chunk_clean_units") >= 60, F.lit(False)))


@R.query("split_gaps", "SELECT author, a, b, a - b AS gap FROM (SELECT author, avg(CASE WHEN split = 'train' THEN chunk_clean_units END) AS a, avg(CASE WHEN split = 'test' THEN chunk_clean_units END) AS b FROM records WHERE author IS NOT NULL GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL")
def split_gaps(spark, d):
    """Mean size of an author's records in the training split minus that in the test split."""
    return K.paired_gap(table(spark, d, "records").where("author is not null"), ["author"], "split", "train", "test", "chunk_clean_units")


@R.query("filled_titles", "WITH g AS (SELECT book_id, chapter_id, CASE WHEN trim(title) <> '' THEN title END AS good FROM chapters WHERE book_id IS NOT NULL), r AS (SELECT *, last_value(good IGNORE NULLS) OVER w AS lastgood, count(good) OVER w AS run FROM g WINDOW w AS (PARTITION BY book_id ORDER BY chapter_id ROWS UNBOUNDED PRECEDING)) SELECT chapter_id, CASE WHEN good IS NOT NULL THEN good WHEN lastgood IS NOT NULL THEN lastgood || ' (' || row_number() OVER (PARTITION BY book_id, run ORDER BY chapter_id) || ')' END AS filled FROM r")
def filled_titles(spark, d):
    """Chapter titles, missing ones after the last good one."""
    c = table(spark, d, "chapters").where("book_id is not null").select("book_id", "chapter_id", "title")
    return K.filled_titles(c, "book_id", "chapter_id", "title").select("chapter_id", "filled")


@R.query("structural_signatures", f"WITH f AS ({FLOW_SQL}) SELECT doc_id, round(spoken_share, 9) AS spoken, round(mark_density, 9) AS marks, round(mean_sentence / 50, 9) AS sentence, round(paragraphs / 60, 9) AS paragraphs FROM f")
def structural_signatures(spark, d):
    """Four numbers on the shape of every document."""
    f = S.flow_metrics(table(spark, d, "documents"), "doc_id", "text")
    return f.select("doc_id", F.round("spoken_share", 9).alias("spoken"), F.round("mark_density", 9).alias("marks"), F.round(F.col("mean_sentence") / 50, 9).alias("sentence"), F.round(F.col("paragraphs") / 60, 9).alias("paragraphs"))


@R.query("title_sets", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT title FROM books INTERSECT SELECT title FROM records) UNION ALL SELECT 'only books', count(*) FROM (SELECT title FROM books EXCEPT SELECT title FROM records) UNION ALL SELECT 'either', count(*) FROM (SELECT title FROM books UNION SELECT title FROM records)")
def title_sets(spark, d):
    """Titles in books and records: intersection, difference, union."""
    a, b = table(spark, d, "books").select("title"), table(spark, d, "records").select("title")
    n = lambda x, kind: x.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(a.intersect(b), "both").union(n(a.subtract(b), "only books")).union(n(a.union(b).distinct(), "either"))


@R.query("event_properties", "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1, 2")
def event_properties(spark, d):
    """Values of the nested property k by event type."""
    return table(spark, d, "events").where("props is not null").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@R.query("dense_confusion", "WITH l AS (SELECT DISTINCT event_type AS t FROM events), p AS (SELECT event_type AS gold, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pred FROM events) SELECT a.t AS gold, b.t AS pred, count(p.gold) AS n FROM l a CROSS JOIN l b LEFT JOIN p ON p.gold = a.t AND p.pred = b.t GROUP BY 1, 2")
def dense_confusion(spark, d):
    """Every pair of event types, with how often one follows the other (also 0). The labels are a few, the rows are joined to their pairs."""
    from pyspark.sql import Window as W

    e = table(spark, d, "events")
    p = e.select(F.col("event_type").alias("gold"), F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("pred")).groupBy("gold", "pred").agg(F.count("*").alias("n"))
    labels = e.select(F.col("event_type").alias("t")).distinct()
    grid = labels.groupBy().agg(F.collect_set("t").alias("a")).select(F.explode("a").alias("gold"), "a").select("gold", F.explode("a").alias("pred"))
    return grid.join(p, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


@R.query("book_shares", f"SELECT book_id, count(*) AS chapters, sum(h)::BIGINT AS han, round(sum(h) / nullif(sum(sum(h)) OVER (), 0), 9) AS share FROM (SELECT book_id, coalesce(list_sum(list_transform(list_filter(paragraphs, lambda x: x IS NOT NULL), lambda x: {han('x')})), 0) AS h FROM chapters WHERE book_id IS NOT NULL) GROUP BY 1")
def book_shares(spark, d):
    """Han characters of every book and its share of all."""
    from inkwell.functions import text as X

    h = F.aggregate(F.filter(F.coalesce("paragraphs", F.array().cast("array<string>")), lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda a, x: a + X.han_count(x))
    b = table(spark, d, "chapters").where("book_id is not null").select("book_id", h.alias("h")).groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum("h").alias("han"))
    return b.crossJoin(F.broadcast(b.agg(F.sum("han").alias("whole")))).select("book_id", "chapters", "han", F.round(F.col("han") / F.nullif(F.col("whole"), F.lit(0)), 9).alias("share"))
