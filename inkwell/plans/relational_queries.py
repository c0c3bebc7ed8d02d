"""Queries: near duplicates, retrieval, joins and guarded updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import changes as CH, corpus as C, joins as J, similarity as S, splits as SP
from inkwell.plans.corpus_queries import BOOK_LINES, SPLIT_SQL, WS
from inkwell.plans.registry import Registry, table

R = Registry()


@R.query("near_duplicates")
def near_duplicates(spark, d):
    """Class and number of links of every document among near duplicates (five words, 0.8)."""
    return S.near_duplicates(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@R.query("near_pairs")
def near_pairs(spark, d):
    """Similar pairs of documents that represent different texts."""
    return S.near_pairs(table(spark, d, "documents"), "doc_id", "text").select("a", "b", F.round("similarity", 6).alias("similarity"))


COS = "list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))"


@R.query("nearest_vectors", f"SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, round({COS}, 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)) WHERE rank <= 5")
def nearest_vectors(spark, d):
    """The five nearest vectors of every vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    return S.top_k(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 64, 5)


@R.query("nearest_documents")
def nearest_documents(spark, d):
    """The five nearest documents, by hashed character grams, of every document whose id is divisible by 50."""
    v = S.hashed_vectors(table(spark, d, "documents"), "doc_id", "text")
    return S.top_k(v, v.where("id % 50 = 0"), "id", "vector", 256, 5)


VARIANTS = f"list_distinct(list_filter([t, regexp_replace(t, '[（(【\\[][^（(【\\[）)】\\]]*[）)】\\]]$', '')], lambda x: x <> ''))"


def _variants(tbl: str, key: str) -> str:
    return f"SELECT {key}, unnest({VARIANTS}) AS v FROM (SELECT {key}, regexp_replace(regexp_replace(lower(regexp_replace(title, '{WS}', '', 'g')), '^[《「『]|[》」』]$', '', 'g'), '^$', '') AS t FROM {tbl} WHERE title IS NOT NULL)"


@R.query("title_matches", f"SELECT DISTINCT a.book_id, b.doc_id FROM ({_variants('books', 'book_id')}) a JOIN ({_variants('documents', 'doc_id')}) b USING (v)")
def title_matches(spark, d):
    """Books and documents of which some title variants are equal."""
    return J.match_titles(table(spark, d, "books"), table(spark, d, "documents"), "book_id", "doc_id")


@R.query("metadata_overlay", "WITH p AS (SELECT book_id, max(source_url) AS source_url, max(published_at) AS issue_date FROM chapters GROUP BY 1) SELECT b.book_id, CASE WHEN p.issue_date IS NOT NULL AND p.issue_date <> '' THEN p.issue_date ELSE b.issue_date END AS issue_date, b.source_url AS source_url FROM books b LEFT JOIN p USING (book_id)")
def metadata_overlay(spark, d):
    """Book dates replaced by chapter dates where there is one; the pinned URL stays."""
    p = table(spark, d, "chapters").groupBy("book_id").agg(F.max("source_url").alias("source_url"), F.max("published_at").alias("issue_date"))
    return J.overlay(table(spark, d, "books").select("book_id", "issue_date", "source_url"), p, "book_id", ["issue_date", "source_url"], keep=["source_url"])


@R.query("language_cascade", "WITH a AS (SELECT book_id, min(lang) AS lang FROM books WHERE lang IN ('zh', 'en') GROUP BY 1), b AS (SELECT book_id, 'zh-by-text' AS lang FROM chapters WHERE regexp_matches(title, '[一-鿿]') GROUP BY 1), c AS (SELECT book_id, 'unknown' AS lang FROM chapters GROUP BY 1) SELECT x.book_id, coalesce(a.lang, b.lang, c.lang) AS lang, CASE WHEN a.lang IS NOT NULL THEN 0 WHEN b.lang IS NOT NULL THEN 1 WHEN c.lang IS NOT NULL THEN 2 END AS source_no FROM (SELECT DISTINCT book_id FROM chapters WHERE book_id IS NOT NULL) x LEFT JOIN a USING (book_id) LEFT JOIN b USING (book_id) LEFT JOIN c USING (book_id)")
def language_cascade(spark, d):
    """A book's language from the first source that knows it."""
    ch, b = table(spark, d, "chapters"), table(spark, d, "books")
    s1 = b.where("lang in ('zh', 'en')").groupBy("book_id").agg(F.min("lang").alias("lang"))
    s2 = ch.where(F.col("title").rlike("[\\u4e00-\\u9fff]")).select("book_id").distinct().withColumn("lang", F.lit("zh-by-text"))
    s3 = ch.select("book_id").distinct().withColumn("lang", F.lit("unknown"))
    return J.cascade(ch.where("book_id is not null").select("book_id").distinct(), "book_id", "lang", [s1, s2, s3])


@R.query("overlapping_orders", "SELECT a.o_custkey AS k, a.o_orderkey AS a, b.o_orderkey AS b FROM (SELECT o_custkey, o_orderkey, epoch(o_orderdate)::BIGINT // 86400 AS s FROM orders) a JOIN (SELECT o_custkey, o_orderkey, epoch(o_orderdate)::BIGINT // 86400 AS s FROM orders) b ON a.o_custkey = b.o_custkey AND a.s <= b.s + 30 AND b.s <= a.s + 30 AND a.o_orderkey < b.o_orderkey")
def overlapping_orders(spark, d):
    """Orders of one customer whose thirty-day periods overlap."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.unix_date(F.to_date("o_orderdate")).cast("long").alias("start")).withColumn("stop", F.col("start") + 30)
    return J.interval_join(o, o, "k", 60).where("o_orderkey < r_o_orderkey").select("k", F.col("o_orderkey").alias("a"), F.col("r_o_orderkey").alias("b"))


@R.query("price_as_of", "SELECT e.event_id, p.o_totalprice AS price FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2) p ON e.user_id = p.o_custkey AND e.ts >= p.o_orderdate")
def price_as_of(spark, d):
    """The price of the latest order before each event of the same customer."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")).agg(F.max("o_totalprice").alias("price"))
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return J.as_of(e, o, "user_id", "ts", "price", "p").select("event_id", F.col("p").alias("price"))


@R.query("glossary_hits", "WITH t AS (SELECT target, unnest(list_concat([source], coalesce(aliases, []))) AS t FROM glossary), k AS (SELECT lower(trim(t)) AS t, min(target) AS target FROM t WHERE t IS NOT NULL AND target IS NOT NULL AND trim(t) <> '' GROUP BY 1), w AS (SELECT entry_id, regexp_extract_all(lower(array_to_string(source, ' ')), '[a-z0-9]+') AS w FROM sentence_translations WHERE source IS NOT NULL), e AS (SELECT entry_id, unnest(w) AS t FROM w UNION ALL SELECT entry_id, w[i] || ' ' || w[i + 1] FROM (SELECT entry_id, w, unnest(range(1, len(w))) AS i FROM w)) SELECT entry_id AS id, target, count(*) AS n FROM e JOIN k USING (t) GROUP BY 1, 2")
def glossary_hits(spark, d):
    """Glossary terms in every entry's English side."""
    s = table(spark, d, "sentence_translations").where("source is not null").select("entry_id", F.concat_ws(" ", "source").alias("text"))
    return J.glossary_hits(s, table(spark, d, "glossary"), "entry_id", "text")


@R.query("views_pivoted", "SELECT author, title, count(*) FILTER (WHERE view_name = 'clean') AS clean, count(*) FILTER (WHERE view_name <> 'clean') AS other FROM records WHERE author IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2")
def views_pivoted(spark, d):
    """Records of every book by view."""
    r = table(spark, d, "records").where("author is not null and title is not null").select("author", "title", F.when(F.col("view_name") == "clean", "clean").when(F.col("view_name").isNotNull(), "other").alias("v"))
    n = r.groupBy("author", "title", "v").agg(F.count("*").alias("n"))
    p = J.pivot_views(n, ["author", "title"], "v", "n", ["clean", "other"])
    return p.select("author", "title", F.coalesce("clean", F.lit(0)).alias("clean"), F.coalesce("other", F.lit(0)).alias("other"))


@R.query("resolved_links", "WITH u AS (SELECT source_url AS url, min(chapter_id) AS page_id FROM chapters WHERE source_url IS NOT NULL AND source_url <> '' GROUP BY 1 HAVING count(*) = 1) SELECT chapter_id AS link_id, page_id FROM chapters JOIN u ON source_url = url")
def resolved_links(spark, d):
    """Links resolved where exactly one page has the URL."""
    c = table(spark, d, "chapters")
    return J.unique_url_targets(c.select(F.col("chapter_id").alias("link_id"), F.col("source_url").alias("url")), c.select(F.col("source_url").alias("url"), F.col("chapter_id").alias("page_id")))


CHANGES_SQL = """WITH base AS (SELECT chapter_id AS k, title AS p FROM chapters WHERE title IS NOT NULL),
ch AS (SELECT k, 1 AS op_index, 'replace' AS kind, CASE WHEN k % 3 = 0 THEN 'stale' ELSE sha256(p) END AS expected, p || '!' AS new FROM base WHERE k % 5 = 0
 UNION ALL SELECT k, 2, 'delete', sha256(p), NULL FROM base WHERE k % 35 = 0 UNION ALL SELECT k, 3, 'append', NULL, p FROM base WHERE k % 11 = 1 UNION ALL SELECT k + 1000000000, 4, 'append', NULL, 'new' FROM base WHERE k % 13 = 1),
n AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM ch),
r AS (SELECT n.k, op_index, kind, new, CASE WHEN n > 1 THEN 'refused: several changes' WHEN kind = 'append' AND base.k IS NOT NULL AND base.p IS NOT DISTINCT FROM new THEN 'repeated' WHEN kind = 'append' AND base.k IS NOT NULL THEN 'refused: exists' WHEN kind = 'append' THEN 'appended' WHEN base.k IS NULL THEN 'refused: missing' WHEN coalesce(sha256(base.p) = expected, false) = false THEN 'refused: changed' WHEN kind = 'replace' THEN 'replaced' WHEN kind = 'delete' THEN 'deleted' END AS outcome FROM n LEFT JOIN base USING (k))"""


def _changes(spark, d):
    base = table(spark, d, "chapters").where("title is not null").select(F.col("chapter_id").alias("k"), F.col("title").alias("p"))
    sha = F.sha2("p", 256)
    none = F.lit(None).cast("string")
    ch = (
        base.where("k % 5 = 0").select("k", F.lit(1).alias("op_index"), F.lit("replace").alias("kind"), F.when(F.col("k") % 3 == 0, "stale").otherwise(sha).alias("expected"), F.concat("p", F.lit("!")).alias("p"))
        .union(base.where("k % 35 = 0").select("k", F.lit(2), F.lit("delete"), sha, none))
        .union(base.where("k % 11 = 1").select("k", F.lit(3), F.lit("append"), none, "p"))
        .union(base.where("k % 13 = 1").select(F.col("k") + 1_000_000_000, F.lit(4), F.lit("append"), none, F.lit("new")))
    )
    return CH.apply_changes(base, ch, "k", "p")


@R.query("change_report", CHANGES_SQL + " SELECT k, op_index, kind, outcome FROM r")
def change_report(spark, d):
    """Outcome of every operation of a guarded change set."""
    return _changes(spark, d)[1]


@R.query("changed_titles", CHANGES_SQL + " SELECT k, p FROM base WHERE k NOT IN (SELECT k FROM r WHERE outcome IN ('replaced', 'deleted')) UNION ALL SELECT k, new FROM r WHERE outcome IN ('appended', 'replaced')")
def changed_titles(spark, d):
    """The titles after the change set."""
    return _changes(spark, d)[0]


@R.query("latest_deliveries", "SELECT book_id, title, chapter_id, collected_at FROM (SELECT *, row_number() OVER (PARTITION BY book_id, title ORDER BY collected_at DESC NULLS LAST, chapter_id DESC) AS k FROM chapters WHERE book_id IS NOT NULL AND title IS NOT NULL) WHERE k = 1")
def latest_deliveries(spark, d):
    """The latest delivery of every chapter of a book."""
    return CH.latest(table(spark, d, "chapters").where("book_id is not null and title is not null").select("book_id", "title", "chapter_id", "collected_at"), ["book_id", "title"], "collected_at", "chapter_id")


@R.query("refresh_plan", "WITH c AS (SELECT chapter_id AS id, collected_at AS was, collected_at + INTERVAL 40 SECOND AS seen FROM chapters WHERE chapter_id % 4 <> 0), n AS (SELECT chapter_id AS id, CASE WHEN chapter_id % 7 = 0 THEN collected_at + INTERVAL 1 HOUR ELSE collected_at END AS cur FROM chapters WHERE chapter_id % 6 <> 0) SELECT coalesce(c.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'drop' WHEN c.id IS NOT NULL AND was = cur AND date_trunc('minute', seen) > date_trunc('minute', was) THEN 'reuse' ELSE 'read' END AS action FROM c FULL JOIN n ON c.id = n.id")
def refresh_plan(spark, d):
    """Which cached chapters may be reused, which must be read again, which are gone."""
    ch = table(spark, d, "chapters").select(F.col("chapter_id").alias("id"), F.col("collected_at").alias("rev"))
    cache = ch.where("id % 4 <> 0").withColumn("seen", F.expr("rev + interval 40 seconds"))
    now = ch.where("id % 6 <> 0").withColumn("rev", F.when(F.col("id") % 7 == 0, F.expr("rev + interval 1 hour")).otherwise(F.col("rev")))
    return CH.refresh_plan(cache, now, "id", "rev", "seen")


@R.query("upserted_books", "WITH f AS (SELECT book_id, min(title) AS title FROM chapters WHERE book_id IS NOT NULL AND title IS NOT NULL AND role = 'extra' GROUP BY 1) SELECT book_id, title FROM books WHERE book_id NOT IN (SELECT book_id FROM f) UNION ALL SELECT book_id, title FROM f")
def upserted_books(spark, d):
    """Books with the first extra's title in place of their own."""
    f = table(spark, d, "chapters").where("book_id is not null and title is not null and role = 'extra'").select("book_id", "title")
    return CH.upsert(table(spark, d, "books").select("book_id", "title"), f, ["book_id"], [F.col("title")])


@R.query("hash_sample", "SELECT author, chunk_id FROM (SELECT author, chunk_id, row_number() OVER (PARTITION BY author ORDER BY sha256('s1:' || chunk_id), chunk_id) AS k FROM (SELECT DISTINCT author, chunk_id FROM records WHERE author IS NOT NULL)) WHERE k <= 2")
def hash_sample(spark, d):
    """Two records of every author with the least salted hash."""
    return SP.first_by_hash(table(spark, d, "records").where("author is not null").select("author", "chunk_id").distinct(), ["author"], "chunk_id", "s1", 2)


@R.query("side_orders", "SELECT chunk_id, CASE WHEN ('0x' || substr(sha256('7:r1:' || chunk_id), 1, 2))::INTEGER % 2 = 0 THEN 'style_first' ELSE 'control_first' END AS side, 's_' || substr(sha256('7:main:' || chunk_id), 1, 24) AS opaque FROM (SELECT DISTINCT chunk_id FROM records WHERE chunk_id IS NOT NULL)")
def side_orders(spark, d):
    """Side and opaque id of every record by hash."""
    r = table(spark, d, "records").where("chunk_id is not null").select("chunk_id").distinct()
    return r.select("chunk_id", SP.side_order(F.col("chunk_id"), "r1", 7).alias("side"), X.opaque_id("chunk_id", 7, "main").alias("opaque"))


@R.query("spaced_rows", "WITH r AS (SELECT DISTINCT author, title, chunk_index FROM records WHERE author IS NOT NULL AND title IS NOT NULL), t AS (SELECT author, title, chunk_index AS i FROM r WHERE chunk_index % 10 = 0) SELECT author, title, chunk_index FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.author = r.author AND t.title = r.title AND abs(t.i - r.chunk_index) <= 2)")
def spaced_rows(spark, d):
    """Chunks farther than two from every tenth."""
    r = table(spark, d, "records").where("author is not null and title is not null").select("author", "title", "chunk_index").distinct()
    return SP.spaced(r, ["author", "title"], "chunk_index", r.where("chunk_index % 10 = 0"), 2).select("author", "title", "chunk_index")


@R.query("round_robin", "SELECT author, chunk_id FROM (SELECT author, chunk_id, row_number() OVER (PARTITION BY author ORDER BY chunk_id) AS k FROM (SELECT DISTINCT author, chunk_id FROM records WHERE author IS NOT NULL)) ORDER BY k, author LIMIT 100")
def round_robin(spark, d):
    """A hundred records taken in turn from the authors."""
    return SP.round_robin(table(spark, d, "records").where("author is not null").select("author", "chunk_id").distinct(), "author", ["chunk_id"], 100)


@R.query("roles_kept", SPLIT_SQL + ", now AS (SELECT author, title, units, CASE WHEN n < 3 THEN 'excluded' WHEN k = 1 THEN 'test' WHEN k = 2 THEN 'dev' ELSE 'train' END AS role FROM r), was AS (SELECT author, title, CASE WHEN units % 2 = 0 THEN 'train' ELSE 'dev' END AS role FROM b WHERE units % 5 <> 0) SELECT author, title, units, CASE WHEN now.role = 'excluded' THEN 'excluded' WHEN was.role IS NULL THEN CASE WHEN now.role = 'train' THEN 'train' ELSE 'excluded' END ELSE was.role END AS role FROM now LEFT JOIN was USING (author, title)")
def roles_kept(spark, d):
    """Split roles that keep earlier assignments."""
    books = SP.book_units(table(spark, d, "records"))
    was = books.where("units % 5 <> 0").select("author", "title", F.when(F.col("units") % 2 == 0, "train").otherwise("dev").alias("role"))
    return SP.keep_roles(SP.split_books(books), was)
