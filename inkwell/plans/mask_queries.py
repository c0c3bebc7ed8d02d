"""Queries: mask terms, masking, chunks and ordered sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import corpus as C, masking as M, sequences as S
from inkwell.plans.corpus_queries import BOOK_LINES, han
from inkwell.plans.registry import Registry, table

R = Registry()


def grams_sql(run: str, sizes: tuple[int, ...]) -> str:
    return " UNION ALL ".join(f"SELECT author, title, substr({run}, i, {k}) AS term FROM (SELECT author, title, {run}, unnest(range(1, length({run}) - {k} + 2)) AS i FROM runs WHERE length({run}) >= {k})" for k in sizes)


TRAIN = "split = 'train' AND author IS NOT NULL AND title IS NOT NULL"
CANDIDATES_SQL = f"""WITH runs AS (SELECT author, title, unnest(regexp_extract_all(regexp_replace(text, '[{M.STOP}]', ' ', 'g'), '[一-鿿]{{2,}}')) AS run FROM records WHERE {TRAIN}),
per AS (SELECT author, title, term, count(*) AS n FROM ({grams_sql('run', (2, 3, 4, 5))}) WHERE len(list_distinct(string_split(term, ''))) > 1 GROUP BY 1, 2, 3)"""


def _train(spark, d):
    return table(spark, d, "records").where("split = 'train' and author is not null and title is not null")


@R.query("mask_candidates", CANDIDATES_SQL + " SELECT author, title, count(*) AS terms, sum(n)::BIGINT AS occurrences FROM per GROUP BY 1, 2")
def mask_candidates(spark, d):
    """Candidate terms per book of the training split."""
    return M.candidates(_train(spark, d), ["author", "title"], "text").groupBy("author", "title").agg(F.count("*").alias("terms"), F.sum("n").alias("occurrences"))


@R.query(
    "mask_terms",
    CANDIDATES_SQL + f""", g AS (SELECT term, sum(n)::BIGINT AS freq, count(*) AS books, count(DISTINCT author) AS authors FROM per WHERE n >= 4 GROUP BY term),
    most AS (SELECT greatest(3, floor(count(*) / 20)) AS most FROM (SELECT DISTINCT author, title FROM records WHERE {TRAIN} AND text IS NOT NULL))
    SELECT term, freq, books, authors, row_number() OVER (ORDER BY freq * length(term) / greatest(authors, 1) DESC, length(term) DESC, term) AS rank FROM g, most WHERE books <= most OR authors <= 1 ORDER BY rank LIMIT {M.MAX_TERMS}""",
)
def mask_terms(spark, d):
    """Global mask vocabulary fitted on the training split."""
    return M.global_terms(_train(spark, d))


RESCUE_SQL = f"""WITH runs AS (SELECT author, title, unnest(regexp_extract_all(text, '[一-鿿]{{2,}}')) AS run FROM records WHERE {TRAIN}),
per AS (SELECT author, title, term, count(*) AS n FROM ({grams_sql('run', (2, 3))}) WHERE len(list_distinct(string_split(term, ''))) > 1 AND regexp_matches(term, '[{M.STOP}]') AND NOT regexp_matches(term, '^[{M.EDGE}]|[{M.EDGE}]$') GROUP BY 1, 2, 3),
g AS (SELECT term, sum(n)::BIGINT AS freq, max(n) AS top, count(*) AS books, count(DISTINCT author) AS authors, max(ROW(n, author, title)) AS owner FROM per WHERE term IN (SELECT term FROM per WHERE n >= 8) GROUP BY term),
kept AS (SELECT * FROM g WHERE top / freq >= 0.8 AND (books <= 4 AND authors <= 2 OR top / freq >= 0.95 AND top >= 100)),
chars AS (SELECT author, title, c, count(*) AS m FROM (SELECT author, title, unnest(string_split(regexp_replace(text, '[^一-鿿]', '', 'g'), '')) AS c FROM records WHERE {TRAIN}) WHERE c <> '' GROUP BY 1, 2, 3),
part AS (SELECT k.term, max(k.top / chars.m) AS part FROM (SELECT term, top, owner[2] AS author, owner[3] AS title, unnest(string_split(term, '')) AS c FROM kept WHERE length(term) = 2) k JOIN chars USING (author, title, c) GROUP BY 1)
SELECT term, freq, top, books, authors FROM kept LEFT JOIN part USING (term) WHERE length(term) <> 2 OR part >= 0.5 ORDER BY freq * length(term) DESC, length(term) DESC, term LIMIT {M.MAX_RESCUED}"""


@R.query("mask_rescued", RESCUE_SQL)
def mask_rescued(spark, d):
    """Terms with stop characters that one book owns."""
    return M.rescued_terms(_train(spark, d), min_in_book=8)


@R.query("records_masked")
def records_masked(spark, d):
    """All records with the canonical global terms masked, length kept: digest and masked characters."""
    terms = M.global_terms(_train(spark, d)).select("term", "freq").collect()  # at most MAX_TERMS rows
    counts = {r["term"]: r["freq"] for r in terms}
    out = M.masked(table(spark, d, "records"), "chunk_id", F.col("text"), M.canonical_terms(set(counts), counts))
    return out.select("id", F.sha2("text", 256).alias("sha256"), F.coalesce(F.regexp_count("text", F.lit("某")), F.lit(0)).cast("long").alias("masked"))


@R.query("mask_density", f"SELECT coalesce(split, '-') AS split, coalesce(view_name, '-') AS view_name, grouping(split, view_name)::BIGINT AS level, count(*) AS chunks, sum({han('text')})::BIGINT AS han, coalesce(sum(length(text) - length(replace(text, '某', ''))), 0)::BIGINT AS masked, coalesce(sum(length(text) - length(replace(text, '某', ''))) / nullif(sum({han('text')}), 0) * 1000, 0) AS per_1k FROM records GROUP BY CUBE (split, view_name)")
def mask_density(spark, d):
    """Masked characters per mille by split and view, with subtotals."""
    g = M.mask_density(table(spark, d, "records"), ["split", "view_name"], "text")
    return g.select(F.coalesce("split", F.lit("-")).alias("split"), F.coalesce("view_name", F.lit("-")).alias("view_name"), "level", "chunks", "han", "masked", "per_1k")


@R.query("doc_chunks")
def doc_chunks(spark, d):
    """Documents cut into chunks of about 1,500 Han characters, by digest."""
    docs = table(spark, d, "documents")
    return S.chunks(docs, "doc_id", X.lines("text")).select("id", "chunk_no", "first", "stop", "han", F.sha2("text", 256).alias("sha256"))


@R.query("book_blocks", f"WITH {BOOK_LINES} SELECT book, block, count(*) AS lines, sum({han('line')})::BIGINT AS han FROM (SELECT *, floor((row_number() OVER (PARTITION BY book ORDER BY pos) - 1) / 20)::BIGINT AS block FROM lines) GROUP BY 1, 2")
def book_blocks(spark, d):
    """Blocks of twenty paragraphs."""
    b = S.fixed_blocks(C.book_lines(table(spark, d, "chapters")), ["book"], ["pos"], 20)
    return b.groupBy("book", "block").agg(F.count("*").alias("lines"), F.sum(X.han_count("line")).alias("han"))


@R.query("paragraph_windows", f"WITH {BOOK_LINES} SELECT book, pos, n0 + n1 + n2 AS han FROM (SELECT book, pos, {han('line')} AS n0, lead({han('line')}, 1) OVER w AS n1, lead({han('line')}, 2) OVER w AS n2 FROM lines WINDOW w AS (PARTITION BY book ORDER BY pos)) WHERE n2 IS NOT NULL AND n0 + n1 + n2 BETWEEN 120 AND 520")
def paragraph_windows(spark, d):
    """Windows of three paragraphs with 120 to 520 Han characters."""
    lines = C.book_lines(table(spark, d, "chapters")).select("book", "pos", X.han_count("line").alias("n"))
    w = S.sliding(lines, ["book"], ["pos"], "n", 3)
    return w.select("book", "pos", F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x).alias("han")).where("han between 120 and 520")


KIND = """CASE WHEN regexp_matches(line, '^[“"「『]') THEN 'dialogue' WHEN regexp_matches(line, '[？?]$') THEN 'question' WHEN regexp_matches(substr(line, 1, 18), '说|道|问|答|喊|叫|笑') THEN 'attribution_open' ELSE 'narration' END"""


@R.query("dialogue_runs", f"WITH {BOOK_LINES}, k AS (SELECT book, pos, {KIND} AS kind FROM lines), c AS (SELECT *, row_number() OVER w AS rn, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM k WINDOW w AS (PARTITION BY book ORDER BY pos)), r AS (SELECT *, sum(ch) OVER (PARTITION BY book ORDER BY pos) AS run_no FROM c) SELECT book, run_no::BIGINT AS run_no, min(kind) AS value, min(rn) AS first, max(rn) AS last, count(*) AS length FROM r GROUP BY book, run_no")
def dialogue_runs(spark, d):
    """Runs of paragraphs of one kind."""
    k = C.book_lines(table(spark, d, "chapters")).select("book", "pos", X.paragraph_kind("line").alias("kind"))
    return S.runs(k, ["book"], ["pos"], "kind")


@R.query("kind_transitions", f"WITH {BOOK_LINES}, k AS (SELECT book, pos, {KIND} AS kind FROM lines) SELECT kind AS source, nxt AS target, count(*) AS n FROM (SELECT kind, lead(kind) OVER (PARTITION BY book ORDER BY pos) AS nxt FROM k) WHERE nxt IS NOT NULL GROUP BY 1, 2")
def kind_transitions(spark, d):
    """Which kind of paragraph follows which."""
    return S.transitions(C.book_lines(table(spark, d, "chapters")).select("book", "pos", X.paragraph_kind("line").alias("kind")), ["book"], ["pos"], "kind")


@R.query("chapter_sequence", """WITH n AS (SELECT book_id, chapter_id, TRY_CAST(nullif(regexp_extract(title, '^(?:第|Chapter |Ch\\. )?0*([0-9]{1,6})', 1), '') AS INTEGER) AS number FROM chapters WHERE book_id IS NOT NULL),
f AS (SELECT *, lag(number) OVER (PARTITION BY book_id ORDER BY chapter_id) AS prev, count(*) OVER (PARTITION BY book_id, number) AS same FROM n WHERE number IS NOT NULL)
SELECT book_id, chapter_id, number, CASE WHEN same > 1 THEN 'duplicate' WHEN number - prev <= 0 THEN 'order' ELSE 'gap' END AS finding FROM f WHERE same > 1 OR prev IS NOT NULL AND (number - prev <= 0 OR number - prev - 1 > 0)""")
def chapter_sequence(spark, d):
    """Duplicate, missing and misplaced chapter numbers."""
    n = F.regexp_extract("title", "^(?:第|Chapter |Ch\\. )?0*([0-9]{1,6})", 1)
    c = table(spark, d, "chapters").where("book_id is not null").select("book_id", "chapter_id", F.when(n != "", n.cast("int")).alias("number"))
    return S.sequence_findings(c, "book_id", "chapter_id", "number")


@R.query("role_filled", "SELECT chapter_id, last_value(role IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY chapter_id ROWS UNBOUNDED PRECEDING) AS role FROM chapters WHERE book_id IS NOT NULL")
def role_filled(spark, d):
    """Chapter roles, missing ones taken from the chapter before."""
    c = table(spark, d, "chapters").where("book_id is not null").select("book_id", "chapter_id", "role")
    return S.forward_fill(c, ["book_id"], ["chapter_id"], "role", "filled").select("chapter_id", F.col("filled").alias("role"))


@R.query("chapter_context", "SELECT chapter_id, list(chapter_id) OVER (PARTITION BY book_id ORDER BY chapter_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before, list(chapter_id) OVER (PARTITION BY book_id ORDER BY chapter_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS behind FROM chapters WHERE book_id IS NOT NULL")
def chapter_context(spark, d):
    """The two chapters before and behind every chapter."""
    c = table(spark, d, "chapters").where("book_id is not null").select("book_id", "chapter_id")
    w = S.context(c, ["book_id"], ["chapter_id"], "chapter_id", 2, 2)
    empty = lambda x: F.when(F.size(x) > 0, F.col(x)).alias(x)
    return w.select("chapter_id", empty("before"), empty("behind"))


@R.query("event_sessions", "WITH s AS (SELECT user_id, ts, sum(CASE WHEN ts - prev <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) SELECT user_id, session::BIGINT AS session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2")
def event_sessions(spark, d):
    """Sessions of events with gaps of at most thirty minutes."""
    s = S.sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", 1800)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
