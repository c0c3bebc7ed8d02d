"""Queries: cleaning, flags, duplicates, splits over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from inkwell.functions import text as X
from inkwell.operators import corpus as C
from inkwell.plans.registry import Registry, table

R = Registry()

HAN_SQL = "length(regexp_replace({c}, '[^一-鿿]', '', 'g'))"
WS = "[ \\t\\n\\r\\x0B\\f\\x{3000}\\x{a0}]+"
BP = X.BOILERPLATE


def han(c: str) -> str:
    return HAN_SQL.format(c=c)


def tidy_sql(c: str) -> str:
    ws = "[ \\t\\x0B\\f\\x{3000}\\x{a0}]*"
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '{ws}\\n{ws}', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}|{WS}$', '', 'g')"


BOOK_LINES = f"""
raw_lines AS (
  SELECT book_id, chapter_id, k, regexp_replace(paragraphs[k], '^{WS}|{WS}$', '', 'g') AS line
  FROM (SELECT book_id, chapter_id, paragraphs, unnest(range(1, len(paragraphs) + 1)) AS k FROM chapters WHERE book_id IS NOT NULL AND len(paragraphs) > 0)
),
lines AS (
  SELECT book_id AS book, row_number() OVER (PARTITION BY book_id ORDER BY chapter_id, k) - 1 AS pos, line FROM raw_lines WHERE line IS NOT NULL AND line <> ''
)"""


@R.query("doc_counts", f"SELECT doc_id, {han('text')} AS han, length(text) AS chars, coalesce(length(text) = n_chars, false) AS agrees FROM documents")
def doc_counts(spark, d):
    """Han characters and code points per document, and whether the stored length agrees."""
    return table(spark, d, "documents").select("doc_id", X.han_count("text").alias("han"), F.length("text").cast("long").alias("chars"), F.coalesce(F.length("text") == F.col("n_chars"), F.lit(False)).alias("agrees"))


@R.query("doc_lines", f"SELECT doc_id, sha256({tidy_sql('text')}) AS tidy_sha, CASE WHEN text IS NULL THEN NULL WHEN {tidy_sql('text')} = '' THEN 0 ELSE len(string_split({tidy_sql('text')}, chr(10))) END AS n_lines FROM documents")
def doc_lines(spark, d):
    """Line-normalised text by digest, and its number of lines."""
    return table(spark, d, "documents").select("doc_id", F.sha2(X.tidy("text"), 256).alias("tidy_sha"), F.when(F.col("text").isNotNull(), F.size(X.lines("text")).cast("long")).alias("n_lines"))


@R.query(
    "doc_forms",
    """SELECT doc_id, translate(text, '%s', '%s') AS half,
      regexp_replace(regexp_replace(text, '，{2,}', '，', 'g'), '，([。！？])', '\\1', 'g') AS commas,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^““', '“'), '：““', '：“', 'g'), '””$', '”'), '([。！？])““', '\\1”“', 'g') AS quotes
    FROM documents"""
    % (X.FULL, X.HALF),
)
def doc_forms(spark, d):
    """Half-width letters, squeezed commas, repaired quotes."""
    return table(spark, d, "documents").select("doc_id", X.half_width("text").alias("half"), X.squeeze_commas("text").alias("commas"), X.fix_doubled_quotes("text").alias("quotes"))


@R.query(
    "doc_views",
    f"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z][A-Za-z0-9_''-]*', '<LATIN>', 'g'), '[0-9]+([.,:/-][0-9]+)*', '<NUM>', 'g'), '<+(CONTENT|NUM|LATIN)>+', '<\\1>', 'g') AS t FROM documents)
    SELECT doc_id, sha256(t) AS latin_num, sha256(regexp_replace(t, '[一-鿿]', '文', 'g')) AS structure,
      sha256(array_to_string(list_transform(string_split(t, ''), lambda x: CASE WHEN x BETWEEN '一' AND '鿿' AND position(x IN '{X.FUNCTION_CHARS}') = 0 THEN '文' ELSE x END), '')) AS topic FROM p""",
)
def doc_views(spark, d):
    """Views of each document with content hidden, by digest: placeholders, structure only, topic distorted."""
    return table(spark, d, "documents").select("doc_id", F.sha2(X.placeholders("text"), 256).alias("latin_num"), F.sha2(X.structure_only("text"), 256).alias("structure"), F.sha2(X.topic_distorted("text"), 256).alias("topic"))


FLAGS_SQL = f"""WITH t AS (SELECT doc_id, text AS raw, {tidy_sql('text')} AS clean FROM documents),
n AS (SELECT *, {han('clean')} AS n, {han('raw')} AS m FROM t)
SELECT doc_id, CASE WHEN raw IS NULL THEN 'missing_txt' ELSE array_to_string(list_filter([
  CASE WHEN n < 50000 THEN 'too_short_for_primary_benchmark' END, CASE WHEN n >= 50000 AND n < 120000 THEN 'short_text' END,
  CASE WHEN m > 0 AND n / m < 0.75 THEN 'large_header_or_nonbody_drop' END,
  CASE WHEN regexp_matches(raw, 'https?://|www\\.|\\.com|\\.net|\\.org', 'i') THEN 'raw_url_or_domain_text' END,
  CASE WHEN regexp_matches(clean, 'https?://|www\\.|\\.com|\\.net|\\.org', 'i') THEN 'clean_url_or_domain_text' END,
  CASE WHEN regexp_matches(raw, '{BP}') THEN 'raw_boilerplate_signal' END, CASE WHEN regexp_matches(clean, '{BP}') THEN 'clean_boilerplate_signal' END,
  CASE WHEN list_count(list_filter(range(2, len(string_split(clean, chr(10))) + 1), lambda i: string_split(clean, chr(10))[i] = string_split(clean, chr(10))[i - 1] AND string_split(clean, chr(10))[i] <> '')) > 0 THEN 'adjacent_duplicate_lines' END,
  CASE WHEN contains(raw, '作者有话要说') OR contains(raw, '作者的话') THEN 'raw_author_notes_present' END,
  CASE WHEN contains(clean, '作者有话要说') OR contains(clean, '作者的话') THEN 'clean_author_notes_present' END,
  CASE WHEN regexp_matches(raw, '[A-Za-z]{{30,}}') THEN 'long_latin_span' END, CASE WHEN contains(raw, chr(65533)) THEN 'raw_unicode_replacement_char' END,
  CASE WHEN regexp_matches(clean, '€{{2,}}') THEN 'clean_replacement_artifacts' END,
  CASE WHEN len(regexp_extract_all(clean, '€{{2,}}')) >= 10 THEN 'systemic_encoding_corruption' END], lambda x: x IS NOT NULL), ',') END AS flags, n AS han FROM n"""


@R.query("doc_flags", FLAGS_SQL)
def doc_flags(spark, d):
    """Quality flags of every document."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("raw"), X.tidy("text").alias("clean"))
    return docs.select("doc_id", F.array_join(C.quality_flags(F.col("raw"), F.col("clean")), ",").alias("flags"), X.han_count("clean").alias("han"))


@R.query("doc_flag_counts", f"WITH f AS ({FLAGS_SQL}) SELECT flag, count(*) AS documents, sum(han)::BIGINT AS han FROM (SELECT unnest(string_split(flags, ',')) AS flag, han FROM f WHERE flags <> '') GROUP BY flag")
def doc_flag_counts(spark, d):
    """Histogram of quality flags."""
    docs = table(spark, d, "documents").select(F.col("text").alias("raw"), X.tidy("text").alias("clean"))
    return docs.select(F.explode(C.quality_flags(F.col("raw"), F.col("clean"))).alias("flag"), X.han_count("clean").alias("han")).groupBy("flag").agg(F.count("*").alias("documents"), F.sum("han").alias("han"))


@R.query("exact_duplicates", "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    """Documents with equal texts."""
    return C.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


PASSAGE_SQL = f"""WITH {BOOK_LINES},
h AS (SELECT book, pos, sha256(regexp_replace(line, '{WS}', '', 'g')) AS h, {han('line')} AS n FROM lines),
a AS (SELECT book, pos, h AS h0, n AS n0, lead(h, 1) OVER w AS h1, lead(n, 1) OVER w AS n1, lead(h, 2) OVER w AS h2, lead(n, 2) OVER w AS n2 FROM h WINDOW w AS (PARTITION BY book ORDER BY pos)),
windows AS (
  SELECT book, pos, 1 AS size, sha256(h0) AS fp, n0 AS han FROM a WHERE n0 >= 80
  UNION ALL SELECT book, pos, 2, sha256(h0 || chr(10) || h1), n0 + n1 FROM a WHERE h1 IS NOT NULL AND n0 + n1 >= 100
  UNION ALL SELECT book, pos, 3, sha256(h0 || chr(10) || h1 || chr(10) || h2), n0 + n1 + n2 FROM a WHERE h2 IS NOT NULL AND n0 + n1 + n2 >= 120),
shared AS (SELECT fp, size, count(*) AS occurrences, count(DISTINCT book) AS books FROM windows GROUP BY fp, size HAVING count(DISTINCT book) >= 2)"""


@R.query("cross_book_passages", PASSAGE_SQL + " SELECT fp, size, occurrences, books FROM shared")
def cross_book_passages(spark, d):
    """Passages of one to three lines that several books hold."""
    return C.shared_passages(C.passages(C.book_lines(table(spark, d, "chapters"))))


@R.query("cross_book_marked", PASSAGE_SQL + " SELECT DISTINCT book, pos + i AS pos FROM (SELECT book, pos, unnest(range(0, size)) AS i FROM windows JOIN shared USING (fp, size))")
def cross_book_marked(spark, d):
    """Lines that such passages cover."""
    return C.marked_lines(C.book_lines(table(spark, d, "chapters")))


@R.query(
    "cross_book_cleaned",
    PASSAGE_SQL + f""", marked AS (SELECT DISTINCT book, pos + i AS pos FROM (SELECT book, pos, unnest(range(0, size)) AS i FROM windows JOIN shared USING (fp, size)))
    SELECT book, count(*) AS lines_left, sum({han('line')})::BIGINT AS han_left FROM lines l WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.book = l.book AND m.pos = l.pos) GROUP BY book""",
)
def cross_book_cleaned(spark, d):
    """Per book what is left after decontamination."""
    return C.decontaminated(C.book_lines(table(spark, d, "chapters"))).groupBy("book").agg(F.count("*").alias("lines_left"), F.sum(X.han_count("line")).alias("han_left"))


@R.query("adjacent_duplicate_lines", f"WITH {BOOK_LINES} SELECT book, sum(CASE WHEN line = prev AND line <> '' THEN 1 ELSE 0 END)::BIGINT AS duplicates FROM (SELECT book, line, lag(line) OVER (PARTITION BY book ORDER BY pos) AS prev FROM lines) GROUP BY book")
def adjacent_duplicate_lines(spark, d):
    """Per book how many paragraphs repeat the one before."""
    return C.adjacent_duplicates(C.book_lines(table(spark, d, "chapters")))


@R.query("heading_kinds", "SELECT chapter_id, CASE WHEN regexp_matches(title, '番外|外传|外傳|特典') THEN 'extra' WHEN regexp_matches(title, '后记|後記') THEN 'afterword' WHEN regexp_matches(title, '简介|簡介|文案') THEN 'synopsis' WHEN title IS NOT NULL THEN '' END AS kind FROM chapters")
def heading_kinds(spark, d):
    """What kind of section a chapter title opens."""
    return table(spark, d, "chapters").select("chapter_id", X.section_kind("title").alias("kind"))


@R.query(
    "paragraph_kinds",
    f"""SELECT kind, count(*) AS paragraphs, sum({han('p')})::BIGINT AS han FROM (
      SELECT p, CASE WHEN s = '' THEN 'empty' WHEN regexp_matches(s, '^[“"「『]') THEN 'dialogue' WHEN regexp_matches(s, '[？?]$') THEN 'question'
        WHEN regexp_matches(substr(s, 1, 18), '说|道|问|答|喊|叫|笑') THEN 'attribution_open' WHEN s IS NOT NULL THEN 'narration' END AS kind
      FROM (SELECT p, regexp_replace(p, '^{WS}|{WS}$', '', 'g') AS s FROM (SELECT unnest(paragraphs) AS p FROM chapters))) GROUP BY kind""",
)
def paragraph_kinds(spark, d):
    """How many paragraphs of which kind there are."""
    p = table(spark, d, "chapters").select(F.explode("paragraphs").alias("p"))
    return p.groupBy(X.paragraph_kind("p").alias("kind")).agg(F.count("*").alias("paragraphs"), F.sum(X.han_count("p")).alias("han"))


@R.query("scene_breaks", f"SELECT chapter_id, k - 1 AS para_no FROM (SELECT chapter_id, paragraphs[k] AS p, k FROM (SELECT chapter_id, paragraphs, unnest(range(1, len(paragraphs) + 1)) AS k FROM chapters)) WHERE regexp_matches(regexp_replace(p, '^{WS}|{WS}$', '', 'g'), '^(\\*{{3,}}|\\*( \\*){{2,}}|[-—–―─]{{2,}})$')")
def scene_breaks(spark, d):
    """Paragraphs that are scene breaks or separators."""
    p = table(spark, d, "chapters").select("chapter_id", F.posexplode("paragraphs").alias("k", "p"))
    return p.where(X.is_scene_break("p") | X.is_separator("p")).select("chapter_id", F.col("k").cast("long").alias("para_no"))


SPLIT_SQL = """WITH b AS (SELECT author, title, sum(chunk_clean_units)::BIGINT AS units FROM records WHERE author IS NOT NULL AND title IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY units DESC, title) AS k, count(*) OVER (PARTITION BY author) AS n FROM b)"""


@R.query("book_split", SPLIT_SQL + " SELECT author, title, units, CASE WHEN n < 3 THEN 'excluded' WHEN k = 1 THEN 'test' WHEN k = 2 THEN 'dev' ELSE 'train' END AS role FROM r")
def book_split(spark, d):
    """Book-level split by size rank within the author: largest to test, next to dev, rest to train; authors with fewer than three books are left out."""
    from inkwell.operators.splits import book_units, split_books

    return split_books(book_units(table(spark, d, "records")))


@R.query("author_table", "SELECT author, count(DISTINCT title) AS books, count(*) AS chunks, sum(chunk_clean_units)::BIGINT AS units, max(chunk_clean_units) AS longest FROM records WHERE author IS NOT NULL GROUP BY author")
def author_table(spark, d):
    """Corpus summary per author."""
    return table(spark, d, "records").where("author is not null").groupBy("author").agg(F.countDistinct("title").alias("books"), F.count("*").alias("chunks"), F.sum("chunk_clean_units").alias("units"), F.max("chunk_clean_units").alias("longest"))


@R.query("corpus_cube", "SELECT coalesce(split, '-') AS split, coalesce(view_name, '-') AS view_name, grouping(split, view_name)::BIGINT AS level, count(*) AS chunks, sum(chunk_clean_units)::BIGINT AS units FROM records GROUP BY CUBE (split, view_name)")
def corpus_cube(spark, d):
    """Chunks and units by split and view, with all subtotals."""
    return table(spark, d, "records").cube("split", "view_name").agg(F.grouping_id().alias("level"), F.count("*").alias("chunks"), F.sum("chunk_clean_units").alias("units")).select(F.coalesce("split", F.lit("-")).alias("split"), F.coalesce("view_name", F.lit("-")).alias("view_name"), "level", "chunks", "units")


@R.query("chunk_positions", "SELECT author, title, bucket, count(*) AS chunks FROM (SELECT author, title, CASE WHEN r <= 0.10 THEN 'opening' WHEN r <= 0.33 THEN 'early' WHEN r <= 0.67 THEN 'middle' WHEN r <= 0.90 THEN 'late' WHEN r IS NOT NULL THEN 'ending' END AS bucket FROM (SELECT author, title, chunk_index / greatest(max(chunk_index) OVER (PARTITION BY author, title), 1) AS r FROM records WHERE author IS NOT NULL AND title IS NOT NULL)) GROUP BY 1, 2, 3")
def chunk_positions(spark, d):
    """Chunks of every book by position."""
    r = table(spark, d, "records").where("author is not null and title is not null")
    b = X.position_bucket(F.col("chunk_index"), F.max("chunk_index").over(W.partitionBy("author", "title")))
    return r.select("author", "title", b.alias("bucket")).groupBy("author", "title", "bucket").agg(F.count("*").alias("chunks"))
