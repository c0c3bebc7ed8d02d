"""Long exact spans shared between records.

Method: sliding sentence spans. Every start of a sentence is an anchor, and the
run of consecutive sentences that starts there, cut after SPAN code points, is
hashed and joined globally. Where a stretch without sentence ends is longer
than GAP, further anchors are chosen inside it by the least hash of K code
points in every window of WINDOW of them, so that the choice depends on nearby
text only.

Why nothing is lost: two texts that share a run of MIN_RUN code points agree on
every anchor at the offsets 1 to GAP of the run, and there is one. If no
sentence starts there, both texts have a stretch longer than GAP around it, and
a whole window of K + WINDOW - 1 <= GAP code points lies inside the run. The
span of that anchor ends at GAP + SPAN <= MIN_RUN - 10 at the latest. Whether a
shared span lies in a run of MIN_RUN is then decided on the texts themselves,
SIDE code points to either side.

Groups of equal texts are reduced to one text first. Spans with many owners are
never paired: they are split into the SIDE + 1 places where a window of MIN_RUN
code points around them may begin, and only equal windows meet. Of the windows
that two owners have in common only the last gives the pair, and a window of
many owners is dealt over as many tasks as they ask for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from inkwell.functions.arrow import arrow_schema, as_batch, grouped_rows, map_rows
from inkwell.session import cut

MIN_RUN = 200
SPAN = 120
GAP = 70
K, WINDOW = 8, 60
SIDE = MIN_RUN - SPAN
#: Owners of one span that are compared one by one; groups above go by equal windows.
SMALL_GROUP = 48
#: Owners of one window that one task pairs; larger windows are salted.
PAIRED = 1_000

_ENDS = re.compile("[。！？!?….；;\n\r”’」』\"')）】》]+")


def joined_text(paragraphs: str = "paragraphs") -> F.Column:
    """The text of a record: its non-null paragraphs joined by line feeds."""
    return F.array_join(F.col(paragraphs), "\n")


def anchors(text: str) -> list[int]:
    """Positions where a span starts, ascending."""
    cuts = [m.end() for m in _ENDS.finditer(text)]
    n = len(text)
    if not cuts or cuts[-1] != n:
        cuts.append(n)
    out, last = [], 0
    for c in cuts:
        if c - last > GAP:
            out.extend(_inner(text, last, c))
        if c < n:
            out.append(c)
        last = c
    return sorted(set(out))


def _inner(text: str, start: int, end: int) -> list[int]:
    """Anchors inside a long stretch: the last least hash of every window."""
    points = np.frombuffer(text[start:end].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    grams = len(points) - K + 1
    if grams < WINDOW:
        return []
    h = np.zeros(grams, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(K):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[i : i + grams]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    picked: set[int] = set()
    for lo in range(0, grams - WINDOW + 1, 50_000):  # in blocks, for very long stretches
        view = np.lib.stride_tricks.sliding_window_view(h[lo : lo + 50_000 + WINDOW - 1], WINDOW)
        last = WINDOW - 1 - np.argmin(view[:, ::-1], axis=1)
        picked.update((np.unique(np.arange(len(view)) + last) + lo).tolist())
    return [start + p for p in picked]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash(s: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")))


def _spans(cols: dict[str, list]) -> Iterator[tuple]:
    for i, text in zip(cols["id"], cols["text"]):
        if text is None or len(text) < MIN_RUN:
            continue
        at = [p for p in anchors(text) if p + SPAN <= len(text)]
        d = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
        yield i, _signed(d >> 64), _signed(d & (1 << 64) - 1), len(text), [_hash(text[p : p + SPAN]) for p in at], at


def distinct_texts(df: DataFrame, id_col: str, text: F.Column) -> tuple[DataFrame, DataFrame]:
    """(classes, members): one row per distinct text of MIN_RUN code points or more with its spans, and every row's class.

    classes: class_id (least id), n_chars, fps, places; members: id, class_id."""
    base = df.select(F.col(id_col).alias("id"), text.alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= MIN_RUN))
    spans = cut(map_rows(base, _spans, "id long, h1 long, h2 long, n_chars int, fps array<long>, places array<int>", 500))
    least = spans.groupBy("h1", "h2").agg(F.min("id").alias("class_id"))
    members = spans.select("id", "h1", "h2").join(least, ["h1", "h2"]).select("id", "class_id")
    classes = spans.join(least, ["h1", "h2"]).where("id = class_id").select("class_id", "n_chars", "fps", "places")
    return classes, members


def _with_context(cols: dict[str, list]) -> Iterator[tuple]:
    for c, text, hits in zip(cols["class_id"], cols["text"], cols["hits"]):
        before = None
        for h in sorted(hits, key=lambda h: h["at"]):
            p = h["at"]
            near = before is not None and p - before["at"] <= SPAN  # touching spans lie in one run
            yield h["fp"], h["n"], c, p, before["fp"] if near else None, p - before["at"] if near else None, text[max(0, p - SIDE) : p], text[p + SPAN : p + MIN_RUN]
            before = h


def occurrences(df: DataFrame, id_col: str, text: F.Column, classes: DataFrame) -> DataFrame:
    """Places of spans that several classes have, with the text SIDE code points before and behind, and the repeated span that touches from the left.

    One shuffle of (span, class, place) serves the count and the join: both read the
    same columns of it, so that it is reused."""
    each = classes.select("class_id", F.explode(F.arrays_zip("fps", "places")).alias("s")).select("class_id", F.col("s.fps").alias("fp"), F.col("s.places").alias("at")).repartition("fp")
    twice = each.groupBy("fp").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b"), F.count("*").alias("n"), F.max("at").alias("last")).where("a < b and last >= 0").select("fp", F.col("n").cast("int").alias("n"))
    hits = each.join(twice, "fp").groupBy("class_id").agg(F.collect_list(F.struct("fp", "n", "at")).alias("hits"))
    texts = df.select(F.col(id_col).alias("class_id"), text.alias("text"))
    return map_rows(texts.join(hits, "class_id"), _with_context, "fp long, n int, class_id long, at int, prev long, back int, left string, right string")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Pairs:
    """Links within the groups of a partition sorted by span.

    A pair whose previous spans agree too is left to that earlier span.
    give: "links" for pairs of classes, "all" for the stretches of every owner,
    "later" for those that an owner with a lesser class holds too."""

    def __init__(self, ddl: str, give: str) -> None:
        self.schema, self.give = arrow_schema(ddl), give

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = self.schema
        out: list[tuple] = []
        for _, rows in grouped_rows(batches, "fp"):
            out.extend(self.linked(rows) if self.give == "links" else self.covered(rows))
            while len(out) >= 20_000:
                yield as_batch(out[:20_000], schema, len(schema))
                out = out[20_000:]
        if out:
            yield as_batch(out, schema, len(schema))

    def linked(self, rows: list[dict]) -> Iterator[tuple]:
        seen: set[tuple[int, int]] = set()
        for i, x in enumerate(rows):
            for y in rows[i + 1 :]:
                a, b = x["class_id"], y["class_id"]
                if a == b or x["prev"] is not None and x["prev"] == y["prev"] and x["back"] == y["back"]:
                    continue
                pair = (a, b) if a < b else (b, a)
                if pair not in seen and _sides(x, y)[2]:
                    seen.add(pair)
                    yield pair

    def covered(self, rows: list[dict]) -> Iterator[tuple]:
        reach = [[-1, -1] for _ in rows]
        for i, x in enumerate(rows):
            for j in range(i + 1, len(rows)):
                y = rows[j]
                if x["class_id"] == y["class_id"]:
                    continue
                l, r, ok = _sides(x, y)
                if ok:
                    for k in (i, j) if self.give == "all" else (i,) if x["class_id"] > y["class_id"] else (j,):
                        reach[k][0], reach[k][1] = max(reach[k][0], l), max(reach[k][1], r)
        for x, (l, r) in zip(rows, reach):
            if l >= 0:
                yield x["class_id"], x["at"] - l, x["at"] + SPAN + r


def _sides(x: dict, y: dict) -> tuple[int, int, bool]:
    l, r = _common(x["left"][::-1], y["left"][::-1]), _common(x["right"], y["right"])
    return l, r, l + r >= SIDE


def _windows(cols: dict[str, list]) -> Iterator[tuple]:
    """All places where a window of MIN_RUN code points around a span may begin, each with the window that begins one before it."""
    for fp, c, at, left, right in zip(cols["fp"], cols["class_id"], cols["at"], cols["left"], cols["right"]):
        before = None
        for j in range(min(SIDE, len(left)), max(0, SIDE - len(right)) - 1, -1):
            h = _hash(f"{fp},{j},{left[len(left) - j :]}\0{right[: SIDE - j]}")
            yield h, before, c, at - j
            before = h


def _split(occ: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Small groups in order, and the windows of large ones."""
    small = occ.where(F.col("n") <= SMALL_GROUP).repartition("fp").sortWithinPartitions("fp")
    large = map_rows(occ.where(F.col("n") > SMALL_GROUP), _windows, "window long, before long, class_id long, start int")
    return small, large


def _prepared(df: DataFrame, id_col: str, text: F.Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    classes, members = distinct_texts(df, id_col, text)
    occ = occurrences(df, id_col, text, classes)
    return classes, members, occ


def class_links(occ: DataFrame) -> DataFrame:
    """Pairs of classes (a, b), a < b, whose texts share a run of MIN_RUN code points."""
    occ = cut(occ)
    small, large = _split(occ)
    near = small.mapInArrow(_Pairs("a long, b long", "links"), "a long, b long")
    return near.union(_window_links(large)).distinct()


def _window_links(large: DataFrame) -> DataFrame:
    """Pairs of classes with a common window, from the first window of every run of common ones."""
    w = cut(large.groupBy("window", "before", "class_id").agg(F.min("start").alias("start")))
    salts = w.groupBy("window").agg(F.ceil(F.count("*") / PAIRED).alias("salts"), F.min("class_id").alias("p"), F.max("class_id").alias("q")).where("p < q").select("window", "salts")
    salted = w.join(salts, "window")
    x = salted.select("window", F.pmod(F.xxhash64("class_id"), F.col("salts")).alias("salt"), F.col("before").alias("bx"), F.col("class_id").alias("a"))
    y = salted.select("window", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("before").alias("by"), F.col("class_id").alias("b"))
    return x.join(y, ["window", "salt"]).where("a < b and (bx is null or by is null or bx <> by)").select("a", "b")


def shared_pairs(df: DataFrame, id_col: str = "chapter_id", text: F.Column | None = None) -> DataFrame:
    """Every two rows (a, b), a < b, that share a run of at least MIN_RUN code points.

    Null ids and null or shorter texts share nothing. Repeated rows with one id
    are one record. Columns beyond the two named are not read."""
    text = joined_text() if text is None else text
    _, members, occ = _prepared(df, id_col, text)
    members = members.distinct()
    links = class_links(occ)
    x, y = members.toDF("a", "ca"), members.toDF("b", "cb")
    across = links.toDF("ca", "cb").join(x, "ca").join(y, "cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    copies = x.join(y, F.col("ca") == F.col("cb")).where("a < b").select("a", "b")
    return across.union(copies)


def shared_intervals(df: DataFrame, id_col: str = "chapter_id", text: F.Column | None = None) -> DataFrame:
    """Per record the maximal stretches [start, stop) of code points that other records hold in runs of MIN_RUN or more."""
    text = joined_text() if text is None else text
    classes, members, occ = _prepared(df, id_col, text)
    occ = cut(occ)
    small, large = _split(occ)
    ddl = "class_id long, start int, stop int"
    near = small.mapInArrow(_Pairs(ddl, "all"), ddl)
    shared = large.groupBy("window").agg(F.min("class_id").alias("p"), F.max("class_id").alias("q")).where("p < q").select("window")
    far = large.join(shared, "window").select("class_id", "start", (F.col("start") + MIN_RUN).alias("stop"))
    copied = members.groupBy("class_id").agg(F.countDistinct("id").alias("k")).where("k > 1").select("class_id")
    whole = classes.join(copied, "class_id").select("class_id", F.lit(0).alias("start"), F.col("n_chars").alias("stop"))
    spans = near.union(far).union(whole).groupBy("class_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("s"))
    merged = map_rows(spans, _merged, ddl)
    return members.distinct().join(merged, "class_id").select(F.col("id"), "class_id", "start", "stop")


def _merged(cols: dict[str, list]) -> Iterator[tuple]:
    for c, spans in zip(cols["class_id"], cols["s"]):
        lo, hi = spans[0]["start"], spans[0]["stop"]
        for s in spans[1:]:
            if s["start"] > hi:
                yield c, lo, hi
                lo, hi = s["start"], s["stop"]
            hi = max(hi, s["stop"])
        yield c, lo, hi


def shared_shares(df: DataFrame, id_col: str = "chapter_id", text: F.Column | None = None) -> DataFrame:
    """Per record: id, n_chars, shared_chars and shared_share (0 for empty texts; a null text has length 0)."""
    text = joined_text() if text is None else text
    own = df.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.coalesce(F.length(text), F.lit(0)).alias("n_chars")).groupBy(id_col).agg(F.max("n_chars").alias("n_chars"))
    spans = shared_intervals(df, id_col, text).groupBy("id").agg(F.sum(F.col("stop") - F.col("start")).alias("s"))
    joined = own.join(spans, own[id_col] == spans["id"], "left")
    shared = F.coalesce(F.col("s"), F.lit(0)).cast("long")
    return joined.select(id_col, F.col("n_chars").cast("long").alias("n_chars"), shared.alias("shared_chars"), F.coalesce(shared / F.nullif(F.col("n_chars"), F.lit(0)), F.lit(0.0)).alias("shared_share"))


def _sentences(text: str) -> list[tuple[int, int]]:
    cuts = [0, *(m.end() for m in _ENDS.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _kept(cols: dict[str, list]) -> Iterator[tuple]:
    for i, text, gone in zip(cols["id"], cols["text"], cols["gone"]):
        spans = sorted((g["start"], g["stop"]) for g in gone or [])
        kept, dropped, k = [], 0, 0
        for a, b in _sentences(text or ""):
            while k < len(spans) and spans[k][1] <= a:
                k += 1
            if k < len(spans) and spans[k][0] <= a and b <= spans[k][1]:
                dropped += b - a
            else:
                kept.append(text[a:b])
        yield i, text if text is None else "".join(kept), dropped


def repeated_intervals(df: DataFrame, id_col: str, text: F.Column) -> DataFrame:
    """Per record the stretches that a record with a lesser id holds too: every span but its first owner's."""
    classes, members = distinct_texts(df, id_col, text)
    occ = cut(occurrences(df, id_col, text, classes))
    small, large = _split(occ)
    ddl = "class_id long, start int, stop int"
    near = small.mapInArrow(_Pairs(ddl, "later"), ddl)
    firsts = large.groupBy("window").agg(F.min("class_id").alias("first"), F.max("class_id").alias("last")).where("first < last").select("window", "first")
    far = large.join(firsts, "window").where("class_id > first").select("class_id", "start", (F.col("start") + MIN_RUN).alias("stop"))
    later = near.union(far)
    merged = map_rows(later.groupBy("class_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("s")), _merged, ddl)
    own = members.distinct()
    copies = own.where("id > class_id").join(classes.select("class_id", "n_chars"), "class_id").select("id", F.lit(0).alias("start"), F.col("n_chars").alias("stop"))
    return own.where("id = class_id").join(merged, "class_id").select("id", "start", "stop").union(copies)


def drop_repeats(df: DataFrame, id_col: str = "chapter_id", text: F.Column | None = None) -> DataFrame:
    """Per record its text without the sentences that lie in a non-first repeated span, and the code points dropped.

    The first owner of a span is the record with the least id; it keeps it. A
    null text stays null. Records without repeats are passed on unchanged."""
    text = joined_text() if text is None else text
    gone = repeated_intervals(df, id_col, text).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    texts = df.select(F.col(id_col).alias("id"), text.alias("text"))
    out = map_rows(texts.join(gone, "id", "left"), _kept, "id long, text string, dropped_chars long", 500)
    return out.withColumnRenamed("id", id_col)
