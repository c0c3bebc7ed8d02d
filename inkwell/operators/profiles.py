"""Author profiles: fitting, scoring, and contrasts between authors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from inkwell.functions.arrow import arrow_schema, as_batch, one_row_batches
from inkwell.session import cut

#: Most features that blocks of dense vectors are made of.
DENSE = 8192
#: Texts and authors of a block.
BLOCK = 8192


def fit_profiles(counts: DataFrame, top: int) -> DataFrame:
    """(author, feature, weight): term frequency x smoothed inverse author frequency, the top features of each author, scaled to length 1.

    counts: (author, feature, n). IDF is over authors: ln((1 + A) / (1 + df)) + 1. Ties by feature."""
    per = counts.groupBy("author", "feature").agg(F.sum("n").alias("n"))
    size = per.groupBy("author").agg(F.sum("n").alias("total"))
    df = per.groupBy("feature").agg(F.count("*").alias("df"))
    authors = size.agg(F.count("*").alias("authors"))
    w = F.col("n") / F.greatest("total", F.lit(1)) * (F.log((F.col("authors") + 1) / (F.col("df") + 1)) + 1)
    weighted = per.join(size, "author").join(df, "feature").crossJoin(F.broadcast(authors)).select("author", "feature", w.alias("w"), (F.log((F.col("authors") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    kept = weighted.withColumn("k", F.row_number().over(W.partitionBy("author").orderBy(F.desc("w"), "feature"))).where(F.col("k") <= top)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("author")))
    return kept.select("author", "feature", (F.col("w") / F.when(norm > 0, norm).otherwise(1.0)).alias("weight"), "idf")


def score(counts: DataFrame, profiles: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, author, score): cosine of a text's in-profile features with each author that shares one; 0 is left out."""
    total = counts.groupBy(id_col).agg(F.greatest(F.sum("n"), F.lit(1)).alias("total"))
    idf = profiles.groupBy("feature").agg(F.max("idf").alias("idf"))
    doc = counts.join(idf, "feature").join(total, id_col).select(id_col, "feature", (F.col("n") / F.col("total") * F.col("idf")).alias("w"))
    norm = doc.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    hits = doc.join(profiles.select("author", "feature", "weight"), "feature").groupBy(id_col, "author").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    return hits.join(norm, id_col).select(id_col, "author", (F.col("dot") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("score"))


def predict(scores: DataFrame, id_col: str = "id", digits: int = 9) -> DataFrame:
    """(id, pred, score): the best author; ties, to the given digits, go to the greater name."""
    r = scores.withColumn("r", F.round("score", digits))
    return r.groupBy(id_col).agg(F.max(F.struct("r", "author")).alias("m")).select(id_col, F.col("m.author").alias("pred"), F.col("m.r").alias("score"))


class _Stack:
    """Rows (key, features, values) stacked into blocks of dense vectors; a feature's values are added up, without values it counts."""

    def __init__(self, at: dict[str, int], size: int, kind: str, ddl: str) -> None:
        self.at, self.size, self.kind, self.schema = at, size, kind, arrow_schema(ddl)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(self.at)
        keys: list[str] = []
        cells: list[int] = []
        values: list[float] = []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for k, (key, features) in enumerate(zip(*columns[:2])):
                base = len(keys) * width
                found = [self.at.get(f) for f in features]
                cells += [base + j for j in found if j is not None]
                values += [1.0] * (len(found) - found.count(None)) if len(columns) < 3 else [x for x, j in zip(columns[2][k], found) if j is not None]
                keys.append(key)
                if len(keys) == self.size:
                    yield self._batch(keys, cells, values)
                    keys, cells, values = [], [], []
        if keys:
            yield self._batch(keys, cells, values)

    def _batch(self, keys: list[str], cells: list[int], values: list[float]) -> pa.RecordBatch:
        dense = np.bincount(np.array(cells, dtype=np.int64), np.array(values, dtype=float), len(keys) * len(self.at))
        return as_batch([(keys, dense.astype(self.kind).tobytes())], self.schema, 2)


class _Best:
    """The best author of the blocks that a block of texts meets one after the other; ties go to the greater name.

    Single precision finds the groups of GROUP authors, and in these the authors, within NEAR of a text's best, double precision decides."""

    NEAR, ROWS, AUTHORS, GROUP = 5e-5, 256, 1024, 32

    def __init__(self, idf: np.ndarray, digits: int, ddl: str) -> None:
        self.idf, self.digits, self.schema = idf, digits, arrow_schema(ddl)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, held = len(self.idf), None
        ids, x, score, best = [], np.zeros((0, width)), np.zeros(0), []
        for b in batches:
            for i in range(b.num_rows):
                if held != b.column(0)[i].as_py():
                    if ids:
                        yield self._rows(ids, score, best)
                    held, ids = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                    x = np.frombuffer(b.column(2)[i].as_py(), np.float32).reshape(-1, width) * self.idf
                    norm = np.linalg.norm(x, axis=1, keepdims=True)
                    x = x / np.where(norm > 0, norm, 1)
                    score, best = np.zeros(len(ids)), [""] * len(ids)
                authors = b.column(3)[i].as_py()
                order = sorted(range(len(authors)), key=lambda k: authors[k])
                self._meet(x, np.frombuffer(b.column(4)[i].as_py()).reshape(-1, width)[order], [authors[k] for k in order], score, best)
        if ids:
            yield self._rows(ids, score, best)

    def _meet(self, x: np.ndarray, y: np.ndarray, authors: list[str], score: np.ndarray, best: list[str]) -> None:
        short, some = np.zeros((-(-len(y) // self.GROUP) * self.GROUP, y.shape[1]), dtype=np.float32), np.flatnonzero(x.any(axis=1))
        short[: len(y)] = y
        room = np.empty(self.AUTHORS * self.ROWS, dtype=np.float32)
        for lo in range(0, len(some), self.ROWS):
            own = some[lo : lo + self.ROWS]
            tall = np.ascontiguousarray(x[own].T, dtype=np.float32)
            for at in range(0, len(short), self.AUTHORS):
                near = short[at : at + self.AUTHORS]
                s = np.matmul(near, tall, out=room[: len(near) * len(own)].reshape(len(near), -1)).reshape(-1, self.GROUP, len(own))
                high = s.max(axis=1)
                least = np.maximum(high.max(axis=0), score[own]) - self.NEAR  # what falls short of the blocks before is not looked at
                group, r = np.nonzero(high >= least)
                k, c = np.nonzero(s[group, :, r] >= least[r][:, None])
                r, c = r[k], at + group[k] * self.GROUP + c
                r, c = r[c < len(y)], c[c < len(y)]
                if not len(r):
                    continue
                exact = np.concatenate([np.einsum("ij,ij->i", x[own[r[k : k + 65536]]], y[c[k : k + 65536]]) for k in range(0, len(r), 65536)])
                exact = np.round(exact, self.digits)
                order = np.lexsort((c, exact, r))
                last = order[np.append(np.diff(r[order]) > 0, True)]
                for k, v, a in zip(own[r[last]].tolist(), exact[last].tolist(), c[last].tolist()):
                    if v > score[k] or v == score[k] > 0 and authors[a] > best[k]:
                        score[k], best[k] = v, authors[a]

    def _rows(self, ids: list[str], score: np.ndarray, best: list[str]) -> pa.RecordBatch:
        return as_batch([(i, a, v) for i, a, v in zip(ids, best, score.tolist()) if v > 0], self.schema, 3)


def best_author(counts: DataFrame, profiles: DataFrame, id_col: str = "id", digits: int = 9, block: int = BLOCK) -> DataFrame:
    """What predict(score(...)) gives. With at most DENSE features, blocks of texts meet blocks of authors as dense vectors; with more, texts and profiles are joined on features."""
    docs = counts.groupBy(F.col(id_col).cast("string").alias(id_col)).agg(F.collect_list("feature").alias("f"), F.collect_list(F.col("n").cast("double")).alias("v"))
    return _nearest(docs, profiles, id_col, digits, block, lambda: counts)


def best_author_of(docs: DataFrame, profiles: DataFrame, id_col: str = "id", digits: int = 9, block: int = BLOCK) -> DataFrame:
    """best_author of texts (id, f): f holds a text's features as often as they occur, so texts are not taken apart and grouped again."""
    counts = lambda: docs.select(id_col, F.explode("f").alias("feature")).groupBy(id_col, "feature").agg(F.count("*").alias("n"))
    return _nearest(docs.select(F.col(id_col).cast("string").alias(id_col), "f"), profiles, id_col, digits, block, counts)


def _nearest(docs: DataFrame, profiles: DataFrame, id_col: str, digits: int, block: int, counts: Callable[[], DataFrame]) -> DataFrame:
    profiles = cut(profiles)
    known = {r["feature"]: r["idf"] for r in profiles.groupBy("feature").agg(F.max("idf").alias("idf")).limit(DENSE + 1).collect()}
    if len(known) > DENSE:
        return predict(score(counts(), profiles, id_col), id_col, digits)
    at = {f: k for k, f in enumerate(sorted(known))}
    people = profiles.groupBy("author").agg(F.collect_list("feature").alias("f"), F.collect_list("weight").alias("v"))
    ddl = "keys array<string>, data binary"
    x = cut(docs.mapInArrow(_Stack(at, block, "f4", ddl), ddl).select(F.expr("uuid()").alias("block"), "*"))
    y = cut(people.mapInArrow(_Stack(at, block, "f8", ddl), ddl)).coalesce(1)  # so that a task meets all authors with a block before the next
    out = f"{id_col} string, author string, score double"
    with one_row_batches(docs.sparkSession):
        near = cut(x.crossJoin(y.toDF("a", "y")).mapInArrow(_Best(np.array([known[f] for f in at]), digits, out), out))
    return near.groupBy(id_col).agg(F.max(F.struct("score", "author")).alias("m")).select(id_col, F.col("m.author").alias("pred"), F.col("m.score").alias("score"))


def book_vote(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, pred): the prediction most chunks of a book have; ties go to the greater name."""
    v = predictions.groupBy(*keys, "pred").agg(F.count("*").alias("votes"))
    return v.groupBy(*keys).agg(F.max(F.struct("votes", "pred")).alias("m")).select(*keys, F.col("m.pred").alias("pred"), F.col("m.votes").alias("votes"))


def standard_scores(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Group medians of each metric, and their z-scores over groups with the sample deviation (0 where it is 0)."""
    med = df.groupBy(group).agg(*[F.median(m).alias(m) for m in metrics])
    whole = med.agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_samp(m).alias(f"{m}_sd") for m in metrics])
    z = [F.coalesce((F.col(m) - F.col(f"{m}_mean")) / F.nullif(F.col(f"{m}_sd"), F.lit(0.0)), F.lit(0.0)).alias(f"{m}_z") for m in metrics]
    return med.crossJoin(F.broadcast(whole)).select(group, *metrics, *z)


def ratio_profiles(observations: DataFrame, group: str, book: str) -> DataFrame:
    """Mergeable ratio profile: (group, feature, value, support, books) from (group, book, feature, num, den)."""
    g = observations.groupBy(group, "feature").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.count("*").alias("support"), F.countDistinct(book).alias("books"))
    return g.select(group, "feature", (F.col("num") / F.nullif(F.col("den"), F.lit(0))).alias("value"), "support", "books")


def contrasts(profiles: DataFrame, group: str, target: str, least_groups: int = 3) -> DataFrame:
    """Target against the mean and population deviation of all other groups, per feature: delta, z, direction.

    Features that fewer than least_groups others have are left out."""
    other = profiles.where((F.col(group) != target) & F.col("value").isNotNull()).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("groups")).where(F.col("groups") >= least_groups)
    mine = profiles.where((F.col(group) == target) & F.col("value").isNotNull())
    delta = F.col("value") - F.col("mean")
    return mine.join(other, "feature").select("feature", "value", "mean", delta.alias("delta"), F.when(F.col("sd") > 1e-12, delta / F.col("sd")).otherwise(0.0).alias("z"), F.when(delta >= 0, "higher").otherwise("lower").alias("direction"), "support", "books", "groups")


def recurrence(profiles: DataFrame, group: str, found: DataFrame) -> DataFrame:
    """(feature, share): share of the groups that differ from the mean in the found direction."""
    j = profiles.where("value is not null").join(found.select("feature", "mean", "direction"), "feature")
    same = F.when(F.col("direction") == "higher", F.col("value") > F.col("mean")).otherwise(F.col("value") < F.col("mean"))
    return j.groupBy("feature").agg(F.avg(same.cast("double")).alias("share"), F.count("*").alias("groups"))


def dispersed(counts: DataFrame, target: str, target_books: int, other_authors: int) -> DataFrame:
    """Features that enough books of the target, or enough other authors, have."""
    g = counts.groupBy("feature").agg(F.countDistinct(F.when(F.col("author") == target, F.col("title"))).alias("books"), F.countDistinct(F.when(F.col("author") != target, F.col("author"))).alias("authors"))
    return g.where((F.col("books") >= target_books) | (F.col("authors") >= other_authors))
