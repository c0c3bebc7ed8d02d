"""Reading level of each document.

Method: smoothed unigram language models per grade level, trained on labelled
texts; the level with the highest posterior likelihood is assigned.

Units are lower-case words and marks in English and characters and pairs of
characters in Chinese; digit runs are one unit. Each language has its own models, smoothed
towards the units of all its grades (Dirichlet). The labelled samples are a
bounded table that is fitted on the driver; scoring runs over all documents, with whole
texts, as sums of table rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkwell.functions.arrow import arrow_schema, as_batch

#: Labelled texts that a fit takes at most; the order is that of their ids.
MAX_SAMPLES = 20_000
#: Weight of the units of all grades in the model of one.
MU = 100.0
ALPHA = 0.5

_UNITS = re.compile(r"[a-z]+|0|[^\w\s]")
_DIGITS = re.compile(r"\d+")
_HAN = re.compile("[㐀-鿿豈-﫿]")
_LATIN = re.compile("[A-Za-z]+")


def language(text: str) -> str:
    """zh where Han characters are at least as many as Latin words, else en."""
    return "zh" if len(_HAN.findall(text)) >= max(1, len(_LATIN.findall(text))) else "en"


def units(text: str, lang: str) -> list[str]:
    t = _DIGITS.sub("0", text.lower())
    if lang == "en":
        return _UNITS.findall(t)
    chars = "".join(t.split())
    return [*chars, *map("".join, zip(chars, chars[1:]))]


class LevelModels:
    """Log likelihoods of units by language and grade."""

    def __init__(self, samples: list[tuple[str, str, int]]) -> None:
        self.grades = sorted({g for *_, g in samples})
        self.tables: dict[str, tuple[dict[str, int], np.ndarray, np.ndarray]] = {}
        for lang in sorted({x for x, *_ in samples}):
            counts = {g: Counter() for g in self.grades}
            texts = Counter()
            for x, text, g in samples:
                if x == lang:
                    counts[g].update(units(text, lang))
                    texts[g] += 1
            whole: Counter = Counter()
            for c in counts.values():
                whole.update(c)
            total, size = sum(whole.values()), len(whole) + 1
            ids = {u: k + 1 for k, u in enumerate(sorted(whole))}
            rows = np.zeros((size, len(self.grades)))
            back = np.array([ALPHA, *(whole[u] + ALPHA for u in sorted(whole))]) / (total + ALPHA * size)
            for j, g in enumerate(self.grades):
                n = sum(counts[g].values())
                own = np.array([0, *(counts[g][u] for u in sorted(whole))])
                rows[:, j] = np.log((own + MU * back) / (n + MU))
            prior = np.log([(texts[g] + 1) / (sum(texts.values()) + len(self.grades)) for g in self.grades])
            self.tables[lang] = (ids, rows, prior)

    def level(self, text: str, lang: str | None = None) -> tuple[int, float, str] | None:
        """(level, posterior probability, language), or None for a blank text."""
        lang = lang or language(text)
        if lang not in self.tables:
            lang = next(iter(self.tables))
        ids, rows, prior = self.tables[lang]
        get = ids.get
        at = [get(u, 0) for u in units(text, lang)]
        if not at:
            return None
        s = prior + np.bincount(at, minlength=len(rows)) @ rows if len(at) > len(rows) else prior + rows[at].sum(axis=0)
        best = int(s.argmax())
        return self.grades[best], float(1 / np.exp(np.minimum(s - s[best], 0)).sum()), lang


def fit(samples: DataFrame, max_samples: int = MAX_SAMPLES) -> LevelModels:
    """Models of (lang, text, grade); rows with a null are left out, the language is read off the text where it is null."""
    rows = samples.where("text is not null and grade is not null").orderBy("sample_id").limit(max_samples).select("lang", "text", "grade").collect()
    return LevelModels([(_lang(r["lang"], r["text"]), r["text"], r["grade"]) for r in rows if r["text"].strip()])


def _lang(lang: str | None, text: str) -> str:
    k = (lang or "").lower()[:2]
    return k if k in ("en", "zh") else language(text)


class _Levels:
    def __init__(self, models: LevelModels, ddl: str) -> None:
        self.models, self.schema = models, arrow_schema(ddl)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                got = self.models.level(text) if text is not None and not text.isspace() else None
                rows.append((i, source, *(got or (None, None, None))))
            yield as_batch(rows, self.schema, 5)


def levels(df: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, level, posterior, lang) of every document; null for null and blank texts and texts without a unit."""
    ddl = "id long, source string, level int, posterior double, lang string"
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).mapInArrow(_Levels(fit(samples), ddl), ddl)


def profile(found: DataFrame) -> DataFrame:
    """Documents and their share by source and level; documents without a level are left out of it."""
    n = found.where("level is not null").groupBy("source", "level").agg(F.count("*").alias("documents"), F.avg("posterior").alias("mean_posterior"))
    whole = n.groupBy(F.col("source").alias("s")).agg(F.sum("documents").alias("whole"))
    return n.join(whole, F.col("source").eqNullSafe(F.col("s"))).select("source", "level", "documents", (F.col("documents") / F.col("whole")).alias("share"), "mean_posterior")


def share_right(models: LevelModels, held_out: list[tuple[str, str, int]]) -> float:
    """Share of held-out texts whose level is their grade."""
    return sum(models.level(t, x)[0] == g for x, t, g in held_out) / max(1, len(held_out))
