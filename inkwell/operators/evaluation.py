"""Scoring of predictions and scores: tables of (gold, pred) or (truth, score, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkwell.operators.order import with_prefix


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def by_label(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of every label that occurs as gold or prediction."""
    by = by or []
    c = rows.groupBy(*by, "gold", "pred").agg(F.count("*").alias("n"))
    gold = c.groupBy(*by, F.col("gold").alias("label")).agg(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("gold_n"), F.lit(0).cast("long").alias("pred_n"))
    pred = c.groupBy(*by, F.col("pred").alias("label")).agg(F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("gold_n"), F.sum("n").alias("pred_n"))
    g = gold.unionByName(pred).where("label is not null").groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("gold_n").alias("gold_n"), F.sum("pred_n").alias("pred_n"))
    p, r = _safe(F.col("tp"), F.col("pred_n")), _safe(F.col("tp"), F.col("gold_n"))
    return g.select(*by, "label", "tp", (F.col("pred_n") - F.col("tp")).alias("fp"), (F.col("gold_n") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, accuracy, balanced accuracy, macro F1 (over labels in gold) and the share of the commonest gold label."""
    by = by or []
    labels = by_label(rows, by).where(F.col("tp") + F.col("fn") > 0)
    g = labels.groupBy(*by).agg(F.sum(F.col("tp") + F.col("fn")).alias("rows"), F.sum("tp").alias("right"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), F.max(F.col("tp") + F.col("fn")).alias("most"))
    return g.select(*by, "rows", _safe(F.col("right"), F.col("rows")).alias("accuracy"), "balanced_accuracy", "macro_f1", _safe(F.col("most"), F.col("rows")).alias("majority_share"))


def confusions(rows: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent wrong pairs (gold, pred, n); ties by gold, then prediction."""
    return rows.where(~F.col("gold").eqNullSafe(F.col("pred"))).groupBy("gold", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold", "pred").limit(top)


def threshold_table(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """(threshold, sensitivity, specificity, balanced) of calling scores >= threshold positive, for every score that occurs.

    rows: (truth 0/1, score). Running sums go over distinct scores, range-partitioned."""
    w = F.col(weight) if weight else F.lit(1.0)
    per = rows.groupBy("score").agg(F.sum(F.when(F.col("truth") == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("truth") == 0, w).otherwise(0.0)).alias("neg"))
    whole = per.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    placed = with_prefix(per.where("score is not null"), "score", {"pos": "_p", "neg": "_f"}, descending=True)
    t = placed.crossJoin(F.broadcast(whole)).select(F.col("score").alias("threshold"), (F.col("_p") + F.col("pos")).alias("tp"), (F.col("_f") + F.col("neg")).alias("fp"), "p", "n")
    sens, spec = _safe(F.col("tp"), F.col("p")), _safe(F.col("n") - F.col("fp"), F.col("n"))
    return t.select("threshold", sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced"))


def choose_threshold(table: DataFrame, sensitivity: float, specificity: float) -> DataFrame:
    """The lowest threshold that meets both floors; without one, the best balanced, then more specific, more sensitive, lower."""
    ok = (F.col("sensitivity") >= sensitivity) & (F.col("specificity") >= specificity)
    t = table.withColumn("eligible", ok)
    order = [F.desc("eligible"), F.when(F.col("eligible"), F.col("threshold")), F.desc("balanced"), F.desc("specificity"), F.desc("sensitivity"), "threshold"]
    return t.orderBy(*order).limit(1)


def auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at half; null without both classes."""
    per = rows.groupBy("score").agg(F.sum((F.col("truth") == 1).cast("long")).alias("p"), F.sum((F.col("truth") == 0).cast("long")).alias("n"))
    return with_prefix(per.where("score is not null"), "score", {"n": "below"}).agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def calibration_error(rows: DataFrame, bins: int = 10, weight: str | None = None) -> DataFrame:
    """Expected calibration error: weighted mean distance of mean score and mean truth over equal bins of [0, 1]."""
    w = F.col(weight) if weight else F.lit(1.0)
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    per = rows.withColumn("w", w).groupBy(b.alias("bin")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("score")).alias("s"), F.sum(F.col("w") * F.col("truth")).alias("t"))
    return per.agg((F.sum(F.abs(F.col("s") - F.col("t"))) / F.sum("w")).alias("ece"))


def hierarchical_weights(rows: DataFrame, group: str, book: str, target: str | None = None) -> DataFrame:
    """Every group the same mass, shared by its books, shared by their rows; mean weight 1.

    With a target group: half of all mass to it, half to all others."""
    per = rows.groupBy(group, book).agg(F.count("*").alias("n"))
    books = per.groupBy(group).agg(F.count("*").alias("books"))
    whole = books.agg(F.count("*").alias("groups")).crossJoin(rows.agg(F.count("*").alias("rows")))
    mass = F.lit(1.0) / F.col("groups") if target is None else F.when(F.col(group) == target, 0.5).otherwise(F.lit(0.5) / F.greatest(F.col("groups") - 1, F.lit(1)))
    return rows.join(per, [group, book]).join(books, group).crossJoin(F.broadcast(whole)).withColumn("weight", mass / F.col("books") / F.col("n") * F.col("rows")).drop("n", "books", "groups", "rows")
