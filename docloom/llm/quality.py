"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Boosted trees over statistics of whole texts give their paths as conjunctive rules; logistic regression with an L1
penalty weights the rules, and those with a weight become one column expression. Statistics and scores are native
expressions; only the fit, over at most 2 * SAMPLE labelled rows, runs in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learn import held_out, labelled

#: Most labelled documents of each class that the fit sees.
SAMPLE = 4000
MODULUS, HELD, THRESHOLD = 5, 0, 0.3
TREES, DEPTH, RATE, BINS, PENALTY = 24, 3, 0.3, 32, 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Statistics by name, none of them null; a null text counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    count = F.greatest(F.size(words), F.lit(1))
    lines = F.split(t, "\n")
    marks = lambda m: (F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))) / n
    rate = lambda p: F.regexp_count(t, F.lit(p)) / n
    return {
        "log_words": F.log1p(F.size(words)), "word_length": n / count, "distinct_words": F.size(F.array_distinct(words)) / count, "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_words": count / F.size(lines), "upper": rate("[A-Z]"), "digits": rate("[0-9]"), "bang": marks("!"), "pipe": marks("|"), "stop": marks("."), "comma": marks(","), "symbols": rate(r"[#$%&*+/<=>@\\^_`{}~\[\];:?\-]"),
    }


@dataclass(frozen=True)
class Rules:
    """Weighted conjunctions of (statistic, above, threshold), and the constant."""

    weights: tuple[float, ...]
    paths: tuple[tuple[tuple[str, bool, float], ...], ...]
    constant: float

    def column(self) -> Column:
        total = F.lit(self.constant)
        for weight, path in zip(self.weights, self.paths, strict=True):
            holds = F.lit(True)
            for name, above, at in path:
                holds = holds & (F.col(name) > at if above else F.col(name) <= at)
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _tree(bins: np.ndarray, slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: list, step: np.ndarray) -> None:
    g, h = slope[rows].sum(), curve[rows].sum()
    step[rows] = RATE * g / (h + 1)
    if path:
        out.append(path)
    if depth == 0 or len(rows) < 20:
        return
    best = (1e-3, -1, 0)
    for f in range(bins.shape[1]):
        left_g = np.cumsum(np.bincount(bins[rows, f], slope[rows], BINS))[:-1]
        left_h = np.cumsum(np.bincount(bins[rows, f], curve[rows], BINS))[:-1]
        gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
        k = int(gain.argmax())
        best = max(best, (float(gain[k]), f, k))
    _, f, k = best
    if f < 0:
        return
    low = bins[rows, f] <= k
    for above, part in ((False, rows[low]), (True, rows[~low])):
        _tree(bins, slope, curve, part, (*path, (f, above, k)), depth - 1, out, step)


def fit(names: list[str], x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules from rows of statistics x and labels y; without two classes only a constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    constant = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Rules((), (), constant)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    score, found = np.full(len(y), constant), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        _tree(bins, y - p, p * (1 - p), np.arange(len(y)), (), DEPTH, found, step)
        score += step
    paths = [*dict.fromkeys(tuple(sorted(p)) for p in found)]
    holds = np.stack([np.logical_and.reduce([(bins[:, f] > k) == above for f, above, k in p]) for p in paths], axis=1).astype(np.float64)
    keep = (share_of := holds.mean(axis=0)) > 0
    paths, holds, share_of = [p for p, k in zip(paths, keep, strict=True) if k], holds[:, keep], share_of[keep]
    # FISTA on the mean logistic loss plus PENALTY times the L1 norm; the constant is not penalised
    design = np.column_stack([np.ones(len(y)), holds])
    speed = 4 * len(y) / (np.linalg.norm(design, 2) ** 2 + 1e-9)
    w = z = np.zeros(design.shape[1])
    t = 1.0
    for _ in range(400):
        new = z - speed * (design.T @ (1 / (1 + np.exp(-(design @ z))) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - speed * PENALTY, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z, w = new + (before - 1) / t * (new - w), new
    used = np.flatnonzero(w[1:])
    at = lambda f, k: float(cuts[f][min(k, len(cuts[f]) - 1)])
    return Rules(tuple(float(w[k + 1]) for k in used), tuple(tuple((names[f], above, at(f, k)) for f, above, k in paths[k]) for k in used), float(w[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Rules:
    """Rules from at most `sample` labelled documents of each class, none of them held out.

    Null labels and ids name no document; an id with several labels has the greatest; an id of several rows gives one
    of them. Without labels, or with one class only, the rules are a constant.
    """
    stats = statistics(F.col("text"))
    rows = labelled(docs.select("doc_id", "text"), labels, label, MODULUS, HELD, sample)
    # both classes are sampled alike, so their true odds go into the constant
    got = rows.select("doc_id", "y", *(c.alias(n) for n, c in stats.items())).toPandas().sort_values(["doc_id", *stats]).reset_index(drop=True)
    whole = labels.where(F.col(label).isNotNull() & F.coalesce(F.crc32(F.col("doc_id").cast("string")) % MODULUS != HELD, F.lit(False))).agg(F.sum((F.col(label) > 0).cast("int")).alias("one"), F.count("*").alias("all")).first()
    rules = fit([*stats], got[[*stats]].to_numpy(float), got["y"].to_numpy(float))
    ones, seen = float(got["y"].sum()), len(got)
    if rules.paths and 0 < ones < seen and whole["one"] and whole["one"] < whole["all"]:
        shift = np.log(whole["one"] / (whole["all"] - whole["one"])) - np.log(ones / (seen - ones))
        rules = Rules(rules.weights, rules.paths, rules.constant + float(shift))
    return rules


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """(row, score, predicted): each row of docs as a struct, with its score (0 to 1) and 1 from THRESHOLD on, else 0.

    Every row, repeated or with nulls, comes back once, and its columns may have any names. A null text scores as an
    empty one; a very long text is read whole; texts with equal statistics score alike. An empty table gives no rows.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.select("row", *(c.cast("double").alias(n) for n, c in statistics(F.col("row.text")).items()))
    return rows.select("row", rules.column().alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, rules: Rules) -> DataFrame:
    """The rows of docs that are predicted good, unchanged."""
    return score(docs, rules).where("predicted = 1").select("row.*")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs; nulls, repeats and empty tables as in score and train."""
    rows = score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("row.doc_id", held_out("row.doc_id", MODULUS, HELD).alias("held_out"), "score", "predicted")
