"""Quality by a sparse ensemble of rules over text statistics.

Shallow trees are boosted on a bounded sample of labelled documents; every path from a
root is a conjunction of thresholds on statistics, a rule.  A logistic model with a lasso
penalty gives weights to few of the rules, and those are compiled into one Spark column,
so scoring a corpus is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, unused

#: Labelled rows that the classifier is fitted on, at most (those with the smallest hash of their id).
SAMPLE = 20_000


STATISTICS = ("log_chars", "log_words", "word_length", "upper", "digits", "symbols", "bangs", "pipes", "ends",
              "distinct_words", "repeated_words", "distinct_lines", "line_length")


def with_statistics(docs: DataFrame, text_col: str, packed: str) -> DataFrame:
    """``docs`` with the statistics of its whole texts (null counts as empty) in the struct ``packed``."""
    text, words, lines, rest = (unused(docs, n) for n in ("__text", "__words", "__lines", "__rest"))
    t = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # Columns of their own: an array that a lambda looks into is then not made anew for each element.
    parted = docs.withColumn(text, t).withColumn(words, F.filter(F.split(text, SPACE), lambda w: w != "")).withColumn(lines, F.split(text, "\n"))
    # Capitals, digits and symbols are counted in what is left without other letters and white space.
    t, w, ln = F.col(text), F.col(words), F.col(lines)
    parted = parted.withColumn(rest, F.regexp_replace(t, r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}\s]+", ""))
    chars, n = F.length(t), F.size(w)
    count = lambda pattern: F.regexp_count(F.col(rest), F.lit(pattern))
    per = lambda x, of: x / F.greatest(of, F.lit(1))
    stats = (
        F.log1p(chars), F.log1p(n), per(chars, n), per(count(r"\p{Lu}"), chars), per(count("[0-9]"), chars),
        per(count(r"[^\p{L}\p{N}\s.,;:'!|]"), chars), per(count("!"), n), per(count(r"\|"), n), per(count("[.?!]"), n),
        per(F.size(F.array_distinct(w)), n),
        per(F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1))), n),
        F.size(F.array_distinct(ln)) / F.size(ln), chars / F.size(ln))
    row = F.struct(*[c.cast("double").alias(name) for name, c in zip(STATISTICS, stats)])
    # A generator of one row: a filter on the statistics stays above it, instead of working each out once per rule.
    return parted.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array(row)).alias(packed))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, True for > or False for <=, threshold) hold."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self, stats: Column) -> Column:
        each = [stats[name] > F.lit(v) if above else stats[name] <= F.lit(v) for name, above, v in self.terms]
        return reduce(lambda a, b: a & b, each)

    def matches(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        return np.all([(x[:, names.index(n)] > v) == above for n, above, v in self.terms], axis=0)


def boosted_paths(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 20) -> list[Rule]:
    """The paths of ``trees`` gradient-boosted trees for the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)  # bin b: x <= cuts[b]
    rules: dict[Rule, None] = {}
    margin = np.zeros(len(y))

    def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + 1.0)

    def grow(at: np.ndarray, terms: tuple, level: int, grad: np.ndarray, hess: np.ndarray) -> None:
        best = (1e-6, None, None)
        if level < depth and len(at) >= 2 * least:
            g_all, h_all = grad[at].sum(), hess[at].sum()
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[at, k]
                g, h, n = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (grad[at], hess[at], np.ones(len(at))))
                won = gain(g, h) + gain(g_all - g, h_all - h) - gain(g_all, h_all)
                won[(n < least) | (len(at) - n < least)] = 0
                j = int(np.argmax(won))
                if won[j] > best[0]:
                    best = (won[j], k, j)
        if best[1] is None:
            margin[at] -= rate * grad[at].sum() / (hess[at].sum() + 1.0)
            return
        _, k, j = best
        left = binned[at, k] <= j
        for side, rows in ((False, at[left]), (True, at[~left])):
            path = (*terms, (names[k], side, float(cuts[k][j])))
            rules[Rule(path)] = None
            grow(rows, path, level + 1, grad, hess)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(y)), (), 0, p - y, p * (1 - p))
    return list(rules)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 1500) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise the mean logistic loss plus ``penalty`` times the
    sum of absolute weights, by accelerated proximal steps."""
    n, d = x.shape
    a = np.hstack([np.ones((n, 1)), x])
    v = np.ones(d + 1)
    for _ in range(30):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / max(float(v @ (a.T @ (a @ v))), 1e-9)
    w = z = np.zeros(d + 1)
    t = 1.0
    for _ in range(rounds):
        slope = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / n
        new = z - step * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, moved = new + (t - 1) / t_new * (new - w), np.abs(new - w).max()
        w, t = new, t_new
        if moved < 1e-6:
            break
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, stats: Column) -> Column:
        """The probability of label 1, from a struct of the statistics."""
        margin = F.lit(self.intercept)
        for rule, w in self.weights:
            margin = margin + F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 5e-4) -> RuleModel:
    """Trees, their paths as rules, and lasso weights.  With one label only, or no rows, the score is constant."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return RuleModel(float(np.log(share / (1 - share))), ())
    rules = boosted_paths(x, y, names)
    if not rules:
        return RuleModel(float(np.log(share / (1 - share))), ())
    hit = np.stack([r.matches(x, names) for r in rules], 1).astype(float)
    _, first = np.unique(hit, axis=1, return_index=True)  # of rules that agree on all rows, one
    first.sort()
    b, w = lasso_logistic(hit[:, first], y, penalty)
    return RuleModel(b, tuple((rules[i], float(v)) for i, v in zip(first, w) if abs(v) > 1e-6))


def held_out(ident: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, mod ``folds``, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """Fit on at most ``sample`` labelled rows that aren't held out.  A document with several labels, or a
    label of several documents (repeated ids), counts once for each pair; pairs that disagree pull both ways."""
    ident = F.col(f"`{id_col}`")
    known = labels.where(~held_out(ident) & F.col(f"`{label_col}`").isNotNull()).select(ident.alias("__id"), F.col(f"`{label_col}`").cast("double").alias("__label"))
    # The share of hashes is cut first, so that tasks don't each send as many rows as are taken in all.
    share = F.shiftrightunsigned(F.xxhash64("__id"), 34) < F.lit(int(min(2 * sample / max(known.count(), 1), 1) * (1 << 30)))
    chosen = known.where(share).orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample)
    # ``sample`` rows of two numbers bound the broadcast side.
    found = docs.select(ident.alias("__doc"), F.col(f"`{text_col}`").alias("__text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    names = list(STATISTICS)
    rows = with_statistics(found, "__text", "__stats").select("__id", "__label", "__stats.*").orderBy(F.xxhash64("__id"), "__id", "__label", *names).limit(sample).toPandas()
    rows = rows.sort_values(["__id", "__label", *names])
    return fit_rules(rows[names].to_numpy(float), rows["__label"].to_numpy(float), names)


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only the text is looked at: null and empty texts have the statistics of an empty text,
    repeated rows the same score each, other columns don't matter."""
    ident = F.col(f"`{id_col}`")
    wide = with_statistics(docs.select(ident.alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text", "stats")
    return wide.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("stats")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, all columns kept."""
    packed = unused(docs, "__stats")
    wide = with_statistics(docs, text_col, packed)
    return wide.where(model.score(F.col(packed)) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
