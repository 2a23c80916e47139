"""Quality classifier: a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(rest: Column, chars: str, n: Column) -> Column:
    """Share of ``n`` characters that are among ``chars``, none of which is missing from ``rest``."""
    return (F.length(rest) - F.length(F.translate(rest, chars, ""))) / n


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; they use nothing but the text. A null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    rest = F.regexp_replace(text, "[a-z ]+", "")  # most of a text is neither, and counting in the rest is cheap
    words = F.split(text, "[ \n\t\r]")
    lines = F.split(text, "\n")
    n_words = F.size(words).cast("double")
    return {
        "log_words": F.log2(n_words),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "chars_a_word": n / n_words,
        "chars_a_line": F.log2(n / F.size(lines)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "upper": _share(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", n),
        "digits": _share(rest, "0123456789", n),
        "stops": _share(rest, ".,;:", n),
        "shouts": _share(rest, "!?", n),
        "symbols": _share(rest, "#$%&*+<=>@[\\]^_`{|}~", n),
        "bars": _share(rest, "|\t", n),
    }


def _tree(x: np.ndarray, residual: np.ndarray, bins: np.ndarray, depth: int, least: int) -> list[tuple]:
    """Paths of one least-squares tree: conjunctions of (feature, is above, bin)."""
    paths: list[tuple] = []

    def grow(rows: np.ndarray, path: tuple) -> None:
        if path:
            paths.append(path)
        if len(path) >= depth or len(rows) < 2 * least:
            return
        best = (1e-12, -1, -1)
        r, total = residual[rows], residual[rows].sum()
        for j in range(x.shape[1]):
            at = x[rows, j]
            n = np.cumsum(np.bincount(at, minlength=bins[j] + 1))[:-1]
            s = np.cumsum(np.bincount(at, r, minlength=bins[j] + 1))[:-1]
            ok = (n >= least) & (len(rows) - n >= least)
            if ok.any():
                m = np.maximum(n, 1)
                gain = np.where(ok, s**2 / m + (total - s) ** 2 / np.maximum(len(rows) - n, 1) - total**2 / len(rows), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        _, j, k = best
        if j < 0:
            return
        above = x[rows, j] > k
        grow(rows[~above], (*path, (j, False, k)))
        grow(rows[above], (*path, (j, True, k)))

    grow(np.arange(len(residual)), ())
    return paths


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, k in rule:
        out &= (x[:, j] > k) == above
    return out


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 200) -> tuple[float, np.ndarray]:
    """L1-penalised logistic weights by accelerated proximal gradient."""
    n, m = a.shape
    z = np.hstack([np.ones((n, 1), np.float32), a])
    y = y.astype(np.float32)
    v = np.ones(m + 1, np.float32) / np.float32(np.sqrt(m + 1))
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = np.float32(4 * n / max(float(v @ (z.T @ (z @ v))), 1e-9) / 1.05)
    w = u = np.zeros(m + 1, np.float32)
    t = 1.0
    for _ in range(steps):
        g = z.T @ (1 / (1 + np.exp(-(z @ u))) - y) / n
        new = u - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * np.float32(penalty), 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + np.float32((t - 1) / s) * (new - w), new, s
    return float(w[0]), w[1:]


class RuleModel:
    """Weighted rules: score = 1 / (1 + exp(-(bias + sum of the weights of rules that hold)))."""

    def __init__(self, names: list[str], bias: float, rules: list[tuple[float, tuple]]):
        self.names, self.bias, self.rules = names, bias, rules

    def column(self, stats: dict[str, Column]) -> Column:
        """The compiled rules as one column expression."""
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            held = None
            for j, above, cut in rule:
                c = stats[self.names[j]] > F.lit(cut) if above else stats[self.names[j]] <= F.lit(cut)
                held = c if held is None else held & c
            total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 25, depth: int = 3, max_bins: int = 64, penalties=(0.0003, 0.001, 0.003, 0.01)) -> RuleModel:
    """Grow boosted trees, take their paths as rules and weigh the rules by lasso logistic regression.

    The penalty is the one with the least log loss on a fixed fifth of the rows. Without
    rows of both labels the model is the labels' mean alone.
    """
    mean = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(mean / (1 - mean)))
    if len(y) < 20 or y.min() == y.max():
        return RuleModel(names, prior, [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    bins = np.array([len(c) for c in cuts])
    score, rules = np.full(len(y), prior), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        paths = _tree(binned, y - p, bins, depth, max(5, len(y) // 500))
        parents = {path[:i] for path in paths for i in range(len(path))}
        for path in paths:
            rules.setdefault(tuple(sorted(path)), None)
            if path not in parents:
                rows = _holds(binned, path)
                w = (p * (1 - p))[rows].sum()
                score[rows] += 0.3 * np.clip((y - p)[rows].sum() / max(w, 1e-6), -4, 4)
    held: dict[bytes, tuple] = {}  # of rules that hold for the same rows, the shortest
    for r in sorted(rules, key=lambda r: (len(r), r)):
        held.setdefault(np.packbits(_holds(binned, r)).tobytes(), r)
    rules = list(held.values())
    a = np.column_stack([_holds(binned, r) for r in rules]).astype(np.float32)
    test = np.arange(len(y)) % 5 == 0
    best = (np.inf, penalties[0])
    for penalty in penalties:
        b, w = _lasso(a[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(b + a[test] @ w))), 1e-6, 1 - 1e-6)
        best = min(best, (float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()), penalty))
    b, w = _lasso(a, y, best[1])
    return RuleModel(names, b, [(float(v), tuple((j, above, float(cuts[j][k])) for j, above, k in r)) for v, r in zip(w, rules, strict=True) if abs(v) > 1e-9])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 10_000) -> RuleModel:
    """Fit on at most ``max_rows`` labelled rows that are not held out, picked by a hash of the id.

    Labels other than 0 and 1 are left out; equal rows of labels count once. The picked labels, of
    bounded number, are broadcast to the documents. Of documents that repeat an id the one of the least text hash counts, so
    statistics of at most ``max_rows`` rows reach the driver.
    """
    picked = labels.select(F.col(id_col).cast("long").alias("key"), F.col(label_col).cast("double").alias("y"))
    picked = picked.where(F.col("y").isin(0.0, 1.0) & F.col("key").isNotNull() & ~held_out(F.col("key"))).distinct()
    picked = picked.orderBy(F.xxhash64("key"), "key", "y").limit(max_rows)
    stats = statistics(F.col(text_col))
    rows = docs.withColumn("key", F.col(id_col).cast("long")).select("key", text_col).join(F.broadcast(picked), "key")
    one = F.min(F.struct(F.xxhash64(text_col).alias("__hash"), *[c.alias(k) for k, c in stats.items()]))
    got = rows.groupBy("key", "y").agg(one.alias("one")).select("key", "y", *[f"one.{k}" for k in stats]).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    return fit(got[list(stats)].to_numpy(float), got["y"].to_numpy(float), list(stats))


def _scored(docs: DataFrame, model: RuleModel, text_col: str) -> DataFrame:
    """``docs`` with a column __score. The statistics are one projection, which computes what they share once;
    a generated row keeps the optimiser from copying them into every rule that uses them."""
    names = {k: f"__stat_{k}" for k in model.names}
    got = docs.withColumn("__stats", F.struct(*[c.alias(names[k]) for k, c in statistics(F.col(text_col)).items()]))
    got = got.select("*", F.inline(F.array("__stats"))).drop("__stats")
    return got.withColumn("__score", model.column({k: F.col(c) for k, c in names.items()})).drop(*names.values())


def classify(docs: DataFrame, model: RuleModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    One pass without shuffle or Python. Null and empty texts are scored as an empty text;
    a null id stays null; repeated rows are scored alike; other columns are ignored; an
    empty table gives no rows.
    """
    got = _scored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model, "text")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows that the model does not reject, with the columns they came with."""
    return _scored(docs, model, text_col).where(F.col("__score") >= threshold).drop("__score")
