"""Quality rules whose cutoffs are risk-controlled on labelled documents.

A rule rejects a document whose statistic is beyond a cutoff. The cutoffs of all rules are settled together, for
each stratum (language), on the labelled documents. A third of these (by the id's crc32) proposes a path: for each
budget of ``BUDGETS``, from none on, every rule takes the loosest cutoff of its grid that drops the most bad
documents with no more than that share of the good ones, if it drops a larger share of bad ones. The other two
thirds test the path: its steps are tried in order, and one is certified while the exact binomial test rejects that
all rules at once would drop more than ``risk`` of the good documents (which is to say, the Clopper-Pearson upper
bound lies below it). The fixed order of trying needs no correction, and the rules share one test; the level is
divided by the number of strata (Bonferroni). Of the certified steps the first that drops the most bad documents is
used. Languages whose good labels could not certify even a step that loses nothing are pooled into one stratum, with
the next smallest language where they are still too few. So with probability ``1 - level`` no stratum, the pool
being one, loses more than ``risk`` of its good documents by these rules. What the base rules reject is no part of that promise.

What reaches the driver are counts by stratum, label and step (of the grids, then of the paths): their number does not depend on
the number of documents.

Defined results: a null text has no words and fails the base rules; a null stratum is a stratum of its own; strata
beyond the ``MOST_STRATA`` with the most labels are one stratum;
a stratum without labels, and all where even together the labels are too few, have no cutoff and keep what the base rules keep; repeated label rows of a
document count once, the highest label; label rows without document and documents without label are left
out of the calibration; repeated rows give a row each; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import Workspace, in_fold
from casewright.llm.text_stats import with_stats

#: Strata with rules of their own at most: those with the most labels; all others are one stratum.
MOST_STRATA, OTHERS = 200, "(others)"
#: Shares of good documents that each rule may drop, step by step of the path.
BUDGETS = (0, 0.0005, 0.001, 0.0015, 0.002, 0.003, 0.004, 0.005, 0.0075, 0.01)


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[Column, np.ndarray]]:
    """Statistics as columns over ``text_stats.COUNTS``; large values are bad."""
    share = np.round(np.linspace(0.98, 0.02, 49), 4)
    return {
        "symbols": (_share("n_symbols", "word_chars"), share),
        "dup_lines": (_share("n_dup_lines", "n_lines"), share),
        "repeats": (_share("n_repeat_words", "n_words"), share),
        "capitals": (_share("n_upper", "word_chars"), share),
        "digits": (_share("n_digits", "word_chars"), share),
        "long_words": (_share("word_chars", "n_words"), np.round(np.geomspace(60, 5, 40), 3)),
        "short_words": (_share("n_words", "word_chars"), share),
    }


def at_most(x: int, n: int, p: float) -> float:
    """The probability that a binomial variable is ``x`` or less."""
    if n <= 0 or x >= n * p:  # then it is about a half or more, and no test rejects
        return 1.0 if n <= 0 or x >= n else float(_sum(x, n, p)) if n <= 10_000 else 1.0
    return float(_sum(x, n, p))


def _sum(x: int, n: int, p: float) -> float:
    """The terms from ``x`` down, as many as matter: they fall off faster than a normal tail."""
    k = np.arange(max(0, x - 100 - int(60 * math.sqrt(n * p))), x + 1)
    lg = np.frompyfunc(math.lgamma, 1, 1)
    log = math.lgamma(n + 1) - lg(k + 1.0).astype(float) - lg(n - k + 1.0).astype(float) + k * math.log(p) + (n - k) * math.log1p(-p)
    return float(min(1.0, np.exp(log).sum()))


def choose(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int | None:
    """The step of the grid to cut at, from counts of good and bad documents that each step alone rejects (last: kept by all)."""
    n_good, n_bad = int(good.sum()), int(bad.sum())
    lost, caught = np.cumsum(good[:-1]), np.cumsum(bad[:-1])
    best = None
    for k in range(len(lost)):
        if at_most(int(lost[k]), n_good, risk) > level:
            break
        if n_bad and caught[k] * n_good > lost[k] * n_bad and (best is None or caught[k] > caught[best]):
            best = k
    return best


def pools(n_good: dict[str, int], risk: float, level: float) -> dict[str, int]:
    """Each stratum's number, given its good labels for testing: its own where they could certify a cutoff, else that of a pool (0)."""
    level = level / max(1, len(n_good))
    need = math.ceil(math.log(level) / math.log1p(-risk))
    order = sorted(n_good, key=lambda s: (n_good[s], s))
    few = sum(n_good[s] < need for s in order)
    while 0 < few < len(order) and sum(n_good[s] for s in order[:few]) < need:
        few += 1
    return {s: 0 if i < few else i - few + 1 for i, s in enumerate(order)}


def proposed(good: dict[str, np.ndarray], bad: dict[str, np.ndarray]) -> list[dict[str, int]]:
    """The path: for each budget the grid step of each rule, from counts by rule of documents that each step alone rejects."""
    path: list[dict[str, int]] = []
    for budget in BUDGETS:
        at = {}
        for rule in good:
            n_good, n_bad = max(1, int(good[rule].sum())), int(bad[rule].sum())
            lost, caught = np.cumsum(good[rule][:-1]), np.cumsum(bad[rule][:-1])
            fit = np.flatnonzero((lost <= budget * n_good) & (caught * n_good > lost * n_bad))
            if len(fit):
                at[rule] = int(fit[np.argmax(caught[fit])])
        if at and at not in path:
            path.append(at)
    return path


def thresholds(stats: DataFrame, labels: DataFrame, risk: float, level: float) -> tuple[dict[str, dict[str, float]], Column]:
    """Cutoffs by stratum and rule, and the stratum as a column. ``stats``: doc_id, stratum, counts; ``labels``: doc_id, label."""
    marked = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = rules()
    joined = stats.join(marked, "doc_id").withColumn("tuning", in_fold("doc_id", 0, 3))
    own = [r["stratum"] for r in joined.groupBy("stratum").count().orderBy(F.desc("count"), "stratum").limit(MOST_STRATA).collect()]
    named = F.when(F.col("stratum").isin(*own), F.col("stratum")).otherwise(F.lit(OTHERS))
    joined = joined.withColumn("stratum", named)
    counted = [F.sum((F.col("label") == 1).cast("long")).alias("good"), F.sum((F.col("label") != 1).cast("long")).alias("bad")]
    # a rule's step: the number of grid cutoffs that are not below the statistic, so that the loosest that rejects is known
    steps = [F.struct(F.lit(name).alias("rule"), _step(value, grid).alias("step")) for name, (value, grid) in known.items()]
    found = joined.select("stratum", "tuning", "label", F.explode(F.array(*steps)).alias("s")).groupBy("stratum", "tuning", "s.rule", "s.step").agg(*counted).collect()
    n_good = {r["stratum"]: 0 for r in found}
    for r in found:
        n_good[r["stratum"]] += r["good"] * (not r["tuning"] and r["rule"] == next(iter(known)))
    pool = pools(n_good, risk, level)
    counts = {p: tuple({name: np.zeros(len(grid) + 1, np.int64) for name, (_, grid) in known.items()} for _ in range(2)) for p in set(pool.values())}
    for r in found:
        if r["tuning"]:
            for k, kind in enumerate(("good", "bad")):
                counts[pool[r["stratum"]]][k][r["rule"]][r["step"]] += r[kind]
    paths = {p: proposed(*c) for p, c in counts.items()}
    step = F.lit(None).cast("int")
    for stratum, p in pool.items():
        rejected = F.lit(len(paths[p]))
        for k in reversed(range(len(paths[p]))):
            by_any = [known[name][0] > float(known[name][1][at]) for name, at in paths[p][k].items()]
            rejected = F.when(F.greatest(*by_any, F.lit(False)), F.lit(k)).otherwise(rejected)
        step = F.when(F.col("stratum") == stratum, rejected).otherwise(step)
    tested = joined.filter("not tuning").groupBy("stratum", step.alias("step")).agg(*counted).collect() if pool else []
    out: dict[str, dict[str, float]] = {}
    for p, path in paths.items():
        good, bad = np.zeros((2, len(path) + 1), np.int64)
        for r in tested:
            if pool[r["stratum"]] == p:
                good[r["step"]] += r["good"]
                bad[r["step"]] += r["bad"]
        k = choose(good, bad, risk, level / max(1, len(n_good)))
        if k is not None:
            for stratum in (s for s in pool if pool[s] == p):
                out[stratum] = {name: float(known[name][1][at]) for name, at in path[k].items()}
    return out, named


def _step(value: Column, grid: np.ndarray) -> Column:
    """How many cutoffs, of the loosest first, are at or above the value: at that step it is rejected first."""
    ascending = F.array(*[F.lit(float(g)) for g in grid])
    return F.size(F.filter(ascending, lambda g: g >= value))


def apply_rules(df: DataFrame, labels: DataFrame, ws: Workspace, risk: float = 0.01, level: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", min_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules``."""
    stats = with_stats(df, text_col, {id_col: "doc_id", stratum_col: "stratum"})
    stats = ws.keep(stats.withColumn("stratum", F.coalesce(F.col("stratum").cast("string"), F.lit(""))), "stats")
    cuts, named = thresholds(stats, labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("label")), risk, level)
    failed = []
    for name, (value, _) in rules().items():
        own = F.lit(False)
        for stratum, by_rule in cuts.items():
            if name in by_rule:
                own = own | ((named == stratum) & (value > by_rule[name]))
        failed.append(F.when(own, F.lit(name)))
    out = stats.withColumn("failed_rules", F.array_compact(F.array(*failed)))
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "failed_rules")
