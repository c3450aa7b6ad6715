"""Quality rules: learned decision lists over text statistics, in DataFrame expressions only.

Each document's statistics are array and string functions of its text. A decision list is
learned by sequential covering from the labelled rows: their statistics are cut at
quantiles into a few bins, one grouped aggregation counts good and bad rows in each cell of
bins (at most 6**5 cells, whatever the number of rows), and from these counts rules are
grown, condition by condition, and pruned on held-back cells. The list becomes an ordered
``CASE WHEN``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.shared import durable

#: Between words: the blank and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: What fails without a rule: fewer words, or a larger share of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Quantiles of the good and of the bad labelled rows that become thresholds: five for each feature.
GOOD_QUANTILES, BAD_QUANTILES = (0.005, 0.995), (0.25, 0.5, 0.75)
FEATURES = ("mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)


#: A rule rejects what meets all its conditions; a decision list is a sequence of rules.
Rule = tuple[Condition, ...]


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more: windows sorted by hash, the repeated ones' positions sorted, their cover summed."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    )

    def repeated(s: Column) -> Column:
        return F.transform(
            F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]
        )

    def cover(p: Column) -> Column:
        steps = F.transform(p, lambda at, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - at, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    return F.when(n >= 3, _once(F.array_sort(_once(F.array_sort(windows), repeated)), cover)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the FEATURES) of each row.

    A null text has no words. Other columns aren't read; a doc_id may be null or repeated.
    """
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    parts = text.select(
        "doc_id",
        "text",
        F.filter(F.split("text", SPACES), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counts = parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda total, w: total + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    words = F.greatest("n_words", F.lit(1))
    return counts.select(
        "*",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / words).alias("symbol_ratio"),
        (F.col("n_dup_lines") / words).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / words).alias("repeat_ratio"),
        (F.col("n_upper") / F.greatest("word_chars", F.lit(1))).alias("upper_ratio"),
    )


def cells(stats: DataFrame, labels: DataFrame) -> tuple[dict[str, list[float]], list[tuple]]:
    """The thresholds of each feature, and (bins, held back, good, bad) for each cell of the labelled rows that don't fail the base.

    A cell's bin of a feature is the number of thresholds below its value. A doc_id with
    several labels takes the lowest; null labels and ids don't count.
    """
    quality = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = stats.filter(~F.col("base_failed")).select("doc_id", *FEATURES).join(quality, "doc_id")
    good = F.col("quality") >= 1

    def quantiles(name: str) -> list[Column]:
        ask = ((good, GOOD_QUANTILES), (~good, BAD_QUANTILES))
        return [F.percentile_approx(F.when(which, F.col(name)), list(at), F.lit(10000)) for which, at in ask]

    found = rows.agg(*[c.alias(f"{name}_{k}") for name in FEATURES for k, c in enumerate(quantiles(name))]).first()
    cuts = {name: sorted({v for k in (0, 1) for v in found[f"{name}_{k}"] or []}) for name in FEATURES}

    def bin_of(name: str) -> Column:
        return sum((F.when(F.col(name) > F.lit(c), 1).otherwise(0) for c in cuts[name]), F.lit(0)).cast("int").alias(name)

    held = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held")
    table = rows.select(*[bin_of(name) for name in FEATURES], held, good.alias("good")).groupBy(*FEATURES, "held")
    counted = table.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect()  # at most 2 * 6**5 rows
    return cuts, [(tuple(r[name] for name in FEATURES), r["held"], r["good"], r["bad"]) for r in counted]


def learn(cuts: dict[str, list[float]], table: Iterable[tuple], most_rules: int = 16, least_precision: float = 0.9, least_bad: int = 5) -> list[Rule]:
    """Sequential covering over counted cells: rules that reject bad rows, in order.

    A rule grows by the condition of the highest information gain until it covers no good
    row or no condition helps, loses its last conditions as long as that raises its worth
    on held-back cells, and stays if of all it covers ``least_precision`` are bad, in the
    grown and the held-back cells together, and at least ``least_bad`` are. Ties go to the
    earlier feature, then the lower threshold. Without bad rows there are no rules.
    """
    tests = [(f, above, k) for f, name in enumerate(FEATURES) for k in range(len(cuts[name])) for above in (True, False)]

    def meets(bins: tuple, test: tuple) -> bool:
        f, above, k = test
        return (bins[f] > k) == above

    def totals(rows: list[tuple]) -> tuple[int, int]:
        return sum(r[2] for r in rows), sum(r[3] for r in rows)

    left = [r for r in table]
    rules: list[Rule] = []
    while len(rules) < most_rules:
        grow, hold = [r for r in left if not r[1]], [r for r in left if r[1]]
        good, bad = totals(grow)
        rule: list[tuple] = []
        covered = grow
        while good and bad:
            before, best = math.log2(bad / (good + bad)), (1e-9, None)
            for test in tests:
                g, b = totals([r for r in covered if meets(r[0], test)])
                if b and (gain := b * (math.log2(b / (g + b)) - before)) > best[0] + 1e-9:
                    best = (gain, test)
            if best[1] is None:
                break
            rule.append(best[1])
            covered = [r for r in covered if meets(r[0], best[1])]
            good, bad = totals(covered)
        if not rule:
            break

        def worth(part: list[tuple]) -> float:
            g, b = totals([r for r in hold if all(meets(r[0], t) for t in part)])
            return (b - g) / (b + g) if b + g else -1.0

        while len(rule) > 1 and worth(rule[:-1]) > worth(rule):
            rule.pop()
        good, bad = totals([r for r in left if all(meets(r[0], t) for t in rule)])
        if bad < least_bad or bad < least_precision * (good + bad):
            break
        rules.append(tuple(Condition(FEATURES[f], above, cuts[FEATURES[f]][k]) for f, above, k in rule))
        left = [r for r in left if not all(meets(r[0], t) for t in rule)]
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """Whether a row stays, and the number of the rule that rejects it (from 1; null if none), as ordered conditional expressions."""
    keep, which = None, None
    for k, rule in enumerate(rules, 1):
        meets = rule[0].column()
        for condition in rule[1:]:
            meets = meets & condition.column()
        keep = F.when(meets, False) if keep is None else keep.when(meets, False)
        which = F.when(meets, k) if which is None else which.when(meets, k)
    return (F.lit(True), F.lit(None).cast("int")) if keep is None else (keep.otherwise(True), which)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of each row of ``docs``, ``base_failed``, ``kept`` and the number of the ``rule`` that rejected it.

    ``labels`` (doc_id, quality) teach the list. Without labels of both kinds only the
    base rejects. An empty table gives an empty result.
    """
    stats = durable(statistics(docs))
    kept, rule = verdict(learn(*cells(stats, labels)))
    base = F.col("base_failed")
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~base & kept).alias("kept"), F.when(~base, rule).alias("rule")
    )
