"""Quality rules as a learned decision list (operator 8).

Everything on the executors is DataFrame functions: one pass of array and string
expressions gives a document's statistics, without a shuffle.  The list itself
is learned on the driver by sequential covering over a bounded sample of
labelled rows and comes back as one CASE expression, so it reads like the rules
it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Labelled rows that the list is learned from at most (those with the smallest hash of their id).
SAMPLE = 20_000
#: A rule must reject at least so many rows of its pruning half, at this precision.
MIN_COVER, MIN_PRECISION = 4, 0.95
#: Conditions of a rule, rules of the list, cut points tried for a statistic.
MAX_CONDITIONS, MAX_RULES, CUTS = 4, 12, 64
BLANK = r"[\x20\x09-\x0D]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "line_words")


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and the five counts of ``COUNTS``, over whole texts.

    A null text has no words and counts zero throughout.  Columns of these names
    in ``docs`` are replaced.  Windows of three words are compared by 64-bit
    hashes, which take a fraction of their strings' memory.  The steps are
    separate projections, so that no array is made twice.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, BLANK + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = F.when(
        F.size("_w") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("_w") - 3),
            lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    at = F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    twice = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.size("_s") - 1),
            lambda j: F.when(
                F.coalesce(F.get("_s", j)["g"] == F.get("_s", j - 1)["g"], F.lit(False))
                | F.coalesce(F.get("_s", j)["g"] == F.get("_s", j + 1)["g"], F.lit(False)),
                F.get("_s", j)["i"],
            ),
        ),
        lambda p: p.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p, p + 1, p + 2)))))
    return (
        docs.drop(*COUNTS)
        .withColumn("_w", words)
        .withColumns(
            {
                "n_words": F.size("_w").cast("long"),
                "word_chars": F.length(F.array_join("_w", "")).cast("long"),
                "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
                "_l": lines,
                "_g": grams,
            }
        )
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(at)))
        .withColumn("n_repeat_words", F.when(F.col("_s").isNotNull(), covered).otherwise(0).cast("long"))
        .drop("_w", "_l", "_g", "_s")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(text_col: str = "text") -> dict[str, Column]:
    """The statistics that conditions may test, from the counts and the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    lines = F.size(F.split(text, "\n"))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        "digit_share": F.regexp_count(text, F.lit("[0-9]")) / chars,
        "mark_share": F.regexp_count(text, F.lit("[!?]")) / words,
        "line_words": F.col("n_words") / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, FEATURES.index(self.feature)]
        return value > self.cut if self.above else value <= self.cut

    def column(self) -> Column:
        value = F.col(f"_f_{self.feature}")
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Adds the condition of the largest information gain until no good row is covered."""
    rule: Rule = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 1e-9
        for k, name in enumerate(FEATURES):
            values = np.unique(x[inside, k])
            if len(values) < 2:
                continue
            middles = (values[1:] + values[:-1]) / 2
            if len(middles) > CUTS:
                middles = middles[np.linspace(0, len(middles) - 1, CUTS).astype(int)]
            for cut in middles:
                for above in (True, False):
                    c = Condition(name, above, float(cut))
                    got = inside & c.holds(x)
                    p, n = (got & bad).sum(), (got & ~bad).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = c, g
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The leading conditions of ``rule`` that do best on rows it was not grown on."""
    def worth(r: Rule) -> float:
        got = _covers(r, x)
        p, n = (got & bad).sum(), (got & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn(x: np.ndarray, bad: np.ndarray, halves: np.ndarray) -> list[Rule]:
    """The ordered rules that reject; rows they leave are kept.

    ``halves`` says which rows a rule is grown on; the others prune it and
    decide whether it is good enough.  No rows, or rows of one kind only, give
    an empty list.
    """
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES:
        grow, judge = left & halves, left & ~halves
        if not (grow & bad).any() or not (grow & ~bad).any():
            break
        rule = _grow(x[grow], bad[grow])
        if not rule:
            break
        rule = _prune(rule, x[judge], bad[judge])
        got = _covers(rule, x) & judge
        hit = (got & bad).sum()
        if hit < MIN_COVER or hit < MIN_PRECISION * got.sum():
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, verdict and half of at most ``SAMPLE`` labelled rows.

    Null ids and labels are left out.  Of labels that repeat an id the smallest
    counts, of texts that repeat one the smallest too, so there is one row an id.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
        .where("_id IS NOT NULL AND _label IS NOT NULL")
        .groupBy("_id").agg(F.min("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(SAMPLE)
    )
    # the join has a row for each row of documents; an id that repeats is one row again before anything is collected
    rows = docs.select(F.col(id_col).alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id").agg(F.first("_label").alias("_label"), F.min("text").alias("text"))
    # a filter on the counts would be pushed below the steps that make them, and make them anew
    rows = with_counts(rows).withColumn("_failed", base_failed())
    got = rows.select("_failed", "_label", (F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(3)) > 0).alias("half"), *[c.alias(f"f{k}") for k, c in enumerate(features().values())]).collect()
    got = [r[1:] for r in got if not r[0]]
    x = np.array([r[2:] for r in got], float).reshape(len(got), len(FEATURES))
    return x, np.array([r[0] == 0 for r in got], bool), np.array([r[1] for r in got], bool)


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression over the ``_f_`` columns."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test &= c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with its counts, ``base_failed`` and ``kept``.

    Empty and null texts fail the base rules.  Rows are judged one by one, so
    repeated rows get the same verdict.  Columns named as the results are
    replaced, all others stay as they are, whatever their names.
    """
    used = {c.feature for r in rules for c in r}
    results = [*COUNTS, "base_failed", "kept"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = with_counts(packed).withColumns({f"_f_{k}": v for k, v in features().items() if k in used} or {"_f_": F.lit(0)})
    judged = counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return judged.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in results], *results)


def rules_for(spark: SparkSession, sf_dir: str) -> list[Rule]:
    return learn(*labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, rules_for(spark, sf_dir)).select("doc_id", *COUNTS, "base_failed", "kept")
