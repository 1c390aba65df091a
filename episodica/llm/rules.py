"""Quality rules: a learned decision list over document statistics, on DataFrame functions alone.

Every document gets statistics of its words, lines and symbols. Sequential covering learns an ordered list of rules from
the statistics of labelled documents: a rule is grown condition by condition (statistic <= or > threshold) by FOIL's
gain on two thirds of the rows, pruned from its end on the other third, and kept while it is worth it; the rows it
covers are then set aside. Each growing step is one aggregation over the labelled rows: a histogram of both classes over
the thresholds of every statistic, of a size that doesn't depend on the number of rows. The list is emitted as one Spark
expression, `CASE WHEN rule 1 THEN ... WHEN rule 2 ...`.

Cases: null and empty texts have no words and statistics of 0; without labelled rows of both classes the list is empty
and every document is kept by it; tied thresholds are taken in the order of names and values; contradicting labels of a
document count as rows of their own; repeated rows get equal results; other columns pass through untouched.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import cut, text_of, words

WINDOW = 8
THRESHOLDS = 40
MAX_RULES, MAX_CONDITIONS = 8, 3
MIN_COVERED, MIN_PRECISION = 5, 0.95
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_repeat_words(tokens: Column) -> Column:
    """Words within windows of eight words that the text has at least twice, the first included.

    Window hashes are sorted with their places; neighbours of equal hash and equal words are repeats, and every repeat
    covers the words that the one before it has not."""

    def count(w: Column) -> Column:
        last = F.size(w) - (WINDOW - 1)
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(w, h)).otherwise(F.lit(0)))

    def covered(w: Column, h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i"))))
        return let(placed, lambda s: let(places(w, s), total))

    def places(w: Column, s: Column) -> Column:
        pairs = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        same = F.filter(pairs, lambda p: (p["a"]["h"] == p["b"]["h"]) & (F.slice(w, p["a"]["i"], WINDOW) == F.slice(w, p["b"]["i"], WINDOW)))
        return F.array_sort(F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p["a"]["i"], p["b"]["i"])))))

    def total(r: Column) -> Column:
        before = F.concat(F.array(F.lit(-WINDOW)), F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))))
        gaps = F.zip_with(r, before, lambda x, y: F.least(x - y, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(tokens) > WINDOW, let(tokens, count)).otherwise(F.lit(0))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of every document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and further
    counts that rules may use."""
    text = text_of(text_col)
    t = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    w = words(F.col("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(v: Column) -> Column:
        distinct = F.size(F.array_distinct(v))
        return F.struct(F.size(v).alias("n_words"), n_repeat_words(v).alias("n_repeat_words"), distinct.alias("n_distinct"))

    counts = t.select(
        "doc_id",
        F.length("t").alias("n_chars"),
        F.length(F.translate("t", SPACES, "")).alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).alias("n_upper"),
        (F.length("t") - F.length(F.translate("t", "!?.,;:", ""))).alias("n_marks"),
        (F.length("t") - F.length(F.translate("t", "0123456789", ""))).alias("n_digits"),
        let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        let(w, of_words).alias("w"),
    )
    number = [F.col(c).cast("long").alias(c.rpartition(".")[2]) for c in
              ("w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "w.n_distinct", "l.n_lines", "n_chars", "n_upper", "n_marks", "n_digits")]
    return counts.select("doc_id", *number)


def features() -> dict[str, Column]:
    """What conditions are about: counts per word or character, as expressions over `statistics`."""
    n_words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / n_words,
        "symbols_per_word": F.col("n_symbols") / n_words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n_words,
        "distinct_share": F.col("n_distinct") / n_words,
        "words_per_line": F.col("n_words") / F.greatest("n_lines", F.lit(1)),
        "upper_share": F.col("n_upper") / chars,
        "mark_share": F.col("n_marks") / chars,
        "digit_share": F.col("n_digits") / chars,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, exprs: dict[str, Column]) -> Column:
        e = exprs[self.feature]
        return e > F.lit(self.threshold) if self.above else e <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, exprs: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.holds(exprs)
        return out

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a document that one covers is rejected, what none covers is kept."""

    rules: tuple[Rule, ...] = ()

    def verdict(self, exprs: dict[str, Column] | None = None) -> Column:
        exprs = exprs or features()
        out = F.when(F.lit(False), F.lit(False))
        for r in self.rules:
            out = out.when(r.holds(exprs), F.lit(False))
        return out.otherwise(F.lit(True))

    def matched(self, exprs: dict[str, Column] | None = None) -> Column:
        """The number of the first rule that covers a document, null if none does."""
        exprs = exprs or features()
        out = F.when(F.lit(False), F.lit(0))
        for k, r in enumerate(self.rules):
            out = out.when(r.holds(exprs), F.lit(k))
        return out


def histogram(rows: DataFrame, covered: Column, names: list[str]) -> dict[str, list[tuple[int, int, int]]]:
    """For every feature (bin, rejected, kept) counts of the growing rows that a rule so far covers."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"bin_{n}").alias("bin")) for n in names]))
    cells = rows.filter(covered & F.col("grow")).select("bad", pairs.alias("p")).groupBy("p.feature", "p.bin")
    out: dict[str, list[tuple[int, int, int]]] = {n: [] for n in names}
    for r in cells.agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect():
        out[r["feature"]].append((r["bin"], r["bad"], r["good"]))
    return out


def best_condition(cells: dict[str, list[tuple[int, int, int]]], cuts: dict[str, list[float]]) -> tuple[Condition, int, int] | None:
    """The condition of the highest FOIL gain, and the (rejected, kept) rows left under it."""
    best, most = None, 1e-9
    for name in sorted(cells):
        bad, good = sum(c[1] for c in cells[name]), sum(c[2] for c in cells[name])
        if not bad:
            continue
        start = math.log2(bad / (bad + good))
        low_bad = low_good = 0
        counts = {b: (x, y) for b, x, y in cells[name]}
        for k, threshold in enumerate(cuts[name]):
            x, y = counts.get(k, (0, 0))
            low_bad, low_good = low_bad + x, low_good + y
            for above, p, n in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                gain = p * (math.log2(p / (p + n)) - start) if p else 0.0
                if gain > most:
                    best, most = (Condition(name, above, threshold), p, n), gain
    return best


def learn(labelled: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> DecisionList:
    """A list of rules for rejection from `statistics` rows with a column `label` (1 keep, 0 reject)."""
    exprs = features()
    names = sorted(exprs)
    rows = labelled.filter(F.col("label").isNotNull()).select(
        (1 - F.col("label").cast("int")).alias("bad"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("third"), *[exprs[n].alias(n) for n in names]
    )
    quantiles = [i / THRESHOLDS for i in range(1, THRESHOLDS)]
    # Thresholds between the values of both classes, so that a rare class is seen too.
    asked = [F.percentile_approx(F.when(F.col("bad") == c, F.col(n)), quantiles, 2000).alias(f"{n}_{c}") for n in names for c in (0, 1)]
    found = rows.agg(F.count("bad").alias("rows"), *asked).first()
    cuts = {n: sorted({v for c in (0, 1) for v in found[f"{n}_{c}"] or []}) for n in names}
    if not found["rows"] or any(found[f"{names[0]}_{c}"] is None for c in (0, 1)):
        return DecisionList()

    def bin_of(n: str) -> Column:
        """How many thresholds lie below the value: value <= threshold k means bin <= k."""
        return F.aggregate(F.array(*map(F.lit, cuts[n])), F.lit(0), lambda a, t: a + (F.col(n) > t).cast("int"))

    binned = cut(rows.select("bad", (F.col("third") != 0).alias("grow"), *names, *[bin_of(n).alias(f"bin_{n}") for n in names]), "labelled")
    own = {n: F.col(n) for n in names}
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        while len(conditions) < max_conditions:
            got = best_condition(histogram(binned, left & Rule(tuple(conditions)).holds(own), names), cuts)
            if got is None:
                break
            conditions.append(got[0])
            if not got[2]:
                break
        if not conditions:
            break
        # Each shorter form of the rule on the rows it was not grown on, and on all rows.
        forms = [Rule(tuple(conditions[:k])) for k in range(1, len(conditions) + 1)]
        asked = [F.sum(F.when(f.holds(own) & where, v)).alias(f"{k}{tag}{cls}") for k, f in enumerate(forms)
                 for tag, where in (("p", ~F.col("grow")), ("a", F.lit(True))) for cls, v in (("b", F.col("bad")), ("g", 1 - F.col("bad")))]
        seen = binned.filter(left).agg(*asked).first().asDict()
        worth = lambda k, tag: ((seen[f"{k}{tag}b"] or 0), (seen[f"{k}{tag}g"] or 0))
        value = [(b - g) / (b + g) if b + g else -1.0 for b, g in (worth(k, "p") for k in range(len(forms)))]
        k = max(range(len(forms)), key=lambda i: (value[i], -i))
        b, g = worth(k, "a")
        if b < MIN_COVERED or b / (b + g) < MIN_PRECISION:
            break
        rules.append(forms[k])
        left = left & ~forms[k].holds(own)
    return DecisionList(tuple(rules))


def labelled_statistics(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    return stats.join(labels.select("doc_id", F.col(label).alias("label")), "doc_id")


def judged(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """The statistics with base_failed, kept and the number of the rule that rejects."""
    out = stats.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & rules.verdict()).withColumn("rule", rules.matched())
