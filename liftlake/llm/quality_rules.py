"""Quality rules: a learned decision list over text statistics.

Statistics are DataFrame expressions over the whole text. Rules are learned by
sequential covering: a rule is a conjunction of thresholds, grown by FOIL gain
on two thirds of the still uncovered labelled rows and pruned on the last third;
rules are added while they reject with ``MIN_PRECISION`` on the pruning rows.
The list becomes one ordered ``when`` expression: the first rule that holds
gives the verdict.

Learning reads at most ``SAMPLE_ROWS`` labelled rows (a sample by keyed hash,
the same for every run); statistics and verdicts cover every document.

Defined cases: a null text counts as empty, has no words and fails the base
rule; null labels are not learned from; repeated labels of one document are
averaged, ties reject; without labelled rows, or with labels of one kind, the
list is empty and only the base rule acts; null ids and repeated rows get a
verdict like any other; other columns pass through ``with_statistics``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftlake.llm.common import let, stored, words_of

# Fixed values of the base rule's contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SAMPLE_ROWS = 20_000
MIN_PRECISION = 0.97
MIN_COVERED = 8           # growing rows that a rule must cover
MAX_RULES = 12
MAX_CONDITIONS = 4
CUTS = 64                 # thresholds tried per feature, at quantiles of the growing rows

FEATURES = ("n_words", "mean_word", "symbols_per_word", "repeat_share", "dup_line_share", "upper_share", "marks_per_word")


def _blank_line(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) == ""


def _dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~_blank_line(x))
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Each window becomes one long: as many bits of its 64-bit hash as its
    position leaves free, then the position. Sorted longs bring equal windows
    together; neighbours that agree in the hash mark both positions."""
    def count(a: Column) -> Column:
        n = F.size(a) - 2
        bits = F.length(F.bin(n))                                       # room for positions 0..n-1
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.call_function(
            "shiftleft", F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)), bits).bitwiseOR(i.cast("long")))

        def places(s: Column) -> Column:
            def same(x, y):
                return F.coalesce(F.call_function("shiftright", x.bitwiseXOR(y), bits) == 0, F.lit(False))
            marked = F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1)))
            return F.sort_array(F.transform(marked, lambda x: x.bitwiseAND(mask)))

        def covered(p: Column) -> Column:
            # each marked window covers 3 words, less what the next one covers too
            steps = F.transform(p, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, j + 1) - x, F.lit(3).cast("long"))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda t, x: t + x)

        return let(let(F.sort_array(windows), places), covered)

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(count(words))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs(text, ...)`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the features."""
    text = F.coalesce("text", F.lit(""))
    length = F.length(text)
    two = let(words_of(F.col("text")), lambda a: F.struct(F.size(a).cast("long").alias("n"), _repeat_words(a).alias("r")))
    base = docs.withColumns({
        "_words": two,
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _dup_lines(text),
        "_lines": (F.size(F.split(text, "\n"))).cast("long"),
        "_upper": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        "_marks": (length - F.length(F.translate(text, "!?", ""))).cast("long"),
    })
    words = F.greatest(F.col("n_words"), F.lit(1))
    return base.withColumns({"n_words": F.col("_words.n"), "n_repeat_words": F.col("_words.r")}).withColumns({
        "mean_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.col("_lines"),
        "upper_share": F.col("_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "marks_per_word": F.col("_marks") / words,
    }).drop("_words", "_lines", "_upper", "_marks")


def base_failed() -> Column:
    """The fixed rule: too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


@dataclass(frozen=True)
class Condition:
    """``feature <= cut`` or ``feature > cut``."""

    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.cut) == self.above

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.cut) if self.above else F.col(self.feature) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, rows: list[dict]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _bad(rows: list[dict]) -> int:
    return sum(r["bad"] for r in rows)


def _cuts(rows: list[dict], feature: str) -> list[float]:
    values = sorted({r[feature] for r in rows})
    if len(values) < 2:
        return []
    step = max(1, len(values) // CUTS)
    # midway between neighbours: a cut never falls on an observed value
    return [(values[i] + values[i + 1]) / 2 for i in range(0, len(values) - 1, step)]


def _grow(rows: list[dict]) -> Rule:
    """Add the condition of largest FOIL gain until only bad rows are covered."""
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        p, n = _bad(rows), len(rows)
        if p in (0, n):
            break
        best, best_gain = None, 1e-9
        for feature in FEATURES:
            ordered = sorted(rows, key=lambda r: r[feature])
            cuts, at, below, below_bad = _cuts(rows, feature), 0, 0, 0
            for cut in cuts:
                while at < n and ordered[at][feature] <= cut:
                    below, below_bad, at = below + 1, below_bad + ordered[at]["bad"], at + 1
                for above, m, q in ((False, below, below_bad), (True, n - below, p - below_bad)):
                    if q and m >= MIN_COVERED:
                        gain = q * (log2(q / m) - log2(p / n))
                        if gain > best_gain:
                            best, best_gain = Condition(feature, above, cut), gain
        if best is None:
            break
        rule, rows = (*rule, best), [r for r in rows if best.holds(r)]
    return rule


def _worth(rule: Rule, rows: list[dict]) -> float:
    """(bad - good) / covered on the pruning rows."""
    covered = _covers(rule, rows)
    return (2 * _bad(covered) - len(covered)) / len(covered) if covered else -1.0


def _prune(rule: Rule, rows: list[dict]) -> Rule:
    """Drop final conditions while the worth on the pruning rows does not fall."""
    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if _worth(rule[:k], rows) >= _worth(best, rows):
            best = rule[:k]
    return best


def learn_rules(rows: list[dict]) -> list[Rule]:
    """Sequential covering over labelled statistics: FEATURES, ``bad`` (0/1) and ``part`` (0..2; 2 prunes)."""
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        grow, prune = [r for r in rows if r["part"] < 2], [r for r in rows if r["part"] == 2]
        if not _bad(grow) or not prune:
            break
        rule = _prune(_grow(grow), prune)
        covered, checked = _covers(rule, grow), _covers(rule, prune)
        precise = bool(rule) and checked and _bad(checked) >= MIN_PRECISION * len(checked) and _bad(covered) >= MIN_PRECISION * len(covered)
        if not precise or len(covered) < MIN_COVERED:
            break
        rules.append(rule)
        rows = [r for r in rows if not all(c.holds(r) for c in rule)]
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[dict]:
    """At most SAMPLE_ROWS labelled documents with their statistics, the base rule's rejects left out."""
    by_doc = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    order = F.xxhash64(F.lit("quality-rules"), "doc_id")
    chosen = by_doc.orderBy(order, "doc_id").limit(SAMPLE_ROWS).withColumnsRenamed({"doc_id": "_id"})
    # Stored: else the filter on statistics moves below the join and every document is measured.
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")), "labelled-sample")
    rows = with_statistics(sample).filter(~base_failed()).select(
        *[F.col(f).cast("double") for f in FEATURES], (F.col("q") <= 0.5).cast("int").alias("bad"),
        F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)).cast("int").alias("part"), order.alias("o"), "doc_id")
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: (r["o"], r["doc_id"]))


def verdict(rules: list[Rule]) -> Column:
    """Name of the first rule that holds, else null: one ordered ``when``."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(" AND ".join(map(str, rule)))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with statistics, base_failed, rejected_by and kept."""
    rules = learn_rules(labelled_sample(docs, labels))
    return (with_statistics(docs).withColumn("base_failed", base_failed())
            .withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(verdict(rules)))
            .withColumn("kept", F.col("rejected_by").isNull()))
