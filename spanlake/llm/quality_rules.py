"""Quality rules: a learned decision list over text statistics.

Everything here is DataFrame work. Statistics are one expression per row.
Sequential covering runs on a bounded sample of labelled rows whose statistics
are binned at approximate quantiles and written once: to grow a rule, one
aggregation gives the labels per (statistic, bin) of the rows still covered, a
few hundred numbers from which the driver picks the threshold with the best
FOIL gain; pruning counts the prefixes of the rule on rows kept apart. The
result is an ordered list of threshold conjunctions, applied as one CASE WHEN.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, held_out, let, materialize

#: Characters that count as symbols (fixed values).
SYMBOLS = r"[#*$%&|<>]"

#: Ratios that the rules may test, by name, from the base statistics s.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "distinct_share", "digit_share", "words_per_line")


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more in the array, the first find included.

    Linear when no window repeats (the usual case); else the windows are sorted
    once with their positions, so long texts cost n log n.
    """
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))

    def twice(s: Column) -> Column:
        same = lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
        first = lambda e, k: F.when(k > 0, F.coalesce(same(e, k), F.lit(False))).otherwise(F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
        return F.array_sort(F.transform(F.filter(s, first), lambda e: e["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ordered, lambda s: covered(twice(s))))

    return let(windows, count)


def statistics(text: Column) -> Column:
    """Struct of the statistics of a text; null counts as a text without words.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines
    with a word that equal an earlier line), n_repeat_words, and the plain
    counts that the ratios of `features` need.
    """
    clean = F.coalesce(text, F.lit(""))

    def of(x: Column) -> Column:
        words, lines = x["words"], x["lines"]
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            x["n_symbols"].alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            x["n_upper"].alias("n_upper"),
            x["n_bang"].alias("n_bang"),
            x["n_digit"].alias("n_digit"),
        )

    parts = F.struct(
        F.regexp_extract_all(clean, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(clean, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
        F.regexp_count(clean, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(clean, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(clean, F.lit("!")).cast("long").alias("n_bang"),
        F.regexp_count(clean, F.lit("[0-9]")).cast("long").alias("n_digit"),
    )
    return let(parts, of)


def base_failed(s: Column) -> Column:
    """Too short, or over half of the words in repeated windows."""
    return (s["n_words"] < 50) | (s["n_repeat_words"] * 100 > s["n_words"] * 50)


def features(s: Column) -> Column:
    """Struct of FEATURES as doubles, from a struct of statistics; shares of nothing are 0."""
    over = lambda a, b: F.when(s[b] > 0, s[a].cast("double") / s[b]).otherwise(F.lit(0.0))
    values = {
        "n_words": s["n_words"].cast("double"),
        "mean_word": over("word_chars", "n_words"),
        "symbol_share": over("n_symbols", "word_chars"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
        "repeat_share": over("n_repeat_words", "n_words"),
        "upper_share": over("n_upper", "word_chars"),
        "bang_share": over("n_bang", "word_chars"),
        "distinct_share": over("n_distinct", "n_words"),
        "digit_share": over("n_digit", "word_chars"),
        "words_per_line": over("n_words", "n_lines"),
    }
    return F.struct(*[values[k].alias(k) for k in FEATURES])


@dataclass(frozen=True)
class Test:
    """feature >= cut, or feature < cut."""

    feature: str
    at_least: bool
    cut: float

    def on(self, f: Column) -> Column:
        return f[self.feature] >= self.cut if self.at_least else f[self.feature] < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut:.6g}"


Rule = tuple[Test, ...]


@dataclass(frozen=True)
class Learner:
    """Parameters of sequential covering."""

    max_labelled: int = 100_000  # labelled documents that rules are fitted on, at most: those of least hash
    bins: int = 32  # thresholds tried per statistic and label, at most
    max_rules: int = 12
    max_tests: int = 4
    min_covered: int = 4  # bad rows that a rule must cover
    min_precision: float = 0.97  # on the rows that rules grow on, and on those kept apart for pruning


def all_of(rule: Rule, f: Column) -> Column:
    out = F.lit(True)
    for test in rule:
        out = out & test.on(f)
    return out


def _best(counts: dict, cuts: dict[str, list[float]], bad: int, good: int) -> tuple[float, Test] | None:
    """The test with the most FOIL gain; counts: bad and good rows by (feature, bin). Ties: first feature, least cut, '<'."""
    found, info = None, math.log2(bad / (bad + good))
    for feature, edges in cuts.items():
        below_bad = below_good = 0
        for k, cut in enumerate(edges):
            b, g = counts.get((feature, k), (0, 0))
            below_bad, below_good = below_bad + b, below_good + g
            for at_least, p, n in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                if p and p + n < bad + good:
                    gain = p * (math.log2(p / (p + n)) - info)
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                        found = gain, Test(feature, at_least, cut)
    return found


def fitting_labels(labels: DataFrame, how: Learner = Learner()) -> DataFrame:
    """(id, bad) of the documents that rules are fitted on: max_labelled at most, those of least hash.

    Rows with a null label or doc_id, and ids that crc32(doc_id) mod 4 = 2
    holds out, are left out. A doc_id with several labels counts once, and as
    bad if any of them says so.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    once = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.min("quality") == 0).cast("int").alias("bad"))
    return once.orderBy(F.xxhash64("id"), "id").limit(how.max_labelled)


def labelled_statistics(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """(bad, prune, f) of the chosen documents that the base rules pass, from stats (doc_id, s). Repeated rows count as often.

    `chosen` has Learner.max_labelled rows at most, so it is broadcast and the corpus stays where it is.
    """
    joined = stats.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("id")).filter(~base_failed(F.col("s")))
    return joined.select("bad", (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("prune"), features(F.col("s")).alias("f"))


def learn(labelled: DataFrame, how: Learner = Learner()) -> list[Rule]:
    """Rules for bad rows, in order, from (bad, prune, f: struct of FEATURES); rows with prune are kept apart.

    Statistics are binned once; one row per (labelled row, statistic) is
    written once, with all of the row's bins, so that each grown test is one
    scan, filter and count of that table. No rows, or none that are bad: no rules.
    """
    quantiles = [i / how.bins for i in range(1, how.bins)]
    row = labelled.select(*[F.percentile_approx(F.when(F.col("bad") == b, F.col(f"f.{x}")), quantiles, 2000).alias(f"{x}{b}") for x in FEATURES for b in (0, 1)]).first()
    cuts = {x: sorted({float(v) for b in (0, 1) for v in (row[f"{x}{b}"] or [])}) for x in FEATURES}

    def bin_of(x: str) -> Column:
        return F.size(F.filter(F.lit(cuts[x] or [0.0]), lambda c: c <= F.col(f"f.{x}"))).cast("byte")

    bins = F.array(*map(bin_of, FEATURES))
    wide = materialize(labelled.select("bad", "prune", bins.alias("bins")), "binned")
    long = materialize(wide.select("*", F.posexplode("bins").alias("feature", "bin")), "binned_long")

    def holds(rule: Rule) -> Column:
        out = F.lit(True)
        for t in rule:  # a statistic is at least its k-th cut where its bin is above k
            bin_, k = F.col("bins")[FEATURES.index(t.feature)], cuts[t.feature].index(t.cut)
            out = out & (bin_ > k if t.at_least else bin_ <= k)
        return out

    rules: list[Rule] = []
    while len(rules) < how.max_rules:
        still_open = F.lit(True)
        for r in rules:
            still_open = still_open & ~holds(r)
        rule: Rule = ()
        while len(rule) < how.max_tests:
            seen = long.filter(~F.col("prune") & still_open & holds(rule)).groupBy("feature", "bin").agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("g")).collect()
            counts = {(FEATURES[r["feature"]], r["bin"]): (r["b"], r["g"]) for r in seen}
            bad, good = (sum(v[i] for (x, _), v in counts.items() if x == FEATURES[0]) for i in (0, 1))
            best = _best(counts, cuts, bad, good) if bad and good else None
            if best is None:
                break
            rule = (*rule, best[1])
        if not rule:
            break
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        held = wide.filter(still_open).agg(*[F.count_if(holds(h) & (F.col("bad") == b) & (F.col("prune") == p)).alias(f"c{k}_{b}_{int(p)}") for k, h in enumerate(heads) for b in (0, 1) for p in (False, True)]).first()
        worth = lambda k: (held[f"c{k}_1_1"] - held[f"c{k}_0_1"]) / max(1, held[f"c{k}_1_1"] + held[f"c{k}_0_1"])
        k = max(range(len(heads)), key=lambda i: (worth(i), -i))
        grown, apart = [[held[f"c{k}_{b}_{p}"] for b in (1, 0)] for p in (0, 1)]
        if grown[0] < how.min_covered or any(p < how.min_precision * (p + n) for p, n in (grown, apart)):
            break
        rules.append(heads[k])
    return rules


def verdict(rules: list[Rule], s: Column) -> Column:
    """Name of the first rule that rejects a struct of statistics ('base', 'rule 1', ...), else null."""

    def chosen(f: Column) -> Column:
        out = F.when(base_failed(s), F.lit("base"))
        for k, rule in enumerate(rules, 1):
            out = out.when(all_of(rule, f), F.lit(f"rule {k}: " + " and ".join(map(str, rule))))
        return out.otherwise(F.lit(None).cast("string"))

    return let(features(s), chosen)


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, s) for every row: the statistics, written once to the shared folder."""
    return materialize(docs.select(F.col("doc_id"), statistics(F.col("text")).alias("s")), "statistics")


def apply_rules(docs: DataFrame, labels: DataFrame, how: Learner = Learner()) -> DataFrame:
    """(doc_id, s, base_failed, reason, kept) for every row of docs (doc_id, text; other columns are ignored).

    Null and empty texts have no words and fail the base rules; repeated rows
    stay and get equal verdicts; an empty table gives an empty result. Labels
    of documents that docs lacks change nothing.
    """
    stats = scored(docs)
    rules = learn(materialize(labelled_statistics(stats, fitting_labels(labels, how)), "labelled"), how)
    return stats.select("doc_id", "s", base_failed(F.col("s")).alias("base_failed"), verdict(rules, F.col("s")).alias("reason")).withColumn("kept", F.col("reason").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, how: Learner = Learner()) -> DataFrame:
    """The rows of docs, all columns, that no rule rejects; cases as in `apply_rules`.

    The documents that rules are fitted on, a bounded number, are found by a
    broadcast of their ids; all rows are then judged where they are read.
    """
    chosen = fitting_labels(labels, how)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen.select("id")), F.col("doc_id").cast("long") == F.col("id"), "left_semi")
    rules = learn(materialize(labelled_statistics(scored(known), chosen), "labelled"), how)
    name = fresh(docs, "verdict")
    return docs.withColumn(name, let(statistics(F.col("text")), lambda s: verdict(rules, s))).filter(F.col(name).isNull()).drop(name)
