import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from spanlake.llm import common, quality_rules, resampling

from .helpers import labels_of, odd_docs, words


def brute(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def check(docs):
    s = quality_rules.statistics(F.col("text"))
    for r in docs.select("text", s.alias("s"), quality_rules.base_failed(s).alias("bad")).collect():
        want = brute(r["text"])
        assert tuple(r["s"])[:5] == want, r["text"]
        assert r["bad"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_statistics(spark, tiny):
    check(odd_docs(spark))
    check(spark.createDataFrame([("a a a a",), ("a b c a b c a",), ("x " * 500,), ("a b c d a b c e b c d",), ("<|x|> #*$%&",)], "text string"))
    check(spark.read.parquet(f"{tiny}/documents.parquet"))


def test_learned_rules(spark):
    rows = [(i, "word " * 3 + " ".join(f"v{i}w{k}{'!' * (i % 5 == 0)}" for k in range(80))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 != 0).cast("int").alias("quality"))
    found = quality_rules.apply_rules(docs, labels)
    assert found.filter(F.col("kept") != (F.col("doc_id") % 5 != 0)).count() == 0
    kept = quality_rules.keep_good(docs, labels)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(400) if i % 5]


def brute_learn(rows, how):
    """Sequential covering from its definition over (bad, prune, features): every test is tried by counting rows one by one."""

    def quantiles(values):
        values = sorted(values)
        return {values[max(0, math.ceil(i / how.bins * len(values)) - 1)] for i in range(1, how.bins)} if values else set()

    names = quality_rules.FEATURES
    cuts = [sorted(quantiles([f[i] for b, _, f in rows if b]) | quantiles([f[i] for b, _, f in rows if not b])) for i in range(len(names))]
    holds = lambda rule, f: all((f[i] >= c) == up for i, up, c in rule)
    rules = []
    while len(rules) < how.max_rules:
        still = [r for r in rows if not any(holds(x, r[2]) for x in rules)]
        rule = []
        while len(rule) < how.max_tests:
            now = [r for r in still if not r[1] and holds(rule, r[2])]
            bad = sum(r[0] for r in now)
            if not bad or bad == len(now):
                break
            best = None
            for i in range(len(names)):
                for c in cuts[i]:
                    for up in (False, True):
                        hit = [r for r in now if (r[2][i] >= c) == up]
                        p = sum(r[0] for r in hit)
                        if p and len(hit) < len(now):
                            gain = p * (math.log2(p / len(hit)) - math.log2(bad / len(now)))
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = gain, (i, up, c)
            if best is None:
                break
            rule.append(best[1])
        if not rule:
            break

        def tally(k, prune):
            hit = [r[0] for r in still if r[1] == prune and holds(rule[: k + 1], r[2])]
            return sum(hit), len(hit)

        worth = [(2 * p - n) / max(1, n) for p, n in (tally(k, True) for k in range(len(rule)))]
        k = worth.index(max(worth))
        if tally(k, False)[0] < how.min_covered or any(p < how.min_precision * n for p, n in (tally(k, False), tally(k, True))):
            break
        rules.append(rule[: k + 1])
    return [tuple((names[i], up, c) for i, up, c in x) for x in rules]


def test_growing_and_pruning_equal_brute_force(spark):
    rng = random.Random(12)
    how = quality_rules.Learner(bins=8, min_precision=0.8)
    for noise in (0.0, 0.05, 0.2):
        rows = []
        for _ in range(600):
            f = [round(rng.random() * 20) / 20 for _ in quality_rules.FEATURES]
            bad = (f[2] > 0.7 and f[5] < 0.5) or f[7] < 0.12
            rows.append((int(bad != (rng.random() < noise)), rng.random() < 0.33, f))
        frame = spark.createDataFrame([(b, p, tuple(f)) for b, p, f in rows], f"bad int, prune boolean, f struct<{', '.join(f'{x}: double' for x in quality_rules.FEATURES)}>")
        found = [tuple((t.feature, t.at_least, t.cut) for t in r) for r in quality_rules.learn(frame, how)]
        assert found == brute_learn(rows, how) and (found or noise > 0.1)
        s = F.struct(*[F.lit(100).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_distinct", "n_upper", "n_bang", "n_digit")], F.lit(0).alias("n_repeat_words"))
        assert "base" not in {r[0] for r in frame.select(quality_rules.verdict(quality_rules.learn(frame, how), s)).distinct().collect()}


def test_repeated_and_contradictory_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 0), (3, 1), (3, 1), (None, 0), (4, None)], "doc_id long, quality int")
    assert sorted(map(tuple, quality_rules.fitting_labels(labels).collect())) == [(1, 1), (3, 0)]
    assert quality_rules.fitting_labels(labels, quality_rules.Learner(max_labelled=1)).count() == 1
    stats = quality_rules.scored(spark.createDataFrame([(1, "word " * 60 + " ".join(f"x{i}" for i in range(200))), (2, "a"), (None, "b")], "doc_id long, text string"))
    assert quality_rules.labelled_statistics(stats, quality_rules.fitting_labels(labels)).count() == 1


def test_held_out_accuracy(spark, tiny):
    d = tiny.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = quality_rules.apply_rules(docs, labels).join(labels, "doc_id").filter(common.held_out(F.col("doc_id")) & ~F.col("base_failed"))
    right, n = found.filter(F.col("kept") == (F.col("quality") == 1)).count(), found.count()
    assert n > 50 and right / n > 0.95


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = labels_of(spark, docs)
    found = quality_rules.apply_rules(docs, labels).collect()
    assert len(found) == docs.count()
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)
    assert quality_rules.apply_rules(docs.limit(0), labels).collect() == []
    assert quality_rules.apply_rules(docs, labels.limit(0)).filter("kept = base_failed").count() == 0


def test_resampling_odd_rows_and_exact_k(spark):
    docs = odd_docs(spark)
    target = labels_of(spark, docs).filter("quality = 1")
    found = resampling.resample(docs, target, 0.5).collect()
    n = docs.count()
    keys = sorted((r["key"] for r in found), reverse=True)
    assert len(found) == n
    least = keys[-(-n // 2) - 1]
    assert {r["key"] for r in found if r["kept"]} == {k for k in keys if k >= least} and sum(r["kept"] for r in found) == -(-n // 2)
    equal = spark.createDataFrame([(1, "same words")] * 7 + [(None, "same words")] * 4, "doc_id long, text string")
    for share in (0.1, 0.5, 0.9):
        assert resampling.resample(equal, target, share).filter("kept").count() == -(-11 * share // 1)
    assert resampling.resample(docs.limit(0), target).collect() == []
    assert {r["log_ratio"] for r in resampling.resample(docs, target.limit(0)).collect()} == {0.0}


def test_resampling_equals_brute_force(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    found = {r["doc_id"]: r for r in resampling.resample(docs, labels.filter("quality = 1")).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    def grams(t):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        return w + list(zip(w, w[1:], strict=False))

    bucket = {}
    for t in text.values():  # buckets by the operator's hash, counted by hand
        b, _ = resampling.gram_buckets([t])
        assert len(b) == len(grams(t))
        bucket.update(zip(grams(t), b.tolist(), strict=True))
    raw, target = Counter(), Counter()
    for d, t in text.items():
        raw.update(bucket[g] for g in grams(t))
        if d in good:
            target.update(bucket[g] for g in grams(t))
    nr, nt, k = sum(raw.values()), sum(target.values()), resampling.BUCKETS
    for d, t in text.items():
        want = sum(math.log((target[bucket[g]] + 1) / (nt + k)) - math.log((raw[bucket[g]] + 1) / (nr + k)) for g in grams(t))
        assert math.isclose(found[d]["log_ratio"], want, rel_tol=1e-6, abs_tol=1e-6)
    order = sorted(found.values(), key=lambda r: (-r["key"], r["doc_id"]))
    assert [r["kept"] for r in order] == [i < math.ceil(0.9 * len(order)) for i in range(len(order))]


def test_kth_key_with_many_ties(spark, monkeypatch):
    monkeypatch.setattr(resampling, "FEW", 3)
    rows = spark.createDataFrame([(i, float(i // 7 % 5)) for i in range(200)], "doc_id long, key double").withColumn("row", F.col("doc_id"))
    for k in (0, 1, 37, 100, 199, 200, 300):
        found = resampling.greatest(rows, k).collect()
        order = sorted(found, key=lambda r: (-r["key"], r["doc_id"]))
        assert [r["kept"] for r in order] == [i < k for i in range(200)]
