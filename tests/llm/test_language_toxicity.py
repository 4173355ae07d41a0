import math
from collections import Counter, defaultdict

import numpy as np
import zlib
from pyspark.sql import functions as F

from spanlake.llm import common, language_id, toxicity

from .helpers import labels_of, odd_docs


def normal(text):
    out = "   "
    for c in text:
        low = c.lower()
        out += (low if len(low) == 1 else c) if c.isalpha() else " " if out[-1] != " " else ""
    return out + ("" if out.endswith(" ") else " ")


def brute_kn(counts, grams_of, vocabulary):
    """Interpolated Kneser-Ney from the definition: counts of 4-grams -> log-probability of the last character."""
    levels = {4: Counter(counts)}
    for n in (3, 2, 1):
        levels[n] = Counter()
        for g in levels[n + 1]:
            levels[n][g[1:]] += 1

    def prob(g):
        n = len(g)
        if n == 0:
            return 1 / vocabulary
        level = levels[n]
        total = sum(c for k, c in level.items() if k[:-1] == g[:-1])
        n1, n2 = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        if not total:
            return prob(g[1:])
        kinds = sum(k[:-1] == g[:-1] for k in level)
        return max(level[g] - d, 0) / total + d * kinds / total * prob(g[1:])

    return [math.log(prob(g)) for g in grams_of]


def test_model_equals_definition():
    train = {"a": ["hello there hello", "the other one"], "b": ["zzz hola otra", "la otra ola zz"]}
    types, counts = {}, {}
    for lang, texts in train.items():
        codes, owner = language_id.symbols(texts)
        key, _ = language_id.grams(codes, owner, 4)
        types[lang] = np.unique(key, return_counts=True)
        counts[lang] = Counter(g[i : i + 4] for t in texts for g in [normal(t)] for i in range(len(g) - 3))
        assert sum(counts[lang].values()) == len(key)
    model = language_id.build(types)
    vocabulary = 1 + len({g[-1] for c in counts.values() for g in c})
    for text in ("hello ola", "otra xyz the", "q"):
        total, n = model.score([text])
        s = normal(text)
        grams = [s[i : i + 4] for i in range(len(s) - 3)]
        assert n[0] == len(grams)
        for j, lang in enumerate(model.languages):
            assert math.isclose(total[0, j], sum(brute_kn(counts[lang], grams, vocabulary)), rel_tol=1e-4)
    same = language_id.Model.of_bytes(model.to_bytes())
    assert same.predict(["hello"])[0] == model.predict(["hello"])[0] == ["a"]


def test_languages_held_out(spark, tiny):
    docs = spark.read.parquet(f"{tiny.replace('0.001', '0.01')}/documents.parquet")
    model = language_id.fit(docs)
    found = language_id.predict(docs, model).join(docs, "doc_id").filter(common.held_out(F.col("doc_id")))
    assert found.filter("lang = lang_pred").count() / found.count() > 0.97
    assert language_id.keep_known(docs, model).count() > 0.995 * docs.count()


def test_unknown_languages_are_rejected(spark, tiny):
    """Letters at random and languages that the model does not know go, however long; known ones stay."""
    docs = spark.read.parquet(f"{tiny.replace('0.001', '0.01')}/documents.parquet")
    model = language_id.fit(docs)
    rng = np.random.default_rng(3)
    noise = [" ".join("".join(chr(97 + int(k)) for k in rng.integers(0, 26, int(n))) for n in rng.integers(2, 9, 120)) for _ in range(20)]
    other = ["\u043e\u0434\u043d\u0430\u0436\u0434\u044b \u0432 \u0441\u0442\u0443\u0434\u0435\u043d\u0443\u044e \u0437\u0438\u043c\u043d\u044e\u044e \u043f\u043e\u0440\u0443 " * 10, "\u03ba\u03b1\u03bb\u03b7\u03bc\u03ad\u03c1\u03b1 \u03c3\u03b5 \u03cc\u03bb\u03bf\u03c5\u03c2 " * 10, "123 456"]
    known = [r["text"] for r in docs.limit(20).collect()]
    frame = spark.createDataFrame([(i, t, None) for i, t in enumerate(noise + other + known)], "doc_id long, text string, lang string")
    kept = sorted(r["doc_id"] for r in language_id.keep_known(frame, model).collect())
    assert kept == list(range(len(noise) + len(other), len(noise) + len(other) + len(known)))


def test_language_odd_rows(spark):
    docs = odd_docs(spark)
    model = language_id.fit(docs)
    assert model.languages == ["en", "fr"]
    found = language_id.predict(docs, model).collect()
    assert len(found) == docs.count()
    text = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        text[r["doc_id"]].append(r["text"])
    for r in found:
        letters = [any(map(str.isalpha, t or "")) for t in text[r["doc_id"]]]
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] in model.languages) in letters and (r["lang_pred"] == "und") == (r["lang_pred"] not in model.languages)
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["rejected"] for r in found)
    nothing = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).collect() == []


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", common.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_toxic_held_out(spark, tiny):
    d = tiny.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter(common.held_out(F.col("doc_id")))
    c = {(r["toxic"], r["p"]): r["count"] for r in found.groupBy("toxic", (F.col("score") >= 0.3).alias("p")).count().collect()}
    assert c[1, True] / (c[1, True] + c.get((1, False), 0)) > 0.8
    assert c.get((0, True), 0) / c[0, False] < 0.02


def test_toxicity_odd_rows(spark):
    docs = odd_docs(spark)
    labels = labels_of(spark, docs)
    for y in (labels, labels.limit(0), labels.filter("toxic = 1")):
        found = toxicity.score(docs, toxicity.fit(docs, y)).collect()
        assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []


def test_scores_equal_brute_force(spark):
    """The whole way from labels to scores, by plain loops: sample, n-grams, ratios, choice, regression, sum of weights."""
    rng = np.random.default_rng(6)
    good, bad = ["table", "river", "window", "garden", "paper"], ["grubble", "snark"]
    rows = [(i, " ".join(rng.choice(good, 12)) + (" " + str(rng.choice(bad)) if i % 3 == 0 else "")) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(1, 0), (6, 0), (2, None)], "doc_id long, toxic int")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}

    def grams(text):
        s = "   " + text + " "
        out = set()
        for n in toxicity.LENGTHS:
            for i in range(len(s) - n + 1):
                key = n
                for c in s[i : i + n]:
                    key = (key * 0x100000001B3 + ord(c)) % 2**64
                out.add(int(language_id.mixed(np.array([key], np.uint64))[0]) >> (64 - toxicity.BITS))
        return out

    train = [(t, i % 3 == 0) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    yes, no = Counter(), Counter()
    for t, y in train:
        (yes if y else no).update(grams(t))
    n, m = sum(y for _, y in train), sum(not y for _, y in train)
    told = {}
    for b in set(yes) | set(no):
        if yes[b] + no[b] >= toxicity.LEAST:
            p, q = (yes[b] + 1) / (n + 2), (no[b] + 1) / (m + 2)
            told[b] = math.log(p) - math.log(q), (math.log(p) - math.log(q)) * (p - q)
    best = sorted(told, key=lambda b: (-told[b][1], b))[: toxicity.KEPT]
    assert len(best) == len(told)  # so the choice leaves none out here
    ratio = np.array([told[b][0] for b in best])
    x = np.array([[b in g for b in best] for g in (grams(t) for t, _ in train)], float) * ratio
    y = np.array([y for _, y in train])
    share = sum(i % 3 == 0 for i, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2) / len(train)
    each = np.where(y, share / n, (1 - share) / m)
    w, b, m1, m2 = np.ones(len(best)) * 0.1, 0.0, np.zeros(len(best) + 1), np.zeros(len(best) + 1)
    for step in range(1, toxicity.STEPS + 1):
        error = each * (1 / (1 + np.exp(-(x @ w + b))) - y)
        g = np.append(x.T @ error + toxicity.PENALTY * (w - w.mean()) / len(w), error.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        d = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        w, b = w - d[:-1], b - d[-1]
    for i, t in rows:
        g = grams(t)
        want = 1 / (1 + math.exp(-(b + sum(w[k] * ratio[k] for k, f in enumerate(best) if f in g))))
        assert math.isclose(found[i], want, abs_tol=2e-3), i


def test_ratios_scale_features():
    texts = ["you trash thing", "a fine thing", "trash", "fine fine day"]
    text, bucket = toxicity.present(texts)
    assert len(set(zip(text.tolist(), bucket.tolist(), strict=True))) == len(text)
    row, at, y = np.array([0, 0, 1, 2, 3]), np.array([0, 1, 1, 0, 1]), np.array([True, False, True, False])
    weight, bias = toxicity.regression(row, at, y, np.array([2.0, -1.0]), 0.5)
    margin = bias + np.bincount(row, weights=weight[at], minlength=4)
    assert ((margin > 0) == y).all()
