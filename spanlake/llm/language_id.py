"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays.

Training counts the character n-grams of a bounded sample of labelled
documents per language as a Spark job; from the summed n-gram types the driver
derives each language's interpolated Kneser-Ney probabilities and stores them
as sorted arrays of hashed n-grams, one array per language and order, so the
model grows with the n-grams that the languages have. Scoring maps Arrow
batches: the n-grams of a slice of texts are looked up by binary search and
fall back by order where the language has not seen them. The language with the
least cross-entropy per character wins. Rejection is calibrated on documents
held back from training.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, held_out, materialize, pieces, record_batch

ORDER = 4
#: Documents per language that the models are fitted on, at most: those of least hash.
SAMPLE = 1500
#: Further documents per language that calibrate rejection.
CALIBRATION = 300
#: How far rejection lies between the worst calibration document and letters at random, and its slack in short texts.
MARGIN, SLACK = 0.6, 6.0

UNKNOWN = "und"
_BLANK = 32

_LETTER = np.zeros(65537, bool)
_FOLD = np.arange(65537, dtype=np.uint16)


def _tables() -> None:
    """Letters of the basic plane and their lower case; other letters share one symbol."""
    for c in range(65536):
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            _LETTER[c] = x.isalpha()
            low = x.lower()
            _FOLD[c] = ord(low[0]) if len(low) == 1 and ord(low) < 65536 else c
    _LETTER[65535] = True


_tables()


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, number of text): letters in lower case, each run of other characters after a letter one blank; blanks before each text."""
    pad = "\0" * (ORDER - 1)
    joined = "".join(f"{pad}{t.replace(chr(0), ' ')} " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes + ORDER)
    low = np.where(codes > 65535, 65535, codes).astype(np.uint16)
    letter = _LETTER[low]
    for c in np.unique(codes[codes > 65535]):
        if not chr(c).isalpha():
            letter[codes == c] = False
    out = np.where(letter, _FOLD[low], _BLANK).astype(np.uint16)
    pads = codes == 0
    keep = pads | letter
    keep[1:] |= letter[:-1]
    return out[keep], owner[keep]


def grams(codes: np.ndarray, owner: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, position of the last character): n-grams inside one text, 16 bits a character."""
    if len(codes) < order:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(codes) - order + 1
    key = np.zeros(n, np.uint64)
    for i in range(order):
        key = (key << np.uint64(16)) | codes[i : i + n]
    inside = owner[order - 1 :] == owner[:n]
    return key[inside], np.flatnonzero(inside) + order - 1


def mixed(key: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash, so that equal hashes mean equal n-grams."""
    h = key * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Language:
    """One language, by order from 1: sorted hashes of its n-grams and their log-probabilities, sorted hashes of its contexts and the log weights of the order below."""

    hashes: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]

    def log_probability(self, key: np.ndarray, order: int, unseen: float) -> np.ndarray:
        """Of n-grams `key` of an order: as stored, or the weight of their context times the probability one order lower."""
        if order == 0:
            return np.full(len(key), unseen)
        out, found = looked_up(self.hashes[order - 1], self.logs[order - 1], mixed(key))
        miss = np.flatnonzero(~found)
        if len(miss):
            short = key[miss]
            context = short >> np.uint64(16) if order > 1 else np.zeros(len(short), np.uint64)
            weight, known = looked_up(self.contexts[order - 1], self.back[order - 1], mixed(context))
            out[miss] = np.where(known, weight, 0.0) + self.log_probability(short & np.uint64((1 << (16 * (order - 1))) - 1), order - 1, unseen)
        return out


def looked_up(hashes: np.ndarray, values: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the sought hashes, whether each is there), by binary search."""
    if not len(hashes):
        return np.zeros(len(sought)), np.zeros(len(sought), bool)
    at = np.minimum(np.searchsorted(hashes, sought), len(hashes) - 1)
    found = hashes[at] == sought
    return np.where(found, values[at], 0.0).astype(np.float64), found


@dataclass
class Model:
    """A model per language, in sorted hash arrays of its own n-grams alone; unseen: log of the last resort."""

    languages: list[str]
    each: list[Language]
    unseen: float
    worst: np.ndarray  # by language: cross-entropy above which a text is rejected

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(summed log-probability by text and language, letters and blanks scored by text)."""
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        codes, owner = symbols(texts)
        key, last = grams(codes, owner, ORDER)
        if len(key) and self.languages:
            who = owner[last]
            start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            n[who[start]] = np.diff(np.r_[start, len(who)])
            distinct, at = np.unique(key, return_inverse=True)  # each n-gram of the texts is looked up once per language
            for j, language in enumerate(self.each):
                total[who[start], j] = np.add.reduceat(language.log_probability(distinct, ORDER, self.unseen)[at], start)
        return total, n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score 0 to 1, rejected, cross-entropy per character of that language)."""
        total, n = self.score(texts)
        known = (n > 0) & np.array([any(map(str.isalpha, t)) for t in texts], bool) & bool(self.languages)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.full(len(texts), np.nan)
        entropy = -total / np.maximum(n, 1)[:, None]
        best = entropy.argmin(axis=1)
        odds = np.exp(np.clip((entropy.min(axis=1, keepdims=True) - entropy) * np.minimum(np.maximum(n, 1), 50)[:, None], -60, 0))
        score = np.where(known, 1 / odds.sum(axis=1), 0.0)
        least = entropy[np.arange(len(texts)), best]
        rejected = ~known | (least - SLACK / np.sqrt(np.maximum(n, 1)) > self.worst[best])
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score, rejected, np.where(known, least, np.nan)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        many = {f"{name}{j}_{k}": x for j, language in enumerate(self.each) for name in ARRAYS for k, x in enumerate(getattr(language, name))}
        np.savez(out, languages=np.array(self.languages, dtype=np.str_), unseen=self.unseen, worst=self.worst, **many)
        return out.getvalue()

    @staticmethod
    def of_bytes(data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        names = [str(x) for x in z["languages"]]
        each = [Language(*[[z[f"{name}{j}_{k}"] for k in range(ORDER)] for name in ARRAYS]) for j in range(len(names))]
        return Model(names, each, float(z["unseen"]), z["worst"])


ARRAYS = ("hashes", "logs", "contexts", "back")


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their values."""
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, weights=values, minlength=len(unique))


def kneser_ney(keys: np.ndarray, counts: np.ndarray, vocabulary: int) -> tuple[list[dict], list[dict]]:
    """By order from 1: (n-gram key -> probability arrays), (context key -> weight of the order below), of one language.

    The top order has counts, lower orders the number of different characters
    that precede an n-gram; one absolute discount per order, n1 / (n1 + 2 n2).
    """
    levels = [(keys, counts.astype(float))]
    for order in range(ORDER - 1, 0, -1):
        above = levels[0][0]
        levels.insert(0, _sums(above & np.uint64((1 << (16 * order)) - 1), np.ones(len(above))))
    probability, weight = [], []
    for order, (k, c) in enumerate(levels, 1):
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        context = k >> np.uint64(16) if order > 1 else np.zeros(len(k), np.uint64)
        seen, total = _sums(context, c)
        _, kinds = _sums(context, np.ones(len(k)))
        at = np.searchsorted(seen, context)
        if order == 1:
            lower = np.full(len(k), 1 / vocabulary)
        else:
            short = k & np.uint64((1 << (16 * (order - 1))) - 1)
            lower = probability[-1][1][np.searchsorted(probability[-1][0], short)]
        p = np.maximum(c - d, 0) / total[at] + d * kinds[at] / total[at] * lower
        probability.append((k, p))
        weight.append((seen, d * kinds / total))
    return probability, weight


def build(types: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The models of all languages from their n-gram types and counts; they share the size of the alphabet."""
    languages = sorted(types)
    vocabulary = 1 + len(np.unique(np.concatenate([k & np.uint64(0xFFFF) for k, _ in types.values()]))) if types else 1

    def stored(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        hashed = [(mixed(k), np.log(v)) for k, v in pairs]
        order = [np.argsort(h) for h, _ in hashed]
        return [h[o] for (h, _), o in zip(hashed, order, strict=True)], [v[o].astype(np.float32) for (_, v), o in zip(hashed, order, strict=True)]

    each = []
    for x in languages:
        probability, weight = kneser_ney(*types[x], vocabulary)
        each.append(Language(*stored(probability), *stored(weight)))
    return Model(languages, each, float(np.log(1 / vocabulary)), np.full(len(languages), np.inf))


def fit(docs: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model:
    """The model of the non-null lang values of docs (doc_id, text, lang) that are not held out.

    Fitted on at most `sample` whole documents per language, those of least
    hash of (doc_id, text); rejection is calibrated on the next `calibration`.
    The driver holds the n-grams of these documents, which grow with the number
    of languages. Documents with a null lang or text are ignored; without any
    language every text is 'und'.
    """
    spark = docs.sparkSession
    usable = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # a uniform cut by hash leaves about sample + calibration rows a language, whatever their number; the rank is then exact
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return build({})
    most = sample + calibration
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, 2 * most / v))]), F.col("lang"))
    ranked = usable.filter(F.abs(F.col("h") / 2.0**63) <= share).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.abs(F.col("h") / 2.0**63), "text"))).filter(F.col("rank") <= most)
    drawn = materialize(ranked.select("lang", "text", "rank"), "drawn")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])
        for part, texts in pieces(batches, "text"):
            langs = part.column(0).to_pylist()
            codes, owner = symbols(texts)
            key, last = grams(codes, owner, ORDER)
            for x in sorted(set(langs)):
                mine = np.array([y == x for y in langs], bool)[owner[last]]
                unique, n = np.unique(key[mine], return_counts=True)
                yield record_batch(schema, [x] * len(unique), unique.view(np.int64), n)

    split = F.col("rank") % (1 + sample // max(1, calibration)) == 0 if calibration else F.lit(False)
    table = drawn.filter(~split).repartition(F.xxhash64("lang", "rank")).select("lang", "text").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    types = {}
    langs, keys, counts = table["lang"].to_numpy(), table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    for x in sorted(set(langs)):
        mine = langs == x
        order = np.argsort(keys[mine])
        types[str(x)] = keys[mine][order], counts[mine][order]
    model = build(types)
    held = spark.sparkContext.broadcast(model.to_bytes())
    for r in drawn.filter(split).select("lang", "text").mapInArrow(_entropies(held), "lang string, entropy double").groupBy("lang").agg(F.max("entropy").alias("most")).collect():
        if r["lang"] in types and r["most"] is not None:
            model.worst[model.languages.index(r["lang"])] = r["most"] + MARGIN * max(0.0, -model.unseen - r["most"])
    return model


def _entropies(held):
    schema = pa.schema([("lang", pa.string()), ("entropy", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of_bytes(held.value)
        for part, texts in pieces(batches, "text"):
            langs = part.column(0).to_pylist()
            total, n = model.score(texts)
            own = np.array([model.languages.index(x) if x in model.languages else -1 for x in langs])
            ok = (own >= 0) & (n >= 200)
            yield record_batch(schema, [x for x, k in zip(langs, ok, strict=True) if k], -total[ok, own[ok]] / n[ok])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, cross_entropy) for every row of docs (doc_id, text; other columns are ignored).

    lang_pred is 'und' (score 0, rejected) where the text is null, empty or has
    no letter. score is the share of the best language among all at the
    cross-entropies found, counted over at most 50 characters. Rows repeat as
    given, ties go to the first language by name, and an empty table gives an
    empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.to_bytes())
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("cross_entropy", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of_bytes(held.value)
        for part, texts in pieces(batches, "text"):
            yield record_batch(schema, part.column(0), *own.predict(texts))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, cross_entropy double")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose language is not rejected.

    Rejected are null and empty texts, texts without a letter, and those whose
    cross-entropy is beyond what calibration allows. Rows repeat as given, an
    empty table gives an empty result, and extra columns may have any names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.to_bytes())
    name = fresh(docs, "language_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of_bytes(held.value)
        for part, texts in pieces(batches, name):
            kept = part.filter(pa.array(~own.predict(texts)[2]))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], schema=pa.schema(list(kept.schema)[:-1]))

    return docs.withColumn(name, F.col("text")).mapInArrow(run, docs.schema)
