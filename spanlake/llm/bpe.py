"""BPE encoding with a pair occurrence index, and decoding.

The new words of a slice of a partition (`pieces`) are laid out as symbol lists
in one array. An index maps each adjacent pair that has a merge rank to all its positions;
the least active rank is taken from a heap, its positions are merged in
ascending order, and the pairs on both sides of each merge leave and enter the
index. Words are independent of each other, so taking the least rank of the
whole partition gives every word its own order of merges. Encoded words are
kept in a bounded store, so a word that comes again costs a look-up.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, record_batch

#: Encoded words that a task keeps before it starts anew.
STORE = 120_000
#: Over any token id.
WIDE = 1 << 31


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself if visible, else the next from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class PairIndexBpe:
    """Encoder and decoder of a tokenizers file: NFC, blanks, lower case; split by pattern; byte-level BPE with word ends.

    Special tokens found in a text become their ids, as the library's encode does by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: By rank: left, right, merged. By left * WIDE + right: rank, also as sorted arrays for whole-partition look-ups.
        self.merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.ranks = {a * WIDE + b: r for r, (a, b, _) in enumerate(self.merges)}
        keys = np.array(list(self.ranks), np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], np.array(list(self.ranks.values()), np.int64)[order]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        letters = byte_letters()
        self.letter = np.array([self.vocab[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([self.vocab[letters[b] + self.end] for b in range(256)], np.int64)
        self.text = {i: str(i) for i in self.names}
        #: The ids of each stored word, as 32-bit numbers in a row.
        self.store: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """Pieces of a text in order: special tokens as they are, else what the pattern finds."""
        if "<|" not in text or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self._plain(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no rule for a sigma that ends a word
        return self.pattern.findall(text.lower())

    def merge(self, words: list[str]) -> list[bytes]:
        """Token ids of each word (without blanks), as in the store, by one pair index over all of them."""
        if not words:
            return []
        data = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
        edge = data == 10  # words don't touch, and each end of the partition has an edge
        first = np.where(np.r_[edge[1:], True], self.final[data], self.letter[data])
        first[edge] = -1
        pair = first[:-1] * WIDE + first[1:]
        pair[edge[:-1] | edge[1:]] = -1
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        active = np.flatnonzero(self.keys[at] == pair)
        rank = self.rank_of[at[active]]
        order = np.argsort(rank, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(rank[order]) != 0]) if len(rank) else []
        lists = np.split(active[order], cuts[1:]) if len(rank) else []
        index = {int(rank[order[c]]): x.tolist() for c, x in zip(cuts, lists, strict=True)}
        symbol, after, before = first.tolist(), list(range(1, len(first) + 1)), list(range(-1, len(first) - 1))
        heap, get = list(index), self.ranks.get
        heapify(heap)
        while heap:
            rank = heappop(heap)
            at = index.pop(rank, None)
            if not at:
                continue
            left, right, made = self.merges[rank]
            at.sort()
            for n, i in enumerate(at):
                j = after[i]
                if symbol[i] != left or symbol[j] != right:
                    continue  # an earlier merge took one side
                k, h = after[j], before[i]
                symbol[i], symbol[j], after[i], before[k] = made, -2, k, i
                lower = False
                if (s := symbol[h]) >= 0 and (found := get(s * WIDE + made)) is not None:
                    if (places := index.get(found)) is None:
                        index[found] = [h]
                        heappush(heap, found)
                    else:
                        places.append(h)
                    lower = found < rank
                if (s := symbol[k]) >= 0 and (found := get(made * WIDE + s)) is not None:
                    if (places := index.get(found)) is None:
                        index[found] = [i]
                        heappush(heap, found)
                    else:
                        places.append(i)
                    lower |= found < rank
                if lower and n + 1 < len(at):  # a lesser rank became active: it goes first
                    index[rank] = at[n + 1 :] + index.get(rank, [])
                    heappush(heap, rank)
                    break
        end = np.array(symbol)
        ids = end[end >= 0].astype(np.uint32).tobytes()
        ends = (4 * np.cumsum(end >= 0)[np.flatnonzero(end == -1)]).tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def learn(self, words: set[str]) -> None:
        """Put the words that the store lacks into it."""
        new = [w for w in words if w not in self.store]
        if len(self.store) + len(new) > STORE:
            self.store.clear()
            new = list(words)
        plain = [w for w in new if w not in self.special]
        self.store.update(zip(plain, self.merge(plain), strict=True))
        self.store.update((w, np.uint32(self.special[w]).tobytes()) for w in new if w in self.special)

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        each = [self.words(t) for t in texts]
        self.learn(set().union(*each))
        ids = self.store.__getitem__
        return [np.frombuffer(b"".join(map(ids, x)), np.uint32).tolist() for x in each]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, special tokens included. The file has no decoder step, so tokens are joined by a space; unknown ids are left out."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except KeyError:
            return " ".join([self.names[i] for i in ids if i in self.names])

    def joined(self, ids: Iterable[int]) -> str:
        """Decimal ids joined by a space."""
        return " ".join(map(self.text.__getitem__, ids))


_loaded: dict[str, PairIndexBpe] = {}


def loaded(path: str) -> PairIndexBpe:
    """The encoder of a file, once per Python worker."""
    if path not in _loaded:
        _loaded[path] = PairIndexBpe(path)
    return _loaded[path]


@contextmanager
def kept_words(path: str) -> Iterator[PairIndexBpe]:
    """The encoder of a file; the words that it keeps go with the task, as the worker goes on to other stages."""
    bpe = loaded(path)
    try:
        yield bpe
    finally:
        bpe.store.clear()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs' doc_id with ids (array of int), n_tokens and the decoded text, for every row.

    docs: (doc_id, text; other columns are ignored). Null and empty texts have no ids and decode to ''. Rows repeat as given.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with kept_words(path) as bpe:
            for part, texts in pieces(batches, "text"):
                ids = bpe.encode_many(texts)
                yield record_batch(schema, part.column(0), ids, [len(x) for x in ids], [bpe.decode(x) for x in ids])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: `encode` digested in the same task.

    ids_sha256 is over the decimal ids joined by a space, decoded_sha256 over
    the text decoded from them in UTF-8, both lower hex. Null and empty texts
    have no ids, and digests of ''; rows repeat as given; an empty table gives
    an empty result. Texts are encoded whole, whatever their length.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with kept_words(path) as bpe:
            for part, texts in pieces(batches, "text"):
                found = bpe.encode_many(texts)
                yield record_batch(schema, part.column(0), [len(x) for x in found], [digest(bpe.joined(x)) for x in found], [digest(bpe.decode(x)) for x in found])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
