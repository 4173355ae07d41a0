import hashlib
import json
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanlake.llm import bpe, common, token_files

from .helpers import TEXTS, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", "the", "'s", "'S", " ", "\n", "\x1c", "\x85", "İ", "Σ", "ΑΣ", "é", "é", "<|endoftext|>", "<|startoftext|>", "<|start", "1", "½", "२", "𝒜", "😀", "!!", "ß", "ﬁ", "中文", "가", "…", "\0", "aaaa", "abab"]


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def random_texts():
    rng = random.Random(5)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + [t or "" for t in TEXTS]


def test_pair_index_equals_the_library(lib):
    own, texts = bpe.PairIndexBpe(PATH), random_texts()
    for text, ids in zip(texts, own.encode_many(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_a_lesser_rank_made_by_a_merge_goes_first():
    own = object.__new__(bpe.PairIndexBpe)
    own.letter, own.final = np.arange(256), np.arange(256)
    own.merges = [(500, 97, 600), (97, 98, 500)]  # the pair (ab, a) ranks before (a, b), which makes ab
    own.ranks = {a * bpe.WIDE + b: r for r, (a, b, _) in enumerate(own.merges)}
    keys = np.array(sorted(own.ranks))
    own.keys, own.rank_of = keys, np.array([own.ranks[k] for k in keys.tolist()])
    assert [np.frombuffer(x, np.uint32).tolist() for x in own.merge(["abab", "ab"])] == [[600, 98], [500]]


def test_digests_and_ids(spark, lib):
    docs = odd_docs(spark)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert sorted((r["doc_id"], r["n_tokens"], sha(" ".join(map(str, r["ids"]))), sha(r["decoded"])) for r in bpe.encode(docs.filter("doc_id IS NOT NULL"), PATH).collect()) == sorted(w for w in want if w[0] is not None)
    assert bpe.digests(docs.limit(0), PATH).collect() == []


def test_dac_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 300, 900), rng.integers(0, 2**32, 700), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype(np.uint32)
    ends = np.array([0, 0, 10, 700, len(ids)])
    dac = token_files.DacFile(token_files.write_dac(ids, ends))
    assert dac.all().tolist() == ids.tolist() == [dac.token(i) for i in range(len(ids))]
    assert dac.document(2) == ids[:10].tolist() and dac.document(0) == []
    empty = token_files.DacFile(token_files.write_dac(np.zeros(0, np.uint32), np.zeros(0, int)))
    assert empty.all().tolist() == []
    with pytest.raises(IndexError):
        empty.token(0)


def test_cheaper_steps_give_the_library_s_ids(lib):
    own = token_files.Encoder(PATH)
    every = [f"x{chr(c)}y'S{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = ["_", "-", "'ll", "'VE", "'", "''s", "'re", "7", "42", "\t", "\r\n", "\x0b", "\x1f", "\x7f", "<|ENDOFTEXT|>", "Don't", "it'd've", "\u2028", "\u00a0", "\u0301", "ǅ"]
    rng = random.Random(7)
    texts = [*random_texts(), *("".join(rng.choice(PARTS + marks) for _ in range(rng.randint(0, 60))) for _ in range(4000)), *("".join(rng.choice([m for m in PARTS + marks if m.isascii()]) for _ in range(rng.randint(0, 30))) for _ in range(4000))]
    assert own.plain is not None and own.is_plain("A b\tC'S\n<|endoftext|>1") and not own.is_plain("a\x1cb") and not own.is_plain("é")
    assert 500 < sum(map(own.is_plain, texts)) < len(texts)
    for part in [texts, *(every[i : i + 50_000] for i in range(0, len(every), 50_000))]:
        want = [np.array(e.ids, "<u4").tobytes() for e in lib.encode_batch_fast(part, add_special_tokens=False)]
        assert own.encode_many(part) == want


def test_whole_texts_in_symbols_give_the_library_s_ids(lib, monkeypatch):
    own = token_files.Encoder(PATH)
    rng = random.Random(11)
    marks = ["'", "''", "'S", "'re", "'Ve", "'ll", "'lx", "'d", "'tis", "it's", "DON'T", "!'s", "1's", "\t", " ", "  ", "\n", "\xa0", "\x85", "\x1c", "\0", "12", "É", "ß", "ſ", "Ǆ", "ΑΣ", "ж", "Ж", "²", "_", "--", "<|", "ab", "THE", "tion"]
    texts = ["", " ", "'", "'s", "a'", "x" * 5000, "ab " * 1000, *("".join(rng.choice(marks) for _ in range(rng.randint(1, 50))) for _ in range(5000))]
    for points in (range(0x600), [*range(0xD800), *range(0xE000, 0x20000)], [0x41, 0x27, 0x2019, 0x65, 0x301, 0x323, 0x3000, 0x4E2D, 0x1100, 0x1161, 0x11A8, 0x130, 0x1F600, 0x661]):
        texts += ["".join(chr(rng.choice(points)) for _ in range(40)) for _ in range(3000)]
    assert all(map(own.marked.takes, texts)) and not own.marked.takes("a <|endoftext|>")
    want = [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
    for blanks in (1, 2, token_files.BLANKS):
        monkeypatch.setattr(token_files, "BLANKS", blanks)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(texts)] == want


def test_encoding_costs_much_less_than_the_file_s_steps(lib):
    rng = random.Random(3)
    syllables = ["the", "ing", "er", "on", "é", "tion", "a", "st", "ción", "eau", "sh", "in"]
    texts = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(600)) for _ in range(150)]
    own = token_files.Encoder(PATH)

    def cost(run):
        spent = []
        for _ in range(3):
            began = time.process_time()
            run(texts)
            spent.append(time.process_time() - began)
        return min(spent)

    assert cost(own.encode_many) < 0.6 * cost(lambda x: [e.ids for e in lib.encode_batch_fast(x, add_special_tokens=False)])


@pytest.mark.parametrize("merge", [("a</w>", "b"), ("a</w>", "b</w>")])
def test_a_model_that_merges_beyond_words_keeps_its_split(tmp_path, merge):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"].append(list(merge))
    spec["model"]["vocab"]["".join(merge)] = len(spec["model"]["vocab"])
    (tmp_path / "beyond.json").write_text(json.dumps(spec))
    own, lib = token_files.Encoder(str(tmp_path / "beyond.json")), Tokenizer.from_file(str(tmp_path / "beyond.json"))
    assert own.marked is None and own.plain is not None
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(["a b a bc", "ab"])] == [lib.encode(t, add_special_tokens=False).ids for t in ("a b a bc", "ab")]


def test_another_file_runs_as_it_is(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = None
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    own, lib = token_files.Encoder(str(tmp_path / "cased.json")), Tokenizer.from_file(str(tmp_path / "cased.json"))
    assert own.plain is None
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(["A b", "a  b"])] == [lib.encode(t, add_special_tokens=False).ids for t in ("A b", "a  b")]


def test_files_in_order(spark, lib, monkeypatch):
    docs = odd_docs(spark)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    path = common.new_path(spark, "files")
    files = token_files.write_files(docs, PATH, path, partitions=3)
    assert spark.read.parquet(path).count() > 1
    found = sorted(token_files.read_files(files).collect(), key=lambda r: r["start"])
    flat, at = [], 0
    encoded = {r["text"]: [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows}
    assert [r["doc_id"] for r in found] == [r["doc_id"] for r in rows]
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted((r["doc_id"] is None, r["doc_id"], len(e := encoded[r["text"]]), zlib.crc32(np.array(e, "<u4").tobytes())) for r in rows if r["doc_id"] is not None)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found if r["doc_id"] is not None) == want
    first = min(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    flat = encoded[first["text"]]
    assert [token_files.token_at(files, i) for i in range(len(flat))] == flat
    assert token_files.token_at(files, at) is None
    none = token_files.write_files(docs.limit(0), PATH, common.new_path(spark, "files"))
    assert token_files.read_files(none).collect() == []
