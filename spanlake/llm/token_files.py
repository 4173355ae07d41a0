"""Token files with directly addressable codes.

A file holds the ids of a run of documents. Ids are cut into 8-bit chunks, low
chunk first: level 0 has the low chunk of every id, level k the next chunk of
the ids that need it. A bitmap per level says which ids go on, and a rank
directory (ones before every 512 bits) finds their place on the next level. So
any token is read with one probe per level, and nothing else is decoded.

Layout, little-endian: magic 'DAC1', number of documents and of ids (u32 each),
number of levels (u32), document ends (u32 each), then for each level its
length (u32), its chunks, its bitmap and its directory (u32 each).
"""

from __future__ import annotations

import json
import os
import string
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from .common import pieces, record_batch

MAGIC = b"DAC1"
BLOCK = 512
#: Ids that a file holds, about: a file ends with the document that reaches it.
FILE_IDS = 1 << 20
#: Merged words that the library keeps in a worker: at worst (runs of 40 Chinese characters) some 8 KB each, 400 MB in all.
CACHE = 50_000
#: Steps of word_bpe_49k.json, as the file has them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The pieces that the pattern of SPLIT finds: letters come first, as no other branch begins with one, and runs are not given back.
PIECES = r"\p{L}++|'(?:[stmd]|re|ve|ll)|\p{N}|[^\s\p{L}\p{N}]++"
#: ASCII control characters that are no blanks.
CONTROLS = bytes([*range(9), *range(14, 32), 127])
#: What a code point is to SPLIT.
BLANK, LETTER, NUMBER, OTHER, UNASKED = range(5)
#: A piece that `Marked` hands to the model has about so many blanks, as the model's queue grows with it.
BLANKS = 128


def write_dac(ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The file of ids (uint32) of documents that end at `ends`."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        chunk, on = (rest & 0xFF).astype(np.uint8), rest > 0xFF
        bits = np.packbits(on, bitorder="little")
        whole = np.zeros(-(-len(rest) // BLOCK) * BLOCK // 8, np.uint8)
        whole[: len(bits)] = bits
        ones = np.bitwise_count(whole.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
        levels.append((chunk, whole, (np.cumsum(ones) - ones).astype("<u4")))
        rest = rest[on] >> np.uint32(8)
    head = MAGIC + np.array([len(ends), len(ids), len(levels)], "<u4").tobytes() + ends.astype("<u4").tobytes()
    return head + b"".join(np.array([len(c)], "<u4").tobytes() + c.tobytes() + b.tobytes() + r.tobytes() for c, b, r in levels)


class DacFile:
    """Reader of a file: `token` and `document` by random access, `all` in one sweep."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC1 file")
        docs, self.n, levels = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
        self.ends = np.frombuffer(data, "<u4", docs, 16)
        at, self.levels = 16 + 4 * docs, []
        for _ in range(levels):
            n = int(np.frombuffer(data, "<u4", 1, at)[0])
            blocks = -(-n // BLOCK)
            chunks = np.frombuffer(data, np.uint8, n, at + 4)
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at + 4 + n)
            ranks = np.frombuffer(data, "<u4", blocks, at + 4 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 4 + n + len(bits) + 4 * blocks

    def token(self, i: int) -> int:
        """The i-th id: one probe per level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = int.from_bytes(bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8].tobytes(), "little") & ((1 << (i % BLOCK)) - 1)
            i = int(ranks[block]) + inside.bit_count()
        return out

    def document(self, d: int) -> list[int]:
        start = int(self.ends[d - 1]) if d else 0
        return [self.token(i) for i in range(start, int(self.ends[d]))]

    def all(self) -> np.ndarray:
        """All ids, level by level from the top."""
        out = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            on = np.unpackbits(bits, bitorder="little")[: len(chunks)].astype(bool)
            now = chunks.astype(np.uint32)
            now[on] |= out << np.uint32(8)
            out = now
        return out


class Marked:
    """The library's model on whole texts in symbols that say where a piece ends, for files with the steps NORMALIZER and SPLIT.

    The library's cost is mostly a fixed one for each piece of the split. Here
    each byte has two symbols, one of them for the last byte of a piece, and the
    model's tokens are spelled in these. No merge of the file starts with a last
    byte, so none reaches beyond a piece, and a whole text needs no split: the
    ids are those of the file. Texts are normalised by the library, those of
    Latin-1 by `lower`, which is the same. Whether a code point is a letter, a number
    or a blank is asked of the library, once. Texts with added tokens are not for this.
    """

    CUT, SEPARATOR = "\n", "\ufefe"  # no byte's symbols

    def __init__(self, spec: dict):
        if any(x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("added tokens are sought after other steps")
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.inner, self.last = self._symbols()
        letters = byte_letters()
        spelled = self._spelled(spec["model"], *({letters[b]: x for b, x in kind.items()} for kind in (self.inner, self.last)))
        vocab = {spelled[token]: i for token, i in spec["model"]["vocab"].items()}
        self.lib = Tokenizer(models.BPE(vocab=vocab, merges=[(spelled[a], spelled[b]) for a, b in spec["model"]["merges"]], cache_capacity=0))
        self.lib.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(self.CUT)
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.two, self.four = np.zeros((2, 0x800), "<u4"), np.zeros((2, sys.maxunicode + 1), "<u8")  # symbols of a code point's bytes, inside and at the end of a piece
        self.kind = np.full(sys.maxunicode + 1, UNASKED, np.uint8)
        self.splits = [(k, pre_tokenizers.Split(Regex(p), "removed", invert=True)) for k, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (OTHER, r"[^\s\p{L}\p{N}]"))]

    @classmethod
    def _symbols(cls) -> tuple[dict[int, str], dict[int, str]]:
        """The symbols of bytes inside of a piece and at its end; those of ASCII texts in lower case are ASCII themselves, which the library reads fastest."""
        common = string.ascii_lowercase + string.punctuation
        pairs = [*((ord(c), False) for c in common), *((ord(c), True) for c in common + string.digits)]
        pairs += [(b, end) for b in range(256) for end in (False, True) if (b, end) not in pairs]
        names = (chr(c) for c in range(1, 0x800) if chr(c) != cls.CUT)
        symbols = dict(zip(pairs, names, strict=False))
        return ({b: symbols[b, end] for b in range(256)} for end in (False, True))

    @staticmethod
    def _spelled(model: dict, inner: dict[str, str], last: dict[str, str]) -> dict[str, str]:
        """The tokens of a model in the symbols of their bytes; ValueError where the model has anything else."""
        end = model.get("end_of_word_suffix")
        if not end or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain model with ends of words")
        out = inner | {c + end: x for c, x in last.items()}
        ends = {c + end for c in last}
        for a, b in model["merges"]:
            if a not in out or b not in out or a in ends or out.setdefault(a + b, out[a] + out[b]) != out[a] + out[b]:
                raise ValueError(f"a merge of other parts: {a} {b}")
            if b in ends:
                ends.add(a + b)
        if out.keys() != model["vocab"].keys():
            raise ValueError("the vocabulary has more or less than bytes and merges")
        return out

    def takes(self, text: str) -> bool:
        return not any(x in text for x in self.added)

    def ask(self, c: int) -> None:
        self.kind[c] = kind = next((k for k, split in self.splits if split.pre_tokenize_str(chr(c))), BLANK)
        if kind != BLANK:
            *head, tail = chr(c).encode()
            for i, end in enumerate((self.inner[tail], self.last[tail])):
                self.four[i, c] = int.from_bytes("".join([*(self.inner[b] for b in head), end]).encode("utf-16-le"), "little")
                if c < 0x800:
                    self.two[i, c] = self.four[i, c]

    def mark(self, texts: list[str], latin: bool) -> list[str]:
        """The symbols of texts that `takes` has taken; latin: all are of Latin-1."""
        texts = [t.lower() if latin else self.normal.normalize_str(t) for t in texts]
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("latin-1"), np.uint8) if latin else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = self.kind[points]
        if (kind == UNASKED).any():
            for c in np.unique(points[kind == UNASKED]).tolist():
                self.ask(c)
            kind = self.kind[points]
        last = kind == NUMBER
        last[:-1] |= kind[:-1] != kind[1:]
        last[-1:] = True
        quotes = np.flatnonzero(points == ord("'"))
        if len(quotes):
            quotes = quotes[(quotes == 0) | (kind[quotes - 1] != OTHER)]  # others are inside a run
            after = np.r_[points, 0, 0]
            first, second = after[quotes + 1], after[quotes + 2]
            short = np.isin(first, [*b"stmd"])
            long = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
            last[quotes[short | long]] = False
            last[quotes[short] + 1] = True
            last[quotes[long] + 2] = True
        table = self.two if latin or points.max(initial=0) < 0x800 else self.four
        symbols = table.ravel()[points + last * np.uint32(table.shape[1])]
        symbols[np.flatnonzero(kind == BLANK)[::BLANKS]] = ord(self.CUT)
        symbols[np.cumsum([len(t) + 1 for t in texts])[:-1] - 1] = ord(self.SEPARATOR)
        bytewise = symbols.view("<u2")
        return bytewise[bytewise != 0].tobytes().decode("utf-16-le").split(self.SEPARATOR)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        narrow = [is_latin(t) for t in texts]
        for latin in (True, False):
            if chosen := [i for i, x in enumerate(narrow) if x is latin]:
                for i, marked in zip(chosen, self.mark([texts[i] for i in chosen], latin), strict=True):
                    out[i] = packed(self.lib.encode_batch_fast([marked], add_special_tokens=False)[0].ids)
        return out


def is_latin(text: str) -> bool:
    """Whether all of a text is Latin-1."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the library's ByteLevel: visible characters of Latin-1 for themselves, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(others)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """The tokenizers library on whole texts, without truncation, padding or special tokens of its own.

    The library keeps up to CACHE words that it has merged, in place of 10,000. Where
    a file has the steps NORMALIZER and SPLIT, the library gets equal ones that
    cost less: `marked`, where the model allows it, for texts without added
    tokens. For the others, `lib` leaves out the change of blanks to spaces, as no piece of
    the split has a blank, and splits by PIECES. `plain` gets the ASCII texts
    without control characters other than blanks; NFC and the letters of bytes
    leave such a text as it is, so it lacks these too. Any other file runs as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = self._from(path)
        self.plain: Tokenizer | None = None
        self.marked: Marked | None = None
        if spec["model"]["type"] == "BPE":
            self.lib.model._resize_cache(CACHE)
        if spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == SPLIT:
            split = pre_tokenizers.Split(Regex(PIECES), "removed", invert=True)
            self.lib.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
            self.lib.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.plain = self._from(path)
            self.plain.model = self.lib.model  # one store of merged words for both
            self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Lowercase(), split
            try:
                self.marked = Marked(spec)
            except ValueError:  # a model of another kind: it gets the other steps
                pass

    @staticmethod
    def _from(path: str) -> Tokenizer:
        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        return lib

    def is_plain(self, text: str) -> bool:
        """Whether `plain` encodes a text as the file does."""
        return self.plain is not None and text.isascii() and len(text.encode().translate(None, CONTROLS)) == len(text)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = [b""] * len(texts)
        rest = range(len(texts))
        if self.marked is not None:
            taken = [self.marked.takes(t) for t in texts]
            chosen, rest = ([i for i, x in enumerate(taken) if x is kind] for kind in (True, False))
            for i, ids in zip(chosen, self.marked.encode_many([texts[i] for i in chosen]), strict=True):
                out[i] = ids
        plain = {i for i in rest if self.is_plain(texts[i])}
        for lib, chosen in ((self.plain, [i for i in rest if i in plain]), (self.lib, [i for i in rest if i not in plain])):
            if chosen:
                for i, e in zip(chosen, lib.encode_batch_fast([texts[i] for i in chosen], add_special_tokens=False), strict=True):
                    out[i] = packed(e.ids)
        return out


_loaded: dict[str, Encoder] = {}


def loaded(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def write_files(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text; other columns are ignored) into DAC files in ascending doc_id order, a null doc_id last.

    The files are the column `file` of a table at `path`, a row each, with
    (part, number) as their order, n_ids, the number of ids of the part before
    them, and the doc_ids of their documents. Returns that table. Null and
    empty texts have the end id alone; rows that repeat are written as often;
    no rows, no file.
    """
    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("file", pa.binary())])
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = loaded(vocabulary), TaskContext.get().partitionId()
        number = before = held = 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def file() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(ids), "<u4")
            return record_batch(schema, [part], [number], [before], [len(data)], [names], [write_dac(data, np.cumsum([len(x) // 4 for x in ids]))])

        for piece, texts in pieces(batches, "text"):
            for doc_id, data in zip(piece.column(0).to_pylist(), encoder.encode_many(texts), strict=True):
                ids.append(data + tail)
                names.append(doc_id)
                held += len(data) // 4 + 1
                if held >= FILE_IDS:
                    yield file()
                    number, before, held, ids, names = number + 1, before + held, 0, [], []
        if names:
            yield file()

    keys = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = narrow.repartitionByRange(partitions, *keys) if partitions else narrow.repartitionByRange(*keys)
    files = ordered.sortWithinPartitions(*keys).mapInArrow(run, "part int, number int, before long, n_ids long, doc_ids array<long>, file binary")
    files.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(files.schema).parquet(path)


def part_starts(files: DataFrame) -> DataFrame:
    """(part, part_start): ids of all parts before each. A part is one write task, so there is a row per task: small enough to sum and broadcast."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in a table of `write_files`, from the files alone.

    start: ids of all documents before it. Only ids per part, a row each, are summed in one place.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    starts = part_starts(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, names, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                dac = DacFile(data)
                ids, ends = dac.all().astype("<u4"), dac.ends.astype(np.int64)
                at = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, ends, strict=True)]
                yield record_batch(schema, names, at + start, ends - at, crc)

    located = files.join(F.broadcast(starts), "part")
    return located.select((F.col("part_start") + F.col("before")).alias("start"), "doc_ids", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(files: DataFrame, position: int) -> int | None:
    """The id at a position of the whole corpus, by random access to the one file that holds it; null beyond the end."""
    starts = part_starts(files)
    first = F.col("part_start") + F.col("before")
    row = files.join(F.broadcast(starts), "part").filter((first <= position) & (first + F.col("n_ids") > position)).select(first.alias("first"), "file").first()
    return None if row is None else DacFile(bytes(row["file"])).token(position - row["first"])
