"""1. BPE encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds the ranks of possible merges.  The lowest
rank goes first (ties: leftmost); entries whose symbols changed meanwhile are stale and skipped.  Decoding looks
up the vocabulary string of each id and concatenates.

The encoder reads the vocabulary file itself (normaliser, split pattern, byte map, end-of-word suffix, special
tokens) and follows it exactly; which code points are letters or numbers is asked of the tokenizers library once, on the
driver.  Texts come in runs of about ``RUN_BYTES``: a run is cut at white space and its distinct pieces are found in Arrow,
each piece is encoded once, and Arrow puts the results in the places of the pieces.  Words repeat beyond a run, so each
worker keeps what it has met lately; that store is bounded.

Defined results: a null text counts as empty (no ids, decoded text empty); a very long text is a run of its own and is
encoded whole; repeated rows and ties are encoded row by row; an empty table gives no rows; other columns pass through,
those named like an output column are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from . import common

#: Words and pieces in each half of a worker's memory, and the longest that it keeps.
MEMO, MEMO_CHARS = 300_000, 64
#: Bytes of text that are worked on together.
RUN_BYTES = 2 << 20
#: The usual piece, letters and the marks after them: it needs no look at the whole pattern.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def library_class(name: str) -> str:
    """The code points of a Unicode category as the tokenizers library has them, as ranges for a bracket.

    Unicode grows: a package may take a code point for a letter that the library doesn't know yet.  All that the package
    knows are shown to the library in a row, after one that belongs to the class for certain.
    """
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    shown = {"L": "a", "N": "0"}[name] + "".join(regex.findall(rf"\p{{{name}}}", points))
    runs = pre_tokenizers.Split(Regex(rf"\p{{{name}}}+"), "isolated").pre_tokenize_str(shown)  # in turn: of the class, not of it
    out: list[list[int]] = []
    for c in sorted({ord(c) for run, _ in runs[::2] for c in run}):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


_patterns: dict[str, str] = {}


def split_pattern(path: str) -> str:
    """The split pattern of a vocabulary file with its classes of letters and numbers as ranges (they stand in brackets)."""
    if path not in _patterns:
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)["pre_tokenizer"]["pretokenizers"]
        pattern = next(s for s in steps if s["type"] == "Split")["pattern"]["Regex"]
        for name in ("L", "N"):
            pattern = pattern.replace(rf"\p{{{name}}}", library_class(name))
        _patterns[path] = pattern
    return _patterns[path]


class WordBpe:
    """Encoder and decoder for a vocabulary file with word ends (``</w>``)."""

    def __init__(self, path: str, pattern: str | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix: str = model.get("end_of_word_suffix") or ""
        self.names = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: s for s, i in self.special.items()}
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        self.normal = normalizers.Sequence([getattr(normalizers, k)() for k in steps if k != "Replace"]).normalize_str
        self.lowered = "Lowercase" in steps
        self.words_of = regex.compile(pattern or split_pattern(path)).findall
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        alphabet = byte_alphabet()
        self.first = [self.vocab.get(c) for c in alphabet]
        self.last = [self.vocab.get(c + suffix) for c in alphabet]
        # a merge by its rank: left, right, what they become; and the rank of a pair
        self.left, self.right, self.made = [], [], []
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.vocab[left], self.vocab[right]
            self.left.append(a)
            self.right.append(b)
            self.made.append(self.vocab[left + right])
            self.rank.setdefault(a << 20 | b, rank)
        # the same for two bytes within a word: a small table for the first entries of a queue
        at = {i: b for b, i in enumerate(self.first) if i is not None}
        self.byte_rank = {at[k >> 20] << 8 | at[k & 0xFFFFF]: r for k, r in self.rank.items() if k >> 20 in at and k & 0xFFFFF in at}
        self.spoken: pa.Array | None = None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, ids: list[int], queue: list[int] | None = None) -> list[int]:
        """Apply the merges to the symbols of one word.

        A queue entry is rank << 40 | place, so the queue sorts by rank, then from the left; ``queue`` has the first ones.
        """
        n, rank, left, right, made = len(ids), self.rank.get, self.left, self.right, self.made
        if queue is None:
            queue = [r << 40 | i for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        if not queue:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            x = pop(queue)
            r, i = x >> 40, x & 0xFFFFFFFFFF
            j = after[i]
            if ids[i] != left[r] or j < 0 or ids[j] != right[r]:
                continue  # stale
            m = made[r]
            ids[i], ids[j] = m, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(m << 20 | ids[k])) is not None:
                    push(queue, r << 40 | i)
            h = before[i]
            if h >= 0 and (r := rank(ids[h] << 20 | m)) is not None:
                push(queue, r << 40 | h)
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> list[int]:
        data = word.encode()
        ids = [*map(self.first.__getitem__, data)]
        ids[-1] = self.last[data[-1]]
        if None in ids:
            return self.merge([i for i in ids if i is not None])
        n, pairs = len(ids), self.byte_rank.get
        queue = [r << 40 | i for i in range(n - 2) if (r := pairs(data[i] << 8 | data[i + 1])) is not None]
        if n > 1 and (r := self.rank.get(ids[-2] << 20 | ids[-1])) is not None:
            queue.append(r << 40 | n - 2)
        return self.merge(ids, queue)

    def normalized(self, text: str) -> str:
        """The library's normaliser (its tables of letter case and composition); white space needs no replacing here."""
        if text.isascii():
            return text.lower() if self.lowered else text
        return self.normal(text)

    def split(self, text: str) -> list[str]:
        """The words and special tokens of a text."""
        if "<|" not in text:
            text = self.normalized(text)
            if m := PLAIN(text):
                return [m[1], m[2]] if m[2] else [m[1]]
            return self.words_of(text)
        out: list[str] = []
        for k, part in enumerate(self.special_at.split(text)):
            out += [part] if k % 2 else self.words_of(self.normalized(part))
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [i for w in self.split(text) for i in ([self.special[w]] if w in self.special else self.word(w))]

    def decode(self, ids) -> str:
        """The vocabulary strings of the ids, a space between them (the file names no decoder)."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def _one(self, word: str) -> bytes:
        ids = [self.special[word]] if word in self.special else self.word(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, piece: str) -> bytes:
        """Ids (little-endian unsigned 32-bit integers) of a piece without white space."""
        found = self.new.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                words = [piece] if self.lowered and piece.isascii() and piece.isalpha() and piece.islower() else self.split(piece)
                if len(words) == 1 and words[0] == piece:
                    found = self._one(piece)
                else:  # a word is kept only if it is a piece that stays as it is
                    found = b"".join([self.piece(w) if w.isascii() or self.normalized(w) == w else self._one(w) for w in words])
            if len(piece) <= MEMO_CHARS:
                if len(self.new) >= MEMO:  # what is in use moves on from the older half
                    self.old, self.new = self.new, {}
                self.new[piece] = found
        return found

    def packed(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Numbers of tokens and packed ids of whole texts.

        No word and no special token holds white space, so a text falls into independent pieces there.  A mark behind a
        letter is a word apart, and A-Z count as a-z, unless a special token may be there: so fewer pieces differ.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.lowered and not pc.any(pc.match_substring(texts, "<|")).as_py():
            # in this order: ascii_lower misplaces the values of an array that is a slice of another
            texts = pc.ascii_lower(pc.replace_substring_regex(texts, r"([A-Za-z])([.,;:!?])", r"\1 \2"))
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.values.dictionary_encode()
        get, piece = self.new.get, self.piece
        made = pa.array([piece(p) if (f := get(p)) is None else f for p in coded.dictionary.to_pylist()], pa.large_binary())
        ids = made.take(coded.indices)
        ends = offsets_of(ids)[lists.offsets.to_numpy()]
        return pa.array(np.diff(ends) // 4, pa.int64()), between(ids.buffers()[2], ends)

    def decoded(self, packed: pa.Array) -> pa.Array:
        """The texts that packed ids (null: none) decode to: their vocabulary strings, a space between them."""
        if self.spoken is None:  # each id's string and a space; ids without a string say nothing
            top = max(self.names, default=-1) + 1
            self.spoken = pa.array([f"{self.names[i]} " if i in self.names else "" for i in range(top)] + [""], pa.large_string())
        packed = packed.cast(pa.large_binary()).fill_null(b"")
        ends = offsets_of(packed)
        ids = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u4")
        said = self.spoken.take(pa.array(np.minimum(ids, len(self.spoken) - 1)))
        to = offsets_of(said)[(ends - ends[0]) // 4]
        return between(said.buffers()[2], to, last=1).cast(pa.string())


def offsets_of(a: pa.Array) -> np.ndarray:
    """Where the values of a large binary or string array begin in its bytes, and where the last one ends."""
    return np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]


def between(data: pa.Buffer | None, ends: np.ndarray, last: int = 0) -> pa.Array:
    """The bytes from each place to the next one; ``last`` bytes at the end of each stretch that isn't empty are left out."""
    whole, at = data.to_pybytes() if data else b"", ends.tolist()  # an array made of memory views would never free them
    return pa.array([whole[a : max(a, b - last)] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())


_encoders: dict[str, WordBpe] = {}


def encoder(path: str, pattern: str | None = None) -> WordBpe:
    if path not in _encoders:
        _encoders[path] = WordBpe(path, pattern)
    return _encoders[path]


def bpe_encode(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Add ``n_tokens`` (long), ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` to each row.

    path: the vocabulary file, as each executor finds it (default: the public word-level file).
    """
    file = path or common.tokenizer_path("word_bpe_49k.json")
    common.small_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in ("n_tokens", "ids", "decoded")]
    held = text in ("n_tokens", "ids", "decoded")
    source = df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text}`").alias("__text"))
    if not held:
        at = [f.name for f in keep].index(text)
        source = df.select(*[F.col(f"`{f.name}`") for f in keep])
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    pattern = split_pattern(file)

    where = len(keep) if held else at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file, pattern)
        for b in common.runs(batches, where, RUN_BYTES):
            n, ids = enc.packed(b.column(where))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n, ids, enc.decoded(ids)], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``decoded``: the vocabulary strings of packed ids (null: empty)."""
    file = path or common.tokenizer_path("word_bpe_49k.json")
    common.small_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name != "decoded"]
    at = [f.name for f in keep].index(ids)
    schema = T.StructType([*keep, T.StructField("decoded", T.StringType())])
    pattern = split_pattern(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, enc.decoded(b.column(at))], names=[f.name for f in schema.fields])

    return df.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.narrow(common.table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return bpe_encode(docs).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


QUERIES = {"op1_bpe": op1_bpe}
