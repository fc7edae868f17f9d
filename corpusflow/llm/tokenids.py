"""10. Token ids as binary files with Elias-Fano document boundaries.

Documents are dealt into ranges of ascending doc_id, encoded, and written as blocks.  A block file holds the ids of its
documents in one array (16 or 32 bits each) and, as Elias-Fano sequences, where each document ends and how far each
doc_id lies above the smallest one.  An Elias-Fano sequence of n values up to u keeps the low bits packed and the high
bits in unary: about 2 + log2(u / n) bits a value.  ``select`` samples (the place of every 64th set bit) answer
"where does document i begin" without a table of 64-bit offsets.

File layout, little-endian: magic ``CFTOKEN1``, header (part, block, documents, tokens, tokens of the part before this
block, smallest doc_id, id width, number of null doc_ids), the two sequences, the ids, one closing newline.

Files are written and read by Spark's own writers and readers (a block is one row of the text writer and one row of
the binary reader), so a task that is lost writes again without leftovers and any store that Spark knows serves.

Reading asks ``select`` for the boundaries of the documents that are returned.

Defined results: a null or empty text is a document that holds the end id only; a very long text is one document in a block
of its own; null doc_ids come first; rows that repeat a doc_id are separate documents in the order of (doc_id, text), those
equal in both in any order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import offsets_of

MAGIC = b"CFTOKEN1"
HEADER = struct.Struct("<8sIIQQQqII")
#: Ids in a block before the next one begins; a longer document has a block of its own.
BLOCK_IDS = 8_000_000
#: Pieces in each half of a worker's memory, and the longest that it keeps.
MEMO, MEMO_CHARS = 400_000, 64
#: Bytes of text that are worked on together; words that go to the library in one call.
RUN_BYTES, CALL = 2 << 20, 20_000
SAMPLE = 64
#: Letters for certain, and marks; an apostrophe isn't one, since it may begin a contraction.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
WORD = re.compile(rf"( ?)([{_LETTER}]+)([{_MARK}]*)").fullmatch
#: White space other than the plain space and line feed, as a class of the expressions that Arrow runs.
_BLANK = r"\x00\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_POPCOUNT = np.asarray([b.bit_count() for b in range(256)], np.int64)
#: Of each byte, the places of its set bits in order.
_NTH = np.asarray([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            bits = ((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
            low = np.packbits(bits, bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32 if not n or ones[-1] < 2**32 else np.uint64))

    def pack(self) -> bytes:
        wide = self.samples.dtype.itemsize
        head = struct.pack("<QBBQQQ", self.n, self.low_bits, wide, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def unpack(cls, data: memoryview) -> tuple[EliasFano, int]:
        head = struct.Struct("<QBBQQQ")
        n, low_bits, wide, a, b, c = head.unpack_from(data)
        p = head.size
        low = np.frombuffer(data, np.uint8, a, p)
        high = np.frombuffer(data, np.uint8, b, p + a)
        samples = np.frombuffer(data, f"<u{wide}", c, p + a + b)
        return cls(n, low_bits, low, high, samples), p + a + b + c * wide

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The place of the i-th set bit among the high bits."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bit = divmod(at, 8)
        word = int(self.high[byte]) >> bit << bit
        while True:
            have = word.bit_count()
            if left < have:
                for _ in range(left):
                    word &= word - 1
                return byte * 8 + (word & -word).bit_length() - 1
            left -= have
            byte += 1
            word = int(self.high[byte])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        low = 0
        for k in range(self.low_bits):
            b = i * self.low_bits + k
            low |= (int(self.low[b >> 3]) >> (b & 7) & 1) << k
        return (self.select(i) - i) << self.low_bits | low

    def take(self, places) -> np.ndarray:
        """The values at these places, by select from the samples."""
        i = np.asarray(places, dtype=np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        at, left = self.samples[i // SAMPLE].astype(np.int64), i % SAMPLE
        byte = at >> 3
        word = self.high[byte].astype(np.int64) & (0xFF << (at & 7))
        while (go := left >= (have := _POPCOUNT[word])).any():
            left = np.where(go, left - have, left)
            byte = byte + go
            word = np.where(go, self.high[np.minimum(byte, len(self.high) - 1)], word)
        out = (byte * 8 + _NTH[word, left] - i) << self.low_bits
        for k in range(self.low_bits):
            b = i * self.low_bits + k
            out |= (self.low[b >> 3].astype(np.int64) >> (b & 7) & 1) << k
        return out

    def all(self) -> np.ndarray:
        """Every value, decoded at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        out = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def nbytes(self) -> int:
        return len(self.low) + len(self.high) + self.samples.nbytes


class Block:
    """A block file: ``ids(i)`` are those of its i-th document."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.part, self.block, self.docs, self.tokens, self.before, least, width, self.nulls = HEADER.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token block")
        p = HEADER.size
        self.ends, n = EliasFano.unpack(view[p:])
        p += n
        above, n = EliasFano.unpack(view[p:])
        p += n
        self.array = np.frombuffer(view, f"<u{width}", self.tokens, p)
        self.least, self.above = least, above
        if len(data) != p + self.tokens * width + 1:
            raise ValueError("a token block is cut short")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.above[i - self.nulls]

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def ids(self, i: int) -> np.ndarray:
        a, b = self.span(i)
        return self.array[a:b]


def header_of(data: bytes) -> tuple:
    return HEADER.unpack(data[: HEADER.size])


def pack_block(part: int, block: int, before: int, doc_ids: list[int | None], lengths: list[int], ids: list[bytes], width: int) -> bytes:
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    ends = np.cumsum(np.asarray(lengths, dtype=np.uint64))
    above = np.asarray([d - least for d in known], dtype=np.uint64)
    head = HEADER.pack(MAGIC, part, block, len(doc_ids), int(ends[-1]), before, least, width, len(doc_ids) - len(known))
    return b"".join([head, EliasFano.build(ends).pack(), EliasFano.build(above).pack(), *ids])


class PieceEncoder:
    """The tokenizers library behind a memory of the pieces that texts are made of.

    A byte-level pattern starts a new token at each space that stands between visible characters, at a mark behind a letter
    and around a line feed between visible characters, so text falls into independent pieces there.  A run of texts is cut
    and its distinct pieces are found in Arrow; texts with other white space are cut at such spaces only, and those with
    a special token go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = 2 if self.lib.get_vocab_size(with_added_tokens=True) < 2**16 else 4
        self.form = f"<u{self.width}"
        special = sorted(t.content for t in self.lib.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self.odd = "|".join([r"[ \n][ \n]", r"[ \n]\z", f"[{_BLANK}]", *map(re.escape, special)])
        self.apart = re.compile(r"(?<=\S)(?= \S)").split
        self.line = int(np.frombuffer(self._encode(["\n"])[0], self.form)[0])
        self.opens = np.zeros(self.lib.get_vocab_size(with_added_tokens=True), bool)  # tokens that begin with a space
        self.opens[[i for t, i in self.lib.get_vocab().items() if t[0] == "Ġ"]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.form).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of letters only, all with a space before them or all without one: many in one text."""
        spaced = bool(words) and words[0][0] == " "
        for lo in range(0, len(words), CALL):
            ids = np.frombuffer(self._encode([("" if spaced else "\n").join(words[lo : lo + CALL])])[0], self.form)
            data, w = ids.tobytes(), self.width
            if spaced:
                at = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
                yield from (data[a * w : b * w] for a, b in zip(at[:-1], at[1:], strict=True))
            else:
                at = [-1, *np.flatnonzero(ids == self.line).tolist(), len(ids)]
                yield from (data[(a + 1) * w : b * w] for a, b in zip(at[:-1], at[1:], strict=True))

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces."""
        new, old = self.new, self.old
        found = [*map(new.get, pieces)]
        if None not in found:
            return found
        made: dict[str, bytes] = {}
        parts: dict[str, tuple[str, str]] = {}
        spaced, bare, other = {}, {}, {}

        def want(part: str, into: dict) -> None:
            if part not in made:
                if (f := new.get(part) or old.get(part)) is not None:
                    made[part] = f
                else:
                    into[part] = None

        for p, f in zip(pieces, found, strict=True):
            if f is None and (f := old.get(p)) is not None:
                made[p] = f
            elif f is None:
                m = WORD(p)
                if m is None:
                    other[p] = None
                elif m[3]:
                    stem = m[1] + m[2]
                    parts[p] = stem, m[3]
                    want(stem, spaced if m[1] else bare)
                    want(m[3], other)
                else:
                    (spaced if m[1] else bare)[p] = None
        for group in (spaced, bare):
            made.update(zip(group, self._words([*group]), strict=True))
        made.update(zip(other, self._encode([*other]), strict=True))
        made.update({p: made[a] + made[b] for p, (a, b) in parts.items()})
        out = [made[p] if f is None else f for p, f in zip(pieces, found, strict=True)]
        if len(new) + len(made) > MEMO:  # what is in use moves on from the older half
            self.old, self.new = new, {}
        self.new.update((p, f) for p, f in made.items() if len(p) <= MEMO_CHARS)
        return out

    def run(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts, each packed."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.odd)
        cut = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        cut = pc.replace_substring(pc.replace_substring(cut, " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(pc.replace_substring_regex(cut, r"([A-Za-z])([.,;:!?])", "\\1\0\\2"), "\0")
        coded = lists.values.dictionary_encode()
        ids = pa.array(self.pieces(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        ends = offsets_of(ids)[lists.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            text = texts[i].as_py()
            out[i] = self._encode([text])[0] if self.special(text) else self._apart(self.apart(text))
        return out

    def _apart(self, pieces: list[str]) -> bytes:
        known = dict.fromkeys(pieces)
        known = dict(zip(known, self.pieces([*known]), strict=True))
        return b"".join([known[p] for p in pieces])

    def encode(self, text: str) -> bytes:
        return self.run(pa.array([text]))[0]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def write_token_files(
    df: DataFrame, out: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2, parts: int | None = None
) -> None:
    """Encode every whole text, append ``end_id`` and write block files under ``out`` in ascending order of doc_id.

    The range partitioner also takes the text's hash and the row's place, so one doc_id on many rows is spread over parts.
    """
    spark = df.sparkSession
    file = path or common.tokenizer_path("byte_bpe_50k.json")
    common.small_batches(spark)
    n = parts or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(file), TaskContext.get().partitionId()
        end = np.asarray([end_id], enc.form).tobytes()
        block = before = held = 0
        doc_ids: list = []
        lengths: list[int] = []
        ids: list[bytes] = []

        def flush():
            nonlocal block, before, held
            data = pack_block(part, block, before, doc_ids, lengths, ids, enc.width)
            block, before, held = block + 1, before + sum(lengths), 0
            for x in (doc_ids, lengths, ids):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        for b in common.runs(batches, 1, RUN_BYTES):
            for d, data in zip(b.column(0).to_pylist(), enc.run(b.column(1)), strict=True):
                data += end
                size = len(data) // enc.width
                if held and held + size > BLOCK_IDS:
                    yield flush()
                doc_ids.append(d)
                lengths.append(size)
                ids.append(data)
                held += size
        if held:
            yield flush()

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("h"), F.monotonically_increasing_id().alias("k"))
    by = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("k")]
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    blocks = dealt.select("doc_id", "text").mapInArrow(run, "data binary")
    blocks.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(out)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """The documents of the block files: doc_id, start (ids of all documents before), n_tokens, ids (unsigned 32-bit).

    Only each part's total goes to the driver, a number for each part.
    """
    # a block is its file's only row: the reader never splits it
    files = spark.read.format("binaryFile").load(out).select("content")
    common.small_batches(spark)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [header_of(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[1] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.int64())], names=["part", "tokens"])

    totals = {r.part: r.n for r in files.select(F.substring("content", 1, HEADER.size).alias("content")).mapInArrow(heads, "part long, tokens long").groupBy("part").agg(F.sum("tokens").alias("n")).collect()}
    starts, so_far = {}, 0
    for p in sorted(totals):
        starts[p], so_far = so_far, so_far + totals[p]

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                x = Block(data.as_py())
                base = starts[x.part] + x.before
                for lo in range(0, x.docs, 256):
                    hi = min(x.docs, lo + 256)
                    ends = x.ends.take(range(lo, hi))
                    begins = np.concatenate([[x.ends[lo - 1] if lo else 0], ends[:-1]])
                    names = [None] * max(0, x.nulls - lo) + (x.above.take(range(max(0, lo - x.nulls), hi - x.nulls)) + x.least).tolist()
                    ids = [x.array[a:e].astype("<u4").tobytes() for a, e in zip(begins, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[: hi - lo], pa.int64()), pa.array(begins + base), pa.array(ends - begins), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return files.mapInArrow(docs, "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.narrow(common.table(spark, sf_dir, "documents"), ["doc_id", "text"])
    out = common.new_path(spark, "tokens")
    write_token_files(docs, out)
    return read_token_files(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op10_token_ids": op10_token_ids}
