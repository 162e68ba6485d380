"""Token-id files with Elias-Fano document boundaries.

File format (little endian), one file per range of ascending ids::

    8 bytes       magic  b"CLTOKEF2"
    u * width     ids of all documents, one after the other, padded to 8 bytes
    n * 8 bytes   doc_ids (i64; the least i64 stands for null)
    n * l bits    low parts of the n boundaries, packed, padded to 8 bytes
    high part     boundary i sets bit (b_i >> l) + i, padded to 8 bytes
    trailer       u64 documents n, u64 ids u, u64 bytes of the high part,
                  u32 bytes per id, u32 low bits per boundary l, magic

Boundary i is the number of ids before document i + 1 in this file (the end of
document i), so n boundaries with n * (2 + log2(u / n)) bits replace a table of
64-bit offsets.  Readers get boundaries by ``select`` alone, a block of documents
at a time: byte popcounts of the high part lead to the bits of the block, and only
those are unpacked.  Positions over the whole corpus add the totals of the files before.

The boundaries stand after the ids, so a writer sends ids out as they come and
holds two numbers a document; a reader fetches the ids of the documents it asks for.

Ids come from the tokenizers library, with its settings as the file gives them.
Its byte-level BPE encodes pre-tokens one by one, so the encoder keeps the ids of
frequent pre-tokens and asks the library only for the others; results are the
same, several times faster.  Texts that hold the string of an added token go to the library whole.

Cases: null = empty text = the end id alone; null doc_ids come first; repeated
doc_ids follow one another in an order of their texts (by hash) and may stand in
several files, so no id has to fit into one task; an empty table gives no files
and an empty result; a text of any length is encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import input_partitions, new_path, small_batches, tidied

MAGIC = b"CLTOKEF2"
TRAILER = struct.Struct("<QQQII8s")
NULL_ID = -(1 << 63)
CACHE_PIECES = 1_000_000
TEXT_BYTES_AT_ONCE = 1 << 20
JOINED_PIECES = 4096
DOCS_AT_ONCE = 512
COPY_IDS = 1 << 20
FILES_PER_SPLIT = 2
#: Fixed value: the byte-level pre-token pattern that the tokenizer file's "use_regex" stands for.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Signs that often end a word.
ENDS = frozenset(",.;:!?")
#: White space other than the space and the line feed.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


# ------------------------------------------------------------ encoding
class Encoder:
    """Texts to ids with a tokenizers file; pre-tokens are remembered where that gives the same ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.piecewise = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and spec["model"].get("type") == "BPE"
            and not spec["model"].get("dropout")
            and not spec["model"].get("continuing_subword_prefix")
            and not spec["model"].get("end_of_word_suffix")
        )
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        if any(x != "".join(x.split()) or x.isalpha() for x in self.added):
            self.piecewise = False  # joined words could then hold one
        self.pattern = regex.compile(PIECES)
        self.known: dict = {}  # what follows a space
        self.bare: dict = {}  # pieces as they are

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list) -> list:
        """The ids of each text.

        Texts are cut before every space.  That is where a pre-token begins, unless white space stands on the
        other side too; texts with such places, or with other white space, are cut by the pattern itself.
        """
        if not self.piecewise:
            return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        out: list = [None] * len(texts)
        simple = []
        for i, text in enumerate(texts):
            if any(x in text for x in self.added):
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
            elif self._simple(text):
                simple.append(i)
            else:
                out[i] = np.frombuffer(b"".join(self._pieces(self.pattern.findall(text))), dtype="<u4")
        for i, ids in zip(simple, self._spaced([texts[i] for i in simple]) if simple else ()):
            out[i] = ids
        return out

    def _spaced(self, texts: list) -> list:
        """The ids of texts that are cut before every space: each distinct word is looked up once for all of them."""
        known = self.known
        if len(known) > CACHE_PIECES:
            known.clear()
        if len(self.bare) > CACHE_PIECES // 8:
            self.bare.clear()
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values
        coded = words.dictionary_encode()
        owner = coded.indices.to_numpy().astype(np.int64)
        # Words hold no space, so one string carries them all to Python.
        n = len(coded.dictionary)
        names = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, n], pa.int64()), coded.dictionary), " ")[0].as_py().split(" ")
        found = list(map(known.get, names))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = [names[i] for i in missing]
            self._learn(set(new))
            for i, w in zip(missing, new):
                found[i] = known[w]
        # A text's first word has no space before it.
        owner[offsets[:-1]] = len(found) + np.arange(len(texts))
        found += self._pieces(words.take(pa.array(offsets[:-1])).to_pylist())
        table = np.frombuffer(b"".join(found), dtype="<u4")
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        first = np.cumsum(sizes) - sizes
        lengths = sizes[owner]
        ends = np.r_[0, np.cumsum(lengths)]
        ids = table[np.repeat(first[owner] - ends[:-1], lengths) + np.arange(int(ends[-1]))]
        cuts = ends[offsets].tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _simple(self, text: str) -> bool:
        return "  " not in text and "\n " not in text and not any(c in text for c in OTHER_SPACE)

    def _pieces(self, pieces: list) -> list:
        """The ids of pieces as they stand, as bytes; all new ones go to the library at once."""
        bare = self.bare
        new = [p for p in dict.fromkeys(pieces) if p not in bare]
        if new:
            bare.update(zip(new, [array("I", x.ids).tobytes() for x in self.library.encode_batch(new, add_special_tokens=False)]))
        return list(map(bare.__getitem__, pieces))

    def _learn(self, new: set) -> None:
        """Ids of what follows a space up to the next.

        Words of letters are one pre-token each: many go to the library in one text, whose word numbers part them.
        Anything else is put together from its pre-tokens.
        """
        known, findall = self.known, self.pattern.findall
        words = set(filter(str.isalpha, new))
        mixed = new.difference(words)
        marked = [w for w in mixed if w[-1:] in ENDS and w[:-1].isalpha()]  # a word and one sign
        mixed = {w: findall(" " + w) for w in mixed.difference(marked)}
        words.update([w[:-1] for w in marked])
        words.update([p[1:] for pieces in mixed.values() for p in pieces if p[0] == " " and p[1:].isalpha()])
        words = list(words.difference(known))
        for k in range(0, len(words), JOINED_PIECES):
            part = words[k : k + JOINED_PIECES]
            found = self.library.encode(" " + " ".join(part), add_special_tokens=False)
            ids, owner = np.array(found.ids, dtype="<u4"), np.array(found.word_ids)
            cuts = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(ids)] * 4
            if len(cuts) != len(part) + 1:
                raise ValueError("the pre-tokenizer cuts elsewhere than its pattern")
            raw, cuts = ids.tobytes(), cuts.tolist()
            known.update(zip(part, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]))
        signs = dict(zip(ENDS, self._pieces(list(ENDS))))
        known.update([(w, known[w[:-1]] + signs[w[-1]]) for w in marked])
        self._pieces([p for pieces in mixed.values() for p in pieces if not (p[0] == " " and p[1:].isalpha())])
        bare = self.bare
        for w, pieces in mixed.items():
            known[w] = b"".join([known[p[1:]] if p[0] == " " and p[1:].isalpha() else bare[p] for p in pieces])



def blocks(texts: pa.Array):
    """The texts in lists of some megabytes each; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES_AT_ONCE, side="right")))
        yield texts.slice(at, stop - at).to_pylist()
        at = stop


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker; its own threads would only fight for the task's core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


# ------------------------------------------------------------ Elias-Fano
def elias_fano(ends: np.ndarray, total: int) -> tuple:
    """(low bits, low part, high part) of non-decreasing values up to total."""
    n = len(ends)
    low_bits = max(0, (total // max(1, n)).bit_length() - 1)
    ends = ends.astype(np.uint64)
    low = b""
    if low_bits:
        bits = ((ends[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        low = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    high = np.zeros(-(-((total >> low_bits) + n + 1) // 64) * 64, dtype=np.uint8)
    high[((ends >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)] = 1
    pad = -len(low) % 8
    return low_bits, low + b"\0" * pad, np.packbits(high, bitorder="little").tobytes()


class Boundaries:
    """Select over an Elias-Fano sequence without a table of its values."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, dtype=np.uint8), np.frombuffer(high, dtype=np.uint8)
        self.block = 64  # bytes of the high part for each entry of the rank directory
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ranks = np.r_[0, np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), self.block)))] if len(ones) else np.zeros(1, np.int64)

    def select(self, i: int) -> int:
        """Value number i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.span(i, i + 1)[0])

    def span(self, first: int, last: int) -> np.ndarray:
        """Values number first to last - 1; only their blocks are unpacked."""
        if first >= last:
            return np.zeros(0, dtype=np.int64)
        low = int(np.searchsorted(self.ranks, first, side="right")) - 1
        high = int(np.searchsorted(self.ranks, last, side="left"))
        part = np.unpackbits(self.high[low * self.block : high * self.block], bitorder="little")
        skip = first - int(self.ranks[low])
        spots = np.flatnonzero(part)[skip : skip + last - first] + low * self.block * 8
        return (spots - np.arange(first, last)) << self.low_bits | self._low(first, last)

    def _low(self, first: int, last: int) -> np.ndarray:
        width = self.low_bits
        if not width:
            return np.zeros(last - first, dtype=np.int64)
        start = first * width >> 3
        bits = np.unpackbits(self.low[start : (last * width + 7) >> 3], bitorder="little")[first * width - 8 * start :]
        return bits[: (last - first) * width].reshape(-1, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def footer(sizes: np.ndarray, doc_ids: np.ndarray, width: int) -> bytes:
    """What follows the ids of a file."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    low_bits, low, high = elias_fano(ends, total)
    pad = b"\0" * (-total * width % 8)
    low, high = low + b"\0" * (-len(low) % 8), high + b"\0" * (-len(high) % 8)
    return pad + doc_ids.astype("<i8").tobytes() + low + high + TRAILER.pack(len(ends), total, len(high), width, low_bits, MAGIC)


class TokenFile:
    """A file of this format, open for random access: ids of any document by number."""

    def __init__(self, source):
        """source: an Arrow file, open for reading at any place."""
        self.source = source
        size = source.size()
        self.n, self.total, high, self.width, low_bits, magic = TRAILER.unpack(source.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        low = -(-(-(-self.n * low_bits // 8)) // 8) * 8
        at = size - TRAILER.size - high - low
        self.names_at = at - 8 * self.n
        self.bounds = Boundaries(self.n, low_bits, source.read_at(low, at), source.read_at(high, at + low))

    @classmethod
    def of(cls, raw: bytes) -> TokenFile:
        return cls(pa.BufferReader(raw))

    def names(self, first: int, last: int) -> np.ndarray:
        """The doc_ids of documents first to last - 1."""
        return np.frombuffer(self.source.read_at(8 * (last - first), self.names_at + 8 * first), dtype="<i8")

    def starts(self, first: int, last: int) -> np.ndarray:
        """Where documents first to last - 1 begin, and where the last of them ends."""
        return np.r_[0, self.bounds.span(0, last)] if not first else self.bounds.span(first - 1, last)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1 of the file."""
        return np.frombuffer(self.source.read_at(self.width * (last - first), len(MAGIC) + self.width * first), dtype=f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i - 1) if i else 0, self.bounds.select(i))


# ------------------------------------------------------------ files
def filesystem(uri: str) -> tuple:
    """(file system, path) of a folder in any store that pyarrow opens; plain paths are local."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2) -> DataFrame:
    """Write docs (doc_id, text) as token-id files in ascending doc_id order; returns (file, name, n_docs, n_ids), one row per file.

    Each task writes to a name of its own attempt and renames it when whole, so
    lost or doubled tasks leave no half files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = FILES_PER_SPLIT * input_partitions(docs)

    def run(batches):
        import uuid

        from pyspark import TaskContext

        store, base = filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.ids"
        attempt = f"{base}/.{name}-{uuid.uuid4().hex}"
        names, sizes, out = array("q"), array("q"), None
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        try:
            for batch in batches:
                names.extend(batch.column(0).fill_null(NULL_ID).to_pylist())
                for texts in blocks(batch.column(1)):
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(attempt)
                        out.write(MAGIC)
                    for found in encoder(tokenizer).encode_all(texts):
                        if width == 2 and len(found) and int(found.max()) > 65535:
                            raise ValueError("an id needs more than two bytes: use width=4")
                        out.write(found.astype(f"<u{width}").tobytes() + end)
                        sizes.append(len(found) + 1)
            if out is None:
                return
            out.write(footer(np.array(sizes, dtype=np.int64), np.array(names, dtype=np.int64), width))
        finally:
            if out is not None:
                out.close()
        store.move(attempt, f"{base}/{name}")
        yield pa.RecordBatch.from_pylist([{"file": part, "name": name, "n_docs": len(sizes), "n_ids": sum(sizes)}])

    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    picked = picked.withColumn("h", F.xxhash64("text"))  # rows of one doc_id are dealt out too
    first = F.col("doc_id").asc_nulls_first()
    dealt = picked.repartitionByRange(parts, first, "h").sortWithinPartitions(first, "h", "text").select("doc_id", "text")
    return dealt.mapInArrow(tidied(run), "file long, name string, n_docs long, n_ids long")


def sum_ids(held: TokenFile, starts: np.ndarray) -> list:
    """crc32 of the ids of each document, as u32; ids are fetched some million at a time."""
    sums, k, n = [], 0, len(starts) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(starts, starts[k] + COPY_IDS, side="right")) - 1)
        ids = held.ids(int(starts[k]), int(starts[stop])).astype("<u4")
        cuts = ((starts[k : stop + 1] - starts[k]) * 4).tolist()
        raw = memoryview(ids).cast("B")
        sums += [zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        k = stop
    return sums


def read(spark: SparkSession, folder: str, files: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, one row per document, from the files; files: (file, name, n_docs, n_ids) rows."""
    before, rows = 0, []
    for f in sorted(files, key=lambda x: x["file"]):
        rows.append((f["name"], before))
        before += f["n_ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(rows, "name string, before long").repartition(len(rows))

    def run(batches):
        store, base = filesystem(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{base}/{name}") as f:
                    held = TokenFile(f)
                    for k in range(0, held.n, DOCS_AT_ONCE):
                        last = min(held.n, k + DOCS_AT_ONCE)
                        starts = held.starts(k, last)
                        sums = sum_ids(held, starts)
                        names = held.names(k, last)
                        columns = [pa.array(names, pa.int64(), mask=names == NULL_ID), pa.array(starts[:-1] + before), pa.array(np.diff(starts)), pa.array(sums, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(tidied(run), schema)


def export(docs: DataFrame, tokenizer: str, end_id: int, width: int = 2, folder: str | None = None) -> DataFrame:
    """Write the files, read them back: the result of read() over everything written."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-ids")
    return read(spark, folder, write(docs, folder, tokenizer, end_id, width).collect())
