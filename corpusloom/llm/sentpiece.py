"""SentencePiece encoding and decoding through a relational lattice.

A text is cut into units: runs of the space mark followed by other characters,
cut again where an ASCII sign follows a letter.  No piece crosses a unit's end, which
is checked when the vocabulary is loaded.  The units go through a lattice:

1. explode the substrings of bounded length of every unit,
2. equi-join them to the piece table,
3. group the edges by unit,
4. fold them with the higher-order function ``aggregate``.

For a unigram vocabulary the fold is Viterbi.  For a BPE vocabulary, like the
public one used here, the likeliest path is not what SentencePiece returns:
BPE joins the best-ranked neighbouring pair first, again and again.  The fold
then carries the current cuts of the unit as the bits of a number, and in each step
removes the cut whose joined piece, an edge of the same lattice, has the best
score.  The ids equal the library's.

Units above ``fold_limit`` characters would make array folds quadratic and are
folded with the same rules in an Arrow function (a heap for BPE).

Texts never move.  Units that occur more than once in the corpus are made
distinct by an exchange and go through the lattice once; the most frequent
``max_units`` of them are broadcast as one packed table, whose size is thereby
bounded.  The rest, few of a text's units and more distinct ones the larger the
corpus, are kept where they are: a text's row carries them with the edges of
their lattices (the same explode and equi-join, as Arrow columns of a block of
texts), the same fold runs over them in the row, and their ids fill the places
left open.

Characters outside the vocabulary become the ids of their UTF-8 bytes.

Cases: null = empty text = no ids; null doc_ids and repeated rows are kept as
they are; an empty table gives an empty result; U+2581 in a text is an ordinary
space mark, as in the library, so decoding gives a space for it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import hashes_of, materialize, small_batches, tidied

MARK = "▁"
MAX_UNITS = 3_000_000
FOLD_LIMIT = 48
TEXT_BYTES_AT_ONCE = 256 << 10
GROUPS_IN_MEMORY = 4_096
UNITS_AT_ONCE = 4_096
NO_SCORE = -1e30
SIGN = "!-/:-@\\[-`{-~"
UNITS = r"▁*[^▁]+|▁+"  # for a marked text


@dataclass
class Vocabulary:
    pieces: dict  # piece -> (id, score), ordinary pieces only
    bytes_from: int  # id of <0x00>, or -1
    unknown: int
    longest: int
    bpe: bool
    prefix: bool
    split_signs: bool  # no piece has a letter beside an ASCII sign, so units may be cut there

    def fallback(self, char: str) -> list:
        return [self.bytes_from + b for b in char.encode()] if self.bytes_from >= 0 else [self.unknown]


def load(path: str, kind: str | None = None, prefix: bool = True) -> Vocabulary:
    """The vocabulary of a SentencePiece file; kind is bpe or unigram (guessed from the scores if not given)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, first = {}, -1
    for i in range(n):
        if model.is_byte(i):
            first = i if first < 0 else first
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = (i, model.get_score(i))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece crosses the end of a unit")
    if kind is None:
        multi = [s for p, (_, s) in pieces.items() if s > -1e8]
        kind = "bpe" if multi and all(s == int(s) for s in multi) else "unigram"
    beside = regex.compile(rf"\p{{L}}[{SIGN}]|[{SIGN}]\p{{L}}")
    split = not any(beside.search(p) for p in pieces)
    return Vocabulary(pieces, first, model.unk_id(), max(map(len, pieces)), kind == "bpe", prefix, split)


def piece_table(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    """(piece, id, score, rank); rank 0 has the best score, equal scores share a rank.  The empty piece has id -1."""
    return spark.createDataFrame(pa.concat_tables([piece_columns(vocab), pa.table({"piece": [""], "id": pa.array([-1], pa.int32()), "score": [0.0], "rank": [0]})]))


def piece_columns(vocab: Vocabulary) -> pa.Table:
    ids, scores = zip(*vocab.pieces.values())
    rank = {x: n for n, x in enumerate(sorted(set(scores), reverse=True))}
    return pa.table({"piece": [*vocab.pieces], "id": pa.array(ids, pa.int32()), "score": pa.array(map(float, scores), pa.float64()), "rank": pa.array([rank[x] for x in scores], pa.int64())})


def marked(text: str, prefix: bool) -> str:
    text = text.replace(" ", MARK)
    return MARK + text if prefix and text else text


# ------------------------------------------------------------ folding one unit in Python
def bpe_cuts(unit: str, vocab: Vocabulary) -> list:
    """Piece ends of a unit by best-first merging, as the library does it."""
    n, pieces = len(unit), vocab.pieces
    left, right = list(range(-1, n)), list(range(1, n + 2))
    end = list(range(1, n + 1))
    heap: list = []

    def offer(i: int) -> None:
        j = right[i]
        if i >= 0 and j < n:
            found = pieces.get(unit[i : end[j]])
            if found is not None:
                heapq.heappush(heap, (-found[1], i, end[i], end[j]))

    alive = [True] * n
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != middle or middle >= n or not alive[middle] or end[middle] != stop:
            continue
        alive[middle] = False
        end[i] = stop
        right[i] = right[middle]
        if right[i] < n:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [end[i] for i in range(n) if alive[i]]


def viterbi_cuts(unit: str, vocab: Vocabulary) -> list:
    n, pieces = len(unit), vocab.pieces
    floor = min((s for _, s in pieces.values() if s > -1e8), default=0.0) - 10.0
    best, back = [0.0] + [NO_SCORE] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i in range(max(0, j - vocab.longest), j):
            found = pieces.get(unit[i:j])
            score = best[i] + (found[1] if found is not None else floor if i == j - 1 else NO_SCORE)
            if score > best[j]:
                best[j], back[j] = score, i
    out, j = [], n
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def ids_of(unit: str, ends: list, vocab: Vocabulary) -> list:
    out: list = []
    start = 0
    for end in ends:
        found = vocab.pieces.get(unit[start:end])
        if found is not None:
            out.append(found[0])
        else:
            out += vocab.fallback(unit[start:end])
        start = end
    return out


# ------------------------------------------------------------ folding units in Spark
def repeated_units(docs: DataFrame, vocab: Vocabulary, longest: int) -> DataFrame:
    """(unit, n): the units of column text that occur n > 1 times and have at most ``longest`` characters; each task sends a unit once per block of texts."""
    small_batches(docs.sparkSession)

    def summed(held: list) -> pa.Table:
        return pa.concat_tables(held).group_by("unit", use_threads=False).aggregate([("n", "sum")]).rename_columns(["unit", "n"])

    def run(batches):
        held: list = []
        for batch in batches:
            for part in text_blocks(batch, 0):
                counts = pc.value_counts(units_of(part.column(0), vocab)[0])
                found = pa.table({"unit": counts.field(0), "n": counts.field(1)})
                held.append(found.filter(pc.less_equal(pc.utf8_length(found["unit"]), longest)))
                if sum(map(len, held)) > 200_000:
                    held = [summed(held)]
                    if len(held[0]) > 80_000:
                        yield from held[0].to_batches()
                        held = []
        if held:
            yield from summed(held).to_batches()

    # Tasks have summed up already: deal out first, so that no task aggregates its own rows once more.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select("text").mapInArrow(tidied(run), "unit string, n long").repartition(parts, "unit")
    return found.groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1")


def text_blocks(batch: pa.RecordBatch, column: int):
    """Slices of a batch with some megabytes of text each; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES_AT_ONCE, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def marked_texts(texts: pa.Array, vocab: Vocabulary) -> pa.Array:
    """Texts with marks for spaces, and the leading mark of the vocabulary."""
    flat = pc.replace_substring(pc.fill_null(texts, ""), " ", MARK)
    return pc.if_else(pc.equal(flat, ""), "", pc.binary_join_element_wise(MARK, flat, "")) if vocab.prefix else flat


def units_of(texts: pa.Array, vocab: Vocabulary) -> tuple:
    """(units, offsets) of an array of texts: units of text i are units[offsets[i]:offsets[i + 1]].

    The separator 0x01 is put before every unit; texts that hold one are cut in Python.
    """
    flat = marked_texts(texts, vocab)
    if pc.any(pc.match_substring(flat, "\x01")).as_py():
        cut = regex.compile(UNITS, regex.S)
        again = regex.compile(rf"(?<=\p{{L}})(?=[{SIGN}])", regex.V1)
        lists = [[v for u in cut.findall(t) for v in (again.split(u) if vocab.split_signs else (u,))] for t in flat.to_pylist()]
        return pa.array([u for x in lists for u in x], pa.string()), np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
    if pc.any(pc.match_substring(flat, MARK + MARK)).as_py():
        split = pc.replace_substring_regex(flat, "([^▁\x01])▁", "\\1\x01▁")
        led = 0
    else:  # the quick way leaves an empty unit before a leading mark
        split = pc.replace_substring(flat, MARK, "\x01" + MARK)
        led = pc.starts_with(flat, MARK).to_numpy(zero_copy_only=False).astype(np.int64)
    if vocab.split_signs:
        split = pc.replace_substring_regex(split, rf"(\p{{L}})([{SIGN}])", "\\1\x01\\2")
    lists = pc.split_pattern(split, "\x01")
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    sizes = np.where(empty, 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False) - led)
    units = pc.list_flatten(lists)
    if empty.any() or np.any(led):
        units = units.filter(pc.not_equal(units, ""))
    return units, np.r_[0, np.cumsum(sizes)].astype(np.int64)


def lattice(units: DataFrame, pieces: DataFrame, longest: int, shortest: int = 1, fold_limit: int = 1 << 30) -> DataFrame:
    """The columns of units, and edges: an array of (first, last, id, score) sorted by first, last; ends are exclusive, starts from 0.

    Units without edges, or above fold_limit, have an empty array: each unit also
    sends the empty string, which the piece table answers with id -1.  Grouping
    by unit reuses the exchange that made the units distinct.
    """
    edges = spread_units(units, longest, shortest, fold_limit).join(F.broadcast(pieces), "piece")
    return edges.groupBy(*units.columns).agg(F.array_sort(F.collect_list(F.when(F.col("id") >= 0, F.struct("first", "last", "id", "score")))).alias("edges"))


def spread_units(units: DataFrame, longest: int, shortest: int, fold_limit: int) -> DataFrame:
    """The columns of units, and (first, last, piece): the substrings of bounded length, and the empty one, of every unit."""
    # Two plain explodes: unlike array functions, they run in generated code.
    starts = f"if(length(unit) > {fold_limit}, array(0), sequence(0, length(unit) - {shortest - 1}))"
    sizes = f"if(i = 0, array(0), sequence({shortest}, least({longest}, length(unit) - i + 1)))"
    own = units.columns
    spread = units.select(*own, F.explode(F.expr(starts)).alias("i")).select(*own, "i", F.explode(F.expr(sizes)).alias("size"))
    return spread.select(*own, (F.col("i") - 1).alias("first"), (F.col("i") + F.col("size") - 1).alias("last"), F.expr("substring(unit, i, size)").alias("piece"))


#: BPE: bit i of cuts is a cut before character i.  An edge has a code (rank * 16384 + first * 128 + last), its ends and
#: the places inside it as bits; it can join when exactly one cut is left inside.  A step takes the edge with the least
#: code (the best score, the leftmost of equals), removes its cut, and keeps the edges whose ends are still cuts.
BPE_FOLD = """
aggregate(
    sequence(2, greatest(length({unit}), 2)),
    struct(shiftleft(2L, length({unit})) - 1 AS cuts, {edges} AS edges),
    (s, step) -> if(size(s.edges) = 0, s,
        aggregate(array(array_min(transform(s.edges, e -> if(bit_count(s.cuts & e.inside) = 1, e.code, 9223372036854775807L)))), s, (a, best) ->
            if(best = 9223372036854775807L, struct(a.cuts AS cuts, slice(a.edges, 1, 0) AS edges),
                aggregate(array(a.cuts & ~(shiftleft(1L, cast(best & 127 AS int)) - shiftleft(2L, cast(shiftright(best, 7) & 127 AS int)))), a, (x, cuts) ->
                    struct(cuts AS cuts, filter(x.edges, e -> (cuts & e.ends) = e.ends AND (cuts & e.inside) != 0) AS edges))))),
    s -> s.cuts)
"""

#: Viterbi: the state holds, for each position, the best score and the path of ends that reaches it, and the edges.
VITERBI_FOLD = """
aggregate(sequence(1, length({unit})), struct(array(struct(double('0') AS score, cast(array() AS array<int>) AS path)) AS best, {edges} AS edges), (s, j) ->
    struct(concat(s.best, array(coalesce(
        array_max(transform(filter(s.edges, e -> e.last = j), e -> struct(s.best[e.first].score + e.score AS score, concat(s.best[e.first].path, array(j)) AS path))),
        struct(double('-1e30') AS score, cast(array() AS array<int>) AS path)))) AS best, s.edges AS edges),
    s -> s.best[length({unit})].path)
"""

#: Characters without a piece get an edge of their own, far below all scores, so that every unit has a path.
PATCHED = """
concat({edges}, transform(filter(sequence(1, length({unit})), i -> NOT exists({edges}, e -> e.first = i - 1 AND e.last = i)),
    i -> struct(i - 1 AS first, i AS last, -1 AS id, double('{floor!r}') AS score)))
"""


def fold_of(vocab: Vocabulary, fold_limit: int, unit: str = "unit", edges: str = "edges") -> str:
    """SQL for the ends of a unit's pieces; null above fold_limit."""
    if vocab.bpe:
        fold = BPE_FOLD.format(unit=unit, edges=edges)
    else:
        floor = min((s for _, s in vocab.pieces.values() if s > -1e8), default=0.0) - 10.0
        fold = VITERBI_FOLD.format(unit=unit, edges=PATCHED.format(unit=unit, edges=edges, floor=floor))
    return f"if(length({unit}) <= {fold_limit}, {fold}, null)"


def bpe_lattice(units: DataFrame, vocab: Vocabulary, fold_limit: int) -> DataFrame:
    """The columns of units, and edges: those of two characters or more, each as (code, ends, inside)."""
    spread = spread_units(units, vocab.longest, 2, fold_limit)
    edges = spread.join(F.broadcast(piece_table(units.sparkSession, vocab)), "piece")
    bit = lambda n: f"shiftleft(1L, {n})"
    edge = F.expr(f"struct(rank * 16384 + first * 128 + last AS code, {bit('first')} + {bit('last')} AS ends, {bit('last')} - {bit('first + 1')} AS inside)")
    return edges.groupBy(*units.columns).agg(F.collect_list(F.when(F.col("id") >= 0, edge)).alias("edges"))


def block_lattice(units: pa.Array, vocab: Vocabulary, pieces: pa.Table, fold_limit: int) -> pa.ListArray:
    """As bpe_lattice or lattice for the units of a block of texts, in their order: exploded, joined to the pieces and grouped as Arrow columns."""
    shortest, done = 2 if vocab.bpe else 1, []
    spread = lambda n: (np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    names = pieces["piece"].combine_chunks()
    ids, scores, ranks = (pieces[c].to_numpy() for c in ("id", "score", "rank"))
    for low in range(0, len(units), UNITS_AT_ONCE):
        some = pa.concat_arrays([units.slice(low, UNITS_AT_ONCE)])
        offsets = np.frombuffer(some.buffers()[1], dtype=np.int32)[some.offset : some.offset + len(some) + 1]
        data = np.frombuffer(some.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        char_at = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
        chars = pc.utf8_length(some).to_numpy().astype(np.int64)
        begin, chars = np.cumsum(chars) - chars, np.where(chars <= fold_limit, chars, 0)
        unit, first = spread(np.maximum(chars - (shortest - 1), 0))
        start, size = spread(np.minimum(vocab.longest, chars[unit] - first) - (shortest - 1))
        unit, first, size = unit[start], first[start], size + shortest
        last = first + size
        at, stop = char_at[begin[unit] + first], char_at[begin[unit] + last]
        ends = np.r_[0, np.cumsum(stop - at)]
        parts = data[np.repeat(at - ends[:-1], stop - at) + np.arange(ends[-1])]
        found = pc.index_in(pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(parts)), value_set=names)
        hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        piece, unit, first, last = found.drop_null().to_numpy(), unit[hit], first[hit], last[hit]
        if vocab.bpe:
            one = np.int64(1)
            edge = {"code": ranks[piece] * 16384 + first * 128 + last, "ends": (one << first) + (one << last), "inside": (one << last) - (one << (first + 1))}
        else:
            edge = {"first": first.astype(np.int32), "last": last.astype(np.int32), "id": ids[piece], "score": scores[piece]}
        values = pa.StructArray.from_arrays([pa.array(x) for x in edge.values()], names=list(edge))
        done.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(unit, np.arange(len(some) + 1)).astype(np.int32)), values))
    return pa.concat_arrays(done)


def ends_of(column: pa.Array, vocab: Vocabulary) -> list:
    """The ends of pieces in each unit; the fold gives them as a list or as the bits of a number."""
    if not vocab.bpe:
        return column.to_pylist()
    bits = np.arange(1, 64, dtype=np.uint64)
    spots = (pc.fill_null(column, 0).to_numpy().astype(np.uint64)[:, None] >> bits & np.uint64(1)).astype(bool)
    rows, found = np.nonzero(spots)
    cuts = np.searchsorted(rows, np.arange(len(column) + 1)).tolist()
    found = (found + 1).tolist()
    return [found[a:b] if b > a else None for a, b in zip(cuts[:-1], cuts[1:])]


def ids_of_all(units: list, ends: list, vocab: Vocabulary) -> list:
    """Little-endian u32 ids of every unit; units without ends are folded here."""
    cuts = bpe_cuts if vocab.bpe else viterbi_cuts
    return [np.array(ids_of(u, e if e is not None else cuts(u, vocab), vocab), dtype="<u4").tobytes() for u, e in zip(units, ends)]


def encode_units(units: DataFrame, vocab: Vocabulary, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """The columns of units (the first is unit), and ids binary: little-endian u32 ids of every unit."""
    spark = units.sparkSession
    small_batches(spark)
    fold_limit = min(fold_limit, 62) if vocab.bpe else fold_limit
    edges = bpe_lattice(units, vocab, fold_limit) if vocab.bpe else lattice(units, piece_table(spark, vocab), vocab.longest, 1, fold_limit)
    done = edges.select(*units.columns, F.expr(fold_of(vocab, fold_limit)).alias("ends"))

    def run(batches):
        for batch in batches:
            *own, ends = batch.columns
            out = ids_of_all(own[0].to_pylist(), ends_of(ends, vocab), vocab)
            yield pa.RecordBatch.from_arrays([*own, pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "ids"])

    return done.mapInArrow(tidied(run), ", ".join([*(f"`{c}` {kind}" for c, kind in units.dtypes), "ids binary"]))


# ------------------------------------------------------------ texts
@dataclass
class Packed:
    """Units by hash: ids of unit k are data[starts[k]:starts[k + 1]]."""

    hashes: np.ndarray
    starts: np.ndarray
    data: np.ndarray

    def spans(self, units: pa.Array) -> tuple:
        """(where the ids of each unit begin, where they end, whether the table has its hash)."""
        wanted = hashes_of(units)
        if not len(self.hashes):
            return np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), np.zeros(len(units), bool)
        order = np.argsort(wanted)  # neighbours are found in neighbouring memory
        found = np.empty(len(wanted), dtype=np.int64)
        found[order] = np.searchsorted(self.hashes, wanted[order])
        found = np.minimum(found, len(self.hashes) - 1)
        return self.starts[found].astype(np.int64), self.starts[found + 1].astype(np.int64), self.hashes[found] == wanted


def pack(coded: DataFrame, kind: str = "<u2") -> Packed:
    """From (unit, ids); works on Arrow buffers, so the driver holds numbers and no row objects."""
    hashes, sizes, data = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, kind)]
    wide = np.dtype(kind).itemsize
    for batch in arrow_batches(coded, kind):
        hashes.append(batch.column(0).to_numpy().view(np.uint64))
        column = batch.column(1)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        sizes.append(np.diff(offsets) // wide)
        data.append(np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].view(kind))
    hashes, sizes, data = np.concatenate(hashes), np.concatenate(sizes), np.concatenate(data)
    order = np.argsort(hashes)
    hashes = hashes[order]
    first, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    del order
    starts = np.r_[0, np.cumsum(sizes)]
    if starts[-1] >= 1 << 32:
        raise ValueError("too many ids for one table")
    out = np.empty(int(starts[-1]), dtype=kind)
    for at in range(0, len(sizes), 200_000):  # in pieces: places are four times as wide as ids
        some = slice(at, at + 200_000)
        base, end = int(starts[at]), int(starts[min(at + 200_000, len(sizes))])
        out[base:end] = data[np.repeat(first[some] - starts[some.start : some.start + len(sizes[some])], sizes[some]) + np.arange(base, end)]
    return Packed(hashes, starts.astype(np.uint32), out)


def arrow_batches(df: DataFrame, kind: str):
    """(hash, ids as numbers of that kind) in pieces; the driver never holds rows as objects of all pieces at once."""

    def run(batches):
        for batch in batches:
            hashes = hashes_of(batch.column(0)).view(np.int64)
            ids = [np.frombuffer(x, dtype="<u4").astype(kind).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids, pa.binary())], names=["h", "ids"])

    return df.mapInArrow(tidied(run), "h long, ids binary").toArrow().to_batches()


def most_frequent(coded: DataFrame, most: int) -> DataFrame:
    """The rows of (unit, n, ids) with the largest n, at most so many; n is compared by its quarter powers of 2, so the driver sees a few hundred counts."""
    level = F.floor(F.log2("n") * 4)
    least, total = None, 0
    for r in sorted(coded.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r.level
    return coded.where(F.lit(False) if least is None else level >= least)


def encode(docs: DataFrame, vocab: Vocabulary, keep: list, max_units: int = MAX_UNITS, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """The columns ``keep`` of docs (which has text), with ids binary (little-endian u32) and round_trip: whether the
    ids decode to the text again (by a digest of 128 bits, so that texts cross to Python once)."""
    spark = docs.sparkSession
    small_batches(spark)
    fold_limit = min(fold_limit, 62) if vocab.bpe else fold_limit
    named = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_sp_text"))
    coded = encode_units(repeated_units(named.select(F.col("_sp_text").alias("text")), vocab, fold_limit), vocab, fold_limit)
    # Groups of edges are small and come one after the other: aggregate them in memory, sorting only beyond many units.
    option = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(option)
    spark.conf.set(option, str(GROUPS_IN_MEMORY))
    try:
        coded = materialize(coded, "sp-units")
    finally:
        spark.conf.set(option, before)
    small = max((i for i, _ in vocab.pieces.values()), default=0) < 65536 and vocab.bytes_from + 256 <= 65536
    packed = pack(most_frequent(coded, max_units).select("unit", "ids"), "<u2" if small else "<u4")
    return encode_with(packed, named, vocab, keep, fold_limit)


def encode_with(packed: Packed, named: DataFrame, vocab: Vocabulary, keep: list, fold_limit: int) -> DataFrame:
    """As encode, for keep and _sp_text; any table will do, as units that it lacks go through their lattices here.  No exchange."""
    looked_up = _look_up(named, packed, vocab, keep, fold_limit)
    ends = f"transform(_sp_edges, (lattice, k) -> {fold_of(vocab, fold_limit, '_sp_units[k]', 'lattice')})"
    return _fill(looked_up.withColumn("_sp_edges", F.expr(ends)), vocab, keep)


def _schema(frame: DataFrame, keep: list, more: str) -> str:
    kinds = dict(frame.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), more])


def _bytes_at(column: pa.Array) -> tuple:
    """(bytes of all values of a string or binary array, where each begins, and the end)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _digests(data: np.ndarray, ends: np.ndarray) -> list:
    ends = ends.tolist()
    return [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]


def _look_up(named: DataFrame, packed: Packed, vocab: Vocabulary, keep: list, fold_limit: int) -> DataFrame:
    """keep, the ids of the units that the table has, a digest of the marked text, and for the others: units with the
    edges of their lattices, each once a text, and spots: pairs (place among the ids, number of the unit) as i32."""
    sent = named.sparkSession.sparkContext.broadcast(packed)
    edge = "code: bigint, ends: bigint, inside: bigint" if vocab.bpe else "first: int, last: int, id: int, score: double"

    def run(batches):
        table, back, pieces = sent.value, Decoder(vocab), piece_columns(vocab)
        for whole in batches:
            for batch in text_blocks(whole, len(keep)):
                texts = batch.column(len(keep))
                units, offsets = units_of(texts, vocab)
                coded = units.dictionary_encode()
                at = coded.indices.to_numpy().astype(np.int64)
                first, last, known = table.spans(coded.dictionary)
                gather = lambda first, sizes, ends: table.data[np.repeat(first - ends[:-1], sizes) + np.arange(int(ends[-1]))].astype("<u4")
                # Another unit may have the same hash: what the table gives must decode to the unit.
                held = np.flatnonzero(known)
                sizes = (last - first)[held]
                ends = np.r_[0, np.cumsum(sizes)]
                decoded, stops = back.raw(gather(first[held], sizes, ends))
                source, begins = _bytes_at(coded.dictionary.take(pa.array(held)))
                stops = stops[ends]
                if not np.array_equal(stops, begins) or not np.array_equal(decoded, source):
                    known[held] = [np.array_equal(decoded[a:b], source[c:d]) for a, b, c, d in zip(stops[:-1], stops[1:], begins[:-1], begins[1:])]
                sizes = np.where(known, last - first, 0)[at]
                ends = np.r_[0, np.cumsum(sizes)]
                ids, cuts = gather(first[at], sizes, ends), ends[offsets]
                open_at = np.flatnonzero(~known[at])
                row = np.searchsorted(offsets, open_at, side="right") - 1
                pairs, which = np.unique(row * len(known) + at[open_at], return_inverse=True)
                counts = np.searchsorted(pairs, np.arange(len(batch) + 1) * len(known))
                wanted, place = np.unique(pairs % max(1, len(known)), return_inverse=True)
                spots = np.stack([ends[open_at] - cuts[row], which - counts[row]], axis=1).astype("<i4")
                slots = np.searchsorted(open_at, offsets)
                wanted = coded.dictionary.take(pa.array(wanted))
                lists = block_lattice(wanted, vocab, pieces, fold_limit) if len(wanted) else None
                grouped = lambda x: pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), x.take(pa.array(place)))  # noqa: E731, B023
                cut = lambda x, ends: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
                out = [cut(ids, cuts), cut(spots, slots), pa.array(_digests(*_bytes_at(marked_texts(texts, vocab))), pa.binary()), grouped(wanted)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *out, grouped(lists) if len(wanted) else pa.array([[]] * len(batch), edges)], names=names)

    names = [*keep, "_sp_ids", "_sp_spots", "_sp_digest", "_sp_units", "_sp_edges"]
    kinds = [("code", pa.int64()), ("ends", pa.int64()), ("inside", pa.int64())] if vocab.bpe else [("first", pa.int32()), ("last", pa.int32()), ("id", pa.int32()), ("score", pa.float64())]
    edges = pa.list_(pa.list_(pa.struct(kinds)))
    return named.mapInArrow(tidied(run), _schema(named, keep, f"_sp_ids binary, _sp_spots binary, _sp_digest binary, _sp_units array<string>, _sp_edges array<array<struct<{edge}>>>"))


def _fill(looked_up: DataFrame, vocab: Vocabulary, keep: list) -> DataFrame:
    """keep, ids with those of the units left open at their spots, and whether all of them decode to the text's digest."""

    def run(batches):
        back, n = Decoder(vocab), len(keep)
        for whole in batches:
            for batch in text_blocks(whole, n):
                own, (ids, spots, digest, units, ends) = batch.columns[:n], batch.columns[n:]
                known, cuts = _bytes_at(ids)
                known, cuts = known.view("<u4"), cuts // 4
                places, slots = _bytes_at(spots)
                places, slots = places.view("<i4").reshape(-1, 2).astype(np.int64), slots // 8
                first = np.r_[0, np.cumsum(pc.list_value_length(units).to_numpy())]
                found = ids_of_all(pc.list_flatten(units).to_pylist(), ends_of(pc.list_flatten(ends), vocab), vocab)
                row = np.repeat(np.arange(len(batch)), np.diff(slots))
                at, unit = cuts[row] + places[:, 0], first[row] + places[:, 1]
                begin = np.r_[0, np.cumsum([len(x) // 4 for x in found])].astype(np.int64)
                sizes = np.diff(begin)[unit]
                before = np.r_[0, np.cumsum(sizes)]
                filled, each = np.empty(len(known) + int(before[-1]), "<u4"), np.arange(int(before[-1]))
                new = np.repeat(at, sizes) + each
                old = np.ones(len(filled), bool)
                old[new] = False
                filled[new] = np.frombuffer(b"".join(found), "<u4")[np.repeat(begin[unit] - before[:-1], sizes) + each]
                filled[old] = known
                cuts = cuts + before[slots]
                decoded, stops = back.raw(filled)
                same = [a == b for a, b in zip(_digests(decoded, stops[cuts]), digest.to_pylist())]
                out = [filled[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*own, pa.array(out, pa.binary()), pa.array(same, pa.bool_())], names=[*keep, "ids", "round_trip"])

    return looked_up.mapInArrow(tidied(run), _schema(looked_up, keep, "ids binary, round_trip boolean"))


class Decoder:
    """Ids to text; the space that the prefix added goes."""

    def __init__(self, vocab: Vocabulary):
        names = {i: p for p, (i, _) in vocab.pieces.items()}
        table = [names.get(i, "").encode() for i in range(max([vocab.bytes_from + 256, *names]) + 1)]
        if vocab.bytes_from >= 0:
            for b in range(256):
                table[vocab.bytes_from + b] = bytes([b])
        table[vocab.unknown] = " \u2047 ".encode()
        self.get, self.prefix, self.mark = table.__getitem__, vocab.prefix, MARK.encode()
        self.table = pa.array(table, pa.binary())

    def raw(self, ids: np.ndarray) -> tuple:
        """(bytes of all ids, marks included; where each id's bytes begin, and the end)."""
        found = self.table.take(pa.array(ids.astype(np.int32)))
        ends = np.frombuffer(found.buffers()[1], dtype=np.int32)[: len(ids) + 1]
        return np.frombuffer(found.buffers()[2] or b"", dtype=np.uint8), ends

    def text(self, ids: bytes) -> str:
        text = b"".join(map(self.get, np.frombuffer(ids, dtype="<u4").tolist())).replace(self.mark, b" ").decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def decode(encoded: DataFrame, vocab: Vocabulary, keep: list) -> DataFrame:
    """The columns ``keep`` and ids of encoded, with text decoded from the ids."""
    small_batches(encoded.sparkSession)
    kinds = dict(encoded.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids binary, text string"])

    def run(batches):
        back = Decoder(vocab)
        for batch in batches:
            out = [back.text(ids) for ids in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep) + 1)), pa.array(out, pa.string())], names=[*keep, "ids", "text"])

    return encoded.select(*keep, "ids").mapInArrow(tidied(run), schema)
