"""The nearest rows of many queries, as products of blocks of vectors.

Rows and queries are packed into blocks of some MB; each block of rows meets the
broadcast blocks of queries, and a task keeps the k nearest rows of every query
over all its blocks.  A matrix product finds which rows may be among them; their
distances are then summed term by term, in the same order for every pair, so equal
vectors have equal distances wherever they lie, and ties go to the smaller key.

Cases: a vector that is null, empty, without length, or holds nulls matches nothing,
nor do vectors of different dimensions; NaN distances come last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_BYTES, QUERY_BYTES = 1 << 21, 1 << 20  # of a block
TASK_ROWS, LEAST_ROWS = 16_384, 256  # rows of a task, and those a task is worth
STEP = 256  # queries of one product
MARGIN = 1e-9  # what a product may differ from the sum term by term
LAST = -2.0  # below any cosine


def tasks(rows: DataFrame) -> int:
    """Tasks for a search over these rows."""
    n = rows.count()
    return max(1, -(-n // TASK_ROWS), min(-(-n // LEAST_ROWS), rows.sparkSession.sparkContext.defaultParallelism))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt to tasks evenly, by key within each, as ``pairs`` breaks ties by the order of the rows."""
    return rows.repartition(tasks(rows)).sortWithinPartitions(key)


def blocks(rows: DataFrame, key: str, size: int = ROW_BYTES, group: str | None = None, bits: str | None = None) -> DataFrame:
    """(d, at, grp, keys, vectors, bits): at most ``size`` bytes of the vectors of one dimension d and one group, as float64.

    rows: key, embedding, and the int ``group`` and binary ``bits`` if named.  ``at`` tells the blocks of a task apart
    and grows with the rows; bits are those of the rows, one after another.
    """
    usable = rows.where("size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL)")
    kind = usable.schema[key].dataType.simpleString()
    whole = usable.select(key, F.transform("embedding", lambda x: x.cast("double")), (F.col(group) if group else F.lit(0)).alias("grp"), (F.col(bits) if bits else F.lit(b"")).alias("bits"))

    def run(batches):
        held, at = {}, 0

        def flush(d, grp):
            nonlocal at
            keys, vectors, marks = zip(*held.pop((d, grp)))
            keys = pa.concat_arrays(keys)
            out = [pa.array([d], pa.int32()), pa.array([at], pa.int64()), pa.array([grp], pa.int32())]
            out += [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([np.concatenate(vectors).tobytes()], pa.binary()), pa.array([b"".join(marks)], pa.binary())]
            at += len(keys)
            return pa.RecordBatch.from_arrays(out, names=["d", "at", "grp", "keys", "vectors", "bits"])

        for batch in batches:
            sizes, groups = pc.list_value_length(batch.column(1)).to_numpy(), batch.column(2).to_numpy()
            for d, grp in dict.fromkeys(zip(sizes.tolist(), groups.tolist())):
                mine = batch if (sizes == d).all() and (groups == grp).all() else batch.filter(pa.array((sizes == d) & (groups == grp)))
                vectors = mine.column(1).flatten().to_numpy().reshape(-1, d)
                good = lengths(vectors) != 0
                mine, vectors = mine.filter(pa.array(good)), vectors[good]
                most = max(1, size // (8 * d))
                for start in range(0, len(vectors), most):
                    part = mine.slice(start, most)
                    filled = sum(len(v) for _, v, _ in held.get((d, grp), ()))
                    if filled and filled + len(part) > most:
                        yield flush(d, grp)
                    held.setdefault((d, grp), []).append((part.column(0), vectors[start : start + most], b"".join(part.column(3).to_pylist())))
            for d, grp in [x for x in held if x[1] != groups[-1]] if group else ():  # rows come group by group
                yield flush(d, grp)
        for d, grp in list(held):
            yield flush(d, grp)

    return whole.mapInArrow(run, f"d int, at long, grp int, keys array<{kind}>, vectors binary, bits binary")


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Squared lengths, summed term by term."""
    out = np.zeros(len(vectors))
    for column in vectors.T:
        out += column * column
    return out


def places(*keys) -> np.ndarray:
    """The place of every item among those with the same first key, by the other keys."""
    order = np.lexsort(keys[::-1])
    first = keys[0][order]
    starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.zeros(0, dtype=int)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return out


def kept(found: tuple, k: int) -> tuple:
    """The k nearest of each query of (query, distance, at, grp) arrays, and those as near in other groups, k a group."""
    query, distance, at, grp = found
    place = places(query, distance, at)
    worst = np.full(int(query.max()) + 1 if len(query) else 0, np.nan)
    last = place == k - 1
    worst[query[last]] = distance[last]
    tied = (distance == worst[query]) | np.isnan(distance)
    keep = place < k
    if (tied & ~keep).any():
        keep |= tied & (places(query * (int(grp.max()) + 2) + grp, distance, at) < k)
    return tuple(x[keep] for x in found)


def candidates(rows: np.ndarray, asked: np.ndarray, k: int, worst: np.ndarray) -> tuple:
    """(query, row) places of pairs that may be among the k nearest; worst: the cosine each query has for its k-th row so far."""
    with np.errstate(all="ignore"):
        unit, sought = (x / np.sqrt(lengths(x))[:, None] for x in (rows, asked))
    bad, unusable = (np.isnan(x).any(axis=1) for x in (unit, sought))
    found = []
    for start in range(0, len(asked), STEP):
        near = sought[start : start + STEP] @ unit.T
        near[:, bad] = LAST
        near[unusable[start : start + STEP]] = LAST
        least = worst[start : start + STEP]
        if near.shape[1] > k:
            least = np.maximum(least, np.partition(near, near.shape[1] - k, axis=1)[:, -k])
        query, row = np.nonzero(near >= (least - MARGIN)[:, None])
        found.append((query + start, row))
    return tuple(np.concatenate(x) for x in zip(*found))


def distances(rows: np.ndarray, asked: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
    """1 - cosine of pairs, summed term by term."""
    total = np.zeros(len(query))
    for a, b in zip(asked.T.copy(), rows.T.copy()):
        total += a[query] * b[row]
    with np.errstate(all="ignore"):
        return 1.0 - np.clip(total / np.sqrt(lengths(asked)[query] * lengths(rows)[row]), -1.0, 1.0)


def pairs(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, key, distance): of every query the k nearest rows of each task, and more that tie with the last.

    held, asked: ``blocks`` of rows and of queries.  Where the queries have bits, a query meets the groups whose bit it has.
    """
    kinds = [x.schema["keys"].dataType.elementType.simpleString() for x in (asked, held)]
    q = F.broadcast(asked.select("d", F.xxhash64("keys", "vectors").alias("q_block"), F.col("keys").alias("q_keys"), F.col("vectors").alias("q_vectors"), F.col("bits").alias("q_bits")))
    cells = held.drop("bits").join(q, "d").select("d", "at", "grp", "keys", "vectors", "q_block", "q_keys", "q_vectors", "q_bits")

    def run(batches):
        best, names, askers = {}, {}, {}
        for batch in batches:
            keys, q_keys = batch.column(3), batch.column(6)
            for n in range(batch.num_rows):
                d, at, grp, block = (batch.column(i)[n].as_py() for i in (0, 1, 2, 5))
                rows, sought = (np.frombuffer(batch.column(i)[n].as_buffer(), "<f8").reshape(-1, d) for i in (4, 7))
                if at not in names:
                    names[at] = pa.concat_arrays([keys[n].values])
                if block not in askers:
                    marks = np.frombuffer(batch.column(8)[n].as_buffer(), np.uint8)
                    askers[block] = pa.concat_arrays([q_keys[n].values]), marks.reshape(len(sought), -1), np.full(len(sought), -np.inf)
                _, marks, worst = askers[block]
                mine = np.flatnonzero(marks[:, grp >> 3] >> (7 - (grp & 7)) & 1) if marks.size else np.arange(len(sought))
                if not len(mine):
                    continue
                query, row = candidates(rows, sought[mine], k, worst[mine])
                query = mine[query]
                new = query, distances(rows, sought, query, row), row + at, np.full(len(row), grp)
                old = best.get(block)
                best[block] = kept(new if old is None else tuple(np.concatenate(x) for x in zip(old, new)), k)
                query, distance, spot, _ = best[block]
                full = places(query, distance, spot) == k - 1
                worst[query[full]] = np.nan_to_num(1.0 - distance[full], nan=LAST)
        starts = sorted(names)
        flat = pa.concat_arrays([names[x] for x in starts]) if names else None
        sizes = np.cumsum([0] + [len(names[x]) for x in starts])
        for block, (query, distance, spot, _) in best.items():
            number = np.searchsorted(starts, spot, side="right") - 1
            at = sizes[number] + spot - np.asarray(starts)[number]
            yield pa.RecordBatch.from_arrays([askers[block][0].take(pa.array(query)), flat.take(pa.array(at)), pa.array(distance)], names=["query_id", "key", "distance"])

    return cells.mapInArrow(run, f"query_id {kinds[0]}, key {kinds[1]}, distance double")
