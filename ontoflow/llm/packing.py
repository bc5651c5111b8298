"""Operator 7: packing by the linear grouping scheme.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. There, large lengths
are sorted, cut into a few groups of equal cardinality and rounded up to each group's longest; how often each configuration of
these few sizes is used is optimised by a linear program whose columns are generated as they pay; actual lengths take the places of the rounded ones, the last
place of a sequence the longest that its room takes. What finds no place in a full sequence is grouped and optimised again, round by round, and the last of it is
filled without rounding; small lengths go best-fit into what room is left. The outcome is a table of runs (length, ranks from-to, sequences,
offset) whose size depends on ``capacity`` alone; it is broadcast and each piece finds its place by its rank
among pieces of its length.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _bpe
from ._common import map_batches, settle, tokenizer_path


#: Groups of rounded lengths; grouping goes on as long as a round places one in so many of the pieces left.
GROUPS, LAST = 24, 200


def grouped(histogram: dict[int, int], smallest: int, groups: int) -> list[tuple[int, int]]:
    """(rounded length, pieces) of groups of equal cardinality of the lengths from ``smallest`` on, longest first; each piece is rounded up to its group's longest."""
    large = sorted(((s, n) for s, n in histogram.items() if s >= smallest and n), reverse=True)
    per = -(-sum(n for _, n in large) // groups) if large else 1
    out: dict[int, int] = {}
    seen, top = 0, 0
    for s, n in large:
        while n:
            if seen % per == 0:
                top = s
            take = min(n, per - seen % per)
            out[top] = out.get(top, 0) + take  # groups that round to the same length are one
            seen, n = seen + take, n - take
    return sorted(out.items(), reverse=True)


def _best_value(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The greatest value of sizes (any number of each) that fit, and how many of each."""
    best, by = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = sizes <= room
        if fits.any():
            got = np.where(fits, values + best[np.maximum(room - sizes, 0)], -1)
            k = int(got.argmax())
            if got[k] > best[room] + 1e-12:
                best[room], by[room] = got[k], k
    used, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if by[room] < 0:
            room -= 1
        else:
            used[by[room]] += 1
            room -= int(sizes[by[room]])
    return float(best[capacity]), used


def configurations(groups: list[tuple[int, int]], capacity: int, most_rounds: int = 2000) -> list[tuple[list[int], int]]:
    """(number of each group in a sequence, number of such sequences) that hold all groups' pieces.

    The linear program of fewest sequences over all configurations, solved with a basis of as many columns as there are groups; the best new
    column fills a sequence with the dual values. Its numbers are rounded down, and what is left goes configuration by configuration, fullest first.
    """
    if not groups:
        return []
    sizes, need = (np.array([g[k] for g in groups]) for k in (0, 1))
    basis = np.diag(capacity // sizes).astype(float)
    times = need / np.diag(basis)
    for _ in range(most_rounds):  # stopping early only costs sequences
        dual = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, new = _best_value(sizes, dual, capacity)
        if value <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, new.astype(float))
        able = change > 1e-9
        if not able.any():
            break
        ratio = np.where(able, np.maximum(times, 0) / np.where(able, change, 1), np.inf)
        out = int(ratio.argmin())
        times = times - ratio[out] * change
        times[out] = ratio[out]
        basis[:, out] = new
    found, left = [], need.copy()
    for k in np.argsort(-(sizes @ basis)):
        used = basis[:, k].astype(np.int64)
        n = min(int(times[k] + 1e-6), *(int(left[g]) // int(used[g]) for g in np.flatnonzero(used)))
        if n > 0:
            found.append((used.tolist(), n))
            left -= used * n
    return found + _filled([(int(s), int(n)) for s, n in zip(sizes, left)], capacity)


def _filled(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[list[int], int]]:
    """(number of each size in a sequence, number of such sequences) of sizes (length, pieces; longest first), each sequence as full as can be."""
    lengths, left, found, first = [s for s, _ in sizes], [n for _, n in sizes], [], 0
    while first < len(lengths):
        if not left[first]:
            first += 1
            continue
        used = _fullest(lengths, left, first, capacity)
        n = min(left[g] // u for g, u in enumerate(used) if u)
        found.append((used, n))
        left = [x - u * n for x, u in zip(left, used)]
    return found


def _fullest(sizes: list[int], left: list[int], first: int, capacity: int) -> list[int]:
    """Of the groups' sizes (descending) and numbers left, how many of each make the fullest sequence that holds one of group ``first``."""
    room = capacity - sizes[first]
    full = (1 << room + 1) - 1
    reach, steps = 1, []
    for k in range(first, len(sizes)):
        n = min(left[k] - (k == first), room // sizes[k])
        for _ in range(n):
            wider = (reach | reach << sizes[k]) & full
            if wider == reach:
                break
            steps.append((k, reach))
            reach = wider
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, [0] * len(sizes)
    for k, before in reversed(steps):
        if not before >> total & 1:
            used[k] += 1
            total -= sizes[k]
    used[first] += 1
    return used


def _substituted(large: dict[int, int], groups: list[tuple[int, int]], capacity: int, spare: dict[int, int]) -> list[list]:
    """Runs [sequences, room left, [(length, pieces in each), ...]] of configurations with actual lengths in their places; takes them out of large.

    A place gets the longest length left that isn't above its rounded size, the last place of a sequence the longest that fits at all. A sequence
    is made if it is full, or if there is a small piece that fills it to the token: spare has their numbers by length, and what is used goes from it.
    """
    there, runs = sorted(s for s, n in large.items() if n), []

    def longest(limit: int, held: dict[int, int]) -> int:
        for k in range(bisect_right(there, limit) - 1, -1, -1):
            if large[there[k]] > held.get(there[k], 0):
                return there[k]
        return 0

    for used, times in configurations(groups, capacity):
        places = [groups[k][0] for k, u in enumerate(used) for _ in range(u)]
        while times and there:
            held: dict[int, int] = {}
            room = capacity
            for k, size in enumerate(places):
                s = longest(room if k + 1 == len(places) else size, held)
                if s:
                    held[s] = held.get(s, 0) + 1
                    room -= s
            while s := longest(room, held):  # rounding has left room for another
                held[s] = held.get(s, 0) + 1
                room -= s
            # As long as none of these lengths runs out, sequences are alike.
            n = min(times, *(large[s] // u for s, u in held.items()), *([spare.get(room, 0)] if room else []))
            if not n:
                break
            if room:
                spare[room] -= n
            for s, u in held.items():
                large[s] -= u * n
            there = [s for s in there if large[s]]
            runs.append([n, room, sorted(held.items(), reverse=True)])
            times -= n
    return runs


def plan(histogram: dict[int, int], capacity: int, smallest: int | None = None, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank from, rank to, first sequence, pieces of that length in each sequence, offset of the first)."""
    smallest = smallest or max(1, capacity // 5)
    large = {s: n for s, n in histogram.items() if s >= smallest and n}
    runs: list[list] = []
    # Group, optimise and substitute again with what is left, first for full sequences, then for those that a small piece fills up.
    for spare in ({}, {s: n for s, n in histogram.items() if 0 < s < smallest}):
        placed = sum(large.values())
        while placed * LAST > (pieces := sum(large.values())) > 0:
            runs += _substituted(large, grouped(large, smallest, groups), capacity, spare)
            placed = pieces - sum(large.values())
    # The last pieces go without rounding, fullest sequence first.
    rest = sorted(((s, n) for s, n in large.items() if n), reverse=True)
    for used, times in _filled(rest, capacity):
        held = [(rest[k][0], u) for k, u in enumerate(used) if u]
        runs.append([times, capacity - sum(s * u for s, u in held), held])
    room: list[list] = [[] for _ in range(capacity + 1)]
    for run in runs:
        room[run[1]].append(run)
    rooms = [r for r in range(1, capacity + 1) if room[r]]
    for s in sorted((s for s, n in histogram.items() if 0 < s < smallest and n), reverse=True):
        n = histogram[s]
        open_rooms = sorted(r for r in rooms if r >= s)
        heapq.heapify(open_rooms)
        while n and open_rooms:
            r = heapq.heappop(open_rooms)
            while n and room[r]:
                run = room[r].pop()
                each = min(r // s, n)
                fit = min(run[0], n // each)
                if fit < run[0]:
                    rest = [run[0] - fit, r, list(run[2])]
                    room[r].append(rest)
                    runs.append(rest)
                    run[0] = fit
                run[1] -= each * s
                run[2].append((s, each))
                room[run[1]].append(run)
                n -= each * fit
        if n:
            each = capacity // s
            for times, u in ((n // each, each), (1, n % each)):
                if times and u:
                    run = [times, capacity - u * s, [(s, u)]]
                    runs.append(run)
                    room[run[1]].append(run)
        rooms = [r for r in range(1, capacity + 1) if room[r]]
    rank, rows, sequence = dict.fromkeys(histogram, 0), [], 0
    for n, _, held in runs:
        offset = 0
        for s, u in held:
            rows.append((s, rank[s], rank[s] + n * u, sequence, u, offset))
            rank[s] += n * u
            offset += s * u
        sequence += n
    return rows


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = 1024,
    end_id: int | None = 2,
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each whole text's ids and end_id, cut into pieces of ``capacity`` ids from the end backwards."""
    path = tokenizer or tokenizer_path()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _bpe.encoder(path)
        for whole in batches:
            for b in _bpe.slices(whole, 1):
                flat, n = encoder.encode(_bpe.strings(b.column(1)))
                ends = np.cumsum(n)
                flat = flat.astype("<u4", copy=False)
                if end_id is not None:
                    flat = np.insert(flat, ends, end_id)
                    n = n + 1
                    ends = np.cumsum(n)
                pieces = -(-n // capacity)
                of = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * capacity
                start = np.where(piece > 0, head[of] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head[of])
                begin = (ends - n)[of] + start
                raw, a = memoryview(flat).cast("B"), (begin * 4).tolist()
                z = ((begin + length) * 4).tolist()
                columns = [b.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(raw[i:j]) for i, j in zip(a, z)], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(flat)), pa.int32()), pa.array(flat.astype(np.int64))))
                yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.transform(map_batches, cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def pack(pieces: DataFrame, capacity: int = 1024, length_col: str = "length", groups: int = GROUPS) -> DataFrame:
    """The pieces with sequence_id and offset; pieces of ``capacity`` or more fill a sequence of their own.

    Lengths must be positive. Sequence numbers have gaps; repeated rows are packed each; an empty table gives an empty result; a column
    named sequence_id or offset is replaced, all others are kept whatever their names.
    """
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    inner = {c: f"c{k}" for k, c in enumerate(columns)}  # names that can't clash
    pieces = pieces.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()], F.col(f"`{length_col}`").alias("_key"))
    # The checkpoint makes partitions stable, so that ranks can be counted by partition first.
    pieces = settle(pieces).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    full = pieces.filter(F.col("_key") >= capacity).select("*", (2 * F.col("_row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = pieces.filter(F.col("_key") < capacity)
    by_part = settle(small.groupBy("_part", "_key").agg(F.count("*").alias("_n")))
    histogram = {r["_key"]: r["n"] for r in by_part.groupBy("_key").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    before = by_part.select("_part", "_key", (F.sum("_n").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part", "_key").orderBy("_row")) - 1
    ranked = small.withColumn("_local", local).join(before, ["_part", "_key"]).withColumn("_rank", F.col("_before") + F.col("_local"))
    schema = "_len bigint, _from bigint, _to bigint, _first bigint, _each bigint, _at bigint"
    runs = spark.createDataFrame(plan(histogram, capacity, groups=groups), schema)  # bounded by capacity, not by the data
    on = (F.col("_key") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    nth = F.col("_rank") - F.col("_from")
    packed = ranked.join(F.broadcast(runs), on).select(
        *full.columns[:-2],
        (2 * (F.col("_first") + F.floor(nth / F.col("_each")))).alias("sequence_id"),
        (F.col("_at") + nth % F.col("_each") * F.col("_len")).alias("offset"),
    )
    return packed.unionByName(full).select(*[F.col(x).alias(c) for c, x in inner.items()], "sequence_id", "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 1024, end_id: int | None = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): every document's pieces, packed.

    A null text is empty: one piece that holds end_id alone. Null ids stay null, repeated rows are packed
    each; other columns are not read; an empty table gives an empty result.
    """
    return pack(token_pieces(docs, id_col, text_col, tokenizer, capacity, end_id, with_ids), capacity)
