"""Operator 3: line dedup by pairwise alignment.

A block that goes holds ``least_words`` words or more, so it holds a run: consecutive lines that just reach as many words. Runs
are rare where single lines aren't. Each run that several documents hold links every later one to its earliest holder, so a passage
makes no more pairs than it has holders, and no passage is left without a pair. Each pair is aligned with patience diff (lines unique in both are its
anchors), and aligned common blocks of ``least_words`` words or more are deleted from the later document; what is left of it is aligned again, for blocks
that moved, are repeated, or have no line of their own. Nothing goes that isn't aligned. Blank lines are left out of all this.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, settle

#: Odd multiplier of the runs' polynomial hash, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of an array without nulls, one at a time."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    for a, z in zip(ends[:-1], ends[1:]):
        yield values[a:z]


def line_hashes(text: Column) -> Column:
    """A hash for each line, trailing blanks left out."""
    return F.transform(F.split(text, "\n"), lambda x: F.xxhash64(F.rtrim(x)))


def line_words(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.size(F.filter(F.split(x, r"[ \t\r\f\x0B]+"), lambda w: w != "")))


def runs(h: np.ndarray, w: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, line after the last, and hash of each run of lines with hashes h and words w (above zero).

    From each line the shortest run that reaches least_words, forwards and backwards: together these cover every
    common block of so many words, line by line.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
    at = np.arange(n)
    forward = np.searchsorted(total, total[:-1] + least_words)  # line after the last
    backward = np.searchsorted(total, total[1:] - least_words, side="right") - 1  # first line
    a = np.concatenate([at[forward <= n], backward[backward >= 0]])
    z = np.concatenate([forward[forward <= n], (at + 1)[backward >= 0]])
    key = np.unique(a * (n + 1) + z)
    a, z = key // (n + 1), key % (n + 1)
    one = np.ones(1, np.uint64)
    power, back = (np.cumprod(np.append(one, np.full(n - 1, x, np.uint64)), dtype=np.uint64) for x in (_BASE, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h.astype(np.int64).view(np.uint64) * power, dtype=np.uint64)])
    return a, z, ((sums[z] - sums[a]) * back[a] + (z - a).astype(np.uint64)).view(np.int64)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose second rises too."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        back.append(at[n - 1] if n else -1)
        if n == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[n], at[n] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned equal positions (i, j) of a and b: common ends, then lines unique in both, recursively."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        one, two = Counter(a[i:m]), Counter(b[j:n])
        where = {x: k for k, x in enumerate(b[j:n], j) if two[x] == 1 and one.get(x) == 1}
        anchors = _rising([(k, where[x]) for k, x in enumerate(a[i:m], i) if x in where])
        for p, q in anchors:
            todo.append((i, p, j, q))
            out.append((p, q))
            i, j = p + 1, q + 1
        if anchors:
            todo.append((i, m, j, n))
    return sorted(out)


def blocks(pairs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """[from, to) of the second positions of runs in which both positions go up by one."""
    k = 0
    while k < len(pairs):
        e = k + 1
        while e < len(pairs) and pairs[e][0] == pairs[e - 1][0] + 1 and pairs[e][1] == pairs[e - 1][1] + 1:
            e += 1
        yield pairs[k][1], pairs[e - 1][1] + 1
        k = e


def common_lines(earlier: np.ndarray, earlier_words: np.ndarray, later: np.ndarray, words: np.ndarray, least_words: int) -> np.ndarray:
    """Which lines of the later document are in an aligned block of least_words words or more.

    The documents are aligned as a whole; then what is left of the later one, stretch by stretch, with the whole earlier one, which finds blocks that moved or that the later
    one repeats; last, where lines aren't unique, what is left from a common run on with the earlier document from that run on.
    """
    cut = np.zeros(len(later), bool)

    def align(one: np.ndarray, begin: int, two: np.ndarray) -> None:
        for a, z in blocks(patience(one.tolist(), two.tolist())):
            if words[begin + a : begin + z].sum() >= least_words:
                cut[begin + a : begin + z] = True

    align(earlier, 0, later)
    if cut.all():
        return cut
    edges = np.flatnonzero(np.diff(np.concatenate([[True], cut, [True]]).astype(np.int8)))
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if (a, z) != (0, len(later)) and words[a:z].sum() >= least_words:
            align(earlier, a, later[a:z])
    a, z, h = runs(later, words, least_words)
    at, _, h0 = runs(earlier, earlier_words, least_words)
    known, first = np.unique(h0, return_index=True)
    spot = np.searchsorted(known, h)
    held = np.flatnonzero((spot < len(known)) & (known[np.minimum(spot, len(known) - 1)] == h)) if len(known) else np.zeros(0, np.int64)
    for k in held.tolist():
        if not cut[a[k] : z[k]].all():
            p, q = int(at[first[spot[k]]]), int(a[k])
            same = earlier[p : p + len(later) - q] != later[q : q + len(earlier) - p]
            n = int(same.argmax()) if same.any() else len(same)
            align(earlier[p : p + n], q, later[q : q + n])
    return cut


def deletions(docs: DataFrame, least_words: int = 20) -> DataFrame:
    """fingerprint, first (the least id), gone (a flag for each line), long: what goes from documents (id, text, fingerprint), none of them null.

    A row for each text that loses lines, or that several documents have; of these all but the first go as a whole
    if the text is long enough.
    """
    texts = docs.select("id", "fingerprint", line_hashes(F.col("text")).alias("h"), line_words(F.col("text")).alias("w"))
    texts = texts.groupBy("fingerprint").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("h").alias("h"), F.first("w").alias("w"))
    # Each text has a number of its own, which tells texts of equal ids apart; order is by id, then number.
    texts = settle(texts).withColumn("no", F.monotonically_increasing_id())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nos, counts, found = b.column(0).to_numpy(), b.column(1).to_numpy(), [], []
            for h, w in zip(_rows(b.column(2)), _rows(b.column(3))):
                kept = w > 0
                found.append(np.unique(runs(h[kept], w[kept], least_words)[2]))
                counts.append(len(found[-1]))
            yield pa.record_batch([pa.array(np.repeat(ids, counts)), pa.array(np.repeat(nos, counts)), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["id", "no", "run"])

    held = settle(texts.select("id", "no", "h", "w").transform(map_batches, keys, "id bigint, no bigint, run bigint"))
    owners = settle(held.groupBy("run").agg(F.min(F.struct("id", "no")).alias("owner"), F.count("*").alias("holders")).filter("holders > 1").select("run", "owner.no"))
    pairs = held.join(owners.withColumnRenamed("no", "owner"), "run").filter("no <> owner").select("no", "owner").distinct()
    later = settle(pairs).join(texts.select("no", "h", "w"), "no")
    earlier = texts.select(F.col("no").alias("owner"), F.col("h").alias("h0"), F.col("w").alias("w0"))
    both = later.join(earlier, "owner").select("no", "h", "w", "h0", "w0")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cuts = [], []
            # Row by row: a whole batch as Python lists would hold an often-linked document's lines many times.
            for k, (h, w, h0, w0) in enumerate(zip(*(_rows(c) for c in batch.columns[1:]))):
                lines, earlier = np.flatnonzero(w), w0 > 0
                cut = lines[common_lines(h0[earlier], w0[earlier], h[lines], w[lines], least_words)]
                if len(cut):
                    at.append(k)
                    cuts.append(cut.astype(np.int32))
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int32())), pa.array(cuts, pa.list_(pa.int32()))], ["no", "cut"])

    cut = both.transform(map_batches, align, "no bigint, cut array<int>").groupBy("no").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))
    found = texts.join(cut, "no", "left").filter("cut is not null or n > 1")

    def blanks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = []
            for w, said in zip(_rows(b.column(2)), b.column(3)):
                gone = np.zeros(len(w), bool)
                if said.is_valid:
                    gone[said.values.to_numpy()] = True
                    # A blank line fares like the line with words before it, or after it at the top.
                    lines = np.flatnonzero(w)
                    gone = gone[lines[np.maximum(np.searchsorted(lines, np.arange(len(w)), side="right") - 1, 0)]]
                cuts.append(gone if said.is_valid else None)
            total = [int(w.sum()) >= least_words for w in _rows(b.column(2))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cuts, pa.list_(pa.bool_())), pa.array(total, pa.bool_())], ["fingerprint", "first", "gone", "long"])

    return found.select("fingerprint", F.col("id").alias("first"), "w", "cut").transform(map_batches, blanks, "fingerprint string, first bigint, gone array<boolean>, long boolean")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 20) -> DataFrame:
    """All columns of docs with deleted lines gone from the text, and n_lines, n_cut (lines before, and deleted).

    A line with words goes if it is in a block of consecutive lines (blank ones left out) with ``least_words`` words or more that a document of a
    lesser id (long) has too; a blank line fares like the line before it. Equal texts of so many words: all but the first lose every line.
    Rows with a null id or text stay as they are, with n_lines null for a null text; rows with equal ids and texts are one document and fare alike, and of different texts with
    equal ids one counts as the later; an empty table gives an empty result. Columns named n_lines or n_cut are replaced, others kept.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_cut")]
    inner = {c: f"c{k}" for k, c in enumerate(columns)}  # names that can't clash
    id_, text_ = inner[id_col], inner[text_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in inner.items()]).withColumn("print", F.md5(F.col(text_)))
    keyed = F.col(id_).isNotNull() & F.col(text_).isNotNull()
    known = rows.filter(keyed).select(F.col(id_).cast("long").alias("id"), F.col(text_).alias("text"), F.col("print").alias("fingerprint"))
    gone = settle(deletions(known, least_words)).withColumnRenamed("fingerprint", "print")
    joined = rows.join(gone, "print", "left")
    lines = F.split(F.col(text_), "\n")
    copy = F.coalesce(F.col("long") & (F.col(id_) > F.col("first")), F.lit(False))
    left = F.array_join(F.filter(lines, lambda x, k: ~F.get("gone", k)), "\n")
    n_lines = F.when(F.col(text_).isNotNull(), F.size(lines))
    touched = keyed & F.col("first").isNotNull()
    text = F.when(~touched, F.col(text_)).when(copy, "").when(F.col("gone").isNull(), F.col(text_)).otherwise(left)
    n_cut = F.when(~touched, 0).when(copy, F.size(lines)).otherwise(F.coalesce(F.size(F.filter("gone", lambda x: x)), F.lit(0)))
    out = joined.withColumns({"n_lines": n_lines, "n_cut": F.when(F.col(text_).isNotNull(), n_cut), text_: text})
    return out.select(*[F.col(x).alias(c) for c, x in inner.items()], "n_lines", "n_cut")
