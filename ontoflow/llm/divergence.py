"""Operator 13: an audit of how the sources of each language diverge, by sketch-prefiltered counting.

First every task adds its documents' distinct terms to a count-min sketch of document frequencies; the tasks' sketches merge in a tree.
A cell never tells less than the true frequency, so a term with a cell below the least frequency can't be kept and is
discarded before anything of it is shuffled. What is left is counted exactly, summed in each task first, and pairs of sources meet in a sparse join: only
terms that both have make rows, all others enter by sums of each source.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import map_batches, settle

#: UTF-8 bytes: A-Z lower-cased, letters and bytes of other characters as they are, all else a blank.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split at once, so that a very long one doesn't become one list of terms; different terms that a task holds.
_PIECE, _HELD = 1_000_000, 400_000
#: Cells of a block, the unit that sketches are sent and merged by.
_BLOCK = 1 << 16
#: Sketches merge in a tree: tasks in groups of so many at most.
_FAN = 64


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, by pieces that end between terms."""
    if len(text) <= _PIECE:
        yield text.translate(_BYTES).split()
        return
    text, begin = text.translate(_BYTES), 0
    while begin < len(text):
        end = text.find(b" ", begin + _PIECE)
        end = len(text) if end < 0 else end
        yield text[begin:end].split()
        begin = end


def _cells(lang: str, terms: list[bytes], depth: int, bits: int) -> np.ndarray:
    """depth x terms: the cells of each term of a language, two halves of a 128-bit hash combined for each row."""
    seed = xxhash.xxh64_intdigest(lang, 13)
    raw = b"".join(xxhash.xxh3_128_digest(t, seed) for t in terms)
    h = np.frombuffer(raw, "<u8").reshape(-1, 2)
    return np.stack([(h[:, 0] + np.uint64(k) * (h[:, 1] | np.uint64(1))) >> np.uint64(64 - bits) for k in range(depth)]).astype(np.int64)


def _bytes(texts: pa.Array) -> Iterator[bytes]:
    """Each text's UTF-8, without making strings of them."""
    for x in texts.cast(pa.large_binary()):
        yield x.as_py()


def sketch(docs: DataFrame, least: int, depth: int, bits: int) -> np.ndarray:
    """depth x 2^bits bytes over docs (lang, source, text): cells of document frequencies of (lang, term), at most ``least``, never underestimating.

    Tasks send blocks of cells that aren't empty, compressed; a group of at most 64 tasks merges a block, then their groups, until one is left.
    """
    cells = depth << bits
    part = "part int, block int, cells binary"

    def add(table: np.ndarray, frequencies: dict[str, Counter]) -> None:
        for lang, seen in frequencies.items():
            spots = _cells(lang, list(seen), depth, bits)
            n = np.fromiter(seen.values(), np.int64, len(seen))
            for row, at in enumerate(spots):
                order = np.argsort(at, kind="stable")
                at, first = np.unique(at[order], return_index=True)
                more = np.add.reduceat(n[order], first) if len(first) else n[:0]
                at += row << bits
                table[at] = np.minimum(table[at] + more, least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, seen, held = np.zeros(cells, np.uint8), {}, 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), _bytes(b.column("text"))):
                once: set[bytes] = set()
                for terms in _terms(text):
                    once.update(terms)
                mine = seen.setdefault(lang, Counter())
                held -= len(mine)
                mine.update(once)
                held += len(mine)
                if held > _HELD:
                    add(table, seen)
                    seen, held = {}, 0
        add(table, seen)
        yield from blocks(table, TaskContext.get().partitionId())

    def blocks(table: np.ndarray, part_id: int) -> Iterator[pa.RecordBatch]:
        for k in range(0, cells, _BLOCK):
            if (block := table[k : k + _BLOCK]).any():
                yield pa.record_batch([pa.array([part_id], pa.int32()), pa.array([k // _BLOCK], pa.int32()), pa.array([zlib.compress(block, 1)], pa.binary())], ["part", "block", "cells"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(min(_BLOCK, cells), np.uint8)
        for b in batches:
            for cells_ in b.column("cells").to_pylist():
                np.minimum(total + np.frombuffer(zlib.decompress(cells_), np.uint8), least, out=total)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([zlib.compress(total, 1)], pa.binary())], ["part", "block", "cells"])

    found = settle(docs.select("lang", "text").transform(map_batches, count, part))
    groups = (found.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        groups = -(-groups // _FAN)
        found = found.withColumn("part", F.floor(F.col("part") / _FAN).cast("int")).groupBy("part", "block").applyInArrow(merge, part)
        if groups <= 1:
            break
    table = np.zeros(cells, np.uint8)
    for r in found.select("block", "cells").toLocalIterator():  # depth x 2^bits bytes, whatever the input
        block = np.frombuffer(zlib.decompress(r["cells"]), np.uint8)
        table[r["block"] * _BLOCK : r["block"] * _BLOCK + len(block)] = block
    return table.reshape(depth, -1)


def _counts(docs: DataFrame, table: np.ndarray, least: int, bits: int) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents): exact for all terms that the sketch lets pass; a few more may be there."""
    depth = len(table)
    full = np.packbits(table >= least, axis=1)  # an eighth of the sketch
    shared = docs.sparkSession.sparkContext.broadcast(full)

    def flush(seen: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in seen.items():
            terms = list(n)
            at = _cells(lang, terms, depth, bits)
            may = np.ones(len(terms), bool)
            for row in range(depth):
                may &= (shared.value[row][at[row] >> 3] >> (7 - (at[row] & 7)).astype(np.uint8) & 1).astype(bool)
            kept = [t for t, m in zip(terms, may.tolist()) if m]
            if kept:
                columns = [pa.array([lang] * len(kept)), pa.array([source] * len(kept)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([n[t] for t in kept], pa.int64()), pa.array([d[t] for t in kept], pa.int64())]
                yield pa.record_batch(columns, ["lang", "source", "term", "n", "d"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = {}, 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), _bytes(b.column("text"))):
                n, d = seen.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                once: set[bytes] = set()
                for terms in _terms(text):
                    n.update(terms)
                    once.update(terms)
                d.update(once)
                held += len(n)
                if held > _HELD:
                    yield from flush(seen)
                    seen, held = {}, 0
        yield from flush(seen)

    partial = docs.select("lang", "source", "text").transform(map_batches, count, "lang string, source string, term string, n bigint, d bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kinds)), exact to 28 digits."""
    wide = "decimal(20,0)"
    return F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 5).cast(wide), (total + 5 * kinds).cast(wide)) + 1


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least: int = 30,
    top: int = 50,
    depth: int = 3,
    bits: int = 21,
) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its other sources and from the language.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a language keeps those in at least ``least`` (255 at most) of its
    documents. p is a term's smoothed share in parts of 10^9. Part ``pair``: the other sources (item) by the sum of absolute differences of p over all kept terms. Part
    ``term``: the ``top`` kept terms (item) whose share in the source is above the language's, by the difference.

    The sketch takes depth x 2^bits bytes in a task and an eighth of it is broadcast, whatever the input; a sketch that is too small lets more
    terms pass to exact counting, and the result is the same. Null text, lang or source count as empty; a text without terms still makes its group occur; repeated rows count each time;
    an empty table gives an empty result; other columns are not read. Equal values are ranked by item.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be from 1 to 255")
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    table = sketch(docs, least, depth, bits)
    counted = settle(_counts(docs, table, least, bits))
    of_lang = counted.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).filter(F.col("d") >= least)
    of_lang = settle(of_lang.select("lang", "term", F.col("n").alias("n_lang")))
    kept = settle(counted.select("lang", "source", "term", "n").join(of_lang, ["lang", "term"]))
    langs = of_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    zero = F.lit(0).cast("bigint")
    groups = groups.join(sums, ["lang", "source"], "left").withColumns({c: F.coalesce(c, zero) for c in ("v", "total_lang", "total", "size")})
    groups = settle(groups.withColumn("base", F.when(F.col("v") > 0, _share(zero, F.col("total"), F.col("v"))).otherwise(zero)))
    kept = kept.join(groups.select("lang", "source", "v", "total", "total_lang", "base"), ["lang", "source"])
    kept = settle(kept.select("lang", "source", "term", "base", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), _share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = kept.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    pairs = _pairs(kept, groups).withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, part, item, value of all ordered pairs of a language's sources.

    A term of both adds |p - p'|, a term of one |p - base'|, one of neither |base - base'|. Only terms of both make a row; a source's p
    against another's base come from how often it has each p.
    """
    here = groups.select("lang", F.col("source").alias("a"), F.col("size").alias("na"), F.col("base").alias("ba"), "v")
    there = groups.select("lang", F.col("source").alias("b"), F.col("size").alias("nb"), F.col("base").alias("bb"))
    both = here.join(there, "lang").filter("a <> b")  # the result has a row for each
    levels = kept.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    alone = levels.withColumnRenamed("source", "a").join(there, "lang").filter("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("n") * F.abs(F.col("p") - F.col("bb"))).alias("own"))
    x = kept.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("base").alias("ba"))
    y = kept.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("base").alias("bb"))
    less = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("bb")) - F.abs(F.col("pb") - F.col("ba"))
    met = x.join(y, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(less).alias("less"), F.count("*").alias("common"))
    met = settle(met)
    met = met.union(met.select("lang", "b", "a", "less", "common"))
    back = alone.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("own").alias("other"))
    out = both.join(met, ["lang", "a", "b"], "left").join(alone, ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left")
    zero = F.lit(0).cast("bigint")
    absent = F.col("v") - F.col("na") - F.col("nb") + F.coalesce("common", zero)
    value = F.coalesce("less", zero) + F.coalesce("own", zero) + F.coalesce("other", zero) + absent * F.abs(F.col("ba") - F.col("bb"))
    return out.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
