"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The test items' word n-grams are looked up in every text, and all of them are seeds, however often the corpus holds them: copies
of a part of an item make just its n-grams frequent. The passage around an item's hits is left out only if it shares too few words
with the item for any alignment to reach the score (no alignment has more equal words than both have in common), so that no leak
is lost. The others are aligned with the item, word by word, by local alignment with
match, mismatch and gap scores; what reaches `SCORE` of a full match is a leak, so that copies that were edited, cut or put
into other words in part are found.

Words are runs of letters, digits and characters from U+0080 on, lower-cased. The test items are the stated query set: they are
held against all rows in blocks of at most `BLOCK` n-grams, so that what is sent along is bounded however many there are.

Cases: null and empty texts hold nothing; items without an id are reported with none; items with fewer than n words are one shorter n-gram; items without words match
nothing; rows that repeat are reported each once per id; ties go to the first passage; empty tables give no rows; of the inputs
only ids and texts are read, so other columns may have any name. A long text is cut to the passages around hits, of bounded length each
(a longer chain of hits is cut into overlapping passages).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import free_name, shared, tidy

N, SCORE, BLOCK = 3, 0.42, 1_000_000
MATCH, MISMATCH, GAP, PAD = 2, -1, -1, 12

#: ASCII that is no letter or digit becomes a space.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split()


class _Ids(dict):
    """Word to id, 0 for others."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Items:
    """A block of test items: their words as ids from 1 on, and the n-grams of those that are long enough."""

    def __init__(self, items: list[tuple[int | None, str]], n: int = N) -> None:
        self.ids, self.n = _Ids(), n
        self.words: list[np.ndarray] = []
        self.item_id = [i for i, _ in items]
        grams: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.short: list[int] = []
        for k, (_, text) in enumerate(items):
            w = np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text or "")], np.int64)
            self.words.append(w)
            for at in range(max(len(w) - n + 1, 1 if len(w) else 0)):
                grams.setdefault(tuple(w[at : at + n].tolist()), []).append((k, at))
        self.base = len(self.ids) + 1
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        # Keys by length; items of fewer than n words have one shorter n-gram.
        self.tables = []
        for size in sorted({len(g) for g in grams}):
            own = sorted((self._key(np.array([g]))[0], v) for g, v in grams.items() if len(g) == size)
            keys = np.array([k for k, _ in own], np.uint64)
            counts = np.array([len(v) for _, v in own], np.int64)
            places = np.array([p for _, v in own for p in v], np.int64).reshape(-1, 2)
            self.tables.append((size, keys, np.cumsum(counts) - counts, counts, places))

    def _key(self, ids: np.ndarray) -> np.ndarray:
        key = np.zeros(len(ids), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(ids.shape[1]):
                key = (key * np.uint64(0x9E3779B97F4A7C15)) + ids[:, j].astype(np.uint64)
                key ^= key >> np.uint64(29)
        return key

    def most(self, k: int, ids: np.ndarray) -> float:
        """No alignment of an item of at least one word with a passage scores more, as a share of a full match: the words that
        both hold, each as often as both hold it."""
        own, count = self.bags[k]
        slot = np.minimum(np.searchsorted(own, ids), len(own) - 1)
        both = np.minimum(np.bincount(slot[own[slot] == ids], minlength=len(own)), count).sum()
        return float(MATCH * both) / (MATCH * len(self.words[k]))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a row of word ids: places, items and places in the item of all n-grams found."""
        found = []
        for size, keys, start, count, places in self.tables:
            if len(ids) < size:
                continue
            known = ids > 0
            run = known[: len(ids) - size + 1].copy()
            for j in range(1, size):
                run &= known[j : len(ids) - size + 1 + j]
            at = np.flatnonzero(run)
            key = self._key(np.stack([ids[at + j] for j in range(size)], axis=1)) if len(at) else np.zeros(0, np.uint64)
            slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = keys[slot] == key
            at, slot = at[ok], slot[ok]
            begin = np.cumsum(count[slot]) - count[slot]
            pick = np.repeat(start[slot] - begin, count[slot]) + np.arange(int(count[slot].sum()))
            found.append((np.repeat(at, count[slot]), places[pick, 0], places[pick, 1]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def align(item: np.ndarray, passages: list[np.ndarray]) -> list[tuple[float, int, int, int]]:
    """Smith-Waterman of one item with passages (words as ids, 0 equal to nothing): score as a share of a full match, equal
    words on the best path, and the path's first word and end in the passage. All passages advance together, row by row."""
    if not passages or not len(item):
        return [(0.0, 0, 0, 0)] * len(passages)
    width = max(len(p) for p in passages)
    text = np.zeros((len(passages), width), np.int64)
    for i, p in enumerate(passages):
        text[i, : len(p)] = p
    rows = len(passages)
    score = np.zeros((rows, width + 1), np.int32)
    begin = np.tile(np.arange(width + 1, dtype=np.int32), (rows, 1))
    same = np.zeros((rows, width + 1), np.int32)
    best = np.zeros((rows, 4), np.int64)
    columns = np.arange(width + 1, dtype=np.int32)
    for w in item.tolist():
        equal = (text == w) & (w > 0)
        diagonal = score[:, :-1] + np.where(equal, MATCH, MISMATCH)
        up = score[:, 1:] + GAP
        cell, frm, eq = np.zeros_like(score), np.tile(columns, (rows, 1)), np.zeros_like(same)
        better = diagonal >= up
        top = np.where(better, diagonal, up)
        live = top > 0
        cell[:, 1:] = np.where(live, top, 0)
        frm[:, 1:] = np.where(live, np.where(better, begin[:, :-1], begin[:, 1:]), columns[1:])
        eq[:, 1:] = np.where(live, np.where(better, same[:, :-1] + equal, same[:, 1:]), 0)
        # A gap in the item costs the same per word, so the best start of one is a running maximum.
        lifted = cell - GAP * columns
        source = np.maximum.accumulate(lifted, axis=1)
        moved = source + GAP * columns
        gap = moved > cell
        if gap.any():
            at = np.maximum.accumulate(np.where(lifted == source, columns, 0), axis=1)
            cell = np.where(gap, moved, cell)
            frm = np.where(gap, np.take_along_axis(frm, at, 1), frm)
            eq = np.where(gap, np.take_along_axis(eq, at, 1), eq)
        score, begin, same = cell.astype(np.int32), frm, eq
        end = score.argmax(axis=1)
        most = score[np.arange(rows), end]
        new = most > best[:, 0]
        k = np.flatnonzero(new)
        best[k] = np.stack([most[k], same[k, end[k]], begin[k, end[k]], end[k]], axis=1)
    full = MATCH * len(item)
    return [(float(s) / full, int(m), int(b), int(e)) for s, m, b, e in best]


def _passages(docs: DataFrame, block: Items, least: float) -> DataFrame:
    """doc_id, item_id, first (its place in the text), words (ids in the block): what stands around hits and can reach the score."""
    lens = np.array([len(w) for w in block.words], np.int64)

    schema = pa.schema([("row", pa.int32()), ("item_id", pa.int64()), ("k", pa.int32()), ("first", pa.int32()), ("words", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                words = words_of(text)
                ids = np.fromiter(map(block.ids.__getitem__, words), np.int64, len(words))
                at, item, _ = block.hits(ids)
                if not len(at):
                    continue
                order = np.lexsort((at, item))
                at, item = at[order], item[order]
                # Hits of one item that lie further apart than it is long are passages of their own; so are long chains.
                apart = (np.diff(item) != 0) | (np.diff(at) > lens[item[1:]] + PAD)
                cuts = np.append(0, np.flatnonzero(apart) + 1).tolist() + [len(at)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    k, n = int(item[a]), int(lens[item[a]])
                    first, last = int(at[a]), int(at[b - 1])
                    step = 3 * n + 64
                    for begin in range(first, last + 1, step):
                        inside = slice(a + int(np.searchsorted(at[a:b], begin)), a + int(np.searchsorted(at[a:b], begin + step)))
                        if inside.start == inside.stop:
                            continue
                        # A path that reaches the score is at most 2.2 times as long as the item, so that one of two windows holds it.
                        around = n + n // 4 + PAD
                        lo, hi = max(0, int(at[inside.start]) - around), min(len(ids), int(at[inside.stop - 1]) + around)
                        if block.most(k, ids[lo:hi]) >= least:
                            out.append((row, block.item_id[k], k, lo, ids[lo:hi].astype(np.int32)))
            if out:
                found = [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
                ids = batch.column("doc_id").take(found[0])
                yield pa.RecordBatch.from_arrays([ids, *found[1:]], ["doc_id", *schema.names[1:]])

    rows = docs.select(F.col("doc_id"), F.col("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, item_id long, k int, first int, words array<int>")


def leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """doc_id, item_id, score, n_equal (words), first_word, last_word (of the text, from 0): one row for each document and item
    whose best passage reaches the score."""
    spark = shared(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    n_grams = items.agg(F.sum(F.length("text"))).head()[0] or 0  # no more words than characters
    blocks = max(1, -(-int(n_grams) // BLOCK))
    parts = []
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = Items([(r["item_id"], r["text"]) for r in own.collect()])
        parts.append(_leaks(docs, block, score))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "n_equal", "first_word", "last_word"), F.struct("score", -F.col("first_word"))).alias("x")).select(
        "doc_id", "item_id", "x.score", "x.n_equal", "x.first_word", "x.last_word"
    )


def _leaks(docs: DataFrame, block: Items, least: float) -> DataFrame:
    schema = pa.schema([("row", pa.int32()), ("score", pa.float64()), ("n_equal", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k_of, first = batch.column("k").to_numpy(), batch.column("first").to_numpy()
            words, out = batch.column("words"), []
            for k in np.unique(k_of).tolist():
                rows = np.flatnonzero(k_of == k)
                for at in range(0, len(rows), 512):
                    some = rows[at : at + 512].tolist()
                    for row, (s, n, begin, end) in zip(some, align(block.words[k], [words[i].values.to_numpy().astype(np.int64) for i in some]), strict=True):
                        if s >= least:
                            out.append((row, s, n, first[row] + begin, first[row] + end - 1))
            if out:
                found = [pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
                kept = [batch.column(c).take(found[0]) for c in ("doc_id", "item_id")]
                yield pa.RecordBatch.from_arrays([*kept, *found[1:]], ["doc_id", "item_id", *schema.names[1:]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _passages(docs, block, least).mapInArrow(tidy(run), f"doc_id {kind}, item_id long, score double, n_equal int, first_word int, last_word int")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """docs without those whose text leaks an item. The key is the text's hash, so that null and repeated ids do no harm."""
    keyed = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("doc_id"), "text")
    name = free_name(docs.columns, "_text_key")
    gone = leaks(keyed, benchmark, score).select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, F.md5(F.coalesce("text", F.lit("")))).join(gone, name, "left_anti").drop(name)
