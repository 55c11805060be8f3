"""LM scoring: a causal self-attention model over subword ids, trained in numpy, beside smoothed word counts.

Ids. A text is the subword ids of its words (A-Z lower-cased), each word's first id marked, and an end. `tokenised` works them out
once and writes them; training and scoring read ids only. A word is named by a 64-bit hash of its ids, which are different for
different words.

Counts, all of them over every training document and none cut off: words; ids that begin words and ids inside words; and, for each
of these, a hashed profile of the ids beside it (of the neighbouring words' first ids; inside words, of the ids before and after).
Word counts give the base score. Of the words, those that are frequent in all documents together (`KNOWN` at most) are sent along;
the counts of the others are joined to the documents that hold them, so that no table grows with the corpus. The other tables have
a size that the vocabulary of subwords sets.

Model (`IdModel`). What is read and predicted are events: an id that begins a word, an id inside a word, the end. Events are
clustered by their profiles into classes; attention predicts the class of the next event and then, by a binary tree over the class's
events (Huffman's), which of them it is: each choice on the way is made by what attention gives. Untrained, all this is the events'
smoothed counts. Attention is over the events before: blocks of `BLOCK` events, each with the block before it as context, so that
windows overlap and every event is scored once, all blocks of a batch at a time under one causal mask; an event enters as the vectors
of its cluster, of its last byte and of its own. All factors sum to one, so that the score is a text's probability among all
sequences of ids. Every training document is trained on, each task's from the same start; the parameters are averaged by events
seen, in a tree.

`Model` is the same attention over words (a word enters by its first id's cluster and its last byte, only the class of the next first
id is predicted, the word's share of its class comes from its count). `IdModel` builds on it; `score` and the query use `IdModel`.

Cases: null and empty texts are one end; repeated rows score alike; documents without an id count as held out or not by the
empty id; without training documents counts are zero and all classes are alike; an empty table gives no rows;
of the input only id and text are read. A long text is scored in blocks; a worker holds one chunk and tables of bounded size.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import pieces as subwords
from granary.llm.common import shared, shared_folder, tidy
from granary.llm.quality_mil import held_out

HELD_PARTS, KNOWN = 10, 600_000
BLOCK, WIDTH, CLASSES, CLUSTERS, BYTES, PROFILE = 8, 12, 40, 256, 128, 32
#: What is added to every count; bytes of text that a worker encodes at a time, and different words and bytes of them from which on it
#: hands over its counts and begins anew.
LITTLE, CHUNK, MANY, MOST_BYTES = 0.1, 6_000_000, 1_000_000, 32_000_000
#: Nodes of a class's tree whose choices are worked out at once, and for how many events of the class at a time.
HEAVY, SIDE = 16, 32
#: The bit of a stored id that marks a word's first one; ids are below it.
FIRST = 1 << 15
WORD, BEGIN, BESIDE, INNER, AMONG = range(5)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, with A-Z lower-cased, and how many each text has (white space and letters are ASCII's)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return flat.filter(pa.array(some)), np.bincount(owner[some], minlength=len(texts))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def names(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash (long) of each word's ids; words begin in ids at begin."""
    if not len(begin):
        return np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(ids)))
    place = (np.arange(len(ids)) - np.repeat(begin, n)).astype(np.uint64)
    with np.errstate(over="ignore"):
        each = mixed(ids.astype(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        return mixed(np.add.reduceat(each, begin) + n.astype(np.uint64)).view(np.int64)


def last_bytes(path: str) -> np.ndarray:
    """For each id a code (below `BYTES`) of the last byte of its piece."""
    model = subwords.load(path)
    some = model.piece_len > 0
    out = np.zeros(model.size, np.int64)
    out[some] = model.piece_bytes[model.piece_at[some] + model.piece_len[some] - 1] & (BYTES - 1)
    return out


def _hashed(n: int) -> np.ndarray:
    return (mixed(np.arange(n, dtype=np.uint64) + np.uint64(77)) % np.uint64(PROFILE)).astype(np.int64)


class Words:
    """The different words so far: the ids of each, and how often it came in training documents and in all."""

    def __init__(self, model: subwords.Pieces) -> None:
        self.model, self.known = model, None
        self.ids, self.at = np.zeros(0, np.uint16), np.zeros(1, np.int64)
        self.train, self.total = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.total) > MANY or self.known is not None and self.known.nbytes > MOST_BYTES

    def index(self, flat: pa.Array) -> np.ndarray:
        """Which one each of some words is; new ones are encoded and put behind the others."""
        coded = flat.dictionary_encode()
        if self.known is None:
            self.known = coded.dictionary.slice(0, 0)
        place = pc.index_in(coded.dictionary, value_set=self.known)
        new = coded.dictionary.filter(place.is_null())
        at = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.known) + np.arange(len(new))
        different, order = new.to_pylist(), np.argsort(pc.binary_length(new).to_numpy(), kind="stable")
        # In slices, as merging takes many times the memory of what is merged.
        merged = [self.model.merge([subwords.SPACE + different[i] for i in order[lo : lo + 20_000].tolist()]) for lo in range(0, max(len(order), 1), 20_000)]
        ids, lens = (np.concatenate(x) for x in zip(*merged, strict=True))
        begin, n = np.cumsum(lens) - lens, np.empty(len(order), np.int64)
        n[order], from_ = lens, np.empty(len(order), np.int64)
        from_[order] = begin
        self.ids = np.append(self.ids, subwords.gather(ids.astype(np.uint16), from_, n))
        self.at = np.append(self.at, self.at[-1] + np.cumsum(n))
        self.known = pa.concat_arrays([self.known, new])
        more = np.zeros(len(new), np.int64)
        self.train, self.total = np.append(self.train, more), np.append(self.total, more)
        return at[coded.indices.to_numpy()]


def _chunks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until a column has so many bytes, so that what is alike is worked out once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= most:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns], table.schema.names)


def tokenised(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Rows of documents (doc_id, held, ids: uint16 as binary, a word's first id with the bit `FIRST`) and, without ids, rows of
    counts (kind, key, first id, c in training documents, n in all), as written to the folder. Each task sums up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = subwords.load(path)
        size = model.size
        hashed, beside, begins = _hashed(size), np.zeros(size * 2 * PROFILE, np.int64), np.zeros(size, np.int64)
        inners, among = np.zeros(size, np.int64), np.zeros(size * 2 * PROFILE, np.int64)
        words, batch = Words(model), None

        def counted() -> pa.RecordBatch:
            """The words' counts; those of their ids are added up."""
            nonlocal begins, inners, among
            wide, first = words.ids.astype(np.int64), words.ids[words.at[:-1]].astype(np.int64)
            begins += np.bincount(first, weights=words.train, minlength=size).astype(np.int64)
            inside = np.ones(len(wide) + 1, bool)
            inside[words.at] = False
            k = np.flatnonzero(inside[:-1])
            times, after = np.repeat(words.train, np.diff(words.at))[k], np.where(inside[k + 1], hashed[wide[np.minimum(k + 1, len(wide) - 1)]], 0)
            inners += np.bincount(wide[k], weights=times, minlength=size).astype(np.int64)
            cell = wide[k] * 2 * PROFILE
            among += np.bincount(np.concatenate([cell + after, cell + PROFILE + hashed[wide[k - 1]]]), weights=np.tile(times, 2), minlength=len(among)).astype(np.int64)
            return _counts(WORD, names(wide, words.at[:-1]), first, words.train, words.total)

        for batch in _chunks(batches, "text", CHUNK):
            flat, n = words_of(batch.column("text"))
            index, held = words.index(flat), batch.column("held")
            learned = np.repeat(~held.to_numpy(zero_copy_only=False), n)
            words.total += np.bincount(index, minlength=len(words.total))
            words.train += np.bincount(index[learned], minlength=len(words.total))
            lens = words.at[index + 1] - words.at[index]
            ids = subwords.gather(words.ids, words.at[index], lens)
            begin = np.cumsum(lens) - lens
            first, owner = ids[begin].astype(np.int64), np.repeat(np.arange(len(n)), n)
            k = np.flatnonzero(learned[:-1] & (owner[1:] == owner[:-1]))
            cell = np.concatenate([first[k] * 2 * PROFILE + hashed[first[k + 1]], (first[k + 1] * 2 + 1) * PROFILE + hashed[first[k]]])
            beside += np.bincount(cell, minlength=len(beside))
            ids[begin] |= FIRST
            ends = np.append(begin, len(ids))[np.append(0, np.cumsum(n))]
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), held, raw, *(pa.nulls(len(n), t) for t in COUNTS.types)], ["doc_id", "held", "ids", *COUNTS.names])
            if words.full():
                yield from _typed(counted(), batch)
                words = Words(model)
        if batch is not None:
            yield from _typed(counted(), batch)
            for kind, cells in ((BEGIN, begins), (BESIDE, beside), (INNER, inners), (AMONG, among)):
                key = np.flatnonzero(cells)
                yield from _typed(_counts(kind, key, np.zeros(len(key)), cells[key], cells[key]), batch)

    kind = docs.schema["doc_id"].dataType.simpleString()
    docs.mapInArrow(tidy(run), f"doc_id {kind}, held boolean, ids binary, kind int, key long, first int, c long, n long").write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


COUNTS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("first", pa.int32()), ("c", pa.int64()), ("n", pa.int64())])


def _counts(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip((np.full(len(columns[0]), kind), *columns), COUNTS.types, strict=True)], COUNTS.names)


def _typed(counts: pa.RecordBatch, like: pa.RecordBatch, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(counts), rows):
        x = counts.slice(at, rows)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(x), like.schema.field("doc_id").type), pa.nulls(len(x), pa.bool_()), pa.nulls(len(x), pa.binary()), *x.columns], ["doc_id", "held", "ids", *x.schema.names])


def _at_most(table: DataFrame, count: str, most: int) -> int:
    """The least power of two from which on at most so many rows of the table have this count."""
    by_size = table.groupBy(F.floor(F.log2(count)).cast("int").alias("k")).count().collect()  # 64 rows at most
    total, least = 0, 0
    for k, n in sorted(((r["k"], r["count"]) for r in by_size), reverse=True):
        total += n
        if total > most:
            least = k + 1
            break
    return 1 << least


def _texts(texts: pa.Array, most: int = 2_000_000) -> Iterator[slice]:
    lens = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    size, lo = 0, 0
    for i, n in enumerate(lens):
        if i > lo and size + n > most:
            yield slice(lo, i)
            lo, size = i, 0
        size += n
    if len(lens) > lo:
        yield slice(lo, len(lens))


def clusters(x: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means of rows with weights, from rows drawn by weight; the cluster of each row."""
    r = np.random.default_rng(3)
    k = min(k, int((weight > 0).sum()))
    if k < 2:
        return np.zeros(len(x), np.int64)
    centre = x[r.choice(len(x), k, replace=False, p=weight / weight.sum())]
    for _ in range(rounds):
        own = (x @ centre.T - (centre**2).sum(axis=1) / 2).argmax(axis=1)
        total = np.bincount(own, weights=weight, minlength=k)
        for j in range(x.shape[1]):
            centre[:, j] = np.where(total > 0, np.bincount(own, weights=weight * x[:, j], minlength=k) / np.maximum(total, 1e-12), centre[:, j])
    return own


class Model:
    """What the counts say, and attention parameters p. Ids: those of the subwords; `size` stands for a word's end."""

    #: Rows of a training step.
    step_rows = 256

    def __init__(self, last: np.ndarray, begins: np.ndarray, different: np.ndarray, beside: np.ndarray, n_ends: int) -> None:
        """last: code of each id's last byte; begins: of words, by first id; different: how many words, by first id; beside: profiles
        by id; n_ends: of texts."""
        self.last, size = last, len(last)
        # Classes of first ids; 0 is the end.
        weight = np.sqrt(begins.astype(np.float64))
        x = np.sqrt(beside / np.maximum(beside.reshape(size, 2, PROFILE).sum(axis=2), 1).repeat(PROFILE, axis=1)).astype(np.float64)
        self.cls = 1 + clusters(x, weight, CLASSES)
        self.cluster = clusters(x, weight, CLUSTERS)
        self.k = CLASSES + 1
        of_class, words = np.bincount(self.cls, weights=begins, minlength=self.k), np.bincount(self.cls, weights=different, minlength=self.k)
        #: log10 of a class's counts, a little for each word and for unseen ones included.
        self.whole = np.log10(of_class + LITTLE * (words + 1))
        mass = of_class + LITTLE * (words + 1)
        mass[0] = n_ends + LITTLE
        self.prior = np.log(mass / mass.sum()).astype(np.float32)
        r, d = np.random.default_rng(11), WIDTH
        init = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        # Rows of E: clusters of first ids, the start, last bytes.
        self.start = CLUSTERS
        self.p = {
            "E": init(CLUSTERS + 1 + BYTES, d) * np.float32(12), "Q": init(d, d), "K": init(d, d), "V": init(d, d), "B": np.zeros((1, 2 * BLOCK), np.float32),
            "H": init(d, d), "X": init(d, d), "O": np.zeros((d, self.k), np.float32),
        }
        at, key_at = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None]
        self.mask = np.where(key_at <= at, 0, -1e9).astype(np.float32)
        self.back = np.clip(at - key_at, 0, 2 * BLOCK - 1)

    def blocks(self, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts of n words with these first ids and last ids: the words before (two rows of E each), classes of the next ones (-1:
        none), as rows of BLOCK, which rows are a text's first, and where each text's words begin in the flat order, ends included."""
        return self._laid(np.stack([self.cluster[first], CLUSTERS + 1 + self.last[last]], axis=1), self.cls[first], n)

    def _laid(self, rows_of: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = n // BLOCK + 1
        start = np.cumsum(rows) - rows
        total = int(rows.sum())
        ctx = np.full((total * BLOCK, rows_of.shape[1]), self.start, np.int64)
        nxt = np.full(total * BLOCK, -1, np.int64)
        spot = np.repeat(start * BLOCK - (np.cumsum(n) - n), n) + np.arange(len(code))
        nxt[spot] = code
        nxt[start * BLOCK + n] = 0
        # What is read is context for the next one; that of a full row's last one is the next row's first place.
        ctx[spot + 1] = rows_of
        is_first = np.zeros(total, bool)
        is_first[start] = True
        return ctx.reshape(-1, BLOCK, rows_of.shape[1]), nxt.reshape(-1, BLOCK), is_first, start * BLOCK

    def texts(self, ids: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks of texts of n words, words beginning in ids at begin."""
        return self.blocks(ids[begin], ids[np.append(begin, len(ids))[1:] - 1], n)

    def class_of(self, nxt: np.ndarray) -> np.ndarray:
        return nxt

    def rest(self, u: np.ndarray, nxt: np.ndarray) -> np.ndarray | float:
        """ln of the probability of what comes next given its class, as far as attention gives it."""
        return 0.0

    def rest_gradient(self, u: np.ndarray, nxt: np.ndarray, g: dict) -> np.ndarray | float:
        """Of the mean loss by u; puts that by the rest's parameters into g."""
        return 0.0

    def rows_gradient(self, ctx: np.ndarray, value: np.ndarray) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
        """Of E: the sums of value (a row for each place of ctx) by row of E."""
        total = np.zeros_like(self.p["E"])
        for j in range(ctx.shape[-1]):
            _add_rows(total, ctx[..., j].ravel(), value)
        return total

    def entered(self, ctx: np.ndarray) -> np.ndarray:
        x = self.p["E"].take(ctx[..., 0], axis=0)
        for j in range(1, ctx.shape[-1]):
            x += self.p["E"].take(ctx[..., j], axis=0)
        return x

    def entries(self) -> np.ndarray:
        """The vector of each value that a column of ctx can have."""
        return self.p["E"]

    def tables(self) -> np.ndarray:
        """The entries' products with K, V, Q and X: for scoring, where they stay as they are."""
        p = self.p
        return self.entries() @ np.concatenate([p["K"], p["V"], p["Q"] * np.float32(1 / np.sqrt(WIDTH)), p["X"]], axis=1)

    def forward(self, ctx: np.ndarray, is_first: np.ndarray, tables: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of rows 1.. of ctx, place by place, exp of the classes' logits (up to 60) without their prior, and the sums with it; each row has
        the row before it as context, if it is not a text's first."""
        p, rows, d = self.p, len(ctx) - 1, WIDTH
        # Products of tables with all places at once; only what a block's places have with each other goes by rows.
        if tables is None:
            whole = self.entered(ctx).reshape(-1, d)
            k, v, x = whole @ p["K"], whole @ p["V"], whole[BLOCK:]
            q, straight = x @ (p["Q"] * np.float32(1 / np.sqrt(d))), x @ p["X"]
        else:
            whole = x = None
            looked_up = tables.take(ctx[..., 0].ravel(), axis=0)
            for j in range(1, ctx.shape[-1]):
                looked_up += tables.take(ctx[..., j].ravel(), axis=0)
            k, v, q, straight = looked_up[:, :d], looked_up[:, d : 2 * d], looked_up[BLOCK:, 2 * d : 3 * d], looked_up[BLOCK:, 3 * d :]
        q, vv = q.reshape(rows, BLOCK, d), _with_row_before(v)
        s = q @ _columns_with_row_before(k)
        s += p["B"][0][self.back] + self.mask
        s[is_first[1:], :, :BLOCK] = -1e9
        np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        # Weights stay as they are; what they make is divided by their sum.
        share = 1 / np.maximum(s.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, s.dtype), 1e-30)[:, None]
        h = (s @ vv).reshape(-1, d)
        h *= share
        u = h @ p["H"]
        u += straight
        np.tanh(u, out=u)
        z = u @ p["O"]
        if np.abs(p["O"]).sum(axis=0).max() > 60:
            np.minimum(z, 60, out=z)
        np.exp(z, out=z)
        return {"whole": whole, "x": x, "q": q, "k": k, "v": v, "s": s, "share": share, "h": h, "u": u, "exp": z, "total": z @ np.exp(self.prior).astype(z.dtype)}

    def log_class(self, ctx: np.ndarray, nxt: np.ndarray, is_first: np.ndarray, tables: np.ndarray | None = None, at_a_time: int = 1024) -> np.ndarray:
        """log10 of the probability of each next word's class (0 where there is none), float64; of each next event in an `IdModel`."""
        out = np.zeros(nxt.shape)
        tables = self.tables() if tables is None else tables
        o, prior = np.ascontiguousarray(self.p["O"].T), self.prior
        for lo in range(0, len(ctx), at_a_time):
            rows = slice(lo, min(len(ctx), lo + at_a_time))
            before = slice(lo - 1, rows.stop) if lo else np.r_[0, : rows.stop]
            f = self.forward(ctx[before], is_first[before], tables)
            own = np.maximum(self.class_of(nxt[rows].ravel()), 0)
            lp = _dots(f["u"], o.take(own, axis=0)) + prior[own] - np.log(f["total"]) + self.rest(f["u"], nxt[rows].ravel())
            out[rows] = lp.reshape(-1, BLOCK)
        out /= np.log(10)
        out[nxt < 0] = 0
        return out

    def gradient(self, ctx: np.ndarray, nxt: np.ndarray, is_first: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss over the next words of rows 1.. ; row 0 is context only."""
        p, f, nxt, rows = self.p, self.forward(ctx, is_first), nxt[1:].ravel(), len(ctx) - 1
        u, x, s, z, total = f["u"], f["x"], f["s"], f["exp"], f["total"]
        live = nxt >= 0
        # By logits it is (exp * prior - total where it is the next one's) * scale; the factors go where the arrays are small.
        own, prior = np.maximum(self.class_of(nxt), 0), np.exp(self.prior).astype(u.dtype)
        z.reshape(-1)[np.arange(len(nxt)) * self.k + own] -= total / prior[own]
        scale = (live / (max(1, live.sum()) * total)).astype(u.dtype)[:, None]
        g = {"O": (u * scale).T @ z * prior}
        d = z @ (p["O"] * prior).T
        d *= scale
        d += self.rest_gradient(u, nxt, g)
        d *= 1 - u * u
        g["H"], g["X"] = f["h"].T @ d, x.T @ d
        dh = d @ p["H"].T
        dh *= f["share"]
        by_row = dh.reshape(rows, BLOCK, -1)
        dv = s.transpose(0, 2, 1) @ by_row
        ds = by_row @ _columns_with_row_before(f["v"])
        ds -= _dots(dh, f["h"]).reshape(rows, BLOCK, 1)
        ds *= s
        g["B"] = np.bincount(self.back.ravel(), weights=ds.sum(axis=0).ravel(), minlength=2 * BLOCK)[None].astype(np.float32)
        dq, dk = (ds @ _with_row_before(f["k"])).reshape(len(x), -1), ds.transpose(0, 2, 1) @ f["q"]
        dq *= np.float32(1 / np.sqrt(WIDTH))
        dk, dv = _to_both_rows(dk), _to_both_rows(dv)
        g["Q"], g["K"], g["V"] = x.T @ dq, f["whole"].T @ dk, f["whole"].T @ dv
        dx = dk @ p["K"].T
        dx += dv @ p["V"].T
        dx[BLOCK:] += d @ p["X"].T
        dx[BLOCK:] += dq @ p["Q"].T
        g["E"] = self.rows_gradient(ctx, dx)
        return g


def _with_row_before(a: np.ndarray) -> np.ndarray:
    """For each row but the first its places after those of the row before, as a view."""
    n, d = a.shape
    return np.lib.stride_tricks.as_strided(a, (n // BLOCK - 1, 2 * BLOCK, d), (BLOCK * a.strides[0], *a.strides), writeable=False)


def _columns_with_row_before(a: np.ndarray) -> np.ndarray:
    """The same with places as columns, which small products take faster than the other's transposed view."""
    n, d = a.shape
    a = np.ascontiguousarray(a.T)
    return np.lib.stride_tricks.as_strided(a, (n // BLOCK - 1, d, 2 * BLOCK), (BLOCK * a.strides[1], *a.strides), writeable=False)


def _to_both_rows(a: np.ndarray) -> np.ndarray:
    """The sums, place by place, of what a row gives to the row before and to itself."""
    out = np.empty((len(a) + 1, BLOCK, a.shape[2]), a.dtype)
    out[0], out[1:] = 0, a[:, BLOCK:]
    out[:-1] += a[:, :BLOCK]
    return out.reshape(-1, a.shape[2])


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b) @ np.ones(a.shape[1], a.dtype)


def _add_rows(total: np.ndarray, where: np.ndarray, value: np.ndarray) -> None:
    """Adds each row of value to the row of total that where names. Two columns at a time, as complex numbers."""
    kind = np.complex64 if value.dtype == np.float32 else np.complex128
    to, more = total.view(kind), value.view(kind)
    for j in range(to.shape[1]):
        np.add.at(to[:, j], where, more[:, j])


def trees(cls: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Huffman's tree over the events of each class: where each event's choices begin (with the end), the choices' nodes, which way they
    go (1 or -1), and for each node ln of the weight on the side of 1 over that on the other."""
    parent, way, odds = np.full(2 * len(cls), -1), np.ones(2 * len(cls), np.float32), []
    for members in np.split(np.argsort(cls, kind="stable"), np.cumsum(np.bincount(cls))[:-1]):
        heap = list(zip(weight[members].tolist(), members.tolist(), strict=True))
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            node = len(cls) + len(odds)
            parent[left] = parent[right] = node
            way[right] = -1
            odds.append(np.log(a / b))
            heapq.heappush(heap, (a + b, node))
    event, at, found = np.arange(len(cls)), np.arange(len(cls)), []
    while True:
        some = parent[at] >= 0
        event, at = event[some], at[some]
        if not len(at):
            break
        found.append((event, parent[at] - len(cls), way[at]))
        at = parent[at]
    event, node, side = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    order = np.argsort(event, kind="stable")
    return np.append(0, np.cumsum(np.bincount(event, minlength=len(cls)))), node[order].astype(np.int32), side[order].astype(np.float32), np.array(odds, np.float32)


class IdModel(Model):
    """Attention over events: 0 is the end, 1 + id an id that begins a word, 1 + size + id one inside a word."""

    step_rows = 512

    def __init__(self, last: np.ndarray, begins: np.ndarray, inner: np.ndarray, beside: np.ndarray, among: np.ndarray, n_ends: int) -> None:
        """last: code of each id's last byte; begins, inner: of ids that begin words and inside words; beside, among: their profiles;
        n_ends: of texts."""
        self.size, halves = len(last), []
        for count, profile in ((begins, beside), (inner, among)):
            x = np.sqrt(profile / np.maximum(profile.reshape(self.size, 2, PROFILE).sum(axis=2), 1).repeat(PROFILE, axis=1)).astype(np.float64)
            weight = np.sqrt(count.astype(np.float64))
            halves.append((clusters(x, weight, CLASSES // 2), clusters(x, weight, CLUSTERS // 2)))
        self.k = 2 * (CLASSES // 2) + 1
        self.cls = np.concatenate([[0], 1 + halves[0][0], 1 + CLASSES // 2 + halves[1][0]])
        weight = np.concatenate([[n_ends], begins, inner]) + LITTLE
        mass = np.bincount(self.cls, weights=weight, minlength=self.k)
        with np.errstate(divide="ignore"):
            self.prior = np.maximum(np.log(mass / mass.sum()), -1e9).astype(np.float32)  # a class may have no event
        self.path_at, self.node, self.way, self.odds = trees(self.cls, weight)
        # A class's heaviest nodes are the last ones made, a way goes from light ones to heavy ones. Places that a class lacks name any
        # node, no way goes there.
        last_node = np.cumsum(np.maximum(np.bincount(self.cls, minlength=self.k) - 1, 0))
        first_node = np.append(0, last_node[:-1])
        heavy = last_node[:, None] - HEAVY + np.arange(HEAVY)
        event = np.repeat(np.arange(len(self.cls)), np.diff(self.path_at))
        place = self.node - heavy[self.cls[event], 0]
        self.light_len = np.bincount(event[place < 0], minlength=len(self.cls))
        self.heavy_way = np.zeros((len(self.cls), HEAVY), np.int8)
        self.heavy_way[event[place >= 0], place[place >= 0]] = self.way[place >= 0]
        there = heavy >= first_node[:, None]
        self.heavy = np.where(there, heavy, 0)
        self.heavy_odds = np.where(there, self.odds[self.heavy] if len(self.odds) else 0, 0).astype(np.float32)
        r, d = np.random.default_rng(11), WIDTH
        init = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        # Rows of E: clusters, the start, last bytes, and one for each event (0 at first).
        start, own = CLUSTERS, CLUSTERS + 1 + BYTES
        self.start = 0  # the end is never read; in its place stands the start
        cluster = np.concatenate([halves[0][1], CLUSTERS // 2 + halves[1][1]])
        self.rows_of = np.stack([np.append(start, cluster), np.append(start, CLUSTERS + 1 + np.tile(last, 2)), own + np.arange(2 * self.size + 1)])
        self.p = {
            "E": np.concatenate([init(own, d) * np.float32(12), np.zeros((2 * self.size + 1, d), np.float32)]), "Q": init(d, d), "K": init(d, d), "V": init(d, d),
            "B": np.zeros((1, 2 * BLOCK), np.float32), "H": init(d, d), "X": init(d, d), "O": np.zeros((d, self.k), np.float32), "T": np.zeros((max(1, len(self.odds)), d), np.float32),
        }
        at, key_at = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None]
        self.mask = np.where(key_at <= at, 0, -1e9).astype(np.float32)
        self.back = np.clip(at - key_at, 0, 2 * BLOCK - 1)

    def texts(self, ids: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocks of the events of texts of n words; the next ones are events here, not classes."""
        event = ids + (1 + self.size)
        event[begin] -= self.size
        return self._laid(event[:, None], event, self.lengths(ids, begin, n))

    @staticmethod
    def lengths(ids: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many ids texts of n words have."""
        return np.diff(np.append(begin, len(ids))[np.append(0, np.cumsum(n))])

    def class_of(self, nxt: np.ndarray) -> np.ndarray:
        return self.cls[np.maximum(nxt, 0)]

    def _heavy(self, u: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, ...]:
        """Choices at the heaviest nodes of each class, for blocks of `SIDE` places of one class as products with all of these: where each
        place of nxt is, the blocks' classes, vectors of the nodes and of the places, ways (0: not on an event's way), and the ways' logits."""
        cls = self.cls.take(nxt)
        n = np.bincount(cls, minlength=self.k)
        blocks = -(-n // SIDE)
        at = np.empty(len(nxt), np.intp)
        at[np.argsort(cls.astype(np.uint8), kind="stable")] = np.arange(len(nxt)) + np.repeat(SIDE * (np.cumsum(blocks) - blocks) - (np.cumsum(n) - n), n)  # there are few classes
        of = np.repeat(np.arange(self.k), blocks)
        place, event = np.zeros((2, SIDE * len(of)), np.intp)  # what is left free is an end, which has no choice
        place[at], event[at] = np.arange(len(nxt)), nxt
        t = self.p["T"].take(self.heavy, axis=0)
        own, way = u.take(place, axis=0).reshape(len(of), SIDE, -1), self.heavy_way.take(event, axis=0).astype(u.dtype).reshape(len(of), SIDE, -1)
        z = own @ np.ascontiguousarray(t.transpose(0, 2, 1)).take(of, axis=0)
        z += self.heavy_odds.take(of, axis=0)[:, None]
        z *= way
        return at, of, t, own, way, z

    def _light(self, u: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, ...]:
        """For all other choices on the ways to the next events: the place in nxt, node, way, vectors of node and place, and the way's logit."""
        n = self.light_len.take(nxt)
        some = np.flatnonzero(n)
        n = n.take(some)
        place = np.repeat(some, n)
        at = np.arange(len(place)) + np.repeat(self.path_at.take(nxt.take(some)) - (np.cumsum(n) - n), n)
        node, way = self.node.take(at), self.way.take(at)
        t, own = self.p["T"].take(node, axis=0), u.take(place, axis=0)
        return place, node, way, t, own, way * (_dots(t, own) + self.odds.take(node))

    def rest(self, u: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        nxt = np.maximum(nxt, 0)
        at, _, _, _, way, z = self._heavy(u, nxt)
        np.exp(np.minimum(np.negative(z, out=z), 80, out=z), out=z)
        z *= np.abs(way, out=way)
        out = (np.log1p(z, out=z) @ np.ones(HEAVY, z.dtype)).ravel().take(at)
        place, _, _, _, _, z = self._light(u, nxt)
        return -out - np.bincount(place, weights=np.log1p(np.exp(np.minimum(-z, 80))), minlength=len(nxt))

    def rest_gradient(self, u: np.ndarray, nxt: np.ndarray, g: dict) -> np.ndarray:
        scale, nxt = u.dtype.type(-1 / max(1, int((nxt >= 0).sum()))), np.maximum(nxt, 0)
        at, of, t, own, way, z = self._heavy(u, nxt)
        np.exp(np.minimum(z, 60, out=z), out=z)
        z += 1
        way *= scale
        way /= z
        out = (way @ t.take(of, axis=0)).reshape(-1, u.shape[1]).take(at, axis=0)
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        by_node = np.add.reduceat(way.transpose(0, 2, 1) @ own, first).reshape(-1, u.shape[1])
        met = np.flatnonzero(by_node.any(axis=1))
        heavy = self.heavy[of[first]].ravel()
        place, node, way, t, own, z = self._light(u, nxt)
        dz = (way * scale / (1 + np.exp(np.minimum(z, 60))))[:, None].astype(u.dtype)
        own *= dz
        rows, sums = _sums(node, own, len(self.p["T"]))
        g["T"] = np.concatenate([heavy[met], rows]), np.concatenate([by_node[met], sums])
        t *= dz
        _add_rows(out, place, t)
        return out

    def entered(self, ctx: np.ndarray) -> np.ndarray:
        x = self.p["E"].take(self.rows_of[0].take(ctx[..., 0]), axis=0)
        for rows in self.rows_of[1:]:
            x += self.p["E"].take(rows.take(ctx[..., 0]), axis=0)
        return x

    def entries(self) -> np.ndarray:
        return self.entered(np.arange(self.rows_of.shape[1])[:, None])

    def rows_gradient(self, ctx: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        event, by_event = _sums(ctx.ravel(), value, self.rows_of.shape[1])
        # Each event's own row is its alone; clusters and last bytes are few.
        common = np.zeros((CLUSTERS + 1 + BYTES, value.shape[1]), value.dtype)
        for rows in self.rows_of[:-1]:
            _add_rows(common, rows.take(event), by_event)
        met = np.flatnonzero(common.any(axis=1))
        return np.concatenate([met, self.rows_of[-1].take(event)]), np.concatenate([common[met], by_event])


def _sums(where: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (below size) that occur, and for each the sums of value (a row for each of where)."""
    there = np.zeros(size, bool)
    there[where] = True
    rows = np.flatnonzero(there)
    place = np.empty(size, np.intp)
    place[rows] = np.arange(len(rows))
    total = np.zeros((len(rows), value.shape[1]), value.dtype)
    _add_rows(total, place.take(where), value)
    return rows, total


class Trainer:
    """Adam over blocks, in the order in which they come; of tables whose gradient names rows, only these move."""

    def __init__(self, model: Model, rate: float = 6e-3) -> None:
        self.model, self.rate, self.step = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in model.p.items()}

    def feed(self, ctx: np.ndarray, nxt: np.ndarray, is_first: np.ndarray) -> None:
        size = self.model.step_rows
        for lo in range(0, len(ctx), size):
            part = slice(lo - 1, lo + size) if lo else np.r_[0, : min(len(ctx), size)]
            self.step += 1
            rate = float(self.rate / np.sqrt(1 + self.step / 100))
            # m and v are held without the factors 0.1 and 0.01 of what is new.
            whole = np.sqrt(0.01 / (1 - 0.99**self.step))
            little, rate = np.float32(1e-8 / whole), np.float32(rate * 0.1 / (1 - 0.9**self.step) / whole)
            for k, g in self.model.gradient(ctx[part], nxt[part], is_first[part]).items():
                p, m, v, at = self.model.p[k], self.m[k], self.v[k], None
                if isinstance(g, tuple):
                    at, g = g
                    m, v = m.take(at, axis=0), v.take(at, axis=0)
                m *= np.float32(0.9)
                m += g
                g *= g
                v *= np.float32(0.99)
                v += g
                by = np.sqrt(v)
                by += little
                np.divide(m, by, out=by)
                by *= rate
                if at is None:
                    p -= by
                else:
                    self.m[k][at], self.v[k][at] = m, v
                    p[at] = p.take(at, axis=0) - by


def _averaged(trained: DataFrame) -> dict[str, np.ndarray] | None:
    """The mean of all tasks' parameters (n, p), weighted by n: summed in groups of 16 until few are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0
        for batch in batches:
            for n, raw in zip(batch.column("n").to_pylist(), batch.column("p").to_pylist(), strict=True):
                total, weight = _add(total, weight, pickle.loads(raw), n)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([pickle.dumps(total)], pa.binary())], ["n", "p"])

    tasks = trained.rdd.getNumPartitions()
    while tasks > 16:
        tasks = -(-tasks // 16)
        trained = trained.repartition(tasks).mapInArrow(tidy(run), "n long, p binary")
    total, weight = None, 0
    for r in sorted(trained.collect(), key=lambda r: (r["n"], bytes(r["p"]))):
        total, weight = _add(total, weight, pickle.loads(r["p"]), r["n"])
    return total


def _add(total: dict | None, weight: int, p: dict, n: int) -> tuple[dict, int]:
    if total is None:
        return p, n
    share = np.float32(n / (weight + n))
    return {k: total[k] + share * (p[k] - total[k]) for k in total}, weight + n


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of stored rows, where words begin among them, and how many words each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint16)[offsets[0] : offsets[-1]]
    begin = np.flatnonzero(raw & FIRST)
    upto = np.searchsorted(begin, offsets - offsets[0])
    return (raw & (FIRST - 1)).astype(np.int64), begin, np.diff(upto)


def train(rows: DataFrame, model: Model) -> Model:
    """rows: the training documents (ids); the model with its parameters learned from all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen = Trainer(model), 0
        start = {k: v.copy() for k, v in model.p.items()}
        for batch in batches:
            for part in _texts(batch.column("ids")):
                ids, begin, n = _unpacked(batch.column("ids").slice(part.start, part.stop - part.start))
                ctx, nxt, first, _ = model.texts(ids, begin, n)
                trainer.feed(ctx, nxt, first)
                seen += int((nxt >= 0).sum())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([pickle.dumps(model.p)], pa.binary())], ["n", "p"])
        model.p.update(start)

    learned = _averaged(rows.mapInArrow(tidy(run), "n long, p binary"))
    if learned is not None:
        model.p = learned
    return model


class Slots:
    """Where different keys (hashes, long) are, in an open table with a quarter of its slots taken at most."""

    def __init__(self, key: np.ndarray) -> None:
        self.key, self.mask = np.append(key, 0), (1 << max(4, int(4 * len(key) - 1).bit_length())) - 1  # the last one is where an empty slot points
        self.slot = np.full(self.mask + 1, len(key), np.int32)
        left, self.probes = np.arange(len(key), dtype=np.int32), 0
        while len(left):
            slot = (key[left] + self.probes) & self.mask
            free = self.slot[slot] == len(key)
            self.slot[slot[free]] = left[free]  # of several the last one gets it
            left, self.probes = left[self.slot[slot] != left], self.probes + 1

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key among those given, or -1."""
        at = self.slot.take(key & self.mask)
        past = len(self.key) - 1
        found = (self.key.take(at) == key) & (at < past)
        out, left = np.where(found, at, -1), np.flatnonzero(~found & (at < past))
        for probe in range(1, self.probes):
            at = self.slot.take((key[left] + probe) & self.mask)
            found = (self.key.take(at) == key[left]) & (at < past)
            out[left[found]] = at[found]
            left = left[~found & (at < past)]
        return out


class Corpus:
    """What is gathered from the documents: their ids, counts, and totals."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, path: str) -> None:
        spark = shared(docs.sparkSession)
        rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), HELD_PARTS).alias("held"), F.col(text).alias("text"))
        folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
        made = tokenised(rows, path, folder)
        self.spark, self.path = spark, path
        self.rows = made.where("ids IS NOT NULL").select("doc_id", "held", "ids")
        made.where("kind IS NOT NULL").groupBy("kind", "key", "first").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).write.parquet(f"{folder}-counts")
        counts = spark.read.parquet(f"{folder}-counts")
        self.words = counts.where(f"kind = {WORD}").select("key", "first", "c", "n")
        self.tables = counts.where(f"kind <> {WORD}").select("kind", "key", "c")
        self.different = self.words.where("c > 0").groupBy("first").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("c")).toArrow()  # a row for each subword at most
        self.ends = self.rows.where("NOT held").count()
        self.n, self.v = (sum(self.different.column(x).to_pylist()) + more for x, more in (("c", self.ends), ("v", 1 if self.ends else 0)))

    def model(self) -> Model:
        """The model of words that the counts give, not yet trained."""
        last = last_bytes(self.path)
        different = np.zeros(len(last))
        different[self.different.column("first").to_numpy()] = self.different.column("v").to_numpy()
        begins, beside = self._tables(len(last), BEGIN, BESIDE)
        return Model(last, begins, different, beside, self.ends)

    def id_model(self) -> IdModel:
        """The model of ids that the counts give, not yet trained."""
        last = last_bytes(self.path)
        begins, beside, inner, among = self._tables(len(last), BEGIN, BESIDE, INNER, AMONG)
        return IdModel(last, begins, inner, beside, among, self.ends)

    def _tables(self, size: int, *kinds: int) -> list[np.ndarray]:
        """Counts by id and profiles, as arrays of size, and of 2 * PROFILE * size cells."""
        table = self.tables.where(F.col("kind").isin(list(kinds))).toArrow()
        kind, key, c = (table.column(x).to_numpy() for x in ("kind", "key", "c"))
        found = []
        for k in kinds:
            cells = np.zeros(size if k in (BEGIN, INNER) else size * 2 * PROFILE)
            cells[key[kind == k]] = c[kind == k]
            found.append(cells if k in (BEGIN, INNER) else cells.reshape(size, -1))
        return found


def apply(corpus: Corpus, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the whole text), a row for each document. With
    an `IdModel` the score is made by attention alone, all ids of a text and its end; with a `Model` words' shares come from counts."""
    by_count = not isinstance(model, IdModel)
    spark, n, ends = corpus.spark, corpus.n, corpus.ends
    least = _at_most(corpus.words, "n", KNOWN)
    table = corpus.words.where(F.col("n") >= least).select("key", "c").toArrow()  # at most KNOWN rows
    whole = float(np.log10(n + LITTLE * (corpus.v + 1)))
    end_base = float(np.log10(ends + LITTLE) - whole)
    sent = spark.sparkContext.broadcast((table.column("key").to_numpy(), table.column("c").to_numpy(), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, lm = sent.value
        slots, log_count, tables = Slots(key), np.log10(count + LITTLE), lm.tables()
        for batch in batches:
            for part in _texts(batch.column("ids")):
                rows = part.stop - part.start
                ids, begin, m = _unpacked(batch.column("ids").slice(part.start, rows))
                name, text_of = names(ids, begin), np.repeat(np.arange(rows), m)
                ctx, nxt, is_first, text_at = lm.texts(ids, begin, m)
                lp = lm.log_class(ctx, nxt, is_first, tables)
                by_model = np.add.reduceat(lp.sum(axis=1), text_at // BLOCK)
                at = slots.find(name)
                found = at >= 0
                at, own = at[found], text_of[found]
                counted = np.bincount(own, weights=log_count[at], minlength=rows)
                if by_count:
                    by_model += counted - np.bincount(text_of, weights=lm.whole[lm.cls[ids[begin]]], minlength=rows)
                rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(text_of[~found], minlength=rows))), pa.int32()), pa.array(name[~found]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.start, rows), batch.column("held").slice(part.start, rows), pa.array(m + 1, pa.int64()),
                        pa.array(np.bincount(own[count[at] > 0], minlength=rows) + (1 if ends else 0), pa.int64()), pa.array(counted - m * whole + end_base, pa.float64()),
                        pa.array(by_model, pa.float64()), rare,
                    ],
                    ["doc_id", "held", "n_tokens", "met", "base", "score", "rare"],
                )

    kind = corpus.rows.schema["doc_id"].dataType.simpleString()
    scored = corpus.rows.mapInArrow(tidy(run), f"doc_id {kind}, held boolean, n_tokens long, met long, base double, score double, rare array<long>")
    scored = scored.withColumn("row", F.monotonically_increasing_id()).checkpoint()  # written, so that row numbers stay
    # Words that were not sent along: their counts are joined. None is frequent in all documents together, so no key has many rows.
    found = scored.select("row", F.explode("rare").alias("key")).join(corpus.words.where((F.col("n") < least) & (F.col("c") > 0)).select("key", "c"), "key", "left")
    more = found.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(LITTLE))).alias("more"), F.count("c").alias("known"))
    return scored.join(more, "row", "left").select(
        "doc_id",
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("met") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0)) if by_count else F.col("score")).alias("score"),
    )


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The scores of all documents by a model of those that are not held out; see `apply`."""
    corpus = Corpus(docs, doc_id, text, path or subwords.model_path())
    return apply(corpus, train(corpus.rows.where("NOT held").select("ids"), corpus.id_model()))
