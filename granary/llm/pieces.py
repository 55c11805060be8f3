"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut where a space follows something else (no piece of the model crosses such a place), and each different segment is
encoded once. All new segments of a batch are merged together in flat numpy arrays: each round looks up the rank of every
adjacent pair, takes each segment's least, merges all its non-overlapping occurrences from the left at once, and drops finished
segments, until no pair remains. Where a merge would make a pair that must come before the next occurrence, that segment merges
only its leftmost one in this round, so that the order is the library's: best score first, then leftmost.

Cases: a null text counts as empty and has no ids; characters without a piece become their UTF-8 bytes' pieces; repeated rows
and ties are rows like others; an empty table gives none; of the input only the id and text are read. A segment of more
than `LONG` characters is merged by itself, in rounds that cost what they merge; a worker's memory follows one batch and a cache of a stated number of segments.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import tidy

SPACE = "▁"
NORMAL, BYTE = 1, 6
#: Characters without a piece are symbols from here on.
SHIFT = 1 << 21
#: The rank of pairs that are no piece.
NONE = 1 << 40
#: Segments in a worker's cache, characters in it, and characters encoded at a time.
CACHE, CACHE_CHARS, AT_A_TIME = 200_000, 8_000_000, 1_000_000
#: Characters from which on a segment is merged by itself.
LONG = 1000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A BPE model: its pieces, its table of pairs, and encoding and decoding."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.model_type != 2:
            raise ValueError("only BPE models without normalisation and with a leading space are handled")
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.size = len(proto.pieces)
        self.byte_id = np.zeros(256, np.int64)
        data: list[bytes] = []
        self.is_byte = np.zeros(self.size, bool)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:-1], 16)] = i
                self.is_byte[i] = True
            data.append(bytes([int(p.piece[3:-1], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else b" \xe2\x81\x87 " if p.type == 2 else b"")
        self.piece_len = np.array([len(x) for x in data], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(data), np.uint8)
        self.begins_space = np.array([x[:1] == b" " and p.type == NORMAL for x, p in zip(data, proto.pieces, strict=True)])
        # Runs of spaces: the library merges them last and from the left, so that a run is cut alike from its longest piece on.
        self.space_run = {len(p): i for p, i in ids.items() if set(p) == {SPACE}}
        self.longest = max(self.space_run)
        self.cuts = [self._from_left(n) for n in range(2 * self.longest)]
        if any(SPACE in p.lstrip(SPACE) or p[:2] == SPACE * 2 and set(p) != {SPACE} for p in ids):
            raise ValueError("pieces of this model cross the ends of words")
        if any(c != [self.longest, *self.cuts[n]] for n, c in enumerate(self.cuts[self.longest :])):
            raise ValueError("this model cuts runs of spaces in another way")
        scores = {-proto.pieces[i].score for p, i in ids.items()}
        rank = {s: r for r, s in enumerate(sorted(scores))}
        self.char_id = {p: i for p, i in ids.items() if len(p) == 1}
        table: dict[int, tuple[int, int]] = {}
        for piece, i in ids.items():
            if set(piece) == {SPACE}:
                continue
            for cut in range(1, len(piece)):
                a, b = (ids.get(x, SHIFT // 2 + ord(x) if len(x) == 1 else None) for x in (piece[:cut], piece[cut:]))
                if a is not None and b is not None:
                    table[a * SHIFT + b] = (rank[-proto.pieces[i].score], i)
        keys = np.array(sorted(table), np.int64)
        self.rank = np.array([table[k][0] for k in keys.tolist()] + [NONE], np.int64)
        self.made = np.array([table[k][1] for k in keys.tolist()] + [0], np.int64)
        self._hash(keys)
        self.char_code = np.array(sorted(ord(c) for c in self.char_id), np.int64)
        self.char_piece = np.array([self.char_id[chr(c)] for c in self.char_code.tolist()], np.int64)
        # The cache: segment -> place in flat arrays.
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.known_chars = 0
        self.seg_ids = np.zeros(0, np.int32)
        self.seg_at = np.zeros(1, np.int64)

    def _from_left(self, n: int) -> list[int]:
        """The lengths into which merges cut n spaces when the leftmost possible one is always next."""
        parts = [1] * n
        while at := [i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.space_run][:1]:
            parts[at[0] : at[0] + 2] = [parts[at[0]] + parts[at[0] + 1]]
        return parts

    def _hash(self, keys: np.ndarray) -> None:
        """Puts the pairs into an open table of slots, a quarter full at most."""
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4))))
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_entry = np.full(1 << self.bits, len(keys), np.int64)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            slot = self._slot(keys[left], probe)
            free = self.slot_key[slot] == -1
            _, first = np.unique(slot, return_index=True)
            placed = np.zeros(len(left), bool)
            placed[first] = True
            placed &= free
            self.slot_key[slot[placed]], self.slot_entry[slot[placed]] = keys[left[placed]], left[placed]
            left, probe = left[~placed], probe + 1
        self.probes = probe

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (mixed.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where each pair is in the table; the entry past the end has no rank."""
        key = a * SHIFT + b
        slot = self._slot(key, 0)
        there = self.slot_key[slot]
        out = np.where(there == key, self.slot_entry[slot], len(self.rank) - 1)
        left = np.flatnonzero((there != key) & (there != -1))
        for probe in range(1, self.probes):
            if not len(left):
                break
            slot = self._slot(key[left], probe)
            there = self.slot_key[slot]
            found = there == key[left]
            out[left[found]] = self.slot_entry[slot[found]]
            left = left[~found & (there != -1)]
        return out

    def merge(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments in one array, and how many each has."""
        code = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        at = np.minimum(np.searchsorted(self.char_code, code), len(self.char_code) - 1)
        sym = np.where(self.char_code[at] == code, self.char_piece[at], SHIFT // 2 + code)
        past = len(self.rank) - 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if long := [i for i, s in enumerate(segments) if len(s) > LONG]:
            own = np.zeros(len(segments), bool)
            own[long] = True
            own = own[word]
            at = np.cumsum([0, *(len(segments[i]) for i in long)])
            for i, a, b in zip(long, at[:-1], at[1:], strict=True):
                whole = self._merge_long(sym[own][a:b])
                done.append((np.full(len(whole), i), whole))
            sym, word = sym[~own], word[~own]
        while len(sym):
            same = word[1:] == word[:-1]
            entry = np.append(np.where(same, self._pair(sym[:-1], sym[1:]), past), past)
            rank = self.rank[entry]
            starts = np.flatnonzero(np.append(True, ~same))
            lens = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                gone = np.repeat(over, lens)
                done.append((word[gone], sym[gone]))
                sym, word, rank, entry = sym[~gone], word[~gone], rank[~gone], entry[~gone]
                lens, least = lens[~over], least[~over]
                if not len(sym):
                    break
            # Of hits in a row every second one overlaps the one before it.
            pos = np.flatnonzero(rank == np.repeat(least, lens))
            first = np.append(True, np.diff(pos) > 1)
            run_start = pos[np.flatnonzero(first)[np.cumsum(first) - 1]]
            take = pos[(pos - run_start) % 2 == 0]
            made = self.made[entry[take]]
            # Pairs that these merges make: with either neighbour, and with a neighbour that is merged as well.
            left, right = np.maximum(take - 1, 0), np.minimum(take + 2, len(sym) - 1)
            is_left, is_right = (take > 0) & (word[left] == word[take]), (take + 2 < len(sym)) & (word[right] == word[take])
            again = np.append(word[take][1:] == word[take][:-1], False)
            again |= np.append(False, again[:-1])
            early = np.zeros(len(take), bool)
            if again.any():  # only where a segment has several of its best pair the order within the round counts
                k = np.flatnonzero(again)
                bound = rank[take[k]]
                early[k] = is_left[k] & (self.rank[self._pair(sym[left[k]], made[k])] <= bound)
                early[k] |= is_right[k] & (self.rank[self._pair(made[k], sym[right[k]])] <= bound)
                twin = np.append((np.diff(take) == 2) & is_right[:-1], False)[k]
                early[k] |= twin & (self.rank[self._pair(made[k], np.append(made[1:], 0)[k])] <= bound)
            if early.any():
                bad = np.zeros(len(segments), bool)
                bad[word[take[early]]] = True
                keep = ~bad[word[take]] | np.append(True, np.diff(word[take]) != 0)
                take, made = take[keep], made[keep]
            sym[take] = made
            alive = np.ones(len(sym), bool)
            alive[take + 1] = False
            sym, word = sym[alive], word[alive]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(segments), np.int64)
        word, sym = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return self._finish(sym[order], np.bincount(word, minlength=len(segments)))

    def _merge_long(self, sym: np.ndarray) -> np.ndarray:
        """The symbols that are left of one long segment. The same rounds, but the places of each rank are kept in lists, and only pairs
        next to a merge are looked up again, so that a round costs what it merges and not the segment's length."""
        n, sym = len(sym), sym.copy()
        nxt, prev = np.arange(1, n + 1), np.arange(-1, n)  # n: none behind; prev[n] is never read
        entry = np.append(self._pair(sym[:-1], sym[1:]), len(self.rank) - 1)
        rank, made, alive = self.rank[entry], self.made[entry], np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else []:
                r = int(rank[part[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(part)

        put(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            pos = np.unique(np.concatenate(places.pop(r)))
            pos = pos[rank[pos] == r]
            if not len(pos):
                continue
            # Of hits in a row every second one overlaps the one before it.
            first = np.append(True, nxt[pos[:-1]] != pos[1:])
            k = np.arange(len(pos))
            take = pos[(k - k[first][np.cumsum(first) - 1]) % 2 == 0]
            new = made[take]
            if len(take) > 1:
                left, right = prev[take], nxt[nxt[take]]
                # If a merge makes a pair that comes before the next occurrence, only the first one is merged now.
                early = self.rank[self._pair(sym[np.maximum(left, 0)], new)] <= r
                early &= left >= 0
                behind = self.rank[self._pair(new, sym[np.minimum(right, n - 1)])] <= r
                early |= behind & (right < n)
                early[:-1] |= (right[:-1] == take[1:]) & (self.rank[self._pair(new[:-1], new[1:])] <= r)
                if early.any():
                    later, take, new = pos[1:], take[:1], new[:1]
                    places[r] = [later]
                    heapq.heappush(ranks, r)
            gone = nxt[take]
            sym[take], rank[gone], alive[gone] = new, NONE, False
            nxt[take] = nxt[gone]
            prev[nxt[take]] = take
            again = np.unique(np.concatenate([prev[take], take]))
            again = again[again >= 0]
            entry = self._pair(sym[again], sym[np.minimum(nxt[again], n - 1)])
            rank[again], made[again] = np.where(nxt[again] < n, self.rank[entry], NONE), self.made[entry]
            put(again)
        return sym[alive]

    def _finish(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cuts the runs of spaces that are left in front, and turns characters without a piece into bytes."""
        space, size = self.space_run[1], np.ones(len(sym), np.int64)
        starts = np.cumsum(lens) - lens
        pair = np.flatnonzero(lens > 1)
        for i in pair[(sym[starts[pair]] == space) & (sym[starts[pair] + 1] == space)].tolist():
            s, e = int(starts[i]), int(starts[i] + lens[i])
            n = int(np.argmin(np.append(sym[s:e] == space, False)))
            runs = [self.longest] * (n // self.longest) + self.cuts[n % self.longest]
            sym[s : s + len(runs)] = [self.space_run[r] for r in runs]
            size[s + len(runs) : s + n] = 0
        at = np.arange(len(sym))
        odd = np.flatnonzero(sym >= SHIFT // 2)
        codes, which = np.unique(sym[odd] - SHIFT // 2, return_inverse=True)
        raw = [chr(c).encode() for c in codes.tolist()]
        if raw:
            n = np.array([len(r) for r in raw], np.int64)
            at[odd], size[odd] = len(sym) + (np.cumsum(n) - n)[which], n[which]
            sym = np.append(sym, self.byte_id[np.frombuffer(b"".join(raw), np.uint8)])
        ends = np.append(0, np.cumsum(size))
        return gather(sym, at, size), ends[starts + lens] - ends[starts]

    def _segments(self, text: str) -> list[str]:
        """A text's segments: a run of spaces with what follows."""
        if not text:
            return []
        parts = (" " + text.replace(SPACE, " ")).split(" ")
        # parts[0] is empty; empty parts further on are spaces before the next.
        if "" not in parts[1:]:
            return parts[1:]
        out, spaces = [], 0
        for p in parts[1:]:
            if p:
                out.append(SPACE * spaces + p if spaces else p)
                spaces = 0
            else:
                spaces += 1
        if spaces:
            out.append(SPACE * (spaces - 1))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text begins in it (with the end)."""
        if len(self.known) > CACHE or self.known_chars > CACHE_CHARS:
            self._clear()
        per_text = [self._segments(t) for t in texts]
        known = self.known
        todo, at = sorted(set(chain.from_iterable(per_text)).difference(known), key=len), 0
        while at < len(todo):
            size, to = 0, at
            while to < len(todo) and (to == at or size + len(todo[to]) + 1 <= AT_A_TIME):
                size += len(todo[to]) + 1
                to += 1
            # Each stored segment lacks the one space that every segment begins with.
            ids, n = self.merge([SPACE + s for s in todo[at:to]])
            base = len(self.seg_at) - 1
            known.update(zip(todo[at:to], range(base, base + to - at), strict=True))
            self.known_chars += size
            self.seg_ids = np.append(self.seg_ids, ids.astype(np.int32))
            self.seg_at = np.append(self.seg_at, self.seg_at[-1] + np.cumsum(n))
            at = to
        counts = np.array([len(s) for s in per_text], np.int64)
        index = np.fromiter(map(known.__getitem__, chain.from_iterable(per_text)), np.int64, int(counts.sum()))
        lens = self.seg_at[index + 1] - self.seg_at[index]
        flat = gather(self.seg_ids, self.seg_at[index], lens)
        ends = np.append(0, np.cumsum(lens))
        return flat, ends[np.append(0, np.cumsum(counts))]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The text of each of the id lists that lie in ids from at[i] to at[i + 1], as the library reads them."""
        ids = np.asarray(ids, np.int64)
        lens = self.piece_len[ids]
        # The space that the encoder puts in front goes.
        heads = at[:-1][at[1:] > at[:-1]]
        drop = np.zeros(len(ids), np.int64)
        drop[heads] = self.begins_space[ids[heads]]
        data = gather(self.piece_bytes, self.piece_at[ids] + drop, lens - drop).tobytes()
        ends = np.append(0, np.cumsum(lens - drop))
        texts = []
        for i in range(len(at) - 1):
            raw = data[ends[at[i]] : ends[at[i + 1]]]
            try:
                texts.append(raw.decode())
            except UnicodeDecodeError:
                texts.append(self._decode_slowly(ids[at[i] : at[i + 1]], int(drop[at[i]])))
        return texts

    def _decode_slowly(self, ids: np.ndarray, drop: int) -> str:
        """For bytes that are no UTF-8: each byte that begins no character becomes U+FFFD."""
        out, i = [], 0
        piece = lambda k: self.piece_bytes[self.piece_at[k] : self.piece_at[k] + self.piece_len[k]].tobytes()
        while i < len(ids):
            if not self.is_byte[ids[i]]:
                out.append(piece(ids[i])[drop if i == 0 else 0 :].decode())
                i += 1
                continue
            to = i
            while to < len(ids) and self.is_byte[ids[to]]:
                to += 1
            raw = b"".join(piece(k) for k in ids[i:to])
            at = 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            i = to
        return "".join(out)


def gather(flat: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[at[i] : at[i] + lens[i]] for all i, one after another."""
    total = int(lens.sum())
    begin = np.cumsum(lens) - lens
    return flat[np.repeat(at - begin, lens) + np.arange(total)]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded: what the ids say again."""
    where = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(where)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and (to == at or size + len(texts[to]) <= AT_A_TIME):
                    size += len(texts[to])
                    to += 1
                ids, begin = model.encode(texts[at:to])
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
                decoded = pa.array(model.decode(ids, begin), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), lists, decoded], ["doc_id", "ids", "decoded"])
                at = to

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run, lambda: load(where)._clear()), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_documents(docs, path=path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
