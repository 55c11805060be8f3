"""N-gram Jaccard join: a metric-space join over sets of word shingles, exact at a similarity of 0.75.

Jaccard distance is a metric, so that pivots and the triangle inequality can split the join. Two documents without a common
shingle are at distance 1, and to nearly every document nearly all others are: document pivots alone would replicate everything
everywhere. So there are two levels of pivots.

1. Pivots are pairs of shingles that stand beside each other in one fixed order (frequent ones last, then by hash): a document's
   Voronoi region is that of its first pair, and its window has all regions in which a partner within the distance can have the
   first pair that both hold. A shingle that only the document has parts two of its pairs, one that only the partner has parts one,
   so that no more than 2x + y pairs are not held by both, with x + y <= (n - x) / 3: the window is the first n / 2 pairs or so. (Single
   shingles would need n / 4 only, but those of frequent words meet by chance more often.) Regions with the same members are kept once. In a region a sketch
   (counts of shingles by bucket; their L1 distance is no larger than the symmetric difference) tells what cannot be close; what may
   be close is connected, and the connected groups go on.
2. In a group pivots are documents. Distances to them are exact; a document within the radius of a pivot is linked with it, the
   pairs of what is linked to one pivot need no further look, and triangle windows decide what must still meet: regions by
   nearest pivot, boundary documents replicated, joined recursively. Only where the windows gain nothing (the squares of the regions'
   sizes do not halve) is a region compared in full, without what is connected already or what the distances exclude. Groups of more
   than `GROUP` members are split so by Spark first, level by level, in even pieces of which each meets the pivots; as the squares
   halve, there are at most 2 log2(members / GROUP) levels, and a group whose squares do not halve is compared in pairs of blocks of
   half of `GROUP`. Smaller groups are split within a task. A region of one pair with more than `REGION` members, too many to
   compare sketches in a task, is connected as it stands: its members are one group, each once, and pivots part it.

Documents with equal sets are one member throughout, so that copies cost nothing. Results are the connected components.

Cases: null, empty and blank texts have no set and are linked with nothing; fewer than five words are one shorter shingle; rows
that repeat are members of the same class; null ids take part but name no component unless a class has none other; an empty table
gives no rows; of the input only id and text are read. Shingles are 64-bit hashes of words, a set's key has 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import forget_shuffles, free_name, shared, tidy

WORDS, REGION, GROUP, PIVOTS, CANDIDATES = 5, 4000, 2000, 8, 32
#: Buckets over which rows of one key are spread, and the share of all edges from which on a node counts as a hub.
SPREAD, HUB, HUB_LEAST = 32, 0.001, 200
#: A shingle is frequent from this share of all rows on: there are at most mean set size / share of them, so they can be sent along.
FREQUENT, BATCH_SHARE, BATCH_LEAST = 0.005, 0.02, 4
LEAST_BUCKETS = 64
#: Members that a task packs at a time; buckets of pairs to a partition; the bits of a set's key that a member has.
PACKED, BUCKETS, SHORT = 500_000, 8, (1 << 40) - 1
EPS = 0.25
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


class _Words(dict):
    """Word to hash, bounded by clearing."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles (uint64)."""
    # bytes.lower and bytes.split are ASCII only: A-Z, and white space \\x20 \\x09-\\x0D.
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(a))
    with np.errstate(over="ignore"):
        h = np.full(len(a) - n + 1, np.uint64(n))
        for j in range(n):
            h += a[j : len(a) - n + 1 + j] * _K[j]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def set_key(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def sketch(s: np.ndarray) -> bytes:
    """Counts of shingles by bucket, a power of two of buckets, with four to eight shingles in each of a large set's."""
    size = LEAST_BUCKETS
    while size * 8 < len(s):
        size *= 2
    return np.minimum(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size), 65535).astype(np.uint16).tobytes()


def window(n: int) -> int:
    """How many first pairs of n shingles two different sets at 0.75 or more must have one in common of."""
    return min(n - 1, n // 4 + (n - n // 4) // 3 + 1) if n > 2 else 0


def pairs(s: np.ndarray) -> np.ndarray:
    """Hashes of the shingles that stand beside each other."""
    with np.errstate(over="ignore"):
        return _mix(_mix(s[:-1]) + s[1:] * _K[0])


def _profile(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, th (hash of the text), ka, kb (key of its set), n, sketch; and rows for shingles that a batch
    holds often: s and their count, with no n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: dict[int, int] = {}
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            keys = [set_key(s) for s in sets]
            first = {k: s for k, s in zip(keys, sets, strict=True)}
            flat = np.concatenate([*first.values(), np.zeros(0, np.uint64)])
            values, counts = np.unique(flat, return_counts=True)
            hot = counts >= max(BATCH_LEAST, BATCH_SHARE * len(sets))
            for v, c in zip(values[hot].view(np.int64).tolist(), counts[hot].tolist(), strict=True):
                often[v] = often.get(v, 0) + c
            rows = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("th"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()),
                ],
                ["doc_id", "th", "ka", "kb", "n", "sketch", "s", "c"],
            )
            id_type = batch.schema.field("doc_id").type
        if often:
            rows = len(often)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(rows, id_type), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()),
                    pa.array(list(often), pa.int64()), pa.array(list(often.values()), pa.int64()),
                ],
                ["doc_id", "th", "ka", "kb", "n", "sketch", "s", "c"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run, _words.clear), f"doc_id {kind}, th long, ka long, kb long, n int, sketch binary, s long, c long")


def _memberships(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, raw): each set with the pairs of its window, by bucket of the pair; copies within a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        first, owner, held = [], [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                s = shingles(text)
                p = window(len(s))
                if not p or (ka := set_key(s)[0]) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(ka)
                if len(hot):
                    late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                    if late[: p + 1].any():
                        s = np.concatenate([s[~late], s[late]])
                first.append(pairs(s[: p + 1]))
                owner.append(np.full(p, ka, np.int64))
                held += p
                if held >= PACKED:
                    yield _pack(np.concatenate(first), np.concatenate(owner), buckets)
                    first, owner, held = [], [], 0
        if held:
            yield _pack(np.concatenate(first), np.concatenate(owner), buckets)

    return docs.mapInArrow(tidy(run, _words.clear), "bucket int, raw binary")


def _pack(pair: np.ndarray, ka: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket: four bytes of each member's pair, in order, and five of its key, each byte's place by itself. Members of
    different pairs that meet so are a few in 100,000, and are told apart as all others that are not close."""
    low = pair.astype(np.uint32)
    bucket = ((pair >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(32)) | low)
    low, bucket = low[order].view(np.uint8).reshape(-1, 4), bucket[order]
    key = ka[order].view(np.uint8).reshape(-1, 8)[:, :5]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    raw = [low[lo:hi].T.tobytes() + key[lo:hi].T.tobytes() for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(low)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[start]), pa.array(raw, pa.binary())], ["bucket", "raw"])


def _unpack(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and short keys of the members of a bucket's rows, of pairs that two or more have, in order and each once."""
    low, short = [], []
    for x in raw:
        planes = np.frombuffer(x.as_buffer(), np.uint8).reshape(9, -1)
        low.append(np.ascontiguousarray(planes[:4].T).view(np.uint32).ravel())
        wide = np.zeros((planes.shape[1], 8), np.uint8)
        wide[:, :5] = planes[4:].T
        short.append(wide.view(np.int64).ravel())
    s, k = np.concatenate(low), np.concatenate(short)
    order = np.argsort(s)
    s = s[order]
    same = s[1:] == s[:-1]
    some = np.append(False, same) | np.append(same, False)
    s, k = s[some], k[order[some]]
    order = np.lexsort((k, s))
    s, k = s[order], k[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])  # copies from several tasks
    return s[new], k[new]


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Cuts sorted batches so that no key's rows are divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != k[0]:
            yield _joined(held)
            held = []
        if k[0] != k[-1]:
            cut = int(np.flatnonzero(k != k[-1])[-1]) + 1
            yield _joined([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _regions(members: DataFrame, parts: int) -> DataFrame:
    """(region, short, size) of regions with two members or more; those with the same members have one name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in _runs(batches, "bucket"):
            s, k = _unpack(batch.column("raw"))
            if not len(s):
                continue
            start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            size = np.diff(np.append(start, len(s)))
            with np.errstate(over="ignore"):
                name = _mix(np.add.reduceat(_mix(k.view(np.uint64)), start) + size.astype(np.uint64)).view(np.int64)
            keep = size > 1
            if len(done) > 200_000:
                done.clear()
            if keep.any():
                fresh = [n not in done and not done.add(n) for n in name[keep].tolist()]
                keep[np.flatnonzero(keep)[~np.array(fresh)]] = False
            pick = np.repeat(keep, size)
            if pick.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[pick]) for x in (np.repeat(name, size), k, np.repeat(size, size))], ["region", "short", "size"])

    found = members.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), "region long, short long, size long")
    return found.distinct()


class _Sketches:
    """The sketches of a region's members, at their own number of buckets and at half of it: sets whose sizes are near enough to
    be linked differ by one doubling at most, and buckets are folded to compare them."""

    def __init__(self, raw: list[bytes]) -> None:
        self.size = np.array([len(x) // 2 for x in raw])
        self.rows: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        for size in np.unique(self.size).tolist():
            own = np.flatnonzero((self.size == size) | (self.size == 2 * size))
            counts = [np.frombuffer(raw[i], np.uint16).astype(np.int32) for i in own.tolist()]
            self.rows[size] = np.stack([c if len(c) == size else c[:size] + c[size:] for c in counts])
            self.place[size] = np.full(len(raw), -1)
            self.place[size][own] = np.arange(len(own))

    def near(self, x: int, others: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which of others differ from x by no more than so much, as far as sketches tell."""
        ok = np.zeros(len(others), bool)
        common = np.minimum(self.size[others], self.size[x])
        for size in np.unique(common).tolist():
            k = np.flatnonzero((common == size) & (self.place[size][others] >= 0))
            if self.place[size][x] >= 0 and len(k):
                rows = self.rows[size]
                ok[k] = np.abs(rows[self.place[size][others[k]]] - rows[self.place[size][x]]).sum(axis=1) <= most[k]
        return ok


def _connected(n: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """For each member the first one of its group: what sketches and sizes allow to be close is connected. Each member is held
    only against those not yet reached, so that a group of near copies costs one look at each."""
    counts = _Sketches(sketches)
    label = np.full(len(n), -1, np.int64)
    left = np.argsort(n, kind="stable")
    while len(left):
        root, left = int(left[0]), left[1:]
        label[root] = root
        queue = [root]
        while queue and len(left):
            x = queue.pop()
            lo = int(np.searchsorted(n[left], -(-3 * int(n[x]) // 4), side="left"))
            hi = int(np.searchsorted(n[left], 4 * int(n[x]) // 3, side="right"))
            near = left[lo:hi]
            if not len(near):
                continue
            ok = counts.near(x, near, (n[near] + n[x]) // 7)
            hit = near[ok]
            if len(hit):
                label[hit] = root
                queue.extend(hit.tolist())
                mask = np.ones(len(left), bool)
                mask[lo:hi][ok] = False
                left = left[mask]
    return label


def _candidate_edges(regions: DataFrame, sketches: DataFrame, parts: int) -> DataFrame:
    """(a, b) of keys, a spanning forest of what may be close in each region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "region"):
            region, ka, n, sk = (batch.column(c) for c in ("region", "ka", "n", "sketch"))
            r, ka, n = region.to_numpy(), ka.to_numpy(), n.to_numpy().astype(np.int64)
            start = np.flatnonzero(np.append(True, r[1:] != r[:-1])).tolist() + [len(r)]
            a, b = [], []
            for lo, hi in zip(start[:-1], start[1:], strict=True):
                if hi - lo > 1:
                    label = _connected(n[lo:hi], sk.slice(lo, hi - lo).to_pylist()) + lo
                    other = np.flatnonzero(label != np.arange(lo, hi)) + lo
                    a.append(ka[label[other - lo]])
                    b.append(ka[other])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    joined = regions.join(sketches, "short").drop("short").repartition(parts, "region").sortWithinPartitions("region", "ka")
    return joined.mapInArrow(tidy(run), "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame, kind: str = "long") -> DataFrame:
    """(node, root) of all nodes of edges (a, b): the least node of each component. Nodes point to the least neighbour of their
    root until nothing changes (large star, small star), so that rounds grow with the logarithm of the longest path. No node
    keeps more than one pointer, and every pass sums up before it shuffles."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    while True:
        hub = max(HUB_LEAST, int(HUB * edges.count()))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("d"))
        # Large star: the larger neighbours of a node are joined to the least of its neighbourhood.
        large = _with_least(both, least, hub).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().checkpoint()
        # Small star: a node and its smaller neighbours are joined to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("d"))
        small = _with_least(large, low, hub).select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = small.checkpoint()
        same = edges.join(now, ["a", "b"], "left_anti").isEmpty() and now.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = now
        forget_shuffles(edges.sparkSession)  # what earlier rounds wrote goes
        if same:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """edges with m of their node a. Hubs, of which there are few (each has a stated share of all edges), are sent along, so that
    their edges stay where they are; all others are joined."""
    hubs = F.broadcast(least.where(F.col("d") > hub).select("a", "m"))
    rest = edges.join(F.broadcast(least.where(F.col("d") > hub).select("a")), "a", "left_anti")
    return edges.join(hubs, "a").select("a", "b", "m").union(rest.join(least.where(F.col("d") <= hub).select("a", "m"), "a").select("a", "b", "m"))


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class Region:
    """Sets in one task, joined by document pivots."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.n = np.array([len(s) for s in sets], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.flat = np.concatenate(sets)
        self.union = _Union(len(sets))
        self.by_pivot = self.in_full = 0  # regions that pivots decided, and such that were compared in full

    def distances(self, pivot: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact Jaccard distances of members to a set, and who is linked with it."""
        n = self.n[members]
        flat = self.flat[np.repeat(self.at[members] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        at = np.minimum(np.searchsorted(pivot, flat), len(pivot) - 1)
        owner = np.repeat(np.arange(len(members)), n)
        common = np.bincount(owner[pivot[at] == flat], minlength=len(members))
        whole = n + len(pivot) - common
        return 1 - common / whole, 4 * common >= 3 * whole

    def join(self, members: np.ndarray) -> None:
        """Links all members within the radius, directly or over others."""
        stack = [members]
        while stack:
            region = stack.pop()
            if len(region) < 2:
                continue
            # Pivots: the first member, then each time the one furthest from those before.
            pivots, d, linked = [int(region[0])], [], []
            while True:
                dist, link = self.distances(self.sets[pivots[-1]], region)
                d.append(dist)
                linked.append(link)
                for x in region[link].tolist():
                    self.union.join(pivots[-1], x)
                far = np.min(d, axis=0)
                if len(d) == PIVOTS or far.max() <= EPS:
                    break
                pivots.append(int(region[int(far.argmax())]))
            d_all, link_all = np.array(d), np.array(linked)
            home, nearest = d_all.argmin(axis=0), d_all.min(axis=0)
            # A pivot's links are all known now, so pivots go.
            rest = ~np.isin(region, pivots)
            subs = []
            for k in range(len(pivots)):
                inside = rest & ((home == k) | (d_all[k] <= nearest + 2 * EPS + 1e-9))
                outer = inside & ~link_all[k]
                if outer.any():  # else all are linked with this pivot
                    reach = d_all[k][outer].min() - EPS - 1e-9
                    subs.append(outer | (inside & link_all[k] & (d_all[k] >= reach)))
            # Where the windows replicate so much that nothing is gained, the region is compared in full.
            if sum(int(s.sum()) ** 2 for s in subs) < 0.5 * len(region) ** 2:
                self.by_pivot += 1
                stack.extend(region[s] for s in subs)
            else:
                self.in_full += 1
                any_ = np.any(subs, axis=0)
                self._leaf(region[any_], d_all[:, any_])

    def _leaf(self, region: np.ndarray, d: np.ndarray) -> None:
        """All against all, but for what is connected already or what the triangle inequality over distances d to pivots excludes:
        from each member the search goes on over those not yet reached only, so that near copies cost one look each."""
        # Members of one component are one start: all of it is held against the rest.
        root = np.array([self.union.find(x) for x in region.tolist()])
        order = np.lexsort((self.n[region], root))
        region, root, d = region[order], root[order], d[:, order]
        n = self.n[region]
        left = np.ones(len(region), bool)
        for first in np.flatnonzero(np.append(True, root[1:] != root[:-1])).tolist():
            if not left[first]:
                continue
            queue = np.flatnonzero((root == root[first]) & left).tolist()
            left[queue] = False
            while queue:
                i = queue.pop()
                near = left & (4 * n >= 3 * n[i]) & (3 * n <= 4 * n[i])
                for row in d:
                    near &= np.abs(row - row[i]) <= EPS + 1e-9
                who = np.flatnonzero(near)
                if not len(who):
                    continue
                _, link = self.distances(self.sets[int(region[i])], region[who])
                for j in who[link].tolist():
                    if left[j]:
                        self.union.join(int(region[i]), int(region[j]))
                        same = np.flatnonzero((root == root[j]) & left)  # what is connected with it comes along
                        left[same] = False
                        queue.extend(same.tolist())


def _join_groups(rows: DataFrame, parts: int) -> DataFrame:
    """(a, b) of linked keys, from (group, ka, set): a star for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, "grp"):
            g, ka = batch.column("grp").to_numpy(), batch.column("ka").to_numpy()
            start = np.flatnonzero(np.append(True, g[1:] != g[:-1])).tolist() + [len(g)]
            a, b = [], []
            raw = batch.column("bag")
            for lo, hi in zip(start[:-1], start[1:], strict=True):
                region = Region([np.frombuffer(raw[i].as_py(), np.uint64) for i in range(lo, hi)])
                region.join(np.arange(hi - lo))
                for i in range(hi - lo):
                    if (r := region.union.find(i)) != i:
                        a.append(ka[lo + r])
                        b.append(ka[lo + i])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])

    return rows.repartition(parts, "grp").sortWithinPartitions("grp", "ka").mapInArrow(tidy(run), "a long, b long")


def _spread(rows: DataFrame, table: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """rows (with ka) joined to a small table with a row for each key; a key's rows are spread over buckets, as one may have many."""
    bucket = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    return rows.withColumn("_b", F.pmod(F.xxhash64("ka"), F.lit(SPREAD)).cast("int")).join(table.withColumn("_b", bucket), [*key, "_b"], how).drop("_b")


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group's candidates (grp, ka, bag) the pivots, with a number k: the first, then each time the one furthest from those before."""
    for batch in _runs(batches, "grp"):
        grp = batch.column("grp").to_numpy()
        start = np.flatnonzero(np.append(True, grp[1:] != grp[:-1])).tolist() + [len(grp)]
        rows, number = [], []
        for lo, hi in zip(start[:-1], start[1:], strict=True):
            region = Region([np.frombuffer(batch.column("bag")[i].as_py(), np.uint64) for i in range(lo, hi)])
            far, chosen = np.full(hi - lo, 2.0), 0
            for k in range(min(PIVOTS, hi - lo)):
                chosen = int(far.argmax())
                if far[chosen] <= 0:
                    break
                rows.append(lo + chosen)
                number.append(k)
                far = np.minimum(far, region.distances(region.sets[chosen], np.arange(hi - lo))[0])
                far[chosen] = -1
        picked = batch.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([picked.column("grp"), pa.array(number, pa.int32()), *(picked.column(c) for c in ("ka", "m", "bag"))], ["grp", "k", "ka", "m", "bag"])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces of groups, each with all pivots in front (k is null for members): distances to pivots, links, and the windows."""
    for batch in _runs(batches, "piece"):
        piece = batch.column("piece").to_numpy()
        start = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])).tolist() + [len(piece)]
        for lo, hi in zip(start[:-1], start[1:], strict=True):
            k = batch.column("k").slice(lo, hi - lo).to_pylist()
            n = sum(x is not None for x in k)
            if n == hi - lo:
                continue
            ka, grp = batch.column("ka").to_numpy()[lo:hi], batch.column("grp").to_numpy()[lo:hi]
            sets = [np.frombuffer(batch.column("bag")[i].as_py(), np.uint64) for i in range(lo, hi)]
            region = Region(sets[n:])
            members = np.arange(hi - lo - n)
            found = [region.distances(p, members) for p in sets[:n]]
            d, link = np.array([x for x, _ in found]), np.array([x for _, x in found])
            inside = (d <= d.min(axis=0) + 2 * EPS + 1e-9) & ~np.isin(ka[n:], ka[:n])
            at, who = np.nonzero(link | inside)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grp[n:][who]), pa.array(ka[n:][who]), pa.array(np.array(k[:n], np.int32)[at]), pa.array(ka[:n][at]), pa.array(d[at, who]), pa.array(link[at, who]), pa.array(inside[at, who])],
                ["grp", "ka", "k", "p", "d", "link", "inside"],
            )


def _split_once(rows: DataFrame, level: int, group: int, parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level of pivots over large groups (grp, ka, m: how many the group has, bag): links with pivots as (a, b), the regions to join
    further, and blocks of what pivots cannot part, to be joined within a task. A row knows its group's size, so that a row's set is
    moved twice only: to its piece, and to its regions."""
    pieces = F.ceil(F.col("m") / group).cast("long")
    # Candidates for pivots: so many of each group on average. A group without one, if that should happen, is compared in blocks.
    drawn = F.pmod(F.xxhash64("ka", F.lit(level)), F.greatest(F.floor(F.col("m") / CANDIDATES), F.lit(1))) == 0
    some = rows.where(drawn).select("grp", "ka", "m", "bag")
    pivots = some.repartition(parts, "grp").sortWithinPartitions("grp", "ka").mapInArrow(tidy(_pick), "grp long, k int, ka long, m long, bag binary").checkpoint()
    members = rows.select("grp", F.pmod(F.xxhash64("ka", F.lit("piece")), pieces).alias("i"), F.lit(None).cast("int").alias("k"), "ka", "bag")
    with_all = pivots.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("i"), "k", "ka", "bag")
    dealt = members.union(with_all).select(F.xxhash64("grp", "i").alias("piece"), "grp", "k", "ka", "bag")
    dealt = dealt.repartition(parts, "piece").sortWithinPartitions("piece", F.col("k").isNull(), "k", "ka")
    measured = dealt.mapInArrow(tidy(_measure), "grp long, ka long, k int, p long, d double, link boolean, inside boolean").checkpoint()
    links = measured.where("link AND ka <> p").select(F.col("p").alias("a"), F.col("ka").alias("b"))
    outer = measured.where("inside AND NOT link").groupBy("grp", "k").agg(F.min("d").alias("least"))
    kept = _spread(measured.where("inside"), outer, ["grp", "k"]).where(F.expr(f"NOT link OR d >= least - {EPS} - 1e-9")).select("grp", "k", "ka").checkpoint()
    sizes = kept.groupBy("grp", "k").agg(F.count(F.lit(1)).alias("c"))
    whole = rows.groupBy("grp").agg(F.max("m").alias("m")).join(sizes.groupBy("grp").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("after")), "grp", "left")
    chosen = whole.join(pivots.select("grp").distinct().withColumn("_p", F.lit(True)), "grp", "left")
    told = chosen.select("grp", (F.col("_p").isNull() | (F.col("after") >= 0.5 * F.col("m") * F.col("m"))).alias("stuck"), F.greatest(F.ceil(2 * F.col("m") / group), F.lit(1)).cast("long").alias("blocks"))
    known = _spread(kept, told.where("NOT stuck").select("grp").join(sizes, "grp"), ["grp", "k"])
    further = known.select("grp", "ka", F.xxhash64("grp", "k", F.lit(level)).alias("next"), F.col("c").alias("m"), F.lit(False).alias("block"))
    # Of a group that is stuck, what a region still holds; of one without a pivot, all.
    left = kept.select("grp", "ka").distinct().union(_spread(rows.select("grp", "ka"), chosen.where("_p IS NULL").select("grp"), ["grp"]).select("grp", "ka"))
    i, j = F.pmod(F.xxhash64("ka", F.lit("block")), F.col("blocks")), F.col("j")
    pairs = _spread(left, told.where("stuck").select("grp", "blocks"), ["grp"]).select("grp", "ka", i.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    block = pairs.select("grp", "ka", F.xxhash64("grp", F.least("i", j), F.greatest("i", j), F.lit(level), F.lit("block")).alias("next"), F.lit(0).cast("long").alias("m"), F.lit(True).alias("block"))
    placed = further.union(block).join(rows.select("grp", "ka", "bag"), ["grp", "ka"]).select(F.col("next").alias("grp"), "ka", "m", "bag", "block").checkpoint()
    return links, placed.where("NOT block").drop("block"), placed.where("block").select("grp", "ka", "bag")


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", region: int = REGION, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs."""
    rows = _components_of(docs, doc_id, text, region, group)
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _components_of(docs: DataFrame, doc_id: str, text: str, region: int = REGION, group: int = GROUP) -> DataFrame:
    """doc_id, th (hash of the text), n, component_id, and what names the component even where ids are null: root and own."""
    spark = shared(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    profile = _profile(texts).checkpoint()
    rows = profile.where("n IS NOT NULL").select("doc_id", "th", "ka", "kb", "n", "sketch")
    often = profile.where("s IS NOT NULL").groupBy("s").agg(F.sum("c").alias("c"))
    many = max(64, int(rows.count() * FREQUENT))
    hot = np.sort(np.array([r["s"] for r in often.where(F.col("c") >= many).select("s").collect()], np.int64).view(np.uint64))
    # One row for each different set; its key's first half names it in what follows, the second half tells twins apart.
    classes = rows.where("n > 0").groupBy("ka", "kb").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    regions = _regions(_memberships(texts.select("text"), hot, BUCKETS * parts), parts).checkpoint()
    forget_shuffles(spark)
    short = F.col("ka").bitwiseAND(F.lit(SHORT)).alias("short")
    edges = _candidate_edges(regions.where(F.col("size") <= region).select("region", "short"), classes.select(short, "ka", "n", "sketch"), parts)
    large = regions.where(F.col("size") > region).join(classes.select(short, "ka"), "short").select("region", "ka")
    least = large.groupBy("region").agg(F.min("ka").alias("a"))
    groups = components(edges.union(_spread(large, least, ["region"]).where("a <> ka").select("a", F.col("ka").alias("b"))))
    # The sets of what has a candidate, each once, with the size of its group if that is large.
    sized = groups.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    large = sized.where(F.col("m") > group).checkpoint()
    told = _spread(groups.withColumnRenamed("node", "ka"), large, ["root"], "left").select("ka", "root", F.coalesce("m", F.lit(0)).alias("m"))
    wanted = classes.join(told, "ka").select("one.doc_id", "one.th", "ka", F.col("root").alias("grp"), "m")
    joined = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["th"] == wanted["th"])).select("grp", "ka", "m", "text")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("grp", "ka", "m")), pa.array(made, pa.binary())], ["grp", "ka", "m", "bag"])

    sets = joined.mapInArrow(tidy(bags, _words.clear), "grp long, ka long, m long, bag binary").dropDuplicates(["grp", "ka", "bag"])
    links: list[DataFrame] = []
    if not large.isEmpty():
        sets = sets.checkpoint()
        forget_shuffles(spark)  # the texts' shuffle goes
        todo, level, small = sets.where(F.col("m") > group), 0, [sets.where(F.col("m") <= group).select("grp", "ka", "bag")]
        while True:
            found, further, blocks = _split_once(todo, level, group, parts)
            links.append(found)
            small += [blocks, further.where(F.col("m") <= group).select("grp", "ka", "bag")]
            todo, level = further.where(F.col("m") > group), level + 1
            del found, further, blocks
            forget_shuffles(spark)
            if todo.isEmpty():
                break
        sets = small[0]
        for s in small[1:]:
            sets = sets.unionByName(s)
    all_links = _join_groups(sets, parts)
    for found in links:
        all_links = all_links.union(found)
    roots = components(all_links)
    linked = classes.join(roots, F.col("ka") == F.col("node"), "left").select("ka", "kb", "least", F.coalesce("root", "ka").alias("root"), F.when(F.col("root").isNull(), F.col("kb")).alias("own"))
    # A component's name is its least id; a set without links is a component of its own.
    names = linked.where("own IS NULL").groupBy("root").agg(F.min("least").alias("name"))
    named = linked.join(names, "root", "left").select("ka", "kb", "root", "own", F.when(F.col("own").isNull(), F.col("name")).otherwise(F.col("least")).alias("component_id"))
    out = rows.select("doc_id", "th", "ka", "kb", "n").join(named, ["ka", "kb"], "left")
    return out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).drop("ka", "kb")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked documents: that of the least id (of equal ids, the least hash of the text).
    Texts without words are linked with nothing and stay; rows equal in id and text stay once."""
    name = free_name(docs.columns, "_key")
    key = lambda d, th: F.md5(F.concat_ws(":", F.coalesce(d.cast("string"), F.lit("-")), th.cast("string"))).alias(name)
    found = _components_of(docs, "doc_id", "text")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")
    first = found.where("n > 0").groupBy("root", "own").agg(F.min(order).alias("x")).select("x.doc_id", "x.th")
    stay = first.union(found.where("n = 0").select("doc_id", "th")).select(key(F.col("doc_id"), F.col("th"))).distinct()
    keyed = docs.select("*", key(F.col("doc_id"), F.xxhash64("text")))
    return keyed.join(stay, name, "left_semi").dropDuplicates([name]).drop(name)
