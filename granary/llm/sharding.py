"""Sharding by best-fit-decreasing bin packing: equal sizes, with equal texts together.

Law `bytes`: the shards' sizes are nearly equal. A group is all rows of one text, and stays together unless it is larger than a
shard's fair share, which no shard could hold evenly; then the hash of its rows cuts it into quarters of a share. Groups, sorted by
size, each enter the bin with the tightest remaining capacity that holds them, found in a balanced tree (a treap) of remaining
capacities; the capacity is the least of a few tried at which all of them fit, so that the fixed number of shards is filled to a
minimal height.

Groups of one size are packed in one step: as many as fit enter the tightest bin, which is what best fit does with them one by one.
So the driver holds sizes and their counts, not groups. Sizes are exact up to 2 ** BITS bytes and rounded up to BITS leading bits
beyond, so that there are at most 2 ** (BITS - 1) of them for each doubling, however many groups there are. Groups of a size are
numbered by a window, sizes that many groups have in parts by hash, and their number tells the bin. Slots are numbered in cells
of a shard, by hash of rows.

Cases: a null text has no bytes and counts as equal to an empty one; a size is never zero, as 16 is added; ties go by key, rows
that repeat get slots of their own (order by id, and then any); more shards than groups leaves shards empty; an empty table
gives no rows; of the input only id and text are read. Long texts are only measured and hashed.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import shared

BITS, EXTRA = 16, 16
#: Parts of a size that many groups have, cells of a shard, and the share of all rows or groups from which on there are many.
PARTS, CELLS, MANY = 64, 64, 0.001


class Tree:
    """A treap over (remaining capacity, bin), with the least entry at or over a size."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.random = random.Random(5)

    def add(self, key: tuple[int, int]) -> None:
        less, more = _split(self.root, key)
        self.root = _join(_join(less, [key, self.random.random(), None, None]), more)

    def take(self, least: int) -> tuple[int, int] | None:
        """Takes out the smallest entry whose capacity is least or more."""
        less, more = _split(self.root, (least, -1))
        if more is None:
            self.root = less
            return None
        first, rest = _pop_first(more)
        self.root = _join(less, rest)
        return first


def _split(node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
    if node is None:
        return None, None
    if node[0] < key:
        node[3], more = _split(node[3], key)
        return node, more
    less, node[2] = _split(node[2], key)
    return less, node


def _join(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return a or b
    if a[1] < b[1]:
        a[3] = _join(a[3], b)
        return a
    b[2] = _join(a, b[2])
    return b


def _pop_first(node: list) -> tuple[tuple[int, int], list | None]:
    if node[2] is None:
        return node[0], node[3]
    first, node[2] = _pop_first(node[2])
    return first, node


Runs = list[tuple[int, int]]  # (bin, how many)


def best_fit_decreasing(sizes: dict[int, int], capacity: int, most: int | None = None) -> dict[int, Runs] | None:
    """For each size, of which so many items exist, into which bins they go: best fit, largest first; None where more than `most` bins
    are needed. An item over the capacity gets a bin of its own."""
    tree, n_bins, placed = Tree(), 0, {}
    for size in sorted(sizes, reverse=True):
        left, runs = sizes[size], []
        while left:
            found = tree.take(size)
            if found is None:
                if most is not None and n_bins == most:
                    return None
                found = (max(capacity, size), n_bins)
                n_bins += 1
            n = min(left, found[0] // size)
            runs.append((found[1], n))
            left -= n
            tree.add((found[0] - n * size, found[1]))
        placed[size] = runs
    return placed


def fill_evenly(sizes: dict[int, int], shards: int) -> dict[int, Runs]:
    """Bins for a fixed number of shards: the smallest capacity at which best fit needs no more of them, by halving, to one part in 2 ** BITS."""
    total, largest = sum(s * n for s, n in sizes.items()), max(sizes, default=0)
    low = max(-(-total // shards), largest)
    close = max(1, low >> BITS)
    high, step, best = low, max(1, low // 4096), best_fit_decreasing(sizes, low, shards)
    while best is None:
        low, high, step = high, high + step, step * 2
        best = best_fit_decreasing(sizes, high, shards)
    while high - low > close:
        middle = (low + high) // 2
        if (found := best_fit_decreasing(sizes, middle, shards)) is None:
            low = middle
        else:
            best, high = found, middle
    return best


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (none for null), and EXTRA for what goes along with a row."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + EXTRA


def size_class(size: Column) -> Column:
    """A size with its first BITS bits, rounded up."""
    left, right = (lambda x, by, name=name: F.call_function(name, x, by) for name in ("shiftleft", "shiftright"))
    one = F.lit(1).cast("long")
    return left(right(size + left(one, _shift(size)) - one, _shift(size)), _shift(size))


def _shift(size: Column) -> Column:
    return F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))


def assign(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (in the shard, without gaps) and group (a hash of the text)."""
    spark = shared(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_size(F.col(text)).alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("group"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    total, n_rows = rows.agg(F.sum("size"), F.count(F.lit(1))).head()
    if not n_rows:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), "group")
    fair = max(1, total // shards)
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).checkpoint()
    # Fewer than `shards` groups are over the fair share.
    over = groups.where(F.col("bytes") > fair).select("group", F.ceil(4 * F.col("bytes") / fair).cast("int").alias("parts"))
    row_hash = F.xxhash64("doc_id", "row")
    keyed = rows.join(F.broadcast(over), "group", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(row_hash, F.col("parts"))).otherwise(0).cast("int")).drop("parts")
    cut = keyed.join(F.broadcast(over.select("group")), "group", "left_semi").groupBy("group", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    units = groups.where(F.col("bytes") <= fair).select("group", F.lit(0).alias("part"), "bytes", "n").unionByName(cut).withColumn("class", size_class(F.col("bytes"))).checkpoint()
    counts = {r["class"]: r["count"] for r in units.groupBy("class").count().collect()}  # a row for each size: bounded by BITS
    often = sorted(c for c, n in counts.items() if n > max(100, MANY * sum(counts.values())))  # fewer than 1 / MANY sizes
    many = units.select("*", F.when(F.col("class").isin(often), F.pmod(F.xxhash64("group", "part"), F.lit(PARTS))).otherwise(0).cast("int").alias("sub")) if often else units.withColumn("sub", F.lit(0))
    in_sub: dict[int, list[tuple[int, int]]] = {c: [] for c in often}
    if often:
        for r in many.where(F.col("class").isin(often)).groupBy("class", "sub").count().orderBy("class", "sub").collect():  # PARTS rows for each of them
            in_sub[r["class"]].append((r["sub"], r["count"]))
    runs = [run for size, placed in fill_evenly(counts, shards).items() for run in _dealt(size, placed, in_sub.get(size, [(0, counts[size])]))]
    table = spark.createDataFrame(pa.table(dict(zip(("class", "sub", "least", "until", "shard"), map(list, zip(*runs, strict=True)), strict=True)))).withColumn("sub", F.col("sub").cast("int")).withColumn("shard", F.col("shard").cast("int"))
    number = F.row_number().over(Window.partitionBy("class", "sub").orderBy("group", "part")) - 1
    placed = many.withColumn("k", number).join(table, ["class", "sub"]).where("k >= least AND k < until").select("group", "part", "n", "shard").checkpoint()
    # Units of many rows, fewer than 1 / MANY, are sent along; the others are joined.
    big = placed.where(F.col("n") > MANY * n_rows).select("group", "part", "shard")
    rest = keyed.join(F.broadcast(big.select("group", "part")), ["group", "part"], "left_anti").join(placed.where(F.col("n") <= MANY * n_rows).select("group", "part", "shard"), ["group", "part"])
    where = keyed.join(F.broadcast(big), ["group", "part"]).unionByName(rest).withColumn("cell", F.pmod(row_hash, F.lit(CELLS)).cast("int")).checkpoint()
    bases, at = [], {}
    for r in where.groupBy("shard", "cell").count().orderBy("shard", "cell").collect():  # shards * CELLS rows
        bases.append((r["shard"], r["cell"], at.get(r["shard"], 0)))
        at[r["shard"]] = at.get(r["shard"], 0) + r["count"]
    base = spark.createDataFrame(bases, "shard int, cell int, base long")
    n = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "row")).cast("long")
    done = where.withColumn("n", n).join(F.broadcast(base), ["shard", "cell"])
    return done.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("n") - 1).alias("slot"), "group")


def _dealt(size: int, placed: Runs, subs: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(size, sub, least, until, bin): which numbers of each part of a size go into which bin."""
    out, runs = [], [list(r) for r in placed]
    for sub, n in subs:
        at = 0
        while at < n:
            taken = min(n - at, runs[0][1])
            out.append((size, sub, at, at + taken, runs[0][0]))
            at += taken
            runs[0][1] -= taken
            if not runs[0][1]:
                runs.pop(0)
    return out


def digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `bytes`)."""
    return assign(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
