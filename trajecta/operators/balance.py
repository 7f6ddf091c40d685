"""Length-balanced partitioning and batch shaping.

Only (id, workload) pairs enter a partitioner; payload rows join the result afterwards.  The caller names the
rule and gets it at every size: largest differencing and the greedy rule are sequential by nature, so the
pairs of one step meet in one task; `serpentine` deals over an exact two-level rank, which needs no task to
hold a step.  All of them fill every partition and, if asked for, give equal sizes, or raise.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .grouping import PACKED, changes, join_group_table, map_groups, with_group_stats, with_prefix_sum, with_rank


def workload(length: Column) -> Column:
    return length * 24576 + length * length


# --- partitioners ---------------------------------------------------------------------------------------------


# A set is one number, ordered like (load, size, first item): 64 bits hold size and first item, the load stands above.
# No two sets share an item, so the first item settles every tie; an empty set is zero.
ITEM, LOAD = 32, 64
ITEMS = (1 << ITEM) - 1


class _Chains:
    """The items of each set, linked in order: joining two sets moves no item."""

    def __init__(self, n: int):
        self.last, self.following = array("q", range(n)), array("q", bytes(8 * n))

    def join(self, x: int, y: int) -> int:
        if not x or not y:
            return x or y
        head, other = x & ITEMS, y & ITEMS
        self.following[self.last[head]] = other
        self.last[head] = self.last[other]
        return x + (y >> ITEM << ITEM)

    def items(self, x: int) -> Iterator[int]:
        item, end = x & ITEMS, self.last[x & ITEMS]
        while item != end:
            yield item
            item = self.following[item]
        yield end


class _Sets(list):
    """Sets in rising order; splits that tie otherwise keep their places in the heap."""

    def __lt__(self, other: list) -> bool:
        return False


def _split(sets: list[int], k: int) -> tuple[int, int, list[int]]:
    """A heap entry of k sets in rising order, of which the empty ones may be left out.

    Widest spread leaves the heap first, on a tie the split with the larger heaviest set.
    """
    lightest = sets[0] >> LOAD if len(sets) == k else 0
    return lightest - (sets[-1] >> LOAD), -sets[-1], _Sets(sets)


def _merged(a: list[int], b: list[int], k: int, join: Callable[[int, int], int]) -> list[int]:
    """Heavy sets of `b` onto light ones of `a`; only sets that meet are made anew."""
    meet = max(0, len(a) + len(b) - k)
    fresh = [join(x, y) for x, y in zip(a[:meet], reversed(b[:meet]))]
    del a[:meet], b[:meet]
    if len(a) < len(b):
        a, b = b, a
    fresh += b
    if len(fresh) > 8:
        a += fresh
        a.sort()
    else:
        for x in fresh:
            insort(a, x)
    return a


def _differencing_parts(work: np.ndarray, k: int, equal: bool) -> np.ndarray:
    """Largest differencing: keep merging the two splits of widest spread, heavy sets onto light ones.

    Items that start alone leave in falling order of work, so they wait in an array and become a split when due.
    """
    n = len(work)
    if _fits_arrays(work, k, equal):
        return _wide_differencing_parts(work, k, equal)
    rising = np.argsort(work, kind="stable")
    chains = _Chains(n)

    def single(i: int) -> int:
        return (int(work[i]) << LOAD) + (1 << ITEM) + int(i)

    heap, waiting = [], -1
    if equal or work[rising[0]] < 0:
        step = k if equal else 1
        for at in range(0, n, step):
            seed = [single(i) for i in rising[at : at + step]]
            heap.append(_split(sorted(seed + [0] * (k - len(seed))), k))
        heapq.heapify(heap)
    else:
        waiting = n - 1
    alone = _split([single(rising[waiting])], k) if waiting >= 0 else None

    def widest() -> tuple[int, int, list[int]]:
        nonlocal alone, waiting
        if alone is None or (heap and heap[0] < alone):
            return heapq.heappop(heap)
        found, waiting = alone, waiting - 1
        alone = _split([single(rising[waiting])], k) if waiting >= 0 else None
        return found

    while len(heap) + waiting + 1 > 1:
        a, b = widest()[2], widest()[2]
        heapq.heappush(heap, _split(_merged(a, b, k, chains.join), k))
    part = np.zeros(n, dtype="int32")
    for p, members in enumerate(reversed(widest()[2])):
        if members:
            for i in chains.items(members):
                part[i] = p
    return part


WIDE = 32  # from so many sets on, the sets of a split are joined and put in order as arrays
FEW = 8  # a split takes in one by one what is fewer than one item for each so many of its sets
TAG, SINGLE = (1 << LOAD) - 1, 1 << ITEM


def _fits_arrays(work: np.ndarray, k: int, equal: bool) -> bool:
    if k < WIDE or len(work) < k or (equal and len(work) % k):
        return False
    return work.dtype.kind == "i" and work.min() >= 0 and work.sum(dtype="float64") < 1 << 62


class _WideSplit:
    """k sets: arrays of loads and of (size, first item) in rising order, or a heap of the same numbers in one."""

    __slots__ = ("load", "tag", "sets", "heaviest")

    def __init__(self, load: np.ndarray, tag: np.ndarray):
        order = np.lexsort((tag, load))
        self.load, self.tag, self.sets = load[order], tag[order], None
        self.heaviest = (int(self.load[-1]) << LOAD) + int(self.tag[-1])

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if self.sets is not None:
            self.sets.sort()
            self.load = np.fromiter((x >> LOAD for x in self.sets), "int64", len(self.sets))
            self.tag = np.fromiter((x & TAG for x in self.sets), "int64", len(self.sets))
            self.sets = None
        return self.load, self.tag

    def heap(self) -> list[int]:
        if self.sets is None:
            self.sets = [(x << LOAD) + y for x, y in zip(self.load.tolist(), self.tag.tolist())]
            self.load = self.tag = None
        return self.sets

    def entry(self) -> tuple[int, int, _WideSplit]:
        """Ordered like `_split`; no two splits share a heaviest set."""
        lightest = int(self.load[0]) if self.sets is None else self.sets[0] >> LOAD
        return lightest - (self.heaviest >> LOAD), -self.heaviest, self


def _wide_differencing_parts(work: np.ndarray, k: int, equal: bool) -> np.ndarray:
    """The same merges in the same order, where a merge costs no more than the sets that meet in it.

    A split with empty sets is a run of single items that follow each other in rising order: it leaves before all
    items that still wait, until it is full or meets a full one.  So only full splits and the ends of one run are kept.
    """
    n = len(work)
    rising = np.argsort(work, kind="stable")
    by_work = work[rising].astype("int64", copy=False)
    head = np.arange(n)
    weight, item, head_of = memoryview(by_work), memoryview(rising), memoryview(head)
    heap: list[tuple[int, int, _WideSplit]] = []

    def keep(split: _WideSplit) -> None:
        heapq.heappush(heap, split.entry())

    def widest() -> _WideSplit:
        return heapq.heappop(heap)[2]

    def joined(load, tag, other_load, other_tag):
        head[other_tag & ITEMS] = tag & ITEMS
        return load + other_load, tag + (other_tag >> ITEM << ITEM)

    def merged(a: _WideSplit, b: _WideSplit) -> _WideSplit:
        load, tag = b.arrays()
        return _WideSplit(*joined(*a.arrays(), load[::-1], tag[::-1]))

    def with_run(split: _WideSplit, lo: int, hi: int, run_first: bool) -> _WideSplit:
        m = hi - lo
        if m * FEW >= k:
            load, tag = split.arrays()
            light, run = (load[:m], tag[:m]), (by_work[lo:hi][::-1], rising[lo:hi][::-1] + SINGLE)
            x, y = joined(*run, *light) if run_first else joined(*light, *run)
            return _WideSplit(np.concatenate([x, load[m:]]), np.concatenate([y, tag[m:]]))
        sets = split.heap()
        light = [sets[0]] if m == 1 else [heapq.heappop(sets) for _ in range(m)]
        for at, x in zip(range(hi - 1, lo - 1, -1), light):
            i, added = item[at], (weight[at] << LOAD) + SINGLE
            if run_first:
                head_of[x & ITEMS] = i
                x = (x >> ITEM << ITEM) + added + i
            else:
                head_of[i] = x & ITEMS
                x += added
            if m == 1:
                heapq.heapreplace(sets, x)
            else:
                heapq.heappush(sets, x)
            split.heaviest = max(split.heaviest, x)
        return split

    def full(lo: int, hi: int) -> _WideSplit:
        return _WideSplit(by_work[lo:hi], rising[lo:hi] + SINGLE)

    def single(at: int) -> tuple[int, int]:
        return -weight[at], -((weight[at] << LOAD) + SINGLE + item[at])

    lo = hi = 0 if equal else n  # the run of items; those before it wait
    for at in range(0, n, k) if equal else ():
        keep(full(at, at + k))
    while hi or len(heap) > 1:
        if not hi:
            keep(merged(widest(), widest()))
            continue
        lo = min(lo, hi - 1)
        run = single(hi - 1)
        if hi - lo == k:
            keep(full(lo, hi))
        elif heap and heap[0] < run:
            split = widest()
            if heap and heap[0] < run:
                keep(merged(split, widest()))
                continue
            keep(with_run(split, lo, hi, run_first=False))
        elif lo and (not heap or single(lo - 1) < heap[0]):
            first = max(0, hi - k)
            lo = min(lo - 1, bisect_right(weight, -heap[0][0], first, lo)) if heap else first
            continue
        else:
            keep(with_run(widest(), lo, hi, run_first=True))
        hi = lo
    part = np.zeros(n, dtype="int32")
    part[widest().arrays()[1][::-1] & ITEMS] = np.arange(k, dtype="int32")
    while not np.array_equal(above := head[head], head):
        head = above
    return part[head]


def _least_loaded_parts(work: np.ndarray, k: int, equal: bool) -> np.ndarray:
    """Input order, each item to the lightest set; a bias above the total enforces equal sizes."""
    bias = sum(int(work[at : at + 4096].sum()) for at in range(0, len(work), 4096)) + 1 if equal else 0
    part = np.zeros(len(work), dtype="int32")
    loads = [(0, p) for p in range(k)]
    for at in range(0, len(work), 4096):
        for i, w in enumerate(work[at : at + 4096].tolist(), at):
            load, p = loads[0]
            part[i] = p
            heapq.heapreplace(loads, (load + w + bias, p))
    return part


PARTS = {"differencing": _differencing_parts, "greedy": _least_loaded_parts}


def _members(algorithm: str, work: list[int], k: int, equal: bool) -> list[list[int]]:
    parts: list[list[int]] = [[] for _ in range(k)]
    for i, p in enumerate(PARTS[algorithm](np.array(work), k, equal).tolist()):
        parts[p].append(i)
    return parts


_differencing = partial(_members, "differencing")
_least_loaded = partial(_members, "greedy")
ALGORITHMS = {"differencing": _differencing, "greedy": _least_loaded}


def _whole(column: pa.Array) -> np.ndarray:
    found = column.to_numpy(zero_copy_only=False)
    return found if found.dtype.kind == "i" else np.array([int(w) for w in found])


def _partition_step(algorithm: str, equal: bool, keys: list[str], number: Callable | None = None):
    place, names = PARTS[algorithm], [*keys, "item_id"]

    def run(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = np.concatenate([_whole(piece.column("work")) for piece in pieces])
        k = int(pieces[0].column("k")[0].as_py())
        if len(work) < k:
            raise ValueError(f"{len(work)} items cannot fill {k} partitions")
        if equal and len(work) % k:
            raise ValueError(f"{len(work)} items do not divide into {k} equal partitions")
        if len(pieces) > 1:
            # Only what is returned stays; the batches as they came hold the other columns too.
            pieces[:] = pa.Table.from_batches(pieces).select(names).combine_chunks().to_batches(PACKED)
        found, at = place(work, k, equal), 0
        if number:
            part = number(found, work, pa.chunked_array([piece.column("item_id") for piece in pieces]), k)
        else:
            part = pa.array(found)
        for piece in pieces:
            columns = [piece.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, part.slice(at, piece.num_rows)], [*names, "part"])
            at += piece.num_rows

    return run


def _smallest_at_ends(part: np.ndarray, work: np.ndarray, ids: pa.ChunkedArray, k: int) -> pa.Array:
    """The numbers `_placed_at_ends` gives to the partitions of one step, whose rows come in the order of their ids."""
    known = np.flatnonzero(ids.is_valid().to_numpy())
    starts = np.concatenate([[True], changes(ids).to_numpy()])
    same = np.cumsum(starts)[known] - 1
    if work.dtype.kind == "i" and work.sum(dtype="float64") * (len(work) - starts.sum() + 1) >= 1 << 62:
        work = work.astype(object)
    # A row counts with the work of all rows of its id.
    load, head = np.zeros(k, work.dtype), np.full(k, -1)
    np.add.at(load, part[known], np.add.reduceat(work, np.flatnonzero(starts))[same])
    head[part[known[::-1]]] = same[::-1]
    used = np.flatnonzero(head >= 0)
    heavy = sorted(used.tolist(), key=lambda p: (load[p], head[p]), reverse=True)
    r, evens = np.arange(len(used)), (len(used) + 1) // 2
    position = np.full(k, -1, dtype="int32")
    position[heavy] = np.where(r % 2 == 0, evens - 1 - r // 2, evens + r // 2)
    found = position[part]
    return pa.array(found, mask=found < 0)


def serpentine(items: DataFrame, keys: list[str], equal: bool = False) -> DataFrame:
    """Deal items of falling workload back and forth over `k` partitions."""
    sizes = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    items = join_group_table(items, sizes, keys, "item_id")
    bucket = F.struct(-F.col("work"), F.floor(F.col("item_id") / 65536))
    ranked = with_rank(items, bucket, [F.col("work").desc(), F.col("item_id")], "__r", keys)
    turn, seat = F.floor(F.col("__r") / F.col("k")), F.col("__r") % F.col("k")
    part = F.when(turn % 2 == 0, seat).otherwise(F.col("k") - 1 - seat)
    part = F.when(F.col("__n") < F.col("k"), _raised("items cannot fill the partitions")).otherwise(part)
    if equal:
        part = F.when(F.col("__n") % F.col("k") != 0, _raised("items do not divide into equal partitions")).otherwise(part)
    return ranked.select(*keys, "item_id", part.cast("int").alias("part"))


def _raised(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("long")


def balanced_partitions(
    items: DataFrame, keys: list[str], algorithm: str = "differencing", equal: bool = True, number: Callable | None = None
) -> DataFrame:
    """(keys, item_id, part) from (keys, item_id, work, k) by the named rule; raises if a partition would stay empty.

    `number` gives the partitions of a step other numbers where the rule has the step in one task.
    """
    if algorithm == "serpentine":
        return serpentine(items, keys, equal)
    schema = ", ".join(f"{n} {t}" for n, t in items.select(*keys, "item_id").dtypes) + ", part int"
    rows = items.select(*keys, "item_id", "work", "k")
    order = [F.col("item_id").asc_nulls_last(), F.col("work")]
    return map_groups(rows, keys, order, _partition_step(algorithm, equal, keys, number), schema)


def imbalance_report(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Token totals per consecutive block and per partition; input has row_idx, length, part."""
    rows = with_group_stats(df, keys, "row_idx", sums={"__n": F.lit(1)})
    block = F.floor(F.col("row_idx") / F.greatest(F.floor(F.col("__n") / k), F.lit(1)))
    before = rows.groupBy(*keys, block.alias("b")).agg(F.sum("length").alias("s")).groupBy(*keys).agg(
        F.min("s").alias("min"), F.max("s").alias("max"), F.sum("s").alias("total")
    )
    after = df.groupBy(*keys, "part").agg(F.sum("length").alias("s")).groupBy(*keys).agg(
        F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max")
    )
    return before.join(after, keys).select(
        *keys,
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("minmax_diff"),
        "balanced_min",
        "balanced_max",
        (F.col("total") / k).alias("mean"),
    )


def micro_batch_counts(df: DataFrame, keys: list[str], budget: int, multiple: int = 1, minimum: int = 1) -> DataFrame:
    """How many micro-batches a step needs so that none has to exceed the token budget on average."""
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("length").alias("tokens"), F.max("length").alias("longest")
    )
    n = F.greatest(F.lit(minimum), F.least(F.col("rows"), F.ceil(F.col("tokens") / F.lit(budget))))
    n = F.ceil(n / multiple) * multiple
    checked = (
        F.when(F.col("longest") > budget, F.raise_error(F.lit("budget below the longest sequence")).cast("long"))
        .when(n > F.col("rows"), F.raise_error(F.lit("more micro-batches than rows")).cast("long"))
        .otherwise(n)
    )
    return agg.select(*keys, checked.alias("k"))


def micro_batches(
    df: DataFrame, keys: list[str], budget: int, multiple: int = 1, minimum: int = 1, algorithm: str = "differencing"
) -> DataFrame:
    """(keys, row_idx, micro_batch): balanced, the smallest at both ends and the largest in the middle.

    The rows are staged, as they are read twice, and so are the counts, whose size the optimiser then knows.
    """
    rows = staged(df.select(*keys, "row_idx", "length"))
    counts = staged(micro_batch_counts(rows, keys, budget, multiple, minimum))
    whole = algorithm in PARTS  # a step meets in one task, so there is no use in spreading it before
    items = (rows.join(counts, keys, "left") if whole else join_group_table(rows, counts, keys, "row_idx")).select(
        *keys, F.col("row_idx").alias("item_id"), workload(F.col("length")).alias("work"), "k"
    )
    if whole:
        parts = balanced_partitions(items, keys, algorithm, equal=False, number=_smallest_at_ends)
        return parts.select(*keys, F.col("item_id").alias("row_idx"), F.col("part").alias("micro_batch"))
    return _placed_at_ends(balanced_partitions(items, keys, algorithm, equal=False), items, keys)


def _placed_at_ends(parts: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    loads = (
        parts.join(items, [*keys, "item_id"])
        .groupBy(*keys, "part")
        .agg(F.sum("work").alias("load"), F.min("item_id").alias("head"))
    )
    heavy = Window.partitionBy(*keys).orderBy(F.col("load").desc(), F.col("head").desc())
    placed = loads.withColumn("r", F.row_number().over(heavy) - 1).withColumn(
        "m", F.count(F.lit(1)).over(Window.partitionBy(*keys))
    )
    evens = F.floor((F.col("m") + 1) / 2)
    position = F.when(F.col("r") % 2 == 0, evens - 1 - F.col("r") / 2).otherwise(evens + (F.col("r") - 1) / 2)
    placed = placed.select(*keys, "part", position.cast("int").alias("micro_batch"))
    return join_group_table(parts, placed, [*keys, "part"], "item_id").select(
        *keys, F.col("item_id").alias("row_idx"), "micro_batch"
    )


def group_partitions(
    df: DataFrame, keys: list[str], uid: str, k: int, algorithm: str = "differencing", equal: bool = True
) -> DataFrame:
    """(keys, uid, part): every prompt whole in one partition, the same number of prompts in each.

    Fewer than k prompts, or with `equal` a number that k does not divide, is an error.
    """
    groups = df.groupBy(*keys, uid).agg(F.sum(workload(F.col("length"))).alias("work"))
    items = groups.select(*keys, F.col(uid).alias("item_id"), "work", F.lit(k).alias("k"))
    parts = balanced_partitions(items, keys, algorithm, equal)
    return parts.withColumnRenamed("item_id", uid)


def balance_step(
    df: DataFrame,
    keys: list[str],
    k: int,
    mini_batch: int | None = None,
    algorithm: str = "differencing",
    equal: bool = True,
) -> DataFrame:
    """(keys, row_idx, part, new_idx): rows of a step laid out partition after partition.

    With `mini_batch`, each mini-batch is balanced on its own.  Inside a partition rows go small, large,
    small by workload.
    """
    cut = [*keys, "__mb"]
    rows = df.withColumn("__mb", F.floor(F.col("row_idx") / mini_batch) if mini_batch else F.lit(0))
    items = rows.select(
        *cut, F.col("row_idx").alias("item_id"), workload(F.col("length")).alias("work"), F.lit(k).alias("k")
    )
    parts = balanced_partitions(items, cut, algorithm, equal).join(items, [*cut, "item_id"])
    bucket = F.struct(F.col("work"), F.floor(F.col("item_id") / 65536))
    in_part = [*keys, "part"]
    parts = with_rank(parts, bucket, [F.col("work"), F.col("item_id")], "r", in_part)
    sizes = parts.groupBy(*in_part).agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("offset", F.coalesce(F.sum("m").over(before), F.lit(0)))
    parts = join_group_table(parts, sizes, in_part, "item_id")
    place = F.when(F.col("r") % 2 == 0, F.col("r") / 2).otherwise(F.col("m") - 1 - (F.col("r") - 1) / 2)
    return parts.select(
        *keys, F.col("item_id").alias("row_idx"), "part", (F.col("offset") + place).cast("long").alias("new_idx")
    )


def restore_order(df: DataFrame, key: str = "row_idx") -> DataFrame:
    return df.orderBy(key)


# --- shared prefixes --------------------------------------------------------------------------------------------


def runs_of_equal(df: DataFrame, key: str, order: str = "row_idx") -> DataFrame:
    """Adds `run_id`: consecutive rows with equal `key` share one, counted over the exact row order.

    A row starts a run when its predecessor (found by rank, not by a global window) differs; run numbers
    are a two-level prefix sum of those starts.
    """
    previous = df.select((F.col(order) + 1).alias(order), F.col(key).alias("__prev"), F.lit(True).alias("__has"))
    rows = df.join(previous, order, "left")
    starts = F.when(F.col("__has").isNull() | ~F.col(key).eqNullSafe(F.col("__prev")), 1).otherwise(0).cast("long")
    rows = rows.withColumn("__start", starts)
    out = with_prefix_sum(rows, F.floor(F.col(order) / 65536), [F.col(order)], F.col("__start"), "__before")
    return out.withColumn("run_id", F.col("__before") + F.col("__start") - 1).drop("__prev", "__has", "__start", "__before")


def shared_prefix_positions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Where each response lies behind its shared prompt; input (keys, sample_id, prefix_len, suffix_len).

    Adds `suffix_start` in the packed sequence and `position_ids`, which restart at the prefix length.
    """
    bucket = F.floor(F.col("sample_id") / 65536)
    rows = with_prefix_sum(df, bucket, [F.col("sample_id")], F.col("suffix_len"), "__before", keys)
    first, last = F.col("prefix_len"), F.col("prefix_len") + F.col("suffix_len") - 1
    ids = F.when(F.col("suffix_len") > 0, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("suffix_start", F.col("prefix_len") + F.col("__before")).withColumn("position_ids", ids).drop("__before")


def pack_shared_prefix(df: DataFrame, keys: list[str], responses: list[str]) -> DataFrame:
    """One row per key: the prompt once, then all of its responses in order.

    The keys name the micro-batch and the prompt.  A packed row is one model input, so its size is bounded by
    the token budget of the micro-batch.
    """
    items = F.sort_array(F.collect_list(F.struct("sample_id", *responses)))
    out = df.groupBy(*keys).agg(F.first("prompt_len").alias("prefix_len"), items.alias("__i"))
    return out.select(*keys, "prefix_len", *[F.col("__i").getField(c).alias(c) for c in ["sample_id", *responses]])
