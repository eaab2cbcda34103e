"""Operator 4: minimax contiguous sharding.

Documents of equal text are one atomic group. Groups are ordered by a fixed key (very large ones
first, then by digest); the capacity is the smallest one for which cutting this order greedily
needs no more than the given shards, found by binary search.

The driver never sees all groups. It gets the sizes of at most 16 ** DIGITS blocks (groups whose
digests share a prefix) and of the at most HEAVY groups that exceed a HEAVY-th of all bytes. The
capacity lies between that of blocks that could be cut anywhere and that of blocks that can't be
cut, which differ by the largest block at most. The blocks that a cut of any capacity between the two
can fall into are divided by longer prefixes, then both bounds are found again, and so on, until only
groups are left there: each time the bounds come closer and fewer blocks remain. A division brings
at most MOST_BLOCKS sums, or 16 for each block if that is more, and is one job over the groups. The
search itself then runs on the driver, and is exact.
DataFrame functions only.

Defined results: a null text counts as an empty one (size 1, checksum 0); repeated rows are rows
of their group; an empty table gives an empty result; with fewer groups than shards, the rest stay
empty.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densityflow.llm.common import cut, gapless, tidy

HEAVY = 4096
#: Groups of a first block, at most about, unless DIGITS is reached.
PER_BLOCK = 256
#: Hex digits of the first blocks, at most.
DIGITS = 4
#: Sums that a division brings to the driver.
MOST_BLOCKS = 1 << 19
#: A key is a digit, 0 for heavy groups and 1 for others, and a digest or its beginning.
WHOLE = 33


def least(feasible, low: int, high: int) -> int:
    """The smallest number from low to high that is feasible; high is."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


class Order:
    """Heavy groups, then light ones or blocks of them, in order, with where they end."""

    def __init__(self, groups: DataFrame):
        n, total, largest = groups.agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
        self.n, self.total, self.largest = n or 0, total or 0, largest or 0
        self.heavy: list[str] = []
        self.atoms: list[tuple[str, int, int]] = []  # key, size, number of groups
        if self.n:
            big = F.col("size") * HEAVY >= F.lit(self.total)
            if self.largest * HEAVY >= self.total:
                self.atoms = sorted(("0" + r.gid, r["size"], 1) for r in groups.where(big).select("gid", "size").toLocalIterator())
                self.heavy = [k[1:] for k, _, _ in self.atoms]
            self.light = groups.where(~big)
            digits = ([d for d in range(1, 33) if 16 ** (d - 1) * PER_BLOCK < self.n][-1:] or [1])[0]
            self.atoms += self._sums(self.light, 1 + min(DIGITS, digits))
        self._end()

    def _end(self) -> None:
        self.keys = [k for k, _, _ in self.atoms]
        self.ends = list(accumulate(s for _, s, _ in self.atoms))

    def _sums(self, rows: DataFrame, length: int) -> list[tuple[str, int, int]]:
        """Keys of this length in order, with sizes and numbers of groups."""
        block = F.substring("gid", 1, length - 1).alias("block")
        return sorted(("1" + r[0], r[1], r[2]) for r in rows.groupBy(block).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect())

    def divide(self, blocks: list[str]) -> None:
        """Puts what stands in these blocks in their places."""
        numbers = {k: n for k, _, n in self.atoms}
        inside: dict[str, list[tuple[str, int, int]]] = {b: [] for b in blocks}
        for length in sorted({len(b) for b in blocks}):
            own = [b for b in blocks if len(b) == length]
            to = length + 1
            while to < WHOLE and 16 ** (to + 1 - length) * len(own) <= MOST_BLOCKS:
                to += 1
            if sum(numbers[b] for b in own) <= max(MOST_BLOCKS, 16 * len(own)):
                to = WHOLE
            pick = self.light.sparkSession.createDataFrame([(b[1:],) for b in own], "pick string")  # no more than there are first blocks
            rows = self.light.join(F.broadcast(pick), F.substring("gid", 1, length - 1) == F.col("pick"), "left_semi")
            for atom in self._sums(rows, to):
                inside[atom[0][:length]].append(atom)
        self.atoms = [x for atom in self.atoms for x in (inside.get(atom[0]) or [atom])]
        self._end()

    def next(self, at: int, capacity: int, slack: bool) -> int:
        """Where a shard that begins at `at` ends, if blocks can't be cut or (slack) can be cut anywhere."""
        k = bisect.bisect_right(self.ends, at + capacity)
        if k == len(self.ends):
            return self.total
        if slack and len(self.keys[k]) < WHOLE:
            return at + capacity
        return self.ends[k - 1] if k else 0

    def cuts(self, capacity: int, shards: int, slack: bool = False) -> list[int] | None:
        """Ends of all shards but the last, if blocks can't be cut, or (slack) can be cut anywhere; None if shards
        don't suffice."""
        at, found = 0, []
        for _ in range(shards):
            end = self.next(at, capacity, slack)
            if end == self.total:
                return found
            if end <= at:
                return None
            at = end
            found.append(at)
        return None


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str], list[str]]:
    """groups: (gid string, size long). The capacity, the key at which each further shard
    begins, and the heavy groups' gids; keys are '0' + gid for these and '1' + gid for others."""
    order = Order(groups)
    if not order.n:
        return 0, [], []
    low, high = max(-(-order.total // shards), order.largest), order.total
    while True:
        low = least(lambda c: order.cuts(c, shards, True) is not None, low, high)
        high = least(lambda c: order.cuts(c, shards) is not None, low, high)
        # the cuts of all capacities between lie between where these two can reach
        near = far = 0
        wanted: list[str] = []
        for _ in range(shards):
            near, far = order.next(near, low, False), order.next(far, high, True)
            wanted += order.keys[bisect.bisect_left(order.ends, near) : bisect.bisect_left(order.ends, far) + 1]
        wanted = [k for k in dict.fromkeys(wanted) if len(k) < WHOLE]
        if not wanted:
            break
        order.divide(wanted)
    capacity = least(lambda c: order.cuts(c, shards) is not None, low, high)
    return capacity, [order.keys[bisect.bisect_right(order.ends, end)] for end in order.cuts(capacity, shards) or []], order.heavy


@tidy
def shard_by_bytes(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity), a row for each of docs."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.md5(body.cast("binary")).alias("gid"),
            F.spark_partition_id().alias("chunk"),
        )
    )
    groups = cut(rows.groupBy("gid").agg(F.sum("size").alias("size")))
    capacity, starts, heavy = minimax_cuts(groups, shards)
    marked = rows.withColumn("heavy", F.lit(False))
    if heavy:
        large = rows.sparkSession.createDataFrame([(g,) for g in heavy], "gid string").withColumn("large", F.lit(True))
        marked = rows.join(F.broadcast(large), "gid", "left").withColumn("heavy", F.coalesce("large", F.lit(False)))  # at most HEAVY rows
    key = F.concat(F.when(F.col("heavy"), "0").otherwise("1"), F.col("gid"))
    shard = F.lit(0)
    for k in starts:
        shard = shard + (key >= F.lit(k)).cast("int")
    placed = gapless(marked.withColumn("shard", shard.cast("int")), "shard", "chunk", ["doc_id", "gid"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"))
