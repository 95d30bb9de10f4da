"""All pairs of similar sets, by recursive chosen-path splitting (Christiani, Pagh and Sivertsen, 2018).

Each tree starts with all records in one node. A record follows the branch of a token if a hash of the node and the
token falls below ``branching / size``: a decision that records sharing the token share too, so a similar pair stays
together on some branch while unrelated records part. Nodes small enough are compared record by record, others are
split again. Several trees bring the recall of a pair at the threshold to the target; every pair is verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import HOT_SHARE, WARM_ROWS, Crowded, block_join, hot_keys, sent_whole, skew_join
from ..session import discard, materialize, materialize_seen

#: Chosen tokens expected per record and node. With 3 a pair at a threshold of 0.6 outlives every further level with a probability of 0.74, so 7
#: trees do; fewer branches need more trees, more need more rows a level.
BRANCHING = 3.0
#: Nodes up to this size are compared record by record. A comparison takes some nanoseconds and a row of one more level some microseconds, of which there
#: would be three for each: beyond a few thousand rows the level costs less than the comparisons it saves.
NODE_ROWS = 4096
#: Levels of splitting; nodes that are still large are compared block by block. Only decides where the work is done.
MAX_DEPTH = 5
#: Sets with more tokens carry all 1,024 parity bits; below it 128 of them tell unlike sets apart.
LARGE = 64
#: Within a node up to this size pairs are formed by shifts over many nodes at once.
SHIFTED = 24
_UNIT = float(1 << 53)


def trees_for(threshold: float, recall: float, branching: float = BRANCHING, depth: int = MAX_DEPTH) -> int:
    """Trees needed so that a pair whose similarity is just ``threshold`` is found with probability ``recall``.

    The branches that such a pair shares form a branching process with at least ``branching * threshold`` children on
    average; a tree finds the pair if the process lives for ``depth`` levels (or meets a small node before).
    """
    lives, grow = 1.0, branching * threshold
    for _ in range(depth):
        lives = 1 - math.exp(-grow * lives)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - lives)))


@dataclass
class SimilarSets:
    """``links``: (a, b, common, similarity) between representatives of equal sets; ``members``: (id, rep) of all records.

    With two tables a is from the left and b from the right one, and ``members`` has a column ``side``.
    """

    links: DataFrame
    members: DataFrame
    two: bool

    def pairs(self) -> DataFrame:
        """(id_a, id_b): the links spelled out for all members; within one table id_a < id_b, equal sets included.

        A representative of many records is met block by block, so its rows never lie in one task.
        """
        m, links = materialize(self.members, "members"), self.links.select("a", "b")
        x = (m.where("side = 0") if self.two else m).select(F.col("rep").alias("a"), F.col("id").alias("x"))
        y = (m.where("side = 1") if self.two else m).select(F.col("rep").alias("b"), F.col("id").alias("y"))
        if self.two:
            across = block_join(block_join(links, x, ["a"], "x").select("b", "x"), y, ["b"], "y")
            return across.select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
        crowded = Crowded.of(x, ["a"])  # counted once for all three joins
        across = block_join(block_join(links, x, ["a"], "x", crowded=crowded).select("b", "x"), y, ["b"], "y", crowded=crowded.renamed(["b"])).select("x", "y")
        same = block_join(x, x.withColumnRenamed("x", "y"), ["a"], "y", crowded=crowded).where("x < y").select("x", "y")
        return across.unionAll(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


@F.arrow_udf(T.StructType([T.StructField("b0", T.LongType()), T.StructField("b1", T.LongType()), T.StructField("wide", T.BinaryType())]))
def _bits(hashes: pa.Array) -> pa.Array:
    """Parity bits of sets of token hashes: two sets differ in at least as many tokens as their words differ in bits.

    1,024 bits as ``wide`` for sets of more than ``LARGE`` tokens, and those folded to the 128 of ``b0`` and ``b1`` for all.
    """
    sizes = np.diff(hashes.offsets.to_numpy())
    h = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    words = np.zeros((len(sizes), 16), dtype=np.uint64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    np.bitwise_xor.at(words, (at, ((h >> np.uint64(6)) & np.uint64(15)).astype(np.intp)), np.uint64(1) << (h & np.uint64(63)))
    b0, b1 = (np.bitwise_xor.reduce(words[:, k::2], axis=1).view(np.int64) for k in (0, 1))
    wide = pa.array([w.tobytes() if n > LARGE else None for w, n in zip(words, sizes)], pa.binary())
    return pa.StructArray.from_arrays([pa.array(b0), pa.array(b1), wide], names=["b0", "b1", "wide"])


def _as_set(df: DataFrame, tokens: str) -> Column:
    """The distinct known elements of a list, in rising order."""
    kind = df.schema[tokens].dataType.elementType
    return F.sort_array(F.array_except(tokens, F.array(F.lit(None).cast(kind))))


def _branches(rows: DataFrame, branching: float) -> DataFrame:
    """The branches that each (path, record) follows: a row per chosen token, with the token's hash and the new path."""
    chosen = F.xxhash64("path", "h").bitwiseAND(F.lit((1 << 53) - 1)) / _UNIT < F.lit(branching) / F.col("len")
    kept = [c for c in rows.columns if c not in ("path", "h")]
    return rows.select(*kept, "path", F.explode("hs").alias("h")).where(chosen).select(*kept, "h", F.xxhash64("path", "h", F.lit(1)).alias("path"))


class _Meeting:
    """Compares the records of nodes, of which a node's rows follow each other."""

    def __init__(self, threshold: float, two: bool) -> None:
        self.threshold, self.two = threshold - 1e-9, two
        self.share = 1 - 2 * (threshold / (1 + threshold) - 1e-9)  # of the tokens of both, at most so many differ

    def pairs(self, part: pa.Table) -> pa.RecordBatch:
        part = part.take(pa.array(np.lexsort((part["len"].to_numpy(), part["path"].to_numpy()))))  # by length within a node
        num = lambda name: part[name].combine_chunks().to_numpy(zero_copy_only=False)
        self.len, self.b0, self.b1, self.side, self.half = num("len").astype(np.int64), num("b0").view(np.uint64), num("b1").view(np.uint64), num("side"), num("half")
        path = num("path")
        wide = part["wide"].combine_chunks()
        has = ~wide.is_null().to_numpy(zero_copy_only=False)
        self.row_of = np.where(has, np.cumsum(has) - 1, -1)
        self.words = np.frombuffer(b"".join(wide.drop_null().to_pylist()) or bytes(128), dtype=np.uint64).reshape(-1, 16)
        starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        sizes = np.diff(np.r_[starts, len(path)])
        small = sizes <= SHIFTED
        found = [self._shifted(starts[small], sizes[small]), *(self._dense(s, n) for s, n in zip(starts[~small], sizes[~small]))]
        i, j = (np.concatenate(x) for x in zip(*found))
        if self.two:
            swap = self.side[i] > self.side[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
        rid = part["rid"].combine_chunks()
        return pa.RecordBatch.from_arrays([rid.take(pa.array(i)), rid.take(pa.array(j))], names=["x", "y"])

    def _kept(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs that pass the narrow bits those that belong together and pass the wide bits."""
        fine = (self.half[i] == 2) | (self.half[i] != self.half[j])
        if self.two:
            fine &= self.side[i] != self.side[j]
        fine &= self.len[i] >= self.threshold * self.len[j]
        i, j = i[fine], j[fine]
        both = np.flatnonzero((self.row_of[i] >= 0) & (self.row_of[j] >= 0))
        if len(both):
            a, b = i[both], j[both]
            apart = np.bitwise_count(self.words[self.row_of[a]] ^ self.words[self.row_of[b]]).sum(axis=1, dtype=np.int64)
            far = both[apart > self.share * (self.len[a] + self.len[b])]
            i, j = np.delete(i, far), np.delete(j, far)
        return i, j

    def _shifted(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All small nodes at once: each row with the k-th row after it, as long as there is one of a fitting length."""
        ends = np.repeat(starts + sizes, sizes)
        i = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        out_i, out_j, k = [], [], 0
        while len(i):
            k += 1
            on = i + k < ends
            i, ends = i[on], ends[on]
            j = i + k
            on = self.len[i] >= self.threshold * self.len[j]  # lengths rise within a node
            i, j, ends = i[on], j[on], ends[on]
            apart = np.bitwise_count(self.b0[i] ^ self.b0[j]) + np.bitwise_count(self.b1[i] ^ self.b1[j])
            near = apart <= self.share * (self.len[i] + self.len[j])
            out_i.append(i[near])
            out_j.append(j[near])
        none = np.zeros(0, dtype=np.int64)
        return self._kept(np.concatenate([none, *out_i]), np.concatenate([none, *out_j]))

    def _dense(self, start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """One node, in strips of rows against those after them whose length fits."""
        end, out_i, out_j = start + size, [], []
        room = self.share * self.len[start:end]
        reach = np.searchsorted(self.len[start:end], self.len[start:end] / self.threshold, side="right")
        for lo in range(0, size, 64):
            hi = min(lo + 64, size)
            a, b = slice(start + lo, start + hi), slice(start + lo, start + reach[hi - 1])
            apart = np.bitwise_count(self.b0[a, None] ^ self.b0[None, b])
            apart += np.bitwise_count(self.b1[a, None] ^ self.b1[None, b])
            i, j = np.nonzero(apart - room[None, lo : reach[hi - 1]].astype(np.float32) <= room[lo:hi, None].astype(np.float32) + 1e-3)
            later = j > i
            out_i.append(i[later] + start + lo)
            out_j.append(j[later] + start + lo)
        return self._kept(np.concatenate(out_i), np.concatenate(out_j))


def _met(rows: DataFrame, threshold: float, two: bool) -> DataFrame:
    """(x, y): pairs of records of one node that sizes and parity bits don't tell apart.

    Rows are laid out by node, so a task holds the rows of one node and a few batches at a time.
    """
    kind = rows.schema["rid"].dataType
    schema = T.StructType([T.StructField("x", kind), T.StructField("y", kind)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, held = _Meeting(threshold, two), []
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch["path"].to_numpy()
            if held and held[-1]["path"][-1].as_py() != path[0] and sum(b.num_rows for b in held) >= 1 << 15:
                yield meeting.pairs(pa.Table.from_batches(held))
                held = []
            change = np.flatnonzero(path[1:] != path[:-1])
            if len(change):  # all but the last node are whole
                cut = int(change[-1]) + 1
                held.append(batch.slice(0, cut))
                if sum(b.num_rows for b in held) >= 1 << 15:
                    yield meeting.pairs(pa.Table.from_batches(held))
                    held = []
                batch = batch.slice(cut)
            held.append(batch)
        if held:
            yield meeting.pairs(pa.Table.from_batches(held))

    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(work, schema)


def similar_sets(
    left: DataFrame,
    id_col: str,
    tokens: str,
    threshold: float,
    right: DataFrame | None = None,
    min_size: int = 1,
    recall: float = 0.9999,
    branching: float = BRANCHING,
    node_rows: int = NODE_ROWS,
    depth: int = MAX_DEPTH,
    seed: int = 1,
) -> SimilarSets:
    """Pairs of records whose token sets have a Jaccard similarity of at least ``threshold``, within ``left`` or across to ``right``.

    Token lists are taken as sets: repeats and NULL elements don't count; NULL lists, sets smaller than ``min_size``
    (1 at least: two empty sets are no pair) and NULL ids are left out. Of rows that repeat an id with different sets
    the smallest set in array order counts. Equal sets are joined once, through a representative. ``recall`` holds for a pair
    at the threshold, its smaller set inside the larger one; pairs above it are missed less often. No pair below the threshold is returned.

    A branch on a token that more than ``node_rows`` records hold is split again without being counted; deeper nodes are
    counted and split while they are larger than that. Nodes that are still large after ``depth`` levels are compared block
    by block, so no pair is given up there. Every level is made anew from the written sets: no rows of paths are kept.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold lies in (0, 1]")
    two = right is not None
    sides = [left] if right is None else [left, right]
    tables = [d.select(F.lit(k).cast("tinyint").alias("side"), F.col(id_col).alias("id"), _as_set(d, tokens).alias("toks")) for k, d in enumerate(sides)]
    every = reduce(DataFrame.unionByName, tables).where(F.col("id").isNotNull() & (F.size("toks") >= max(1, min_size)))
    every = every.groupBy("side", "id").agg(F.min("toks").alias("toks"))
    every = materialize(every.select("*", F.xxhash64("toks").alias("sig1"), F.xxhash64(F.lit(seed), "toks").alias("sig2")), "sets")
    hashed = F.transform("toks", lambda t: F.xxhash64(t, F.lit(5)))
    reps = every.groupBy("side", "sig1", "sig2").agg(F.min(F.struct("id", "toks")).alias("r")).select("side", "sig1", "sig2", F.col("r.id").alias("rid"), F.col("r.toks").alias("toks"))
    reps = materialize(reps.withColumns({"len": F.size("toks"), "hs": hashed}).withColumn("bits", _bits("hs")), "reps")
    keys = ["side", "sig1", "sig2"]
    members = skew_join(every.select("side", "id", "sig1", "sig2"), reps.select(*keys, F.col("rid").alias("rep")), keys).select("side", "id", "rep")
    if not two:
        members = members.drop("side")
    roots = F.array(*[F.xxhash64(F.lit(k), F.lit(seed)) for k in range(trees_for(threshold, recall, branching, depth))])

    counts = reps.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    busy, seen = materialize_seen(counts.where(F.col("n") > node_rows), "busy", F.count(F.lit(1)).alias("n"), F.max("n").alias("most"))
    spent, lasting = [busy], []

    def hot(table: DataFrame, key: str, most: int | None) -> list:
        """The keys of a small table of crowded nodes that hold a share of all rows."""
        limit = max(WARM_ROWS, 4 * node_rows)
        if (most or 0) <= limit or sent_whole(table):
            return []
        return [r[0] for r in table.where(F.col("n") > limit).orderBy(F.desc("n"), key).limit(int(1 / HOT_SHARE)).collect()]

    def within(rows: DataFrame, crowded: DataFrame, key: str, how: str, most: int | None) -> DataFrame:
        return skew_join(rows, crowded.select(key), key, how, hot(crowded, key, most))

    carried = ["side", "rid", "len", "b0", "b1", "wide"]
    level = _branches(reps.select("side", "rid", "len", "bits.*", "hs", F.explode(roots).alias("path")), branching)
    leaves = [within(level, busy, "h", "left_anti", seen["most"])]
    level = within(level, busy, "h", "left_semi", seen["most"]) if seen["n"] else None
    for d in range(2, depth + 1):
        if level is None:
            break
        level = _branches(level, branching)
        full = level.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        full, seen = materialize_seen(full.where(F.col("n") > node_rows), "full", F.count(F.lit(1)).alias("n"), F.max("n").alias("most"))
        spent.append(full)
        leaves.append(within(level, full, "path", "left_anti", seen["most"]))
        if not seen["n"]:
            level = None
        elif d == depth:
            lasting.append(skew_join(level, full, "path", "inner", hot(full, "path", seen["most"])))
        else:
            level = within(level, full, "path", "left_semi", seen["most"])
    if level is not None and depth == 1:
        lasting.append(skew_join(level, level.groupBy("path").agg(F.count(F.lit(1)).alias("n")), "path"))

    shown = [*carried, "path"]
    found = [df.select(*shown, F.lit(2).cast("tinyint").alias("half")) for df in leaves]
    for df in lasting:  # pairs of blocks: p and q of a node meet under the key (node, p, q), in which only rows of different blocks pair unless p = q
        parts = F.ceil(F.col("n") / node_rows).cast("bigint")
        p = F.pmod(F.xxhash64("rid", F.lit(3)), parts)
        spread = df.select(*shown, p.alias("p"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("q"))
        half = F.when(F.col("p") == F.col("q"), 2).when(F.col("p") < F.col("q"), 0).otherwise(1).cast("tinyint")
        found.append(spread.select(*carried, F.xxhash64("path", F.least("p", "q"), F.greatest("p", "q")).alias("path"), half.alias("half")))
    met = _met(reduce(DataFrame.unionAll, found), threshold, two)
    met = met.select(F.col("x").alias("a"), F.col("y").alias("b")) if two else met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    maybe, seen = materialize_seen(met.distinct(), "maybe", F.count(F.lit(1)).alias("n"))
    for table in spent:
        discard(table)
    # only sets with a candidate have to travel
    ends = maybe.select(F.col("a").alias("rid")).unionAll(maybe.select(F.col("b").alias("rid"))).distinct()
    wanted = materialize(reps.select("side", "rid", "toks").join(ends, "rid", "left_semi"), "wanted")
    ls = wanted.where("side = 0").select(F.col("rid").alias("a"), F.col("toks").alias("toks_a"))
    rs = wanted.where(f"side = {int(two)}").select(F.col("rid").alias("b"), F.col("toks").alias("toks_b"))
    both = skew_join(skew_join(maybe, ls, "a", hot=hot_keys(maybe, "a", rows=seen["n"])), rs, "b", hot=hot_keys(maybe, "b", rows=seen["n"]))
    common = F.size(F.array_intersect("toks_a", "toks_b"))
    links = both.select("a", "b", common.alias("common"), (common / (F.size("toks_a") + F.size("toks_b") - common)).alias("similarity"))
    return SimilarSets(links.where(F.col("similarity") >= threshold), members, two)
