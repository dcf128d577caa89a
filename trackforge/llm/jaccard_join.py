"""N-gram Jaccard self-join by prefix trees, with the classes of texts that its links connect.

Every text is the set of its n-gram hashes, and all sets stand in one global order, rare n-grams first: by the power of
two of the number of rows that hold an n-gram, then by hash. By the prefix bound, two sets of sufficient similarity
share an n-gram among the first n - ceil(t n) + 1 of each; of the set that isn't the larger one even the first
n - ceil(2 t / (1 + t) n) + 1 are enough. The steps:

1. Equal sets become one class, which one row represents; the rest deals with classes.
2. How many rows hold an n-gram is found by dealing n-grams by hash, packed, each once for a part of the documents
   with its count. What occurs again returns to those parts, which put their sets in order.
3. Sets with a prefix n-gram that other classes have as well are compared with one leader: of the classes that lead
   its prefix n-grams (the one with the fewest n-grams of its own leads), the one with which it shares most of them,
   if those are enough for a link. Groups of copies, however large, are linked by one comparison for each member.
4. What could still link different components shares a prefix n-gram across them. Rows that such n-grams connect are a
   family; its sets go to one place, or, if they are many, to one for each pair of blocks of the family.
5. Sets that meet are stored as a prefix tree in the global order. A probe walks it from the root: paths that sets
   share are compared once, and a subtree is left as soon as the overlap so far and what remains of the probe and of
   the sets below can't be enough, or when all of it belongs to the probe's component.

Links are joined to components by label propagation over distributed tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackforge.llm import counts, textops
from trackforge.llm.durable import materialise, release_shuffles, staged
from trackforge.llm.packing import merged
from trackforge.llm.workers import bound_batches, lean, lean_group

NULL_ID = (1 << 63) - 1
BLOCK_BYTES = 4 << 20  # sets of a tree
STRIDE = 48  # n-grams of a path that are compared at once
CLASS_BITS = 6  # of an ordered n-gram: the power of two of its rows; the others are those of its hash
SECOND = np.uint64(0xA5A5B4B4C3C3D2D2)


@dataclass(frozen=True)
class Similarity:
    """Shingles of size words; two sets link when percent / 100 of their union is common."""

    size: int
    percent: int

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.percent * n // 100) + 1

    def short_prefix(self, n: np.ndarray) -> np.ndarray:
        """The prefix that is enough of a set that isn't the larger of two."""
        return n - -(-2 * self.percent * n // (100 + self.percent)) + 1

    def needed(self, a: int, b: np.ndarray) -> np.ndarray:
        """Least common part of sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))


def shingle_sets(texts: textops.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the bounds of each text's."""
    words, _, _, firsts = texts.lowered().word_hashes()
    n = np.diff(firsts)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = textops.expand(firsts[:-1], count)
    whole = np.repeat(n >= size, count)
    hashes = np.zeros(len(at), np.uint64)
    hashes[whole] = textops.grams(words, size)[at[whole]] if whole.any() else 0
    for k in range(1, size):
        short = np.repeat(n == k, count)
        if short.any():
            hashes[short] = textops.grams(words, k)[at[short]]
    return textops.distinct_in_order(hashes, np.concatenate([[0], np.cumsum(count)]))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _described(size: int) -> Callable:
    """doc_id, text_hash, row, text -> doc_id, text_hash, row, n, and two digests of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in textops.chunks(batch.column(3)):
                hashes, bounds = shingle_sets(texts, size)
                a, b = _sums(textops.mix(hashes), bounds), _sums(textops.mix(hashes ^ SECOND), bounds)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(texts.first, len(texts)) for i in range(3)), *(pa.array(x) for x in (np.diff(bounds), a.view(np.int64), b.view(np.int64)))], names=["doc_id", "text_hash", "row", "n", "d1", "d2"])

    return run


def _counted(s: Similarity, buckets: int) -> Callable:
    """part, text -> each n-gram of a part with its number of rows, as counts.dealt()."""
    return counts.dealt(lambda texts: shingle_sets(texts, s.size), buckets)


def _prefixes(s: Similarity, buckets: int) -> Callable:
    """(texts of a part, its repeated n-grams and the rows that represent classes) -> rows (row, n, own, gram, short).

    They are the prefix n-grams that other rows have as well, of the rows that represent classes; own is the number of
    n-grams that no other row has. For each row that has any, one more row holds its whole set, big-endian in the
    global order, and no gram.
    """
    fields = [("row", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("gram", pa.int64()), ("short", pa.bool_()), ("grams", pa.binary())]

    def ordered(texts: textops.Texts, known: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, bounds = shingle_sets(texts, s.size)
        keys = counts.names(hashes, buckets)
        rank = np.zeros(len(keys), np.uint64)
        if len(known):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            rank = np.where(known[at] == keys, power[at], 0).astype(np.uint64)
        values = (rank << np.uint64(64 - CLASS_BITS)) | (hashes >> np.uint64(CLASS_BITS))
        return textops.distinct_in_order(values, bounds)

    def run(texts_of: pa.Table, others: pa.Table) -> pa.Table:
        out = [pa.table({k: pa.array([], t) for k, t in fields})]
        if not texts_of.num_rows or not others.num_rows:
            return out[0]
        chosen = pc.drop_null(others.column("row")).combine_chunks()
        blobs = pc.drop_null(others.column("blob"))
        known, power = merged(blobs) if len(blobs) else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        order = np.argsort(known)
        known, power = known[order], power[order]
        rows = texts_of.column("row").to_numpy()
        _, first = np.unique(rows, return_index=True)  # a row that comes twice is taken once
        mine = np.sort(first[np.isin(rows[first], chosen.to_numpy())])
        at = 0
        for column in texts_of.column("text").take(pa.array(mine)).chunks:
            for texts in textops.chunks(column):
                own_rows = rows[mine[at + texts.first : at + texts.first + len(texts)]]
                grams, bounds = ordered(texts, known, power)
                size = np.diff(bounds)
                text = np.repeat(np.arange(len(texts)), size)
                shared = grams >> np.uint64(64 - CLASS_BITS) > 0
                within = np.arange(len(grams)) - bounds[text]
                own = np.bincount(text[~shared], minlength=len(texts))
                keep = np.flatnonzero((within < s.prefix(size)[text]) & shared)
                near = within[keep] < s.short_prefix(size)[text[keep]]
                some = np.unique(text[keep])
                blob = grams.astype(">u8").tobytes()
                of = np.concatenate([text[keep], some])
                mask = np.arange(len(of)) >= len(keep)
                out.append(
                    pa.table(
                        {
                            "row": own_rows[of],
                            "n": size[of].astype(np.int32),
                            "own": own[of].astype(np.int32),
                            "gram": pa.array(np.concatenate([grams[keep].view(np.int64), np.zeros(len(some), np.int64)]), mask=mask),
                            "short": np.concatenate([near, np.zeros(len(some), bool)]),
                            "grams": pa.array([None] * len(keep) + [blob[8 * bounds[i] : 8 * bounds[i + 1]] for i in some.tolist()], pa.binary()),
                        }
                    )
                )
            at += len(column)
        return pa.concat_tables(out)

    return run


class PrefixTree:
    """Sets as paths from a root, in the order of their members; paths that sets share are stored once.

    sets: arrays of ascending numbers below universe and 2**32, all different. Nodes are the places where paths part or end.
    groups: a number for each set; a subtree of one group only can be left out of a walk.
    """

    def __init__(self, sets: list[np.ndarray], groups: np.ndarray, universe: int) -> None:
        self.marked = np.zeros(universe, bool)
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets, self.groups = sets, groups
        self.sizes = np.array([len(x) for x in sets])
        starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.symbols = np.concatenate(sets)
        depth, parent, first, ends = [0], [-1], [order[0]], [-1]
        done: list[int] = []  # nodes, each after those below it
        path = [0]

        def close(to: int) -> None:
            while depth[path[-1]] > to:
                node = path.pop()
                if depth[path[-1]] < to:
                    depth.append(to)
                    parent.append(-1)
                    first.append(first[node])
                    ends.append(-1)
                    path.append(len(depth) - 1)
                parent[node] = path[-1]
                done.append(node)

        before = None
        for i in order:
            x = sets[i]
            common = 0
            if before is not None:
                m = min(len(x), len(before))
                differs = np.flatnonzero(x[:m] != before[:m])
                common = int(differs[0]) if len(differs) else m
            close(common)
            depth.append(len(x))
            parent.append(-1)
            first.append(i)
            ends.append(i)
            path.append(len(depth) - 1)
            before = x
        close(0)
        sizes, of = self.sizes.tolist(), groups.tolist()
        least = [1 << 40 if e < 0 else sizes[e] for e in ends]  # of all sets below a node
        most = [0 if e < 0 else sizes[e] for e in ends]
        group = [-2 if e < 0 else of[e] for e in ends]  # -1: several
        for node in done:
            up = parent[node]
            least[up], most[up] = min(least[up], least[node]), max(most[up], most[node])
            group[up] = group[node] if group[up] in (-2, group[node]) else -1
        self.depth, self.parent, self.ends, self.least, self.most, self.group = (np.array(x) for x in (depth, parent, ends, least, most, group))
        self.begin = starts[np.array(first)]  # symbols of the path to a node begin here
        below = np.argsort(self.parent[1:], kind="stable") + 1
        self.below = below
        self.below_at = np.searchsorted(self.parent[below], np.arange(len(depth) + 1))

    def similar(self, probe: np.ndarray, s: Similarity, group: int | None = None, at_least: int = 0) -> np.ndarray:
        """Numbers of the sets that link with the probe, of those with at least so many members and not of its group."""
        self.marked[probe] = True
        found = []

        def children(nodes: np.ndarray) -> np.ndarray:
            return self.below[textops.expand(self.below_at[nodes], self.below_at[nodes + 1] - self.below_at[nodes])]

        node = children(np.zeros(1, np.int64))
        place, along = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        while len(node):
            steps = np.minimum(self.depth[node] - place, STRIDE)
            hits = self.marked[self.symbols[textops.expand(self.begin[node] + place, steps)]]
            along = along + np.add.reduceat(hits, np.concatenate([[0], np.cumsum(steps)[:-1]]), dtype=np.int64)
            place = place + steps
            rest = len(probe) - np.searchsorted(probe, self.symbols[self.begin[node] + place - 1], side="right")
            bound = along + np.minimum(self.most[node] - place, rest)
            keep = (bound >= s.needed(len(probe), np.maximum(self.least[node], at_least))) & (self.most[node] >= at_least)
            if group is not None:
                keep &= self.group[node] != group
            node, place, along = node[keep], place[keep], along[keep]
            whole = place == self.depth[node]
            last = np.flatnonzero(whole & (self.ends[node] >= 0))
            if len(last):
                of = self.ends[node[last]]
                fits = (along[last] >= s.needed(len(probe), self.sizes[of])) & (self.sizes[of] >= at_least)
                found.append(of[fits] if group is None else of[fits & (self.groups[of] != group)])
            onward = node[whole]
            next_nodes = children(onward)
            times = self.below_at[onward + 1] - self.below_at[onward]
            place = np.concatenate([place[~whole], np.repeat(place[whole], times)])
            along = np.concatenate([along[~whole], np.repeat(along[whole], times)])
            node = np.concatenate([node[~whole], next_nodes])
        self.marked[probe] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _numbered(blobs: list[bytes]) -> tuple[list[np.ndarray], int]:
    """Sets with members numbered in the global order, and how many there are."""
    sizes = np.array([len(b) // 8 for b in blobs])
    members, numbers = np.unique(np.frombuffer(b"".join(blobs), ">u8").astype(np.uint64), return_inverse=True)
    return np.split(numbers, np.cumsum(sizes)[:-1]), len(members)


def _parts_of(table: pa.Table, *names: str) -> Iterator[pa.Table]:
    """Rows of a table that agree in the columns."""
    keys = np.stack([table.column(c).to_numpy() for c in names])
    order = np.lexsort(keys)
    cuts = np.flatnonzero((np.diff(keys[:, order], axis=1) != 0).any(0)) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield table.take(pa.array(part))


def _links(a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    return pa.table({k: np.concatenate([np.zeros(0, np.int64), *x]) for k, x in (("a", a), ("b", b))})


def _led(s: Similarity) -> Callable:
    """rows (leader, block, row, grams), the leader's own among them -> links (a, b) of leaders with rows."""

    def run(rows: pa.Table) -> pa.Table:
        a, b = [], []
        for part in _parts_of(rows, "leader", "block"):
            leader, row = part.column("leader")[0].as_py(), part.column("row").to_numpy()
            sets, universe = _numbered(part.column("grams").to_pylist())
            others = np.flatnonzero(row != leader)
            if len(others) < len(row) and len(others):
                tree = PrefixTree([sets[i] for i in others], np.zeros(len(others), np.int64), universe)
                found = row[others[tree.similar(sets[int(np.flatnonzero(row == leader)[0])], s)]]
                a.append(np.full(len(found), leader))
                b.append(found)
        return _links(a, b)

    return run


def _in_family(s: Similarity) -> Callable:
    """rows (family, i, j, block, row, component, short, grams) -> links (a, b) between components.

    Of two different blocks i and j only what lies between them is compared. Rows that are short probe sets that
    aren't smaller than theirs.
    """

    def run(rows: pa.Table) -> pa.Table:
        a, b = [], []
        for part in _parts_of(rows, "family", "i", "j"):
            row, block, short = (part.column(c).to_numpy() for c in ("row", "block", "short"))
            _, component = np.unique(part.column("component").to_numpy(), return_inverse=True)
            sets, universe = _numbered(part.column("grams").to_pylist())
            blocks = np.unique(block)
            if len(blocks) == 1 and part.column("i")[0] != part.column("j")[0]:
                continue
            for other in blocks.tolist():
                into = np.flatnonzero(block == other)
                probes = np.flatnonzero((short & (block != other)) if len(blocks) > 1 else short)
                tree = PrefixTree([sets[i] for i in into], component[into], universe)
                for x in probes.tolist():
                    found = row[into[tree.similar(sets[x], s, int(component[x]), len(sets[x]))]]
                    a.append(np.full(len(found), row[x]))
                    b.append(found)
        return _links(a, b)

    return run


def components(links: DataFrame) -> DataFrame:
    """node, component: for each node with a link the smallest that links reach. Labels spread over links and are then shortened.

    Tables of labels are merged, never broadcast: a table that just passes for small, round after round, fills the driver.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = both.join(labels.hint("merge"), both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
        spread = labels.join(near.hint("merge"), "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        spread = materialise(spread)
        up = spread.select(F.col("node").alias("component"), F.col("component").alias("above"))
        labels = materialise(spread.join(up.hint("merge"), "component").select("node", "old", F.col("above").alias("component")))
        if not labels.where("old <> component").limit(1).count():
            return labels.select("node", "component")
        labels = labels.select("node", "component")


def least_common(n: Column, m: Column, s: Similarity) -> Column:
    """How many n-grams the prefixes of two sets of these sizes share at least, if the sets link.

    At most n - o of a set's n-grams are missing in the other, o being the overlap that is needed; of the set whose
    prefix ends first in the global order, all others of its prefix are in the other's prefix too.
    """
    overlap = F.ceil(s.percent * (n + m) / (100 + s.percent))
    return F.least(overlap - F.ceil(s.percent * n / 100) + 1, overlap - F.ceil(s.percent * m / 100) + 1)


def text_hash(text: Column) -> Column:
    """Names a text among those of one id; a null text is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def leaders(prefixes: DataFrame, s: Similarity) -> DataFrame:
    """leader, row: for each row the leader to compare it with, if there is one that it could link with."""
    close = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * s.percent
    offers = prefixes.where("row <> leader").groupBy("row", "n", "leader", "leader_n", "leader_own").agg(F.count("*").alias("common"))
    offers = offers.where(close & (F.col("common") >= least_common(F.col("n"), F.col("leader_n"), s)))
    best = offers.groupBy("row").agg(F.max(F.struct("common", -F.col("leader_own"), "leader")).alias("best"))
    return best.select(F.col("best.leader").alias("leader"), "row")


def leader_links(pairs: DataFrame, sets: DataFrame, s: Similarity, bins: int) -> DataFrame:
    """Links (a, b) of leaders with their rows; the rows of a leader are dealt in blocks of bounded size."""
    weighed = pairs.join(sets.hint("merge"), "row")
    blocks = weighed.groupBy("leader").agg(F.ceil(F.sum(F.octet_length("grams")) / BLOCK_BYTES).cast("int").alias("blocks"))
    weighed = weighed.join(blocks.hint("merge"), "leader").select("leader", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), "row", "grams")
    own = blocks.join(sets.hint("merge"), F.col("leader") == F.col("row")).select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "row", "grams")
    dealt = weighed.unionByName(own).withColumn("bin", F.pmod(F.xxhash64("leader", "block"), F.lit(bins)))
    return dealt.groupBy("bin").applyInArrow(lean_group(_led(s)), "a long, b long")


def family_links(prefixes: DataFrame, labels: DataFrame, sets: DataFrame, s: Similarity, bins: int) -> DataFrame:
    """Links (a, b) between rows of different components that share a prefix n-gram, at least one for each two that link."""
    placed = prefixes.join(labels.hint("merge"), F.col("row") == F.col("node"), "left").select("gram", "short", "row", F.coalesce("component", "row").alias("component"))
    mixed = placed.groupBy("gram").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("row").alias("least")).where("c0 <> c1").select("gram", "least")
    found = materialise(placed.join(mixed.hint("merge"), "gram"))
    families = components(found.where("row <> least").select(F.col("least").alias("a"), F.col("row").alias("b")).distinct())
    rows = found.groupBy("row", "component").agg(F.max("short").alias("short")).join(families.hint("merge"), F.col("row") == F.col("node"))
    rows = materialise(rows.select(families["component"].alias("family"), "row", found["component"], "short").join(sets.hint("merge"), "row"))
    sizes = rows.groupBy("family").agg(F.ceil(F.sum(F.octet_length("grams")) / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = rows.join(sizes.hint("merge"), "family").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "row", "component", "short", "grams")
    dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("family", "i", "j"), F.lit(bins)))
    return dealt.groupBy("bin").applyInArrow(lean_group(_in_family(s)), "a long, b long")


def join_classes(docs: DataFrame, s: Similarity, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Each row of docs with text_hash, n_shingles, component_id (the smallest doc_id that links reach) and representative.

    text_hash: names the row together with doc_id, as text_hash() of its text. representative: true for exactly one row
    of each component, the one of smallest doc_id (of several texts with that id, the one of smallest key; of equal
    rows, any one), and for every row without shingles.
    Words are compared with A-Z in lower case. Texts that are null, empty or without words have an empty set, which
    links with nothing; texts shorter than a shingle are one shingle as a whole. Rows that come twice are one class.
    A null doc_id counts as larger than all others. An empty table gives no rows; only id and text are read. Shingles
    are compared by 58 bits of their hashes, with the class of their frequency.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")) + 1
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.xxhash64("doc_id", "text").alias("row"), "text")
    part = F.pmod("row", F.lit(buckets)).cast("int").alias("part")
    rows = materialise(texts.mapInArrow(lean(_described(s.size)), "doc_id long, text_hash long, row long, n long, d1 long, d2 long"))
    classes = rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    classes = materialise(classes.select("n", "d1", "d2", F.col("least.doc_id").alias("doc_id"), F.col("least.row").alias("row")))

    counted = texts.select(part, "text").mapInArrow(_counted(s, buckets), "bucket int, blob binary")
    ranked = counted.groupBy("bucket").applyInArrow(counts.repeated(buckets), "part int, blob binary")
    others = ranked.select("part", "blob", F.lit(None).cast("long").alias("row")).union(classes.select(part, F.lit(None).cast("binary"), "row"))
    dealt = texts.select(part, "row", "text").groupBy("part").cogroup(others.groupBy("part"))
    found = staged(dealt.applyInArrow(lean_group(_prefixes(s, buckets)), "row long, n int, own int, gram long, short boolean, grams binary"))
    release_shuffles(spark)
    sets = found.where("grams is not null").select("row", "grams")
    prefixes = found.where("gram is not null").select("row", "n", "own", "gram", "short")
    shared = prefixes.groupBy("gram").agg(F.count("*").alias("m"), F.min(F.struct((F.col("own") / F.col("n")).alias("leader_own"), "row", "n")).alias("first")).where("m > 1")
    shared = shared.select("gram", F.col("first.leader_own").alias("leader_own"), F.col("first.row").alias("leader"), F.col("first.n").alias("leader_n"))
    prefixes = materialise(prefixes.select("row", "n", "gram", "short").join(shared.hint("merge"), "gram"))

    first = materialise(leader_links(leaders(prefixes, s), sets, s, buckets))
    labels = components(first)
    second = materialise(family_links(prefixes, labels, sets, s, buckets))
    release_shuffles(spark)
    if second.limit(1).count():
        labels = components(first.union(second))

    named = classes.join(labels.hint("merge"), F.col("row") == F.col("node"), "left").select("n", "d1", "d2", F.struct("doc_id", "row").alias("class"), F.coalesce("component", "row").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("class").alias("first")).hint("merge"), "component")
    named = named.select("n", "d1", "d2", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row"))
    out = rows.join(named.hint("merge"), ["n", "d1", "d2"], "left")
    out = out.withColumn("copy", F.row_number().over(Window.partitionBy("row").orderBy("doc_id")))
    own = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    component = F.coalesce(F.when(F.col("component_id") != NULL_ID, F.col("component_id")), own)
    representative = F.col("component_id").isNull() | ((F.col("first_row") == F.col("row")) & (F.col("copy") == 1))
    return out.select(own.alias("doc_id"), "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), representative.alias("representative"))


def drop_copies(docs: DataFrame, s: Similarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that join_classes marks as representative, with all their columns.

    Of rows with the same id and text the one whose other columns come first is kept.
    """
    key = ["id", "text_hash"]
    found = join_classes(docs, s, id_col, text_col).where("representative")
    kept = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text_hash", (F.col("n_shingles") > 0).alias("once")).distinct()
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"), text_hash(docs[text_col]).alias("text_hash"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    others = [F.col("row")[c] for c in docs.columns if c not in (id_col, text_col)] or [F.col("id")]
    copy = F.row_number().over(Window.partitionBy(*key).orderBy(*others))
    chosen = rows.join(kept.hint("merge"), key).withColumn("copy", copy).where(~F.col("once") | (F.col("copy") == 1))
    return chosen.select(*(F.col("row")[c].alias(c) for c in docs.columns))
