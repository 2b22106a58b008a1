"""N-gram Jaccard self join with count-vector R-trees.

A document's set is its distinct word shingles, as 64-bit hashes; documents with
equal sets are one node, so copies are never compared.

1. Shingles are hashed into groups.  A pair within the threshold differs in at
   most t shingles, so of t + 3 groups three at least are equal in both sets;
   each node is sent out once per group, with the hash of the group's members, and
   nodes that agree in a group meet in a block.  t depends on the size, so nodes
   use the group number of their size band and of the next; the bands are such
   that no pair spans more than two.
2. In a block the nodes' counts over `DIMENSIONS` groups are points.  An R-tree
   packs them into pages by size; the overlap of two pages, and then of two
   points, is at most the sum of the smaller counts.  Pairs that this bound leaves
   connect their nodes; the components are clusters.  In a cluster the search is
   run again on points with `WIDE` counts, which part long sets, too.
3. In what is left of a cluster pairs are verified on the sets themselves, unless they
   are already linked through others.
   The links that join something make a forest; its components are the result.

A block or cluster is one tile, or, when it is large, its nodes are dealt into
leaves and each pair of leaves is a tile, so no task gets more than two leaves.

Every document whose set is equal to or linked with another's is found, at any
number of copies: there is no cap on groups, clusters, or candidates.
"""
from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finlake.llm import bloom
from finlake.llm import text as T
from finlake.llm.components import components
from finlake.session import scratch_dir

SHINGLE = 3
PERCENT = 90
SPARE = 3              # groups that any linked pair has equal, at least
DIMENSIONS = 64        # counts of a point, a byte each; 255 stands for any larger count
WIDE = 1024            # the same for the second search: long sets look alike in few counts
PAGE = 32              # points of a page
LEAF_NODES, LEAF_BYTES = 1024, 16 << 20
CHUNK_BYTES = 1 << 20  # texts at once: arrays of hashes take some 50 times as much
SET_ROWS, WIDE_ROWS = "node long, tokens binary", "node long, n long, point binary"


def band_starts(percent: int, most: int = 1 << 31) -> np.ndarray:
    """First size of each band; the largest size that can be linked with a
    size of band j is in band j or j + 1."""
    out = [1]
    while out[-1] < most:
        out.append(100 * out[-1] // percent + 1)
    return np.array(out, np.int64)


class _Shingles:
    """The sets of the texts of one chunk."""

    def __init__(self, column: pa.Array, k: int):
        data, off = T.utf8(column)
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        s, e, first = T.runs(~T.SPACE[low], off)
        h, n = T.Rolling(low).span(s, e), np.diff(first)
        at = np.arange(len(h))
        end = np.repeat(first[1:], n)
        g = T.grams(h, k)
        keep = at + k <= end
        whole = (at == np.repeat(first[:-1], n)) & np.repeat(n < k, n)  # short texts: one gram of all words
        value = np.zeros(len(h), np.uint64)
        value[:len(g)] = g
        for m in range(1, k):
            here = at[whole & (np.repeat(n, n) == m)]
            x = np.full(len(here), m, np.uint64)
            for j in range(m):
                x = T.mix(x + h[here + j])
            value[here] = x
        keep |= whole
        doc = T.owner(first)[keep]
        value = value[keep]
        bounds = np.searchsorted(doc, np.arange(len(n) + 1))
        parts = [np.unique(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        self.n = np.array([len(p) for p in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        # node: hash of the set; 0 stands for no set
        self.node = _sum(T.mix(self.tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self.first)
        self.node = T.mix(self.node + self.n.astype(np.uint64)) | np.uint64(1)
        self.node[self.n == 0] = 0


def _sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _keys(sh: _Shingles, rows: np.ndarray, percent: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group keys of the given rows: (row, key)."""
    out_row, out_key = [], []
    band = np.searchsorted(starts, sh.n, "right") - 1
    for up in (0, 1):
        n = sh.n[rows]
        target = band[rows] + up
        # the largest difference of two linked sets, the larger in the target band
        t = (100 - percent) * 2 * (starts[target + 1] - 1) // (100 + percent)
        reach = (t > 0) & (100 * n // percent >= starts[target])
        r, target, t = rows[reach], target[reach], t[reach]
        if not len(r):
            continue
        m = t + SPARE
        n = sh.n[r]
        take = np.repeat(sh.first[r] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        tok = sh.tokens[take]
        salt = T.mix(target.astype(np.uint64) + np.uint64(77))
        base = np.concatenate([[0], np.cumsum(m)])
        spread = T.mix(tok ^ np.repeat(salt, n))
        group = np.repeat(base[:-1], n) + (spread % np.repeat(m, n).astype(np.uint64)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, group, T.mix(spread + np.uint64(1)))
        count = np.bincount(group, minlength=base[-1])
        row = np.repeat(np.arange(len(r)), m)
        number = np.arange(base[-1]) - np.repeat(base[:-1], m)
        empty = np.bincount(row[count == 0], minlength=len(r))
        # as many empty groups as any pair has equal ones: then those count, too
        keep = (count > 0) | (empty[row] >= SPARE)
        key = T.mix(total + np.repeat(salt, m) + number.astype(np.uint64) * np.uint64(T._BASE_2))
        out_row.append(r[row[keep]])
        out_key.append(key[keep])
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_row), np.concatenate(out_key)


def points_of(tokens: np.ndarray, first: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Group counts of the sets that lie one after another in `tokens`."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    group = (T.mix(tokens) % np.uint64(dimensions)).astype(np.int64)
    counts = np.bincount(row * dimensions + group, minlength=(len(first) - 1) * dimensions)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, dimensions)


def binary(rows: np.ndarray) -> pa.Array:
    off = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(rows.tobytes())])


def _bytes_of(column: pa.Array) -> np.ndarray:
    """Rows of a binary column whose values have one length."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0]:off[-1]].reshape(len(column), -1)


def _nodes(k: int):
    def run(batches):
        for chunk in T.chunks(batches, size=CHUNK_BYTES):
            sh = _Shingles(chunk.column("text"), k)
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id"), pa.array(sh.n), pa.array(sh.node.view(np.int64), mask=sh.n == 0),
                 binary(points_of(sh.tokens, sh.first))], ["id", "n", "node", "point"])
    return run


def _group_keys(k: int, percent: int):
    starts = band_starts(percent)

    def run(batches):
        seen: set[int] = set()  # nodes of this task whose keys are out: copies need none
        for chunk in T.chunks(batches, size=CHUNK_BYTES):
            sh = _Shingles(chunk.column("text"), k)
            new = []
            for i, x in enumerate(sh.node.tolist()):
                if x and x not in seen:
                    seen.add(x)
                    new.append(i)
            row, key = _keys(sh, np.array(new, np.int64), percent, starts)
            yield pa.RecordBatch.from_arrays([pa.array(sh.node[row].view(np.int64)), pa.array(key.view(np.int64))], ["node", "key"])
    return run


def _sets(k: int, wanted, wide: bool = False):
    """(node, tokens) of the wanted sets, or (node, n, point) with wide points."""
    def run(batches):
        seen: set[int] = set()
        for chunk in T.chunks(batches, size=CHUNK_BYTES):
            sh = _Shingles(chunk.column("text"), k)
            node = sh.node.view(np.int64)
            pick = []
            for i in np.flatnonzero((sh.n > 0) & bloom.contains(wanted.value, node)).tolist():
                if int(node[i]) not in seen:
                    seen.add(int(node[i]))
                    pick.append(i)
            yield set_rows(node, sh.tokens, sh.first, np.array(pick, np.int64), wide)
    return run


def set_rows(node: np.ndarray, tokens: np.ndarray, first: np.ndarray, pick: np.ndarray, wide: bool) -> pa.RecordBatch:
    sets = [tokens[first[i]:first[i + 1]] for i in pick.tolist()]
    if not wide:
        return pa.RecordBatch.from_arrays([pa.array(node[pick]), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "tokens"])
    n = np.array([len(x) for x in sets], np.int64)
    points = [points_of(x, np.array([0, len(x)]), WIDE) for x in sets]
    return pa.RecordBatch.from_arrays(
        [pa.array(node[pick]), pa.array(n), binary(np.concatenate(points) if points else np.zeros((0, WIDE), np.uint8))],
        ["node", "n", "point"])


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def forest(points: np.ndarray, n: np.ndarray, side: np.ndarray, percent: int, decide=None) -> list[tuple[int, int]]:
    """A forest of the pairs whose overlap bound allows a link and, if given,
    that `decide` accepts; pairs that are connected already are left out.  With two sides
    only pairs across are looked at (pairs within one have a tile of their own)."""
    points = np.where(points == 255, np.int32(1 << 24), points.astype(np.int32))
    two = side.any() and not side.all()
    pages = []
    for x in (0, 1) if two else (None,):
        order = np.argsort(n, kind="stable")
        if x is not None:
            order = order[side[order] == x]
        pages += [(order[i:i + PAGE], x) for i in range(0, len(order), PAGE)]
    high = np.array([points[p].max(0) for p, _ in pages])
    least = np.array([n[p].min() for p, _ in pages])
    most = np.array([n[p].max() for p, _ in pages])
    of_side = np.array([-1 if x is None else x for _, x in pages])
    union, links = _Union(len(n)), []
    for i, (p, x) in enumerate(pages):
        others = np.arange(i, len(pages))
        if two:
            others = others[of_side[others] != x]
        # sizes, then the pages' bound: the sum of the smaller highest counts
        others = others[(100 * most[others] >= percent * least[i]) & (100 * most[i] >= percent * least[others])]
        bound = np.minimum(high[i], high[others]).sum(1)
        others = others[(100 + percent) * bound >= percent * (least[i] + least[others])]
        for j in others.tolist():
            q = pages[j][0]
            apart = (np.array([union.find(a) for a in p.tolist()])[:, None]
                     != np.array([union.find(b) for b in q.tolist()]))
            apart &= (100 * n[p][:, None] >= percent * n[q]) & (100 * n[q] >= percent * n[p][:, None])
            if not apart.any():
                continue
            bound = np.minimum(points[p][:, None, :], points[q][None, :, :]).sum(2)
            a, b = np.nonzero(apart & ((100 + percent) * bound >= percent * (n[p][:, None] + n[q][None, :])))
            for a, b in zip(p[a].tolist(), q[b].tolist()):
                if union.find(a) != union.find(b) and (decide is None or decide(a, b)):
                    union.join(a, b)
                    links.append((a, b))
    return links


def verified_forest(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """The forest of the links between the sets of a tile."""
    n = np.array([len(x) for x in sets], np.int64)

    def linked(a: int, b: int) -> bool:
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return 100 * both >= percent * (n[a] + n[b] - both)

    points = points_of(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]), WIDE if n.max() > 500 else DIMENSIONS)
    return forest(points, n, side, percent, linked)


def _groups(batches):
    """Record batches of whole tiles: (batch, first row of each tile, one more)."""
    rest = None
    for b in itertools.chain(batches, [None]):
        parts = [x for x in (rest, b) if x is not None and x.num_rows]
        if not parts:
            continue
        t = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        key = np.stack([t.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "i", "j")])
        first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        if b is None:
            yield t, np.append(first, t.num_rows)
        else:
            rest = t.slice(first[-1])
            if len(first) > 1:
                yield t.slice(0, first[-1]), first


def _edges(node: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(node[a[:, 0]]), pa.array(node[a[:, 1]])], ["u", "v"])


def _bounded_tiles(percent: int):
    def run(batches):
        for t, first in _groups(batches):
            node, n, side = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "side"))
            points, size = _bytes_of(t.column("point")), np.diff(first)
            # most tiles are pairs: all at once
            a = first[:-1][size == 2]
            p, q = (np.where(points[x] == 255, np.int32(1 << 24), points[x].astype(np.int32)) for x in (a, a + 1))
            total = n[a] + n[a + 1]
            near = ((100 + percent) * np.minimum(p, q).sum(1) >= percent * total) & (
                100 * np.minimum(n[a], n[a + 1]) >= percent * np.maximum(n[a], n[a + 1]))
            pairs = list(zip(a[near].tolist(), (a[near] + 1).tolist()))
            for g in np.flatnonzero(size > 2).tolist():
                x, y = int(first[g]), int(first[g + 1])
                pairs += [(x + u, x + v) for u, v in forest(points[x:y], n[x:y], side[x:y], percent)]
            yield _edges(node, pairs)
    return run


def _verified_tiles(percent: int):
    def run(batches):
        for t, first in _groups(batches):
            node, side = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "side"))
            tokens = t.column("tokens")
            for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
                if y - x > 1:
                    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in tokens[x:y]]
                    yield _edges(node, [(x + u, x + v) for u, v in verified_forest(sets, side[x:y], percent)])
    return run


def _deal(rows: DataFrame, tile: str, leaves: F.Column, run) -> DataFrame:
    """Run `run` over the tiles of `rows`: one per value of column `tile`, or one
    per pair of its leaves; gives (u, v)."""
    rest = [c for c in rows.columns if c != tile]
    dealt = (rows.withColumn("leaves", leaves.cast("int")).withColumn("leaf", F.pmod(F.xxhash64("node"), "leaves").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("leaves") - 1)))
             .select(F.col(tile).alias("tile"), F.least("leaf", "other").alias("i"), F.greatest("leaf", "other").alias("j"),
                     (F.col("leaf") > F.col("other")).cast("int").alias("side"), *[c for c in rest if c != "size"]))
    return dealt.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j").mapInArrow(run, "u long, v long")


def verified_links(keyed: DataFrame, points: DataFrame, fetch, percent: int, base: str) -> DataFrame:
    """A forest (u, v) of the links between nodes.

    keyed: (node, key), nodes that may be linked share a key; points: (node, n,
    point), repeated rows allowed; `fetch` takes a broadcast bit filter of nodes
    and whether wide points are wanted, and gives ``set_rows`` of those it
    holds.  `base` is a fresh folder for tables.
    """
    spark = keyed.sparkSession
    # one exchange by key serves both: the keys are counted as they stream by, and nothing is held per key
    keyed = keyed.repartition("key")
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size"))
    keyed.join(shared.where("low != high").select("key", "size"), "key").select("node", "key", "size").write.parquet(f"{base}/met")
    met = spark.read.parquet(f"{base}/met")
    here = spark.sparkContext.broadcast(bloom.build(met.select("node").distinct(), "node"))

    def held(batches):
        for b in batches:
            yield b.filter(pa.array(bloom.contains(here.value, b.column("node").to_numpy(zero_copy_only=False))))

    points = points.where("node is not null").mapInArrow(held, points.schema)
    points = points.groupBy("node").agg(F.first("n").alias("n"), F.first("point").alias("point"))
    near = _deal(met.join(points, "node"), "key", F.ceil(F.col("size") / LEAF_NODES), _bounded_tiles(percent))
    components(near).write.parquet(f"{base}/clusters")
    clusters = spark.read.parquet(f"{base}/clusters").toDF("node", "cluster")

    wanted = spark.sparkContext.broadcast(bloom.build(clusters, "node"))
    wide = fetch(wanted, True).join(clusters, "node").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "point", "cluster")])
    wide.write.parquet(f"{base}/wide")
    wide = spark.read.parquet(f"{base}/wide")
    size = wide.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    near = _deal(wide.join(size, "cluster"), "cluster", F.ceil(F.col("size") / LEAF_NODES), _bounded_tiles(percent))
    components(near).write.parquet(f"{base}/parted")
    clusters = spark.read.parquet(f"{base}/parted").toDF("node", "cluster")

    wanted = spark.sparkContext.broadcast(bloom.build(clusters, "node"))
    sets = fetch(wanted, False).join(clusters, "node").groupBy("node").agg(F.first("tokens").alias("tokens"), F.first("cluster").alias("cluster"))
    sets.write.parquet(f"{base}/candidates")
    sets = spark.read.parquet(f"{base}/candidates")
    size = sets.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / LEAF_NODES),
                                                  F.ceil(F.sum(F.length("tokens")) / LEAF_BYTES)).alias("size"))
    return _deal(sets.join(size, "cluster"), "cluster", F.col("size"), _verified_tiles(percent))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles and component_id, the smallest id
    that links reach from it, itself included.

    Two documents link when ``100 * intersection >= percent * union`` of their
    shingle sets.  NULL, empty and wordless texts have no set and link with
    nothing.  Repeated rows and equal texts are linked.  A NULL id names no
    component: such a row has its partners' smallest id, or NULL.  Other
    columns are left out.
    """
    spark = docs.sparkSession
    base = scratch_dir(spark, "ngrams")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    d.mapInArrow(_nodes(shingle), f"id {kind}, n long, node long, point binary").write.parquet(f"{base}/nodes")
    table = spark.read.parquet(f"{base}/nodes")

    # group keys go straight to the shuffle: written down they would take as much space again
    keyed = d.select("text").mapInArrow(_group_keys(shingle, percent), "node long, key long")

    def fetch(wanted, wide):
        return d.select("text").mapInArrow(_sets(shingle, wanted, wide), WIDE_ROWS if wide else SET_ROWS)

    roots = components(verified_links(keyed, table.select("node", "n", "point"), fetch, percent, base))

    reps = table.where("node is not null").groupBy("node").agg(F.min("id").alias("rep"))
    linked = reps.join(roots, "node")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("linked"))
    names = reps.join(linked.select("node", "root").join(smallest, "root").select("node", "linked"), "node", "left")
    names = names.select("node", F.coalesce("linked", "rep").alias("component"))
    named = table.where("node is not null").select("id", "n", "node").join(names, "node", "left")
    alone = table.where("node is null").select("id", "n", F.col("id").alias("component"))
    return (named.select("id", "n", "component").union(alone)
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **join) -> DataFrame:
    """The documents, all columns kept, without those linked with a smaller id,
    or with a row of the same id whose text has a smaller hash; rows equal in
    all columns count once, and rows equal in id and text stay or go together.
    Rows with a NULL id stay.  Columns may have any name."""
    mark = "_" * (1 + max(map(len, docs.columns)))  # a name no column has
    row = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("text"))
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).withColumn(mark, row).dropDuplicates()
    links = link_documents(rows.select(F.col(mark).alias("row"), F.col(f"`{text_col}`").alias("text")), "row", "text", **join)
    keep = links.where("row = component_id").select(F.col("row").alias(mark)).distinct()
    return rows.join(keep, mark, "leftsemi").select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
