"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketches: in round i, every shingle is hashed to a bin and to a value that begins with i, and each
bin keeps its smallest value; so a bin filled in an early round beats all later ones. From round t on
(t bins), round t + j puts all shingles into bin j, so after 2 t rounds every coordinate is full; a set
is done as soon as all bins are. Two sets agree in a coordinate with the chance of their Jaccard
similarity, and the number of equal coordinates is concentrated as with independent hashes.

Steps, all in Spark: (1) texts become a signature: size and 128-bit hash of the shingle set, and a
hash for each of 32 bands of 4 coordinates; equal sets collapse to one node, the smallest id, so exact
copies cost one partial aggregate. (2) A band bucket of two nodes or more links its nodes to its smallest node, the hub:
candidate edges, at most one for each node and band, never pairs. (3) Connected components of these edges
hold all nodes that share a bucket. (4) Inside a candidate component, the links are confirmed on the full
shingle sets: sketches can't rule a pair out, but the sizes and an index of the shingles can, exactly.
A component of at most `cell_nodes` nodes and `cell_shingles` shingles is one task's cell. A larger one is
cut into such cells around hubs: a node goes to the hub that it shares most bands with, and a hub is in all cells
of its own. (5) Components of the cells' links are clusters. Only where a larger component has several clusters,
nodes of different clusters are still compared, by pairs of blocks of nodes: a large cluster has blocks of its own,
which aren't paired with each other, so one giant group and some strays cost the group's size times the strays', not its
square. A task's memory is bounded, and it returns a spanning forest of the confirmed links, not the links.
(6) Components of clusters and new links give the result.

A link at the threshold of 0.85 shares no band with a chance of (1 - 0.85**4)**32, about 6e-11; one at the
pipeline's 0.8, about 5e-8.

Defined results: documents without words (null or empty) have no shingles, are linked with nothing and
kept; documents of fewer than k words have one shingle, their whole sequence; rows of one id are one
document of all their links; rows with a null id are linked with nothing and have a null component;
other columns are not returned, whatever they are called; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, apart, flat, mix, rolling_in_rows, scratch, slices, whole, written
from .components import components

BINS, ROWS = 128, 4
_FULL = np.uint64((1 << 64) - 1)


def shingle_sets(column, k: int = 5):
    """Yields (first row, counts, hashes): the sorted distinct shingle hashes of some rows, row by row."""
    data, offsets = flat(column)
    for i, j in slices(offsets):
        w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        h = w.hashes(lower=True)
        s, at = rolling_in_rows(h, w.bounds, k)
        row = np.searchsorted(w.bounds, at, "right") - 1
        n = np.diff(w.bounds)
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            s, row = np.concatenate([s, whole(h, w.bounds)[short]]), np.concatenate([row, short])
        order = np.lexsort((s, row))
        s, row = s[order], row[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
        s, row = s[new], row[new]
        yield i, np.bincount(row, minlength=j - i), s


def sketches(counts: np.ndarray, s: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches, one row for each set; sets without shingles stay at the largest value."""
    out = np.full((len(counts), bins), _FULL, np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    for i in range(2 * bins):
        if not len(s):
            break
        x = mix(s + np.uint64((i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
        at = (x >> np.uint64(40)) % np.uint64(bins) if i < bins else np.full(len(s), i - bins, np.uint64)
        value = (np.uint64(i) << np.uint64(52)) | (mix(x) >> np.uint64(12))
        np.minimum.at(out.ravel(), row * bins + at.astype(np.int64), value)
        open_ = (out == _FULL).any(axis=1)
        keep = open_[row]
        s, row = s[keep], row[keep]
    return out


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of coordinates, different between bands."""
    n, bins = sketch.shape
    part = sketch.reshape(n, bins // rows, rows)
    h = np.zeros(part.shape[:2], np.uint64) + np.arange(bins // rows, dtype=np.uint64)
    for r in range(rows):
        h = mix(h + part[:, :, r] * np.uint64(0x9E3779B97F4A7C15))
    return h


def _signatures(k: int, rows: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, counts, s in shingle_sets(batch.column(1), k):
                n = len(counts)
                ends = np.cumsum(counts)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(salt)))]) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                h1, h2 = (x[ends] - x[ends - counts] for x in sums)
                h = bands(sketches(counts, s), rows)
                h[counts == 0] = 0
                width = h.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(h.view(np.int64).ravel()))
                yield pa.record_batch([ids.slice(first, n), pa.array(counts.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists], names=["id", "n", "h1", "h2", "bands"])

    return run


def _links(k: int, percent: int):
    """Confirmed links within a group of nodes that connect what `cluster` (if there) doesn't: a spanning forest of them."""

    def run(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        known = t["cluster"].to_pylist() if "cluster" in t.column_names else None
        sets = []
        for _, counts, s in shingle_sets(t["text"], k):
            sets += np.split(s, np.cumsum(counts)[:-1]) if len(counts) else []
        return pa.table(dict(zip(("u", "v"), (pa.array(x, pa.int64()) for x in forest(ids, sets, percent, known)), strict=True)))

    return run


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links 100 |A & B| >= percent |A | B| among sets of hashes.

    Sets in order of size meet, through an index, only earlier sets that share one of their rarest
    hashes: of a set of n, any n - ceil(percent n / 100) + 1 hashes must hit a set that it is linked with.
    Pairs that are already connected, by earlier links or by one value of `known`, are not looked at again.
    """
    m = len(sets)
    size = np.array([len(x) for x in sets])
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    u, v = [], []
    by_id: dict[int, int] = {}
    for i, x in enumerate(ids.tolist()):  # rows of one id are one document
        if by_id.setdefault(x, i) != i:
            parent[root(i)] = root(by_id[x])
    by_cluster: dict[int, int] = {}
    for i, x in enumerate(known or ()):
        if by_cluster.setdefault(x, i) != i:
            parent[root(i)] = root(by_cluster[x])
    _, rank, often = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    ends = np.cumsum(size)
    order = np.argsort(size, kind="stable").tolist()
    index: dict[int, list[int]] = {}
    here = np.zeros(len(often), bool)
    whole_rank = [rank[ends[i] - size[i] : ends[i]] for i in range(m)]
    for i in order:
        mine, n = whole_rank[i], int(size[i])
        if not n:
            continue
        rare = mine[np.lexsort((mine, often[mine]))][: n - -(-percent * n // 100) + 1].tolist()
        at, tried = root(i), set()
        here[mine] = True
        for r in rare:
            for j in index.get(r, ()):
                if j in tried:
                    continue
                tried.add(j)
                k = root(j)
                if k == at or 100 * int(size[j]) < percent * n:
                    continue
                both = int(np.count_nonzero(here[whole_rank[j]]))
                if 100 * both >= percent * (n + int(size[j]) - both):
                    parent[at] = k
                    at = k
                    u.append(int(ids[i]))
                    v.append(int(ids[j]))
        here[mine] = False
        for r in rare:
            index.setdefault(r, []).append(i)
    return u, v


def _parts(nodes: str, shingles: str, most_nodes: int, most_shingles: int) -> Column:
    """Number of cells or blocks of bounded size that a group is cut into."""
    return F.ceil(F.greatest(F.col(nodes) / F.lit(float(most_nodes)), F.col(shingles) / F.lit(float(most_shingles)))).cast("int")


def _texts_of(source: DataFrame, wanted: DataFrame, most_words: int = 1 << 20) -> DataFrame:
    """source joined to wanted on id = node, with few other texts shuffled.

    A bitmap of hashed nodes, 16 bits a node and at most `most_words` words of 64 bits, is broadcast and drops nearly
    all texts that aren't wanted. Beyond some 10 million nodes it drops fewer, and none is ever lost.
    """
    words = min(most_words, 1 << max(4, (wanted.count() // 4).bit_length()))
    hashed = lambda c: F.xxhash64(F.lit("bitmap"), c)
    word = lambda c: F.shiftrightunsigned(hashed(c), 6).bitwiseAND(F.lit(words - 1))
    bitmap = wanted.groupBy(word("node").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(xxhash64('bitmap', node) & 63 as int))")).alias("__bits"))
    near = source.withColumn("__word", word("id")).join(F.broadcast(bitmap), "__word")
    near = near.filter(F.expr("shiftrightunsigned(__bits, cast(xxhash64('bitmap', id) & 63 as int)) & 1 = 1")).drop("__word", "__bits")
    return near.join(wanted, near["id"] == wanted["node"])


def _cells(members: DataFrame, edges: DataFrame, nodes: int, shingles: int) -> DataFrame:
    """(node, k, part, large): the cells in which links are looked for first; members have (node, n, cc, large)."""
    small = members.filter(~F.col("large")).select("node", F.col("cc").alias("k"), F.lit(0).alias("part"), "large")
    guide = edges.groupBy(F.col("u").alias("node")).agg(F.max_by("v", F.struct("shared", -F.col("v"))).alias("k"))
    guided = members.filter("large").join(guide, "node").select("node", "n", "k")
    hubs = guided.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    hubs = written(hubs.select("k", _parts("m", "s", nodes, shingles).alias("parts")), "hubs")
    own = guided.join(hubs, "k").select("node", "k", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("large"))
    hub = hubs.select(F.col("k").alias("node"), "k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("large"))
    return small.unionByName(own).unionByName(hub)


def _block_pairs(members: DataFrame, clusters: DataFrame, nodes: int, shingles: int) -> DataFrame:
    """(node, cluster, cc, a, b): blocks to compare of components with several clusters; members have (node, n, cc)."""
    placed = members.join(clusters, "node", "left").select("node", "n", "cc", F.coalesce("component", "node").alias("cluster"))
    sizes = written(placed.groupBy("cc", "cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")), "cluster-sizes")
    several = sizes.groupBy("cc").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("cc")
    # Clusters of a block or more are lanes of their own; all others of a component share one lane.
    lane = F.when((F.col("m") >= nodes) | (F.col("s") >= shingles), F.col("cluster").cast("string")).otherwise("")
    laned = written(sizes.join(several, "cc").withColumn("lane", lane), "lanes")
    parts = laned.groupBy("cc", "lane").agg(F.sum("m").alias("m"), F.sum("s").alias("s")).select("cc", "lane", _parts("m", "s", nodes, shingles).alias("parts"))
    lanes = written(parts, "lane-parts")
    number = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    at = placed.join(laned.select("cc", "cluster", "lane"), ["cc", "cluster"]).join(lanes, ["cc", "lane"])
    at = written(at.select("node", "cluster", "cc", F.struct("lane", number.alias("number")).alias("block")), "blocks")
    blocks = lanes.select("cc", "lane", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("number")).select("cc", F.struct("lane", "number").alias("block"))
    a, b = blocks.withColumnRenamed("block", "a"), blocks.withColumnRenamed("block", "b")
    pairs = a.join(b, "cc").filter((F.col("a") <= F.col("b")) & ((F.col("a.lane") != F.col("b.lane")) | (F.col("a.lane") == "")))
    pairs = written(pairs, "block-pairs")
    ends = pairs.select("cc", F.col("a").alias("block"), "a", "b").unionByName(pairs.filter("a != b").select("cc", F.col("b").alias("block"), "a", "b"))
    text = lambda x: F.concat_ws("/", f"{x}.lane", f"{x}.number").alias(x)
    return at.join(ends, ["cc", "block"]).select("node", "cluster", "cc", text("a"), text("b"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 85, cell_nodes: int = 512, cell_shingles: int = 1_000_000, block_nodes: int = 4096, block_shingles: int = 4_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    source = apart(docs, id=id_col, text=text_col)[0].select(F.col("id").cast("long").alias("id"), "text")
    with scratch(docs.sparkSession, "near-dedup"):
        return _labelled(source, k, percent, cell_nodes, cell_shingles, block_nodes, block_shingles)


def _labelled(source: DataFrame, k: int, percent: int, cell_nodes: int, cell_shingles: int, block_nodes: int, block_shingles: int) -> DataFrame:
    signed = written(source.mapInArrow(_signatures(k, ROWS), "id long, n long, h1 long, h2 long, bands array<long>"), "signatures", outer=True)

    some = signed.filter((F.col("n") > 0) & F.col("id").isNotNull())
    keyed = some.groupBy("n", "h1", "h2").agg(F.min("id").alias("node"))
    # Equal sets: the smallest id stands for all.
    nodes = some.select("id", "n", "h1", "h2").distinct().join(keyed, ["n", "h1", "h2"]).select("id", "n", "node")
    nodes = written(nodes, "nodes", outer=True)
    at_node = some.groupBy("n", "h1", "h2").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    entries = at_node.select(F.col("id").alias("node"), F.explode("bands").alias("bucket"))
    hubs = entries.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("most")).filter(F.col("hub") != F.col("most")).select("bucket", "hub")
    hubs = written(hubs, "buckets")  # then AQE may split a bucket with very many nodes
    edges = entries.join(hubs, "bucket").filter(F.col("node") != F.col("hub")).groupBy(F.col("node").alias("u"), F.col("hub").alias("v")).agg(F.count(F.lit(1)).alias("shared"))
    edges = written(edges, "edges")
    # Ids whose rows have different sets hang together through the id.
    split_ids = nodes.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter(F.col("a") != F.col("b"))
    split_ids = split_ids.select(F.col("a").alias("u"), F.col("b").alias("v"))
    candidates = components(edges.select("u", "v").unionByName(split_ids), label="candidates")

    sizes = nodes.groupBy("node").agg(F.max("n").alias("n"))
    members = candidates.join(sizes, "node").withColumnRenamed("component", "cc")
    groups = members.groupBy("cc").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    large = (F.col("m") > cell_nodes) | (F.col("s") > cell_shingles)
    members = written(members.join(groups.select("cc", large.alias("large")), "cc").select("node", "n", "cc", "large"), "members")

    cells = written(_cells(members, edges, cell_nodes, cell_shingles), "cells")
    texts = _texts_of(source, cells).select("id", "text", "k", "part", "large")
    forests = texts.groupBy("k", "part", "large").applyInArrow(_links(k, percent), "u long, v long")
    linked = components(forests.unionByName(split_ids), label="clusters")
    loose = members.filter("large").drop("large")
    if not loose.isEmpty():
        linked = written(linked, "clusters")
        pairs = written(_block_pairs(loose, linked, block_nodes, block_shingles), "compared")
        texts = _texts_of(source, pairs).select("id", "text", "cluster", "cc", "a", "b")
        more = texts.groupBy("cc", "a", "b").applyInArrow(_links(k, percent), "u long, v long")
        linked = components(linked.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), label="links")
    # What the result reads stays; the tables before it go.
    linked = written(linked, "links", outer=True).withColumnRenamed("node", "__linked")

    of_id = nodes.groupBy("id").agg(F.min("node").alias("node"))
    label = of_id.join(linked, of_id["node"] == linked["__linked"], "left").select(F.col("id").alias("__node"), F.coalesce("component", "node").alias("component"))
    out = signed.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"))
    out = out.join(label, (out["doc_id"] == label["__node"]) & (out["n_shingles"] > 0), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END) AS h FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT u AS node, v AS reached FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reached),
c AS (SELECT node, least(node, min(reached)) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""
