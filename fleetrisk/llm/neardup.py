"""Near-duplicate removal with HyperMinHash.

A document's set of word shingles fills one register per hash bucket: the leading-zero
count of the bucket's smallest hash and some mantissa bits behind it. Bands of compressed
registers (empty ones filled from others by a fixed rule) are the candidate keys. Documents
with equal sets are one class; class representatives that share a band are candidates. A candidate pair
passes an estimate of Jaccard corrected for accidental register collisions, then
is confirmed on the full shingle sets. Confirmed links give connected components.

Nothing emits all pairs of a band's documents. First each is compared with its band's hub,
the document that shares most bands with others: the original of a family of copies. Most links then
lie inside components. Pairs across components that still share a band are compared by their registers
in tiles of bounded size, and only those that may be links are emitted and confirmed. No cap
drops a candidate; a family of many documents that are alike but not linked costs comparisons in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm.common import GOLDEN, give_back, mix64, stored, text_slices, window_hashes, words_of
from fleetrisk.llm.decontaminate import bounded

SHINGLE = 5
#: link if 100 * intersection >= percent * union; op1's, where no other is asked for
LINK_PERCENT = 85
REGISTERS = 256
MANTISSA = 10
#: registers of a band, and the chance that a pair at the threshold shares no band: (1 - 0.85**5)**25 < 5e-7
ROWS, MISS = 5, 5e-7
#: standard deviations that the estimate may fall short of the threshold
SLACK = 4.5
#: text bytes handled at once: word hashing holds some 40 bytes for each
SLICE = 1 << 20
#: documents of a band on each side of a tile
TILE = 256
#: rows of a task's tiles, about
TASK_ROWS = 20_000


def shingle_sets(col: pa.Array) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of 5-word shingles; fewer words are one shingle, none is empty."""
    words = words_of(col, lower=True)
    windows = window_hashes(words.hashes, SHINGLE)
    found = []
    for b, e in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if e - b >= SHINGLE:
            found.append(np.unique(windows[b:e - SHINGLE + 1]))
        elif e > b:
            found.append(window_hashes(words.hashes[b:e], e - b) ^ GOLDEN)
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """rows x REGISTERS (uint16): leading zeros, then inverted mantissa bits, plus 1, of each bucket's smallest hash; 0 is empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    if not sizes.sum():
        return out
    hashes = np.concatenate(sets)
    bits = REGISTERS.bit_length() - 1
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    share, exponent = np.frexp((hashes << np.uint64(bits)).astype(np.float64))
    zeros = np.where(share > 0, np.clip(64 - exponent, 0, 64 - bits), 64 - bits)
    mantissa = np.where(share > 0, ((share - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64), 0)
    value = (zeros << MANTISSA | ((1 << MANTISSA) - 1 - mantissa)) + 1
    np.maximum.at(out.reshape(-1), np.repeat(np.arange(len(sets)), sizes) * REGISTERS + bucket, value.astype(np.uint16))
    return out


_DONORS = (mix64(np.arange(REGISTERS * 256, dtype=np.uint64) * GOLDEN + GOLDEN) % np.uint64(REGISTERS)).astype(np.int64).reshape(REGISTERS, 256)


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with each empty one taken from the first non-empty of a fixed sequence of others."""
    out, has = regs.copy(), regs > 0
    row, place = np.nonzero(~has & has.any(axis=1)[:, None])
    for attempt in range(_DONORS.shape[1] + REGISTERS):
        if not len(row):
            break
        donor = _DONORS[place, attempt] if attempt < _DONORS.shape[1] else (place + attempt) % REGISTERS
        ok = has[row, donor]
        out[row[ok], place[ok]] = regs[row[ok], donor[ok]]
        row, place = row[~ok], place[~ok]
    return out


def bands_of(percent: int) -> tuple[int, int]:
    """(bands, rows): the fewest bands that miss a pair at the threshold with a chance below MISS; rows are fewer if registers don't suffice."""
    for rows in range(ROWS, 0, -1):
        share = min((percent / 100) ** rows, 1 - 1e-9)
        bands = math.ceil(math.log(MISS) / math.log1p(-share))
        if bands * rows <= REGISTERS:
            return max(bands, 1), rows
    raise ValueError(f"{REGISTERS} registers are too few for a threshold of {percent} %")


def band_keys(regs: np.ndarray, percent: int = LINK_PERCENT) -> np.ndarray:
    """rows x bands keys (int64) of the filled registers."""
    bands, rows = bands_of(percent)
    used = filled(regs)[:, :bands * rows].reshape(len(regs), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), used.shape[:2]).copy()
    for k in range(rows):
        key = mix64(key * GOLDEN + used[:, :, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """doc_id, text_hash, n, set_a, set_b (128-bit hash of the shingle set), sketch (registers), bands; whole texts, one row each."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
                        ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                sets = shingle_sets(part.column(2))
                regs = registers(sets)
                keys = band_keys(regs, percent)
                sums = np.array([(int(s.sum(dtype=np.uint64)), int(mix64(s ^ GOLDEN).sum(dtype=np.uint64))) for s in sets], np.uint64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(map(len, sets)), pa.int64()), pa.array(sums[:, 0].view(np.int64).copy()),
                                                  pa.array(sums[:, 1].view(np.int64).copy()), pa.array([r.tobytes() for r in regs], pa.binary()), lists], schema=schema)

    text = F.col("text").cast("string")
    return (docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
            .mapInArrow(run, "doc_id long, text_hash long, n long, set_a long, set_b long, sketch binary, bands array<long>"))


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate, registers used) of rows of registers, corrected for accidental collisions.

    Two unrelated minima of a bucket agree if their leading zeros and mantissa do; with
    registers' zeros spread as observed, that is about sum(p(z)**2) / 2**MANTISSA.
    """
    either = (a > 0) | (b > 0)
    used = either.sum(axis=1)
    same = ((a == b) & either).sum(axis=1)
    both = ((a > 0) & (b > 0)).sum(axis=1)
    zeros_a, zeros_b = (np.where(x > 0, (x.astype(np.int64) - 1) >> MANTISSA, -1) for x in (a, b))
    chance = np.zeros(len(a))
    for z in range(int(max(zeros_a.max(initial=0), zeros_b.max(initial=0))) + 1):
        chance += (zeros_a == z).mean(axis=1) * (zeros_b == z).mean(axis=1)
    expected = both * chance / (1 << MANTISSA)
    return np.clip((same - expected) / np.maximum(used - expected, 1e-9), 0, 1), used


def floor_of(used: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int = LINK_PERCENT) -> np.ndarray:
    """The least estimate that a link may show: SLACK deviations below the threshold.

    ``used`` registers are a sample without replacement of the union's shingles.
    """
    limit = percent / 100
    union = np.maximum((sizes_a + sizes_b) / (1 + limit), 1)
    unseen = np.clip(1 - used / union, 0.25, 1)
    return limit - SLACK * np.sqrt(limit * (1 - limit) / np.maximum(used, 1) * unseen) - 0.01


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def likely(pairs: DataFrame, nodes: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """The pairs (a, b) whose estimate a link may show."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                found, used = estimate(_regs(batch.column(2)), _regs(batch.column(3)))
                sizes = (batch.column(k).to_numpy() for k in (4, 5))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(found >= floor_of(used, *sizes, percent)))
        give_back()

    left, right = (nodes.select(F.col("node").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def tile_pairs(key: int, node: np.ndarray, component: np.ndarray, side: np.ndarray, regs: np.ndarray, sizes: np.ndarray,
               keys: np.ndarray, percent: int = LINK_PERCENT) -> np.ndarray:
    """Likely pairs (rows of two nodes) across components in one tile of the band ``key``.

    side: 0 or 1; where both occur, pairs have one node of each side. A pair that shares an
    earlier band too is left to that one. Accidental register matches only raise the
    raw share, so it rules pairs out before the corrected estimate.
    """
    both_sides = side.min() != side.max()
    limit = percent / 100
    has = (regs > 0).astype(np.float32)
    count = has.sum(axis=1)
    found = []
    for i in range(len(node) - 1):
        rest = np.flatnonzero(component[i + 1:] != component[i]) + i + 1
        if both_sides:
            rest = rest[side[rest] != side[i]]
        rest = rest[(limit * sizes[rest] <= sizes[i] + 1e-9) & (limit * sizes[i] <= sizes[rest] + 1e-9)]
        equal = keys[rest] == keys[i]
        rest = rest[keys[i][equal.argmax(axis=1)] == key]
        if not len(rest):
            continue
        used = count[rest] + count[i] - has[rest] @ has[i]
        same = ((regs[rest] == regs[i]) & (regs[i] > 0)).sum(axis=1)
        rest = rest[same >= used * floor_of(used, sizes[rest], sizes[i], percent)]
        if len(rest):
            close, used = estimate(regs[rest], np.broadcast_to(regs[i], (len(rest), REGISTERS)))
            rest = rest[close >= floor_of(used, sizes[rest], sizes[i], percent)]
            found.append(np.stack([np.minimum(node[rest], node[i]), np.maximum(node[rest], node[i])], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def across(placed: DataFrame, nodes: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """Likely pairs (a, b) of different components that share a band of three documents or more.

    placed: key, node, component. A band's documents are dealt into tiles by a hash of
    the node; each goes to the tiles of its number and every other. (A band of two was
    compared with its hub.)
    """
    bands = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where(
        "low < high and size > 2").select("key", _dealt("key"), F.ceil(F.col("size") / TILE).alias("tiles"))
    mixed = placed.withColumn("half", F.shiftright(F.col("key"), 1)).join(bands, ["key", "half"]).select("key", "node", "component", "tiles")
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    dealt = mixed.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    tile = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = stored(dealt.select("key", "node", "component", tile.alias("tile"), (F.col("own") > F.col("other")).cast("int").alias("side")), "tiles")
    tasks = 1 + dealt.count() // TASK_ROWS
    rows = dealt.join(nodes.select("node", "sketch", "n"), "node").withColumn("task", F.pmod(F.col("tile"), F.lit(tasks)))

    def compare(table: pa.Table) -> pa.Table:
        key, node, component, tile, side, sizes = (table.column(k).to_numpy() for k in ("key", "node", "component", "tile", "side", "n"))
        regs = _regs(table.column("sketch"))
        keys = band_keys(regs, percent)
        order = np.argsort(tile, kind="stable")
        first = np.flatnonzero(np.diff(tile[order], prepend=tile[order[:1]] - 1))
        found = [tile_pairs(key[own[0]], *(x[own] for x in (node, component, side, regs, sizes, keys)), percent) for own in np.split(order, first[1:])]
        pairs = np.concatenate(found)
        give_back()
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return rows.groupBy("task").applyInArrow(compare, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are alike; texts: node, text."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in text_slices(batch, "x", SLICE):
                sets = []
                for id_at, text_at in ((0, 2), (1, 3)):
                    _, first, back = np.unique(part.column(id_at).to_numpy(), return_index=True, return_inverse=True)
                    own = shingle_sets(part.column(text_at).take(pa.array(first)))
                    sets.append([own[k] for k in back.tolist()])
                keep = []
                for x, y in zip(*sets, strict=True):
                    # both are sorted and distinct
                    shared = int(np.count_nonzero(np.diff(np.sort(np.concatenate([x, y]), kind="stable")) == 0))
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over the undirected edges (a, b), of each node with an edge.

    Rounds contract the graph: every node joins its smallest neighbour, edges inside a
    new node vanish. Each round at least halves the nodes that still have edges.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "parents")
        # a parent may itself move on in the same round; two more steps shorten chains
        for _ in range(2):
            up = parent.select(F.col("node").alias("to"), F.col("to").alias("up"))
            parent = parent.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("to"))
        parent = stored(parent, "parents")
        moved = parent.select(F.col("node").alias("a"), F.col("to").alias("x"))
        moved_b = parent.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = stored(left.join(moved, "a").join(moved_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if labels is None:
            labels = parent.withColumnRenamed("to", "component")
        else:
            again = parent.select(F.col("node").alias("component"), "to")
            labels = stored(labels.join(again, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)


def _dealt(key: str):
    """A second join column, so that a side grouped by ``key`` is dealt anew and AQE can split a hot key."""
    return F.shiftright(F.col(key), 1).alias("half")


def links(nodes: DataFrame, docs: DataFrame, percent: int = LINK_PERCENT) -> tuple[DataFrame, DataFrame]:
    """(edges, labels) among class representatives.

    nodes: node, n, sketch, bands; docs: doc_id, text of at least these nodes.
    """
    rows = nodes.select(F.explode("bands").alias("key"), "node")
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key", _dealt("key"), "size")
    members = stored(rows.select("key", "node", _dealt("key")).join(shared, ["key", "half"]).select("key", "node", "size"), "bands")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = members.select("key", "node").join(degree, "node")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub")).select("key", _dealt("key"), F.col("hub.node").alias("hub"))
    pairs = members.select("key", "node", _dealt("key")).join(hubs, ["key", "half"]).where("node <> hub").select(
        F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    edges = confirmed_links(stored(likely(pairs, nodes, percent), "likely"), docs, percent)
    labels = components(edges)
    placed = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    more = confirmed_links(stored(across(stored(placed, "placed"), nodes, percent), "likely"), docs, percent)
    if not more.isEmpty():
        edges = stored(edges.unionByName(more).distinct(), "links")
        labels = components(edges)
    return edges, labels


def confirmed_links(close: DataFrame, docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """Links among likely pairs (a, b), confirmed on whole texts."""
    needed = close.select(F.col("a").alias("doc_id")).unionByName(close.select(F.col("b").alias("doc_id"))).distinct()
    texts = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(bounded(needed), "doc_id").select(
        F.col("doc_id").alias("node"), "text").distinct(), "texts")
    return stored(confirmed(close, texts, percent).distinct(), "links")


def near_duplicates(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept, text_hash.

    percent: two sets are linked from this Jaccard similarity on; bands, size filter, floor of
    the estimate and confirmation follow it.
    docs: doc_id, text; other columns are ignored. A null, empty or blank text has no
    shingles and is alone. Rows that share a doc_id are one document: their links
    add up. Rows without a doc_id join the component of an equal set but are not
    compared otherwise (component_id null if none, kept then). An empty table gives no rows.
    Very long texts are sketched whole; links are confirmed on their full sets.
    """
    base = stored(sketches(docs, percent), "sketches")
    same = ["set_a", "set_b", "n"]
    groups = base.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = stored(groups.where("node is not null"), "nodes")
    labels = links(nodes, docs, percent)[1]
    named = nodes.select(*same, "node").join(labels, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id"))
    # joined on more than the grouping keys, so a hot class can be split
    out = base.drop("sketch", "bands").join(named, same, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False) | component.isNull()).alias("kept"), "text_hash")


def keep_one(docs: DataFrame, percent: int = LINK_PERCENT) -> DataFrame:
    """``docs`` with one row of each component: its smallest doc_id's, once if that row is repeated.

    Keys (doc_id, text hash) of the rows to remove are joined, not texts.
    """
    found = stored(near_duplicates(docs, percent).select("doc_id", "text_hash", "kept"), "kept")
    keys = found.groupBy("doc_id", "text_hash").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    clash = [c for c in docs.columns if c in ("__id", "__hash", "__kept")]
    if clash:
        docs = docs.withColumnsRenamed({c: f"__own{c}" for c in clash})
    odd = stored(keys.where("not kept or n > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("kept").alias("__kept")), "removed")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__hash"))
    rest = docs.join(bounded(odd), same, "left_anti")
    if not odd.where("__kept").isEmpty():
        repeated = docs.join(bounded(odd.where("__kept")), same).dropDuplicates(["__id", "__hash"]).select(*docs.columns)
        rest = rest.unionByName(repeated)
    return rest.withColumnsRenamed({f"__own{c}": c for c in clash})


#: links of all pairs of distinct sets that share a shingle, and what they reach
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5
    THEN list_transform(range(0, len(w) - 4), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d),
nodes AS MATERIALIZED (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
each AS (SELECT node, n, unnest(s) AS g FROM nodes),
pairs AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
          FROM each a JOIN each b ON a.g = b.g AND a.node < b.node GROUP BY a.node, b.node),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)),
edge AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT DISTINCT a, a FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT x.doc_id, CAST(len(x.s) AS BIGINT) AS n_shingles, coalesce(c.component, nd.node, x.doc_id) AS component_id,
       x.doc_id = coalesce(c.component, nd.node, x.doc_id) AS kept
FROM sets x LEFT JOIN nodes nd ON nd.s = x.s LEFT JOIN comp c ON c.node = nd.node
"""
