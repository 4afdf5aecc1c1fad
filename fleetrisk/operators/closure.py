"""Supersedence reachability: an index of distinct edge sets, presence without roots, roots on demand.

Hosts that asked for the same product and months got the same KB entries, so their
supersedence edges are equal. A scan's edge set has a fingerprint (its size and two 64-bit hashes
of its edges, exclusive-or'ed), and each distinct set, a *graph*, is kept and closed once. Scans of one
graph whose installed KBs that replace something are equal too share a *profile*.

* Presence (``Reachability.present``) spreads (profile, KB): a KB is reached or not, whichever
  installed KB it comes from. The work is linear in reached KBs and their edges.
* Roots (``Reachability.roots_of``) spread (graph, root, KB) and cost that many pairs; only output
  that prints the replacing KBs asks for them.

Both are the fixpoint ``spread``. Spark's recursive CTE only takes UNION ALL and stops at a recursion
limit on a cycle, so it is a driver loop of DataFrame jobs. One job makes HOPS hops, each deduplicated
before the next and kept (a hop is read by the next one and by the union, and would be run again for each),
then drops what was reached before. Edges are broadcast if their measured bytes stay
within the bound; beyond it they and the reached rows are cached, hash-partitioned on their join
keys, so a job shuffles new rows only. Every job's result is saved as Parquet to the shared
folder (a checkpoint would run the job twice and hold several times the bytes): a lost executor recomputes one job at most. The driver sees one row count per job.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetrisk.functions.ids import normalise_id
from fleetrisk.operators import joins

MAX_JOBS = 10_000
MERGE_EVERY = 8
HOPS = 8


def edges_from_entries(kb_entry: DataFrame, scan_col: str = "scan_id") -> DataFrame:
    """(scan_id, src, dst): KB src replaces KB dst; ids normalised, blanks dropped."""
    e = kb_entry.select(scan_col, normalise_id("kb_id").alias("src"), F.explode("supersedes").alias("dst"))
    e = e.withColumn("dst", normalise_id("dst"))
    return e.where((F.col("src") != "") & F.col("dst").isNotNull() & (F.col("dst") != "")).distinct()


def _co_partitioned(df: DataFrame, n: int, keys: list[str]) -> tuple[DataFrame, int]:
    """Hash-partition on ``keys`` into ``n`` parts, sorted on them, cache (memory, spilling to disk),
    build the cache and return it with its row count.

    A cached scan keeps its hash partitioning and its order once built, so a later merge join on
    ``keys`` reads it without a shuffle and without a sort (a checkpointed frame does not keep them):
    a hop sorts its own rows only, not all edges again.
    ``df`` is always saved to the shared folder, so lost blocks are recomputed from it.
    """
    out = df.repartition(n, *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
    return out, out.count()


def fingerprint(*cols: str) -> Column:
    """Aggregate: the same text for equal sets of (distinct) rows, whatever their order; 128 bits of hash."""
    hashes = [F.hex(F.bit_xor(F.xxhash64(*cols, F.lit(seed)))) for seed in (1, 2)]
    return F.concat_ws("-", F.count(F.lit(1)).cast("string"), *hashes)


def spread(frontier: DataFrame, edges: DataFrame, carry: list[str], hops: int = HOPS, merge_every: int = MERGE_EVERY,
           max_jobs: int = MAX_JOBS, broadcast_bytes: int | None = None) -> DataFrame:
    """(graph, *carry, kb_id): every KB that one edge or more lead to from a row of ``frontier`` (of the same columns).

    edges: graph, src, dst (distinct). Cycle-safe: a row is expanded once; a start on a cycle
    reaches itself. Jobs = longest shortest path / ``hops`` + 1.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = ["graph", *carry, "kb_id"]
    steps = joins.saved(edges.select("graph", F.col("src").alias("kb_id"), "dst"))
    bound = joins.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    small = joins.measured_bytes(steps) <= bound
    steps = F.broadcast(steps) if small else _co_partitioned(steps, n, ["graph", "kb_id"])[0]
    cached, blocks, found = [] if small else [steps], [], []
    frontier = frontier.select(*row)
    try:
        for _ in range(max_jobs):
            reached, at, kept = [], frontier, []
            for hop in range(1, hops + 1):
                at = at.join(steps, ["graph", "kb_id"]).select("graph", *carry, F.col("dst").alias("kb_id")).distinct()
                at = at.persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(at)
                reached.append(at.withColumn("hop", F.lit(hop)))
            cached += kept
            new = reduce(DataFrame.unionByName, reached).groupBy(*row).agg(F.min("hop").alias("hop"))
            for block in blocks:
                new = new.join(block, row, "left_anti")
            new = joins.saved(new)
            for frame in kept:
                frame.unpersist()
            last = new.where(F.col("hop") == hops).select(*row)  # all others were expanded in this job
            found.append(new.select(*row))
            if last.isEmpty():
                return reduce(DataFrame.unionByName, found)
            blocks.append(_co_partitioned(found[-1], n, row)[0])
            cached.append(blocks[-1])
            if len(blocks) >= merge_every:  # one block from the jobs' saved rows
                for block in blocks:
                    block.unpersist()
                blocks = [_co_partitioned(reduce(DataFrame.unionByName, found), n, row)[0]]
                cached.append(blocks[0])
            frontier = last
        raise RuntimeError(f"closure did not converge in {max_jobs} jobs")
    finally:
        for c in cached:
            c.unpersist()


class Reachability:
    """What installed KBs replace, transitively, in each scan; computed on first use.

    edges: (scan, src, dst); installed: (scan, kb_id), both normalised. Options go to ``spread``.
    """

    def __init__(self, edges: DataFrame, installed: DataFrame, scan_col: str = "scan_id", **options):
        self.scan_col, self.options = scan_col, options
        self._edges, self.installed = edges, installed

    @cached_property
    def _scan_edges(self) -> DataFrame:
        return joins.saved(self._edges.distinct())

    @cached_property
    def graph_of(self) -> DataFrame:
        """(scan, graph): equal edge sets have equal graphs, named by their first scan; scans without edges have none."""
        marks = joins.saved(self._scan_edges.groupBy(self.scan_col).agg(fingerprint("src", "dst").alias("_print")))
        first = marks.groupBy("_print").agg(F.min(self.scan_col).alias("graph"))
        return joins.saved(marks.join(first, "_print").select(self.scan_col, "graph"))

    @cached_property
    def edges(self) -> DataFrame:
        """(graph, src, dst): each distinct edge set once, taken from its first scan."""
        first = self.graph_of.select(F.col("graph").alias(self.scan_col), "graph").distinct()
        return joins.saved(self._scan_edges.join(first, self.scan_col).select("graph", "src", "dst"))

    @cached_property
    def _roots(self) -> DataFrame:
        """(scan, graph, kb_id): installed KBs that replace something in their scan."""
        sources = self._scan_edges.select(self.scan_col, F.col("src").alias("kb_id")).distinct()
        own = self.installed.select(self.scan_col, "kb_id").distinct().join(sources, [self.scan_col, "kb_id"], "left_semi")
        return joins.saved(own.join(self.graph_of, self.scan_col))

    @cached_property
    def profile_of(self) -> DataFrame:
        """(scan, graph, profile): scans of one profile, named by its first, have the same graph and the same roots."""
        marks = joins.saved(self._roots.groupBy(self.scan_col, "graph").agg(fingerprint("kb_id").alias("_print")))
        first = marks.groupBy("graph", "_print").agg(F.min(self.scan_col).alias("profile"))
        return joins.saved(marks.join(first, ["graph", "_print"]).select(self.scan_col, "graph", "profile"))

    @cached_property
    def profile_roots(self) -> DataFrame:
        """(graph, profile, kb_id): the roots of each profile once, from its first scan."""
        first = self.profile_of.select(F.col("profile").alias(self.scan_col), "profile").distinct()
        return joins.saved(self._roots.join(first, self.scan_col).select("graph", "profile", "kb_id"))

    @cached_property
    def _present(self) -> DataFrame:
        """(graph, profile, kb_id): KBs reached in each profile."""
        return spread(self.profile_roots, self.edges, ["profile"], **self.options)

    @cached_property
    def _pairs(self) -> DataFrame:
        """(graph, root_kb, kb_id): what each root reaches, once per graph."""
        starts = self._roots.select("graph", F.col("kb_id").alias("root_kb"), "kb_id").distinct()
        return spread(starts, self.edges, ["root_kb"], **self.options)

    def reached(self) -> DataFrame:
        """(scan, kb_id): KBs that an installed KB replaces, without asking which."""
        return self.profile_of.select(self.scan_col, "profile").join(self._present.select("profile", "kb_id"), "profile").select(self.scan_col, "kb_id")

    def present(self) -> DataFrame:
        """(scan, kb_id): installed KBs plus every KB an installed KB replaces, transitively."""
        return self.installed.select(self.scan_col, "kb_id").unionByName(self.reached()).distinct()

    def pairs(self) -> DataFrame:
        """(scan, root_kb, kb_id): every installed root and every KB it replaces."""
        roots = self._roots.withColumnRenamed("kb_id", "root_kb")
        return roots.join(self._pairs, ["graph", "root_kb"]).select(self.scan_col, "root_kb", "kb_id")

    def roots_of(self) -> DataFrame:
        """(scan, kb_id, replaced_by): per reached KB the sorted roots, gathered once per profile."""
        roots = self.profile_roots.withColumnRenamed("kb_id", "root_kb")
        lists = roots.join(self._pairs, ["graph", "root_kb"]).groupBy("profile", "kb_id").agg(F.array_sort(F.collect_set("root_kb")).alias("replaced_by"))
        return self.profile_of.select(self.scan_col, "profile").join(lists, "profile").select(self.scan_col, "kb_id", "replaced_by")


def closure(edges: DataFrame, roots: DataFrame, scan_col: str = "scan_id", **options) -> DataFrame:
    """All (scan, root_kb, kb_id) with kb reachable from an installed root by >= 1 edge.

    ``roots`` is (scan_id, kb_id).
    """
    inst = roots.select(scan_col, normalise_id("kb_id").alias("kb_id")).where(F.col("kb_id") != "")
    return Reachability(edges, inst, scan_col, **options).pairs()
