"""Benchmark decontamination over a positional inverted index, with DataFrame operations only.

The index stores the postings (document, term, position) of every benchmark term in
the training texts, and one end posting per document. For each benchmark window, the
postings of its two rarest terms are shifted by their offsets and intersected; the
surviving starts are confirmed term by term against the candidates' postings. So
common terms cost their storage, and are matched in candidate documents alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.llm.common import stored
from fleetrisk.operators.joins import measured_bytes

WINDOW = 13
#: words by which a term may lie off its place in a proximity match
SLOP = 2
#: a document is contaminated if at least one word in so many is hit
SHARE = 20
#: a side is broadcast only if it has at most so many rows and, measured as text, so many bytes; beyond, the join shuffles
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 48 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: words are the runs of these after lower-casing A-Z: digits, a-z and all that isn't ASCII
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: the term of end postings; no word holds a control character
END = "\x01"


def bounded(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its counted rows and measured bytes stay within the bounds."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS and measured_bytes(df) <= BROADCAST_BYTES else df


def words(text):
    """Array of words; its first and last entry may be empty."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.split(lowered, SEPARATORS, -1)


def word_count(split):
    n = F.size(split)
    return F.when(n == 1, F.when(split[0] == "", 0).otherwise(1)).otherwise(
        n - F.when(split[0] == "", 1).otherwise(0) - F.when(F.element_at(split, -1) == "", 1).otherwise(0))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows, items): each distinct window's id and words, and the item ids of each window.

    benchmark: item_id, text. An item of fewer words than ``size`` is one window; one
    without words has none. Repeated items give their windows once.
    """
    split = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             F.array_remove(words(F.coalesce(F.col("text").cast("string"), F.lit(""))), "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    cut = split.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, size))).alias("words"))
    windows = stored(cut.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    items = cut.join(windows, "words").select("wid", "item_id").distinct()
    return windows, items


def build_index(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, vocabulary). Index rows: rid, doc_id, text_hash, term, pos; term 0 at pos n_words ends a document.

    docs: doc_id, text. rid numbers the rows, so repeated rows and ids stay apart. Only
    terms of the benchmark are stored: no other can be part of a match.
    """
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    vocabulary = stored(vocabulary.withColumn("term", F.monotonically_increasing_id() + 1), "terms")
    vocabulary = vocabulary.unionByName(vocabulary.sparkSession.createDataFrame([(END, 0)], "word string, term long"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = (docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), words(text).alias("split"))
             .withColumn("rid", F.monotonically_increasing_id()))
    split = split.withColumn("n_words", word_count(F.col("split")).cast("int"))
    each = split.select("rid", "doc_id", "text_hash", "n_words", F.posexplode(F.concat("split", F.array(F.lit(END)))).alias("pos", "word"))
    index = each.join(bounded(vocabulary), "word").select(
        "rid", "doc_id", "text_hash", F.col("term"), F.when(F.col("term") == 0, F.col("n_words")).otherwise(F.col("pos")).alias("pos"))
    return stored(index, "index"), vocabulary


def window_terms(index: DataFrame, vocabulary: DataFrame, windows: DataFrame) -> DataFrame:
    """wid, size, off, term, n, rarity: terms of the windows all of whose terms the index has, rarest first."""
    counts = index.where("term > 0").groupBy("term").agg(F.count("*").alias("n"))
    known = vocabulary.join(counts, "term")
    terms = windows.select("wid", F.size("words").alias("size"), F.posexplode("words").alias("off", "word")).join(known, "word")
    own = Window.partitionBy("wid")
    return stored(terms.withColumn("present", F.count("*").over(own)).where("present = size")
                  .withColumn("rarity", F.row_number().over(own.orderBy("n", "off")))
                  .select("wid", "size", "off", "term", "n", "rarity"), "window-terms")


def shifted(index: DataFrame, terms: DataFrame, rarity: int) -> DataFrame:
    """Offset-adjusted postings (rid, wid, start) of the windows' term of that rarity."""
    probes = bounded(terms.where(F.col("rarity") == rarity).select("wid", "size", "off", "term"))
    return index.join(probes, "term").select("rid", "wid", "size", (F.col("pos") - F.col("off")).alias("start"))


def phrase_matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Every occurrence of a window: rid, wid, size, start."""
    first = shifted(index, terms, 1).where("start >= 0")
    second = shifted(index, terms, 2).select("rid", "wid", "start")
    starts = stored(first.where("size = 1").unionByName(first.where("size > 1").join(second, ["rid", "wid", "start"], "left_semi")
                                                         .select(*first.columns)), "starts")
    candidates = bounded(starts.select("rid").distinct())
    near = index.where("term > 0").join(candidates, "rid", "left_semi").select("rid", "term", "pos")
    needed = starts.join(bounded(terms.select("wid", "off", "term")), "wid").select(
        "rid", "wid", "size", "start", "term", (F.col("start") + F.col("off")).alias("pos"))
    return (needed.join(near, ["rid", "pos", "term"]).groupBy("rid", "wid", "size", "start").agg(F.count("*").alias("n"))
            .where("n = size").drop("n"))


def proximity_matches(index: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """rid, wid, start: places where every term of a window lies within ``slop`` words of where the phrase has it.

    start: where the window's rarest term puts its first word. The lists of the two rarest terms are
    intersected first, the second one's postings sent to each start they allow; the places left are
    confirmed term by term against the candidates' postings, as phrases are.
    """
    around = lambda at: F.explode(F.sequence(at - slop, at + slop))
    first = shifted(index, terms, 1)
    second = shifted(index, terms, 2).select("rid", "wid", around(F.col("start")).alias("start"))
    starts = stored(first.where("size = 1").unionByName(first.where("size > 1").join(second, ["rid", "wid", "start"], "left_semi")
                                                         .select(*first.columns)), "near-starts")
    candidates = bounded(starts.select("rid").distinct())
    postings = index.where("term > 0").join(candidates, "rid", "left_semi").select("rid", "term", "pos")
    needed = starts.join(bounded(terms.select("wid", "off", "term")), "wid").select(
        "rid", "wid", "size", "start", "off", "term", around(F.col("start") + F.col("off")).alias("pos"))
    return (needed.join(postings, ["rid", "pos", "term"]).groupBy("rid", "wid", "size", "start").agg(F.collect_set("off").alias("offs"))
            .where(F.size("offs") == F.col("size")).select("rid", "wid", "start"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    With ``slop`` also n_near, the proximity matches (window and start; phrases are among them), and
    n_near_items, the items they belong to; they don't decide on contamination.
    A null or empty text has no words and is clean. With an empty benchmark nothing is hit. A very long
    text is postings like any other, and only those of benchmark terms are kept.
    Other columns of either table are ignored, whatever their names.
    """
    windows, items = benchmark_windows(benchmark, size)
    index, vocabulary = build_index(docs, windows)
    terms = window_terms(index, vocabulary, windows)
    matches = stored(phrase_matches(index, terms), "matches")
    hit = (matches.select("rid", "start", "size").distinct()
           .select("rid", F.explode(F.expr("sequence(start, start + size - 1)")).alias("pos")).distinct()
           .groupBy("rid").agg(F.count("*").alias("n_hit")))
    found = (matches.select("rid", "wid").distinct().join(bounded(items), "wid").groupBy("rid")
             .agg(F.sort_array(F.collect_set("item_id")).alias("found")))
    base = index.where("term = 0").select("rid", "doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    joined = base.join(hit.join(found, "rid"), "rid", "left")
    reports = []
    if slop is not None:
        near = stored(proximity_matches(index, terms, slop), "near")
        of_items = near.select("rid", "wid").distinct().join(bounded(items), "wid").select("rid", "item_id").distinct()
        counted = near.groupBy("rid").agg(F.count("*").alias("n_near")).join(
            of_items.groupBy("rid").agg(F.count("*").alias("n_near_items")), "rid")
        joined = joined.join(counted, "rid", "left")
        reports = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_near", "n_near_items")]
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return joined.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"),
                         F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_items"),
                         F.sha2(F.coalesce(F.array_join("found", ","), F.lit("")), 256).alias("items_sha256"),
                         ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"), *reports)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, with the columns it had."""
    clash = [c for c in docs.columns if c in ("__bad_id", "__bad_text")]
    if clash:
        docs = docs.withColumnsRenamed({c: f"__own{c}" for c in clash})
    bad = stored(contamination(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_text")).distinct(), "contaminated")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__bad_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__bad_text"))
    return docs.join(bounded(bad), same, "left_anti").withColumnsRenamed({f"__own{c}": c for c in clash})


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(0, greatest(1, len(w) - 12)),
         lambda i: array_to_string(list_slice(w, i + 1, i + 13), ' '))) AS win
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, unnest(range(0, len(w) - n + 1)) AS s, w FROM d, sizes WHERE len(w) >= n),
occ AS (
  SELECT DISTINCT dw.rid, dw.s, dw.n, bw.item_id
  FROM dw JOIN bw ON bw.n = dw.n AND bw.win = array_to_string(list_slice(dw.w, dw.s + 1, dw.s + dw.n), ' ')),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, list_sort(list(DISTINCT item_id)) AS ids FROM occ GROUP BY rid),
terms AS (SELECT win, n, unnest(string_split(win, ' ')) AS term, unnest(range(0, n)) AS off FROM (SELECT DISTINCT win, n FROM bw)),
p AS (SELECT rid, term, pos FROM (SELECT rid, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d)
      WHERE term IN (SELECT term FROM terms)),
seen AS (SELECT term, count(*) AS c FROM p GROUP BY term),
rarest AS (SELECT win, n, term, off FROM terms JOIN seen USING (term) QUALIFY row_number() OVER (PARTITION BY win ORDER BY c, off) = 1),
near AS (
  SELECT a.rid, a.win, a.start
  FROM (SELECT p.rid, r.win, r.n, p.pos - r.off AS start FROM rarest r JOIN p USING (term)) a
  JOIN terms t ON t.win = a.win
  JOIN p ON p.rid = a.rid AND p.term = t.term AND p.pos BETWEEN a.start + t.off - 2 AND a.start + t.off + 2
  GROUP BY a.rid, a.win, a.n, a.start HAVING count(DISTINCT t.off) = a.n),
n1 AS (SELECT rid, count(*) AS n_near FROM near GROUP BY rid),
n2 AS (SELECT rid, count(DISTINCT item_id) AS n_near_items FROM near JOIN bw USING (win) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid) LEFT JOIN n1 USING (rid) LEFT JOIN n2 USING (rid)
"""
