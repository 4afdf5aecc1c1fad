"""SpotSigs fingerprints, with DataFrame operations only.

A spot is a common word; its signature is the word with the next content words (words
that aren't common), common words in between passed over. A text's fingerprint is the multiset of
its signatures' hashes, kept as a set: later occurrences are hashed with their number. Sets are compared by Jaccard; ``similar_sets`` partitions them by length, so
that only sets whose sizes allow the similarity meet, and joins on rarest signatures.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.llm.common import stored

#: common words of the four languages, as anchors
ANCHORS = """a an and are as at be by for from has have he in is it its of on or that the this to was were which with you
das dem den der des die ein eine einer für ist mit nicht sich sie und von zu auf auch im
al con de del el en es la las lo los no para por que se su un una y
au aux avec ce dans des du elle est et être il le les ne par pas pour qui sur une""".split()
CHAIN = 2
#: texts with fewer spots take the pairs of adjacent words as well
FEW_SPOTS = 4
#: of consecutive doc_ids that share a window partition, about
ROWS_PER_RANGE = 512
#: numbers that reach the driver at most, as bounds of ranges; a range of 100 TB of texts is then 1.6 GB, which its window may spill
MAX_RANGES = 65_536
_FIRST = -(1 << 63)


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` and column ``out``: the sorted distinct signature hashes (int) of column ``text``; a text without words has none."""
    m, s, r, w, a, b = (f"__{out}_{k}" for k in ("marked", "spots", "rest", "words", "all", "starts"))
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    anchor = r" +(" + "|".join(sorted(set(ANCHORS))) + r")(?= )"
    df = df.withColumn(m, F.regexp_replace(plain, anchor, "\x01$1"))
    df = df.withColumn(s, F.split(F.col(m), "\x01", -1))
    df = df.withColumn(r, F.transform(s, lambda x: F.substr(x, F.char_length(F.substring_index(x, " ", 1)) + 1)))
    following = lambda i, k: F.coalesce(F.get(F.col(r), i + k), F.lit(""))
    chains = F.transform(s, lambda x, i: F.when(i > 0, F.hash(F.substring_index(
        F.regexp_replace(F.concat(x, *[following(i, k) for k in range(1, CHAIN + 1)]), " +", " "), " ", CHAIN + 1))))
    df = df.withColumn(w, F.when(F.size(s) <= FEW_SPOTS, F.filter(F.split(F.translate(m, "\x01", " "), " +"), lambda x: x != "")))
    pairs = F.coalesce(F.transform(w, lambda x, i: F.hash(x, F.coalesce(F.get(F.col(w), i + 1), F.lit("")))), F.array().cast("array<int>"))
    df = df.withColumn(a, F.sort_array(F.array_compact(F.concat(chains, pairs))))
    # occurrences of one signature are told apart, so that sets compare like multisets
    df = df.withColumn(b, F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(F.col(a), i - 1)), i)), lambda i: i.isNotNull()))
    runs = F.transform(b, lambda p, j: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(F.col(b), j + 1), F.size(a)) - p - 1),
                                                   lambda k: F.when(k == 0, F.get(F.col(a), p)).otherwise(F.hash(F.get(F.col(a), p), k))))
    return df.withColumn(out, F.sort_array(F.array_distinct(F.flatten(runs)))).drop(m, s, r, w, a, b)


def likeness(a, b):
    """Jaccard of two signature sets; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def written(signatures):
    """A set as text: eight hex digits for each hash, in order."""
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.right(F.concat(F.lit("0000000"), F.hex(x)), F.lit(8)))), "")


def _ranges(docs: DataFrame, rows_per_range: int) -> list[int]:
    """Sorted doc_ids that cut the table into ranges of about as many rows; the first is the smallest.

    At most MAX_RANGES numbers reach the driver; their ranks are exact to a sixteenth of a range or better.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))
    found = docs.agg(F.min(key).alias("least"), F.count("*").alias("n")).first()
    if not found["n"]:
        return []
    ranges = max(1, min(MAX_RANGES, found["n"] // rows_per_range))
    cuts = docs.agg(F.percentile_approx(key, [k / ranges for k in range(ranges)], max(100_000, 16 * ranges)).alias("cuts")).first()["cuts"]
    return sorted({found["least"], *cuts})


def _constant(numbers: list[int]):
    """An array literal of any size, as one expression."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def _range_of(key, cuts: list[int]):
    """How many of the sorted ``cuts`` are at most ``key``: counted among every so many of them, then in the stretch found."""
    width = math.isqrt(len(cuts)) + 1
    upto = lambda bounds: F.size(F.filter(bounds, lambda b: b <= key))
    before = (F.greatest(upto(_constant(cuts[::width])), F.lit(1)) - 1) * width
    return before + upto(F.slice(_constant(cuts), before + 1, width))


def edited_pairs(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Each document row with its edited text's and its next document's signatures.

    docs: doc_id, text (null: empty); rows are in the order of doc_id, null first, and of
    the text's hash where ids tie; the last is followed by the first. Rows are dealt into
    ranges of doc_id; the first row of each range is also sent to the range before it.
    Very long texts are taken whole, like any other.
    """
    cuts = _ranges(docs, rows_per_range)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"))
    cuts = cuts or [_FIRST]
    own = _range_of(F.col("key"), cuts)
    first_of_range = F.element_at(_constant(cuts), own) == F.col("key")
    place = lambda at, wraps, guard: F.struct(at.alias("at"), F.lit(wraps).alias("wraps"), F.lit(guard).alias("guard"))
    places = F.when(~first_of_range, F.array(place(own, False, False))).when(
        own > 1, F.array(place(own, False, False), place(own - 1, False, True))).otherwise(
        F.array(place(own, False, False), place(F.lit(max(1, len(cuts))), True, True)))
    dealt = rows.select("*", F.inline(places)).withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("at").orderBy("wraps", "key", "tie", "guard")
    dealt = dealt.withColumn("next_text", F.lead("text").over(order))
    n, follows = F.char_length("text"), F.coalesce(F.col("next_text"), F.lit(""))
    quarter = F.floor(n / 4).cast("int")
    dealt = dealt.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substr("text", F.lit(1), n - quarter), F.substr(follows, F.lit(1), quarter))).drop("next_text")
    dealt = with_signatures(dealt, "text", "own").drop("text")
    dealt = with_signatures(dealt, "edited", "changed").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    return dealt.withColumn("next", F.lead("own").over(order)).where(~F.col("guard")).select(
        "doc_id", "n_chars", "edited_sha256", "own", "changed", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's rows. An empty table gives none; a single document follows itself."""
    return edited_pairs(docs).select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
        F.size("own").cast("long").alias("set_length"))


def similar_sets(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness): classes of equal signature sets that are alike by ``threshold``; with ``classes`` for membership.

    docs: doc_id, text. A class is named by its smallest doc_id; texts without words
    belong to none. Sets are partitioned by length so that alike sets lie in one
    partition or in neighbours. Of each set only its rarest signatures, as many as any
    alike set must share one of, are joined; pairs whose lengths rule them out are
    dropped before their sets are fetched and compared.
    """
    sets = stored(with_signatures(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "text", "own")
                  .where(F.size("own") > 0).groupBy("own").agg(F.min("doc_id").alias("id")), "spot-sets")
    each = sets.select("id", F.size("own").alias("n"), F.explode("own").alias("signature"))
    counts = each.groupBy("signature").agg(F.count("*").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("seen", "signature"))
    least = F.ceil(F.col("n") * threshold - 1e-9)
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9)
    probes = each.join(counts, "signature").where("seen > 1").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - least + 1)
    probes = stored(probes.select("id", "n", "signature", part.alias("part")), "spot-probes")
    longer = probes.select(F.col("id").alias("b"), F.col("n").alias("m"), "signature", "part")
    shorter = probes.select(F.col("id").alias("a"), "n", "signature", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    fits = (F.col("n") >= F.col("m") * threshold - 1e-9) & ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b"))))
    pairs = shorter.join(longer, ["signature", "part"]).where(fits).select("a", "b").distinct()
    sets_a, sets_b = (sets.select(F.col("id").alias(k), F.col("own").alias(f"own_{k}")) for k in "ab")
    return (pairs.join(sets_a, "a").join(sets_b, "b").withColumn("likeness", likeness(F.col("own_a"), F.col("own_b")))
            .where(F.col("likeness") >= threshold).select("a", "b", "likeness"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, id): the class of each document with words, for ``similar_sets``."""
    own = with_signatures(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "text", "own").where(F.size("own") > 0)
    first = own.groupBy("own").agg(F.min("doc_id").alias("id"))
    return own.join(first, "own").select("doc_id", "id")
