"""Quality by importance resampling over hashed n-grams.

Two generative models, of target texts and of the raw corpus, are bags of hashed word
unigrams and bigrams: relative bucket frequencies. The target's are smoothed towards the
corpus's, so few targets pull no text far. A text's importance is the ratio of
its probability under the target to that under the corpus, taken per n-gram; texts
likelier under the target are kept, and among them Gumbel noise on the importance with a top-k gives a
sample without replacement in proportion to it.

A few toxic words don't move a mean over a whole text, so toxicity has models of its own:
document frequencies of word stems (prefixes, and whole words) in labelled toxic texts and in labelled
other texts. A text is judged by its strongest words alone, however long it is.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm.common import GOLDEN, MIX_1, mix64, stored, text_slices, words_of
from fleetrisk.llm.langid import letters
from fleetrisk.operators.rank import rank_within

#: hash buckets of unigrams and bigrams together
BUCKETS = 1 << 17
#: bound of the labelled sample: about so many target texts, by a hash of doc_id
TARGET_SAMPLE = 20_000
#: added to each raw count; n-grams that the target model takes from the corpus model
RAW_PRIOR, TARGET_PRIOR = 1.0, float(BUCKETS)
#: how many n-grams' worth of evidence the importance of a sampled text counts
SHARPNESS = 50.0
#: a text is kept if its mean log ratio is at least -(KEEP_FLOOR + SHORT_ALLOWANCE / sqrt(n_grams)):
#: a few n-grams say little, so short texts are given the benefit of the doubt
KEEP_FLOOR, SHORT_ALLOWANCE = 0.06, 0.6
#: the sample takes as many texts as are kept, times this share
SAMPLE_SHARE = 1.0
#: a word's stems are its prefixes of these many letters, and the word itself
STEM_LETTERS = range(3, 9)
#: a stem is toxic if most labelled texts with it are, in TOXIC_DOCS texts at least, with this log likelihood over chance
TOXIC_DOCS, TOXIC_EVIDENCE = 3, 6.0
#: a text is toxic if the log ratios of its TOXIC_WORDS strongest different words add up to the limit
TOXIC_WORDS, TOXIC_LIMIT = 3, 6.0
#: distinct stems that a task counts before it sends them
STEMS_HELD = 1 << 20
_SCALE = 1 << 40


class Toxic(NamedTuple):
    stems: np.ndarray  # sorted hashes of the toxic stems
    weights: np.ndarray  # log ratio of each: its share of toxic texts to its share of others


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds): row r has the n-grams ``buckets[bounds[r]:bounds[r + 1]]``, unigrams then bigrams."""
    words = words_of(col, lower=True)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    sizes = np.diff(words.bounds)
    one = (mix64(words.hashes ^ GOLDEN) >> shift).astype(np.int64)
    two = (mix64(words.hashes[:-1] * GOLDEN + words.hashes[1:]) >> shift).astype(np.int64) if len(one) > 1 else one[:0]
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(row[1:] == row[:-1])
    rows = np.concatenate([row, row[inside]])
    order = np.argsort(rows, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(sizes + np.maximum(sizes - 1, 0))])
    return np.concatenate([one, two[inside]])[order], bounds


def target_ids(labels: DataFrame, sample: int = TARGET_SAMPLE) -> DataFrame:
    """doc_id of labelled target texts (quality 1, not toxic), ``sample`` of them on average.

    labels: doc_id, quality, toxic. A doc_id with conflicting labels is no target.
    """
    good = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
            .where("quality = 1 and toxic = 0").select("doc_id"))
    n = good.count()
    rate = min(_SCALE, -(-sample * _SCALE // max(n, 1)))
    return good.where(F.pmod(F.xxhash64("doc_id", F.lit("target sample")), F.lit(_SCALE)) < rate)


def toxic_ids(labels: DataFrame, sample: int = TARGET_SAMPLE) -> DataFrame:
    """doc_id, toxic (boolean): ``sample`` labelled toxic texts and as many others, on average; conflicting labels are left out."""
    told = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min("toxic").alias("low"), F.max("toxic").alias("high")).where("low = high").select("doc_id", (F.col("low") > 0).alias("toxic")))
    rate = F.lit(0).cast("long")
    for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect():
        rate = F.when(F.col("toxic") == r["toxic"], min(_SCALE, -(-sample * _SCALE // r["n"]))).otherwise(rate)
    return told.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic sample")), F.lit(_SCALE)) < rate)


def stems(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stems, words, rows): ``stems[w]`` has the hashes of word w's prefixes and of the whole word, 0 where it is too short."""
    is_letter, lower = letters()
    texts = col.to_pylist()
    points = np.frombuffer(" ".join(["", *(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = is_letter[points]
    begin = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    size = end - begin
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(lower[points[at]].astype(np.uint64) * GOLDEN + place.astype(np.uint64) * MIX_1), dtype=np.uint64)])
    first = np.cumsum(size) - size
    whole = mix64(total[first + size] - total[first]) | np.uint64(1)
    found = np.zeros((len(begin), len(STEM_LETTERS) + 1), np.uint64)
    found[:, -1] = whole
    for k, n in enumerate(STEM_LETTERS):
        long = np.flatnonzero(size >= n)
        found[long, k] = mix64((total[first[long] + n] - total[first[long]]) + np.uint64(n)) | np.uint64(1)
    ends = np.cumsum(np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts)))
    return found, whole, np.searchsorted(ends, begin - 1, side="right")


def _document_stems(col: pa.Array) -> np.ndarray:
    """The stems of all rows, each once for a row that has it, and one 0 for each row."""
    found, whole, row = stems(col)
    order = np.lexsort((whole, row))
    new = order[np.flatnonzero(np.append(True, (whole[order][1:] != whole[order][:-1]) | (row[order][1:] != row[order][:-1])))] if len(order) else order
    found, row = found[new].reshape(-1), np.repeat(row[new], found.shape[1])
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    once = (found != 0) & np.append(True, (found[1:] != found[:-1]) | (row[1:] != row[:-1]))[:len(found)]
    return np.concatenate([found[once], np.zeros(len(col), np.uint64)])


def stem_counts(texts: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(stem, n): rows of ``texts`` (text) with each stem, of the sorted ``only`` if given; stem 0 counts all rows."""
    shared = None if only is None else texts.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["stem", "n"])

        for batch in batches:
            for part in text_slices(batch):
                found = _document_stems(part.column(0))
                if shared is not None:
                    found = found[(found == 0) | _held(found, shared.value)[1]]
                new, n = np.unique(found, return_counts=True)
                keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
                if len(keys) > STEMS_HELD:
                    yield packed()
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield packed()

    return texts.select("text").mapInArrow(run, "stem long, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def _held(found: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted ``known``, whether it is there) of each hash."""
    place = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
    return place, known[place] == found if len(known) else np.zeros(len(found), bool)


def _collected(counts: DataFrame) -> dict[int, int]:
    return {r["stem"] % (1 << 64): r["n"] for r in counts.toLocalIterator()}


def toxic_model(marked: DataFrame) -> Toxic:
    """Toxic stems by the labelled sample: ``marked`` has text and toxic (null if not in the sample).

    What reaches the driver are stems of several toxic texts of the sample, so its parameter bounds them.
    """
    common = _collected(stem_counts(marked.where("toxic")).where(F.col("n") >= F.when(F.col("stem") == 0, 0).otherwise(TOXIC_DOCS)))
    toxic = common.pop(0, 0)
    stem = np.array(sorted(common), np.uint64)
    k = np.array([common[s] for s in stem.tolist()], np.float64)
    others = _collected(stem_counts(marked.where("not toxic"), stem)) if len(stem) else {}
    other = others.pop(0, 0)
    if not other:
        return Toxic(stem[:0], k[:0])
    clean = np.array([others.get(s, 0) for s in stem.tolist()], np.float64)
    chance, share = toxic / max(toxic + other, 1), k / (k + clean)
    evidence = k * np.log(share / chance) + clean * np.log(np.maximum(1 - share, 1e-300) / (1 - chance))
    told = (share > np.maximum(0.5, chance)) & (evidence > TOXIC_EVIDENCE)
    # no word shows more than log(2 * (other + 1)): in a small sample the limit is lower, or the weights are larger
    weight = np.log((k + 0.5) / (toxic + 1) / ((clean + 0.5) / (other + 1))) * max(1.0, TOXIC_LIMIT / np.log(other + 1))
    return Toxic(stem[told], weight[told])


def toxicity(col: pa.Array, model: Toxic) -> np.ndarray:
    """Per row the sum of the log ratios of its TOXIC_WORDS strongest different words, each judged by its strongest stem."""
    out = np.zeros(len(col))
    if not len(model.stems):
        return out
    found, whole, row = stems(col)
    weight = np.zeros(len(whole))
    for k in range(found.shape[1]):
        place, there = _held(found[:, k], model.stems)
        weight[there] = np.maximum(weight[there], model.weights[place[there]])
    some = np.flatnonzero(weight > 0)
    order = some[np.lexsort((whole[some], -weight[some], row[some]))]
    order = order[np.append(True, (whole[order][1:] != whole[order][:-1]) | (row[order][1:] != row[order][:-1]))[:len(order)]]
    rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    strong = order[rank < TOXIC_WORDS]
    np.add.at(out, row[strong], weight[strong])
    return out


def bucket_counts(marked: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-grams of all documents, and of the target ones, in one pass.

    Each task counts its own documents and sends one row per bucket it saw.
    """
    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in text_slices(batch):
                found, bounds = features(part.column(0))
                raw += np.bincount(found, minlength=BUCKETS)
                chosen = np.repeat(part.column(1).to_numpy(zero_copy_only=False), np.diff(bounds))
                target += np.bincount(found[chosen], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        for at in range(0, len(seen), 1 << 16):
            own = seen[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(raw[own]), pa.array(target[own])], names=["bucket", "raw", "target"])

    return (marked.select("text", "chosen").mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket")
            .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def model_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) counts of each bucket: 2 * BUCKETS numbers, whatever the corpus."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.toLocalIterator():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def _marked(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_hash, text, chosen (a target), toxic (null outside the sample); the ids' number is bounded by the operator's parameter."""
    text, chosen = F.col("text").cast("string"), F.broadcast(known.select(F.col("doc_id").alias("__id"), F.col("chosen").alias("__in"), "toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.join(chosen, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text_hash", "text", F.coalesce("__in", F.lit(False)).alias("chosen"), "toxic")


def mean_log_ratios(found: np.ndarray, bounds: np.ndarray, chosen: np.ndarray, raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per row the mean log ratio of its n-grams, its own share taken out of both models (0 without n-grams, or without any target)."""
    n = np.diff(bounds)
    if not target.any():
        return np.zeros(len(n))
    row = np.repeat(np.arange(len(n)), n)
    _, back, times = np.unique(row * BUCKETS + found, return_inverse=True, return_counts=True)
    own = times[back]
    own_target = np.where(chosen[row], own, 0)
    corpus = (np.maximum(raw[found] - own, 0) + RAW_PRIOR) / (np.maximum(raw.sum() - n, 0) + RAW_PRIOR * BUCKETS)[row]
    wanted = (np.maximum(target[found] - own_target, 0) + TARGET_PRIOR * corpus) / (
        np.maximum(target.sum() - np.where(chosen, n, 0), 0) + TARGET_PRIOR)[row]
    total = np.concatenate([[0], np.cumsum(np.log(wanted / corpus))])
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1)


def importance(docs: DataFrame, labels: DataFrame, sample: int = TARGET_SAMPLE) -> DataFrame:
    """doc_id, text_hash, n_grams, log_ratio (mean over the n-grams; 0 without any), toxicity.

    A text is judged by the models of all other texts: its own n-grams are taken out, or
    those of target texts would speak for themselves.
    """
    known = target_ids(labels, sample).withColumn("chosen", F.lit(True)).join(toxic_ids(labels, sample), "doc_id", "full")
    marked = _marked(docs, stored(known, "targets"))
    models = docs.sparkSession.sparkContext.broadcast((*model_counts(bucket_counts(marked)), toxic_model(marked)))

    def run(batches):
        raw, target, toxic = models.value
        for batch in batches:
            for part in text_slices(batch):
                found, bounds = features(part.column(2))
                mean = mean_log_ratios(found, bounds, part.column(3).to_numpy(zero_copy_only=False), raw, target)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds)), pa.array(mean), pa.array(toxicity(part.column(2), toxic))],
                                                 names=["doc_id", "text_hash", "n_grams", "log_ratio", "toxicity"])

    return marked.mapInArrow(run, "doc_id long, text_hash long, n_grams long, log_ratio double, toxicity double")


def resample(docs: DataFrame, labels: DataFrame, share: float = SAMPLE_SHARE) -> DataFrame:
    """Per document row: doc_id, n_grams, log_ratio, score, kept, gumbel_key, rank, selected.

    score: the target's posterior for one n-gram, 0 to 1. kept: the text has words, is not clearly
    less likely under the target than under the corpus (KEEP_FLOOR), and is not toxic by its strongest
    words (TOXIC_LIMIT). selected: kept, and among the ceil(share * number kept) largest keys
    SHARPNESS * log_ratio + Gumbel noise; other texts have the lowest key and rank last. The noise is
    a fixed function of doc_id and text, and equal keys are ordered by doc_id, so runs agree.
    docs: doc_id, text; a null or empty text has no n-grams, is not kept and ranks last.
    Without target labels nothing is known of the target, and all texts with words that are not
    toxic are kept. Repeated rows have equal keys and take a place each. An empty table gives no rows.
    """
    unit = (F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("gumbel")), F.lit(_SCALE)) + 0.5) / _SCALE
    noise = -F.log(-F.log(unit))
    some = (F.col("n_grams") > 0) & (F.col("toxicity") < TOXIC_LIMIT)
    floor = -(KEEP_FLOOR + SHORT_ALLOWANCE / F.sqrt(F.greatest("n_grams", F.lit(1))))
    scored = importance(docs, labels).withColumns({
        "kept": some & (F.col("log_ratio") >= floor),
        "gumbel_key": F.when(some & (F.col("log_ratio") >= floor), SHARPNESS * F.col("log_ratio") + noise).otherwise(F.lit(float("-inf")))})
    scored = stored(scored, "importance")
    k = -(-scored.where("kept").count() * int(share * 10**6) // 10**6)
    # a global rank without a single task: range partitions and offsets
    ranked = rank_within(scored, [], [F.col("gumbel_key").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc()])
    return ranked.select("doc_id", "n_grams", "log_ratio", (1 / (1 + F.exp(-F.col("log_ratio")))).alias("score"), "kept",
                         "gumbel_key", F.col("rank").cast("long").alias("rank"), (F.col("rank") <= k).alias("selected"))


def sample(docs: DataFrame, labels: DataFrame, share: float = SAMPLE_SHARE) -> DataFrame:
    """(doc_id) of the selected rows."""
    return resample(docs, labels, share).where("selected").select("doc_id")
