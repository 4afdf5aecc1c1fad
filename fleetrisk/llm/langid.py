"""Language identification by nearest centroid.

Texts become hashed character-trigram TF-IDF vectors of unit length (trigrams of
letters within words, word edges included). Each language has several centroids from
spherical k-means over a bounded sample of its labelled texts. A text gets the language
of the centroid with the largest cosine.

Few trigrams are a noisy vector: a text of n trigrams that fits a centroid well has a cosine
of about 1 / sqrt(1 + noise / n). Each centroid's noise is measured on sampled texts that it was not
fitted on, and closeness is the cosine over that value. A text is rejected if its closeness to its
centroid is below a share of a low quantile of those texts' own; the limit falls with few trigrams.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from fleetrisk.llm.common import GOLDEN, MIX_1, MIX_2, crc_mod, give_back, stored, text_slices

#: hashed trigram features
FEATURES = 4096
#: expected size of the bounded sample of labelled texts, of each language
SAMPLE_PER_LANGUAGE = 1000
CENTROIDS = 4
ROUNDS = 10
#: the commonest labels are learned, so many at most
LANGUAGES = 200
#: a centroid holds this share of its language's sample at least, and as many texts far from the mean seed none
LEAST_SHARE = 0.05
#: every so many-th sampled text calibrates the centroids and is not fitted, in samples of CALIBRATED texts or more
CALIBRATE_EACH, CALIBRATED = 4, 80
#: a text is rejected below REJECT_SHARE of this quantile of closeness, times n / (n + FEW_TRIGRAMS)
REJECT_QUANTILE, REJECT_SHARE, FEW_TRIGRAMS = 0.01, 0.8, 64.0
UNDETERMINED = "und"
ROWS_AT_ONCE = 256
_SCALE = 1 << 40


class Model(NamedTuple):
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # centroids x features, unit rows
    idf: np.ndarray
    noise: np.ndarray  # of each centroid
    floor: np.ndarray  # closeness below it is rejected


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower-case form) of each code point."""
    is_letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    lower = np.fromiter((ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(0x110000)), np.uint32, 0x110000)
    return is_letter, lower


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """rows x FEATURES counts (float32) of hashed letter trigrams; a null or letterless text is all zero."""
    is_letter, lower = letters()
    joined = " ".join(["", *(t or "" for t in texts), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = is_letter[points]
    codes = np.where(inside, lower[points], np.uint32(32)).astype(np.uint64)
    middle = np.flatnonzero(inside)
    mixed = (codes[middle - 1] * GOLDEN) ^ (codes[middle] * MIX_1) ^ (codes[middle + 1] * MIX_2)
    mixed *= GOLDEN
    feature = (mixed >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)
    sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    row = np.searchsorted(np.cumsum(sizes), middle - 1, side="right")
    return np.bincount(row * FEATURES + feature, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def spherical_means(x: np.ndarray, sizes: np.ndarray, k: int, rounds: int = ROUNDS, least: float = LEAST_SHARE) -> np.ndarray:
    """Unit centroids of unit rows, at most ``k``, each nearest to ``least`` of the rows or more; no randomness.

    sizes: trigrams of each row. Seeds are spread out among the longer half of the
    rows, less the share ``least`` that is farthest from the mean: short or odd texts lie
    far from everything, and would be clusters of their own.
    """
    mean = _unit(x.mean(axis=0, keepdims=True))
    long = x[sizes >= np.median(sizes)]
    near = (long @ mean.T)[:, 0]
    long, near = long[near >= np.quantile(near, least)], near[near >= np.quantile(near, least)]
    centroids = long[[near.argmin()]]
    while len(centroids) < min(k, len(long)):
        nearest = (long @ centroids.T).max(axis=1)
        centroids = np.vstack([centroids, long[nearest.argmin()]])
    for _ in range(rounds):
        held = _members(x, centroids)
        own = (x @ centroids.T).argmax(axis=1)
        centroids = _unit(np.vstack([x[own == c].sum(axis=0) for c in np.flatnonzero(held >= max(least * len(x), 1))]))
    while len(centroids) > 1 and _members(x, centroids).min() < least * len(x):
        centroids = np.delete(centroids, _members(x, centroids).argmin(), axis=0)
    return centroids


def _members(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.bincount((x @ centroids.T).argmax(axis=1), minlength=len(centroids))


def calibrated(x: np.ndarray, sizes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(noise, floor of closeness) of each centroid from rows of its language; one with few rows takes all rows'."""
    cosines = x @ centroids.T
    own, best = cosines.argmax(axis=1), np.clip(cosines.max(axis=1), 1e-3, 1)
    noise, floor = [], []
    for c in range(len(centroids)):
        rows = own == c if (own == c).sum() >= CALIBRATED // CALIBRATE_EACH else np.ones(len(x), bool)
        noise.append(max(float(np.median((1 / best[rows] ** 2 - 1) * sizes[rows])), 0.0))
        floor.append(REJECT_SHARE * float(np.quantile(closeness(best[rows], sizes[rows], noise[-1]), REJECT_QUANTILE)))
    return np.array(noise), np.array(floor)


def closeness(cosine: np.ndarray, size: np.ndarray, noise) -> np.ndarray:
    return cosine * np.sqrt(1 + noise / np.maximum(size, 1))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, clusters: int = CENTROIDS) -> Model | None:
    """Learn from text and non-null lang of rows whose crc32(doc_id) mod 4 is not 2.

    ``per_language`` bounds the sample: labels are counted over all rows, then rows of the LANGUAGES
    commonest are taken by a hash of doc_id at the rate that gives so many of each on
    average (all of a rarer one). Sampled texts of any length become vectors of FEATURES counts
    before they meet in a group; what reaches the driver is one vector per centroid.
    Returns None if no row has a label and a letter.
    """
    spark = docs.sparkSession
    labelled = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
                .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)))
    common = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not common:
        return None
    counts = {r["lang"]: r["n"] for r in common}
    rates = spark.createDataFrame([(lang, min(_SCALE, -(-per_language * _SCALE // n))) for lang, n in counts.items()], "lang string, rate long")
    sample = (labelled.join(F.broadcast(rates), "lang")  # LANGUAGES rows at most
              .where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(_SCALE)) < F.col("rate")).select("text", "lang"))

    def vectors(batches):
        for batch in batches:
            for part in text_slices(batch):
                rows, langs = part.column(0).to_pylist(), part.column(1)
                for i in range(0, len(rows), ROWS_AT_ONCE):
                    block = trigram_counts(rows[i:i + ROWS_AT_ONCE])
                    yield pa.RecordBatch.from_arrays([langs.slice(i, len(block)), pa.array([v.tobytes() for v in block])], names=["lang", "counts"])

    sample = stored(sample.mapInArrow(vectors, "lang string, counts binary"), "language-sample")

    def document_counts(group):
        n, seen = group.num_rows, (_rows(group) > 0).sum(axis=0).astype("<f8").tobytes()
        give_back()
        return pa.table({"lang": group.column("lang").slice(0, 1), "n": [n], "seen": pa.array([seen], pa.binary())})

    found = sample.groupBy("lang").applyInArrow(document_counts, "lang string, n long, seen binary").collect()
    total = sum(r["n"] for r in found)
    seen = sum(np.frombuffer(r["seen"], "<f8") for r in found)
    idf = np.log((1 + total) / (1 + seen)).astype(np.float32) + np.float32(1)

    schema = pa.schema([("lang", pa.string()), ("noise", pa.float64()), ("floor", pa.float64()), ("centroid", pa.binary())])

    def centroids(group):
        lang = group.column("lang")[0].as_py()
        x = _rows(group.sort_by("counts"))  # an order that doesn't depend on how the group was shuffled
        x = x[x.any(axis=1)]
        if not len(x):
            return schema.empty_table()
        sizes, x = x.sum(axis=1), _unit(x * idf)
        held = np.arange(len(x)) % CALIBRATE_EACH == 0 if len(x) >= CALIBRATED else np.zeros(len(x), bool)
        means = spherical_means(x[~held], sizes[~held], clusters)
        noise, floor = calibrated(*((x[held], sizes[held]) if held.any() else (x, sizes)), means)
        del x
        give_back()
        return pa.table([[lang] * len(means), noise, floor, [c.astype("<f4").tobytes() for c in means]], schema=schema)

    rows = sample.groupBy("lang").applyInArrow(centroids, "lang string, noise double, floor double, centroid binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (-counts[r["lang"]], r["lang"], r["centroid"]))
    return Model([r["lang"] for r in rows], np.vstack([np.frombuffer(r["centroid"], "<f4") for r in rows]), idf,
                 np.array([r["noise"] for r in rows]), np.array([r["floor"] for r in rows]))


def _rows(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("counts").to_pylist()), np.float32).reshape(-1, FEATURES)


def classify(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, cosine, rejected) of each text."""
    names, scores, rejected = [], [], []
    for i in range(0, len(texts), ROWS_AT_ONCE):
        counts = trigram_counts(texts[i:i + ROWS_AT_ONCE])
        has_letters = counts.any(axis=1)
        if model is None:
            names += [UNDETERMINED] * len(counts)
            scores.append(np.zeros(len(counts)))
            rejected.append(np.ones(len(counts), bool))
            continue
        cosines = counts @ (model.centroids * model.idf).T
        size = np.sqrt((counts * counts) @ (model.idf * model.idf))
        cosines /= np.where(size > 0, size, 1)[:, None]
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(np.float64) * has_letters
        names += [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has_letters, strict=True)]
        scores.append(score)
        n = counts.sum(axis=1, dtype=np.float64)
        rejected.append(~has_letters | (closeness(score, n, model.noise[best]) < model.floor[best] * n / (n + FEW_TRIGRAMS)))
    return names, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(rejected) if rejected else np.zeros(0, bool)


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and lang_pred, lang_score, lang_rejected, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0, rejected; so is every
    text without a model. A text with letters always gets a learned language; one whose
    trigrams no centroid knows scores 0, is rejected and gets the commonest language.
    """
    columns = list(dict.fromkeys(["text", *keep]))
    chosen = docs.select(*[docs[c] for c in columns])
    new = [StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_rejected", BooleanType())]
    kept = [f for f in chosen.schema.fields if f.name in keep]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                names, scores, rejected = classify(part.column(0).to_pylist(), model)
                arrays = [part.column(columns.index(f.name)) for f in kept]
                arrays += [pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in [*kept, *new]])

    return chosen.mapInArrow(run, StructType(kept + new))


def identify(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, lang_pred, score, and whether distance rejects the text.

    Repeated rows and null ids are predicted like any other row (a null id is not held
    out, and never learned from); an empty table gives no rows. Very long texts are
    vectors of the same size as others.
    """
    found = predict(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fit(docs), ["doc_id"])
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred",
                        F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def keep_known(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that language identification does not reject, with the columns they had."""
    clash = [c for c in docs.columns if c in ("lang_pred", "lang_score", "lang_rejected")]
    renamed = docs.withColumnsRenamed({c: f"__own_{c}" for c in clash})
    found = predict(renamed, fit(docs), renamed.columns).where(~F.col("lang_rejected")).select(*renamed.columns)
    return found.withColumnsRenamed({f"__own_{c}": c for c in clash})
