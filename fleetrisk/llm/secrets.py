"""Secret scanning with multipart credential linking, with DataFrame operations only.

Strong parts (assignments of 12 or more characters, access identifiers, hex runs) are
reported by themselves. Weak parts (account names, opaque blobs, short assigned
values, endpoints) are reported only where a complementary part lies within the scope:
an interval join on buckets of text positions links them.

Matches are found in place: the pieces between matches and the matches give lengths,
and a running sum over them gives positions, so only matches are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetrisk.llm.common import stored
from fleetrisk.llm.decontaminate import bounded

#: fixed patterns of the contract; a match counts from LEAST characters on (of group 2 for assign)
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: weak parts
IDENT = r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
BLOB = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"""(?i:https?|s3|postgres|mysql|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""
SHORT_LEAST = 6

#: kinds in the order of the span lists
KINDS = ["assign", "access", "hex", "ident", "blob", "short", "endpoint"]
STRONG = 3
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "blob": BLOB, "endpoint": ENDPOINT}
#: role of each kind, and the roles that complement a weak part of it
ROLES = {"assign": "secret", "access": "account", "hex": "secret", "ident": "account", "blob": "secret", "short": "secret",
         "endpoint": "place"}
COMPLEMENTS = {"ident": ["secret"], "blob": ["account", "place"], "short": ["account", "place"], "endpoint": ["secret"]}
#: code points between two parts of one credential, at most
SCOPE = 200
MASK = "[secret]"


def _found(text, kind: str):
    """Array of (kind, idx, lead, size, value): the characters before each match since the last, and its own."""
    pattern = PATTERNS[kind]
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else whole
    zipped = F.transform(F.arrays_zip(whole.alias("m"), between.alias("b"), value.alias("v")), lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("idx"), F.char_length(x["b"]).alias("lead"),
        F.char_length(x["m"]).alias("size"), F.char_length(x["v"]).alias("value")))
    # the last piece between has no match behind it
    matched = F.filter(zipped, lambda x: x["size"].isNotNull())
    return F.when(text.rlike(pattern), matched)


def parts(docs: DataFrame) -> DataFrame:
    """Raw matches: rid, doc_id, text_hash, kind, idx, lead, size, value; one row of kind -1 for each document row."""
    text = F.col("text")
    end = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("idx"), F.lit(0).alias("lead"), F.lit(0).alias("size"), F.lit(0).alias("value")))
    none = F.filter(end, lambda x: F.lit(False))
    rows = (docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("text_hash"),
                    F.concat(end, *[F.coalesce(_found(text, k), none) for k in PATTERNS]).alias("found")))
    return stored(rows.select("rid", "doc_id", "text_hash", F.inline("found")), "secret-parts")


def placed(raw: DataFrame) -> DataFrame:
    """Spans (rid, kind, start, end) of the matches that count; short assignments become weak parts."""
    order = Window.partitionBy("rid", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    spans = (raw.where("kind >= 0").withColumn("end", F.sum(F.col("lead") + F.col("size")).over(order))
             .withColumn("start", F.col("end") - F.col("size")))
    assign, short = KINDS.index("assign"), KINDS.index("short")
    weak = (F.col("kind") == assign) & (F.col("value") < ASSIGN_LEAST)
    return (spans.withColumn("kind", F.when(weak, short).otherwise(F.col("kind")))
            .where((F.col("kind") != short) | (F.col("value") >= SHORT_LEAST)).select("rid", "kind", "start", "end"))


def _buckets(start, end, reach: int):
    """The buckets of SCOPE + 1 positions that [start - reach, end + reach) touches."""
    width = SCOPE + 1
    return F.explode(F.sequence(F.floor((start - reach) / width), F.floor((end - 1 + reach) / width)))


def link(spans: DataFrame) -> DataFrame:
    """Strong spans, and the weak spans that overlap no strong one and have a complement within SCOPE."""
    strong, weak = spans.where(F.col("kind") < STRONG), spans.where(F.col("kind") >= STRONG)
    held = strong.select(F.col("rid").alias("s_rid"), F.col("start").alias("s_start"), F.col("end").alias("s_end"),
                         _buckets(F.col("start"), F.col("end"), 0).alias("s_bucket"))
    weak = weak.select("*", _buckets(F.col("start"), F.col("end"), 0).alias("bucket"))
    covered = weak.join(held, (F.col("rid") == F.col("s_rid")) & (F.col("bucket") == F.col("s_bucket"))
                        & (F.col("s_start") < F.col("end")) & (F.col("start") < F.col("s_end")), "left_semi")
    key = ["rid", "kind", "start", "end"]
    free = weak.select(*key).distinct().join(covered.select(*key).distinct(), key, "left_anti")
    role = F.element_at(F.create_map(*[F.lit(x) for k, r in ROLES.items() for x in (KINDS.index(k), r)]), F.col("kind"))
    every = strong.select(*key).unionByName(free).select(
        F.col("rid").alias("o_rid"), role.alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        _buckets(F.col("start"), F.col("end"), 0).alias("o_bucket"))
    wants = F.element_at(F.create_map(*[x for k, roles in COMPLEMENTS.items() for x in (
        F.lit(KINDS.index(k)), F.array(*[F.lit(r) for r in roles]))]), F.col("kind"))
    near = free.select("*", wants.alias("wants"), _buckets(F.col("start"), F.col("end"), SCOPE).alias("bucket"))
    linked = near.join(every, (F.col("rid") == F.col("o_rid")) & (F.col("bucket") == F.col("o_bucket"))
                       & F.array_contains("wants", F.col("o_role"))
                       & (F.col("o_start") <= F.col("end") + SCOPE) & (F.col("start") <= F.col("o_end") + SCOPE), "left_semi")
    return strong.select(*key).unionByName(linked.select(*key).distinct())


def scan(docs: DataFrame) -> DataFrame:
    """Per document row: rid, doc_id, text_hash and found, its reported spans (start, kind, end) in order (null: none).

    docs: doc_id, text; a null text is empty. Repeated rows and null ids are scanned
    like any other; an empty table gives no rows. Very long texts are scanned whole.
    """
    raw = parts(docs)
    spans = link(stored(placed(raw), "secret-spans"))
    lists = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    return raw.where("kind = -1").select("rid", "doc_id", "text_hash").join(lists, "rid", "left")


def report(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    names = F.array(*[F.lit(k) for k in KINDS])
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    base = F.filter(found, lambda s: s["kind"] < STRONG)
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return scan(docs).select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                             F.sha2(written(base), 256).alias("base_sha256"), written(found).alias("spans"))


def redact(docs: DataFrame, length_column: str = "n_chars") -> DataFrame:
    """``docs`` with every reported span replaced by a mask (overlapping spans by one); other rows unchanged.

    ``length_column``, if there is one, is set to the new length of a changed text.
    """
    clash = [c for c in docs.columns if c in ("__id", "__hash", "__found")]
    if clash:
        docs = docs.withColumnsRenamed({c: f"__own{c}" for c in clash})
    marked = scan(docs).where("found is not null").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("found").alias("__found")).dropDuplicates(["__id", "__hash"])
    marked = stored(marked, "secret-documents")
    # per span, where the text goes on: the largest end so far
    cut = F.transform("__found", lambda s, i: F.struct(
        s["start"].alias("start"),
        F.coalesce(F.array_max(F.transform(F.slice(F.col("__found"), F.lit(1), i), lambda x: x["end"])), F.lit(0).cast("long")).alias("before"), s["end"].alias("end")))
    text = F.col("text")
    masked = F.array_join(F.transform(cut, lambda s: F.when(s["start"] >= s["before"], F.concat(
        text.substr((s["before"] + 1).cast("int"), (s["start"] - s["before"]).cast("int")), F.lit(MASK))).otherwise(F.lit(""))), "")
    rest = text.substr((F.array_max(F.transform("__found", lambda s: s["end"])) + 1).cast("int"), F.char_length(text))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__hash"))
    joined = docs.join(bounded(marked), same, "left")
    changed = F.col("__found").isNotNull()
    joined = joined.withColumn("text", F.when(changed, F.concat(masked, rest)).otherwise(text))
    if length_column in docs.columns:
        kind = docs.schema[length_column].dataType
        joined = joined.withColumn(length_column, F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col(length_column)))
    return joined.select(*docs.columns).withColumnsRenamed({f"__own{c}": c for c in clash})


def _oracle_spans(kind: str) -> str:
    pattern = PATTERNS[kind].replace("'", "''")
    value = f"regexp_extract_all(text, '{pattern}', 2)" if kind == "assign" else "NULL::VARCHAR[]"
    return f"""SELECT rid, {KINDS.index(kind)} AS kind, unnest(range(len(m))) AS i, m, b, v FROM (
      SELECT rid, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS b, {value} AS v FROM d)"""


ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(_oracle_spans(k) for k in PATTERNS)}),
pos AS (SELECT rid, kind, length(v[i + 1]) AS vlen, length(m[i + 1]) AS size,
          CAST(sum(length(b[i + 1]) + length(m[i + 1])) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS e FROM raw),
sp AS (SELECT rid, CASE WHEN kind = 0 AND vlen < {ASSIGN_LEAST} THEN 5 ELSE kind END AS kind, e - size AS s, e
       FROM pos WHERE kind <> 0 OR vlen >= {SHORT_LEAST}),
strong AS (SELECT * FROM sp WHERE kind < {STRONG}),
free AS (SELECT * FROM sp w WHERE kind >= {STRONG}
         AND NOT EXISTS (SELECT 1 FROM strong x WHERE x.rid = w.rid AND x.s < w.e AND w.s < x.e)),
part AS (SELECT *, CASE WHEN kind IN (1, 3) THEN 'account' WHEN kind = 6 THEN 'place' ELSE 'secret' END AS role
         FROM (SELECT * FROM strong UNION ALL SELECT * FROM free)),
rep AS (SELECT rid, kind, s, e FROM strong UNION ALL
        SELECT rid, kind, s, e FROM free w WHERE EXISTS (
          SELECT 1 FROM part o WHERE o.rid = w.rid AND o.s <= w.e + {SCOPE} AND w.s <= o.e + {SCOPE}
          AND CASE WHEN w.kind IN (3, 6) THEN o.role = 'secret' ELSE o.role IN ('account', 'place') END)),
named AS (SELECT rid, kind, s, ([{", ".join(f"'{k}'" for k in KINDS)}])[kind + 1] || ':' || s || ':' || e AS t FROM rep),
lists AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h,
          string_agg(t, ',' ORDER BY s, kind) FILTER (kind < {STRONG}) AS base, string_agg(t, ',' ORDER BY s, kind) AS spans
          FROM named GROUP BY rid)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(c, 0) AS BIGINT) AS n_access,
       CAST(coalesce(h, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lists USING (rid)
"""
