"""Conversation structure repair: cheapest edits by block tables over normalised cost vectors.

A conversation is well formed if its role initials are ``(s?(ua)+)?``. Four states say
what may follow. For a place in a conversation, the cheapest cost of repairing the rest
from each state is a vector of four numbers, which differ by a few units only: less its
minimum, it is one of a handful of normalised vectors. ``BlockTables`` finds them all
and, for each and for every block of BLOCK row symbols, tabulates the vector before
the block and the cost it adds (the method of the Four Russians). A conversation is read
by lookups from its end to its beginning, BLOCK rows at once, and then the blocks are
expanded the other way: at each edit the smallest letter that keeps to the optimum is
taken, so of all cheapest audits the ASCII-least one results.

Spark deals the damaged rows out by ranges of (conv_id, turn). Conversations inside a
partition are finished there. The first and last one of a partition may go on in
another, so their rows are stored as segments, and a conversation of any length is
repaired in parts: a segment's map from vectors to vectors, the composed maps, each
segment's trace from every state, and the composed traces. Only the SHA-256 of the
repaired text runs through a conversation in order, over finished chunks.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm.common import prepare, stored

#: fixed values of the contract: costs of the edits and of an undeleted truncated row
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
SPACES = " \t\n\v\f\r"
ENDINGS = ".!?"
LEGAL_PAIRS = frozenset(("su", "ua", "au"))
#: states: nothing yet, after s, after u, after a; a conversation may end in the first and the last
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: the state behind a row made user or assistant (by reroling or inserting), which is forced
FORCED = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
KEPT = {("s", START): AFTER_S, ("u", START): AFTER_U, ("u", AFTER_S): AFTER_U, ("u", AFTER_A): AFTER_U, ("a", AFTER_U): AFTER_A}
#: symbols: 0 must go; 1 + 2 * initial + truncated otherwise
MUST_GO, INITIALS, SYMBOLS = 0, "sua", 9
BLOCK = 4
#: bytes of repaired text in one row on their way to the hash
CHUNK_BYTES = 1 << 20

RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")
EDGE = "conv string, seg int, pos long, turn long, role string, text string, live boolean, empty boolean, again boolean, cut boolean, key binary"


def symbol(role: str, cut: bool) -> int:
    """Symbol of a row that may stay; cut: truncated."""
    at = INITIALS.find(role[:1]) if role else -1
    return 1 + 2 * (at if at >= 0 else len(INITIALS)) + cut


def row_edits(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row, letters ascending."""
    found = [("D", DELETE_COST, state)]
    if sym != MUST_GO:
        initial, cut = (INITIALS + "?")[(sym - 1) // 2], (sym - 1) % 2 * TRUNCATED_COST
        if (initial, state) in KEPT:
            found.append(("K", KEEP_COST + cut, KEPT[initial, state]))
        found.append(("R", REROLE_COST + cut, FORCED[state]))
    return found


def _with_inserts(vector: list[int]) -> tuple[int, ...]:
    for _ in range(3):  # no more than three inserts lead to a state that another one improves
        vector = [min(c, INSERT_COST + vector[FORCED[q]]) for q, c in enumerate(vector)]
    return tuple(vector)


def before_row(sym: int, vector: tuple[int, ...]) -> tuple[int, ...]:
    """Cheapest costs from each state before a row, inserts ahead of it included; vector: those behind it."""
    return _with_inserts([min(cost + vector[to] for _, cost, to in row_edits(sym, q)) for q in range(4)])


class BlockTables:
    """Normalised vectors, their transitions by one row, and by every block of ``size`` rows."""

    def __init__(self, size: int = BLOCK):
        big = 10 ** 6
        end = _with_inserts([0, big, big, 0])
        self.vectors, self.size = [end], size  # the end's minimum is 0
        number, step = {end: 0}, []
        for v in self.vectors:  # grows while it is read
            row = []
            for sym in range(SYMBOLS):
                found = before_row(sym, v)
                least = min(found)
                found = tuple(c - least for c in found)
                if found not in number:
                    number[found] = len(self.vectors)
                    self.vectors.append(found)
                row.append((number[found], least))
            step.append(row)
        self.step = step
        self.next1 = np.array([[to for to, _ in row] for row in step])
        self.add1 = np.array([[add for _, add in row] for row in step])
        # a block's number has its first row as its leading digit; its last row is read first
        nxt, add = np.arange(len(step))[:, None], np.zeros((len(step), 1), np.int64)
        for k in range(size):
            front = np.repeat(np.arange(SYMBOLS), SYMBOLS ** k)[None, :]  # one more row ahead of those of nxt
            behind, cost = np.tile(nxt, SYMBOLS), np.tile(add, SYMBOLS)
            nxt, add = self.next1[behind, front], cost + self.add1[behind, front]
        self.next_block, self.add_block = nxt, add
        self.next_list, self.add_list = nxt.tolist(), add.tolist()
        self.expand = lru_cache(1 << 16)(self._expand)

    def blocks(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """(single symbols ahead, block numbers): the rows, cut so that whole blocks stand at the end."""
        head = len(symbols) % self.size
        power = SYMBOLS ** np.arange(self.size - 1, -1, -1)
        return symbols[:head].tolist(), (symbols[head:].reshape(-1, self.size).astype(np.int64) @ power).tolist()

    def segment_map(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector behind the rows: the vector before them and the cost added."""
        head, numbers = self.blocks(symbols)
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for b in reversed(numbers):
            cost += self.add_block[at, b]
            at = self.next_block[at, b]
        for s in reversed(head):
            cost += self.add1[at, s]
            at = self.next1[at, s]
        return at, cost

    def read(self, symbols: np.ndarray, behind: int = 0) -> tuple[list[tuple[int, int]], int, int]:
        """([(block or ~symbol, vector behind it)] in row order, the vector before all rows, the cost added)."""
        head, numbers = self.blocks(symbols)
        places, at, cost = [], behind, 0
        for b in reversed(numbers):
            places.append((b, at))
            cost += self.add_list[at][b]
            at = self.next_list[at][b]
        for s in reversed(head):
            places.append((~s, at))
            to, add = self.step[at][s]
            at, cost = to, cost + add
        return places[::-1], at, cost

    def _expand(self, block: int, behind: int, state: int) -> tuple[str, int]:
        """(letters, state behind) of one block, or of one row where ``block`` is ~symbol."""
        if block < 0:
            rows = [~block]
        else:
            rows = [block // SYMBOLS ** k % SYMBOLS for k in range(self.size - 1, -1, -1)]
        after = [behind]
        for s in reversed(rows):
            after.append(self.step[after[-1]][s][0])
        after.reverse()
        letters = []
        for k, s in enumerate(rows):
            to, base = self.vectors[after[k + 1]], self.step[after[k + 1]][s][1]
            here = self.vectors[after[k]]
            while True:  # letters are tried in ASCII order: D, I, K, R
                left = here[state] + base
                edits = row_edits(s, state)
                if left == edits[0][1] + to[state]:
                    letters.append("D")
                    break
                if here[state] == INSERT_COST + here[FORCED[state]]:
                    letters.append("I")
                    state = FORCED[state]
                    continue
                letter, _, state = next(e for e in edits[1:] if left == e[1] + to[e[2]])
                letters.append(letter)
                break
        return "".join(letters), state

    def trace(self, symbols: np.ndarray, behind: int, state: int, last: bool) -> tuple[str, int]:
        """The ASCII-least cheapest letters from ``state`` over the rows, and the state behind them."""
        letters = []
        for block, vector in self.read(symbols, behind)[0]:
            part, state = self.expand(block, vector, state)
            letters.append(part)
        while last and self.vectors[0][state]:  # what is left costs only inserts
            letters.append("I")
            state = FORCED[state]
        return "".join(letters), state


@lru_cache(maxsize=1)
def tables() -> BlockTables:
    return BlockTables()


def repaired(audit: str, rows, state: int = START):
    """``role:text`` of each row that the audit leaves; rows: (role, text) in order."""
    rows = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[role[0], state]
        else:
            role, state = ("assistant" if state == AFTER_U else "user"), FORCED[state]
        yield f"{role}:{text}"


class Segment:
    """Rows of one conversation in order, as far as one partition holds them."""

    def __init__(self, conv: str):
        self.conv, self.rows, self.seen, self.pos = conv, [], set(), 0

    def row(self, turn, role: str, text: str, live: bool) -> tuple:
        """The row's entry of EDGE behind conv and seg: what can be told without the segments before."""
        self.pos += 1
        if not live:
            return self.pos, None, None, None, False, False, False, False, None
        body = text.strip(SPACES)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        again = key in self.seen
        self.seen.add(key)
        return self.pos, turn, role, text, True, not body, again, bool(body) and body[-1] not in ENDINGS, key

    def result(self, conv_id) -> tuple:
        """RESULT of a conversation that lies in one segment."""
        live = [r for r in self.rows if r[4]]
        symbols, counts = faults(live)
        places, before, cost = tables().read(symbols)
        audit, _ = tables().trace(symbols, 0, START, True)
        text = "\n".join(repaired(audit, ((r[2], r[3]) for r in live)))
        turns = [r[1] for r in live if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in live]
        illegal = sum(a + b not in LEGAL_PAIRS for a, b in itertools.pairwise(initials))
        return (conv_id, gaps, *counts, illegal, cost + tables().vectors[before][START], audit,
                hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())


def faults(live: list[tuple]) -> tuple[np.ndarray, tuple[int, int, int]]:
    """(symbols, (blank, duplicate, truncated)): a row's first fault counts."""
    symbols, counts = np.zeros(len(live), np.uint8), [0, 0, 0]
    for k, (_, _, role, _, _, empty, again, cut, _) in enumerate(live):
        fault = 0 if empty else 1 if again else 2 if cut else None
        if fault is not None:
            counts[fault] += 1
        symbols[k] = MUST_GO if empty or again else symbol(role, cut)
    return symbols, tuple(counts)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, live): the contract's damage; a dropped row stays as one that is not live."""
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                             F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                             F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    c = c.withColumn("kind", F.crc32(F.encode(name, "UTF-8")) % 20)
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ENDINGS, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return c.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), (F.col("kind") != 0).alias("live"), copies.alias("copy")).drop("copy")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_RESULT_FIELDS = [("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                  ("audit", pa.string()), ("repaired_sha256", pa.string())]
_EDGE_FIELDS = [("conv", pa.string()), ("seg", pa.int32()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
                ("text", pa.string()), ("live", pa.bool_()), ("empty", pa.bool_()), ("again", pa.bool_()), ("cut", pa.bool_()), ("key", pa.binary())]


def _first_pass(batches):
    """Finished conversations, and the rows of the partition's first and last one as segments."""
    seg = TaskContext.get().partitionId()
    schema = pa.schema(_RESULT_FIELDS + _EDGE_FIELDS)
    done, edge = (None,) * len(_EDGE_FIELDS), (None,) * len(_RESULT_FIELDS)
    current, conv_id, first, out, size = None, None, True, [], 0

    def edge_row(row):
        return (*edge, current.conv, seg, *row)

    for batch in batches:
        for conv, turn, role, text, live in zip(*(c.to_pylist() for c in batch.columns)):
            name = " " if conv is None else str(conv)
            if current is None or name != current.conv:
                if current is not None and not first:
                    out.append((*current.result(conv_id), *done))
                first = current is None
                current, conv_id = Segment(name), conv
            row = current.row(turn, role, text, live)
            if first:  # it may have begun in the partition before, and may be long: its rows are not held
                out.append(edge_row(row))
                size += len(text)
            else:
                current.rows.append(row)
            if len(out) >= 2000 or size > CHUNK_BYTES:
                yield _batch(out, schema)
                out, size = [], 0
    if out:
        yield _batch(out, schema)
    if current is not None:
        rows = [edge_row(r) for r in current.rows]
        for k in range(0, len(rows), 500):
            yield _batch(rows[k:k + 500], schema)


_SEGMENT = ("conv string, seg int, symbols binary, next binary, add binary, blank long, duplicate long, truncated long, illegal long, "
            "first_initial string, last_initial string, first_turn long, last_turn long, turns long")


def _segment_maps(table: pa.Table) -> pa.Table:
    """One row of _SEGMENT for the rows of one segment."""
    rows = sorted(table.select(["pos", "turn", "role", "text", "live", "empty", "again", "cut", "key"]).to_pylist(), key=lambda r: r["pos"])
    live = [tuple(r.values()) for r in rows if r["live"]]
    symbols, counts = faults(live)
    at, cost = tables().segment_map(symbols)
    turns = [r[1] for r in live if r[1] is not None]
    initials = [r[2][:1] for r in live]
    illegal = sum(a + b not in LEGAL_PAIRS for a, b in itertools.pairwise(initials))
    head = table.slice(0, 1).to_pylist()[0]
    found = (head["conv"], head["seg"], symbols.tobytes(), at.astype("<i4").tobytes(), cost.astype("<i8").tobytes(), *counts, illegal,
             initials[0] if initials else None, initials[-1] if initials else None,
             turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)))
    types = [pa.string(), pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 4, *[pa.string()] * 2, *[pa.int64()] * 3]
    names = [c.split()[0] for c in _SEGMENT.split(", ")]
    return pa.table([pa.array([v], t) for v, t in zip(found, types)], names=names)


_PLACED = "conv string, seg int, behind int, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _place(table: pa.Table) -> pa.Table:
    """The vector behind each segment of one conversation; its first segment also carries the conversation's totals."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seg"])
    at, cost, behind = 0, 0, []
    for r in reversed(rows):
        behind.append(at)
        cost += int(np.frombuffer(r["add"], "<i8")[at])
        at = int(np.frombuffer(r["next"], "<i4")[at])
    behind.reverse()
    illegal = sum(r["illegal"] for r in rows)
    held = [r for r in rows if r["first_initial"] is not None]
    illegal += sum(a["last_initial"] + b["first_initial"] not in LEGAL_PAIRS for a, b in itertools.pairwise(held))
    timed = [r for r in rows if r["turns"]]
    turns = sum(r["turns"] for r in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in itertools.pairwise(timed))
    gaps = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns if timed else 0
    totals = [gaps, *(sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated")), illegal, cost + tables().vectors[at][START]]
    out = [(r["conv"], r["seg"], b, k == len(rows) - 1, *(totals if k == 0 else [None] * 6)) for k, (r, b) in enumerate(zip(rows, behind))]
    types = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 6]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in _PLACED.split(", ")])


def _exits(batches):
    """The state behind each segment from each state before it."""
    for batch in batches:
        out = []
        for conv, seg, symbols, behind, last in zip(*(c.to_pylist() for c in batch.columns)):
            symbols = np.frombuffer(symbols, np.uint8)
            out.append((conv, seg, behind, last, [tables().trace(symbols, behind, q, last)[1] for q in range(4)]))
        schema = pa.schema([("conv", pa.string()), ("seg", pa.int32()), ("behind", pa.int32()), ("last", pa.bool_()), ("exits", pa.list_(pa.int32()))])
        yield _batch(out, schema)


def _entries(table: pa.Table) -> pa.Table:
    """The state before each segment of one conversation."""
    rows, state, out = sorted(table.to_pylist(), key=lambda r: r["seg"]), START, []
    for r in rows:
        out.append((r["conv"], r["seg"], r["behind"], r["last"], state))
        state = r["exits"][state]
    types = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv", "seg", "behind", "last", "state"])


def _finish(table: pa.Table) -> pa.Table:
    """Audit and repaired text of one segment, in chunks."""
    rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
    head, live = rows[0], [tuple(r[n] for n in ("pos", "turn", "role", "text", "live", "empty", "again", "cut", "key")) for r in rows if r["live"]]
    audit, _ = tables().trace(faults(live)[0], head["behind"], head["state"], head["last"])
    chunks, part, size = [], [], 0
    for item in repaired(audit, ((r[2], r[3]) for r in live), head["state"]):
        part.append(item)
        size += len(item)
        if size > CHUNK_BYTES:
            chunks.append(part)
            part, size = [], 0
    chunks = chunks + [part] if part or not chunks else chunks
    out = [(head["conv"], head["seg"], k, audit if k == 0 else "", "\n".join(c).encode("utf-8", "surrogatepass")) for k, c in enumerate(chunks)]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv", "seg", "part", "audit", "body"])


def _digests(batches):
    """Audit and SHA-256 of each conversation, over its chunks in order."""
    schema = pa.schema([("conv", pa.string()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    conv, audit, digest, begun = None, [], None, False

    def row():
        return _batch([(conv, "".join(audit), digest.hexdigest())], schema)

    for batch in batches:
        for name, part, body in zip(*(c.to_pylist() for c in batch.columns)):
            if name != conv:
                if conv is not None:
                    yield row()
                conv, audit, digest, begun = name, [], hashlib.sha256(), False
            audit.append(part)
            if body:
                digest.update(b"\n" + body if begun else body)
                begun = True
    if conv is not None:
        yield row()


def _across(edges: DataFrame) -> DataFrame:
    """RESULT of the conversations that may lie in several partitions; edges: columns EDGE."""
    spark = edges.sparkSession
    # a row that its own segment holds first is a duplicate if an earlier segment holds it too
    firsts = (edges.where("live and not empty and not again").groupBy("conv", "key").agg(F.min("seg").alias("first_seg")))
    own = edges.where("live and not empty and not again").join(firsts, ["conv", "key"], "left").withColumn("again", F.coalesce(F.col("first_seg") < F.col("seg"), F.lit(False)))
    rows = stored(own.drop("first_seg").select(edges.columns).unionByName(edges.where("not live or empty or again")), "conversations-edges")
    segments = stored(rows.drop("text").withColumn("text", F.lit(None).cast("string")).select(edges.columns)
                      .groupBy("conv", "seg").applyInArrow(_segment_maps, _SEGMENT), "conversations-segments")
    placed = stored(segments.drop("symbols").groupBy("conv").applyInArrow(_place, _PLACED), "conversations-placed")
    exits = (segments.select("conv", "seg", "symbols").join(placed.select("conv", "seg", "behind", "last"), ["conv", "seg"])
             .mapInArrow(_exits, "conv string, seg int, behind int, last boolean, exits array<int>"))
    entries = stored(exits.groupBy("conv").applyInArrow(_entries, "conv string, seg int, behind int, last boolean, state int"), "conversations-entries")
    chunks = (rows.join(entries, ["conv", "seg"]).groupBy("conv", "seg")
              .applyInArrow(_finish, "conv string, seg int, part int, audit string, body binary"))
    chunks = chunks.repartition("conv").sortWithinPartitions("conv", "seg", "part").select("conv", "audit", "body")
    hashed = chunks.mapInArrow(_digests, "conv string, audit string, repaired_sha256 string")
    totals = placed.where("gaps is not null")
    conv_id = F.when(F.col("conv") != " ", F.col("conv").cast("long"))
    return totals.join(hashed, "conv").select(conv_id.alias("conv_id"), *[c.split()[0] for c in RESULT.split(", ")[1:]])


def repair(conversations: DataFrame) -> DataFrame:
    """One row of RESULT for each conv_id of ``conversations`` (conv_id, turn, role, text; others are ignored).

    Nulls are one space: a null text is blank, a null role is no known one; null conv_ids are
    one conversation, null turns come first and don't count for gaps. Rows of one turn stand in
    the order of the MD5 of role, U+0000 and text; repeated rows are duplicates. A role counts by
    its first character, an empty role never stays as it is. Long texts are held one
    partition's conversation at a time. An empty table gives no rows.
    """
    prepare(conversations.sparkSession)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "tie", "spread"]
    rows = (damaged(conversations)
            .withColumn("tie", F.md5(F.encode(F.concat_ws("\0", "role", "text"), "UTF-8")))
            .withColumn("spread", F.monotonically_increasing_id()))  # equal rows needn't share a partition
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(rows.select("conv_id", "turn", "role", "text", "live").mapInArrow(_first_pass, f"{RESULT}, {EDGE}"), "conversations")
    done = found.where("conv is null").select([c.split()[0] for c in RESULT.split(", ")])
    return done.unionByName(_across(found.where("conv is not null").select([c.split()[0] for c in EDGE.split(", ")])))
