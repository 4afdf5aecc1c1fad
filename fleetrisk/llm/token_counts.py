"""Token counts by a compiled finite-state tokenizer.

The byte-level BPE file is compiled, state by state as texts need it, to a
deterministic transducer over characters. A state holds all that later characters
can depend on: where the pre-token pattern stands, and, for each place of the longest
suffix that may still grow into a token, the last token and the count up to there.
A transition's annotation is the change of the token count, as if the text ended there.

A text is cut into chunks, which run side by side, one vectorised transition a step. A
chunk's map takes the state before it to the state behind it and the count between.
At a synchronising place (a pre-token must end there, whatever stood before) the map is
constant: every state goes to the start state, so chunks that begin there need one entry
and their counts add up in a prefix sum. A stretch without such a place (a very long
word, blanks, signs) is cut as well. Its chunks' maps are evaluated for the states that
can come before them and composed by pointer doubling, a parallel prefix scan.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetrisk.llm.common import text_bytes, text_slices, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
#: characters of a chunk, about
CHUNK = 256
#: bytes read before a chunk to guess the state it begins in
WARM = 32
#: times the maps of a stretch's chunks get further entries; what is open then is read on from the last state known
ROUNDS = 8
#: bytes a worker spends on compiled transitions; beyond that it compiles anew, which changes no count
TABLE_BYTES = 128 << 20
LIMIT = 512

LETTER, NUMBER, SPACE, MARK, INNER = range(5)  # INNER: a later byte of a character
#: fixed values: the byte-level pattern's contractions ('s 't 'm 'd, and 're 've 'll)
SHORT, LONG = frozenset(b"stmd"), {ord("r"): ord("e"), ord("v"): ord("e"), ord("l"): ord("l")}
QUOTE, BLANK = ord("'"), b" "
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
FROM_BYTE_LEVEL = {chr(b): b for b in _PRINTABLE} | {
    chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of each code point for the pre-token pattern."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], MARK) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


class MergeRules:
    """What the BPE file says: tokens by their bytes, and which two tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        spelled = lambda token: bytes(FROM_BYTE_LEVEL[c] for c in token)
        # numbered anew: single bytes first, then the merges by rank
        self.number = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int] | None] = [None] * 256
        self.pairs: dict[tuple[int, int], int] = {}
        for left, right in merges:
            left, right = spelled(left), spelled(right)
            pair = self.number[left], self.number[right]
            self.pairs[pair] = len(self.halves)
            self.number[left + right] = len(self.halves)
            self.halves.append(pair)
        self.prefixes = {b[:n] for b in self.number for n in range(1, len(b))}
        self.special = [t["content"].encode() for t in content["added_tokens"]]
        self.beside: dict[tuple[int, int], bool] = {}

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand at that edge of ``token`` while its merges happen, last first."""
        found = [token]
        while (halves := self.halves[found[-1]]) is not None:
            found.append(halves[side])
        return found

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the bytes of both together encode to just these two tokens.

        They don't if some merge across the seam comes before the merges, inside
        either, that take its two halves away. Of equal merges the leftmost is first.
        """
        known = self.beside.get((left, right))
        if known is None:
            known, until_left = True, len(self.halves)
            for a in self.edge(left, 1):
                until_right = len(self.halves)
                for b in self.edge(right, 0):
                    across = self.pairs.get((a, b))
                    if across is not None and across < until_left and across <= until_right:
                        known = False
                    until_right = b
                until_left = a
            self.beside[left, right] = known
        return known


#: a pre-token of which nothing is read: (suffix, last token at each place of it, counts up to there less the present one)
NOTHING = (b"", (-1,), (0,))


class Transducer:
    """Lazily compiled transducer; ``step`` is the definition, ``table`` remembers it.

    States: ("start",), ("run", class, pre-token), ("white", pre-token without its last
    character, that character, what it adds), ("quote",) after an apostrophe that begins a
    pre-token, ("quote", letter) one letter on. An entry packs the next state and the added count.
    """

    def __init__(self, rules: MergeRules, table_bytes: int = TABLE_BYTES):
        self.rules, self.table_bytes = rules, table_bytes
        self.columns = np.full(5 * 256, -1, np.int64)
        self.symbols: list[tuple[int, int]] = []
        self.width = 128
        self._begin([("start",)])

    def _begin(self, states: list[tuple]) -> None:
        self.states = list(dict.fromkeys([("start",), *states]))
        self.ids = {s: k for k, s in enumerate(self.states)}
        rows = max(1024, 2 * len(self.states))
        self.table = np.full(rows * self.width, -1, np.int32)

    # -- the definition ---------------------------------------------------------------

    def push(self, token_state: tuple, data: bytes) -> tuple[tuple, int]:
        """Read bytes of a pre-token; the state after them and what they add to its count."""
        rules, added = self.rules, 0
        suffix, lasts, counts = token_state
        for k in range(len(data)):
            suffix += data[k:k + 1]
            size = len(suffix)
            for n in range(1, size + 1):
                token = rules.number.get(suffix[size - n:])
                if token is not None and (lasts[size - n] == -1 or rules.may_follow(lasts[size - n], token)):
                    count = counts[size - n] + 1
                    break
            keep = next((n for n in range(size, 0, -1) if suffix[size - n:] in rules.prefixes), 0)
            suffix = suffix[size - keep:]
            lasts, counts = (*lasts, token)[-keep - 1:], (*counts, count)[-keep - 1:]
            # only places where a longer token may begin matter later
            open_at = [keep == n or n == 0 or suffix[keep - n:] in rules.prefixes for n in range(keep, -1, -1)]
            lasts = tuple(t if o else -2 for t, o in zip(lasts, open_at))
            counts = tuple(c - count if o else 0 for c, o in zip(counts, open_at))
            added += count
        return (suffix, lasts, counts), added

    def fresh(self, kind: int, data: bytes) -> tuple[tuple, int]:
        """A character that begins a pre-token."""
        state, added = self.push(NOTHING, data)
        if kind == SPACE:
            return ("white", NOTHING, data, added), added
        return (("quote",) if data[0] == QUOTE else ("run", kind, state)), added

    def step(self, state: tuple, kind: int, byte: int) -> tuple[tuple, int]:
        data, mode = bytes([byte]), state[0]
        if mode == "run" and kind in (state[1], INNER):
            after, added = self.push(state[2], data)
            return ("run", state[1], after), added
        if mode == "white":
            _, before, last, weight = state
            if kind == INNER:
                added = self.push(before, last + data)[1]
                return ("white", before, last + data, added), added - weight
            if kind == SPACE:
                before = self.push(before, last)[0]
                added = self.push(before, data)[1]
                return ("white", before, data, added), added
            if last == BLANK:
                after, added = self.push(NOTHING, last + data)
                return ("run", kind, after), added - weight
            after, added = self.fresh(kind, data)
            return after, added + self.push(NOTHING, last)[1] - weight
        if mode == "quote":
            so_far = b"'" + bytes(state[1:])
            ended = self.push(NOTHING, b"'")[1] + (self.push(NOTHING, so_far[1:])[1] if state[1:] else 0)
            if byte in SHORT and not state[1:] or state[1:] and LONG[state[1]] == byte:
                return ("start",), self.push(NOTHING, so_far + data)[1] - ended
            if state[1:]:
                return self.step(("run", LETTER, self.push(NOTHING, so_far[1:])[0]), kind, byte)
            if byte in LONG:
                return ("quote", byte), self.push(NOTHING, data)[1]
            if kind == MARK:
                return self.step(("run", MARK, self.push(NOTHING, b"'")[0]), kind, byte)
        return self.fresh(kind, data)

    # -- the compiled form ------------------------------------------------------------

    def symbols_of(self, kinds: np.ndarray, raw: np.ndarray) -> np.ndarray:
        codes = kinds.astype(np.int64) << 8 | raw
        found = self.columns[codes]
        if (found < 0).any():
            for code in np.unique(codes[found < 0]).tolist():
                self.columns[code] = len(self.symbols)
                self.symbols.append((code >> 8, code & 255))
            if len(self.symbols) > self.width:
                self.width *= 1 << (-(-len(self.symbols) // self.width) - 1).bit_length()
                self._begin([])
            found = self.columns[codes]
        return found

    def _known(self, state: tuple) -> int:
        """The number of a state, a new one if need be; its row of the table exists."""
        k = self.ids.setdefault(state, len(self.states))
        if k == len(self.states):
            self.states.append(state)
            if (k + 1) * self.width > len(self.table):
                self.table = np.append(self.table, np.full(len(self.table) // 2, -1, np.int32))
        return k

    def _compile(self, entries: np.ndarray) -> None:
        for entry in np.unique(entries).tolist():
            state, (kind, byte) = self.states[entry // self.width], self.symbols[entry % self.width]
            after, added = self.step(state, kind, byte)
            self.table[entry] = self._known(after) << 8 | (added + 128)

    def run(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray,
            before: list[tuple] | None = None) -> np.ndarray | tuple[np.ndarray, list[tuple]]:
        """Counts of the chunks ``symbols[start:end]``, side by side, each from the start state.

        With ``before``, each from its own state; then the states behind the chunks are returned too.
        """
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        at, left = starts[order], np.sort(sizes)
        states, totals = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        behind: list[tuple | None] = [None] * len(order)
        if before is not None:
            states[:] = [self._known(before[k]) for k in order.tolist()]
        for k in range(int(sizes.max(initial=0))):
            n = len(order) - int(np.searchsorted(left, k, side="right"))
            if self.table.nbytes > self.table_bytes and len(self.states) > 4 * n + 1024:
                live = [self.states[s] for s in states[:n].tolist()]
                if before is not None:  # chunks that have ended keep their states, not the numbers
                    behind[n:] = [self.states[s] if b is None else b for s, b in zip(states[n:].tolist(), behind[n:])]
                self._begin(live)
                states[:n] = [self.ids[s] for s in live]
            entries = states[:n] * self.width + symbols[at[:n] + k]
            found = self.table[entries]
            if (missing := found < 0).any():
                self._compile(entries[missing])
                found = self.table[entries]
            states[:n] = found >> 8
            totals[:n] += (found & 255) - 128
        out = np.empty_like(totals)
        out[order] = totals
        if before is None:
            return out
        left_in = [self.states[s] if b is None else b for s, b in zip(states.tolist(), behind)]
        return out, [left_in[k] for k in np.argsort(order).tolist()]

    def composed(self, symbols: np.ndarray, leads: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Counts of long stretches ``symbols[start:end]``, their chunks side by side.

        A chunk's map holds the entries that the chunk before can leave in; the first entry is a guess,
        the state after the bytes just before. What the guesses miss is evaluated in rounds, for all
        chunks at once. Composing the maps by pointer doubling leads from each stretch's
        start to its last known place; a stretch still open after the last round is read on from there.
        """
        cuts = [leads[np.searchsorted(leads, np.arange(s + CHUNK, e - CHUNK // 2, CHUNK))] for s, e in zip(starts.tolist(), ends.tolist())]
        begin = np.concatenate([np.concatenate([[s], c]) for s, c in zip(starts, cuts)])
        end = np.concatenate([np.concatenate([c, [e]]) for c, e in zip(cuts, ends)])
        sizes = np.array([len(c) + 1 for c in cuts])
        first, n = np.cumsum(sizes) - sizes, len(begin)
        last = np.zeros(n, bool)
        last[first + sizes - 1] = True
        warm = leads[np.searchsorted(leads, begin - WARM)]
        warm[first] = begin[first]
        guesses = self.run(symbols, warm, begin, [("start",)] * n)[1]
        numbers: dict[tuple, int] = {}  # of states within this call; the table may be compiled anew
        names: list[tuple] = []

        def numbered(states: list[tuple]) -> np.ndarray:
            found = [numbers.setdefault(state, len(numbers)) for state in states]
            names.extend(list(numbers)[len(names):])
            return np.array(found, np.int64)

        # nodes: a chunk and a state before it; their counts, and the node that follows
        nodes, counts, after = (np.zeros(0, np.int64) for _ in range(3))
        wanted = np.arange(n) << 32 | numbered(guesses)
        for left in range(ROUNDS, -1, -1):
            chunk = wanted >> 32
            added, behind = self.run(symbols, begin[chunk], end[chunk], [names[k] for k in (wanted & 0xFFFFFFFF).tolist()])
            nodes, counts = np.concatenate([nodes, wanted]), np.concatenate([counts, added])
            after = np.concatenate([after, np.where(last[chunk], -1, (chunk + 1) << 32 | numbered(behind))])
            order = np.argsort(nodes)
            nodes, counts, after = nodes[order], counts[order], after[order]
            missing = ~np.isin(after, nodes) & (after >= 0)
            wanted = np.unique(after[missing])
            # pointer doubling: after round j a node spans up to 2^j chunks
            ends_in, total = np.where(missing | (after < 0), len(nodes), np.searchsorted(nodes, after)), np.append(counts, 0)
            stop, hop = np.append(after, -1), np.append(ends_in, len(nodes))
            while (hop < len(nodes)).any():
                total, stop, hop = total + np.where(hop < len(nodes), total[hop], 0), np.where(hop < len(nodes), stop[hop], stop), hop[hop]
            at = np.searchsorted(nodes, first << 32)
            open_ones = stop[at] >= 0
            if not open_ones.any():
                return total[at]
            if not left:
                rest = stop[at][open_ones]
                out = total[at]
                out[open_ones] += self.run(symbols, begin[rest >> 32], ends[open_ones], [names[k] for k in (rest & 0xFFFFFFFF).tolist()])[0]
                return out

    def count(self, col: pa.Array) -> np.ndarray:
        """Token counts of the rows of a string array; a null row counts as empty."""
        raw, starts, ends = text_bytes(col)
        if not len(raw):
            return np.zeros(len(col), np.int64)
        whole = raw.tobytes()
        kinds = np.full(len(raw), INNER, np.uint8)
        leads = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32) if len(leads) < len(raw) else raw
        kinds[leads] = own = character_classes()[points]
        # places where a pre-token ends, whatever stands before
        before, now = own[:-1], own[1:]
        closed = (before != SPACE) & (now != before) & ((before != MARK) | (now != LETTER))
        cuts = leads[1:][closed]
        cuts = cuts[np.unique(cuts // CHUNK, return_index=True)[1]]  # the first in each chunk
        rows = [starts, ends]
        special = np.zeros(len(col), np.int64)
        for token in self.rules.special:  # counted by themselves, and nothing joins across them
            found = whole.find(token)
            while found >= 0:
                row = int(np.searchsorted(starts, found, side="right")) - 1
                while ends[row] <= found:  # empty rows share a start
                    row -= 1
                if found + len(token) <= ends[row]:
                    special[row] += 1
                    rows += [[found], [found + len(token)]]
                    kinds[found:found + len(token)] = 255
                    found = whole.find(token, found + len(token))
                else:
                    found = whole.find(token, found + 1)
        edges = np.unique(np.concatenate([*rows, cuts, [0, len(raw)]]))
        edges = edges[edges <= len(raw)]
        begin, end = edges[:-1], edges[1:]
        read = kinds[begin] != 255
        begin, end = begin[read], end[read]
        used = np.where(kinds == 255, MARK, kinds) if special.any() else kinds
        symbols, long = self.symbols_of(used, raw), end - begin > 4 * CHUNK
        counts = np.zeros(len(begin), np.int64)
        counts[~long] = self.run(symbols, begin[~long], end[~long])
        if long.any():
            counts[long] = self.composed(symbols, leads, begin[long], end[long])
        summed = np.append(0, np.cumsum(counts))  # the prefix scan of the composed maps
        place = np.searchsorted(begin, np.stack([starts, ends]))
        return np.where(ends > starts, summed[place[1]] - summed[place[0]], 0) + special


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(MergeRules(path))


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): n_bytes, n_tokens, over_limit.

    A null or empty text has no bytes and no tokens. Repeated rows and null ids are
    counted like any other row; an empty table gives no rows. A special token's string
    inside a text counts as that one token. No shuffle is needed.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        machine = transducer(path)
        for batch in batches:
            for part in text_slices(batch):
                col = part.column(1)
                sizes = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(machine.count(col), pa.int64())], schema=schema)

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
