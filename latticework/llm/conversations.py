"""Conversation structure repair: iterative-deepening A* finds each conversation's cheapest edits, the ASCII-least of equals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.llm.common import map_texts, table

#: What edits cost, and what an undeleted truncated row adds.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: A row's role by its initial, and its first fault; a row's code is 3 * role + fault.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
FINE, DOOMED, CUT = range(3)
#: States: nothing kept yet, after a system row, after a user row, after an assistant row. NEEDED is the state after the user or assistant row that a state waits for.
START, TOLD, ASKED, ANSWERED = range(4)
NEEDED = (ASKED, ASKED, ANSWERED, ASKED)
#: The cost of inserts that end a conversation in each state.
AT_END = [0, 2 * INSERT, INSERT, 0]
#: Rows that one search goes through; longer conversations are searched in strides of as many, from the back.
STRIDE = 32


def least_cost(code: int) -> int:
    """What a row costs at least, whatever stands around it."""
    role, fault = divmod(code, 3)
    if fault == DOOMED:
        return DELETE
    return min(DELETE, (TRUNCATED if fault == CUT else 0) + (REROLE if role == OTHER else 0))


def edits(state: int, code: int) -> list[tuple[str, int, int, int]]:
    """(initial, rows taken, next state, cost) of each edit before or at a row, in ASCII order."""
    role, fault = divmod(code, 3)
    out = [("D", 1, state, DELETE), ("I", 0, NEEDED[state], INSERT)]
    if fault != DOOMED:
        more = TRUNCATED if fault == CUT else 0
        fits = TOLD if (state, role) == (START, SYSTEM) else NEEDED[state] if role == (ASSISTANT if state == ASKED else USER) else None
        if fits is not None:
            out.append(("K", 1, fits, more))
        out.append(("R", 1, NEEDED[state], REROLE + more))
    return out


_EDITS = [[edits(state, code) for code in range(12)] for state in range(4)]
_LEAST = [least_cost(code) for code in range(12)]


class Search:
    """Iterative-deepening A* over the rows of one stride, whose end costs `beyond[state]` more.

    A node is a row's position and a state. `bound_of` is the transposition table of failed nodes: what a node costs at
    least, at first the sum of the rows' own least costs, raised each time that a search from it fails.
    """

    def __init__(self, codes: bytes, beyond: list[int]):
        self.codes, self.beyond, self.n = codes, beyond, len(codes)
        rest = list(accumulate((_LEAST[c] for c in reversed(codes)), initial=min(beyond)))[::-1]
        self.bound_of = [x for x in rest[:-1] for _ in range(4)] + list(beyond)

    def cheapest(self, state: int) -> tuple[int, str, int]:
        """Cost, edits and last state of the cheapest way from the first row in `state`, the ASCII-least of equals."""
        while True:
            limit = self.bound_of[state]
            found = self.within(state, limit)
            if found:
                return limit, *found
            self.bound_of[state] = max(self.bound_of[state], limit + 1)

    def within(self, state: int, limit: int) -> tuple[str, int] | None:
        """Depth-first in ASCII order: the first way that costs `limit` at most, or None, with tables raised."""
        bound_of, codes, n = self.bound_of, self.codes, self.n
        if not n:
            return ("", state) if self.beyond[state] <= limit else None
        # position, state, cost so far, states met at this position (inserts go round), edits left, least cost of those that failed
        stack = [[0, state, 0, 1 << state, iter(_EDITS[state][codes[0]]), 1 << 60]]
        path: list[str] = []
        while stack:
            top = stack[-1]
            at, state, spent, met, left, _ = top
            for name, taken, after, cost in left:
                child = 4 * (at + taken) + after
                if spent + cost + bound_of[child] > limit or not taken and met >> after & 1:
                    top[5] = min(top[5], cost + bound_of[child])
                    continue
                path.append(name)
                if at + taken == n:
                    return "".join(path), after
                stack.append([at + taken, after, spent + cost, (0 if taken else met) | 1 << after, iter(_EDITS[after][codes[at + taken]]), 1 << 60])
                break
            else:
                node = 4 * at + state
                bound_of[node] = max(bound_of[node], top[5])
                stack.pop()
                if stack:
                    path.pop()
                    above = stack[-1]
                    above[5] = min(above[5], spent - above[2] + bound_of[node])
        return None


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and audit: the cheapest edits' initials in order, the ASCII-least of equals.

    Up to STRIDE rows are one search. In longer conversations what remains after a stride is found first, from the back, so
    each search ends at rows whose cost is known: time is in proportion to the rows, and besides the codes 4 numbers a
    stride are held.
    """
    starts = list(range(0, max(1, len(codes)), STRIDE))
    beyond = {starts[-1] + STRIDE: AT_END}
    for at in reversed(starts[1:]):
        search = Search(codes[at : at + STRIDE], beyond[at + STRIDE])
        beyond[at] = [search.cheapest(state)[0] for state in range(4)]
    audit, state, total = [], START, 0
    for at in starts:
        cost, some, state = Search(codes[at : at + STRIDE], beyond[at + STRIDE]).cheapest(state)
        total = total or cost  # the first search's cost takes in all that follows
        audit.append(some)
    return total, "".join(audit) + "I" * (AT_END[state] // INSERT)


def damaged(talks: DataFrame) -> DataFrame:
    """conv_id, turn, tie, role, text, copy and `gone`, by the row's remainder of crc32(conv_id:turn): 0 drops it, 1 empties its text, 2 takes out [.!?], 3 repeats it, 4 makes its role user. Nulls of role and text, and in what is hashed, count as one space. Rows of one turn stand in the order of `tie`, a hash of the row."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = talks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    rows = rows.withColumn("k", F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).withColumn("tie", F.xxhash64("role", "text"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "tie", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("k") == 0).alias("gone"))


def as_given(talks: DataFrame) -> DataFrame:
    """The rows of `talks` in the columns of `damaged`, undamaged."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = talks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    return rows.select("conv_id", "turn", F.xxhash64("role", "text").alias("tie"), "role", "text", F.lit(0).alias("copy"), F.lit(False).alias("gone"))


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, tie, copy, code and `fault` (0 none, 1 blank, 2 duplicate, 3 truncated; -1 for dropped rows) of each row, without texts."""
    flat = _trimmed(F.col("text"))
    kind = F.when(F.col("gone"), -1).when(flat == "", 1).when(~F.substring(flat, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    role, letter = F.lit(OTHER), F.substring("role", 1, 1)
    for name, known in (("s", SYSTEM), ("u", USER), ("a", ASSISTANT)):
        role = F.when(letter == name, known).otherwise(role)
    own = rows.select("conv_id", "turn", "tie", "copy", "gone", role.cast("int").alias("initial"), kind.cast("int").alias("kind"), F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(7), "role", "text").alias("d2"))
    first = Window.partitionBy("conv_id", "gone", "d1", "d2").orderBy(F.asc_nulls_first("turn"), "tie", "copy")
    again = own.repartition("conv_id").withColumn("nth", F.row_number().over(first))
    fault = F.when(F.col("kind").isin(-1, 1), F.col("kind")).when(F.col("nth") > 1, 2).otherwise(F.col("kind"))
    return again.select("conv_id", "turn", "tie", "copy", "initial", fault.cast("int").alias("fault"))


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
#: Codes of the pairs of neighbouring roles that may be.
_LEGAL = np.zeros(16, bool)
_LEGAL[[4 * SYSTEM + USER, 4 * USER + ASSISTANT, 4 * ASSISTANT + USER]] = True


class Talk:
    """What a conversation's rows, met in order, leave: a byte each, and counts."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes = conv_id, bytearray()
        self.faults, self.turns, self.illegal = np.zeros(4, np.int64), 0, 0
        self.low = self.high = None

    def take(self, turn: np.ndarray, known: np.ndarray, initial: np.ndarray, fault: np.ndarray) -> None:
        """More rows, in order; `known` marks turns that aren't null."""
        at = turn[known].tolist()
        if at:
            self.low = at[0] if self.low is None else self.low
            self.turns += sum(a != b for a, b in zip(at, [self.high, *at[:-1]], strict=True))
            self.high = at[-1]
        if len(initial):
            last = [self.codes[-1] // 3] if self.codes else []
            roles = np.concatenate([np.array(last, np.int64), initial])
            self.illegal += int((~_LEGAL[4 * roles[:-1] + roles[1:]]).sum())
            self.faults += np.bincount(fault, minlength=4)
            self.codes += (3 * initial + np.array([FINE, DOOMED, DOOMED, CUT])[fault]).astype(np.uint8).tobytes()

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit = repair(bytes(self.codes))
        return self.conv_id, gaps, *self.faults[1:].tolist(), self.illegal, cost, audit


def groups(batch: pa.RecordBatch) -> list[tuple[int | None, int, int]]:
    """(conv_id, first row, row after the last) of each run of one conversation in an ordered batch."""
    if not batch.num_rows:
        return []
    ids = batch.column("conv_id")
    null = np.asarray(ids.is_null())
    flat = ids.fill_null(0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((flat[1:] != flat[:-1]) | (null[1:] != null[:-1])) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    return [(None if null[a] else int(flat[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def summaries(rows: DataFrame) -> DataFrame:
    """SUMMARY of each conversation in rows (as from `damaged`): faults, cheapest edits. Only hashes and flags are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk: Talk | None = None
        names = [f.split()[0] for f in SUMMARY.split(", ")]

        def made(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in names]))

        for b in batches:
            done = []
            turn, known = b.column("turn").fill_null(0).to_numpy(zero_copy_only=False), np.asarray(b.column("turn").is_valid())
            initial, fault = b.column("initial").to_numpy(zero_copy_only=False).astype(np.int64), b.column("fault").to_numpy(zero_copy_only=False)
            for conv_id, first, end in groups(b):
                if talk is None or talk.conv_id != conv_id:
                    done += [talk.row()] if talk else []
                    talk = Talk(conv_id)
                here = np.flatnonzero(fault[first:end] >= 0) + first
                talk.take(turn[here], known[here], initial[here], fault[here])
            if done:
                yield made(done)
        if talk:
            yield made([talk.row()])

    ordered = faults(rows).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "tie", "copy")
    return ordered.select("conv_id", "turn", "initial", "fault").mapInArrow(run, SUMMARY)


class Repaired:
    """A repaired conversation's lines in order, as rows come; nothing is kept but the hash or, if wanted, the lines."""

    def __init__(self, audit: str, with_text: bool):
        self.audit, self.at, self.state, self.begun = audit, 0, START, False
        self.hash, self.lines = hashlib.sha256(), [] if with_text else None

    def line(self, role: str, text: str) -> None:
        data = f"{role}:{text}"
        self.hash.update((("\n" if self.begun else "") + data).encode("utf-8", "surrogatepass"))
        self.begun = True
        if self.lines is not None:
            self.lines.append(data)

    def needed(self) -> str:
        role = "assistant" if self.state == ASKED else "user"
        self.state = NEEDED[self.state]
        return role

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.line(self.needed(), "")
            self.at += 1

    def take(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.line(self.needed(), text)
        elif edit == "K":
            self.state = TOLD if role.startswith("s") else NEEDED[self.state]
            self.line(role, text)


def repaired(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """The columns of SUMMARY, repaired_sha256 and, if wanted, repaired: the lines `role:text` after the cheapest edits.

    Conversations are followed in order of their turns, nulls first, rows of one turn in the order of a hash. A row's
    first fault counts: blank (nothing but ASCII white space), duplicate (role and text met earlier in the conversation),
    truncated (last character, white space aside, not one of .!?). Edits keep (K), delete (D), insert (I) or give rows
    another role (R), so that the roles' initials become (s?(ua)+)?; blank and duplicate rows have to go. Roles count by
    their first letter, as it is written; empty roles and others can only be changed or deleted. A null conv_id is a
    conversation like any other, and one without rows left gives zeros. Equal rows are duplicates of each other.

    Edits are found on a byte a row. Texts are shuffled once, sorted by Spark behind their conversation's summary and
    hashed as they pass, so neither long texts nor conversations of any length are held: a hash over all of a
    conversation's text is sequential by its nature, so its rows do pass through one task. Columns other than conv_id,
    turn, role and text don't matter; an empty table gives an empty result.
    """
    head = summaries(rows).withColumns({"kind": F.lit(0), "turn": F.lit(None).cast("long"), "tie": F.lit(0).cast("long"), "copy": F.lit(0), "role": F.lit(""), "text": F.lit("")})
    body = rows.filter(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "tie", "copy", "role", "text")
    both = head.unionByName(body, allowMissingColumns=True).repartition("conv_id")
    ordered = both.sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), "tie", "copy")
    fields = [f.split() for f in SUMMARY.split(", ")]
    numbers = [n for n, _ in fields]
    more = ["repaired_sha256", *(["repaired"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, summary, schema = None, None, pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in fields] + [(n, pa.string()) for n in more])

        def ended() -> dict:
            now.inserts()
            return summary | {"repaired_sha256": now.hash.hexdigest()} | ({"repaired": "\n".join(now.lines)} if with_text else {})

        for b in batches:
            done = []
            heads = np.flatnonzero(b.column("kind").to_numpy(zero_copy_only=False) == 0).tolist()
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            for first, end in zip([0, *heads], [*heads, b.num_rows], strict=True):
                if heads and first in heads and end > first:
                    if now:
                        done.append(ended())
                    summary = {n: b.column(n)[first].as_py() for n in numbers}
                    now, first = Repaired(summary["audit"], with_text), first + 1
                for k in range(first, end):
                    now.take(roles[k], texts[k])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if now:
            yield pa.RecordBatch.from_pylist([ended()], schema=schema)

    return map_texts(ordered.select(*numbers, "kind", "role", "text"), run, SUMMARY + "".join(f", {n} string" for n in more))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))
