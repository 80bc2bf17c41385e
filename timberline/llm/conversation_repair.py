"""Repair of conversations whose turns do not alternate: cheapest edits, ties to the least audit.

A conversation should read as an optional system turn, then user and assistant in turn, ending with the assistant. Each row
is kept (0), given the role user or assistant (2) or deleted (3); empty user or assistant turns are inserted anywhere (2).
Blank rows and repeats of an earlier (role, text) must go; a row that stays though its text breaks off costs one more. The
audit is the string of the edits' initials (D, I, K, R); of the cheapest repairs the one with the ASCII-least audit is
taken.

Nodes are (row, state), states being nothing yet, system, user, assistant. A backward dynamic program gives each node its
cost to the end; arcs that keep this cost are optimal. Nodes are then ranked by the least audit of length 1, 2, 4, ... that
begins there: the rank of twice the length is the rank of the pair (own rank, rank of the node one length ahead), and the
pointers to the node ahead double alike. Letters out of a node differ, so an audit names its path and a least prefix has one
end. The path is laid out by the same pointers, doubling what is known of it in each step.

Rows are dealt by ranges of (conversation, turn), so a conversation may be longer than any task. One that lies within a task
is solved there, many at once. Others are cut into chunks of bounded rows and bytes: repeats between chunks are found by
digest, each chunk sums itself up as the 4 x 4 matrix of its costs from state to state, a pass over these (numbers alone)
from the end gives each chunk its cost to go, and a pass from the beginning its entering state; then every chunk is
repaired by itself. Only a SHA-256 of all of it must read a long conversation in one go: chunk by chunk, in order.

Defined results: rows are taken by turn, null turns first, equal turns by role and then by a hash of the text; null roles
and texts are one space; a null conversation id is a conversation; conversations without rows that are present keep a row of
zeros; a very long text is one row of a chunk; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import salted_lookup, stage

WHITE = "\t\n\x0b\x0c\r "
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.asarray([USER, USER, ASSISTANT, USER])  # the state after an inserted or re-roled turn
BLANK, REPEAT, TRUNCATED = 1, 2, 4
FAR = 1 << 40
#: Costs from the states of a conversation's end, where turns may still be inserted.
END = np.asarray([0, FAR, FAR, 0], np.int64)
_LETTERS = np.frombuffer(b" DIKR", np.uint8)
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_ROLES = {USER: "user", ASSISTANT: "assistant"}


@dataclass
class Problem:
    """Rows of a conversation or a chunk: the state that keeping a row leads to (0: it cannot be kept), its faults, the cost
    from each state at its end, and whether turns may be inserted there."""

    kinds: np.ndarray
    faults: np.ndarray
    end: np.ndarray
    last: bool
    entry: int = EMPTY


def costs_to_go(problems: list[Problem]) -> tuple[np.ndarray, np.ndarray]:
    """Cost of every node and the first layer of each problem. Problem p has a layer of four nodes per row and one for its
    end; step t looks at the t-th row from the end of every problem that has one."""
    sizes = np.asarray([len(p.kinds) for p in problems])
    first = np.r_[0, np.cumsum(sizes + 1)]
    cost = np.empty((first[-1], 4), np.int64)
    kinds, faults = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    for p, at in zip(problems, first[:-1], strict=True):
        kinds[at : at + len(p.kinds)], faults[at : at + len(p.faults)] = p.kinds, p.faults
    ends = first[1:] - 1
    cost[ends] = np.stack([p.end for p in problems])
    _inserts(cost, ends[[p.last for p in problems]])
    order = np.argsort(-sizes, kind="stable")
    longest = -sizes[order]
    for t in range(1, int(sizes.max(initial=0)) + 1):
        at = ends[order[: np.searchsorted(longest, -t, side="right")]] - t
        after = cost[at + 1]
        best = after + DELETE
        fine = (faults[at] & (BLANK | REPEAT)) == 0
        broken = np.where(fine, (faults[at] & TRUNCATED > 0) * BROKEN, FAR)[:, None]
        best = np.minimum(best, after[:, NEXT] + REROLE + broken)
        best = np.minimum(best, _kept(kinds[at], after) + KEEP + broken)
        cost[at] = best
        _inserts(cost, at)
    return cost, first


def _kept(kinds: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Cost after keeping a row of each kind, from each state; a system turn comes first, others alternate."""
    out = np.full(after.shape, FAR, np.int64)
    for kind, states in ((SYSTEM, (EMPTY,)), (USER, (EMPTY, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
        rows = np.flatnonzero(kinds == kind)
        for q in states:
            out[rows, q] = after[rows, kind]
    return out


def _inserts(cost: np.ndarray, at: np.ndarray) -> None:
    user, assistant = cost[at, USER], cost[at, ASSISTANT]
    cost[at, USER], cost[at, ASSISTANT] = np.minimum(user, assistant + INSERT), np.minimum(assistant, user + INSERT)
    for q in (EMPTY, SYSTEM):
        cost[at, q] = np.minimum(cost[at, q], cost[at, USER] + INSERT)


def optimal_arcs(problems: list[Problem], cost: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter (1 to 4: D, I, K, R; 0: the end) of the least optimal arc of every node, and the node it leads to."""
    layers = len(cost)
    kinds, faults, ends, last = np.zeros(layers, np.int64), np.zeros(layers, np.int64), np.zeros(layers, bool), np.zeros(layers, bool)
    for p, at in zip(problems, first[:-1], strict=True):
        n = len(p.kinds)
        kinds[at : at + n], faults[at : at + n] = p.kinds, p.faults
        ends[at + n], last[at + n] = True, p.last
    after = np.vstack([cost[1:], np.full((1, 4), FAR)])
    after[ends] = FAR
    broken = np.where(faults & (BLANK | REPEAT), FAR, (faults & TRUNCATED > 0) * BROKEN)[:, None]
    state = np.arange(4)
    layer = np.arange(layers)[:, None]
    inserted = np.where((~ends | last)[:, None], cost[:, NEXT] + INSERT, FAR)
    arcs = (  # in the order of their letters
        (after + DELETE, 4 * (layer + 1) + state),
        (inserted, 4 * layer + NEXT),
        (_kept(kinds, after) + KEEP + broken, np.broadcast_to(4 * (layer + 1) + kinds[:, None], (layers, 4))),
        (after[:, NEXT] + REROLE + broken, 4 * (layer + 1) + NEXT),
    )
    letter, target = np.zeros((layers, 4), np.int64), 4 * layer + state
    for k in range(4, 0, -1):
        optimal = (arcs[k - 1][0] == cost) & (cost < FAR)
        letter[optimal], target[optimal] = k, arcs[k - 1][1][optimal]
    # an end is reached where nothing need be inserted
    done = ends[:, None] & ~(last[:, None] & (letter == 2))
    letter[done] = 0
    target[done] = (4 * layer + state)[done]
    return letter.ravel(), target.ravel()


def double(letter: np.ndarray, target: np.ndarray, steps: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Pointers over 1, 2, 4, ... letters, until ``steps`` are covered, and the ranks of the nodes by that much of their
    least audits."""
    pointers, rank, length = [target], letter, 1
    while length < steps:
        ahead = pointers[-1]
        rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[ahead], return_inverse=True)[1].reshape(-1)
        pointers.append(ahead[ahead])
        length *= 2
    return pointers, rank


def least_audits(problems: list[Problem], entries: list[list[int]] | None = None) -> list[list[tuple[bytes, int, int]]]:
    """Per problem and entering state: the least audit, the state at the end, and the audit's rank among those of problems
    of its size. Without ``entries``, each problem's own entry."""
    out: list = [None] * len(problems)
    classes: dict[int, list[int]] = {}
    for i, p in enumerate(problems):
        classes.setdefault(len(p.kinds).bit_length(), []).append(i)
    for members in classes.values():
        own = [problems[i] for i in members]
        cost, first = costs_to_go(own)
        letter, target = optimal_arcs(own, cost, first)
        pointers, rank = double(letter, target, 3 * (max(len(p.kinds) for p in own) + 1))
        wanted = [entries[i] if entries else [problems[i].entry] for i in members]
        starts = np.asarray([4 * at + q for at, states in zip(first, wanted) for q in states])
        path = starts[:, None]
        for ahead in pointers:
            path = np.hstack([path, ahead[path]])
        letters = letter[path]
        lengths = (letters > 0).sum(axis=1)
        spelled = _LETTERS[letters]
        found = iter(zip(spelled, lengths, path[:, -1] & 3, rank[starts], strict=True))
        for i, states in zip(members, wanted, strict=True):
            out[i] = [(row[:n].tobytes(), int(q), int(r)) for row, n, q, r in (next(found) for _ in states)]
    return out


def apply_audit(audit: bytes, entry: int, kinds: np.ndarray, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """The repaired turns that an audit spells out."""
    state, at = entry, 0
    new_roles: list[str] = []
    new_texts: list[str] = []
    for letter in audit:
        if letter == 73:  # I
            state = int(NEXT[state])
            new_roles.append(_ROLES[state])
            new_texts.append("")
            continue
        if letter == 75:  # K
            state = int(kinds[at])
            new_roles.append(roles[at])
            new_texts.append(texts[at])
        elif letter == 82:  # R
            state = int(NEXT[state])
            new_roles.append(_ROLES[state])
            new_texts.append(texts[at])
        at += 1
    return new_roles, new_texts


def cost_of(audit: bytes, faults: np.ndarray) -> int:
    kept = np.frombuffer(audit.replace(b"I", b""), np.uint8) != 68
    return DELETE * audit.count(b"D") + INSERT * audit.count(b"I") + REROLE * audit.count(b"R") + int(((faults & TRUNCATED > 0) & kept).sum()) * BROKEN


_TURNS = "turns array<struct<role: string, text: string>>"
_COUNTS = "n_rows long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, min_turn long, max_turn long, n_turns long"


class _Rows:
    """Rows of one conversation, or of one chunk of it."""

    def __init__(self, conv) -> None:
        self.conv = conv
        self.turns: list = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults: list[int] = []
        self.digests: list[bytes] = []
        self.bytes = 0

    def add(self, turn, role: str, text: str, faults: int, digest: bytes) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(faults)
        self.digests.append(digest)
        self.bytes += len(text)

    def close(self) -> None:
        """Mark repeats within, and count."""
        seen: set[bytes] = set()
        self.kinds = np.asarray([_INITIALS.get(r[:1], 0) for r in self.roles], np.int64)
        for i, (fault, digest) in enumerate(zip(self.faults, self.digests, strict=True)):
            if not fault & BLANK:
                if digest in seen:
                    self.faults[i] = REPEAT
                seen.add(digest)
        self.marks = np.asarray(self.faults, np.int64)
        known = [t for t in self.turns if t is not None]
        pairs = {"su", "ua", "au"}
        illegal = sum(a[:1] + b[:1] not in pairs for a, b in zip(self.roles, self.roles[1:]))
        ends = (self.roles[0][:1], self.roles[-1][:1]) if self.roles else (None, None)
        self.counts = (len(self.roles), *fault_counts(self.marks), illegal, *ends, min(known, default=None), max(known, default=None), len(set(known)))


def fault_counts(marks: np.ndarray) -> tuple[int, int, int]:
    return int((marks == BLANK).sum()), int((marks == REPEAT).sum()), int((marks == TRUNCATED).sum())


def _turns_array(turns: list[tuple[list[str], list[str]]]):
    import pyarrow as pa

    ends = np.r_[0, np.cumsum([len(r) for r, _ in turns])].astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array([x for r, _ in turns for x in r], pa.string()), pa.array([x for _, t in turns for x in t], pa.string())], names=["role", "text"])
    return pa.ListArray.from_arrays(pa.array(ends), flat)


_COUNT_NAMES = [c.split()[0] for c in _COUNTS.split(", ")]


def _counts_arrays(counts: list[tuple]) -> list:
    import pyarrow as pa

    columns = list(zip(*counts, strict=True))
    return [pa.array(c, pa.string() if "initial" in name else pa.int64()) for name, c in zip(_COUNT_NAMES, columns, strict=True)]


@dataclass
class Repaired:
    """``parts`` has a row per conversation, or per chunk of a long one, with its repaired turns; ordered by (part, no)."""

    parts: DataFrame
    conv: str

    def turns(self) -> DataFrame:
        """One row per repaired turn, in the order of (part, no, at)."""
        return self.parts.select(self.conv, "part", "no", F.posexplode("turns").alias("at", "turn")).select(self.conv, "part", "no", "at", "turn.role", "turn.text")

    def summary(self) -> DataFrame:
        """One row per conversation: gaps, fault counts, illegal neighbours, cost, audit, SHA-256 of the repaired turns."""
        whole = self.parts.filter(~F.col("long"))
        joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
        gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0))
        single = whole.select(self.conv, gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.col("audit").cast("string").alias("audit"), F.sha2(joined, 256).alias("repaired_sha256"))
        return single.unionAll(_long_summary(self.parts.filter("long"), self.conv))


def repair(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present: Column | None = None,
    chunk_rows: int = 4096,
    chunk_bytes: int = 4 << 20,
) -> Repaired:
    """Repair every conversation. Rows that are not ``present`` only name theirs."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col))
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    read = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"), here.alias("here"))
    ended = F.rtrim(F.col("text"), F.lit(WHITE))
    faults = F.when(ended == "", BLANK).when(~F.substring(ended, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    digest = F.unhex(F.md5(F.concat_ws("\x00", F.col("conv").isNull().cast("string"), F.coalesce(F.col("conv").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text")))
    keyed = read.select(
        "conv", "turn", F.when(F.col("here"), F.col("role")).alias("role"), F.when(F.col("here"), F.col("text")).alias("text"),
        "here", faults.alias("faults"), digest.alias("digest"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv", "turn", "role", "tie", "row"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "here", "faults", "digest")
    kind = dict(read.dtypes)["conv"]
    schema = f"conv {kind}, open boolean, part int, no int, {_COUNTS}, cost long, audit binary, marks binary, kinds binary, digests array<binary>, {_TURNS}"
    found = stage(dealt.mapInArrow(_first_pass(chunk_rows, chunk_bytes), schema), "conversations")
    shown = ["conv", "long", "part", "no", *_COUNT_NAMES, "cost", "audit", "turns"]
    solved = found.filter(~F.col("open")).withColumn("long", F.lit(False)).select(*shown)
    chunks = found.filter("open")
    if not chunks.isEmpty():
        solved = solved.unionAll(_repair_long(chunks, kind).select(*shown))
    return Repaired(solved.withColumnRenamed("conv", conv_col), conv_col)


def _first_pass(chunk_rows: int, chunk_bytes: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, no, kind = TaskContext.get().partitionId(), 0, None
        ready: list[_Rows] = []
        waiting = 0
        own: _Rows | None = None
        first, cut = True, False  # of the conversation at hand: the task's first, already cut

        def chunk(rows: _Rows):
            nonlocal no
            no += 1
            rows.close()
            digests = [None if f & (BLANK | REPEAT) else d for f, d in zip(rows.faults, rows.digests, strict=True)]
            return _record([rows], kind, True, part, [no], [None], [None], [(rows.roles, rows.texts)], [digests])

        def solve():
            nonlocal ready, waiting, no
            for rows in ready:
                rows.close()
            problems = [Problem(r.kinds, r.marks, END, True) for r in ready]
            audits = [a[0][0] for a in least_audits(problems)]
            turns = [apply_audit(a, EMPTY, r.kinds, r.roles, r.texts) for a, r in zip(audits, ready, strict=True)]
            costs = [cost_of(a, r.marks) for a, r in zip(audits, ready, strict=True)]
            out = _record(ready, kind, False, part, range(no + 1, no + 1 + len(ready)), costs, audits, turns, [None] * len(ready))
            no += len(ready)
            ready, waiting = [], 0
            return out

        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, turn, role, text, here, faults, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is None or conv != own.conv:
                    if own is not None:
                        if first or cut:
                            yield chunk(own)
                        else:
                            ready.append(own)
                            waiting += len(own.roles)
                            if waiting >= 8192 or len(ready) >= 8192:
                                yield solve()
                        first, cut = False, False
                    own = _Rows(conv)
                if here:
                    own.add(turn, role, text, faults, digest)
                if len(own.roles) >= chunk_rows or own.bytes >= chunk_bytes:
                    yield chunk(own)
                    own, cut = _Rows(conv), True
        if ready:
            yield solve()
        if own is not None:
            yield chunk(own)  # it may go on in the next task

    return run


def _record(rows: list[_Rows], kind, open_: bool, part: int, numbers, costs, audits, turns, digests):
    import pyarrow as pa

    n = len(rows)
    columns = [pa.array([r.conv for r in rows], kind), pa.array([open_] * n), pa.array([part] * n, pa.int32()), pa.array(list(numbers), pa.int32()), *_counts_arrays([r.counts for r in rows])]
    columns += [pa.array(costs, pa.int64()), pa.array(audits, pa.binary())]
    columns += [pa.array([r.marks.astype(np.uint8).tobytes() if open_ else None for r in rows], pa.binary()), pa.array([r.kinds.astype(np.uint8).tobytes() if open_ else None for r in rows], pa.binary())]
    columns += [pa.array(digests, pa.list_(pa.binary())), _turns_array(turns)]
    return pa.RecordBatch.from_arrays(columns, names=["conv", "open", "part", "no", *_COUNT_NAMES, "cost", "audit", "marks", "kinds", "digests", "turns"])


def _repair_long(chunks: DataFrame, kind: str) -> DataFrame:
    key = ["part", "no"]
    # repeats of what an earlier chunk holds
    at = F.struct(*key)
    rows = chunks.select(*key, F.posexplode("digests").alias("i", "digest")).filter("digest is not null")
    firsts = rows.groupBy("digest").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    late = salted_lookup(rows, "digest", firsts, F.struct(*key, "i")).filter(at > F.col("first")).groupBy(*key).agg(F.collect_list("i").alias("late"))

    def matrices(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                marks = np.frombuffer(r["marks"], np.uint8).copy()
                marks[np.asarray(r.pop("late") or [], np.int64)] = REPEAT
                r["marks"] = marks.tobytes()
            problems = [Problem(np.frombuffer(r["kinds"], np.uint8).astype(np.int64), np.frombuffer(r["marks"], np.uint8).astype(np.int64), np.where(np.arange(4) == x, 0, FAR), False) for r in rows for x in range(4)]
            cost, first = costs_to_go(problems)
            for i, r in enumerate(rows):
                r["matrix"] = np.minimum(np.stack([cost[first[4 * i + x]] for x in range(4)], axis=1), FAR).ravel().tolist()
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*(batch.schema.field(c) for c in ("conv", "part", "no", "marks", "kinds")), pa.field("matrix", pa.list_(pa.int64()))]))

    marked = chunks.select("conv", *key, "marks", "kinds").join(late, key, "left").select("conv", *key, "marks", "kinds", "late")
    costed = stage(marked.mapInArrow(matrices, f"conv {kind}, part int, no int, marks binary, kinds binary, matrix array<long>"), "chunk-costs")

    def backward(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, vector = [], END
        for batch in batches:
            out = []
            for conv, part, no, matrix in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "no", "matrix")), strict=True):
                last = held != [conv]
                if last:
                    held, vector = [conv], END
                out.append((part, no, vector.tolist(), last))
                if last:
                    vector = _with_inserts(vector)
                vector = np.minimum((np.asarray(matrix, np.int64).reshape(4, 4) + vector).min(axis=1), FAR)
            yield _columns(out, ("part", "no", "vector", "last"), (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_()))

    slim = costed.select("conv", *key, "matrix").repartition("conv")
    vectors = slim.sortWithinPartitions("conv", F.desc("part"), F.desc("no")).mapInArrow(backward, "part int, no int, vector array<long>, last boolean")
    aimed = stage(costed.drop("matrix").join(vectors, key), "chunk-aims")

    def exits(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            found = least_audits([_problem(r) for r in rows], [[0, 1, 2, 3]] * len(rows))
            yield _columns([(r["conv"], r["part"], r["no"], [x[1] for x in f]) for r, f in zip(rows, found, strict=True)], ("conv", "part", "no", "exits"), (batch.schema.field("conv").type, pa.int32(), pa.int32(), pa.list_(pa.int32())))

    def forward(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, state = [], EMPTY
        for batch in batches:
            out = []
            for conv, part, no, ends in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "no", "exits")), strict=True):
                if held != [conv]:
                    held, state = [conv], EMPTY
                out.append((part, no, state))
                state = ends[state]
            yield _columns(out, ("part", "no", "entry"), (pa.int32(), pa.int32(), pa.int32()))

    left = aimed.mapInArrow(exits, f"conv {kind}, part int, no int, exits array<int>").repartition("conv").sortWithinPartitions("conv", *key)
    entries = left.mapInArrow(forward, "part int, no int, entry int")

    def solve(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):  # a chunk holds up to chunk_bytes of text
                r = batch.slice(at, 1).to_pylist()[0]
                problem = _problem(r)
                audit = least_audits([problem])[0][0][0]
                turns = apply_audit(audit, problem.entry, problem.kinds, [t["role"] for t in r["turns"]], [t["text"] for t in r["turns"]])
                counts = (r["n_rows"], *fault_counts(problem.faults), *(r[c] for c in _COUNT_NAMES[4:]))
                columns = [pa.array([r["conv"]], batch.schema.field("conv").type), pa.array([True]), pa.array([r["part"]], pa.int32()), pa.array([r["no"]], pa.int32()), *_counts_arrays([counts])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([cost_of(audit, problem.faults)], pa.int64()), pa.array([audit], pa.binary()), _turns_array([turns])], names=["conv", "long", "part", "no", *_COUNT_NAMES, "cost", "audit", "turns"])

    plan = aimed.drop("conv").join(entries, key)
    whole = chunks.select("conv", *key, *_COUNT_NAMES, "turns").join(plan, key)
    return stage(whole.mapInArrow(solve, f"conv {kind}, long boolean, part int, no int, {_COUNTS}, cost long, audit binary, {_TURNS}"), "chunks-repaired")


def _with_inserts(vector: np.ndarray) -> np.ndarray:
    out = vector.reshape(1, 4).copy()
    _inserts(out, np.asarray([0]))
    return out[0]


def _problem(r: dict) -> Problem:
    return Problem(np.frombuffer(r["kinds"], np.uint8).astype(np.int64), np.frombuffer(r["marks"], np.uint8).astype(np.int64), np.asarray(r["vector"], np.int64), r["last"], r.get("entry") or EMPTY)


def _columns(rows: list[tuple], names, kinds):
    import pyarrow as pa

    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))


def _long_summary(parts: DataFrame, conv: str) -> DataFrame:
    """Chunks in order, conversation by conversation: sums, seams between chunks, the audit, and the running hash."""
    kind = dict(parts.dtypes)[conv]
    schema = f"{conv} {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None

        def flush():
            least, most = held["min"], held["max"]
            row = (held["conv"], most - least + 1 - held["distinct"] if least is not None else 0, *held["sums"], b"".join(held["audit"]).decode(), held["hash"].hexdigest())
            return _columns([row], names, (field, *[pa.int64()] * 6, pa.string(), pa.string()))

        for batch in batches:
            field = batch.schema.field(conv).type
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if held is None or held["conv"] != r[conv]:
                    if held is not None:
                        yield flush()
                    held = {"conv": r[conv], "min": None, "max": None, "distinct": 0, "sums": np.zeros(5, np.int64), "audit": [], "hash": hashlib.sha256(), "last": None, "any": False}
                seam = 0
                if r["n_rows"]:
                    seam = held["last"] is not None and held["last"] + r["first_initial"] not in ("su", "ua", "au")
                    held["last"] = r["last_initial"]
                held["sums"] = held["sums"] + np.asarray([r["blank"], r["duplicate"], r["truncated"], r["illegal"] + seam, r["cost"]])
                if r["min_turn"] is not None:
                    held["distinct"] += r["n_turns"] - (held["max"] == r["min_turn"])
                    held["min"] = r["min_turn"] if held["min"] is None else held["min"]
                    held["max"] = r["max_turn"]
                held["audit"].append(r["audit"])
                for turn in r["turns"]:
                    if held["any"]:
                        held["hash"].update(b"\n")
                    held["any"] = True
                    held["hash"].update(f"{turn['role']}:{turn['text']}".encode())
        if held is not None:
            yield flush()

    return parts.repartition(conv).sortWithinPartitions(conv, "part", "no").mapInArrow(run, schema)
