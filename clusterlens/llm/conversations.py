"""Conversation structure repair by parallel Viterbi with rank convergence.

A conversation should read `(s?(ua)+)?` by the initials of its roles. Each row may be kept, given the role of user or
assistant, or deleted, and rows without text may be inserted; blank and repeated rows must go. The cheapest edits are
the cheapest way through four states (nothing yet, after system, after user, after assistant), and a backward cost
vector holds what is still to pay from each state at a row.

1. Rows are range-partitioned in order of conversation, turn, role and text, so that a conversation of any size is
   spread over tasks. A task cuts its rows into chunks: rows of one conversation, at most `CHUNK_ROWS` of them. A
   conversation that begins and ends inside one chunk is settled there and then; only longer ones, and those at the
   edge of a partition, go on as chunks, one row each.
2. A chunk does not know the costs behind it. It starts from four speculative vectors (`BOUNDS`) and gets a matrix. Where
   its columns differ only by constants the rank has converged: the vector at the chunk's start is then the same, up
   to a constant, whatever follows. The last chunk knows what follows: nothing.
3. Fix-up passes rerun the others from the vectors behind them until all differ only by constants. A pass joins each open
   chunk with the span that follows it and doubles its span, so the passes are at most log2 of the chunks even where no
   rank ever converges (a conversation of repeats only).
4. The constants are stitched: what each chunk adds over the vector behind it, summed, is the cost.
5. With the vector behind it each chunk traces the least audit from all four states at its start: the first letter, in
   order D, I, K, R, that stays on a cheapest way. The ways are linked by the same passes, from the front; where all
   four ways of a span meet in one state, the entry of the next chunk is known.
6. Digests of conversations of several chunks are made in one pass over their chunks in order, none of which is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterlens.llm.shared import Scratch

CHUNK_ROWS = 1024
CHUNK_BYTES = 1 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40  # more than any cost
INSERT, REROLE, DELETE, CUT_OFF = 2, 2, 3, 1
INSERTED = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # also where a new role leads
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "."
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
VISIBLE = r"[^\x20\x09-\x0D]"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and whether the row is left, after damage; a null role or text counts as one space.

    What happens to a row is drawn by crc32(`conv_id:turn`) % 20, nulls as one space: 0 drops it, 1 empties its text,
    2 takes `.`, `!` and `?` out of it, 3 lists it twice, 4 makes the user its speaker.
    """

    def or_space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat_ws(":", or_space("conv_id"), or_space("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), draw.alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("draw") != 0).alias("left"), copies.alias("copy"))


# ---- the four states


def _insertions(costs: list[int]) -> list[int]:
    """Costs with rows inserted before the next one, from the costs without."""
    u, a = costs[USER], costs[ASSISTANT]
    one = min(INSERT + u, 2 * INSERT + a)
    return [min(costs[START], one), min(costs[SYSTEM], one), min(u, INSERT + a), min(a, INSERT + u)]


LAST = _insertions([0, FAR, FAR, 0])  # what is to pay behind the last row
# The most by which a state can be dearer than another (row than column), whatever follows: it edits as the other does, and
# where it cannot, inserts or deletes. Every true cost vector keeps these bounds, so the four columns, the
# speculative vectors, stand for all of them: a true vector is their least sum with its own values.
BOUNDS = [[0, 0, 2, 0], [4, 0, 2, 4], [5, 2, 0, 2], [3, 0, 2, 0]]


def _steps(initial: str, fault: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row as (letter, cost, next state), in order of their letters; insertions are not among them."""
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    extra = CUT_OFF if fault == TRUNCATED else 0
    kept = KEPT.get(initial, {}).get(state)
    if kept is not None:
        yield "K", extra, kept
    yield "R", REROLE + extra, INSERTED[state]


_TABLE = {
    (i, f): [list(_steps(i, f, state)) for state in range(4)] for i in ("s", "u", "a", "") for f in (BLANK, DUPLICATE, TRUNCATED, SOUND)
}


def _kind(initial: str) -> str:
    return initial if initial in KEPT else ""


def backward(initials: list[str], faults: list[str], behind: list[int]) -> list[list[int]]:
    """The cost vector before each row, and behind the last one, insertions included."""
    out = [behind]
    for i, f in zip(reversed(initials), reversed(faults), strict=True):
        nxt = out[-1]
        out.append(_insertions([min(cost + nxt[to] for _, cost, to in steps) for steps in _TABLE[_kind(i), f]]))
    return out[::-1]


def trace(initials: list[str], faults: list[str], costs: list[list[int]], state: int, last: bool) -> tuple[str, list[tuple[int, int]], int]:
    """The least audit from a state on, the repaired rows as (row, state; row -1 for an inserted one), the state left in."""
    audit, rows, n, at = [], [], len(initials), 0
    while True:
        now = costs[at][state]
        if at == n and (not last or state in (START, ASSISTANT)):
            return "".join(audit), rows, state
        steps = _TABLE[_kind(initials[at]), faults[at]][state] if at < n else []
        fits = {letter: to for letter, cost, to in steps if cost + costs[at + 1][to] == now}
        if "D" in fits:
            audit.append("D")
            at += 1
            continue
        to = INSERTED[state]
        if INSERT + costs[at][to] == now:
            audit.append("I")
            rows.append((-1, to))
            state = to
            continue
        letter = "K" if "K" in fits else "R"
        audit.append(letter)
        state = fits[letter]
        rows.append((at if letter == "K" else -2 - at, state))
        at += 1


def _repaired(rows: list[tuple[int, int]], roles: list[str], texts: list[str]) -> str:
    parts = []
    for row, state in rows:
        if row >= 0:
            parts.append(f"{roles[row]}:{texts[row]}")
        else:
            parts.append(f"{NAMES[state]}:{texts[-2 - row] if row < -1 else ''}")
    return "\n".join(parts)


# ---- chunks


class _Chunk:
    """Consecutive rows of one conversation."""

    def __init__(self, conv):
        self.conv, self.bytes = conv, 0
        self.turns, self.roles, self.texts, self.initials, self.faults, self.digests = [], [], [], [], [], []
        self.seen: set[bytes] = set()
        self.first_of: list[tuple[bytes, int]] = []

    def add(self, turn, role: str, text: str, fault: str, digest: bytes) -> None:
        if fault != BLANK:
            if digest in self.seen:
                fault = DUPLICATE
            else:
                self.seen.add(digest)
                self.first_of.append((digest, len(self.turns)))
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.initials.append(role[:1])
        self.faults.append(fault)
        self.bytes += len(text)

    def summary(self) -> dict:
        known = [t for t in self.turns if t is not None]
        pairs = zip(self.initials, self.initials[1:], strict=False)
        return {
            "low": known[0] if known else None,
            "high": known[-1] if known else None,
            "distinct": sum(a != b for a, b in zip(known, known[1:], strict=False)) + bool(known),
            "illegal": sum(a + b not in LEGAL for a, b in pairs),
        }

    def settled(self) -> dict:
        """The result of a conversation that is all in here."""
        s = self.summary()
        costs = backward(self.initials, self.faults, LAST)
        audit, rows, _ = trace(self.initials, self.faults, costs, START, True)
        text = _repaired(rows, self.roles, self.texts)
        return {
            "conv_id": self.conv,
            "whole": True,
            "gaps": s["high"] - s["low"] + 1 - s["distinct"] if s["low"] is not None else 0,
            **_fault_counts(self.faults),
            "illegal": s["illegal"],
            "cost": costs[0][START],
            "audit": audit,
            "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
        }

    def open(self, number: int) -> dict:
        return {
            "conv_id": self.conv,
            "whole": False,
            "chunk": number,
            **self.summary(),
            "roles": self.roles,
            "texts": self.texts,
            "faults": "".join(self.faults),
            "keys": [d for d, _ in self.first_of],
            "key_rows": [r for _, r in self.first_of],
        }


def _fault_counts(faults) -> dict:
    return {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED)}


def _cut(conv_type: str, turn_type: str, chunk_rows: int) -> tuple:
    """Function and schema of the pass that settles whole conversations and cuts the others."""
    schema = (
        f"conv_id {conv_type}, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        f"repaired_sha256 string, chunk long, low {turn_type}, high {turn_type}, distinct long, roles array<string>, texts array<string>, "
        "faults string, keys array<binary>, key_rows array<int>"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        chunk: _Chunk | None = None
        inner = True  # nothing of the chunk's conversation can lie outside of it
        begun = False
        types = None
        ready: list[dict] = []

        def close(more: bool) -> None:
            nonlocal number
            if inner and not more:
                ready.append(chunk.settled())
            else:
                ready.append(chunk.open(number))
                number += 1

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r.get(n) for r in ready], types[n]) for n in names]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            if types is None:
                types = _arrow_types(batch.schema)
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "digest", "left"))
            for conv, turn, role, text, fault, digest, left in zip(*columns, strict=True):
                if chunk is None or conv != chunk.conv:
                    if chunk is not None:
                        close(False)
                    inner = begun
                    begun = True
                    chunk = _Chunk(conv)
                elif len(chunk.turns) >= chunk_rows or chunk.bytes >= CHUNK_BYTES:
                    close(True)
                    chunk, inner = _Chunk(conv), False
                if left:
                    chunk.add(turn, role, text, fault, digest)
                if len(ready) >= 2000:
                    yield flush()
        if chunk is not None:
            close(True)
        if ready:
            yield flush()

    return run, schema


def _arrow_types(schema: pa.Schema) -> dict:
    conv, turn = schema.field("conv_id").type, schema.field("turn").type
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "chunk", "distinct")
    text = pa.string()
    return {
        **dict.fromkeys(longs, pa.int64()),
        **{"conv_id": conv, "whole": pa.bool_(), "audit": text, "repaired_sha256": text, "low": turn, "high": turn, "faults": text},
        **{"roles": pa.list_(text), "texts": pa.list_(text), "keys": pa.list_(pa.binary()), "key_rows": pa.list_(pa.int32())},
    }


# ---- linking chunks


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cross-chunk duplicates enter the faults; the chunk's matrix, row by row: least cost from a state to a state behind it."""
    for batch in batches:
        faults, out, counts = [], [], {c: [] for c in ("blank", "duplicate", "truncated")}
        for roles, marks, later, last in zip(*(batch.column(c).to_pylist() for c in ("roles", "faults", "later", "last")), strict=True):
            f = list(marks)
            for row in later or ():
                f[row] = DUPLICATE
            initials = [r[:1] for r in roles]
            ends = [LAST] * 4 if last else [[BOUNDS[s][t] for s in range(4)] for t in range(4)]
            columns = [backward(initials, f, end)[0] for end in ends]
            out.append([columns[t][s] for s in range(4) for t in range(4)])
            faults.append("".join(f))
            for name, n in _fault_counts(f).items():
                counts[name].append(n)
        columns = [batch.column("i"), batch.column("link"), pa.array(faults, pa.string()), pa.array(out, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            [*columns, *(pa.array(c, pa.int64()) for c in counts.values())], names=["i", "link", "faults", "matrix", *counts]
        )


def _times(a: Column, b: Column) -> Column:
    """Product of two matrices of costs: the cheapest way through both."""

    def cell(k: Column) -> Column:
        row, col = F.floor(k / 4).cast("int") * 4, k % 4
        return F.array_min(F.array(*[F.least(F.lit(FAR), F.get(a, row + j) + F.get(b, col + 4 * j)) for j in range(4)]))

    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def _settled(m: Column) -> Column:
    """Whether the columns of a matrix differ only by constants; a way that does not exist stays so."""
    same = [F.get(m, F.lit(4 * s + t)) - F.get(m, F.lit(4 * s)) == F.get(m, F.lit(t)) - F.get(m, F.lit(0)) for s in range(1, 4) for t in range(1, 4)]
    out = F.lit(True)
    for x in same:
        out = out & x
    return out


def link(scratch: Scratch, chunks: DataFrame, forward: bool, label: str) -> DataFrame:
    """link, i, matrix: each chunk's matrix multiplied with those behind (before) it until its columns differ only by constants.

    `chunks` has (link, i, matrix); chunks of a conversation share `link` and are numbered by i from 0. The matrix of
    the end must differ only by constants from the start. Every pass doubles the span of the open ones.
    """
    state = scratch.stage(chunks.select("link", "i", "matrix", F.lit(1).alias("span"), _settled(F.col("matrix")).alias("done")), f"{label}-0")
    done, turn = 0, -1 if forward else 1
    while not state.where("not done").isEmpty():
        done += 1
        other = state.select(F.col("link").alias("l2"), F.col("i").alias("i2"), F.col("matrix").alias("m2"), F.col("span").alias("s2"))
        at = (F.col("link") == F.col("l2")) & (F.col("i") + turn * F.col("span") == F.col("i2")) & ~F.col("done")
        met = state.join(other, at, "left")
        # chunks of a conversation lie side by side: what an open one needs is always there
        product = _times(F.col("matrix"), F.col("m2")) if not forward else _times(F.col("m2"), F.col("matrix"))
        matrix = F.when(F.col("done"), F.col("matrix")).otherwise(product)
        nxt = met.select("link", "i", matrix.alias("matrix"), (F.col("span") + F.coalesce("s2", F.lit(0))).alias("span"))
        state = scratch.stage(nxt.withColumn("done", _settled(F.col("matrix"))), f"{label}-{done}")
    return state.select("link", "i", "matrix")


def _column(m: Column, t: int = 0) -> Column:
    return F.array(*[F.get(m, F.lit(4 * s + t)) for s in range(4)])


def _normal(v: Column) -> Column:
    return F.transform(v, lambda x: x - F.array_min(v))


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the least audit leaves each chunk, for each state it may be entered in, as a matrix of cost 0 or far."""
    for batch in batches:
        out = []
        for roles, faults, behind, last, i in zip(*(batch.column(c).to_pylist() for c in ("roles", "faults", "behind", "last", "i")), strict=True):
            initials = [r[:1] for r in roles]
            costs = backward(initials, list(faults), behind)
            exits = [trace(initials, list(faults), costs, s if i else START, last)[2] for s in range(4)]
            out.append([0 if exits[s] == t else FAR for s in range(4) for t in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("link"), batch.column("i"), pa.array(out, pa.list_(pa.int64()))], names=["link", "i", "matrix"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole conversations in order: the audit and the digest of each conversation."""
    conv, audit, sha, any_row = None, [], None, False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array(["".join(audit)], pa.string()), pa.array([sha.hexdigest()], pa.string())],
            names=["link", "audit", "repaired_sha256"],
        )

    names = ("link", "roles", "texts", "faults", "behind", "entry", "last")
    for batch in batches:
        for k in range(len(batch)):
            one, roles, texts, faults, behind, entry, last = (batch.column(c)[k].as_py() for c in names)
            if sha is None or one != conv:
                if sha is not None:
                    yield row()
                conv, audit, sha, any_row = one, [], hashlib.sha256(), False
            initials = [r[:1] for r in roles]
            letters, rows, _ = trace(initials, list(faults), backward(initials, list(faults), behind), entry, last)
            audit.append(letters)
            if rows:
                sha.update((b"\n" if any_row else b"") + _repaired(rows, roles, texts).encode())
                any_row = True
    if sha is not None:
        yield row()


def _long_conversations(scratch: Scratch, chunks: DataFrame) -> DataFrame:
    """The results of conversations that lie in several chunks, or at the edge of a partition."""
    by = Window.partitionBy("conv_id").orderBy("chunk")
    ends = [F.get("roles", F.lit(0)).alias("head"), F.element_at(F.when(F.size("roles") > 0, F.col("roles")), -1).alias("tail")]
    narrow = chunks.select("conv_id", "chunk", "low", "high", "distinct", "illegal", *ends)
    places = narrow.select(
        "*",
        (F.row_number().over(by) - 1).alias("i"),
        F.first("chunk").over(by).alias("link"),
        F.lead("chunk").over(by).isNull().alias("last"),
        F.last("high", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("turn_before"),
        F.last("tail", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("tail_before"),
    )
    places = scratch.stage(places, "places")
    keys = chunks.select("conv_id", "chunk", F.explode(F.arrays_zip("keys", "key_rows")).alias("k")).select("conv_id", "chunk", "k.keys", "k.key_rows")
    first = F.min("chunk").over(Window.partitionBy("conv_id", "keys"))
    later = keys.withColumn("first", first).where("chunk > first").groupBy("chunk").agg(F.collect_list("key_rows").alias("later"))
    numbers = places.select("chunk", "i", "link", "last")
    marked = chunks.select("chunk", "roles", "faults").join(numbers, "chunk").join(later, "chunk", "left").select("link", "i", "last", "roles", "faults", "later")
    schema = "i int, link long, faults string, matrix array<bigint>, blank long, duplicate long, truncated long"
    speculative = scratch.stage(marked.mapInArrow(_matrices, schema), "speculative")

    ahead = link(scratch, speculative, False, "costs").select("link", "i", _normal(_column(F.col("matrix"))).alias("vector"))
    behind = ahead.select("link", (F.col("i") - 1).alias("i"), F.col("vector").alias("behind"))
    solved = speculative.join(behind, ["link", "i"], "left").join(ahead, ["link", "i"])
    ended = F.array(*[F.lit(x).cast("long") for x in LAST])
    solved = solved.withColumn("last", F.col("behind").isNull()).withColumn("behind", F.coalesce("behind", ended))
    # what a chunk adds: its own matrix applied to the vector behind it, over the normal vector at its start
    through = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.get("matrix", t) + F.get("behind", t)))
    through = F.when(F.col("last"), F.get("matrix", F.lit(0))).otherwise(through)
    added = through - F.when(F.col("i") > 0, F.get("vector", F.lit(0))).otherwise(0)
    solved = scratch.stage(solved.select("link", "i", "faults", "behind", "last", "blank", "duplicate", "truncated", added.alias("added")), "solved")

    body = chunks.select("chunk", "roles", "texts").join(places.select("chunk", "i", "link"), "chunk").join(solved, ["link", "i"])
    ways = body.select("link", "i", "roles", "faults", "behind", "last").mapInArrow(_ways, "link long, i int, matrix array<bigint>")
    exits = link(scratch, ways, True, "ways")
    exit_state = sum((F.when(F.get("matrix", F.lit(t)) == 0, t).otherwise(0) for t in range(4)), F.lit(0))
    entries = exits.select("link", (F.col("i") + 1).alias("i"), exit_state.alias("entry"))
    traced = body.join(entries, ["link", "i"], "left").withColumn("entry", F.coalesce("entry", F.lit(START)))
    traced = traced.select("link", "i", "roles", "texts", "faults", "behind", "entry", "last").repartition("link").sortWithinPartitions("link", "i")
    told = traced.drop("i").mapInArrow(_pieces, "link long, audit string, repaired_sha256 string")

    apart = F.concat(F.substring("tail_before", 1, 1), F.substring(F.col("head"), 1, 1)).isin(*LEGAL)
    seam = F.when(F.col("head").isNotNull() & F.col("tail_before").isNotNull() & ~apart, 1).otherwise(0)
    again = F.when(F.col("low") == F.col("turn_before"), 1).otherwise(0)
    spread = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("distinct") - again), F.lit(0))
    summed = places.groupBy("link").agg(
        F.first("conv_id").alias("conv_id"), spread.cast("long").alias("gaps"), F.sum(F.col("illegal") + seam).alias("illegal")
    )
    faults = solved.groupBy("link").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum("added").alias("cost"))
    out = summed.join(faults, "link").join(scratch.stage(told, "told"), "link")
    return out.select("conv_id", *COUNTS, "audit", "repaired_sha256")


def repair(spark: SparkSession, rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    A null conv_id is a conversation; null turns come first and count for no gap; a null role or text is one space. Rows
    of one turn are taken in order of role, then of the SHA-256 of role and text. Where the column `left` of `rows` is
    false a row only names its conversation; one without other rows has zeros and an empty audit. Rows with equal role
    and text, by SHA-256, are duplicates of the first. Other columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(spark, "conversations")

    def or_space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    role, text = or_space("role"), or_space("text")
    ends = F.regexp_extract(text, rf"(?s)({VISIBLE})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~text.rlike(VISIBLE), BLANK).when(~ends.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    digest = F.unhex(F.sha2(F.concat(role, F.lit(":"), text, F.lit(":"), F.length(role).cast("string")), 256))
    left = F.col("left") if "left" in rows.columns else F.lit(True)
    ready = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"), digest.alias("digest"), left.alias("left"))
    ready = ready.withColumn("tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "digest", "tie"]
    ready = ready.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    run, schema = _cut(rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString(), chunk_rows)
    cut = scratch.stage(ready.mapInArrow(run, schema), "cut")
    chunks = cut.where("not whole").select("conv_id", "chunk", "low", "high", "distinct", "illegal", "roles", "texts", "faults", "keys", "key_rows")
    settled = cut.where("whole").select("conv_id", *COUNTS, "audit", "repaired_sha256")
    return settled.unionByName(_long_conversations(scratch, chunks))


def damage_and_repair(spark: SparkSession, rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`repair` after `damaged`: a row for every conv_id there is, also where all its rows are dropped."""
    return repair(spark, damaged(rows), chunk_rows)
