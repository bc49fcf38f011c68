"""Repair of conversation structure by the cheapest edits: dynamic programming with checkpoints.

A conversation's roles have to read (s?(ua)+)?: nothing, or an optional system turn and then user and
assistant in turn. Rows are kept, deleted or given another role, and empty turns are put in. Four states
say what may follow (START, after a system, user or assistant turn); the cost of the cheapest ending is
a vector over them.

Backward, such vectors are stored at every square-root-th row only; forward, the vectors of one block are
worked out again from the checkpoint behind it, and the edits are read off: the ASCII-least of those that
are tight. Across tasks the same holds for segments: a conversation that is long, or lies on the edge of a
range of rows, is cut into segments; each gives the cheapest costs between its states, a backward pass
over these few numbers gives each segment its checkpoint, a forward pass its entry, and all segments
then emit their edits side by side.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamem.llm import common

#: Rows and characters of a segment: what a task holds of one conversation.
SEGMENT, SEGMENT_CHARS = 4096, 1 << 20
SPACE = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
#: What a system, user, assistant or other row leads to if kept; None where it may not stand.
KEPT = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None,) * 4)
#: What an inserted or re-roled turn leads to, and whose it is.
TURN = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Costs at the end of a conversation, inserts to come included.
FINAL = (0, 4, 2, 0)
INFINITE = 1 << 40

SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
LEGAL = {"su", "ua", "au"}

Vector = tuple[int, ...]


def row_code(role: str, fault: int) -> int:
    """One byte that says all that the costs depend on."""
    return ("sua".find(role[0]) if role[:1] in ("s", "u", "a") else 3) | fault << 2


def before(code: int, after: Vector) -> Vector:
    """Cheapest costs before a row, inserts before it included, from those after it."""
    kept, fault = KEPT[code & 3], code >> 2
    out = [DELETE + c for c in after]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT_OFF else 0
        for q in range(4):
            cost = REROLE + after[TURN[q]]
            if kept[q] is not None and after[kept[q]] < cost:
                cost = after[kept[q]]
            if cost + extra < out[q]:
                out[q] = cost + extra
    user, assistant = out[USER], out[ASSISTANT]
    out[USER], out[ASSISTANT] = min(user, INSERT + assistant), min(assistant, INSERT + user)
    out[START], out[SYSTEM] = min(out[START], INSERT + out[USER]), min(out[SYSTEM], INSERT + out[USER])
    return tuple(out)


def checkpoints(codes: bytes, end: Vector) -> tuple[int, list[Vector]]:
    """Block length, about the root of the rows, and the vectors before rows 0, length, 2 length, ..., and at the end."""
    length = max(1, math.isqrt(len(codes)))
    kept, v = [end], end
    for i in range(len(codes) - 1, -1, -1):
        v = before(codes[i], v)
        if i % length == 0:
            kept.append(v)
    return length, kept[::-1]


def walk(codes: bytes, end: Vector, state: int, last: bool) -> tuple[str, int, int]:
    """The ASCII-least cheapest edits from a state, the state after them, and their cost."""
    length, marks = checkpoints(codes, end)
    edits, cost = [], marks[0][state]
    for b in range(len(marks) - 1):
        lo, hi = b * length, min((b + 1) * length, len(codes))
        vectors = [marks[b + 1]]
        for i in range(hi - 1, lo - 1, -1):
            vectors.append(before(codes[i], vectors[-1]))
        for i in range(lo, hi):
            here, after = vectors[hi - i], vectors[hi - i - 1]
            while here[state] != DELETE + after[state] and here[state] == INSERT + here[TURN[state]]:
                edits.append("I")
                state = TURN[state]
            extra, kept = TRUNCATED if codes[i] >> 2 == CUT_OFF else 0, KEPT[codes[i] & 3][state]
            if here[state] == DELETE + after[state]:
                edits.append("D")
            elif kept is not None and here[state] == extra + after[kept]:
                edits.append("K")
                state = kept
            else:
                edits.append("R")
                state = TURN[state]
    cost -= end[state]
    while last and state in (SYSTEM, USER):
        edits.append("I")
        state, cost = TURN[state], cost + INSERT
    return "".join(edits), state, cost


def transfer(codes: bytes) -> list[int]:
    """Cheapest costs from each state before the rows to each state after them, row by row of the matrix."""
    columns = [checkpoints(codes, tuple(0 if q == k else INFINITE for q in range(4)))[1][0] for k in range(4)]
    return [min(INFINITE, columns[k][q]) for q in range(4) for k in range(4)]


def through(matrix: list[int], end: Vector) -> Vector:
    """Costs before a segment from those after it."""
    return tuple(min(matrix[4 * q + k] + end[k] for k in range(4)) for q in range(4))


def apply(edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    out, i = ([], []), 0
    for e in edits:
        if e in "IR":
            state = TURN[state]
            out[0].append(NAMES[state])
        elif e == "K":
            state = KEPT[row_code(roles[i], SOUND) & 3][state]
            out[0].append(roles[i])
        if e != "D":
            out[1].append("" if e == "I" else texts[i])
        i += e != "I"
    return out


_TALLY = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "cost")
_SEGMENT = "conv_id long, at long, whole boolean, rows long, blank long, duplicate long, truncated long, illegal long, turns long, cost long, t0 long, t1 long, r0 string, r1 string, audit string, codes binary, whos binary, roles array<string>, texts array<string>"
_TYPES = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 9, *[pa.string()] * 3, *[pa.binary()] * 2, *[pa.list_(pa.string())] * 2]


def _batch(rows: list[dict], schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in zip(names, types, strict=True)], names)


def _in_batches(rows: Iterator[dict], schema: str, types: list[pa.DataType], most: int = 256) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += sum(map(len, r.get("texts") or ()))
        if len(held) >= most or chars > SEGMENT_CHARS:
            yield _batch(held, schema, types)
            held, chars = [], 0
    if held:
        yield _batch(held, schema, types)


def _counts(codes: bytes) -> dict:
    """How many rows have each fault."""
    faults = [c >> 2 for c in codes]
    return {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_OFF)}


def _segment(rows: list[tuple[int | None, str, str, int, bytes]], conv_id: int | None, whole: bool) -> dict:
    """A run of rows (turn, role, text, fault, who) of one conversation: its edits if it is whole, else what other tasks need."""
    turns = [r[0] for r in rows if r[0] is not None]
    out = {
        "conv_id": conv_id, "whole": whole, "rows": len(rows), "illegal": sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False)), "turns": len(set(turns)),
        "t0": turns[0] if turns else None, "t1": turns[-1] if turns else None, "r0": rows[0][1][:1], "r1": rows[-1][1][:1],
        "roles": [r[1] for r in rows], "texts": [r[2] for r in rows],
    }
    if not whole:
        return out | {"codes": bytes(row_code(r[1], r[3]) for r in rows), "whos": b"".join(r[4] for r in rows)}
    seen, codes = set(), bytearray()
    for _, role, _text, fault, who in rows:
        codes.append(row_code(role, DUPLICATE if who in seen and fault != BLANK else fault))
        seen.add(who)
    out["audit"], _, out["cost"] = walk(bytes(codes), FINAL, START, True)
    out["roles"], out["texts"] = apply(out["audit"], START, out["roles"], out["texts"])
    return out | _counts(codes)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a range of ordered rows. A conversation inside the range is whole; the first and last may go on in others."""

    def segments() -> Iterator[dict]:
        at, key, held, chars, whole = TaskContext.get().partitionId() << 33, (), [], 0, False
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "fault", "who")]
            for conv_id, turn, role, text, fault, who in zip(*columns, strict=True):
                if key and key[0] == conv_id:
                    if len(held) >= SEGMENT or chars > SEGMENT_CHARS:
                        yield _segment(held, conv_id, False) | {"at": at}
                        at, held, chars, whole = at + 1, [], 0, False
                else:
                    if held:
                        yield _segment(held, key[0], whole) | {"at": at}
                        at += 1
                    whole, key, held, chars = bool(key), (conv_id,), [], 0
                held.append((turn, role, text, fault, who))
                chars += len(text)
        if held:
            yield _segment(held, key[0], False) | {"at": at}

    yield from _in_batches(segments(), _SEGMENT, _TYPES)


def _by_conversation(df: DataFrame, back: bool = False) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at") if back else F.asc("at"))


_SCORED = "conv_id long, at long, codes binary, matrix array<long>, blank long, duplicate long, truncated long"


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of segments with their duplicates marked, counts of faults, and costs between states."""
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            codes = bytearray(x["codes"])
            for i in x["dups"] or ():
                if codes[i] >> 2 != BLANK:
                    codes[i] = codes[i] & 3 | DUPLICATE << 2
            rows.append({"conv_id": x["conv_id"], "at": x["at"], "codes": bytes(codes), "matrix": transfer(bytes(codes))} | _counts(codes))
        yield _batch(rows, _SCORED, [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 3])


_CHECKED = "at long, ending array<long>, last boolean"
_EXITS = "conv_id long, at long, ending array<long>, last boolean, exits array<long>"
_ENTRIES = "at long, ending array<long>, last boolean, entry long"


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The checkpoint behind each segment; a conversation's segments come last first."""

    def rows() -> Iterator[dict]:
        key, v = (), FINAL
        for batch in batches:
            for x in batch.to_pylist():
                last = key != (x["conv_id"],)
                if last:
                    key, v = (x["conv_id"],), FINAL
                yield {"at": x["at"], "ending": list(v), "last": last}
                v = through(x["matrix"], v)

    yield from _in_batches(rows(), _CHECKED, [pa.int64(), pa.list_(pa.int64()), pa.bool_()], 10_000)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each segment, for each state before it."""
    for batch in batches:
        rows = [x | {"exits": [walk(x["codes"], tuple(x["ending"]), q, False)[1] for q in range(4)]} for x in batch.to_pylist()]
        yield _batch(rows, _EXITS, [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int64())])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each segment."""

    def rows() -> Iterator[dict]:
        key, state = (), START
        for batch in batches:
            for x in batch.to_pylist():
                if key != (x["conv_id"],):
                    key, state = (x["conv_id"],), START
                yield {"at": x["at"], "ending": x["ending"], "last": x["last"], "entry": state}
                state = x["exits"][state]

    yield from _in_batches(rows(), _ENTRIES, [pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64()], 10_000)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their edits, repaired."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.slice(k, 1).to_pylist()[0]
                x["audit"], _, x["cost"] = walk(x["codes"], tuple(x["ending"]), x["entry"], x["last"])
                x["roles"], x["texts"] = apply(x["audit"], x["entry"], x["roles"], x["texts"])
                yield x

    yield from _in_batches(rows(), _SEGMENT, _TYPES)


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, who and place of rows; who tells conversation, role and text, place rows equal in all. What is a duplicate shows only in order."""
    said = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(k), F.lit(" ")).alias(k) for k in ("role", "text")],
        F.monotonically_increasing_id().alias("place"),
    )
    who = F.unhex(F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")))
    rest = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(rest == "", BLANK).when(~F.substring(rest, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(SOUND)
    return said.select("conv_id", "turn", "role", "text", fault.alias("fault"), who.alias("who"), "place")


def duplicates(parts: DataFrame) -> DataFrame:
    """at, dups: the rows of segments (at, rows, whos) whose role and text an earlier row of the conversation has, in whichever segment."""
    place = F.transform(F.sequence(F.lit(0), (F.col("rows") - 1).cast("int")), lambda i: F.substring(F.col("whos"), i * 16 + 1, F.lit(16)))
    each = parts.select("at", F.posexplode(place).alias("i", "who"))
    here = F.struct("at", "i")
    firsts = each.groupBy("who").agg(F.min(here).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("who", "first")
    return each.join(firsts, "who").where(here > F.col("first")).groupBy("at").agg(F.collect_list("i").alias("dups"))


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations as segments in order (conv_id, at): roles and texts after the edits, and what was found and done.

    rows has conv_id, turn, role, text; other columns, whatever their names, are not read. A null role or text counts
    as one space. Rows go by turn, null first, then by role, then by a checksum of the text; rows equal in all are
    repeats of one another, the later ones duplicates. A null conv_id is a conversation like others. A role that
    begins with none of s, u, a is never kept as it is. An empty table gives nothing.

    Texts are shuffled once, in ranges by conversation and order, so that a conversation with a third of all rows
    goes to many tasks; each holds a segment of at most SEGMENT rows. A conversation inside a range is repaired there.
    Of others, checksums find the duplicates, and what is passed on to one task of a long one is some numbers a segment.
    """
    order = ("conv_id", "turn", "role", "who", "place")
    ranges = faults(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    found = common.written(ranges.select("conv_id", "turn", "role", "text", "fault", "who").mapInArrow(_cut, _SEGMENT), "segments")
    parts = found.where("NOT whole")
    marked = parts.select("conv_id", "at", "codes").join(duplicates(parts), "at", "left")
    scored = common.written(marked.mapInArrow(_scored, _SCORED), "scored")
    checked = _by_conversation(scored.select("conv_id", "at", "matrix"), back=True).mapInArrow(_backward, _CHECKED)
    exits = scored.select("conv_id", "at", "codes").join(checked, "at").select("conv_id", "at", "codes", "ending", "last").mapInArrow(_exits, _EXITS)
    entries = _by_conversation(exits).mapInArrow(_forward, _ENTRIES)
    texts = parts.drop("codes", "whos", "blank", "duplicate", "truncated").join(scored.drop("conv_id", "matrix"), "at").join(entries, "at")
    return found.where("whole").unionByName(texts.mapInArrow(_edited, _SEGMENT)).drop("codes", "whos")


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_TYPES = [*[pa.int64()] * 7, pa.string(), pa.string()]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation from its segments in order; the digest is fed piece by piece."""

    def closed(c: dict) -> dict:
        gaps = c["t1"] - c["t0"] + 1 - c["turns"] if c["t0"] is not None else 0
        return c | {"gaps": gaps, "audit": "".join(c["edits"]), "repaired_sha256": c["sha"].hexdigest()}

    def rows() -> Iterator[dict]:
        c = None
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.slice(k, 1).to_pylist()[0]
                if c is None or c["conv_id"] != x["conv_id"]:
                    if c is not None:
                        yield closed(c)
                    c = {"conv_id": x["conv_id"], "t0": None, "t1": None, "r1": None, "edits": [], "sha": hashlib.sha256(), "any": False} | dict.fromkeys(_TALLY, 0)
                for name in _TALLY:
                    c[name] += x[name]
                if c["r1"] is not None:
                    c["illegal"] += c["r1"] + x["r0"] not in LEGAL
                if x["t0"] is not None:
                    c["turns"] -= c["t1"] == x["t0"]
                    c["t0"] = x["t0"] if c["t0"] is None else c["t0"]
                    c["t1"] = x["t1"]
                c["r1"] = x["r1"]
                c["edits"].append(x["audit"])
                if x["roles"]:
                    joined = "\n".join(f"{r}:{t}" for r, t in zip(x["roles"], x["texts"], strict=True))
                    c["sha"].update((("\n" if c["any"] else "") + joined).encode())
                    c["any"] = True
        if c is not None:
            yield closed(c)

    yield from _in_batches(rows(), _RESULT, _RESULT_TYPES, 1000)


def digest(segments: DataFrame) -> DataFrame:
    """A row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    whole = segments.where("whole").mapInArrow(_digest, _RESULT)
    return whole.unionByName(_by_conversation(segments.where("NOT whole")).mapInArrow(_digest, _RESULT))


def damaged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with faults that a checksum of `conv_id:turn` picks, and the ids of which no row is left."""
    text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(" "))
    marked = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("draw"))
    on = lambda k, new, old: F.when(F.col("draw") == k, new).otherwise(old)
    hurt = marked.select(
        "conv_id", "turn", on(4, F.lit("user"), F.col("role")).alias("role"),
        on(1, F.lit(""), on(2, F.regexp_replace("text", "[.!?]", ""), F.col("text"))).alias("text"), F.explode(on(3, F.array(F.lit(0), F.lit(1)), F.array(F.lit(0)))).alias("copy"), "draw",
    ).where("draw <> 0")
    gone = marked.groupBy("conv_id").agg(F.max(F.col("draw") != 0).alias("any")).where("NOT any").select("conv_id")
    return hurt.select("conv_id", "turn", "role", "text"), gone


def op11_checkpointed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt, gone = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    zeros = [F.lit(0).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = gone.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    return digest(repair(hurt)).unionByName(nothing)
