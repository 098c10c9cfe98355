"""Conversation structure repair: the cheapest edits that make a conversation read system?, (user, assistant)+, or nothing.

Rows are read by turn (null first), then role, then a digest of role and text. A row has at most one fault: blank text, the same
role and text as an earlier row (duplicate), or a text that does not end in . ! or ? (truncated). Edits: Keep costs 0,
Rerole to user or assistant 2, Delete 3 (blank and duplicate rows must go), Insert an empty user or assistant row 2; a
truncated row that stays costs 1 more. Of the cheapest edit lists the ASCII-least list of initials (D < I < K < R) is the audit.

With four states (start, after system, after user, after assistant), a row is a 4 x 4 matrix of costs in the min-plus
algebra, which depends on its symbol only: role initial and fault. Equal consecutive symbols are one run, advanced by the binary powers of its
matrix, which are cached per symbol. What it costs to finish from each state is carried backwards over the runs; then the
choices are unrolled forwards, the least letter on a cheapest path first.

A conversation may hold a third of all rows, so it is not one group:

1. Equal rows are counted map-side and become one row with a count; `earlier` rows are found by windows salted by turn.
2. Keys of rows without texts are dealt by range of (conversation, turn), so a long conversation lies in several tasks, and cut into
   chunks of CHUNK rows; a chunk's runs are multiplied to one matrix.
3. Two streams over the chunks of a conversation hold a vector of four numbers and a state: backwards the costs to finish after
   each chunk, forwards the state it is entered in. Between them, and for all chunks at once, choices are unrolled; a chunk that
   is not a conversation's first is unrolled from each state it may be entered in.
4. Texts meet the choices by row number, a key without repetition. The digest of a repaired conversation is defined
   over its text in order, so one task streams it, holding the state of the hash and the audit, which is a value of the result.

Defined results: null roles and texts are one space, null turns come first and count for no gap, null conversation ids
are one conversation; roles of other initials than s, u and a can only be reroled or deleted; repeated rows of a table are
duplicates; the texts of any length are kept whole; an empty table gives no rows; columns of other names play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from transmuta.functions.materialize import Written
from transmuta.llm.batches import together

CHUNK = 4096  # rows
SALTS = 64
KEEP, REROLE, DELETE, INSERT, STAY_TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
#: The state an inserted or reroled row leads to, and what its role is.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: Symbols: 0 must be deleted; 1 to 4 a sound row whose role begins with s, u, a or another letter; 5 to 8 a truncated one.
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
FINISH = (0, 2 * INSERT, INSERT, 0)  # what it costs to end in a state, by insertions
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

Matrix = tuple[tuple[int, ...], ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(NEVER, min(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def applied(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(NEVER, min(a[i][k] + v[k] for k in range(4))) for i in range(4))


IDENTITY: Matrix = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))
#: Any number of insertions; more than two never pay, as they lead back.
INSERTIONS: Matrix = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else 2 * INSERT if NEXT[NEXT[i]] == j else NEVER for j in range(4)) for i in range(4))


@cache
def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row, in order of their letters."""
    found = [("D", DELETE, state)]
    if symbol:
        more = STAY_TRUNCATED if symbol > 4 else 0
        after = KEPT[(symbol - 1) % 4].get(state)
        if after is not None:
            found.append(("K", KEEP + more, after))
        found.append(("R", REROLE + more, NEXT[state]))
    return found


@cache
def power(symbol: int, k: int) -> Matrix:
    """The matrix of 2**k equal rows."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    step = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in choices(symbol, state):
            step[state][after] = min(step[state][after], cost)
    return product(INSERTIONS, tuple(map(tuple, step)))


def runs(symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) of maximal runs."""
    codes = np.frombuffer(symbols, np.uint8)
    if not len(codes):
        return []
    starts = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1))
    return list(zip(codes[starts].tolist(), np.diff(np.append(starts, len(codes))).tolist()))


def matrix(symbols: bytes) -> Matrix:
    """The product of all rows' matrices, run by run through binary powers."""
    out = IDENTITY
    for symbol, length in runs(symbols):
        k = 0
        while length >> k:
            if length >> k & 1:
                out = product(out, power(symbol, k))
            k += 1
    return out


def costs(symbols: bytes, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """What it costs to finish from each state before every row, and after the last. Inside a run, 2**k vectors are
    advanced by the k-th power at once until it is filled."""
    out = [after]
    for symbol, length in reversed(runs(symbols)):
        if length < 8:
            for _ in range(length):
                out.append(applied(power(symbol, 0), out[-1]))
            continue
        block, k = np.array([applied(power(symbol, 0), out[-1])], np.int64), 0
        while len(block) < length:
            p = np.array(power(symbol, k), np.int64)
            more = (p[None] + block[:length - len(block), None, :]).min(axis=2)
            block, k = np.concatenate((block, np.minimum(more, NEVER))), k + 1
        out.extend(map(tuple, block.tolist()))
    out.reverse()
    return out


def unroll(symbols: bytes, after: tuple[int, ...], state: int, ends: bool) -> tuple[list[str], list[str], int]:
    """Per row, and for what follows the last one if the conversation ends there: initials of the edits, and lines to write.

    Lines: u and a an inserted user and assistant, K the row as it is, U and A its text under another role.
    """
    known = costs(symbols, after)
    letters, lines = [], []
    for i, symbol in enumerate(symbols):
        edits, written = "", ""
        while True:
            rest = known[i][state]
            edit = next((e for e in choices(symbol, state)[:1] if e[1] + known[i + 1][e[2]] == rest), None)
            if edit is None and INSERT + known[i][NEXT[state]] == rest:
                edits, written, state = edits + "I", written + ROLE[state][0], NEXT[state]
                continue
            letter, _, to = edit or next(e for e in choices(symbol, state)[1:] if e[1] + known[i + 1][e[2]] == rest)
            edits += letter
            written += "" if letter == "D" else "K" if letter == "K" else ROLE[state][0].upper()
            state = to
            break
        letters.append(edits)
        lines.append(written)
    edits, written = "", ""
    while ends and FINISH[state]:
        edits, written, state = edits + "I", written + ROLE[state][0], NEXT[state]
    return [*letters, edits], [*lines, written], state


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by the checksum of `conv_id:turn` (nulls: one space) modulo 20: 0 drops a row, 1
    empties its text, 2 removes its . ! ?, 3 repeats it, 4 makes its role user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("fate")).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_")).drop("_")


def _symbols(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, n, row) without texts, with digest, blank, duplicate, truncated."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    narrow = rows.select("conv_id", "turn", "role", "n", "row", digest.alias("digest"), (~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).alias("blank"),
                         (~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))).alias("open"), F.pmod(F.xxhash64("turn"), F.lit(SALTS)).alias("salt"))
    # a turn holds a digest once; only the first of a salt can be the first of all
    some = F.row_number().over(Window.partitionBy("conv_id", "digest", "salt").orderBy("turn"))
    of_all = F.row_number().over(Window.partitionBy("conv_id", "digest", F.when(F.col("some") == 1, -1).otherwise(F.col("salt"))).orderBy("turn"))
    placed = narrow.withColumn("some", some).withColumn("of_all", of_all)
    return placed.select("conv_id", "turn", "role", "n", "row", "digest", "blank", (~F.col("blank") & ((F.col("some") > 1) | (F.col("of_all") > 1))).alias("repeated"), "open")


_CHUNK = "piece int, part int, rows binary, n binary, symbols binary, matrix array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"


def _chunks(symbols: DataFrame) -> DataFrame:
    """Chunks of the rows in order; `part` numbers the chunks of a piece."""
    kind = symbols.schema["conv_id"].dataType.simpleString()
    ordered = symbols.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    rows = ordered.select("conv_id", F.col("turn").cast("long").alias("turn"), F.substring("role", 1, 1).alias("initial"), "n", "row", "blank", "repeated", "open", F.spark_partition_id().alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv, part = [], None, 0
        for batch in batches:
            ids = batch["conv_id"]
            for i, r in enumerate(zip(*(batch[c].to_pylist() for c in ("turn", "initial", "n", "row", "blank", "repeated", "open", "piece")))):
                own = ids[i]
                if held and (own.as_py() != conv.as_py() or len(held) >= CHUNK):
                    yield _chunk(conv, part, held)
                    held, part = [], part + 1
                conv = own
                held.append(r)
        if held:
            yield _chunk(conv, part, held)
    return rows.mapInArrow(lambda batches: together(run(batches)), f"conv_id {kind}, {_CHUNK}")


def _chunk(conv: pa.Scalar, part: int, held: list[tuple]) -> pa.RecordBatch:
    symbols, blank, duplicate, truncated, illegal, last = bytearray(), 0, 0, 0, 0, None
    for _, initial, n, _, is_blank, repeated, is_open, _ in held:
        symbol = 0 if is_blank or repeated else 1 + ("sua".find(initial) if initial in ("s", "u", "a") else 3) + 4 * is_open
        symbols += bytes([symbol]) + bytes(n - 1)
        blank += n * is_blank
        duplicate += 0 if is_blank else n - 1 + repeated
        truncated += symbol > 4
        illegal += n - 1 + (last is not None and last + initial not in ("su", "ua", "au"))
        last = initial
    turns = [r[0] for r in held if r[0] is not None]
    number = lambda x: pa.array([x], pa.int64())
    return pa.RecordBatch.from_pydict({
        "conv_id": pa.array([conv.as_py()], conv.type), "piece": pa.array([held[0][-1]], pa.int32()), "part": pa.array([part], pa.int32()),
        "rows": pa.array([np.array([r[3] for r in held], np.int64).tobytes()], pa.binary()), "n": pa.array([np.array([r[2] for r in held], np.int64).tobytes()], pa.binary()),
        "symbols": pa.array([bytes(symbols)], pa.binary()), "matrix": pa.array([[x for row in matrix(bytes(symbols)) for x in row]], pa.list_(pa.int64())),
        "blank": number(blank), "duplicate": number(duplicate), "truncated": number(truncated), "illegal": number(illegal), "first": pa.array([held[0][1]]), "last": pa.array([last]),
        "low": number(turns[0] if turns else None), "high": number(turns[-1] if turns else None), "turns": number(len(set(turns)))})


def _in_order(chunks: DataFrame, backwards: bool = False) -> DataFrame:
    """The chunks of a conversation together, in or against their order; a stream reads them one by one."""
    way = F.desc if backwards else F.asc
    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", way("piece"), way("part"))


def _backwards(chunks: DataFrame) -> DataFrame:
    """piece, part, after: costs to finish after the chunk; ends and begins: whether it is the last and the first; cost of the whole at the first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, before, held = None, None, None
        for batch in batches:
            out = []
            for own, piece, part, m in zip(*(batch[c].to_pylist() for c in ("conv_id", "piece", "part", "matrix"))):
                ends = held is None or own != conv
                if held is not None:
                    out.append((*held, ends, before[START] if ends else None))
                after = FINISH if ends else before
                held, conv = (piece, part, list(after), ends), own
                before = applied(tuple(tuple(m[4 * i:4 * i + 4]) for i in range(4)), after)
            yield _records(out)
        if held is not None:
            yield _records([(*held, True, before[START])])

    def _records(rows):
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["piece", "part", "after", "ends", "begins", "cost"])
    return _in_order(chunks.select("conv_id", "piece", "part", "matrix"), True).mapInArrow(run, "piece int, part int, after array<long>, ends boolean, begins boolean, cost long")


def _unrolled(chunks: DataFrame, ahead: DataFrame) -> DataFrame:
    """chunks with, per state they may be entered in, the edits, the lines and the state they end in; a row is ended by a line break."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    kept = ["conv_id", "piece", "part", "rows", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "begins", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits, lines, exits = [], [], []
            for symbols, after, ends, begins in zip(*(batch[c].to_pylist() for c in ("symbols", "after", "ends", "begins"))):
                found = [unroll(symbols, tuple(after), state, ends) if state == START or not begins else ([], [], 0) for state in range(4)]
                edits.append(["\n".join(f[0]) for f in found])
                lines.append(["\n".join(f[1]) for f in found])
                exits.append([f[2] for f in found])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(edits, pa.list_(pa.string())), pa.array(lines, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))],
                                             [*kept, "edits", "lines", "exits"])
    both = chunks.join(ahead, ["piece", "part"])
    types = {f.name: f.dataType.simpleString() for f in both.schema.fields} | {"conv_id": kind}
    return both.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", edits array<string>, lines array<string>, exits array<int>")


_EDITS = "at long, row long, edits string, lines string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _forwards(unrolled: DataFrame) -> DataFrame:
    """conv_id, at (place), row, edits, lines of every row; a conversation's last entry holds what follows its rows and its totals."""
    kind = unrolled.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_ = None, None
        for batch in batches:
            ids = batch["conv_id"]
            for i, r in enumerate(batch.to_pylist()):
                if open_ is not None and (r["conv_id"] != conv.as_py()):
                    yield _last(conv, open_)
                    open_ = None
                if open_ is None:
                    open_ = {"state": START, "at": 0, "cost": r["cost"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "last": None, "low": r["low"], "high": None, "turns": 0}
                conv = ids[i]
                yield _entries(conv, open_, r)
        if open_ is not None:
            yield _last(conv, open_)
    return _in_order(unrolled).mapInArrow(lambda batches: together(run(batches)), f"conv_id {kind}, {_EDITS}")


def _entries(conv: pa.Scalar, open_: dict, r: dict) -> pa.RecordBatch:
    """Moves the conversation's state over a chunk; its rows' edits."""
    edits, lines = r["edits"][open_["state"]].split("\n"), r["lines"][open_["state"]].split("\n")
    counts = np.frombuffer(r["n"], np.int64)
    first = np.cumsum(counts) - counts  # a row counted n times is n letters, of which all but the first delete
    rows = np.frombuffer(r["rows"], np.int64)
    if open_["last"] is not None and open_["last"] + r["first"] not in ("su", "ua", "au"):
        open_["illegal"] += 1
    for c in ("blank", "duplicate", "truncated", "illegal"):
        open_[c] += r[c]
    open_["turns"] += r["turns"] - (r["low"] is not None and r["low"] == open_["high"])
    open_["low"] = r["low"] if open_["low"] is None else open_["low"]
    open_["high"] = r["high"] if r["high"] is not None else open_["high"]
    open_["last"], open_["state"] = r["last"], r["exits"][open_["state"]]
    open_["rest"], open_["key"] = (edits[-1], lines[-1]), (r["piece"] << 32) + r["part"]
    at = open_["at"] + np.arange(len(rows))
    open_["at"] += len(rows)
    nothing = pa.nulls(len(rows), pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.array([conv.as_py()] * len(rows), conv.type), pa.array(at, pa.int64()), pa.array(rows, pa.int64()), pa.array(["".join(edits[a:a + n]) for a, n in zip(first.tolist(), counts.tolist())], pa.string()),
        pa.array(["".join(lines[a:a + n]) for a, n in zip(first.tolist(), counts.tolist())], pa.string()), *[nothing] * 6],
        ["conv_id", "at", "row", "edits", "lines", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"])


def _last(conv: pa.Scalar, open_: dict) -> pa.RecordBatch:
    gaps = open_["high"] - open_["low"] + 1 - open_["turns"] if open_["low"] is not None else 0
    numbers = {"at": open_["at"], "row": -1 - open_["key"], "gaps": gaps, **{c: open_[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")}}
    return pa.RecordBatch.from_pydict({"conv_id": pa.array([conv.as_py()], conv.type), "at": pa.array([numbers.pop("at")], pa.int64()), "row": pa.array([numbers.pop("row")], pa.int64()),
                                       "edits": pa.array([open_["rest"][0]]), "lines": pa.array([open_["rest"][1]]), **{k: pa.array([v], pa.int64()) for k, v in numbers.items()}})


def edits(turns: DataFrame) -> DataFrame:
    """conv_id, at, edits, text and the totals: the edits of every row in order, with the lines (`role:text`) it leaves, null if none.

    A conversation's last entry (gaps not null) holds what is inserted after its rows, and its totals.
    """
    filled = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    counted = turns.select("conv_id", "turn", filled("role"), filled("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = Written(counted.withColumn("row", F.monotonically_increasing_id()), "turns").df
    chunks = Written(_chunks(_symbols(rows)), "turn-chunks").df
    placed = _forwards(_unrolled(chunks, _backwards(chunks)))
    joined = placed.join(rows.select("row", "role", "text"), "row", "left")
    # an inserted row has no text
    line = lambda c: F.when(c == "u", "user:").when(c == "a", "assistant:").when(c == "U", F.concat(F.lit("user:"), "text")).when(c == "A", F.concat(F.lit("assistant:"), "text")) \
        .otherwise(F.concat("role", F.lit(":"), "text"))
    written = F.when(F.length("lines") > 0, F.array_join(F.transform(F.split("lines", ""), line), "\n"))
    return joined.select("conv_id", "at", "edits", written.alias("text"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation with rows."""
    found = edits(turns)
    kind = found.schema["conv_id"].dataType.simpleString()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, some, audit = hashlib.sha256(), False, []
        for batch in batches:
            ends = []
            for i, (letters, text, gaps) in enumerate(zip(batch["edits"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["gaps"].to_pylist())):
                audit.append(letters)
                if text is not None:
                    digest.update(b"\n" + text if some else text)
                    some = True
                if gaps is not None:
                    ends.append((i, "".join(audit), digest.hexdigest()))
                    digest, some, audit = hashlib.sha256(), False, []
            last = batch.take(pa.array([e[0] for e in ends], pa.int32()))
            yield pa.RecordBatch.from_arrays([last["conv_id"], *(last[c] for c in numbers), pa.array([e[1] for e in ends], pa.string()), pa.array([e[2] for e in ends], pa.string())],
                                             ["conv_id", *numbers, "audit", "repaired_sha256"])
    ordered = found.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return ordered.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in numbers)}, audit string, repaired_sha256 string")


def repair_report(turns: DataFrame) -> DataFrame:
    """Every conversation of `turns`, damaged and repaired; zeros and an empty audit for one without rows after the damage."""
    known = repaired(damaged(turns)).withColumnRenamed("conv_id", "_conv")
    every = turns.select("conv_id").distinct()
    both = every.join(known, every["conv_id"].eqNullSafe(known["_conv"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return both.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                       F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
