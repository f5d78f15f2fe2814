r"""Conversation structure repair by error-correcting Earley parsing (operator 13).

A conversation should read as the role grammar (s?(ua)+)? of role initials: a system turn or
none, then user and assistant in turns. Edits have weights: Keep 0, Rerole (to user or
assistant) 1, Delete 2, Insert (an empty user or assistant turn) 5; a truncated turn that is not
deleted adds 5; blank and duplicate turns must be deleted. `Chart` parses with all edits at once:
an item is a dotted rule and keeps the least (cost, audit) with which it can be reached, where
the audit is the edits' initials, in order. The completed item of S yields cost and repair.

The rules are left-linear, so every item begins at the conversation's start, a column has seven
items that wait for input, and time grows with the rows. Audits are compared without being
spelt: all items of a column have read the same rows, so an audit is a stem, which ends with the
last row's edit, and some inserts; two stems differ in some letter or are equal. Stems are
ranked in each column from their ranks in the one before.

Equal rows of a conversation are counted first (all but one are duplicates). Rows are then
ordered by conversation, turn (nulls first), role and text over all partitions, so that a
conversation with a third of all rows is spread over many tasks. A task parses its conversations
in passing. Of the first in a task, which may have begun in another, it gives the least cost and
audit between any two items; those pieces, two a task at most, are joined by conversation.

Cases: a null role or text is one space; a null turn sorts first and is not in gaps; a null
conv_id is a conversation of its own; an empty role has no initial and is legal next to nothing;
turns that tie are in the order of role and text; a conversation without rows has zeros and an
empty audit; extra columns are ignored; an empty table gives an empty result. `repaired` holds a
row for each edit, whatever the conversation's length; only a digest over a whole conversation
needs it in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed, ensure_checkpoint_dir, shuffle_partitions

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Heads and bodies. A non-terminal stands first in a body only.
RULES = [("S", ""), ("S", "P"), ("P", "Qua"), ("P", "Pua"), ("Q", ""), ("Q", "s")]
ITEMS = [(r, dot) for r, (_, body) in enumerate(RULES) for dot in range(len(body) + 1)]
NUMBER = {item: i for i, item in enumerate(ITEMS)}
MADE = "ua"  # roles that an edit may give


def _next(i: int) -> str:
    r, dot = ITEMS[i]
    return RULES[r][1][dot : dot + 1]


def _after(i: int) -> int:
    r, dot = ITEMS[i]
    return NUMBER[r, dot + 1]


#: Of each item that waits for a terminal: the terminal and the item after it.
SCAN = {i: (_next(i), _after(i)) for i in range(len(ITEMS)) if _next(i).islower()}
#: Of each completed item: the items that it moves on. As those wait since the first column, they add nothing.
COMPLETE = {i: [_after(j) for j in range(len(ITEMS)) if _next(j) == RULES[ITEMS[i][0]][0]] for i in range(len(ITEMS)) if not _next(i)}
FINAL = [i for i in COMPLETE if RULES[ITEMS[i][0]][0] == "S"]
#: Items that outlast a column.
WAITING = [*SCAN, *FINAL]
START = [i for i, (_, dot) in enumerate(ITEMS) if dot == 0]
_NONE = 255


class Chart:
    """The columns of a parse. `begin`: the items that it starts from; all that are predicted by
    default, else one of a piece's items."""

    def __init__(self, begin: list[int] = START):
        self.label: dict[int, tuple[int, int, int]] = {i: (0, 0, 0) for i in begin}  # cost, rank of the stem, inserts after it
        self.back = bytearray()  # of each column and item: the item before, and the edit
        self.times: list[int] = []  # rows of each column after the first
        self._column = self._fresh()
        self._close()

    def _fresh(self) -> bytearray:
        return bytearray([_NONE, 0] * len(ITEMS))

    def _close(self) -> None:
        """Completions, and inserts of what items wait for, until nothing is less."""
        label, column = self.label, self._column
        todo = sorted(label, key=label.__getitem__)
        for i in todo:  # grows
            cost, rank, inserts = label[i]
            if i in SCAN:
                terminal, to = SCAN[i]
                reached, new, edit = ([to], (cost + INSERT, rank, inserts + 1), 73) if terminal in MADE else ([], None, 0)
            else:
                reached, new, edit = COMPLETE.get(i, []), label[i], 0
            for to in reached:
                if to not in label or new < label[to]:
                    label[to] = new
                    column[2 * to : 2 * to + 2] = bytes([i, edit])
                    todo.append(to)
        self.label = {i: label[i] for i in WAITING if i in label}
        self.back += column

    def read(self, initial: str, forced: bool, truncated: bool, times: int = 1) -> None:
        """A row, or several equal ones that must all be deleted."""
        best: dict[int, tuple] = {}

        def reach(to: int, cost: int, stem: tuple, i: int, edit: int) -> None:
            if to not in best or (cost, stem) < best[to][:2]:
                best[to] = (cost, stem, i, edit)

        more = TRUNCATED if truncated else 0
        for i, (cost, rank, inserts) in self.label.items():
            reach(i, cost + DELETE * times, (rank, 0, inserts, "D"), i, 68)
            if not forced and i in SCAN:
                terminal, to = SCAN[i]
                if terminal == initial:
                    reach(to, cost + more, (rank, 1, -inserts, "K"), i, 75)
                elif terminal in MADE:
                    reach(to, cost + more + REROLE, (rank, 1, -inserts, "R"), i, 82)
        ranks = {stem: k for k, stem in enumerate(sorted({b[1] for b in best.values()}))}
        self.label = {to: (cost, ranks[stem], 0) for to, (cost, stem, _, _) in best.items()}
        self._column = self._fresh()
        for to, (_, _, i, edit) in best.items():
            self._column[2 * to : 2 * to + 2] = bytes([i, edit])
        self.times.append(times)
        self._close()

    def audit(self, item: int) -> str:
        out, column = [], len(self.times)
        while True:
            at = 2 * (column * len(ITEMS) + item)
            before, edit = self.back[at], self.back[at + 1]
            if before == _NONE:
                return "".join(reversed(out))
            if edit:
                scanned = edit != 73
                out.append(chr(edit) * (self.times[column - 1] if scanned else 1))
                column -= scanned
            item = before

    def steps(self) -> dict[int, tuple[int, str]]:
        """Of each item that waits after the last row, cost and audit."""
        return {i: (label[0], self.audit(i)) for i, label in self.label.items()}

    def best(self) -> tuple[int, str]:
        i = min((i for i in FINAL if i in self.label), key=lambda i: self.label[i])
        return self.label[i][0], self.audit(i)


LEGAL = ("su", "ua", "au")


class _Piece:
    """The rows that a task has of one conversation. first: whether it may have begun earlier."""

    def __init__(self, c: str, first: bool):
        self.c, self.n, self.illegal, self.head, self.tail = c, 0, 0, None, None
        self.charts = {-1: Chart()} | ({i: Chart([i]) for i in WAITING} if first else {})

    def read(self, initial: str, forced: bool, truncated: bool, times: int) -> None:
        for chart in self.charts.values():
            chart.read(initial, forced, truncated)
            if times > 1:
                chart.read(initial, True, False, times - 1)
        if self.n:
            self.illegal += self.tail + initial not in LEGAL
        else:
            self.head = initial
        self.illegal += times - 1
        self.tail = initial
        self.n += times

    def row(self, piece: int, whole: bool) -> dict:
        if whole:
            steps = [dict(zip(STEP, (-1, -1, *self.charts[-1].best()), strict=True))]
        else:
            steps = [dict(zip(STEP, (a, b, *x), strict=True)) for a, chart in self.charts.items() for b, x in chart.steps().items()]
        return {"kind": 1, "c": self.c, "piece": piece, "n": self.n, "whole": whole, "illegal": self.illegal, "head": self.head, "tail": self.tail, "steps": steps}


STEP = ("a", "b", "cost", "audit")
PIECES = "kind int, c string, piece int, n long, role string, text string, whole boolean, illegal long, head string, tail string, steps array<struct<a: int, b: int, cost: long, audit: string>>"
_ARROW = pa.schema([("kind", pa.int32()), ("c", pa.string()), ("piece", pa.int32()), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("whole", pa.bool_()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("steps", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: rows that may be kept, with their number in the piece. Kind 1: pieces."""
    number, piece = TaskContext.get().partitionId(), None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if piece is None or piece.c != r["c"]:
                if piece is not None:
                    out.append(piece.row(number, len(piece.charts) == 1))
                piece = _Piece(r["c"], piece is None)
            if not r["forced"]:
                out.append({"kind": 0, "c": r["c"], "piece": number, "n": piece.n, "role": r["role"], "text": r["text"]})
            piece.read(r["role"][:1], r["forced"], r["cut"], r["times"])
        yield pa.RecordBatch.from_pylist(out, _ARROW)
    if piece is not None:
        yield pa.RecordBatch.from_pylist([piece.row(number, False)], _ARROW)


PARSED = "c string, cost long, audit string, illegal long, pieces array<int>, sizes array<long>"


def _join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The pieces of a conversation, one after the other."""
    pieces = sorted(table.to_pylist(), key=lambda r: r["piece"])
    at: dict[int, tuple[int, str]] = {-1: (0, "")}
    for p in pieces:
        reached: dict[int, tuple[int, str]] = {}
        for s in p["steps"]:
            if s["a"] in at:
                cost, audit = at[s["a"]]
                new = (cost + s["cost"], audit + s["audit"])
                reached[s["b"]] = min(new, reached.get(s["b"], new))
        at = reached
    cost, audit = min(at[i] for i in [*FINAL, -1] if i in at)
    illegal = sum(p["illegal"] for p in pieces) + sum(x["tail"] + y["head"] not in LEGAL for x, y in zip(pieces, pieces[1:], strict=False))
    return pa.table({"c": [key[0].as_py()], "cost": [cost], "audit": [audit], "illegal": [illegal], "pieces": pa.array([[p["piece"] for p in pieces]], pa.list_(pa.int32())), "sizes": pa.array([[p["n"] for p in pieces]], pa.list_(pa.int64()))})


EDITS = "c string, piece int, n long, edit string, place long, given string"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each edit: the row it is about, none of an insert; its place in what is left; the role given."""
    for batch in batches:
        for r in batch.to_pylist():
            system = sum(x != "D" for x in r["audit"]) % 2
            begin, total = [], 0
            for size in r["sizes"]:
                begin.append(total)
                total += size
            rows, row, piece, place = [], 0, 0, 0
            for x in r["audit"]:
                while piece + 1 < len(begin) and row >= begin[piece + 1]:
                    piece += 1
                given = ("user", "assistant")[(place - system) % 2] if x in "RI" else None
                rows.append((r["c"], r["pieces"][piece], None if x == "I" else row - begin[piece], x, None if x == "D" else place, given))
                row += x != "I"
                place += x != "D"
                if len(rows) == 10_000:
                    yield _edit_batch(rows)
                    rows = []
            yield _edit_batch(rows)


def _edit_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["c", "piece", "n", "edit", "place", "given"])


def conversation_key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


_SPACE = r"[^\x20\x09-\x0D]"


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Of each conversation that has rows: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit. And of each edit: conv_id, edit, place (null: deleted), role, text."""
    ensure_checkpoint_dir(turns.sparkSession)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    rows = given.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    after = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    rows = checkpointed(rows.select("*", conversation_key(F.col("conv_id")).alias("c"), said.alias("said"), after.alias("after")))
    first = rows.groupBy("c", "said").agg(F.min("after").alias("after")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["c", "said", "after"], "left")  # a row each at most: no key is hot
    blank = ~F.col("text").rlike(_SPACE)
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    later = F.col("first").isNull()
    rows = rows.select("c", "turn", "role", "text", "times", blank.alias("blank"), later.alias("later"), cut.alias("cut"))
    rows = checkpointed(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "c", "turn", "role", "text").sortWithinPartitions("c", "turn", "role", "text"))

    counts = rows.groupBy("c").agg(
        (F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.count_distinct("turn")).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("times")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("times") - F.when(F.col("later"), 0).otherwise(1)).otherwise(0)).alias("duplicate"),
        F.sum((~F.col("blank") & ~F.col("later") & F.col("cut")).cast("long")).alias("truncated"),
    )
    forced = F.col("blank") | F.col("later")
    parsed = checkpointed(rows.select("c", "role", "text", "times", forced.alias("forced"), "cut").mapInArrow(_parse, PIECES))
    pieces = parsed.where("kind = 1")
    whole = pieces.where("whole").select("c", F.col("steps")[0].cost.alias("cost"), F.col("steps")[0].audit.alias("audit"), "illegal", F.array("piece").alias("pieces"), F.array("n").alias("sizes"))
    joined = checkpointed(whole.union(pieces.where("not whole").select("c", "piece", "n", "illegal", "head", "tail", "steps").groupBy("c").applyInArrow(_join, PARSED)))
    kept = parsed.where("kind = 0").select("c", "piece", "n", "role", "text")
    edits = joined.select("c", "audit", "pieces", "sizes").mapInArrow(_edits, EDITS).join(kept, ["c", "piece", "n"], "left")
    own = F.when(F.col("c") != "", F.substring("c", 2, 1 << 30).cast(turns.schema[conv_id].dataType)).alias("conv_id")
    role_now, text_now = F.coalesce("given", "role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
    found = counts.join(joined.select("c", "illegal", "cost", "audit"), "c")
    edits = edits.select(own, "edit", "place", role_now.alias("role"), text_now.alias("text"))
    return found.select(own, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), edits
