"""Repair of conversations: the cheapest edits that make the roles alternate, with an audit of every edit.

Rows of a conversation are put in order and edited: Keep (0), Rerole to user or assistant (1), Delete (2; blank rows and
repeats have to be), Insert a user or assistant turn of empty text (5); a row cut off in mid-sentence that stays adds 5. The
role initials left have to read ``(s?(ua)+)?``. Of the cheapest audits (the edits' initials in order) the least by ASCII wins.

The search is a dynamic programme over four states: nothing yet, after system, after user, after assistant. Inserts
belong to the row they stand before. A state holds its cost and the last edit of its audit, a node linked to the edit before it, so that states
share what they have in common. A node knows ancestors at powers of two (binary lifting) and a rolling hash of all edits up to it: two audits of
equal cost are compared at the end of their longest common prefix, found by hashes, and what the hashes call equal is verified.

A conversation may hold any share of the rows. Turns are sorted over all partitions without their texts, and a
piece of a conversation gives, for each state before and after it, the cost and the audit. As audits of one piece end in no insert, none begins another:
their order within the piece decides all ties, so that pieces are put together by cost and rank alone. Texts are joined with the
audit in one sorted pass that holds one row at a time.

Defined results: rows are ordered by turn (null first), then role, then the text's SHA-256; a conversation without an id is one of its own; a
null role or text is one space; an empty role has no initial and cannot be kept; the initial is the role's first letter, so that other
roles with s, u or a are taken for those. Other columns are passed over; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritab.llm.common import arrow_schema
from veritab.session import materialize

_COST = {"K": 0, "R": 1, "D": 2, "I": 5}
_CUT_OFF = 5
#: States: nothing yet, after system, after user, after assistant. Where a kept initial, and where a new role leads.
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEW = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_BASE, _MOD = 1_000_003, (1 << 61) - 1


# Audits --------------------------------------------------------------------------------


class Edit:
    """The last edit of an audit."""

    __slots__ = ("char", "depth", "hash", "up")

    def __init__(self, before: "Edit | None" = None, char: str = ""):
        self.char, self.up = char, []
        if before is None:
            self.depth = self.hash = 0
            return
        self.depth, self.hash = before.depth + 1, (before.hash * _BASE + ord(char)) % _MOD
        self.up.append(before)
        while len(self.up) <= len(self.up[-1].up):
            self.up.append(self.up[-1].up[len(self.up) - 1])

    def at(self, depth: int) -> "Edit":
        """The edit of the given depth on the way here."""
        node = self
        while node.depth > depth:
            node = node.up[(node.depth - depth).bit_length() - 1]
        return node

    def text(self) -> str:
        out, node = [], self
        while node.depth:
            out.append(node.char)
            node = node.up[0]
        return "".join(reversed(out))


def _first_difference(a: Edit, b: Edit) -> tuple[Edit, Edit] | None:
    """Of two audits of one length, found equal by hash: the first edits that differ after all."""
    found = None
    while a is not b:
        if a.char != b.char:
            found = (a, b)
        a, b = a.up[0], b.up[0]
    return found


def less(a: Edit, b: Edit) -> bool:
    """Whether audit ``a`` comes before ``b``."""
    depth = min(a.depth, b.depth)
    x, y = a.at(depth), b.at(depth)
    if x.hash == y.hash:
        differ = _first_difference(x, y)
        return differ[0].char < differ[1].char if differ else a.depth < b.depth
    k = len(x.up) - 1
    while k >= 0:
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
        k -= 1
    differ = _first_difference(x.up[0], y.up[0]) or (x, y)
    return differ[0].char < differ[1].char


def _offer(states: list, to: int, cost: int, before: Edit, char: str) -> None:
    held = states[to]
    if held is None or cost < held[0]:
        states[to] = (cost, Edit(before, char))
    elif cost == held[0]:
        new = Edit(before, char)
        if less(new, held[1]):
            states[to] = (cost, new)


def _inserted(states: list) -> list:
    """The states after any inserts; more than two in a row are never cheapest."""
    out = list(states)
    for s in (0, 1, 3):
        if states[s]:
            _offer(out, 2, states[s][0] + _COST["I"], states[s][1], "I")
    if out[2]:
        _offer(out, 3, out[2][0] + _COST["I"], out[2][1], "I")
    return out


def step(states: list, initial: str, bad: bool, cut_off: bool) -> list:
    """The states after one more row."""
    out: list = [None] * 4
    more = _CUT_OFF if cut_off else 0
    for s, held in enumerate(_inserted(states)):
        if held is None:
            continue
        cost, node = held
        _offer(out, s, cost + _COST["D"], node, "D")
        if not bad:
            if initial in _KEPT[s]:
                _offer(out, _KEPT[s][initial], cost + more, node, "K")
            _offer(out, _NEW[s], cost + more + _COST["R"], node, "R")
    return out


#: Inserts after the last row by the state after it; after a lone system turn and at the start two are needed.
_ENDS = {0: "", 3: "", 2: "I", 1: "II"}


# Damage and faults ---------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows <conv_id, turn, role, text> after the damage told by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("harm"))
    rows = rows.where("harm <> 0").select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("harm") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_")).drop("_")


def faults(rows: DataFrame) -> DataFrame:
    """Rows without texts, equal ones as one: conv_id, turn, role, key, n, blank, cut_off, again.

    ``again`` tells that the role and text stand at an earlier turn; of ``n`` equal rows those after the first are repeats anyway.
    """
    light = rows.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("key"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut_off"))
    light = light.groupBy("conv_id", "turn", "role", "key", "blank", "cut_off").agg(F.count("*").alias("n"))
    # A null turn comes first.
    said = light.groupBy("conv_id", "role", "key").agg(
        F.count("*").alias("places"), F.count_if(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("first"))
    said = said.where("places > 1").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "untimed", "first")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    again = F.col("k").isNotNull() & F.col("turn").isNotNull() & ((F.col("untimed") > 0) | (F.col("turn") > F.col("first")))
    return light.join(said, on, "left").select("conv_id", "turn", "role", "key", "n", "blank", "cut_off", again.alias("again"))


# Pieces of conversations ---------------------------------------------------------------

_PIECE = ("conv_id {id}, part int, open boolean, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
          "least long, most long, turns long, first_turn long, last_turn long, costs array<long>, ranks array<int>, audits array<string>")
_LEGAL = {"su", "ua", "au"}


class _Piece:
    """What one partition holds of one conversation."""

    def __init__(self, conv, starts):
        self.conv, self.states = conv, {s: [(0, Edit()) if s == i else None for i in range(4)] for s in starts}
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.least = self.most = self.first_turn = self.last_turn = None

    def add(self, turn, role, n, blank, cut_off, again):
        initial = role[:1]
        if self.n == 0:
            self.first, self.first_turn = initial, turn
        else:
            self.illegal += self.last + initial not in _LEGAL
        if turn is not None and (self.turns == 0 or turn != self.last_turn):
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.last, self.last_turn, self.n = initial, turn, self.n + n
        self.illegal += n - 1
        bad = blank or again
        if blank:
            self.blank += n
        else:
            self.duplicate += n - (not again)
            self.truncated += cut_off and not again
        for s, states in self.states.items():
            states = step(states, initial, bad, cut_off and not bad)
            for _ in range(n - 1):  # equal rows behind the first: nothing but deletes
                states = [held and (held[0] + _COST["D"], Edit(held[1], "D")) for held in states]
            self.states[s] = states

    def row(self, part, is_open):
        costs, ranks, audits = [], [], []
        if is_open:
            for s in range(4):
                texts = [held and held[1].text() for held in self.states[s]]
                order = sorted(t for t in texts if t is not None)
                costs += [-1 if held is None else held[0] for held in self.states[s]]
                ranks += [-1 if t is None else order.index(t) for t in texts]
                audits += texts
        else:
            ends: list = [None]
            for s, held in enumerate(self.states[0]):
                if held:
                    node = held[1]
                    for char in _ENDS[s][:-1]:
                        node = Edit(node, char)
                    cost = held[0] + _COST["I"] * len(_ENDS[s])
                    if _ENDS[s]:
                        _offer(ends, 0, cost, node, "I")
                    elif ends[0] is None or cost < ends[0][0] or (cost == ends[0][0] and less(node, ends[0][1])):
                        ends[0] = (cost, node)
            costs, audits = [ends[0][0]], [ends[0][1].text()]
        return (self.conv, part, is_open, self.n, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.least,
                self.most, self.turns, self.first_turn, self.last_turn, costs, ranks, audits)


def _pieces(schema: str):
    """Pieces of the sorted rows of a partition. Only its first and last conversation can go on in others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, target = TaskContext.get().partitionId(), arrow_schema(schema)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

        piece, opened, out = None, False, []
        for batch in batches:
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        out.append(piece.row(part, not opened))
                        opened = True
                    piece = _Piece(conv, (0,) if opened else range(4))
                    # A last conversation is open as well, which is known at the end: it is worked out from all states there.
                    held = []
                piece.add(*row)
                if opened:
                    held.append(row)
            if len(out) >= 2_000:
                yield batch_of(out)
                out = []
        if piece is not None:
            if opened:
                piece = _Piece(piece.conv, range(4))
                for row in held:
                    piece.add(*row)
            out.append(piece.row(part, True))
        if out:
            yield batch_of(out)

    return run


def _chosen(rows):
    """Puts the open pieces of one conversation together by cost and rank: the choice for each piece, and the sums.

    There is at most one row for each partition, and none holds an audit.
    """
    rows = rows.sort_values("part")
    state: dict[int, tuple] = {0: (0, 0)}  # state -> (cost, rank)
    ways: list[dict] = []
    for costs, ranks in zip(rows["costs"], rows["ranks"]):
        best: dict[int, tuple] = {}
        for s, (cost, rank) in state.items():
            for t in range(4):
                if costs[4 * s + t] >= 0:
                    offer = (cost + int(costs[4 * s + t]), rank, int(ranks[4 * s + t]), s)
                    if t not in best or offer < best[t]:
                        best[t] = offer
        ways.append({t: o[3] for t, o in best.items()})
        order = sorted(best, key=lambda t: best[t][1:3])
        state = {t: (best[t][0], order.index(t)) for t in best}
    end = min(state, key=lambda s: (state[s][0] + _COST["I"] * len(_ENDS[s]), state[s][1]))
    total, choices, at = state[end][0] + _COST["I"] * len(_ENDS[end]), [], end
    for way in reversed(ways):
        choices.append(4 * way[at] + at)
        at = way[at]
    firsts, lasts = rows["first"].tolist(), rows["last"].tolist()
    same = sum(a is not None and a == b for a, b in zip(rows["first_turn"].tolist()[1:], rows["last_turn"].tolist()))
    least, most = ([int(x) for x in rows[c].tolist() if x is not None] for c in ("least", "most"))
    out = rows[["conv_id", "part"]].copy()
    out["choice"] = choices[::-1]
    out["tail"] = [""] * (len(rows) - 1) + [_ENDS[end]]
    sums = {c: int(rows[c].sum()) for c in ("n", "blank", "duplicate", "truncated")}
    sums["illegal"] = int(rows["illegal"].sum()) + sum(a + b not in _LEGAL for a, b in zip(lasts, firsts[1:]))
    sums["gaps"] = max(most) - min(least) + 1 - (int(rows["turns"].sum()) - same) if most else 0
    for name, value in (sums | {"cost": total}).items():
        out[name] = value
    return out


_TOTALS = ["n", "blank", "duplicate", "truncated", "illegal", "gaps", "cost"]


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``faults``: its counts, gaps, cost, and the audit."""
    spark, id_type = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString().replace("bigint", "long")
    schema = _PIECE.format(id=id_type)
    order = ["conv_id", "turn", "role", "key"]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Sorted over all partitions: a conversation is cut wherever a partition ends.
    ordered = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    pieces = materialize(ordered.select("conv_id", F.col("turn").cast("long"), "role", "n", "blank", "cut_off", "again").mapInArrow(
        _pieces(schema), schema), "conversation-pieces")
    whole = pieces.where("not open").select(
        "conv_id", "n", "blank", "duplicate", "truncated", "illegal",
        F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), F.col("costs")[0].alias("cost"),
        F.col("audits")[0].alias("audit"))
    cut = pieces.where("open")
    # As texts: numbers with nulls would become doubles in pandas.
    times = [F.col(c).cast("string").alias(c) for c in ("least", "most", "first_turn", "last_turn")]
    light = cut.select("conv_id", "part", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", *times, "costs", "ranks")
    chosen = light.groupBy("conv_id").applyInPandas(
        _chosen, f"conv_id {id_type}, part int, choice int, tail string, " + ", ".join(f"{c} long" for c in _TOTALS))
    chosen = chosen.withColumnRenamed("conv_id", "id").withColumnRenamed("part", "at").select("id", "at", "choice", "tail", *_TOTALS)
    texts = cut.select("conv_id", "part", "audits")
    joined = texts.join(chosen, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("part") == F.col("at")))
    told = joined.groupBy("conv_id", *_TOTALS).agg(F.array_sort(F.collect_list(F.struct(
        "part", F.concat(F.element_at("audits", F.col("choice") + 1), F.col("tail")).alias("audit")))).alias("all"))
    return whole.union(told.select("conv_id", *_TOTALS, F.array_join(F.col("all.audit"), "").alias("audit")))


# Repaired turns ------------------------------------------------------------------------

_TURN = "conv_id {id}, place long, edit string, role string, text string"


def _apply(schema: str):
    """The turns that the edits leave; a conversation's audit comes before its rows, which follow one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        audit, conv, at, state, place, out, size = "", None, 0, 0, 0, [], 0

        def put(edit, role, text):
            nonlocal place, size
            out.append((conv, place, edit, role, text))
            place, size = place + 1, size + len(text)

        def inserts():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = _NEW[state], at + 1
                put("I", _ROLE[state], "")

        def batch_of():
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

        for batch in batches:
            for new, head, told, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if head == 0:
                    inserts()
                    audit, conv, at, state, place = told, new, 0, 0, 0
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = _KEPT[state][role[:1]]
                    put(edit, role, text)
                elif edit == "R":
                    state = _NEW[state]
                    put(edit, _ROLE[state], text)
                if len(out) >= 2_000 or size > 1 << 22:
                    yield batch_of()
                    size = 0
        inserts()
        if out:
            yield batch_of()

    return run


def repaired(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The turns of every conversation after its edits: conv_id, place (from 0), edit, role, text; sorted within partitions.

    ``rows`` are those of ``damaged``, ``told`` has the audits. Conversations are spread over the partitions; one of any
    length passes its task row by row, and only its audit is held.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString().replace("bigint", "long")
    none = F.lit(None).cast("string")
    both = told.select("conv_id", F.lit(0).alias("head"), "audit", F.lit(None).cast("long").alias("turn"), none.alias("role"),
                       none.alias("key"), none.alias("text")).union(
        rows.select("conv_id", F.lit(1), none, F.col("turn").cast("long"), "role", F.sha2("text", 256), "text"))
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(width, "conv_id").sortWithinPartitions("conv_id", "head", "turn", "role", "key")
    schema = _TURN.format(id=id_type)
    return ordered.select("conv_id", "head", "audit", "role", "text").mapInArrow(_apply(schema), schema)


def _digests(schema: str):
    """SHA-256 of the sorted turns of each conversation, fed row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)

        def turns():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))

        out = []
        for conv, rows in groupby(turns(), key=lambda r: r[0]):
            sha = hashlib.sha256()
            for _, place, role, text in rows:
                sha.update(("\n" * (place > 0) + role + ":" + text).encode())
            out.append((conv, sha.hexdigest()))
            if len(out) >= 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), target)], schema=target)

    return run


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation without rows after the damage has zeros, an empty audit and the hash of the empty text.
    """
    rows = damaged(conversations)
    told = materialize(audits(faults(rows)), "conversation-audits")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString().replace('bigint', 'long')}, sha string"
    hashes = repaired(rows, told).select("conv_id", "place", "role", "text").mapInArrow(_digests(schema), schema)
    totals = [c for c in _TOTALS if c != "n"]
    none = [F.lit(None).cast("long").alias(c) for c in totals] + [F.lit(None).cast("string").alias("audit")]
    every = (told.select("conv_id", *totals, "audit", F.lit(None).cast("string").alias("sha"))
             .union(conversations.select("conv_id").distinct().select("conv_id", *none, F.lit(None).cast("string")))
             .union(hashes.select("conv_id", *none, "sha")))
    of_none = hashlib.sha256(b"").hexdigest()
    return every.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.lit(of_none)).alias("repaired_sha256"))
