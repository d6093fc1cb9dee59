"""Conversation structure repair: the cheapest edits that give a conversation the roles ``(s?(ua)+)?``.

Faults of a turn, the first of: blank (nothing but white space), duplicate (role and text seen earlier), truncated
(the last other character is no ``.``, ``!`` or ``?``). Edits: Keep (0), Rerole to user or assistant (1), Delete (2; blank
and duplicate turns must go), Insert an empty user or assistant turn anywhere (5); a truncated turn that is not
deleted costs 5 more. The audit is the row of the edits' initials, of equal costs the least in ASCII order.

The edit lattice has a node per (turns consumed, role written last). Two heaps settle it from both ends, always the
nearer one, until no path through unsettled nodes can be as cheap as the best that met; so all equal-cost
crossings are finished. Nodes on cheapest paths are marked back from the crossings, and a walk that takes the
least initial at each marked node gives the least audit. Initials determine the roles, and two different audits
of equal cost between the same nodes never begin one another, so least parts make the least whole.

Rows are dealt by ranges of conversation and turn. A conversation inside one task with at most ``BLOCK`` turns is
solved at once. Others are blocks of turns, each solved between every pair of roles at its ends; one pass over
these small tables picks the chain of blocks (it keeps four audits, a byte an edit), and only a digest must see
a long conversation's texts in one stream.

Null roles and texts are one blank. Turns of equal number are ordered by role and text; null turns come first. A null
conversation id is a conversation as any other. Roles go by their first letter, case counts.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, give_back, written

BLOCK = 512  # turns of a piece
PIECE_BYTES = 8 << 20  # text of a piece, about
SOLVED = 1 << 14  # solved short shapes remembered
SHORT = 16  # turns of a shape that is remembered
RANGE_CHARS = 32  # of roles and texts by which turns of equal number are dealt

# Fixed values of the rules.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
LETTERS = "sua"
LEGAL = {"su", "ua", "au"}
WRITTEN = {"u": "user", "a": "assistant"}
WORD = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

# Roles written last: none yet, system, user, assistant. What may follow, and where a conversation may end.
NONE, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (NONE, ASSISTANT)
STATES = 4


def shape(role: str, fault: int) -> int:
    """A turn as the lattice sees it: the role's first letter and the fault."""
    at = LETTERS.find(role[:1]) if role else -1
    return 4 * (at if at >= 0 else 3) + fault


def _inserts(state: int) -> list[tuple[str, int, int]]:
    return [("I", INSERT, to) for (at, letter), to in FOLLOWS.items() if at == state and letter in WRITTEN]


def _turns(kind: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, role written last) of the edits that consume a turn."""
    letter, fault = (LETTERS + "?")[kind // 4], kind % 4
    out = [("D", DELETE, state)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = CUT_OFF if fault == TRUNCATED else 0
    for (at, follows), to in FOLLOWS.items():
        if at == state and follows == letter:
            out.append(("K", more, to))
        elif at == state and follows in WRITTEN:
            out.append(("R", REROLE + more, to))
    return out


# Edges in the order of their initials, and the same edges by where they lead.
AHEAD = [[sorted([*_turns(k, s), *_inserts(s)]) for s in range(STATES)] for k in range(16)]
LAST = [_inserts(s) for s in range(STATES)]
BACK = [[[(c, s) for s in range(STATES) for _, c, to in _turns(k, s) if to == t] for t in range(STATES)] for k in range(16)]
BACK_INSERT = [[(c, s) for s in range(STATES) for _, c, to in _inserts(s) if to == t] for t in range(STATES)]


def solve(kinds: bytes, entry: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost and its least audit from a role before some turns to one of the roles after them; None: no way."""
    if len(kinds) <= SHORT:
        return _remembered(kinds, entry, goals)
    return _solve(kinds, entry, goals)


def _solve(kinds: bytes, entry: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    n = len(kinds)
    ends = {n * STATES + g for g in goals}

    def ahead(node):
        at, state = divmod(node, STATES)
        if at == n:
            return [(letter, cost, at * STATES + to) for letter, cost, to in LAST[state]]
        return [(letter, cost, (at + (letter != "I")) * STATES + to) for letter, cost, to in AHEAD[kinds[at]][state]]

    def back(node):
        at, state = divmod(node, STATES)
        out = [(cost, at * STATES + s) for cost, s in BACK_INSERT[state]]
        if at:
            out += [(cost, (at - 1) * STATES + s) for cost, s in BACK[kinds[at - 1]][state]]
        return out

    far = {entry: 0}, dict.fromkeys(ends, 0)
    heaps = [(0, entry)], [(0, e) for e in sorted(ends)]
    settled: tuple[set, set] = (set(), set())
    best = 0 if entry in ends else float("inf")
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, node = heapq.heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side].add(node)
        mine, other = far[side], far[1 - side]
        for step in ahead(node) if side == 0 else back(node):
            there, total = step[-1], cost + step[-2] if side == 0 else cost + step[0]
            if total < mine.get(there, float("inf")):
                mine[there] = total
                heapq.heappush(heaps[side], (total, there))
            if there in other:
                best = min(best, total + other[there])
    if best == float("inf"):
        return None

    (start, rest), near, beyond = far, settled[0], settled[1] | ends
    marked = set()  # nodes settled from the start on cheapest paths, found back from the crossings
    for node in sorted(near, key=lambda x: (start[x], x // STATES), reverse=True):
        cost = start[node]
        for _, step, there in ahead(node):
            crossing = there in beyond and cost + step + rest[there] == best
            if crossing or there in marked and start[there] == cost + step:
                marked.add(node)
                break
    audit, node, cost = [], entry, 0
    while not (node in ends and cost == best):
        for letter, step, there in ahead(node):
            total = cost + step
            if (there in beyond and total + rest[there] == best) or (there in marked and start[there] == total):
                audit.append(letter)
                node, cost = there, total
                break
    return best, "".join(audit)


_remembered = lru_cache(maxsize=SOLVED)(_solve)


def edited(roles: list[str], texts: list[str], audit: str, state: int) -> list[tuple[str, str]]:
    """The repaired turns (role, text) that an audit gives, and nothing else, from a role before them."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        letter = "a" if state == USER else "u"
        if edit == "I":
            out.append((WRITTEN[letter], ""))
        else:
            role = roles[at] if edit == "K" else WRITTEN[letter]
            out.append((role, texts[at]))
            letter = role[:1]
            at += 1
        state = FOLLOWS[state, letter]
    return out


def _first_faults(turns: DataFrame) -> DataFrame:
    """Turns with ``blank``, ``ended`` and ``again``: role and text were seen at an earlier turn number."""
    turns = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    spot = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    keyed = turns.withColumns(
        {
            "blank": ~F.col("text").rlike(WORD),
            "ended": F.col("text").rlike(ENDED),
            "k1": F.xxhash64("role", "text"),
            "k2": F.xxhash64(F.lit("again"), "text", "role"),
        }
    )
    # 128 bits name a role and text; only those at several turn numbers are joined
    seen = (
        keyed.where(~F.col("blank"))
        .groupBy(F.col("conv_id").alias("c"), F.col("k1").alias("a"), F.col("k2").alias("b"))
        .agg(F.min(spot).alias("first"), F.max(spot).alias("last"))
        .where(F.col("first") != F.col("last"))
        .drop("last")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b"))
    found = keyed.join(seen, same, "left")
    return found.select(
        "conv_id", "turn", "role", "text", "blank", "ended", F.coalesce(spot != F.col("first"), F.lit(False)).alias("again")
    )


_SUMMARY = "rows long, first_turn {turn}, last_turn {turn}, numbers long, blank long, duplicate long, truncated long, illegal long"
_PIECE = "conv_id {conv}, part int, block int, whole boolean, first_role string, last_role string, " + _SUMMARY
_WAYS = "ways array<struct<entry:int,goal:int,cost:long,audit:string>>"
_TEXTS = "roles array<string>, texts array<string>"


class _Piece:
    """Turns of one conversation in order, as many as fit in a block."""

    def __init__(self, conv_id, before: tuple | None):
        self.conv_id, self.before = conv_id, before
        self.turns, self.roles, self.texts, self.kinds, self.size = [], [], [], bytearray(), 0

    def add(self, turn, role: str, text: str, blank: bool, ended: bool, again: bool) -> None:
        again = again or (turn, role, text) == self.before
        self.before = (turn, role, text)
        fault = BLANK if blank else DUPLICATE if again else 0 if ended else TRUNCATED
        self.kinds.append(shape(role, fault))
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)

    def full(self) -> bool:
        return len(self.turns) >= BLOCK or self.size >= PIECE_BYTES

    def row(self, part: int, block: int, whole: bool) -> dict:
        kinds = bytes(self.kinds)
        if whole:
            asked = [(NONE, ENDS, -1)]
        else:
            asked = [(e, (g,), g) for e in range(STATES) for g in range(STATES)]
        ways = [(e, g, solve(kinds, e, goals)) for e, goals, g in asked]
        numbered = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        faults = [k % 4 for k in kinds]
        return dict(
            conv_id=self.conv_id, part=part, block=block, whole=whole, first_role=initials[0], last_role=initials[-1],
            rows=len(kinds), first_turn=numbered[0] if numbered else None, last_turn=numbered[-1] if numbered else None,
            numbers=len(set(numbered)), blank=faults.count(BLANK), duplicate=faults.count(DUPLICATE),
            truncated=faults.count(TRUNCATED), illegal=sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            ways=[dict(entry=e, goal=g, cost=w[0], audit=w[1]) for e, g, w in ways if w is not None],
            roles=self.roles, texts=self.texts,
        )


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def pieces(turns: DataFrame) -> DataFrame:
    """Conversations cut into pieces of at most ``BLOCK`` turns, each with its faults and cheapest edits.

    ``whole`` pieces are a conversation; the others have edits between each pair of roles at their ends and
    follow each other by (part, block).
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    rows = _first_faults(turns)
    start = [F.substring(c, 1, RANGE_CHARS) for c in ("role", "text")]
    rows = rows.repartitionByRange("conv_id", "turn", *start).sortWithinPartitions("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    schema = ", ".join([_PIECE, _WAYS, _TEXTS]).format(conv=kinds["conv_id"], turn=kinds["turn"])
    arrow = _arrow(spark, schema)

    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        now: _Piece | None = None
        edge = True  # the conversation may have begun in another task, or did so in another piece
        done, size = [], 0
        for batch in batches:
            for conv_id, *turn in zip(*[c.to_pylist() for c in batch.columns]):
                new = now is not None and conv_id != now.conv_id
                if new or now is not None and now.full():
                    done.append(now.row(part, block, new and not edge))
                    size += now.size
                    block, edge = block + 1, not new
                    now = _Piece(conv_id, None if new else now.before)
                now = now or _Piece(conv_id, None)
                now.add(*turn)
                if size >= PIECE_BYTES or len(done) >= BLOCK:
                    yield pa.RecordBatch.from_pylist(done, schema=arrow)
                    done, size = [], 0
        if now is not None:
            done.append(now.row(part, block, False))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        give_back()

    return rows.mapInArrow(run, schema)


class _Chain:
    """The cheapest edits of a conversation's pieces so far, for each role that may be written last."""

    def __init__(self, row: dict):
        self.conv_id, self.spots, self.steps = row["conv_id"], [], []
        self.best: dict[int, tuple[int, str]] = {NONE: (0, "")}
        self.sums = dict.fromkeys(("numbers", "blank", "duplicate", "truncated", "illegal"), 0)
        self.least = self.most = self.role = None

    def add(self, row: dict) -> None:
        now, steps = {}, {}
        for way in row["ways"]:
            if way["entry"] not in self.best:
                continue
            cost, audit = self.best[way["entry"]]
            label = (cost + way["cost"], audit + way["audit"])
            if way["goal"] not in now or label < now[way["goal"]]:
                now[way["goal"]], steps[way["goal"]] = label, (way["entry"], way["audit"])
        self.best = now
        self.steps.append(steps)
        self.spots.append((row["part"], row["block"]))
        for k in self.sums:
            self.sums[k] += row[k]
        if self.role is not None and self.role + row["first_role"] not in LEGAL:
            self.sums["illegal"] += 1
        self.role = row["last_role"]
        if row["first_turn"] is not None:
            if self.most is not None and self.most == row["first_turn"]:
                self.sums["numbers"] -= 1
            self.least = row["first_turn"] if self.least is None else self.least
            self.most = row["last_turn"]

    def rows(self) -> list[dict]:
        """(part, block, entry, audit) of each piece; the last one has the sums of all."""
        cost, goal = min((*label, g) for g, label in self.best.items() if g in ENDS)[::2]
        out = []
        for spot, steps in zip(reversed(self.spots), reversed(self.steps)):
            entry, audit = steps[goal]
            out.append(dict(p=spot[0], k=spot[1], entry=entry, edits=audit))
            goal = entry
        out[0]["sums"] = dict(cost=cost, least=self.least, most=self.most, **self.sums)
        return out[::-1]


_SUMS = "sums struct<cost:long,least:{turn},most:{turn},numbers:long,blank:long,duplicate:long,truncated:long,illegal:long>"


def chained(cut: DataFrame) -> DataFrame:
    """(p, k, entry, edits, sums) of each piece of conversations that are not in one piece; see `pieces`."""
    small = cut.drop("roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    schema = f"p int, k int, entry int, edits string, {_SUMS}".format(turn=dict(cut.dtypes)["first_turn"])
    arrow = _arrow(cut.sparkSession, schema)

    def run(batches):
        now: _Chain | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now.conv_id:
                    done += now.rows() if now is not None else []
                    now = _Chain(row)
                now.add(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist(now.rows(), schema=arrow)

    return small.mapInArrow(run, schema)


def repaired(turns: DataFrame, name: str = "repair") -> DataFrame:
    """Pieces of repaired conversations in order of (part, block): the edits and the turns that they give.

    ``sums`` (cost, least and greatest turn, different turns, faults and illegal neighbours before the repair) stands
    at the last piece of a conversation. ``turns`` has conv_id, turn, role and text.
    """
    spark = turns.sparkSession
    cut = written(pieces(turns), name)
    turn = dict(cut.dtypes)["first_turn"]
    alone = F.col("ways")[0]
    sums = F.struct(
        alone["cost"].alias("cost"), F.col("first_turn").alias("least"), F.col("last_turn").alias("most"),
        *[F.col(c) for c in ("numbers", "blank", "duplicate", "truncated", "illegal")],
    )
    whole = cut.where("whole").select(
        "conv_id", "part", "block", "whole", F.lit(NONE).alias("entry"), alone["audit"].alias("edits"), sums.alias("sums"),
        "roles", "texts",
    )
    links = chained(cut.where("NOT whole"))
    rest = cut.where("NOT whole").join(links, (F.col("part") == F.col("p")) & (F.col("block") == F.col("k")))
    rest = rest.select("conv_id", "part", "block", "whole", "entry", "edits", "sums", "roles", "texts")
    schema = f"conv_id {dict(cut.dtypes)['conv_id']}, part int, block int, whole boolean, edits string, {_SUMS}, {_TEXTS}".format(turn=turn)
    arrow = _arrow(spark, schema)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                made = edited(row["roles"], row["texts"], row["edits"], row.pop("entry"))
                out.append({**row, "roles": [r for r, _ in made], "texts": [t for _, t in made]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return whole.unionByName(rest).mapInArrow(run, schema)


def audited(fixed: DataFrame) -> DataFrame:
    """One row per conversation of `repaired`: sums, audit, and the digest of its ``role:text`` lines.

    A digest runs over a conversation in order, so one task streams one; of its texts only a hash state is kept.
    """
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    told = fixed.select("conv_id", "part", "block", "whole", "edits", "sums", (F.size("roles") > 0).alias("some"), lines.alias("lines"))
    one = told.where("whole").select("conv_id", "sums", F.col("edits").alias("audit"), F.sha2("lines", 256).alias("digest"))
    many = told.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    kinds = dict(told.dtypes)
    schema = f"conv_id {kinds['conv_id']}, sums {kinds['sums']}, audit string, digest string"
    arrow = _arrow(fixed.sparkSession, schema)

    def run(batches):
        now, hashed, some, audit, sums = None, None, False, [], None

        def row():
            return dict(conv_id=now[0], sums=sums, audit="".join(audit), digest=hashed.hexdigest())

        for batch in batches:
            done = []
            for x in batch.to_pylist():
                if now is None or now[0] != x["conv_id"]:
                    if now is not None:
                        done.append(row())
                    now, hashed, some, audit = (x["conv_id"],), hashlib.sha256(), False, []
                if x["some"]:
                    hashed.update((("\n" if some else "") + x["lines"]).encode())
                    some = True
                audit.append(x["edits"])
                sums = x["sums"]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=arrow)

    return one.unionByName(many.mapInArrow(run, schema))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by crc32(``conv_id:turn``) % 20; nulls are one blank.

    0 drops a turn, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it, 4 sets role ``user``.
    """

    def told(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    rows = turns.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(told("role")).alias("role"),
        text.alias("text"),
        F.when(fault == 3, 2).otherwise(1).alias("times"),
    )
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")
