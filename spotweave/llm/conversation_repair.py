"""Repair of conversations' structure at least cost, by a Viterbi search that runs in chunks and converges by rank.

A conversation's rows, in order, are kept, given another role, deleted, or joined by new ones, such that the role initials read
`(s?(ua)+)?` afterwards; each edit has its cost (`COSTS`), rows without words and repeated rows must go, and rows that end in no
full stop cost more when they stay. The costs from a row on, for the four states of that pattern, are a vector; a row turns the vector
after it into the one before it.

Conversations are cut into chunks of `CHUNK` rows. Every chunk but a conversation's last starts from a speculative vector, all at once. Fix-up
passes hand each chunk the vector that the next one has come to, and run those again whose vector differs by more than a constant; a rerun stops
at the first row where it is parallel to the former run, as all before it then differs by that constant only, which changes no
choice. Passes end when no vector changes: mostly after one, at worst after as many as a conversation has chunks. Then a chunk maps each state at its start
to one at its end; these maps are composed in a tree of `FAN`, which gives every chunk its state, and the chunks are traced by the stitched backward costs, taking
at each step the edit with the least initial among the cheapest ones.

Rows are numbered within conversations by range, so one conversation may be many tasks up to here. Only what a contract wants in one value (audit, hash of the
repaired text) passes through one task for a conversation, as a stream: it holds a row, a chunk's edits and the audit.

Defined cases: a null role or text counts as one space; null turns come first, rows of one turn by role and text; rows without a conv_id are one conversation; repeated
rows are duplicates; texts of any length are compared by SHA-256 and hashed as they come; extra columns are ignored; a conversation all of whose rows were
dropped has zeros, an empty audit and the empty string's hash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import meet, numbered
from .common import use_shared_checkpoints

CHUNK, FAN = 512, 256
#: Keep, Rerole, Delete, Insert, and what a truncated row adds.
COSTS = {"R": 3, "D": 4, "I": 3, "truncated": 3}
SPACE = " \t\n\x0b\x0c\r"

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What a role's initial does, and the one role that may follow by our own making.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_MADE = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
_INITIALS = " sua"
_END = (0, 6, 3, 0)
#: What interior chunks start from.
_GUESS = (0, 0, 0, 0)
MUST_GO = (1, 2)
NAMES = {"u": "user", "a": "assistant"}

Vector = tuple[int, int, int, int]


class Steps:
    """Vectors before a row from vectors after it, both less their least cost; a symbol is initial + 4 * fault (0 none, 1 blank, 2 duplicate, 3 truncated)."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, Vector], tuple[Vector, tuple]] = {}

    def __call__(self, symbol: int, after: Vector) -> tuple[Vector, tuple]:
        """The vector before, and for each state the edit to take: (letter, state after it)."""
        found = self.known.get((symbol, after))
        if found is None:
            found = self.known[symbol, after] = self._make(symbol, after)
        return found

    def _make(self, symbol: int, after: Vector) -> tuple[Vector, tuple]:
        initial, fault = _INITIALS[symbol % 4], symbol // 4
        more = COSTS["truncated"] * (fault == 3)
        ways: list[dict[str, tuple[int, int]]] = []  # letter: (cost, state)
        for s in range(4):
            w = {"D": (COSTS["D"] + after[s], s)}
            if fault not in MUST_GO:
                if initial in _NEXT[s]:
                    w["K"] = (more + after[_NEXT[s][initial]], _NEXT[s][initial])
                w["R"] = (COSTS["R"] + more + after[_MADE[s][1]], _MADE[s][1])
            ways.append(w)
        cost = [min(c for c, _ in w.values()) for w in ways]
        for _ in range(2):
            cost = [min(c, COSTS["I"] + cost[_MADE[s][1]]) for s, c in enumerate(cost)]
        for s in range(4):
            ways[s]["I"] = (COSTS["I"] + cost[_MADE[s][1]], _MADE[s][1])
        choice = tuple(next((letter, ways[s][letter][1]) for letter in "DIKR" if letter in ways[s] and ways[s][letter][0] == cost[s]) for s in range(4))
        return _flat(cost), choice

    def back(self, symbols: list[int], after: Vector) -> Vector:
        for x in reversed(symbols):
            after = self(x, after)[0]
        return after

    def again(self, symbols: list[int], old: Vector, new: Vector, before: Vector) -> Vector:
        """The vector at a chunk's start from a new one at its end; `before` is what the old one came to, and is the answer once both are parallel."""
        for x in reversed(symbols):
            old, new = self(x, old)[0], self(x, new)[0]
            if old == new:
                return before
        return new

    def trace(self, symbols: list[int], after: Vector, last: bool) -> list:
        """Choices of each row, from the first on."""
        out = []
        for x in reversed(symbols):
            after, choice = self(x, after)
            out.append(choice)
        return out[::-1]


def _flat(v) -> Vector:
    low = min(v)
    return tuple(int(x - low) for x in v)


def _walk(choices: list, state: int, last: bool) -> tuple[str, int]:
    """Edits of a chunk from a state, and the state after it: small letters are roles put in, capital ones what becomes of a row (K, D, or its new role)."""
    out = []
    for choice in choices:
        while True:
            letter, to = choice[state]
            if letter == "I":
                out.append(_MADE[state][0])
                state = to
                continue
            out.append(_MADE[state][0].upper() if letter == "R" else letter)
            state = to
            break
    while last and _END[state]:
        out.append(_MADE[state][0])
        state = _MADE[state][1]
    return "".join(out), state


def damage(rows: DataFrame) -> DataFrame:
    """The test's damage, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its full stops, 3 repeats it, 4 makes its role user."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    d = rows.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def _bare(c: str) -> Column:
    return F.rtrim(F.col(c), F.lit(SPACE))


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and pos, the row's place in its conversation; nulls as one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return numbered(rows.select("conv_id", "turn", or_space("role"), or_space("text"), F.monotonically_increasing_id().alias("_tie")), ["conv_id"], ["turn", "role", "text", "_tie"], "pos").drop("_tie")


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, symbol) of placed rows. Rows are equal when SHA-256 of their role and text is; the first of a conversation's equal rows is none."""
    same = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    initial = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(0)
    slim = rows.select("conv_id", "pos", same.alias("same"), initial.alias("initial"), (_bare("text") == "").alias("blank"), F.substring(_bare("text"), -1, 1).isin(".", "!", "?").alias("ended"))
    first = slim.groupBy("conv_id", "same").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    fault = F.when(F.col("blank"), 1).when(F.col("pos") > F.col("first"), 2).when(~F.col("ended"), 3).otherwise(0)
    return meet(slim, first, ["conv_id", "same"], "left").select("conv_id", "pos", (F.col("initial") + 4 * fault).cast("int").alias("symbol"))


def chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """(conv_id, chunk, symbols, last): a row for each `chunk` rows of a conversation."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"])  # `chunk` rows at most
    made = symbols(rows).groupBy("conv_id", F.expr(f"pos div {chunk}").alias("chunk")).agg(in_order.alias("symbols")).checkpoint()
    earlier = made.where("chunk > 0").select("conv_id", (F.col("chunk") - 1).alias("chunk"), F.lit(False).alias("last"))
    return meet(made, earlier, ["conv_id", "chunk"], "left").withColumn("last", F.coalesce("last", F.lit(True)))


def _vectors(name: str) -> str:
    return f"{name} array<int>"


def solved(found: DataFrame) -> tuple[DataFrame, int]:
    """Adds `after`, the stitched vector at each chunk's end; and the number of fix-up passes that changed something."""
    kind = found.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, chunk bigint, symbols array<int>, last boolean, after array<int>, before array<int>, changed boolean"
    columns = ["conv_id", "chunk", "symbols", "last"]

    def speculate(batches):
        steps = Steps()
        for batch in batches:
            after = [_END if last else _GUESS for last in batch.column("last").to_pylist()]
            before = [steps.back(x, _flat(a)) for x, a in zip(batch.column("symbols").to_pylist(), after, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([_flat(a) for a in after], pa.list_(pa.int32())), pa.array(before, pa.list_(pa.int32())), pa.array([True] * len(after))], [*columns, "after", "before", "changed"])

    def fix(batches):
        steps = Steps()
        for batch in batches:
            rows = []
            for x, a, b, now in zip(*(batch.column(c).to_pylist() for c in ("symbols", "after", "before", "now")), strict=True):
                changed = now is not None and now != a
                rows.append((now, steps.again(x, tuple(a), tuple(now), tuple(b)), True) if changed else (a, b, False))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (0, 1)), pa.array([r[2] for r in rows], pa.bool_())], [*columns, "after", "before", "changed"])

    state, passes = found.select(*columns).mapInArrow(speculate, shape).checkpoint(), 0
    alone = (F.col("chunk") == 0) & F.col("last")
    whole, state = state.where(alone), state.where(~alone)
    while True:
        came = state.where("chunk > 0").select("conv_id", (F.col("chunk") - 1).alias("chunk"), F.col("before").alias("now"))
        state = meet(state, came, ["conv_id", "chunk"], "left").mapInArrow(fix, shape).checkpoint()
        if not state.where("changed").take(1):
            return whole.union(state).drop("before", "changed"), passes
        passes += 1


def starts(maps: DataFrame, fan: int = FAN) -> DataFrame:
    """(conv_id, chunk, start) from (conv_id, chunk, ends), the state that each chunk makes of a state: composed in a tree, and told down it again."""
    levels = [maps.select("conv_id", F.col("chunk").alias("k"), "ends")]
    groups = []
    while (levels[-1].agg(F.max("k")).first()[0] or 0) > 0:
        members = F.array_sort(F.collect_list(F.struct("k", "ends"))).alias("members")  # `fan` at most
        g = levels[-1].groupBy("conv_id", F.expr(f"k div {fan}").alias("k")).agg(members).checkpoint()
        whole = F.aggregate("members", F.array(*[F.lit(s) for s in range(4)]), lambda s, x: F.transform(s, lambda y: F.get(x["ends"], y)))
        groups.append(g)
        levels.append(g.select("conv_id", "k", whole.alias("ends")))
    told = levels[-1].select("conv_id", "k", F.lit(0).alias("start"))
    for g in reversed(groups):
        run = F.aggregate("members", F.struct(F.col("start").alias("s"), F.array().cast("array<struct<k:bigint,start:int>>").alias("out")), lambda s, x: F.struct(F.get(x["ends"], s["s"]).alias("s"), F.concat(s["out"], F.array(F.struct(x["k"].alias("k"), s["s"].alias("start")))).alias("out")))
        told = meet(g, told, ["conv_id", "k"]).select("conv_id", F.explode(run["out"]).alias("m")).select("conv_id", "m.k", "m.start")
    return told.select("conv_id", F.col("k").alias("chunk"), "start")


def edits(found: DataFrame, fan: int = FAN) -> DataFrame:
    """(conv_id, chunk, symbols, edits) from solved chunks."""
    kind = found.schema["conv_id"].dataType.simpleString()

    def ends(batches):
        steps = Steps()
        for batch in batches:
            got = []
            for x, a, last in zip(*(batch.column(c).to_pylist() for c in ("symbols", "after", "last")), strict=True):
                choices = steps.trace(x, tuple(a), last)
                got.append([_walk(choices, s, last)[1] for s in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(got, pa.list_(pa.int32()))], ["conv_id", "chunk", "ends"])

    def trace(batches):
        steps = Steps()
        for batch in batches:
            got = []
            for x, a, last, start in zip(*(batch.column(c).to_pylist() for c in ("symbols", "after", "last", "start")), strict=True):
                got.append(_walk(steps.trace(x, tuple(a), last), start, last)[0])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), batch.column("symbols"), pa.array(got, pa.string())], ["conv_id", "chunk", "symbols", "edits"])

    several = found.where(~((F.col("chunk") == 0) & F.col("last")))
    begun = starts(several.mapInArrow(ends, f"conv_id {kind}, chunk bigint, ends array<int>").checkpoint(), fan)
    every = found.where((F.col("chunk") == 0) & F.col("last")).withColumn("start", F.lit(0)).unionByName(meet(several, begun, ["conv_id", "chunk"]))
    return every.mapInArrow(trace, f"conv_id {kind}, chunk bigint, symbols array<int>, edits string")


class _Tale:
    """One conversation as its rows come by."""

    def __init__(self, key):
        self.key, self.low, self.high, self.turns, self.turn = key, None, None, 0, None
        self.faults, self.illegal, self.cost, self.before = [0, 0, 0, 0], 0, 0, None
        self.audit, self.hash, self.begun = [], hashlib.sha256(), False
        self.todo, self.symbols, self.at, self.row = "", [], 0, 0

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
        self.begun = True

    def put_in(self) -> None:
        """New rows before the next one."""
        while self.at < len(self.todo) and self.todo[self.at].islower():
            self._say(NAMES[self.todo[self.at]], "")
            self.audit.append("I")
            self.cost += COSTS["I"]
            self.at += 1

    def chunk(self, todo: str, symbols: list[int]) -> None:
        self.put_in()
        self.todo, self.symbols, self.at, self.row = todo, symbols, 0, 0

    def see(self, turn, role: str, text: str) -> None:
        self.put_in()
        edit, fault = self.todo[self.at], self.symbols[self.row] // 4
        self.at, self.row = self.at + 1, self.row + 1
        self.faults[fault] += 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        if turn is not None:
            self.turns += turn != self.turn
            self.turn = turn
            self.low, self.high = turn if self.low is None else self.low, turn
        if edit == "D":
            self.cost += COSTS["D"]
            self.audit.append("D")
            return
        self.cost += COSTS["truncated"] * (fault == 3) + COSTS["R"] * (edit != "K")
        self.audit.append("K" if edit == "K" else "R")
        self._say(role if edit == "K" else NAMES[edit.lower()], text)

    def result(self) -> tuple:
        self.put_in()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.key, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def told(rows: DataFrame, edited: DataFrame, chunk: int) -> DataFrame:
    """A row for each conversation that has rows: counts, cost, audit, hash of the repaired text. A chunk's edits come before its rows in one stream."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    head = edited.select("conv_id", (F.col("chunk") * chunk).alias("pos"), F.lit(0).alias("tag"), none("bigint").alias("turn"), none("string").alias("role"), none("string").alias("text"), "edits", "symbols")
    body = rows.select("conv_id", "pos", F.lit(1).alias("tag"), F.col("turn").cast("bigint").alias("turn"), "role", "text", none("string").alias("edits"), none("array<int>").alias("symbols"))
    stream = head.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "tag")
    types = [rows.schema["conv_id"].dataType.simpleString(), *["bigint"] * len(COUNTS), "string", "string"]
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def run(batches):
        tale = None
        for batch in batches:
            done = []
            for key, tag, turn, role, text, todo, symbols in zip(*(batch.column(c) for c in ("conv_id", "tag", "turn", "role", "text", "edits", "symbols")), strict=True):
                key = key.as_py()
                if tale is None or tale.key != key:
                    if tale is not None:
                        done.append(tale.result())
                    tale = _Tale(key)
                if tag.as_py() == 0:
                    tale.chunk(todo.as_py(), symbols.as_py())
                else:
                    tale.see(turn.as_py(), role.as_py(), text.as_py())
            yield packed(done, batch.column("conv_id").type)
        if tale is not None:
            yield packed([tale.result()], batch.column("conv_id").type)

    def packed(done, key):
        kinds = [key, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names)

    return stream.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def repair(rows: DataFrame, conversations: DataFrame | None = None, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. conversations: all ids there are, where rows may lack some."""
    use_shared_checkpoints(rows.sparkSession)
    at = placed(rows)
    found, _ = solved(chunks(at, chunk))
    result = told(at, edits(found, fan), chunk)
    if conversations is None:
        return result
    every = meet(conversations.select("conv_id").distinct(), result, ["conv_id"], "left")
    return every.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def oracle() -> str:
    """The query's rows in DuckDB: the damage with CRC-32 bit by bit, one vector for each row backwards, one edit for each step forwards."""
    half = "CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END"
    byte = f"lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: 0::UBIGINT)), lambda v, z: {half})"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::UBIGINT)), {byte}), 4294967295::UBIGINT)"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    keep = lambda s: f"CASE WHEN ok THEN CASE initial {' '.join(f"WHEN '{c}' THEN pen + b.v[{to + 1}]" for c, to in _NEXT[s].items())} END END"
    ways = ", ".join(f"least(4 + b.v[{s + 1}], {keep(s)}, CASE WHEN ok THEN 3 + pen + b.v[{_MADE[s][1] + 1}] END)" for s in range(4))
    to = "CASE t.s WHEN 2 THEN 3 ELSE 2 END"
    kept = "CASE initial WHEN 's' THEN CASE WHEN t.s = 0 THEN 1 END WHEN 'u' THEN CASE WHEN t.s <> 2 THEN 2 END WHEN 'a' THEN CASE WHEN t.s = 2 THEN 3 END END"
    return f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, 'none') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
hashed AS (SELECT *, {crc} % 20 AS kind FROM raw),
damaged AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) x(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY c) AS n, left(role, 1) AS initial, rtrim(text, {white}) AS bare
  FROM damaged),
met AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS k, lag(initial) OVER (PARTITION BY c ORDER BY i) AS before FROM placed),
faults AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN k > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM met),
f AS (SELECT *, fault NOT IN (1, 2) AS ok, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS pen FROM faults),
b AS (
  SELECT c, n + 1 AS i, [0, 6, 3, 0] AS v FROM f GROUP BY c, n
  UNION ALL
  SELECT c, i, [least(w[1], 3 + least(w[3], 3 + w[4])), least(w[2], 3 + least(w[3], 3 + w[4])), least(w[3], 3 + w[4]), least(w[4], 3 + w[3])] FROM (SELECT f.c, f.i, [{ways}] AS w FROM b JOIN f ON f.c = b.c AND f.i = b.i - 1)),
t AS (
  SELECT c, 1::BIGINT AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS said FROM b WHERE i = 1
  UNION ALL
  SELECT c, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN s WHEN 'K' THEN kept ELSE made END, audit || edit,
         CASE edit WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE WHEN made = 2 THEN 'user:' ELSE 'assistant:' END || CASE WHEN edit = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT t.*, f.role, f.text, {kept} AS kept, {to} AS made,
           CASE WHEN f.i IS NOT NULL AND 4 + later.v[t.s + 1] = here.v[t.s + 1] THEN 'D' WHEN 3 + here.v[{to} + 1] = here.v[t.s + 1] THEN 'I'
                WHEN ok AND pen + later.v[{kept} + 1] = here.v[t.s + 1] THEN 'K' ELSE 'R' END AS edit
    FROM t JOIN b here ON here.c = t.c AND here.i = t.i LEFT JOIN b later ON later.c = t.c AND later.i = t.i + 1 LEFT JOIN f ON f.c = t.c AND f.i = t.i
    WHERE f.i IS NOT NULL OR t.s IN (1, 2))),
done AS (SELECT c, arg_max(audit, length(audit)) AS audit, arg_max(said, length(audit)) AS said FROM t GROUP BY c),
sums AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY c)
SELECT r.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.v[1], 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM raw) r LEFT JOIN sums ON sums.c = r.c LEFT JOIN done ON done.c = r.c LEFT JOIN b ON b.c = r.c AND b.i = 1"""
