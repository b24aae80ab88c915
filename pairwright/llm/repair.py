"""Conversation repair: cheapest edits by branch-and-bound over streamed conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.common import stored, table

#: What an edit costs; a truncated row that stays costs ``TRUNCATED`` more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The role written last: nothing yet, system, user, assistant. A repaired conversation
#: ends in the first or the last of them, that is, its initials are ``(s?(ua)+)?``.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
_TAKES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Rows of one search. Longer conversations are searched part by part, for every way to
#: enter and leave a part, so that the work is linear in their rows.
PART = 48
#: Rows of a result batch, and the characters of text it may hold.
_ROWS, _CHARS = 4096, 4 << 20

# Rows come to the search as letters: u, a, s and o (any other role), in capitals where the
# row is truncated, and x where it has to go.


def suffix_bounds(letters: str) -> tuple[list[int], list[int]]:
    """The least that the rows from each place on can cost, at the start and after it.

    A row that has to go or is truncated costs two at least, one of another role or a
    system row behind the start one; and of two neighbours of the same role, with nothing
    between them that can stay for free, one has to change.
    """
    later, start = [0] * (len(letters) + 1), [0] * (len(letters) + 1)
    single, spare = "", 0
    for i in range(len(letters) - 1, -1, -1):
        letter, least = letters[i], 0
        if letter == "x" or letter.isupper():
            least = DELETE
        elif letter in "so":
            least, single = REROLE, ""
            spare = 1 if letter == "s" else spare
        elif letter == single:
            least, single = REROLE, ""
        else:
            single = letter
        later[i] = later[i + 1] + least
        start[i] = later[i] - spare
    return start, later


def _greedy(letters: str, enter: int, leave: tuple[int, ...]) -> tuple[int, str] | None:
    """A first incumbent: keep what fits, rename what doesn't, close with inserted turns."""
    cost, audit, phase = 0, [], enter
    for letter in letters:
        if letter == "x" or letter.isupper():
            cost += DELETE
            audit.append("D")
        else:
            fits = letter in _TAKES[phase]
            cost += KEEP if fits else REROLE
            audit.append("K" if fits else "R")
            phase = _TAKES[phase][letter] if fits else _NEXT[phase]
    for _ in range(3):
        if phase in leave:
            return cost, "".join(audit)
        cost, phase = cost + INSERT, _NEXT[phase]
        audit.append("I")
    return None


@lru_cache(1 << 16)
def cheapest(letters: str, enter: int = EMPTY, leave: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits that lead from ``enter`` to one of ``leave``.

    Depth first over an explicit stack, in ASCII order of the edits. A prefix goes when its
    cost and the bound of the rest exceed the incumbent's cost, or equal it with a later
    audit, or when a prefix at the same row and phase was as good: at equal cost, no
    audit of the same rows is the start of another, so the lesser prefix always gives the
    lesser whole. What is left when the stack is empty is proved best. None if no edits
    lead there (a system row can't be inserted).
    """
    start, later = suffix_bounds(letters)
    best = _greedy(letters, enter, leave)
    dominance: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, enter, 0, "")]
    while stack:
        i, phase, cost, audit = stack.pop()
        if best is not None:
            least = cost + (start if phase == EMPTY else later)[i]
            if least > best[0] or least == best[0] and audit > best[1][: len(audit)]:
                continue
        held = dominance.get((i, phase))
        if held is not None and held <= (cost, audit):
            continue
        dominance[i, phase] = (cost, audit)
        if i == len(letters):
            if phase in leave and (best is None or (cost, audit) < best):
                best = (cost, audit)
        else:
            letter = letters[i]
            if letter != "x":
                stays = TRUNCATED if letter.isupper() else 0
                role = letter.lower()
                stack.append((i + 1, _NEXT[phase], cost + REROLE + stays, audit + "R"))
                if role in _TAKES[phase]:
                    stack.append((i + 1, _TAKES[phase][role], cost + KEEP + stays, audit + "K"))
        stack.append((i, _NEXT[phase], cost + INSERT, audit + "I"))
        if i < len(letters):
            stack.append((i + 1, phase, cost + DELETE, audit + "D"))
    return best


class _Chain:
    """An audit as the parts it was put together from."""

    __slots__ = ("before", "audit")

    def __init__(self, before: _Chain | None, audit: str):
        self.before, self.audit = before, audit

    def __str__(self) -> str:
        return "".join(self.back_to(None))

    def back_to(self, other: _Chain | None) -> list[str]:
        parts, at = [], self
        while at is not None and at is not other:
            parts.append(at.audit)
            at = at.before
        return parts[::-1]

    def __lt__(self, other: _Chain) -> bool:
        a, b = self, other
        while a is not b and a is not None:
            a, b = a.before, b.before
        return "".join(self.back_to(a)) < "".join(other.back_to(a))


def repair_plan(letters: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation, however long."""
    if len(letters) <= PART:
        return cheapest(letters)  # type: ignore[return-value]
    held: dict[int, tuple[int, _Chain | None]] = {EMPTY: (0, None)}
    for at in range(0, len(letters), PART):
        part, moved = letters[at : at + PART], {}
        for phase, (cost, audit) in held.items():
            for leave in range(4):
                found = cheapest(part, phase, (leave,))
                if found is None:
                    continue
                option = (cost + found[0], _Chain(audit, found[1]))
                if leave not in moved or option < moved[leave]:
                    moved[leave] = option
        held = moved
    cost, audit = min(held[end] for end in ENDS if end in held)
    return cost, str(audit)


def _rows(conversations: DataFrame, key: str) -> DataFrame:
    """The rows with nulls as one space, their faults but repetition, and a digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        F.col(key).alias("key"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"),
    )
    first = F.substring("role", 1, 1)
    return rows.withColumn(
        "digest", F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256))
    ).withColumn("initial", F.when(first.isin("u", "a", "s"), first).otherwise("o")).withColumn(
        "fault",
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z"), "truncated"),
    )


class _Conversation:
    """What a plan needs of a conversation: one letter a row, and counts."""

    def __init__(self) -> None:
        self.letters: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = None
        self.initial = ""

    def add(self, turn: int | None, digest: bytes, initial: str, fault: str | None) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        if self.initial and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        new, self.first = self.first == (turn, digest), None
        if fault == "blank":
            self.blank += 1
            self.letters.append("x")
        elif not new:
            self.duplicate += 1
            self.letters.append("x")
        elif fault == "truncated":
            self.truncated += 1
            self.letters.append(initial.upper())
        else:
            self.letters.append(initial)

    def plan(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        faults = (self.blank, self.duplicate, self.truncated, self.illegal)
        return (min(gaps, (1 << 63) - 1), *faults, *repair_plan("".join(self.letters)))


_PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _schema(frame: DataFrame, key: str, rest: str) -> T.StructType:
    return T.StructType([T.StructField(key, frame.schema["key"].dataType), *T._parse_datatype_string(rest)])


def repair_plans(conversations: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """Faults and cheapest edits of every conversation: a row for each ``key``.

    Rows go by ``turn``, nulls first, those of one turn by a digest of role and text. The
    first fault of a row counts: blank, duplicate (role and text were there before) or
    truncated. ``gaps``: turns missing between the least and the greatest; ``illegal``:
    neighbours whose roles don't follow one another; ``cost`` and ``audit``: the cheapest
    edits (D, I, K, R in order) to initials of the form ``(s?(ua)+)?``.

    Null roles and texts count as one space, an empty role as another role that can't be
    kept; a null key is a conversation of its own. An empty table gives an empty one,
    other columns are ignored. Where a text occurs first is found by an aggregate that
    tasks combine before the shuffle; a conversation then streams through its task, which
    keeps one letter a row, whatever the texts hold.
    """
    rows = _rows(conversations, key)
    order = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    firsts = (
        rows.where("fault IS DISTINCT FROM 'blank'").groupBy("key", "digest").agg(F.min(order).alias("at"))
        .select("key", F.col("at.turn").alias("turn"), "digest", F.lit(0).alias("kind"),
                F.lit(None).cast("string").alias("initial"), F.lit(None).cast("string").alias("fault"))
    )
    every = rows.select("key", "turn", "digest", F.lit(1).alias("kind"), "initial", "fault").union(firsts)
    names = [key, *(f.name for f in T._parse_datatype_string(_PLAN))]
    kinds = [None, *[pa.int64()] * 6, pa.string()]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done, kind = None, None, [], None

        def result() -> pa.RecordBatch:
            columns = zip(*done)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k or kind) for c, k in zip(columns, kinds)], names
            )

        for batch in batches:
            kind = batch.column("key").type
            for mine, turn, digest, what, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or mine != now:
                    if held is not None:
                        done.append((now, *held.plan()))
                    now, held = mine, _Conversation()
                if what == 0:
                    held.first = (turn, digest)
                else:
                    held.add(turn, digest, initial, fault)
            if len(done) >= _ROWS:
                yield result()
                done = []
        if held is not None:
            done.append((now, *held.plan()))
        if done:
            yield result()

    dealt = every.repartition("key").sortWithinPartitions("key", "turn", "digest", "kind")
    return dealt.mapInArrow(plan, _schema(rows, key, _PLAN))


_REPAIRED = "place long, edit string, role string, text string"


class _Editor:
    """Applies an audit to the rows of a conversation, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.phase = audit, 0, 0, EMPTY

    def _written(self, edit: str, role: str | None, text: str) -> tuple:
        kept = edit == "K" and role is not None and self.phase == EMPTY and role[:1] == "s"
        self.phase = SYSTEM if kept else _NEXT[self.phase]
        self.place += 1
        return self.place - 1, edit, role if edit == "K" else _ROLE[self.phase], text

    def inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._written("I", None, "")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            yield self._written(edit, role, text)


def repaired_rows(conversations: DataFrame, plans: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """The rows that ``plans`` (of the same rows) leave: key, place, edit, role, text.

    ``place`` counts from 0; inserted rows have an empty text, rows kept or given another
    role theirs. A conversation whose rows all go has none. Rows of a conversation lie in
    one task, in order. Plans and rows meet by a sort, each conversation's plan in front
    of its rows, so a task holds one plan and one batch, however long the conversation.
    """
    rows = _rows(conversations, key)
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("digest", "binary"), ("role", "string"))]
    both = rows.select("key", F.lit(1).alias("kind"), "turn", "digest", "role", "text").union(
        plans.select(F.col(key).alias("key"), F.lit(0), *nothing, F.col("audit").alias("text"))
    )
    names = [key, *(f.name for f in T._parse_datatype_string(_REPAIRED))]

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, editor, out, chars, kind = None, _Editor(""), [], 0, None

        def result() -> pa.RecordBatch:
            types = [kind, pa.int64(), *[pa.string()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            kind = batch.column("key").type
            columns = [batch.column(c).to_pylist() for c in ("key", "kind", "role", "text")]
            for mine, what, role, text in zip(*columns):
                if what == 0:
                    written = editor.inserted()
                    out.extend((now, *w) for w in written)
                    now, editor = mine, _Editor(text)
                    continue
                out.extend((now, *w) for w in editor.row(role, text))
                chars += len(text)
                if len(out) >= _ROWS or chars >= _CHARS:
                    if out:
                        yield result()
                    out, chars = [], 0
        out.extend((now, *w) for w in editor.inserted())
        if out:
            yield result()

    dealt = both.repartition("key").sortWithinPartitions("key", "kind", "turn", "digest")
    return dealt.mapInArrow(edit, _schema(rows, key, _REPAIRED))


def text_digests(rows: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """key and ``repaired_sha256`` over ``role:text`` of its rows, joined by line breaks.

    ``rows`` as ``repaired_rows`` gives them; the hash is carried from row to row.
    """
    schema = T.StructType([rows.schema[key], T.StructField("repaired_sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, kind = None, None, None

        def result(done: list) -> pa.RecordBatch:
            keys, digests = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(digests)], [key, "repaired_sha256"])

        for batch in batches:
            kind, done = batch.column(key).type, []
            for mine, role, text in zip(*(batch.column(c).to_pylist() for c in (key, "role", "text"))):
                if held is None or mine != now:
                    if held is not None:
                        done.append((now, held.hexdigest()))
                    now, held = mine, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    held.update(f"\n{role}:{text}".encode())
            if done:
                yield result(done)
        if held is not None:
            yield result([(now, held.hexdigest())])

    return rows.mapInArrow(digest, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that a checksum of conversation and turn names."""
    of = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat_ws(":", of[0], of[1]).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(fault == 4, "user").otherwise(of[2]).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(of[3], "[.!?]", "")).otherwise(of[3]).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"),
    )
    whole = F.struct("conv_id", "turn", "role", "text")
    return rows.select(F.explode(F.array_repeat(whole, F.col("times"))).alias("r")).select("r.*")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = damaged(given)
    plans = stored(repair_plans(rows), "plans")
    digests = text_digests(repaired_rows(rows, plans))
    ids = given.select(F.col("conv_id").alias("id")).distinct()
    same = F.col("id").eqNullSafe(F.col("conv_id"))
    planned = ids.join(plans, same, "left").drop("conv_id")
    out = planned.join(digests, same, "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _plus(state: str, cost: str, edit: str) -> str:
    return f"printf('%06d', CAST({state}[1:6] AS INT) + {cost}) || {state}[7:] || '{edit}'"


def _closed(states: list[str]) -> str:
    """SQL for the four states with turns inserted where that is cheaper."""
    user = f"least(n2, {', '.join(_plus(f'n{p}', '5', 'I') for p in (0, 1, 3))})"
    reached = ", ".join(f"{s} AS n{p}" for p, s in enumerate(states))
    return (
        f"SELECT k, i, n0 AS s0, n1 AS s1, n2 AS s2, least(n3, {_plus('n2', '5', 'I')}) AS s3 "
        f"FROM (SELECT k, i, n0, n1, {user} AS n2, n3 FROM (SELECT k, i, {reached} FROM step))"
    )


def _oracle() -> str:
    """The same repairs in DuckDB: row by row, the least cost and audit of every phase."""

    def kept(phase: int, initial: str) -> str:
        keep = _plus(f"s{phase}", "stays", "K")
        return f"CASE WHEN initial = '{initial}' AND NOT gone THEN {keep} END"

    def named(phase: int) -> str:
        return f"CASE WHEN NOT gone THEN {_plus(f's{phase}', 'stays + 1', 'R')} END"

    drop = [_plus(f"s{p}", "2", "D") for p in range(4)]
    user = ", ".join([drop[2], *[f"{kept(p, 'u')}, {named(p)}" for p in (0, 1, 3)]])
    moved = [drop[0], f"least({drop[1]}, {kept(0, 's')})", f"least({user})", f"least({drop[3]}, {kept(2, 'a')}, {named(2)})"]
    step = "(SELECT b.k, b.i + 1 AS i, s0, s1, s2, s3, initial, gone, stays FROM best b JOIN faults f ON f.k = b.k AND f.i = b.i + 1)"
    return f"""
WITH RECURSIVE crc AS (
    SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) r(i))
), given AS (
    SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, conv_id, turn, coalesce(role, ' ') AS role,
           coalesce(text, ' ') AS text,
           list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                          lambda c: ord(c)::BIGINT) AS name
    FROM conversations
), dealt AS (
    SELECT k, turn, role, text, xor(list_reduce(list_prepend(4294967295, name),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
    FROM given, crc
), damaged AS (
    SELECT k, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM dealt, (SELECT unnest([1, 2]) AS time) WHERE fault <> 0 AND (time = 1 OR fault = 3)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, digest) AS i, left(role, 1) AS initial
    FROM (SELECT *, unhex(sha256(length(role) || ':' || role || ':' || text)) AS digest FROM damaged)
), seen AS (
    SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
           row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again,
           NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS cut,
           lag(initial) OVER (PARTITION BY k ORDER BY i) || initial AS pair
    FROM placed
), faults AS (
    SELECT k, i, turn, role, text, initial, blank, again AND NOT blank AS duplicate,
           cut AND NOT blank AND NOT again AS truncated, pair,
           blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS stays
    FROM seen
), best AS (
    (WITH step AS (SELECT DISTINCT k, 0::BIGINT AS i FROM faults)
     {_closed(["'000000'", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR"])})
    UNION ALL
    (WITH step AS {step} {_closed(moved)})
), plans AS (
    SELECT k, least(s0, s3)[1:6]::BIGINT AS cost, least(s0, s3)[7:] AS audit
    FROM best QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1
), edits AS (
    SELECT k, j, audit[j] AS edit, sum((audit[j] <> 'I')::INT) OVER w AS i, sum((audit[j] <> 'D')::INT) OVER w AS q
    FROM (SELECT k, audit, unnest(range(1, length(audit) + 1)) AS j FROM plans)
    WINDOW w AS (PARTITION BY k ORDER BY j)
), written AS (
    SELECT e.k, e.j, q, edit, role, text, bool_or(q = 1 AND edit = 'K' AND initial = 's') OVER (PARTITION BY e.k) AS system
    FROM edits e LEFT JOIN faults f ON f.k = e.k AND f.i = e.i AND edit <> 'I' WHERE edit <> 'D'
), hashes AS (
    SELECT k, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (q - system::INT) % 2 = 1 THEN 'user'
                     ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j)) AS digest
    FROM written GROUP BY k
), counted AS (
    SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
           count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
           count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY k
)
SELECT conv_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))},
       coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM given) LEFT JOIN counted USING (k) LEFT JOIN plans USING (k) LEFT JOIN hashes USING (k)
"""


ORACLE = _oracle()
