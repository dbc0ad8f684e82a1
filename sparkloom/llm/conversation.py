"""Repair of conversation structure by a bidirectional graph of tight arcs.

A conversation is repaired to ``system`` at most once at its start and then pairs of
user and assistant.  A path through the graph of (row, last role kept) is a sequence of
edits: Keep 0, Rerole 1, Delete 2 (forced for blank and repeated rows), Insert 5, and 5
more for a truncated row that stays.  Forward and backward least costs tell which arcs
lie on a cheapest path (tight arcs); a walk over sets of nodes takes the least letter
that any tight arc out of the set has, which gives the ASCII-least of all cheapest edits.

Rows reach the graph as light rows (role, hash of the text, faults), sorted by ranges of
conversation and turn and cut into blocks of at most ``BLOCK`` rows, so no conversation
has to fit in a task: a block is a matrix of least costs between the four states; costs
up to a block and from its end are products of matrices over the conversation's blocks
(64 bytes of work a block); then each block is walked from each state that it may be
entered in, and a second pass over blocks picks the walk that is real.  Texts are
shuffled once, by conversation, and streamed in order into the digest, which is the one
step that is sequential for a conversation.

Defined results: null role and text, and null parts of the damage key, count as one
space; null conv_id is a conversation.  Rows of one turn come in order of role and then
hash of the text.  A role counts by its first character; an empty one adds no initial,
so it can be kept anywhere.  A conversation without rows gives zeros, an empty audit and
the digest of nothing; an empty table gives no row.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import parts, read, spread_join, stored

#: Light rows of a block at most.
BLOCK = 4096
#: Costs of edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing kept yet, last kept system, user, assistant; a path may end in these.
STATES, ENDS, FAR = 4, (0, 3), 1 << 60
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
AFTER = {"s": 1, "u": 2, "a": 3}
ROLES = {"u": "user", "a": "assistant"}
#: Words are runs of what is none of these; ends of sentences.
BLANKS, STOPS = r"[\x20\x09-\x0D]", "[.!?]"


# ---------------------------------------------------------------- rows


def damaged(rows: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text``, ``copies`` of conversations after the damage that
    crc32 of ``conv_id:turn`` modulo 20 chooses."""
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)  # noqa: E731
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text, role = part("text"), part("role")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, STOPS, "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    out = rows.select(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    return out.where("kind != 0").withColumn("copies", F.when(F.col("kind") == 3, 2).otherwise(1).cast("long")).drop("kind")


def _hash() -> Column:
    return F.md5(F.col("text").cast("binary"))


def light(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number ``n``: ``conv``, ``turn``, ``role``, ``hash``, ``blank``,
    ``truncated`` and ``again`` (role and text stand at an earlier turn)."""
    words = F.regexp_replace("text", BLANKS, "")
    of = rows.select(
        "conv", "turn", "role", _hash().alias("hash"), (words == "").alias("blank"), (~words.rlike(STOPS + r"\z")).alias("truncated"), "copies"
    ).groupBy("conv", "turn", "role", "hash").agg(F.first("blank").alias("blank"), F.first("truncated").alias("truncated"), F.sum("copies").alias("n"))  # fmt: skip
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))  # noqa: E731
    key = F.when(~F.col("blank"), F.md5(F.concat_ws(":", known("conv"), F.length("role"), "role", "hash").cast("binary")))
    of = stored(of, "rows").withColumn("key", key).withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    firsts = of.where("key is not null").groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("uses")).where("uses > 1")
    joined = spread_join(of, firsts, "key", "uses", "turn", how="left")
    return joined.withColumn("again", F.coalesce(F.col("place") > F.col("first"), F.lit(False))).drop("key", "place", "first", "uses")


# ---------------------------------------------------------------- graph


def arcs(initial: str, blank: bool, again: bool, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letter) of a row's edits, least letter first."""
    out = [(s, s, DELETE, "D") for s in range(STATES)]
    if blank or again:
        return out
    more = TRUNCATED if truncated else 0
    for s in range(STATES):
        if initial == "" or initial == NEXT[s] or (initial == "s" and s == 0):
            out.append((s, AFTER.get(initial, s), KEEP + more, "K"))
        out.append((s, AFTER[NEXT[s]], REROLE + more, "R"))
    return out


INSERTS = [(s, AFTER[NEXT[s]]) for s in range(STATES)]


def forth(costs: list[int]) -> list[int]:
    """Least costs from the start, with rows inserted after what ``costs`` has; two at most pay."""
    user = min(costs[2], costs[0] + INSERT, costs[1] + INSERT, costs[3] + INSERT)
    return [costs[0], costs[1], user, min(costs[3], user + INSERT)]


def back(costs: list[int]) -> list[int]:
    """Least costs to the end, with rows inserted before what ``costs`` has."""
    user = min(costs[2], costs[3] + INSERT)
    return [min(costs[0], user + INSERT), min(costs[1], user + INSERT), user, min(costs[3], user + INSERT)]


#: Least costs from each state when nothing follows.
END = back([0 if s in ENDS else FAR for s in range(STATES)])


class Block:
    """Rows of one conversation that follow each other: initials, faults as a bit set (1 blank,
    2 again, 4 truncated) and how often each row stands there; repeats are deleted."""

    def __init__(self, initials: list[str], faults: list[int], n: list[int]) -> None:
        self.steps = [[(a, b, c + DELETE * (k - 1), x) for a, b, c, x in arcs(i, bool(f & 1), bool(f & 2), bool(f & 4))] for i, f, k in zip(initials, faults, n)]
        self.repeats = [k - 1 for k in n]

    def _forward(self, costs: list[int]) -> list[list[int]]:
        """Costs in front of each row and behind the last one, inserts included but there."""
        layers = []
        for steps in self.steps:
            layers.append(forth(costs))
            costs = [FAR] * STATES
            for a, b, c, _ in steps:
                costs[b] = min(costs[b], layers[-1][a] + c)
        return [*layers, costs]

    def _backward(self, costs: list[int]) -> list[list[int]]:
        layers = [costs]
        for steps in reversed(self.steps):
            costs = [FAR] * STATES
            for a, b, c, _ in steps:
                costs[a] = min(costs[a], layers[-1][b] + c)
            layers.append(back(costs))
        return layers[::-1]

    def matrix(self) -> list[int]:
        """Least costs from each state in front of the block to each behind it, row by row."""
        return [min(FAR, c) for s in range(STATES) for c in self._forward([0 if x == s else FAR for x in range(STATES)])[-1]]

    def walks(self, ahead: list[int], behind: list[int], last: bool) -> list[tuple[int, str] | None]:
        """For each state that a cheapest path enters the block in: the state in which the least walk
        leaves it, and its letters.  ``ahead``: least costs from the start of the conversation,
        ``behind``: to its end, inserts included.  ``last``: the walk inserts behind the last row."""
        forward, backward = self._forward(ahead), self._backward(behind)
        forward[-1] = forth(forward[-1])
        best = min(f + b for f, b in zip(ahead, backward[0]))
        layers = len(self.steps) + last

        def walk(entry: int) -> tuple[int, str]:
            at, letters, i = {entry}, [], 0
            while i < layers:
                tight = [("I", b) for a, b in INSERTS if a in at and forward[i][a] + INSERT + backward[i][b] == best]
                if i < len(self.steps):
                    tight += [(x, b) for a, b, c, x in self.steps[i] if a in at and forward[i][a] + c + backward[i + 1][b] == best]
                if not tight:
                    break
                least = min(x for x, _ in tight)
                at = {b for x, b in tight if x == least}
                letters.append(least)
                if least != "I":
                    letters.append("D" * self.repeats[i])
                    i += 1
            return min(at), "".join(letters)

        return [walk(s) if ahead[s] + backward[0][s] == best else None for s in range(STATES)]


def replayed(state: int, audit: str, initials: list[str], n: list[int]):
    """For each row: letters up to its own and its repeats', roles inserted before it, and its new
    role (None deleted, "" kept); at last the same of what is inserted behind the rows."""
    at, before, begun = 0, [], 0
    for initial, k in zip(initials, n):
        while audit[at] == "I":
            before.append(ROLES[NEXT[state]])
            state, at = AFTER[NEXT[state]], at + 1
        letter, at = audit[at], at + k
        role = None if letter == "D" else ""
        if letter == "R":
            role, state = ROLES[NEXT[state]], AFTER[NEXT[state]]
        elif letter == "K":
            state = AFTER.get(initial, state)
        yield audit[begun:at], before, role
        before, begun = [], at
    while at < len(audit):
        before.append(ROLES[NEXT[state]])
        state, at = AFTER[NEXT[state]], at + 1
    yield audit[begun:], before, None


# ---------------------------------------------------------------- jobs


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows, schema: pa.Schema, size: int = 1000):
    """Rows as record batches."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _runs(rows, same):
    """Rows in runs of equal ``same``, one run in memory at a time."""
    held, key = [], None
    for r in rows:
        if held and same(r) != key:
            yield held
            held = []
        key = same(r)
        held.append(r)
    if held:
        yield held


def _mapped(df: DataFrame, rows, schema: str, size: int = 1000) -> DataFrame:
    """``rows``, a function from rows to rows, over every partition of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.mapInArrow(lambda batches: _batches(rows(_rows(batches)), arrow, size), schema)


def _blocks(rows: DataFrame, conv: str, turn: str) -> DataFrame:
    """Blocks in order of ``id`` by conversation, from light rows."""
    place = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("hash").asc()]
    faults = (F.col("blank").cast("int") + 2 * F.col("again").cast("int") + 4 * F.col("truncated").cast("int")).alias("faults")
    dealt = rows.repartitionByRange(parts(rows.sparkSession), *place).sortWithinPartitions(*place)

    def cut(rows):
        made = TaskContext.get().partitionId() << 32

        def block(held):
            nonlocal made
            made += 1
            turns, roles, hashes, faults, n = (list(c) for c in zip(*(r[1:] for r in held)))
            initials = [r[:1] for r in roles]
            bad = sum(k - 1 for k in n) + sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            return held[0][0], made, turns, roles, hashes, initials, faults, n, bad, Block(initials, faults, n).matrix()

        held: list = []
        for r in rows:
            if held and (r[0] != held[0][0] or len(held) == BLOCK):
                yield block(held)
                held = []
            held.append(r)
        if held:
            yield block(held)

    schema = f"conv {conv}, id long, turn array<{turn}>, role array<string>, hash array<string>, initials array<string>, faults array<int>, n array<long>, bad long, matrix array<long>"
    return _mapped(dealt.select("conv", "turn", "role", "hash", faults, "n"), cut, schema, 16)


def _by_conversation(df: DataFrame, *then: str | Column) -> DataFrame:
    return df.repartition(parts(df.sparkSession), "conv").sortWithinPartitions("conv", *then)


def _costs(blocks: DataFrame, conv: str) -> DataFrame:
    """For each block least costs up to it and from its end; whether it is its conversation's last;
    cost and illegal neighbours of the conversation."""

    def scanned(rows):
        for run in _runs(rows, lambda r: r[0]):
            ahead, behind, bad = [[0, FAR, FAR, FAR]], [END], 0
            for k, (_, _, first, last, inside, m) in enumerate(run):
                ahead.append([min(ahead[-1][a] + m[STATES * a + b] for a in range(STATES)) for b in range(STATES)])
                bad += inside + (k > 0 and run[k - 1][3] + first not in ("su", "ua", "au"))
            for *_, m in reversed(run[1:]):
                behind.append([min(m[STATES * a + b] + behind[-1][b] for b in range(STATES)) for a in range(STATES)])
            cost = min(a + b for a, b in zip(ahead[-1], END))
            for k, r in enumerate(run):
                yield r[0], r[1], ahead[k], back(behind[len(run) - 1 - k]), k == len(run) - 1, cost, bad

    edges = blocks.select("conv", "id", F.element_at("initials", 1).alias("first"), F.element_at("initials", -1).alias("last"), "bad", "matrix")
    return _mapped(_by_conversation(edges, "id"), scanned, f"conv {conv}, id long, ahead array<long>, behind array<long>, last boolean, cost long, illegal long")


def _audits(blocks: DataFrame, costs: DataFrame, conv: str) -> DataFrame:
    """For each block the state in which the least walk enters it, and its letters there."""

    def walked(rows):
        for c, i, initials, faults, n, ahead, behind, last in rows:
            found = Block(initials, faults, n).walks(ahead, behind, last)
            yield c, i, [w[0] if w else None for w in found], [w[1] if w else None for w in found]

    def chosen(rows):
        before, state = object(), 0
        for c, i, leaves, letters in rows:
            state = state if c == before else 0
            yield i, state, letters[state]
            before, state = c, leaves[state]

    both = blocks.select("id", "initials", "faults", "n").join(costs.select("conv", "id", "ahead", "behind", "last"), "id")
    walks = _mapped(both.select("conv", "id", "initials", "faults", "n", "ahead", "behind", "last"), walked, f"conv {conv}, id long, leaves array<int>, letters array<string>", 16)
    return _mapped(_by_conversation(walks, "id"), chosen, "id long, state int, audit string", 16)


def _repaired(blocks: DataFrame, audits: DataFrame, costs: DataFrame, rows: DataFrame, conv: str, turn: str) -> DataFrame:
    """``conv``, ``audit``, ``repaired_sha256``: edits of each row and texts meet in order."""

    def edits(rows):
        for c, turns, roles, hashes, initials, n, state, audit, last in rows:
            *found, (more, behind, _) = replayed(state, audit, initials, n)
            for k, (t, r, h, (letters, before, to)) in enumerate(zip(turns, roles, hashes, found)):
                end = last and k == len(found) - 1
                yield c, t, r, h, 0, letters + (more if end else ""), before, to, behind if end else [], None

    def digests(rows):
        conversation, audit, digest, empty, edit = None, [], None, True, None

        def put(role, text):
            nonlocal empty
            digest.update(("" if empty else "\n").encode() + f"{role}:".encode() + text.encode())
            empty = False

        for c, t, r, h, kind, letters, before, to, behind, text in rows:
            if digest is None or c != conversation:
                if digest is not None:
                    yield conversation, "".join(audit), digest.hexdigest()
                conversation, audit, digest, empty = c, [], hashlib.sha256(), True
            if kind == 0:
                audit.append(letters)
                for role in before:
                    put(role, "")
                edit = (t, r, h, to, behind)
                if to is None:
                    for role in behind:
                        put(role, "")
                    edit = None
            elif edit and edit[:3] == (t, r, h):  # the first copy's text; others are deleted
                put(edit[3] or r, text)
                for role in edit[4]:
                    put(role, "")
                edit = None
        if digest is not None:
            yield conversation, "".join(audit), digest.hexdigest()

    columns = f"conv {conv}, turn {turn}, role string, hash string, kind int, letters string, before array<string>, to string, behind array<string>, text string"
    both = blocks.select("conv", "turn", "role", "hash", "initials", "n", "id").join(audits, "id").join(costs.select("id", "last"), "id")
    changes = _mapped(both.select("conv", "turn", "role", "hash", "initials", "n", "state", "audit", "last"), edits, columns)
    none = F.lit(None)
    texts = rows.select("conv", "turn", "role", _hash().alias("hash"), F.lit(1).alias("kind"), none.cast("string").alias("letters"), none.cast("array<string>").alias("before"), none.cast("string").alias("to"), none.cast("array<string>").alias("behind"), "text")
    order = [F.col("turn").asc_nulls_first(), "role", "hash", "kind"]
    return _mapped(_by_conversation(changes.unionByName(texts), *order), digests, f"conv {conv}, audit string, repaired_sha256 string", 100)


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of ``conversations`` (conv_id, turn, role, text), damaged first."""
    ids = conversations.select("conv_id").distinct()
    rows = damaged(conversations)
    conv, turn = (conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    of = light(rows)
    blocks = stored(_blocks(of, conv, turn), "blocks")
    costs = stored(_costs(blocks, conv), "costs")
    repaired = _repaired(blocks, _audits(blocks, costs, conv), costs, rows, conv, turn)
    plain = ~F.col("blank") & ~F.col("again")
    number = lambda x, v: F.sum(F.when(x, v).otherwise(0))  # noqa: E731
    totals = of.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        number(F.col("blank"), F.col("n")).alias("blank"),
        number(~F.col("blank"), F.col("n") - plain.cast("long")).alias("duplicate"),
        number(plain & F.col("truncated"), F.lit(1)).alias("truncated"),
    )
    out, found = ids, [totals, costs.where("last").select("conv", "illegal", "cost"), repaired]
    for k, df in enumerate(found):
        df = df.withColumnRenamed("conv", f"conv{k}")
        out = out.join(df, out["conv_id"].eqNullSafe(df[f"conv{k}"]), "left")
    zero = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(read(spark, sf_dir, "conversations"))


def _sql() -> str:
    """The same by a recursive query: for each state the cheapest and then least edits so far, as
    a sortable string, with the rows kept."""
    far, roles = "9" * 12, {"u": "user", "a": "assistant"}

    def plus(x: str, cost: str, letter: str, line: str) -> str:
        return f"{{'k': lpad(((substr({x}.k, 1, 12))::BIGINT + {cost})::VARCHAR, 12, '0') || substr({x}.k, 13) || '{letter}', 'o': {x}.o || {line}}}"

    def least(*xs: str) -> str:
        return f"list_sort(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))[1]"

    def when(test: str, x: str) -> str:
        return f"CASE WHEN {test} THEN {x} END"

    ins = lambda x, r: plus(x, "5", "I", f"chr(10) || '{roles[r]}:'")  # noqa: E731
    kept = "chr(10) || role || ':' || text"
    edit = lambda x, test, to: [when(f"NOT gone AND {test}", plus(x, "late", "K", kept)), when("NOT gone", plus(x, "1 + late", "R", f"chr(10) || '{roles[to]}:' || text"))]  # noqa: E731
    stay = lambda x: [plus(x, "2", "D", "''"), when("NOT gone AND ini = ''", plus(x, "late", "K", kept))]  # noqa: E731
    return rf"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text
    FROM conversations
), bits AS (SELECT *, list_transform(range(8 * strlen(key)), lambda i: (ascii(key[i // 8 + 1])::BIGINT >> (i % 8)) & 1) AS b FROM keyed),
kinds AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 20 AS kind FROM bits
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds WHERE kind <> 0
), ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (
    SELECT c, turn, role, text, left(role, 1) AS ini, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS i
    FROM damaged JOIN ids ON damaged.conv_id IS NOT DISTINCT FROM ids.conv_id
), marked AS (
    SELECT *, regexp_replace(text, '[ 	-]', '', 'g') AS solid, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS seen,
        coalesce(lag(ini) OVER (PARTITION BY c ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS bad
    FROM numbered
), faulty AS (
    SELECT *, solid = '' AS blank, solid <> '' AND seen AS again, solid <> '' AND NOT seen AND right(solid, 1) NOT IN ('.', '!', '?') AS cut FROM marked
), ready AS (SELECT c, i, role, text, ini, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS late FROM faulty),
walk AS (
    SELECT c, 0::BIGINT AS i, {{'k': repeat('0', 12), 'o': ''}} AS x0, {{'k': '{far}', 'o': ''}} AS x1, {{'k': '{far}', 'o': ''}} AS x2, {{'k': '{far}', 'o': ''}} AS x3 FROM ids
    UNION ALL
    SELECT c, i, {least(*stay('x0'))}, {least(*stay('x1'), when("NOT gone AND ini = 's'", plus('x0', 'late', 'K', kept)))},
        {least(*stay('z2'), *edit('x0', "ini = 'u'", 'u'), *edit('x1', "ini = 'u'", 'u'), *edit('z3', "ini = 'u'", 'u'))}, {least(*stay('z3'), *edit('z2', "ini = 'a'", 'a'))}
    FROM (
        SELECT *, {least('x3', ins('z2', 'a'))} AS z3
        FROM (SELECT r.*, x0, x1, x3, {least('x2', ins('x0', 'u'), ins('x1', 'u'), ins('x3', 'u'))} AS z2 FROM walk w JOIN ready r ON r.c = w.c AND r.i = w.i + 1)
    )
), ended AS (
    SELECT c, {least('x0', 'x3', ins('z2', 'a'))} AS x
    FROM (SELECT c, x0, x3, {least('x2', ins('x0', 'u'), ins('x1', 'u'), ins('x3', 'u'))} AS z2 FROM (SELECT c, max_by(x0, i) AS x0, max_by(x1, i) AS x1, max_by(x2, i) AS x2, max_by(x3, i) AS x3 FROM walk GROUP BY c))
), totals AS (
    SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS again, count(*) FILTER (cut) AS cut, count(*) FILTER (bad) AS bad
    FROM faulty GROUP BY c
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(again, 0)::BIGINT AS duplicate, coalesce(cut, 0)::BIGINT AS truncated,
    coalesce(bad, 0)::BIGINT AS illegal, substr(x.k, 1, 12)::BIGINT AS cost, substr(x.k, 13) AS audit, sha256(substr(x.o, 2)) AS repaired_sha256
FROM ids JOIN ended USING (c) LEFT JOIN totals USING (c)
"""


OP11_SQL = _sql()
