"""Conversation structure repair: Wagner-Fischer alignment of turns to an alternating grammar.

A repaired conversation's role initials read ``(s?(ua)+)?``. Its target strings of one last symbol
are suffixes of each other, so one table of suffix costs holds the alignment to every feasible
length; cells outside Ukkonen's band of an incumbent's cost are never filled. The cheapest lengths
are traced back, least edit first, and their audits compared.

Rows are put in order once for the whole table and cut into segments of a fixed number of rows.
Conversations inside a segment are repaired there. Of one that crosses a border, each segment aligns
its piece for every pair of grammar states at its two ends, and a pass over the pieces joins them; so
a conversation of any length costs a task no more memory than a segment and its own audit. Among
audits of equal cost for the same rows none is a prefix of another (a longer one has more insertions),
so the least audit of a whole is made of least audits of its pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeline.llm.common import arrow_bounds, written

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Rows of one segment.
SEGMENT = 512
#: Beyond any cost.
NEVER = 1 << 60
BLANKS = r"[\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by the hash of their place; nulls are one space.

    crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes full stops,
    exclamation and question marks, 3 repeats the row, 4 makes its role ``user``.
    """
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    rows = conversations.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("_copy"),
    )
    return rows.drop("_copy")


class Piece:
    """Consecutive rows of one conversation: initials, what keeping costs, and which must go."""

    def __init__(self, initials: list[str], kept_cost: list[int], must_go: list[bool]):
        self.initials, self.kept_cost, self.must_go = initials, kept_cost, must_go
        self.n = len(initials)
        self.tables: dict[str, list[np.ndarray]] = {}

    def incumbent(self, expected: str) -> int:
        """Cost of a quick repair from ``expected``, with two insertions to spare for any end: rows
        that must go do, a missing turn is inserted, other roles are changed."""
        cost = 2 * INSERT
        for initial, kept, gone in zip(self.initials, self.kept_cost, self.must_go):
            if gone:
                cost += DELETE
                continue
            cost += kept
            if initial == expected:
                expected = "a" if expected == "u" else "u"
            elif initial in ROLES:
                cost += INSERT
            else:
                cost += REROLE
                expected = "a" if expected == "u" else "u"
        return cost

    def table(self, last: str) -> list[np.ndarray]:
        """``table[i][l]``: least cost to turn rows i.. into the last l symbols of a string ending in ``last``."""
        if last in self.tables:
            return self.tables[last]
        bound = max(self.incumbent("u"), self.incumbent("a"))
        more, fewer = bound // INSERT, bound // DELETE
        width = self.n + more + 1
        place = np.arange(width, dtype=np.int64)
        is_last = place % 2 == 1
        below = np.full(width, NEVER, dtype=np.int64)
        below[: more + 1] = INSERT * place[: more + 1]
        out = [below]
        for i in range(self.n - 1, -1, -1):
            rest = self.n - i
            lo, hi = max(0, rest - fewer), min(width, rest + more + 1)
            now = np.full(width, NEVER, dtype=np.int64)
            best = below[lo:hi] + DELETE
            if not self.must_go[i]:
                start = max(lo, 1)
                kept = self.kept_cost[i]
                fits = kept if self.initials[i] == last else kept + REROLE
                other = kept if self.initials[i] in ROLES and self.initials[i] != last else kept + REROLE
                step = below[start - 1 : hi - 1] + np.where(is_last[start:hi], fits, other)
                best[start - lo :] = np.minimum(best[start - lo :], step)
            now[lo:hi] = np.minimum(np.minimum.accumulate(best - INSERT * place[lo:hi]) + INSERT * place[lo:hi], NEVER)
            out.append(now)
            below = now
        out.reverse()
        self.tables[last] = out
        return out

    def traced(self, last: str, i: int, length: int) -> str:
        """The least audit among the cheapest from row i to the last ``length`` symbols."""
        table, audit = self.table(last), []
        while i < self.n or length:
            cost = table[i][length]
            if i < self.n and table[i + 1][length] + DELETE == cost:
                audit.append("D")
                i += 1
            elif length and table[i][length - 1] + INSERT == cost:
                audit.append("I")
                length -= 1
            else:
                symbol = last if length % 2 else ("u" if last == "a" else "a")
                audit.append("K" if self.initials[i] == symbol else "R")
                i, length = i + 1, length - 1
        return "".join(audit)

    def with_system(self, last: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """Costs, per length, of a leading ``s`` and then that many symbols; all rows of that table."""
        table = self.table(last)
        rows = [np.full(len(table[0]), NEVER, dtype=np.int64)]
        for i in range(self.n - 1, -1, -1):
            now = rows[-1] + DELETE
            if self.initials[i] == "s" and not self.must_go[i]:
                now = np.minimum(now, table[i + 1] + self.kept_cost[i])
            rows.append(np.minimum(now, NEVER))
        rows.reverse()
        return rows[0], rows

    def best(self, start: str, end: str) -> tuple[int, str] | None:
        """Cheapest (cost, least audit) between two grammar states, over all feasible lengths.

        E: nothing yet; S: a system turn; U: complete, a user may follow; A: an assistant must follow.
        """
        if start == end and start in "ES":
            return DELETE * self.n, "D" * self.n
        if end == "S":
            cost, audit = NEVER, ""
            for i in range(self.n):
                if self.initials[i] == "s" and not self.must_go[i]:
                    found = DELETE * (self.n - 1) + self.kept_cost[i], "D" * i + "K" + "D" * (self.n - 1 - i)
                    cost, audit = min((cost, audit), found) if audit else found
            return (cost, audit) if audit else None
        last = "a" if end == "U" else "u"
        # The first symbol follows from the start and the parity of the length.
        odd = (start == "A") == (end == "U")
        first = table_row = self.table(last)[0]
        lengths = np.arange(len(first))
        fits = (lengths % 2 == odd) & ((lengths > 0) | (start in "UA"))
        plain = np.where(fits, table_row, NEVER)
        cost = int(plain.min())
        led, led_rows = (None, None)
        if start == "E":
            led, led_rows = self.with_system(last)
            led = np.where(fits, led, NEVER)
            cost = min(cost, int(led.min()))
        if cost >= NEVER:
            return None
        audits = [self.traced(last, 0, int(n)) for n in np.flatnonzero(plain == cost)]
        if led is not None:
            for n in np.flatnonzero(led == cost):
                i = 0
                while i < self.n and led_rows[i + 1][n] + DELETE == led_rows[i][n]:
                    i += 1
                audits.append("D" * i + "K" + self.traced(last, i + 1, int(n)))
        return cost, min(audits)

    def whole(self) -> tuple[int, str]:
        """Cheapest repair of a whole conversation."""
        empty, full = self.best("E", "E"), self.best("E", "U")
        return min(empty, full) if full else empty


#: Grammar states a piece can lead from and to.
WAYS = ("EE", "ES", "EU", "EA", "SS", "SU", "SA", "UU", "UA", "AU", "AA")


def repaired_lines(audit: str, start: str, roles: list[str], texts: list[str]) -> list[str]:
    """``role:text`` of the turns that ``audit`` leaves or inserts."""
    expected, i, lines = ("a" if start == "A" else "u"), 0, []
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "I":
            lines.append(ROLES[expected] + ":")
        elif edit == "R":
            lines.append(f"{ROLES[expected]}:{texts[i]}")
            i += 1
        else:
            lines.append(f"{roles[i]}:{texts[i]}")
            i += 1
            if lines[-1][0] == "s":
                continue
        expected = "a" if expected == "u" else "u"
    return lines


def _segment(rows: pa.Table) -> Iterator[dict]:
    """One record for each conversation's piece in a segment; the inner pieces are whole conversations."""
    rows = rows.sort_by("ord")
    again = rows.column("again")[0].as_py()
    again = set(again or ())
    cols = {c: rows.column(c).to_pylist() for c in ("ord", "conv", "turn", "role", "text", "blank", "truncated")}
    convs, n = cols["conv"], rows.num_rows
    starts = [i for i in range(n) if not i or convs[i] != convs[i - 1]] + [n]
    for a, b in zip(starts, starts[1:]):
        part = a == 0 or b == n
        roles, texts = cols["role"][a:b], cols["text"][a:b]
        initials = [r[:1] for r in roles]
        blank = cols["blank"][a:b]
        dup = [not k and o in again for k, o in zip(blank, cols["ord"][a:b])]
        cut = [t and not k and not d for t, k, d in zip(cols["truncated"][a:b], blank, dup)]
        turns = [t for t in cols["turn"][a:b] if t is not None]
        piece = Piece(initials, [TRUNCATED * c for c in cut], [k or d for k, d in zip(blank, dup)])
        out = {
            "conv": convs[a], "ord": cols["ord"][a], "part": part, "blank": sum(blank), "duplicate": sum(dup), "truncated": sum(cut),
            "illegal": sum(x + y not in LEGAL for x, y in zip(initials, initials[1:])),
            "head": initials[0], "tail": initials[-1], "n_turns": len(set(turns)),
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
            "cost": None, "audit": None, "sha": None, "roles": None, "texts": None, "ways": None,
        }
        if part:
            ways = [(w, piece.best(*w)) for w in WAYS]
            out |= {"roles": roles, "texts": texts, "ways": [{"way": w, "cost": f[0], "audit": f[1]} for w, f in ways if f]}
        else:
            cost, audit = piece.whole()
            lines = "\n".join(repaired_lines(audit, "E", roles, texts))
            out |= {"cost": cost, "audit": audit, "sha": hashlib.sha256(lines.encode()).hexdigest()}
        yield out


class Joined:
    """Pieces of one conversation, taken in order: the best repair so far that ends in each state."""

    def __init__(self, piece: dict):
        self.conv = piece["conv"]
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "n_turns"), 0)
        self.low = self.high = self.tail = None
        self.settled: list[str] = []
        self.states = {"E": (0, "", hashlib.sha256())}

    def add(self, piece: dict) -> None:
        if self.tail is not None and self.tail + piece["head"] not in LEGAL:
            self.sums["illegal"] += 1
        self.tail = piece["tail"]
        for name in self.sums:
            self.sums[name] += piece[name]
        if piece["low"] is not None:
            if piece["low"] == self.high:
                self.sums["n_turns"] -= 1
            self.low = piece["low"] if self.low is None else self.low
            self.high = piece["high"]
        best: dict[str, tuple[int, str, str, str]] = {}
        for found in piece["ways"]:
            start, end = found["way"]
            if start in self.states:
                cost, audit, _ = self.states[start]
                option = (cost + found["cost"], audit + found["audit"], start, found["audit"])
                best[end] = min(best.get(end, option), option)
        states = {}
        for end, (cost, audit, start, own) in best.items():
            digest = self.states[start][2].copy()
            lines = repaired_lines(own, start, piece["roles"], piece["texts"])
            if lines:
                digest.update(("\n" * (start != "E") + "\n".join(lines)).encode())
            states[end] = (cost, audit, digest)
        # What all states share is decided; only the rest is compared further on.
        shared = commonprefix([audit for _, audit, _ in states.values()])
        self.settled.append(shared)
        self.states = {end: (cost, audit[len(shared):], digest) for end, (cost, audit, digest) in states.items()}

    def result(self) -> dict:
        cost, audit, digest = min((self.states[e] for e in "EU" if e in self.states), key=lambda s: s[:2])
        return {
            "conv": self.conv, "gaps": self.high - self.low + 1 - self.sums["n_turns"] if self.high is not None else 0,
            **{k: v for k, v in self.sums.items() if k != "n_turns"},
            "cost": cost, "audit": "".join(self.settled) + audit, "sha": digest.hexdigest(),
        }


def repair(rows: DataFrame, every: DataFrame | None = None, segment: int = SEGMENT) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role and text; other columns are not looked at. A conversation's rows
    are taken by turn (nulls first), rows of one turn by role and then by a digest of the text. Null
    roles and texts are one space, and so a blank text; a null conv_id is a conversation of its own.
    Keeping costs 0, changing the role 3, deleting 4 (a must for blank and repeated rows), inserting 3,
    and a truncated row that stays 3 more. An empty role fits no symbol, so its row is not kept as it
    is. ``every`` (conv_id) names conversations to return even without rows: zeros, an empty audit and
    the digest of the empty text. ``segment`` must be a power of two.
    """
    if segment & (segment - 1):
        raise ValueError("segment must be a power of two")
    spark = rows.sparkSession
    arrow_bounds(spark)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    conv = F.col("conv_id")
    same = F.concat_ws("\n", F.when(conv.isNull(), "").otherwise(F.concat(F.lit("="), conv.cast("string"))), F.char_length(role).cast("string"), role, text)
    flat = rows.select(
        conv.alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.unhex(F.sha2(same.cast("binary"), 256)).alias("key"),
        F.monotonically_increasing_id().alias("salt"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~text.rlike(rf"[.!?]{BLANKS}*\z")).alias("truncated"),
    )
    order = ["conv", "turn", "role", "key", "salt"]
    ordered = flat.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    # Partition number and place in it: increasing over the whole order.
    ordered = written(ordered.withColumn("ord", F.monotonically_increasing_id()), "repair-rows")
    cut = F.shiftright("ord", segment.bit_length() - 1).alias("seg")
    first = ordered.groupBy("key").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = ordered.select("key", "ord").join(first, "key").where("ord <> first")
    again = again.groupBy(cut).agg(F.collect_list("ord").alias("again"))
    kind = ordered.schema["conv"].dataType.simpleString()
    counts = "blank long, duplicate long, truncated long, illegal long"
    schema = (
        f"conv {kind}, ord long, part boolean, {counts}, head string, tail string, n_turns long, low long, high long, "
        "cost long, audit string, sha string, roles array<string>, texts array<string>, "
        "ways array<struct<way:string,cost:long,audit:string>>"
    )
    arrow = spark.createDataFrame([], schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    piece_schema = to_arrow_schema(arrow.schema)

    def align(rows: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(_segment(rows)), piece_schema)

    pieces = ordered.select("*", cut).join(again, "seg", "left").groupBy("seg").applyInArrow(align, schema)
    pieces = written(pieces, "repair-pieces")
    result = f"conv {kind}, gaps long, {counts}, cost long, audit string, sha string"
    result_schema = to_arrow_schema(spark.createDataFrame([], result).schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Joined | None = None
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                piece = batch.slice(i, 1).to_pylist()[0]
                if now is None or piece["conv"] != now.conv:
                    if now is not None:
                        done.append(now.result())
                    now = Joined(piece)
                now.add(piece)
            if done:
                yield pa.RecordBatch.from_pylist(done, result_schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result()], result_schema)

    crossing = pieces.where("part").drop("part", "cost", "audit", "sha").repartition("conv").sortWithinPartitions("conv", "ord")
    crossing = crossing.mapInArrow(join, result)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    inner = pieces.where("NOT part").select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha")
    found = inner.unionByName(crossing).withColumnsRenamed({"conv": "conv_id", "sha": "repaired_sha256"})
    if every is None:
        return found
    ids = every.select(F.col("conv_id").alias("_id")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(found, ids["_id"].eqNullSafe(found["conv_id"]), "left").select(
        F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


#: The same by a table of grammar states, row by row: per state the least (cost, audit, text). Two
#: insertions in a row between turns suffice, as a third would bring back an earlier state.
ORACLE = r"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
bits AS (SELECT 0 AS k UNION ALL SELECT k + 1 FROM bits WHERE k < 255),
crc0 AS (
  SELECT k, k::UBIGINT AS v, 0 AS i FROM bits UNION ALL
  SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, i + 1 FROM crc0 WHERE i < 8),
crc_table AS (SELECT list(v ORDER BY k) AS t FROM crc0 WHERE i = 8),
keys AS (SELECT DISTINCT key FROM hashed),
digest AS (
  SELECT key, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::UBIGINT)),
    lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 20 AS fault
  FROM keys, crc_table),
faulty AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed JOIN digest USING (key)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM faulty),
marked AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS pair FROM ordered),
turns AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS c, i, role, text, blank OR seen AS must_go,
         CASE WHEN cut AND NOT blank AND NOT seen THEN 3 ELSE 0 END AS kept FROM marked),
sizes AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
gaps_between AS (SELECT * FROM (VALUES
  ('E', 'E', 0, '', ''), ('S', 'S', 0, '', ''), ('U', 'U', 0, '', ''), ('A', 'A', 0, '', ''),
  ('E', 'A', 3, 'I', 'user:'), ('S', 'A', 3, 'I', 'user:'), ('U', 'A', 3, 'I', 'user:'), ('A', 'U', 3, 'I', 'assistant:'),
  ('E', 'U', 6, 'II', 'user:' || chr(10) || 'assistant:'), ('S', 'U', 6, 'II', 'user:' || chr(10) || 'assistant:')) v(a, b, cost, audit, lines)),
steps AS (
  SELECT c, i, s.state AS a, s.state AS b, 4 AS cost, 'D' AS audit, '' AS line, FALSE AS says
  FROM turns, (VALUES ('E'), ('S'), ('U'), ('A')) s(state)
  UNION ALL
  SELECT c, i, m.a, m.b, kept + CASE WHEN role[1:1] = m.x THEN 0 ELSE 3 END, CASE WHEN role[1:1] = m.x THEN 'K' ELSE 'R' END,
         CASE WHEN role[1:1] = m.x THEN role WHEN m.x = 'u' THEN 'user' ELSE 'assistant' END || ':' || text, TRUE
  FROM turns, (VALUES ('E', 'S', 's'), ('E', 'A', 'u'), ('S', 'A', 'u'), ('U', 'A', 'u'), ('A', 'U', 'a')) m(a, b, x)
  WHERE NOT must_go AND (m.x <> 's' OR role[1:1] = 's')),
walk AS (
  SELECT c, 0::BIGINT AS i, 'E' AS state, 0 AS cost, '' AS audit, '' AS said FROM sizes
  UNION ALL
  SELECT c, i, state, best.cost, best.audit, best.said FROM (
    SELECT c, i, state, min({'cost': cost, 'audit': audit, 'said': said}) AS best FROM (
      SELECT w.c, w.i + 1 AS i, t.b AS state, w.cost + g.cost + t.cost AS cost, w.audit || g.audit || t.audit AS audit,
             w.said || CASE WHEN w.said <> '' AND g.lines <> '' THEN chr(10) ELSE '' END || g.lines
             || CASE WHEN (w.said <> '' OR g.lines <> '') AND t.says THEN chr(10) ELSE '' END || t.line AS said
      FROM walk w JOIN gaps_between g ON g.a = w.state JOIN steps t ON t.c = w.c AND t.i = w.i + 1 AND t.a = g.b)
    GROUP BY c, i, state)),
ends AS (
  SELECT c, min({'cost': cost, 'audit': audit, 'said': said}) AS best FROM (
    SELECT w.c, w.cost + g.cost AS cost, w.audit || g.audit AS audit,
           w.said || CASE WHEN w.said <> '' AND g.lines <> '' THEN chr(10) ELSE '' END || g.lines AS said
    FROM walk w JOIN sizes z ON z.c = w.c AND z.n = w.i JOIN gaps_between g ON g.a = w.state WHERE g.b IN ('E', 'U'))
  GROUP BY c),
counts AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate,
         count(*) FILTER (cut AND NOT blank AND NOT seen) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(best.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS c FROM conversations) o LEFT JOIN counts USING (c) LEFT JOIN ends USING (c)
"""
