"""Repair of conversations: cheapest edits to a regular alternation of roles, by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricegrid.llm.common import sent_by_value

sent_by_value(__name__)

#: Costs of edits, and what a truncated row adds unless it is deleted.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5

#: Role initials accept ``(s?(ua)+)?``: start, after s, after u, after a. Missing initials lead nowhere.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {
    START: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
ACCEPTS = (START, ASSISTANT)
NAMES = {"u": "user", "a": "assistant"}

SOUND, BLANK, DUPLICATE, CUT = range(4)


#: States of the coarser automaton that lower bounds are exact in.
_COARSE = {START: 0, SYSTEM: 1, ASSISTANT: 1, USER: 2}


def _lower_bounds(rows: list[tuple[str, int]]) -> list[tuple[int, int, int]]:
    """For each row, what it and all later ones cost at least: at the start, where a user is awaited, where an assistant.

    The bound is the exact cost in a coarser automaton: after s is one state with after a, and any state may end.
    What is cheaper there cannot be dearer in the true one, so the bound never says too much.
    """
    at = (0, 0, 0)
    bounds = [at]
    for initial, fault in reversed(rows):
        start, user, assistant = at
        if fault in (BLANK, DUPLICATE):
            at = (start + DELETE, user + DELETE, assistant + DELETE)
        else:
            more = TRUNCATED if fault == CUT else 0
            as_user = assistant + more + (KEEP if initial == "u" else REROLE)
            as_assistant = user + more + (KEEP if initial == "a" else REROLE)
            stays = more if initial == "" else DELETE
            leads = user + more if initial == "s" else as_user
            at = (
                min(start + min(DELETE, stays), as_user, leads),
                min(user + min(DELETE, stays), as_user),
                min(assistant + min(DELETE, stays), as_assistant),
            )
        start, user, assistant = at
        at = (min(start, assistant + INSERT), min(user, assistant + INSERT), min(assistant, user + INSERT))
        bounds.append(at)
    return bounds[::-1]


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of ``rows`` (role initial, first fault), the ASCII-least of these.

    Iterative-deepening A*. A depth-first search tries edits in ASCII order (D, I, K, R) and cuts a path whose cost and
    lower bound exceed the limit, which starts at the bound of the whole and rises to the least sum that was cut. So
    the first path that ends in an accepting state has the least cost, and of these the first audit. A state that
    failed (row, automaton state) is kept with what it was found to cost at least; that stays true as the limit rises,
    so it is entered again only with more to spend. Empty rows: 0 and an empty audit.
    """
    n = len(rows)
    bounds = _lower_bounds(rows)
    failed: dict[int, int] = {}  # row * 4 + state: what it costs at least to finish from there

    def least(i: int, state: int) -> int:
        known = failed.get(i * 4 + state)
        return bounds[i][_COARSE[state]] if known is None else known

    def edits(i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(initial of the edit, cost, next row, next state) in ASCII order."""
        follow, out = NEXT[state], []
        if i < n:
            out.append(("D", DELETE, i + 1, state))
        out += [("I", INSERT, i, follow[r]) for r in ("a", "u") if r in follow]
        if i < n and rows[i][1] not in (BLANK, DUPLICATE):
            initial, more = rows[i][0], TRUNCATED if rows[i][1] == CUT else 0
            if initial == "":
                out.append(("K", KEEP + more, i + 1, state))
            elif initial in follow:
                out.append(("K", KEEP + more, i + 1, follow[initial]))
            out += [("R", REROLE + more, i + 1, follow[r]) for r in ("a", "u") if r in follow]
        return out

    limit = least(0, START)
    while True:
        path: list[str] = []
        # Frames: row, state, cost so far, edits left to try, least cost to finish seen among edits that failed.
        stack = [[0, START, 0, iter(edits(0, START)), 1 << 60]]
        if n == 0:
            return 0, ""
        while stack:
            i, state, cost, left, finish = frame = stack[-1]
            for edit, price, row, then in left:
                rest = least(row, then)
                if cost + price + rest > limit:
                    frame[4] = min(frame[4], price + rest)
                    continue
                path.append(edit)
                if row == n and then in ACCEPTS:
                    return cost + price, "".join(path)
                stack.append([row, then, cost + price, iter(edits(row, then)), 1 << 60])
                break
            else:
                failed[i * 4 + state] = max(least(i, state), frame[4])
                stack.pop()
                if stack:
                    edit = path.pop()
                    price = {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[edit]
                    above = stack[-1]
                    if edit in "KR" and rows[above[0]][1] == CUT:
                        price += TRUNCATED
                    above[4] = min(above[4], price + failed[i * 4 + state])
        limit = least(0, START)


@dataclass
class _Conversation:
    """What is held of a conversation: a few bytes for each of its rows; texts pass by."""

    conv_id: int | None
    rows: list[tuple[str, int]] = field(default_factory=list)
    seen: set[bytes] = field(default_factory=set)
    turns: int = 0
    first: int | None = None
    last: int | None = None
    illegal: int = 0
    cost: int = 0
    audit: str | None = None
    at: int = 0  # edits done while texts pass
    before: str = ""  # role initial of the last repaired row
    hash: object = field(default_factory=hashlib.sha256)
    some: bool = False

    def see(self, turn: int | None, role: str, digest: bytes, blank: bool, cut: bool) -> None:
        fault = BLANK if blank else DUPLICATE if digest in self.seen else CUT if cut else SOUND
        self.seen.add(digest)
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        initial = role[:1]
        if self.rows and self.rows[-1][0] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.rows.append((initial, fault))

    def decide(self) -> None:
        self.cost, self.audit = cheapest(self.rows)

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.some else "") + role + ":" + text).encode())
        self.before, self.some = role[:1] or self.before, True

    def awaited(self) -> str:
        return NAMES["a" if self.before == "u" else "u"]

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.put(self.awaited(), "")
            self.at += 1

    def text(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.put(role if edit == "K" else self.awaited(), text)

    def result(self) -> tuple:
        if self.audit is None:
            self.decide()
        self.inserts()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        faults = [sum(f == k for _, f in self.rows) for k in (BLANK, DUPLICATE, CUT)]
        return (self.conv_id, gaps, *faults, self.illegal, self.cost, self.audit, self.hash.hexdigest())


RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)
_TYPES = [*[pa.int64()] * 7, pa.string(), pa.string()]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times of every row of ``rows`` (conv_id, turn, role, text) after damage.

    A null counts as one space, in what is hashed as in role and text; ``turn`` keeps its nulls, for the order. The
    damage hangs on crc32 of ``conv_id:turn`` modulo 20: 0 drops the row (``times`` 0), 1 empties its text, 2 removes
    its ``.!?``, 3 repeats it (``times`` 2), 4 sets its role to user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("_kind"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, F.lit(""))
        .when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).alias("times"),
    )


def repaired(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text, times): its faults, cheapest edits and their hash.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. ``times`` says how often
    a row is there; a conversation with none left has zeros, an empty audit and the hash of nothing. Rows are taken by
    turn, nulls first, and rows of one turn by a digest of role and text, so that repeated ones are adjacent. A row
    without a role (null: one space) has an initial that no state accepts, an empty role has none and leaves the state
    as it is. Rows of a null conv_id are one conversation. Other columns are ignored; an empty table gives an empty result.

    Each conversation passes a task twice in one sort: first its rows without texts, from which the edits are searched,
    then the texts, which are hashed one at a time. So a task holds a few bytes a row of one conversation, and its
    texts stay in Spark's sort, which spills; the search and the hash of one conversation are sequential as defined.
    """
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    cut = ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    facts = rows.select("conv_id", "turn", "role", "text", "times", blank.alias("blank"), cut.alias("cut"), digest.alias("digest"))
    # One exchange: a row goes out twice, without its text first. A row that is dropped still names its conversation.
    passes = F.explode(F.when(F.col("times") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    facts = facts.select("*", passes.alias("pass"))
    text = F.when(F.col("pass") == 1, F.col("text"))
    columns = ["conv_id", "pass", "turn", "digest", "role", "blank", "cut", "times"]
    dealt = facts.select(*columns, text.alias("text")).repartition("conv_id").sortWithinPartitions(*columns[:4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: _Conversation | None = None
        for batch in batches:
            out = []
            for conv_id, again, turn, digest, role, blank, cut, times, text in zip(*[c.to_pylist() for c in batch.columns]):
                if here is None or here.conv_id != conv_id:
                    if here is not None:
                        out.append(here.result())
                    here = _Conversation(conv_id)
                if again and here.audit is None:
                    here.decide()
                for _ in range(times):
                    here.text(role, text) if again else here.see(turn, role, digest, blank, cut)
            yield _batch(out)
        if here is not None:
            yield _batch([here.result()])

    return dealt.mapInArrow(run, RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names)


ORACLE = r"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
           lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                 lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE r END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed),
placed AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS e, left(lag(role) OVER w, 1) || left(role, 1) AS pair,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'sound' END AS fault
  FROM placed),
follow(q, e, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
conversation AS (SELECT conv_id, count(i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN judged USING (conv_id) GROUP BY conv_id),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit FROM conversation
  UNION ALL
  SELECT conv_id, i, q, cost, audit FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) AS place FROM (
      SELECT s.conv_id, j.i, s.q, s.cost + 2 AS cost, s.audit || 'D' AS audit
      FROM (SELECT b.*, 0 AS inserts FROM best b
            UNION ALL SELECT b.conv_id, b.i, f.q2, b.cost + 5, b.audit || 'I', 1 FROM best b JOIN follow f ON f.q = b.q AND f.e <> 's'
            UNION ALL SELECT b.conv_id, b.i, g.q2, b.cost + 10, b.audit || 'II', 2 FROM best b JOIN follow f ON f.q = b.q AND f.e <> 's'
                      JOIN follow g ON g.q = f.q2 AND g.e <> 's') s
      JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i + 1
      UNION ALL
      SELECT s.conv_id, j.i, f.q2, s.cost + CASE WHEN m.edit = 'R' THEN 1 ELSE 0 END + CASE WHEN j.fault = 'truncated' THEN 5 ELSE 0 END,
             s.audit || m.edit
      FROM (SELECT b.*, 0 AS inserts FROM best b
            UNION ALL SELECT b.conv_id, b.i, f.q2, b.cost + 5, b.audit || 'I', 1 FROM best b JOIN follow f ON f.q = b.q AND f.e <> 's'
            UNION ALL SELECT b.conv_id, b.i, g.q2, b.cost + 10, b.audit || 'II', 2 FROM best b JOIN follow f ON f.q = b.q AND f.e <> 's'
                      JOIN follow g ON g.q = f.q2 AND g.e <> 's') s
      JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i + 1 AND j.fault IN ('sound', 'truncated')
      JOIN follow f ON f.q = s.q
      JOIN (VALUES ('K'), ('R')) m(edit) ON (m.edit = 'K' AND j.e = f.e) OR (m.edit = 'R' AND f.e <> 's')))
  WHERE place = 1),
ended AS (
  SELECT b.conv_id, b.q, b.cost, b.audit FROM best b JOIN conversation c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i
  UNION ALL
  SELECT b.conv_id, f.q2, b.cost + 5, b.audit || 'I' FROM best b JOIN follow f ON f.q = b.q AND f.e <> 's'
  JOIN conversation c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i
  UNION ALL
  SELECT b.conv_id, g.q2, b.cost + 10, b.audit || 'II' FROM best b JOIN follow f ON f.q = b.q AND f.e <> 's'
  JOIN follow g ON g.q = f.q2 AND g.e <> 's' JOIN conversation c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i),
chosen AS (
  SELECT conv_id, cost, audit FROM ended WHERE q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
edits AS (
  SELECT conv_id, k, audit[k] AS edit, length(replace(left(audit, k), 'I', '')) AS i, length(replace(left(audit, k), 'D', '')) AS o
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM chosen)),
lines AS (
  SELECT d.conv_id, d.k, d.o, d.edit, j.role, CASE WHEN d.edit = 'I' THEN '' ELSE j.text END AS text
  FROM edits d LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM d.conv_id AND j.i = d.i AND d.edit <> 'I' WHERE d.edit <> 'D'),
led AS (SELECT conv_id, max(CASE WHEN o = 1 AND edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) AS s FROM lines GROUP BY conv_id),
repaired AS (
  SELECT l.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS lines
  FROM lines l JOIN led ON led.conv_id IS NOT DISTINCT FROM l.conv_id GROUP BY l.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT c.conv_id, coalesce(x.gaps, 0)::BIGINT AS gaps, coalesce(x.blank, 0)::BIGINT AS blank, coalesce(x.duplicate, 0)::BIGINT AS duplicate,
       coalesce(x.truncated, 0)::BIGINT AS truncated, coalesce(x.illegal, 0)::BIGINT AS illegal, h.cost::BIGINT AS cost, h.audit,
       sha256(coalesce(r.lines, '')) AS repaired_sha256
FROM conversation c JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN counts x ON x.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
