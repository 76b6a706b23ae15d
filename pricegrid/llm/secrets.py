"""Secrets in texts, with multipart credentials linked by an interval join of their parts."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pricegrid.llm.common import sent_by_value

sent_by_value(__name__)

#: Code points between parts of one credential, at most: their scope, where no block holds them.
REACH = 300

#: Code points of a block (braces, or a section under a [name]) that is at most one scope.
BLOCK = 4_000

#: Bits a character that a bare token has at least to be a weak secret.
ENTROPY = 3.5

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "linked_id", "linked_secret", "linked_endpoint")


def either_case(words: str) -> str:
    """A pattern with each ASCII letter in either case; other letters that fold to it stay out."""
    return re.sub(r"(?<!\\)[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = re.compile("(" + either_case("password|passwd|secret|token|api_?key") + ")" + VALUE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]+")

BRACE = re.compile(r"[{}]")
SECTION = re.compile(r"^[ \t]*\[[^\[\]\n]{1,80}\][ \t]*$", re.M)

# Parts that mean little alone.
WEAK_ID = re.compile(
    "(?<![A-Za-z0-9])(" + either_case("user_?name|user_?id|user|login|account|client_?id|access_?key_?id|key_?id|e?mail") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})"""
)
WEAK_SECRET = re.compile("(?<![A-Za-z0-9])(" + either_case("pass|pwd|auth|credential|private_?key|access_?key|secret_?key") + ")" + VALUE)
BARE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(
    r"(?<![A-Za-z0-9])(?:[a-z][a-z0-9+]{1,9}://[A-Za-z0-9.-]+(?::[0-9]+)?|(?:"
    + either_case("endpoint|hostname|host|server|url")
    + r""")["']?\x20*[:=]\x20*["']?(?:[a-z][a-z0-9+]{1,9}://)?[A-Za-z0-9.-]+(?::[0-9]+)?)"""
)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the assignments, access identifiers and hexadecimal strings, by start, then kind."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def random_looking(token: str) -> bool:
    return (
        any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token) and entropy(token) >= ENTROPY
    )


class Intervals:
    """Spans of one role, to be joined with others by how far apart they are."""

    def __init__(self, spans):
        self.spans = sorted(set(spans))
        self.starts = [s for s, _ in self.spans]
        self.ends, self.which, far = [], [], (-1, -1)  # the largest end so far, and whose it is
        for i, (_, e) in enumerate(self.spans):
            far = max(far, (e, i))
            self.ends.append(far[0])
            self.which.append(far[1])

    def near(self, start: int, end: int, reach: int) -> tuple[int, int] | None:
        """The span that begins in reach after ``end``, or before it, and ends last, if it ends in reach of ``start``."""
        k = bisect_right(self.starts, end + reach) - 1
        return self.spans[self.which[k]] if k >= 0 and self.ends[k] >= start - reach else None

    def within(self, start: int, end: int, reach: int) -> list[tuple[int, int]]:
        """All spans that begin in reach after ``end``, or before it, and end in reach of ``start``."""
        low, high = bisect_left(self.ends, start - reach), bisect_right(self.starts, end + reach)
        return [x for x in self.spans[low:high] if x[1] >= start - reach]


class Blocks:
    """Blocks of a text that are a scope each: braces, the innermost ones; outside of braces, sections under a [name]."""

    def __init__(self, text: str, limit: int = BLOCK):
        marks, open_, blocks = [], [], []  # (position, block from there on), open blocks, [start, end]
        for m in BRACE.finditer(text):
            if m[0] == "{":
                open_.append(len(blocks))
                blocks.append([m.start(), None])
            elif open_:
                blocks[open_.pop()][1] = m.end()
            marks.append((m.start(), open_[-1] if open_ else None))
        self.places, self.at = [p for p, _ in marks], [b for _, b in marks]
        self.blocks, self.limit = blocks, limit
        self.sections = [m.start() for m in SECTION.finditer(text)]
        self.end = len(text)

    def of(self, place: int) -> tuple[int, int] | None:
        """The block that a place lies in, if it is closed and within the limit."""
        k = bisect_right(self.places, place) - 1
        block = self.at[k] if k >= 0 else None
        if block is not None:
            start, end = self.blocks[block]
        else:
            k = bisect_right(self.sections, place) - 1
            if k < 0:
                return None
            start, end = self.sections[k], (*self.sections[k + 1 : k + 2], self.end)[0]
        return (start, end) if end is not None and end - start <= self.limit else None


class Parts:
    """Spans of one role, found by distance or by the block that they share."""

    def __init__(self, spans, blocks: Blocks):
        self.joined, self.blocks, self.by_block = Intervals(spans), blocks, {}
        for span in self.joined.spans:
            if (block := blocks.of(span[0])) is not None:
                self.by_block.setdefault(block, []).append(span)

    def beside(self, span: tuple[int, int], reach: int) -> list[tuple[int, int]]:
        """All spans in one scope with ``span``, in order."""
        return sorted({*self.joined.within(*span, reach), *self.by_block.get(self.blocks.of(span[0]), ())})


Link = tuple[tuple[int, int] | None, tuple[int, int], tuple[int, int] | None]


def linked(text: str, base: list[tuple[int, str, int]], reach: int = REACH) -> tuple[list, list[Link]]:
    """Spans of weak parts that are reported, and all links: (identifier or None, secret, endpoint or None) as spans.

    Parts are identifiers, secrets and endpoints, strong ones being the base spans. Two parts are in one scope if at
    most ``reach`` code points lie between them or one block holds both (see ``Blocks``). A link is any identifier and
    secret in one scope with any endpoint in scope of both, or with none if there is none; and a secret with an
    endpoint in its scope that no identifier of the secret shares. Weak parts of links are reported. Parts that
    overlap a base span are that span.
    """
    strong_ids = [(s, e) for s, k, e in base if k == "access"]
    strong_secrets = [(s, e) for s, k, e in base if k != "access"]
    taken = Intervals([(s, e) for s, _, e in base])
    free = lambda s, e: taken.near(s, e - 1, 0) is None or taken.near(s + 1, e - 1, 0) is None
    weak_ids = [(m.start(), m.end()) for m in WEAK_ID.finditer(text) if free(*m.span())]
    weak_secrets = [(m.start(), m.end()) for m in WEAK_SECRET.finditer(text) if len(m[2]) >= 6 and free(*m.span())]
    inside = Intervals(weak_ids + weak_secrets)
    for m in BARE.finditer(text):
        s, e = m.span()
        if free(s, e) and inside.near(s + 1, e - 1, 0) is None and random_looking(m[0]):
            weak_secrets.append((s, e))
    if not (weak_secrets or strong_secrets):
        return [], []
    endpoints = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    links = links_between(strong_ids + weak_ids, strong_secrets + weak_secrets, endpoints, Blocks(text), reach)
    used = [set(part) for part in zip(*links)] or [set()] * 3
    roles = [("linked_id", weak_ids), ("linked_secret", weak_secrets), ("linked_endpoint", endpoints)]
    return [(s, kind, e) for (kind, weak), seen in zip(roles, used) for s, e in weak if (s, e) in seen], links


def links_between(ids, secrets, endpoints, blocks: Blocks, reach: int) -> list[Link]:
    """All links of ``linked``, by sorted starts: work grows with the parts and the links, not with pairs of parts."""
    ids, ends, out = Parts(ids, blocks), Parts(endpoints, blocks), []
    for secret in sorted(set(secrets)):
        near, shared = ends.beside(secret, reach), set()
        for one in ids.beside(secret, reach):
            both = sorted(set(near).intersection(ends.beside(one, reach))) if near else []
            shared.update(both)
            out += [(one, secret, e) for e in both] or [(one, secret, None)]
        out += [(None, secret, e) for e in near if e not in shared]
    return out


def told(links: list[Link]) -> str:
    """Links as ``identifier|secret|endpoint``, each start:end or empty, comma-joined."""
    return ",".join("|".join(f"{x[0]}:{x[1]}" if x else "" for x in link) for link in links)


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


ADDED = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_linked", T.LongType()),
        T.StructField("links", T.StringType()),
    ]
)


def found(text: str | None) -> tuple:
    text = text or ""
    base = base_spans(text)
    more, links = linked(text, base)
    every = sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))
    counts = Counter(k for _, k, _ in base)
    return (*(counts[k] for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(links), told(links))


def secrets(documents: DataFrame) -> DataFrame:
    """Every row of ``documents`` with the secrets in its whole text.

    Needs text; all columns stay, and n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (kind:start:end,
    in code points, by start, then kind), n_linked (credentials of several parts) and links (identifier|secret|endpoint,
    each start:end) are added; columns of these names are replaced. A null or empty text has none. Scopes lie within a
    text, so parts are joined where the text is: by their sorted starts and running largest ends, with no exchange of
    rows and no pairs beyond the reported ones.
    """
    rows = documents.drop(*ADDED.names)
    text, out = rows.columns.index("text"), T.StructType([*rows.schema.fields, *ADDED.fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[found(t.as_py()) for t in batch.column(text)])) or [()] * len(ADDED)
            types = [pa.string() if f.dataType == T.StringType() else pa.int64() for f in ADDED]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], out.names)

    return rows.mapInArrow(scan, out)
