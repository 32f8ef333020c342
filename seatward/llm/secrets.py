"""Secret scans: patterns per kind, then links between the parts of one credential.

Assignments, access identifiers and long hex runs are reported by themselves. Weak candidates (a mixed token that only might be a
secret, a named client identifier, an endpoint) are reported only where parts that belong together stand in one scope: a paragraph, or
paragraphs that braces enclose or that meet in key-value lines. Spans are joined as intervals sorted by start, by bisection, so a text with many parts costs
no product of them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatward.llm.common import documents, packed, query, unpacked
from seatward.llm.texts import each, map_texts

# Fixed patterns of the base kinds; letters of the names match in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_VALUE, MIN_ACCESS = 8, 16
NAMES = ("passw", "secret", "token", "api")

# Weak parts.
CLIENT = re.compile(r"""(?:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{4,})""", re.I | re.A)
MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}", re.A)
ENDPOINT = re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,30}://[^\s\"'<>]+", re.A)
KINDS = ("assign", "access", "hex", "client", "mixed", "endpoint")
# What ``scan`` takes by itself; tables are scanned without a distance, so that the scope alone decides.
DISTANCE = 400
BLANK = re.compile(r"\n[ \t]*\n\s*")
PAIR = re.compile(r"""[ \t]*(?:[-,{][ \t]*|export[ \t]+)?["']?[A-Za-z_][\w.-]*["']?[ \t]*[:=](?!//)""", re.A)

SCHEMA = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string,"
    " found array<struct<kind:string,first:int,last:int,linked_to:int>>"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, kinds as numbers in their listed order, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # A greedy run of hex digits is taken whole; shorter runs fail, so the pattern asks for the length at once.
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _scopes(text: str) -> list[int]:
    """Starts of the scopes: paragraphs are what blank lines separate, but for blank lines between key-value lines or inside a pair of braces."""
    blanks = list(BLANK.finditer(text))
    if not blanks:
        return [0]
    pairs, opened = [], []
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            opened.append(m.start())
        elif opened:
            pairs.append((opened.pop(), m.start()))
    pairs.sort()
    begins, ends, top = [p[0] for p in pairs], [], 0
    for _, end in pairs:
        top = max(top, end)
        ends.append(top)
    out = [0]
    for m in blanks:
        i = bisect_right(begins, m.start()) - 1
        enclosed = i >= 0 and ends[i] > m.start()
        if not enclosed and not (PAIR.match(text, text.rfind("\n", 0, m.start()) + 1, m.start()) and PAIR.match(text, m.end())):
            out.append(m.end())
    return out


class Parts:
    """Spans of one role, found by nearness within a scope."""

    def __init__(self, spans: list[tuple[int, int, int]], scopes: list[int]):
        self.spans, self.scopes = sorted(spans), scopes
        self.starts = [s[0] for s in self.spans]
        # Ends grow with starts but for nesting; their running maximum keeps the bisection right.
        self.ends, top = [], 0
        for s in self.spans:
            top = max(top, s[2])
            self.ends.append(top)

    def near(self, span: tuple[int, int, int], distance: int | None):
        """A span of this role in the scope of ``span``, and within the distance if there is one, not overlapping it; the nearest by start."""
        at = bisect_right(self.scopes, span[0]) - 1
        first = self.scopes[at]
        end = self.scopes[at + 1] if at + 1 < len(self.scopes) else None
        i = bisect_right(self.starts, span[0]) - 1
        while i >= 0 and self.starts[i] >= first and self.spans[i][2] > span[0]:
            i -= 1
        j = bisect_left(self.starts, span[2])
        best = []
        if i >= 0 and self.starts[i] >= first and (distance is None or self.spans[i][2] >= span[0] - distance):
            best.append((span[0] - self.starts[i], 0, self.spans[i]))
        if j < len(self.spans) and (end is None or self.starts[j] < end) and (distance is None or self.starts[j] <= span[2] + distance):
            best.append((self.starts[j] - span[0], 1, self.spans[j]))
        return min(best)[2] if best else None


def linked_spans(text: str, base: list[tuple[int, int, int]], distance: int | None = DISTANCE) -> list[tuple[tuple[int, int, int], int]]:
    """Weak spans that a complementary part stands by, each with the start of that part.

    A mixed token needs an identifier (access or client), a client identifier needs a secret (base or mixed), an endpoint needs both.
    """
    clients = [(m.start(), 3, m.end()) for m in CLIENT.finditer(text)] if re.search(r"id|name|login", text, re.I) else []
    strong_ids = [s for s in base if s[1] == 1]
    if not clients and not strong_ids:
        return []
    covered = Parts(base, [0])
    mixed = [(m.start(), 4, m.end()) for m in MIXED.finditer(text)]
    mixed = [s for s in mixed if not _overlaps(s, covered)]
    named = Parts(clients, [0])
    mixed = [s for s in mixed if not _overlaps(s, named)]
    scopes = _scopes(text)
    ids = Parts(strong_ids + clients, scopes)
    secrets = Parts([s for s in base if s[1] in (0, 2)] + mixed, scopes)
    strong_secrets = Parts([s for s in base if s[1] in (0, 2)], scopes)
    out = []
    for s in mixed:
        if hit := ids.near(s, distance):
            out.append((s, hit[0]))
    for s in clients:
        if hit := strong_secrets.near(s, distance) or secrets.near(s, distance):
            out.append((s, hit[0]))
    if "://" in text:
        for m in ENDPOINT.finditer(text):
            s = (m.start(), 5, m.end())
            if (a := ids.near(s, distance)) and secrets.near(s, distance):
                out.append((s, a[0]))
    return sorted(out)


def _overlaps(span: tuple[int, int, int], parts: Parts) -> bool:
    i = bisect_right(parts.ends, span[0])
    return i < len(parts.spans) and parts.starts[i] < span[2]


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str | None, distance: int | None = DISTANCE) -> tuple:
    """The row of ``SCHEMA`` for one text. Positions are code points, ends exclusive; a null text counts as empty."""
    text = text or ""
    base = base_spans(text)
    weak = linked_spans(text, base, distance)
    every = sorted([(s, None) for s in base] + weak, key=lambda x: x[0])
    counts = [sum(s[1] == k for s in base) for k in range(3)]
    found = [{"kind": KINDS[k], "first": a, "last": b, "linked_to": to} for (a, k, b), to in every]
    return (*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(s for s, _ in every), found)


def scan_secrets(docs: DataFrame, text: str = "text", carry: list[str] | None = None, distance: int | None = None) -> DataFrame:
    """Every row with its base counts, ``base_sha256``, ``spans`` and ``found`` (spans with the part they are linked to).

    Rows are independent: no shuffle. Null and empty texts have no spans; repeated rows get equal results; an empty table gives no
    rows. Input columns named like a result column give way to it.
    """
    rows = docs.select(packed(docs, carry), F.col(text).alias("text"))
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]
    return unpacked(map_texts(rows, F.col("text"), each(scan, distance), SCHEMA), *names)


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(documents(spark, folder), carry=["doc_id"]).drop("found")
