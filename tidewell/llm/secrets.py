"""Secret scans with multipart credential linking.

One scan of each whole text finds the plain secrets (assignments, access identifiers, hex runs)
and the parts that are weak alone: key-like words, endpoints and account names. Each part has a
role: identifier, secret or endpoint. Parts go into scopes (the paragraphs of a text); inside a
scope an interval join links parts of different roles whose intervals, widened by `reach` code
points, meet. A weak part is reported only when complementary parts complete it: a secret with an
identifier or endpoint, an identifier or endpoint with a secret, or an endpoint and an identifier
of which one has a secret. The link says which part completes it.

Defined results: a null text counts as empty and gives a row with no spans; rows that repeat a
doc_id are scanned each on its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import ids_and_text, stored

# fixed values
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex"]
LEAST_ASSIGN = 6

#: Weak alone. A key-like word of 20 to 80 characters with digits, capitals and small letters.
KEYLIKE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,80}(?![A-Za-z0-9+/_=-])")
SHORTHEX = re.compile(r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])[0-9a-f]{16,23}(?![0-9A-Za-z])")
WEB = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/%-]*)?")  # what follows http:// or https://
OWNED = re.compile(r"[A-Za-z0-9._-]++@[A-Za-z0-9.-]+")  # what follows any other scheme: a user's place
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
ACCOUNT = re.compile(r"(?:user(?:name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,})", re.I | re.A)
IDENTIFIER, SECRET, PLACE = "identifier", "secret", "endpoint"
WEAK = {"weak_key": SECRET, "weak_hex": SECRET, "endpoint": PLACE, "account": IDENTIFIER}
ROLES = WEAK | {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET}

SCAN = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, "
    "parts array<struct<scope:int,role:string,kind:string,start:int,end:int,weak:boolean>>"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind index, end) of the plain secrets, sorted by start, then kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def endpoints(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of web addresses and of users' places under any scheme (letters, or letters+letters).

    From each :// the scheme's letters are walked back, no further than the address before, so
    every character is passed a few times at most.
    """
    done, at = 0, text.find("://")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LETTERS:
            first -= 1
        web = max(at - 5 if text.startswith("https", max(at - 5, 0)) else at - 4 if text.startswith("http", max(at - 4, 0)) else -1, -1)
        start, host = first, WEB.match(text, at + 3) if web >= done else None
        if first < at and first - 2 >= done and text[first - 1] == "+" and text[first - 2] in LETTERS:
            start = first - 2
            while start > done and text[start - 1] in LETTERS:
                start -= 1
        owned = OWNED.match(text, at + 3) if start < at and not (host and web == start) else None
        if owned or host:
            done = (owned or host).end()
            yield start if owned else web, done
        at = text.find("://", max(at + 3, done))


def parts_of(text: str, base: list[tuple[int, int, str]]) -> list[dict]:
    """Linkable parts with their scope; no weak part inside a plain secret."""
    digits = any(c in text for c in "0123456789")
    found = []
    if digits:
        found += [(m.start(), m.end(), "weak_key") for m in KEYLIKE.finditer(text)]
        found += [(m.start(), m.end(), "weak_hex") for m in SHORTHEX.finditer(text)]
    if "://" in text:
        found += [(a, b, "endpoint") for a, b in endpoints(text)]
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "account") for m in ACCOUNT.finditer(text)]
    starts, furthest = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    before = lambda end: bisect_left(starts, end)  # how many plain secrets start before it
    found = [x for x in found if not before(x[1]) or furthest[before(x[1]) - 1] <= x[0]]
    if not found:
        return []
    # identifiers and secrets found for sure complete a weak part, and need no report of their own
    found += [(a, b, KINDS[k]) for a, k, b in base]
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    out, scope, at = [], 0, 0
    for start, end, kind in sorted(found):
        while at < len(breaks) and breaks[at] < start:
            at, scope = at + 1, scope + 1
        out.append({"scope": scope, "role": ROLES[kind], "kind": kind, "start": start, "end": end, "weak": kind in WEAK})
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("scope", pa.int32()), ("role", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("weak", pa.bool_())])
    for b in batches:
        counts, shas, bases, parts = [[], [], []], [], [], []
        for t in b.column("text").to_pylist():
            base = base_spans(t or "")
            said = ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in base)
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in base))
            shas.append(hashlib.sha256(said.encode()).hexdigest())
            bases.append(said)
            parts.append(parts_of(t or "", base))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(bases, pa.string()), pa.array(parts, pa.list_(kind))],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"],
        )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the counts, digest and list of plain secrets, and the parts that may be linked."""
    return ids_and_text(docs, id_col, text_col).mapInArrow(_scan, SCAN)


def linked_parts(parts: DataFrame, reach: int = 200) -> DataFrame:
    """The weak rows of parts (row_id, scope, role, kind, start, end, weak) that are completed, with the part that does it.

    An interval join as a sweep: in a scope, by start, the part of another role with the furthest
    end so far and the one with the nearest start to come decide, so no pairs are made. Of the two
    the nearer is the partner (the earlier, if both are as near).
    """
    key, order = ["row_id", "scope"], ["start", "end", "kind"]
    back = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*key).orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    fields = [F.col("start").alias("s"), F.col("end").alias("e"), F.col("kind").alias("k")]

    def nearest(of: Column) -> Column:
        """The nearest part for which `of` holds, within reach: (gap, start, end, kind), or null."""
        last = F.max(F.when(of, F.struct(F.col("end"), *fields))).over(back)
        next_ = F.min(F.when(of, F.struct(F.col("start"), *fields))).over(ahead)
        gap = lambda x: F.greatest(F.lit(0), x["s"] - F.col("end"), F.col("start") - x["e"])
        near = [F.when(x.isNotNull() & (gap(x) <= reach), F.struct(gap(x).alias("gap"), x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))) for x in (last, next_)]
        return F.array_min(F.filter(F.array(*near), lambda x: x.isNotNull()))

    role = F.col("role")
    one = parts.withColumns({SECRET: nearest(role == SECRET), "open": nearest(role != SECRET)})
    one = one.withColumn("direct", F.when(role == SECRET, F.col("open")).otherwise(F.col(SECRET)))
    held = F.col("direct").isNotNull()
    two = one.withColumns({IDENTIFIER: nearest((role == IDENTIFIER) & held), PLACE: nearest((role == PLACE) & held)})
    partner = F.coalesce("direct", F.when(role == IDENTIFIER, F.col(PLACE)).when(role == PLACE, F.col(IDENTIFIER)))
    return two.withColumn("partner", partner).filter(F.col("weak") & F.col("partner").isNotNull()).select(*parts.columns, "partner")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, n_linked, spans (base and linked) and links (weak part>the part that completes it)."""
    scans = stored(scan_secrets(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id()), "secrets")
    some = scans.filter(F.exists("parts", lambda p: p["role"] == SECRET) & F.exists("parts", lambda p: p["role"] != SECRET))
    linked = linked_parts(some.select("row_id", F.inline("parts")), reach)
    said = F.concat_ws(":", "kind", "start", "end")
    entry = F.struct(F.col("start"), F.lit(3).alias("k"), said.alias("said"))
    link = F.struct(F.col("start"), F.concat(said, F.lit(">"), F.concat_ws(":", "partner.k", "partner.s", "partner.e")).alias("said"))
    more = linked.groupBy("row_id").agg(F.collect_set(entry).alias("added"), F.array_sort(F.collect_set(link)).alias("links"))
    out = scans.join(more, "row_id", "left")
    # spans are few and short: base ones are read back from their text form to be merged by start
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("int").alias("start"),
            (F.array_position(F.array(*map(F.lit, KINDS)), F.split(s, ":")[0]) - 1).cast("int").alias("k"),
            s.alias("said"),
        ),
    )
    spans = F.array_sort(F.concat(base, F.coalesce("added", F.array().cast("array<struct<start:int,k:int,said:string>>"))))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_linked"),
        F.array_join(F.transform(spans, lambda x: x["said"]), ",").alias("spans"),
        F.coalesce(F.array_join(F.transform("links", lambda x: x["said"]), ","), F.lit("")).alias("links"),
    )
