"""Secrets in texts: fixed patterns, and values that would be hard to guess."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "guess")

#: what may stand before a value that is meant to be secret
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|login|api[_\x20-]?key|"""
    r"""access[_\x20-]?key|private[_\x20-]?key|auth|bearer)["']?(?:\x20*(?::=|=>|->|[:=])\x20*|\x20+is\x20+)["'`]?"""
    r"""([^\s"'`<>,;]{6,})""",
    re.I | re.A,
)

BEFORE = CONTEXT.pattern.rpartition('["\'`]?')[0]
#: the same names before a value that goes on after commas or semicolons
WHOLE = re.compile(BEFORE + r"""["'`]?([^\s"'`<>,;][^\s"'`<>]{4,}[^\s"'`<>,;])""", re.I | re.A)
#: and before one in quotes, which may have any characters in its line
QUOTED = re.compile(BEFORE + r"""(?:"([^"\n]{6,})"|'([^'\n]{6,})'|`([^`\n]{6,})`)""", re.I | re.A)
BEARER = re.compile(r"(?<![A-Za-z0-9])(?:bearer|basic)\x20+([A-Za-z0-9._~+/-]{6,}=*)", re.I | re.A)
ADDRESS = re.compile(r"""://[^\s/:@"'<>]*:([^\s/@"'<>]{6,})@""")

# fixed values: common words of passwords, rows of a keyboard
WORDS = """password passwd pass secret admin administrator root login welcome hello master monkey dragon
shadow sunshine princess football baseball soccer hockey batman superman starwars pokemon letmein trustno
iloveyou love baby angel flower summer winter spring autumn monday friday january february march april may
june july august september october november december test testing guest user default changeme change example
sample demo temp server system database access internet computer google apple orange banana cookie coffee
cheese pepper ginger tiger eagle falcon lion wolf horse jordan michael jennifer thomas robert daniel andrew
charlie george harley ranger hunter killer freedom whatever nothing token key api none null your here insert
placeholder company london paris berlin madrid red blue green black white silver gold one two three the and
for you my me is to of in on""".split()
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop", "qsdfghjklm", "wxcvbn")

RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST_WORD = max(map(len, WORDS))
LEET = str.maketrans("01345@$7!", "oieasasti")
NEXT = {(a, b) for row in KEYBOARD for a, b in zip(row, row[1:])}
NEXT |= {(b, a) for a, b in NEXT}
DATE = re.compile(
    r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d"
    r"|(?:19|20)\d\d"
)
DATE_GUESSES = math.log10(365 * 130)
YEAR_GUESSES = math.log10(130)
#: every further part doubles the ways in which parts can be put together
NEXT_PART = math.log10(2)


def alphabet(char: str) -> float:
    """log10 of the characters that a brute-force search would try in this place."""
    if char.isdigit():
        return 1.0
    if char.isascii() and char.isalpha():
        return math.log10(26 if char.islower() else 52)
    return math.log10(95 if char.isascii() else 1000)


def guess_cost(value: str) -> float:
    """log10 of the guesses needed at least, by the cheapest cut into parts.

    Dynamic programme over the ends of parts: a word (also with capitals and digits for
    letters), a date or year, a repeat of one to eight characters, a keyboard or
    alphabet walk, or a character by brute force. Every start of a part is considered; a
    start within a run or walk is left out where an earlier one of it is never dearer.
    """
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    upto = [0.0]  # brute force up to each place
    for char in value:
        upto.append(upto[-1] + alphabet(char))
    dates = {}
    for start in range(n):
        for end in (start + 4, start + 8, start + 10):
            if end <= n and DATE.fullmatch(value, start, end):
                dates[start, end] = YEAR_GUESSES if end - start == 4 else DATE_GUESSES
    walks: list[int] = []  # starts of walks that reach this place
    runs: dict[int, list[int]] = {u: [] for u in range(1, 9)}  # the same of runs by period
    for end in range(1, n + 1):
        last = end - 1
        cost = best[last] + upto[end] - upto[last]
        for start in range(max(0, end - LONGEST_WORD), last):
            rank = RANK.get(low[start:end]) or RANK.get(plain[start:end])
            if rank:
                changed = sum(a != b for a, b in zip(value[start:end], low[start:end]))
                changed += sum(a != b for a, b in zip(low[start:end], plain[start:end])) * (low[start:end] not in RANK)
                cost = min(cost, best[start] + math.log10(rank + 1) + changed * 0.5 + NEXT_PART)
        for size in (4, 8, 10):
            if (end - size, end) in dates:
                cost = min(cost, best[end - size] + dates[end - size, end] + NEXT_PART)
        if last and not steps(low[last - 1], low[last]):
            walks = []
        if all(best[last] < best[s] + math.log10(40 * (last - s)) for s in walks):
            walks.append(last)
        for start in walks:
            if end - start >= 3:
                cost = min(cost, best[start] + math.log10(40 * (end - start)) + NEXT_PART)
        for u, starts in runs.items():
            again = last - u
            if again >= 0:
                if value[last] != value[again]:
                    starts = [s for s in starts if s > again]
                elif any(s < again and best[again] >= best[s] + upto[s + u] - upto[s] + math.log10(max(2, (again - s) // u)) for s in starts):
                    starts = [s for s in starts if s != again]
            runs[u] = starts = [*starts, last]
            for start in starts:
                if end - start >= 2 * u and end - start >= 3:
                    unit = upto[start + u] - upto[start]
                    cost = min(cost, best[start] + unit + math.log10(max(2, (end - start) // u)) + NEXT_PART)
        best[end] = cost
    return best[n]


def steps(a: str, b: str) -> bool:
    """Whether ``b`` follows ``a`` in a walk over a keyboard or the alphabet."""
    return (a, b) in NEXT or abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum()


def valued(text: str) -> set[tuple[int, int]]:
    """Spans of the values after a credential's name, of bearer tokens, and of passwords in addresses."""
    found = {m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6}
    ends = dict(m.span(1) for m in CONTEXT.finditer(text))
    ends.update(m.span(1) for m in WHOLE.finditer(text))  # never ends sooner
    found |= set(ends.items())
    found |= {m.span(m.lastindex) for m in QUOTED.finditer(text)}
    found |= {m.span(1) for m in BEARER.finditer(text)}
    if "://" in text:
        found |= {m.span(1) for m in ADDRESS.finditer(text)}
    return found


def spans(text: str, least_cost: float) -> list[tuple[str, int, int]]:
    """Kind, start and end of every secret, by start, then by kind as in ``KINDS``."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += [("guess", a, b) for a, b in valued(text) if guess_cost(text[a:b]) >= least_cost]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", least_cost: float = 10.0) -> DataFrame:
    """Every secret of each text, as spans of code points, end exclusive.

    Kinds: ``assign`` (a credential's name, a colon or equals sign, and six characters or
    more), ``access`` (an access key id), ``hex`` (24 hexadecimal digits or more), each
    leftmost and without overlap; and ``guess``, the value alone after a credential's
    name, if the cheapest way to guess it takes ``10 ** least_cost`` guesses or more.

    Returns ``key`` and ``secrets``, an array of (kind, start, end). NULL and empty texts
    have an empty array. Rows are independent: repeated rows and NULL keys stay, and
    other columns are ignored. An empty table gives no rows.
    """
    out = T.StructType([docs.schema[key], T.StructField("secrets", SPANS)])
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in spans(t.as_py() or "", least_cost)]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], names=[key, "secrets"])

    return docs.select(key, text).mapInArrow(rows, out)


def masked(docs: DataFrame, text: str = "text", least_cost: float = 10.0) -> DataFrame:
    """The rows with every secret in their text replaced by ``[kind]``; overlapping ones by the first's.

    Other columns stay as they are, NULL texts too.
    """
    at = docs.columns.index(text)

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        out, done = [], 0
        for kind, start, end in spans(value, least_cost):
            if start >= done:
                out += [value[done:start], f"[{kind}]"]
            done = max(done, end)
        return "".join([*out, value[done:]]) if out else value

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            texts = pa.array([clean(t.as_py()) for t in column], column.type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(rows, docs.schema)
