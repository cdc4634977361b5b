"""Secret scan with a password guess-cost model.

Patterns find the base spans. In addition, values in credential contexts (a
password-like key, or the password of a URL) are priced by dynamic programming:
the cheapest cut of the value into words, dates, repeats, sequences, keyboard
walks and brute-force spans gives the guesses an attacker needs. Words cost by
their rank: common passwords first, then the words of the corpus by frequency,
so that prose is cheap and no value needs to be exempt. Costly values are
secrets.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, partial
from math import inf, log10

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import map_texts, small_batches, text_batches

#: Base patterns, letters of ``assign`` in either case.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "guess")
#: Credential contexts of values that the guess-cost model prices.
CONTEXT = re.compile(rb"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth)["']?\s{0,4}(?::=|=>|[:=])\s{0,4}["']?([^\s"'<>,;]+)|[a-z][a-z0-9+.-]{1,15}://[^\s:@/]+:([^\s@/]+)@""", re.I)
#: A value is a secret from this many guesses (log10) and characters on.
LOG_GUESSES, MIN_VALUE = 9.0, 8

#: Common passwords and words of placeholders, the commonest first.
WORDS = """password admin welcome secret changeme qwerty letmein monkey dragon master login test guest root user default example
sample dummy your token value here insert placeholder my the pass key api please change this replace todo none null true false
string abc love summer winter spring autumn hello world football baseball shadow sunshine princess iloveyou""".split()
#: Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@301!57$", "aaeoiists")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?\d\d?){0,2}|\d\d?[-/.]?\d\d?[-/.]?(?:19|20)?\d\d")
#: Words of the corpus in the table, and the longest word or date (in characters) that a cut looks for.
TABLE, REACH = 50_000, 24
#: Longest block whose repeats a cut looks for.
PERIOD = 32
#: log10 of the guesses of a date, of a sequence or walk, of going on with a block, of another case, of letters written as digits.
DATE_COST, RUN_COST, AGAIN_COST, CASE_COST, LEET_COST = 4.5, 2.5, 1.0, 0.3, 0.3
#: Characters that join words, and what one costs.
JOINTS, JOINT_COST = "-_./:' ", 1.0
#: Keeps letters and what is not ASCII, in lower case; the rest becomes a space.
LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: A text without any of these has no context.
HINTS = (b"pass", b"pwd", b"secret", b"token", b"api", b"credential", b"auth", b"@")
#: Counters of a task are handed on at this many entries.
ENTRIES = 400_000


@cache
def _near() -> frozenset[str]:
    return frozenset(a + b for row in ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False))


def costs_of(words: list[str]) -> dict[str, float]:
    """log10 guesses of each word: common passwords first, then ``words`` in their order."""
    out: dict[str, float] = {}
    for w in (*WORDS, *words):
        out.setdefault(w, log10(len(out) + 2))
    return out


PLAIN = costs_of([])


def _small_letters(value: str) -> str:
    """Lower case, character by character (where that is longer than one, the character stays)."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(x if len(x := c.lower()) == 1 else c for c in value)


def log_guesses(value: str, costs: dict[str, float] = PLAIN, enough: float = inf) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``; ``costs``: log10 guesses of each word.

    Segments: a word of ``costs`` of at most REACH characters (other case and
    letters written as digits cost more); a date; three or more characters each
    next to the one before in the alphabet, or on the keyboard; two or more that
    go on with a block of at most PERIOD characters, for a whole block at least;
    or one character by brute force (10 guesses a digit or joint, 26 a letter,
    95 any other). Time is linear in the length: runs keep the cheapest of their
    possible starts. As soon as no cut can be below ``enough``, some value of at
    least ``enough`` is returned; that is exact for the comparison.
    """
    near = _near()
    n, low = len(value), _small_letters(value)
    plain = low.translate(LEET)
    best = [0.0] + [inf] * n
    since, least = [0, 0], [inf, inf]  # of the open sequence and walk: first character, cheapest start
    began, again = [0] * (PERIOD + 1), [inf] * (PERIOD + 1)  # the same of the open repeats, by size of block
    window = max(REACH, PERIOD)
    for j in range(1, n + 1):
        c = value[j - 1]
        now = best[j - 1] + (1.0 if "0" <= c <= "9" else log10(26) if c.isascii() and c.isalpha() else JOINT_COST if c in JOINTS else log10(95))
        if j > 1:
            a, b = low[j - 2], low[j - 1]
            for k, going in enumerate((abs(ord(b) - ord(a)) == 1, a + b in near)):
                if not going:
                    since[k], least[k] = j - 1, inf
                elif j - 3 >= since[k]:
                    least[k] = min(least[k], best[j - 3])
                    now = min(now, least[k] + RUN_COST)
            for p in range(1, min(PERIOD, j - 1) + 1):
                if b != low[j - 1 - p]:
                    began[p], again[p] = j, inf
                elif (i := j - max(p, 2)) >= max(began[p], p):
                    again[p] = min(again[p], best[i])
                    now = min(now, again[p] + AGAIN_COST)
        for i in range(max(0, j - REACH), j - 1):
            if (r := costs.get(low[i:j])) is not None or (r := costs.get(plain[i:j])) is not None:
                now = min(now, best[i] + r + CASE_COST * (value[i:j] != low[i:j]) + LEET_COST * (low[i:j] not in costs))
            if 4 <= j - i <= 10 and low[i].isdigit() and DATE.fullmatch(low, i, j):
                now = min(now, best[i] + DATE_COST)
        best[j] = now
        if enough < inf and j >= window and not j % 8 and now >= enough:
            if min(best[j - window : j + 1]) >= enough and min(least) + RUN_COST >= enough and min(again) + AGAIN_COST >= enough:
                return enough
    return best[n]


def is_secret(value: bytes, costs: dict[str, float] = PLAIN) -> bool:
    """Long and costly enough; punctuation at the end belongs to the sentence."""
    text = value.decode(errors="replace").rstrip(".,;:!?)]}")
    return len(text) >= MIN_VALUE and log_guesses(text, costs, LOG_GUESSES) >= LOG_GUESSES


def contexts(text: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the values in credential contexts, in order."""
    if (b":" in text or b"=" in text) and any(k in low for low in (text.lower(),) for k in HINTS):
        for m in CONTEXT.finditer(text):
            yield m.span(1 if m.group(1) is not None else 2)


def find_spans(text: bytes, costs: dict[str, float] = PLAIN) -> list[tuple[int, int, int]]:
    """(start byte, kind, end byte), sorted. Values that a base span touches are not priced again."""
    spans = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS] if b"AKIA" in text else []
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if b":" in text or b"=" in text:
        low = text.lower()
        if any(k in low for k in (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")):
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= MIN_ASSIGN]
    taken, at, reach, more = sorted((a, b) for a, _, b in spans), 0, 0, []
    for a, b in contexts(text):  # both in order of their starts, so one sweep does
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= a and is_secret(text[a:b], costs):
            more.append((a, 3, b))
    return sorted(spans + more)


def _words(batches):
    """Words of the texts and their counts; values in credential contexts are left out, lest a secret that is copied become a word."""
    seen: Counter = Counter()

    def flush():
        kept = {w: n for w, n in seen.items() if 2 < len(w) <= REACH}
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.binary()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

    for _, texts in text_batches(batches):
        for text in texts:
            at, rest = 0, []
            for a, b in contexts(text):
                rest.append(text[at:a])
                at = b
            seen.update(b" ".join([*rest, text[at:]]).translate(LETTERS).split())
            if len(seen) > ENTRIES:
                yield flush()
    yield flush()


def word_costs(docs: DataFrame, *, text_col: str = "text", size: int = TABLE) -> dict[str, float]:
    """Costs of the fixed words and of the ``size`` commonest words of all texts of ``docs`` (ties: by bytes). At most ``size`` words of REACH bytes come to the driver."""
    words = small_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(_words, "word binary, n long")
    top = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).toArrow()
    return costs_of([_small_letters(w.decode(errors="ignore")) for w in top.column("word").to_pylist()])


def in_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    if text.isascii() or not spans:
        return spans
    at, points, where = 0, 0, {}
    for p in sorted({x for a, _, b in spans for x in (a, b)}):
        points += len(text[at:p].decode())
        at, where[p] = p, points
    return [(where[a], k, where[b]) for a, k, b in spans]


COLUMNS = "n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"


def scan(text: bytes, costs: dict[str, float] = PLAIN) -> tuple:
    spans = in_points(text, find_spans(text, costs))
    n = [sum(k == x for _, k, _ in spans) for x in range(4)]
    said = [(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in spans]
    return *n, hashlib.sha256(",".join(x for k, x in said if k < 3).encode()).hexdigest(), ",".join(x for _, x in said)


def _scan_all(texts: list[bytes], shared) -> dict:
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    rows = [scan(t, shared.value) for t in texts]
    return dict(zip(names, zip(*rows, strict=True) if rows else [[] for _ in names], strict=True))


def _same(x):
    return x


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", costs: dict[str, float] | None = None) -> DataFrame:
    """One row per row of ``docs``: spans by kind, in code points, end exclusive.

    ``costs`` may carry the word table of an earlier run, else one pass over
    ``docs`` makes it. Null and empty texts have no spans (the hash is that of an
    empty string). Repeated rows give repeated rows, an empty table an empty one.
    Time is linear in the length of a text, however many spans or contexts it
    has and however long their values are.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(word_costs(docs, text_col=text_col) if costs is None else costs)
    return map_texts(slim, _scan_all, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {COLUMNS}", keep=["doc_id"], setup=partial(_same, shared))


def redact(text: bytes, costs: dict[str, float] = PLAIN, mark: bytes = b"[SECRET]") -> bytes:
    """``text`` with ``mark`` for each secret; of assignments only the value goes, and spans that overlap go as one."""
    out, at = [], 0
    for a, k, b in find_spans(text, costs):
        if k == 0:
            a = ASSIGN.match(text, a).start(2)
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return b"".join([*out, text[at:]])


def redacted(text: Column, shared) -> Column:
    """A text column without its secrets, by a broadcast word table; null stays null."""

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            raw = pc.cast(texts, pa.large_binary()).to_pylist()
            yield pa.array([None if x is None else redact(x, shared.value).decode() for x in raw], pa.string())

    return F.arrow_udf(each, "string", F.ArrowUDFType.SCALAR_ITER)(text)


def redact_secrets(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", costs: dict[str, float] | None = None) -> DataFrame:
    """``docs``, all rows and columns, with secrets cut out of the texts and the length column kept true.

    Null texts stay null, and rows without secrets stay as they are, however
    often repeated. An empty table gives an empty one. ``costs`` and long texts
    are as in :func:`secret_scan`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(word_costs(docs, text_col=text_col) if costs is None else costs)
    out = small_batches(docs).withColumn(text_col, redacted(F.col(text_col), shared))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(F.col(text_col)).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
