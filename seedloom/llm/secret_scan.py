"""Secrets in texts: fixed patterns, and values in credential contexts whose guess cost shows that nobody chose them for being easy."""

from __future__ import annotations

import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.llm.common import map_arrow, scratch
from seedloom.llm.words import counted, letter_runs

KINDS = ("assign", "access", "hex")
# The contract's patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Words that announce a credential, in forms that the fixed pattern doesn't know. They are looked for first.
NAMES = (
    "pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|signing|encryption)[ _-]?key|client[ _-]?secret|credentials?"
    "|authorization|bearer|auth|login|connection[ _-]?string"
)
CONTEXT = re.compile(
    rf"""(?<![A-Za-z])(?:{NAMES})(?![a-z])["'`\])]*"""
    r"""(?:\x20{0,8}(?::=|=>|->|[:=|])\x20{0,8}(?:(?:basic|bearer)\x20{1,8})?|\x20{1,8}(?P<weak>is|was|to)\x20{1,8}|(?<=bearer)\x20{1,8})"""
    r"""["'`]?(?P<value>[^\s"'`<>|,;()\[\]{}]{6,256})""",
    re.IGNORECASE | re.ASCII,
)
#: The credential of an address: scheme://name:value@host.
ADDRESS = re.compile(r"://[^\s/:@]{1,64}:(?P<value>[^\s/@]{6,256})@")
NEEDS = rf"(?i)(?:{NAMES})|AKIA|[0-9a-f]{{24}}|://[^\s/:@]+:"
#: The most frequent words over all documents make up the dictionary, if they occur so often: a secret's own letters must not make it cheap.
LEXICON, OCCURRENCES = 50_000, 5
LONGEST_WORD = 24
#: Values that take 2 to this many guesses or more are secrets; behind a mere verb they need as many more.
LEAST_BITS, WEAK_BITS = 33.0, 12.0
#: Longer matches of the fixed patterns are priced by brute force alone.
PRICED = 256
#: Each span of a segmentation costs so many bits for being one more.
SPAN_BITS = 1.0
# Passwords that people choose first, letters' look-alikes, and the keyboard's rows.
COMMON = (
    "password 123456 qwerty letmein welcome admin login master monkey dragon iloveyou sunshine princess football baseball shadow superman"
    " trustno1 changeme secret default example test guest root user pass hello freedom whatever abc123 access"
).split()
LOOKS = str.maketrans("4@831!05$7", "aabeiiosst")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Keys beside each other: in a row, and with the row below.
BESIDE = {frozenset((r[i], r[i + 1])) for r in ROWS for i in range(len(r) - 1)} | {frozenset((a[i], b[j])) for a, b in zip(ROWS, ROWS[1:]) for i in range(len(a)) for j in (i - 1, i) if 0 <= j < len(b)}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|[12]\d|3[01])\2(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d)")
YEARS, DAYS = 150, 372


def character_bits(c: str) -> float:
    """Bits of one character by brute force."""
    return math.log2(10) if c.isdigit() else math.log2(26) if c.isalpha() else math.log2(33)


def case_bits(word: str) -> float:
    """Bits of where a word's capitals stand."""
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    return 1.0 if upper == len(word) or upper == 1 and word[0].isupper() else math.log2(math.comb(len(word), upper) + 1)


def word_bits(part: str, costs: dict[str, float]) -> float | None:
    """Bits of a dictionary word, with capitals and look-alikes; None if it is none."""
    lower = part.lower()
    own = costs.get(lower)
    if own is not None:
        return own + case_bits(part)
    plain = lower.translate(LOOKS)
    own = costs.get(plain) if plain != lower else None
    return None if own is None else own + case_bits(part) + sum(a != b for a, b in zip(lower, plain)) + 1.0


def walk_lengths(value: str) -> list[tuple[int, int]]:
    """For the end of each character, the length of the walk over neighbouring keys or letters that ends there, and its turns."""
    lower = value.lower()
    found = [(1, 0)] if value else []
    before = None
    for i in range(1, len(lower)):
        a, b = lower[i - 1], lower[i]
        step = ord(b) - ord(a)
        kind = ("order", step) if abs(step) == 1 and a.isalnum() and b.isalnum() else ("keys", 0) if a != b and frozenset((a, b)) in BESIDE else None
        length, turns = found[-1]
        found.append((1, 0) if kind is None else (length + 1, turns + (before is not None and before != kind)) if length > 1 else (2, 0))
        before = kind
    return found


def guess_bits(value: str, costs: dict[str, float]) -> tuple[float, list[tuple[str, int, int]]]:
    """Bits of the cheapest segmentation of ``value``, and its spans: ``kind, start, end``.

    Dynamic programming over the ends of spans: dictionary words, dates, repeats of a unit, walks over
    neighbouring keys or letters, and single characters by brute force, of which neighbours count as one span.
    """
    n = len(value)
    best, back = [0.0] + [math.inf] * n, [("", 0)] * (n + 1)
    single = [0.0]
    for c in value:
        single.append(single[-1] + character_bits(c))
    walks = walk_lengths(value)
    periods = [[0] * (n + 1) for _ in range(9)]

    def offer(kind: str, start: int, end: int, bits: float) -> None:
        total = best[start] + bits + (0.0 if kind == "brute" and start and back[start][0] == "brute" else SPAN_BITS)
        if total < best[end]:
            best[end], back[end] = total, (kind, start)

    for end in range(1, n + 1):
        offer("brute", end - 1, end, single[end] - single[end - 1])
        for start in range(max(0, end - LONGEST_WORD), end - 2):
            bits = word_bits(value[start:end], costs)
            if bits is not None:
                offer("word", start, end, bits)
        for length in (4, 5, 6, 7, 8, 9, 10):
            if length <= end and DATE.fullmatch(value, end - length, end):
                offer("date", end - length, end, math.log2(YEARS) if length == 4 and value[end - 4 : end - 2] in ("19", "20") else math.log2(YEARS * DAYS) + 2.0 * (not value[end - length : end].isdigit()))
        length, turns = walks[end - 1]
        if length >= 3:
            offer("walk", end - length, end, math.log2(36) + math.log2(length) + 3.0 * (turns + 1))
        for unit in range(1, min(8, end - 1) + 1):
            run = periods[unit][end - 1] + 1 if value[end - 1] == value[end - 1 - unit] else 0
            periods[unit][end] = run
            times = run // unit + 1
            if times >= (3 if unit == 1 else 2):
                part = value[end - unit : end]
                own = word_bits(part, costs)
                brute = single[end] - single[end - unit]
                offer("repeat", end - times * unit, end, min(brute, brute if own is None else own) + math.log2(times))
    spans: list[tuple[str, int, int]] = []
    at = n
    while at:
        kind, start = back[at]
        if spans and kind == "brute" == spans[-1][0]:
            spans[-1] = (kind, start, spans[-1][2])
        else:
            spans.append((kind, start, at))
        at = start
    return best[n], spans[::-1]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``start, kind, end, value`` of the fixed patterns' matches that are long enough."""
    found = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found)


def candidate_spans(text: str) -> list[tuple[int, int, str, bool]]:
    """``start, end, value, weak`` of values in credential contexts; the value loses a full stop or such at its end."""
    found = []
    for pattern in (CONTEXT, ADDRESS):
        for m in pattern.finditer(text):
            value = m["value"].rstrip(".:!?*")
            if len(value) >= 6:
                start = m.start() if pattern is CONTEXT else m.start("value")
                found.append((start, m.start("value") + len(value), value, pattern is CONTEXT and m["weak"] is not None))
    return sorted(found)


def added_spans(text: str, base: list[tuple[int, int, int, str]], costs: dict[str, float], least: float = LEAST_BITS) -> list[tuple[int, int, int, float]]:
    """``start, kind, end, bits`` of candidates that are hard to guess and overlap neither base spans nor each other."""
    found: list[tuple[int, int, int, float]] = []
    for start, end, value, weak in candidate_spans(text):
        if any(s < end and start < e for s, _, e, _ in base) or found and start < found[-1][2]:
            continue
        # Placeholders such as ${NAME} and <name>, and addresses without a credential in them, announce nothing.
        if value[0] in "$%&" or value.startswith(("http:", "https:", "www.")) or not any(c.isalnum() for c in value):
            continue
        classes = sum((any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value[1:])))
        bits, _ = guess_bits(value, costs)
        if bits >= least + (WEAK_BITS if weak else 0.0) and (classes > 1 or not weak):
            found.append((start, 0, end, bits))
    return found


def common_words() -> dict[str, float]:
    """Bits of the passwords that people choose first, by their place in the list."""
    return {w: math.log2(i + 2) for i, w in enumerate(COMMON)}


def lexicon(documents: DataFrame, text_col: str = "text", words: int = LEXICON) -> dict[str, float]:
    """Bits of common passwords and of the most frequent words of all documents, by their share of these.

    As many of the highest counts are taken as give at most ``words`` words; where a count's words would exceed that, they and
    rarer ones are left out. The driver gets that border and these words, whatever the number of tasks.
    """
    counts = counted(documents.select(F.lit(None).cast("bigint"), F.col(text_col).cast("string")), lambda _, text: letter_runs(text))
    counts = scratch(counts.where(F.length("word").between(3, LONGEST_WORD) & (F.col("n") >= OCCURRENCES)))
    # One row a count: there are far fewer of these than words.
    falling = Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    border = counts.groupBy("n").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(falling)).where(F.col("upto") <= words).agg(F.min("n").alias("n")).first()["n"]
    top = counts.where(F.col("n") >= border).collect() if border is not None else []
    total = sum(r["n"] for r in top)
    return {r["word"]: math.log2(total / r["n"]) for r in top} | common_words()


SCHEMA = "doc_id bigint, base array<struct<start:int,kind:int,stop:int,bits:double>>, spans array<struct<start:int,kind:int,stop:int,bits:double>>"


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", costs: dict[str, float] | None = None, least: float = LEAST_BITS) -> DataFrame:
    """``doc_id, base, spans``: arrays of ``start, kind, stop, bits`` by start, then kind.

    ``base`` has the matches of the three fixed patterns that are long enough, leftmost and not
    overlapping within a kind. ``spans`` adds, as kind ``assign``, values that stand in credential contexts
    and take 2 to the ``least`` guesses or more by the cheapest segmentation; they overlap no other span. ``bits`` is
    that cost of a span's value. ``costs`` defaults to :func:`lexicon` of these documents. Positions are code points, the end exclusive.

    One map over the table after one that counts words. Null and empty texts have no spans; repeated rows and
    null ids are kept; an empty table gives an empty result; other columns are not read.
    """
    costs = lexicon(documents, text_col) if costs is None else costs
    shared = documents.sparkSession.sparkContext.broadcast(costs)

    def rows(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1)
        may = pc.fill_null(pc.match_substring_regex(texts, NEEDS), False)
        base: list[list] = [[] for _ in range(len(texts))]
        spans: list[list] = [[] for _ in range(len(texts))]
        at = pc.indices_nonzero(may).to_pylist()
        named = lambda found: [dict(zip(("start", "kind", "stop", "bits"), s)) for s in found]
        for i, text in zip(at, texts.take(pa.array(at, pa.int64())).to_pylist()):
            own = base_spans(text)
            more = added_spans(text, own, shared.value, least)
            priced = [(s, k, e, guess_bits(value, shared.value)[0] if len(value) <= PRICED else sum(map(character_bits, value))) for s, k, e, value in own]
            base[i], spans[i] = named(priced), named(sorted(priced + more))
        return {"doc_id": batch.column(0), "base": base, "spans": spans}

    return map_arrow(documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")), rows, SCHEMA)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["stop"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The base counts and hash, the text of all spans and the number of those added, of :func:`find_secrets` rows."""

    def of_kind(k: int):
        return lambda s: s["kind"] == k

    counts = [F.size(F.filter("base", of_kind(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(F.encode(spans_text(F.col("base")), "UTF-8"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"),
    )
