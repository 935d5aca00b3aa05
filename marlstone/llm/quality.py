"""Per-document text quality statistics.

A document is cut into chunks of at most ``chunk`` characters. Each chunk gives counts that can be added, and the
state of the pieces of lines at its two ends; joining two chunks joins the last piece of the first with the first
piece of the second (a word cut in two is made one again) before that line is judged, so the result does not
depend on where the cuts fall. A document of one chunk never leaves its task. The chunks of longer ones are spread over
all tasks to be counted, and their states (some hundred bytes for 64 K characters) meet in a tree: ``FAN`` neighbours
become one state of the same kind, and so on up to the document, so no task ever holds more than ``FAN`` of them.
Ratios and rule outcomes follow from the counts.

Every line is judged by its own form: a list item, a table row, a log or trace line, code, natural prose, a short
line, or other. A document is natural prose if at least half of its characters (blanks around lines not counted)
are prose.
"""

from __future__ import annotations

import re
from ast import literal_eval
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 65_536
#: How many characters of a line's start and end its state keeps, for the marks that lines of a kind begin and end with;
#: everything that is counted is counted over the whole line.
EDGE = 200
#: States that become one, and levels of the tree: texts of Spark have at most 2**31 bytes, less than CHUNK * FAN**LEVELS.
FAN, LEVELS = 64, 3
KINDS = ("prose", "list", "table", "log", "code", "short", "other")
COUNTS = ("lines", "chars", "words", "letters", "common", "symbols", "digits", "ended", *(f"{k}_chars" for k in KINDS), *(f"{k}_lines" for k in KINDS))

LIST = re.compile(r"\s*(?:[-*+•‣◦▪–—·○●□]|\[[ xX]?\]|\(?\d{1,4}[.):]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)])\s+\S")
LOG = re.compile(
    r"\s*(?:\[?\d{4}-\d\d-\d\d[T ]|\[?\d\d:\d\d|at \S+\(|\w+=\S+ \S+=|\{\"|(?:[A-Za-z-]+): \S+ \(\d|Traceback|File \"|(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b|\S+ \[\d+\])"
)
CODE = re.compile(
    r"\s*(?:(?:def|func|fn|class|struct|interface|enum|package|import|from|return|const|let|var|public|private|static|if|for|while|switch|elif|try|#include|#define)\b.*[(){}\[\];=:]\s*(?:[#/].*)?$"
    r"|\s+(?:#|//|/\*)|[\w.\[\]]+\s*(?:[-+*/|]?=|:=)\s*\S+.*$|[\w-]+:\s*$|\s+[\w-]+:\s*\S+$|[)}\]]+[;,]?\s*$|<[/?!a-zA-Z])"
)
GAP = re.compile(r"\S {2,}(?=\S)")
LETTERS = re.compile(r"[^\W\d_]+")
STOPS = frozenset(".!?…:;。！？")
SENTENCE_END = frozenset(".!?…。！？")


def _measure(line: str, common: frozenset) -> list:
    """The state of a line or a piece of one: counts, first and last characters."""
    bare = line.strip()
    letters = LETTERS.findall(bare)
    return [
        len(bare), len(bare.split()), sum(map(len, letters)), sum(w in common for w in map(str.lower, letters)), sum(map(str.isdigit, bare)),
        bare.count("|"), line.count("\t"), len(GAP.findall(bare)) if "  " in bare else 0, bare.count(","), bare.count(", "),
        sum(bare.count(c) for c in "{}()[];=<>_"), bare.count(" "), line[:EDGE], line[-EDGE:],
    ]


def _join(a: list, b: list, common: frozenset) -> list:
    """The state of the line whose two pieces have the states ``a`` and ``b``."""
    head, tail = a[13], b[12]
    out = [x + y for x, y in zip(a[:12], b[:12], strict=True)]
    blank_a, blank_b = len(head) - len(head.rstrip()), len(tail) - len(tail.lstrip())
    if a[0] and b[0]:
        out[0] += blank_a + blank_b
        out[11] += head[len(head) - blank_a :].count(" ") + tail[:blank_b].count(" ")
        if not blank_a and not blank_b:  # a word cut in two
            out[1] -= 1
            left, right = re.search(r"[^\W\d_]*$", head)[0], re.match(r"[^\W\d_]*", tail)[0]
            if left and right:
                out[3] += ((left + right).lower() in common) - (left.lower() in common) - (right.lower() in common)
        mid = head + tail
        if "  " in mid:
            out[7] += len(GAP.findall(mid)) - len(GAP.findall(head.rstrip())) - len(GAP.findall(tail.lstrip()))
        if head.endswith(",") and tail.startswith(" "):
            out[9] += 1
    first, last = a[12], b[13]
    return [*out, (first + tail)[:EDGE] if len(first) < EDGE else first, (head + last)[-EDGE:] if len(last) < EDGE else last]


def _kind(s: list) -> str:
    """What a whole line of state ``s`` is."""
    chars, words, letters, common, digits, pipes, tabs, gaps, commas, spaced, code, spaces, first, last = s
    if LIST.match(first):
        return "list"
    if pipes >= 1 and (pipes >= 2 or " | " in first) or tabs >= 2 or gaps >= 2 or (commas - spaced >= 2 and commas - spaced > spaced and commas * 3 >= words):
        return "table"
    if LOG.match(first):
        return "log"
    if CODE.match(first) and common * 4 < max(words, 4) or (code >= 3 and code * 12 > chars and last.rstrip()[-1:] in "{};:,)]>") or (first[:1] in " \t" and LIST.match(first) is None and re.match(r"\s+(?:#|//|return\b)", first)):
        return "code"
    ends = last.rstrip()[-1:] in SENTENCE_END
    if words < 4:  # a script without blanks still ends its sentences
        return "prose" if letters >= 20 and ends and letters >= 0.8 * chars and first.lstrip()[:1] > "\u2e80" else "short"
    plain = letters + spaces >= 0.8 * chars
    if plain and common >= 0.12 * words:
        return "prose"
    # A sentence of a language without a list of common words, told by its form.
    if plain and words >= 6 and ends and not first.lstrip()[:1].islower() and 2.5 * words <= letters <= 12 * words and sum(len(w) <= 3 for w in first.split()) >= 0.15 * min(words, len(first.split())):
        return "prose"
    return "other"


def _add(total: list, s: list) -> None:
    chars, words, letters, common, digits = s[:5]
    if not chars:
        return
    kind = KINDS.index(_kind(s))
    for i, v in enumerate((1, chars, words, letters, common, chars - letters - digits - s[11], digits, s[13].rstrip()[-1:] in STOPS)):
        total[i] += v
    total[8 + kind] += chars
    total[8 + len(KINDS) + kind] += 1


def measure_chunk(text: str, common: frozenset, whole: bool) -> tuple[list, list, list]:
    """Counts of the whole lines of a chunk, and the states of its first and last piece (of none if ``whole``)."""
    lines, total = text.split("\n"), [0] * len(COUNTS)
    inner = lines if whole else lines[1:-1]
    for line in inner:
        if line and not line.isspace():
            _add(total, _measure(line, common))
    if whole:
        return total, [], []
    return total, _measure(lines[0], common), _measure(lines[-1], common) if len(lines) > 1 else []


def merge_states(parts: list[tuple[list, list, list]], common: frozenset) -> tuple[list, list, list]:
    """The state of neighbouring chunks, in order, as that of one: an associative step."""
    total, head, tail = [0] * len(COUNTS), [], []
    for counts, first, last in parts:
        total = [a + b for a, b in zip(total, counts, strict=True)]
        if tail:
            line = _join(tail, list(first), common)
            if last:
                _add(total, line)
            tail = list(last) or line
        else:
            head = _join(head, list(first), common) if head else list(first)
            tail = list(last)
    return total, head, tail


def merge_chunks(parts: list[tuple[list, list, list]], common: frozenset) -> list:
    """The counts of a document from those of its chunks, in order."""
    total, *lines = merge_states(parts, common)
    for line in lines:
        if line:
            _add(total, line)
    return total


def statistics(df: DataFrame, key: str, text: str, common_words: list[str], chunk: int = CHUNK) -> DataFrame:
    """One row of counts, ratios and outcomes per row of ``df`` with a non-null key and text.

    Columns: ``id``, the counts of ``COUNTS``, ``mean_word_length``, ``symbol_ratio``, ``digit_ratio``,
    ``ended_share`` (lines that end in punctuation), ``common_share`` (words that are common words),
    ``prose_share`` and ``is_prose``. Ratios of a text without characters are 0 and it is no prose. A repeated row
    comes out again, but for texts longer than a chunk, which come out once per key and text; the caller keeps one
    row of a key with ``dropDuplicates(["id"])``.
    """
    common = frozenset(w.lower() for w in common_words if w)
    source = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    short = source.where(F.length("text") <= chunk)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    long = source.where(F.length("text") > chunk).dropDuplicates().select("id", F.xxhash64("text").alias("which"), F.posexplode(pieces).alias("no", "text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure_chunk(t, common, True)[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(COUNTS))]], ["id", *COUNTS])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [repr(measure_chunk(t, common, False)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(states, pa.string())], ["id", "which", "no", "state"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [repr(merge_states([literal_eval(s["state"]) for s in states], common)) for states in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(states, pa.string())], ["id", "which", "no", "state"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [merge_chunks([literal_eval(s)], common) for s in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(COUNTS))]], ["id", *COUNTS])

    schema = "id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
    state = "id bigint, which bigint, no int, state string"
    states = long.repartition("id", "which", "no").mapInArrow(part, state)
    for _ in range(LEVELS):
        near = states.groupBy("id", "which", F.floor(F.col("no") / FAN).cast("int").alias("no")).agg(F.array_sort(F.collect_list(F.struct(F.col("no").alias("at"), "state"))).alias("states"))  # at most FAN
        states = near.mapInArrow(joined, state)
    counts = short.mapInArrow(whole, schema).unionByName(states.mapInArrow(merge, schema))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return counts.select(
        "id", *COUNTS, ratio("letters", "words").alias("mean_word_length"), ratio("symbols", "chars").alias("symbol_ratio"), ratio("digits", "chars").alias("digit_ratio"),
        ratio("ended", "lines").alias("ended_share"), ratio("common", "words").alias("common_share"), ratio("prose_chars", "chars").alias("prose_share"),
        (F.col("prose_chars") * 2 >= F.greatest("chars", F.lit(1))).alias("is_prose"),
    )
