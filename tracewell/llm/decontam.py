"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Words are runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. A window is
`window` consecutive words of an item, or the whole item if it has fewer. The automaton reads a
document's words as numbers, once; hits are word positions, mapped back to character offsets.

The automaton is broadcast. Its size is that of the benchmark, so it is checked: items are dealt into
groups of GROUP_BYTES of text at most, one automaton each, and documents are scanned once per group.
A benchmark within the bound (a test set, not a corpus) is one automaton and one scan. An item
longer than the bound is cut into overlapping parts with the same windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tracewell.llm.common import append_arrow, materialise, runs_by_size, texts

WINDOW = 10
GROUP_BYTES = 1 << 24
#: A-Z in lower case; ASCII characters that are no letter or digit as spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
#: What a scan yields: merged runs of hit words, as word positions and as code points, end exclusive.
RUN = StructType([StructField(x, IntegerType()) for x in ("first_word", "last_word", "start", "end")])


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def items_of(benchmark: DataFrame, least_words: int, text: str = "text") -> DataFrame:
    """The items of so many words or more."""
    words = F.array_size(F.filter(F.split(F.col(text), r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"), lambda w: w != ""))
    return benchmark.where(words >= least_words)


class Scanner:
    """The automaton over all windows of a list of (item, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.number: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        at = {item: i for i, item in enumerate(self.items)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            for w in windows(words, size):
                owners.setdefault(tuple(self.number.setdefault(x, len(self.number) + 1) for x in w), set()).add(at[item])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, who in owners.items():
            self.automaton.add_word(key, (len(key), tuple(who)))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged runs [first, last] of hit words, and the items found."""
        runs: list[list[int]] = []
        found: set[int] = set()
        if self.empty or not words:
            return [], []
        get = self.number.get
        for end, (n, who) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            found.update(who)
            start = end - n + 1
            while runs and start <= runs[-1][1] + 1:  # ends rise, but a longer window can start earlier
                start = min(start, runs.pop()[0])
            runs.append([start, end])
        return [(a, b) for a, b in runs], sorted(self.items[i] for i in found)


def spans_of(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets of word runs, in the original text."""
    if not runs:
        return []
    folded, at, n, out, pos, chars = raw.translate(FOLD), 0, -1, [], 0, 0
    wanted, edges = {x for r in runs for x in r}, {}
    for piece in folded.split():
        n += 1
        at = folded.index(piece, at)
        if n in wanted:
            chars += len(raw[pos:at].decode("utf-8", "replace"))
            pos = at
            edges[n] = (chars, chars + len(piece.decode("utf-8", "replace")))
        at += len(piece)
    for a, b in runs:
        out.append((edges[a][0], edges[b][1]))
    return out


def item_groups(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in groups of GROUP_BYTES of text at most; one group is on the driver at a time."""
    group, held = [], 0
    rows = benchmark.select(F.col(item_id).cast("string"), F.col(text)).where(F.col(item_id).isNotNull() & F.col(text).isNotNull())
    for item, body in rows.toLocalIterator():
        words = words_of(body.encode())
        sizes = [len(w) + 1 for w in words]
        for at, to in runs_by_size(sizes, GROUP_BYTES) if sum(sizes) > GROUP_BYTES else [(0, len(words))]:
            part = words[max(0, at - window + 1) : to]
            n = sum(map(len, part)) + len(part)
            if group and held + n > GROUP_BYTES:
                yield group
                group, held = [], 0
            group.append((item, part))
            held += n
    yield group


def scan_group(docs: DataFrame, group: list[tuple[str, list[bytes]]], text: str, window: int, prefix: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(group)

    def start():
        scanner = Scanner(shared.value, window)

        def make(batch):
            n, runs, items = [], [], []
            for raw in texts(batch.column(text)):
                words = words_of(raw)
                hit, found = scanner.scan(words)
                n.append(len(words))
                items.append(found)
                runs.append([{"first_word": a, "last_word": b, "start": s, "end": e} for (a, b), (s, e) in zip(hit, spans_of(raw, hit), strict=True)])
            return [pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.struct([(f.name, pa.int32()) for f in RUN]))), pa.array(items, pa.list_(pa.string()))]

        return make

    return append_arrow(docs, [StructField(f"{prefix}n_words", LongType()), StructField(f"{prefix}runs", ArrayType(RUN)), StructField(f"{prefix}items", ArrayType(StringType()))], start, text)


def scan_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, prefix: str = "") -> DataFrame:
    """docs with n_words, runs (merged runs of hit words: word positions, code point offsets) and
    items (sorted ids of the items with an occurring window).

    Null texts have no words; items with null id or text and items without words match nothing; an
    empty benchmark hits nothing. Rows that repeat an item_id are one item. Repeated documents get
    equal results. Columns named like the results are replaced; a prefix avoids that."""
    out, done = docs, []
    for group in item_groups(benchmark, item_id, item_text, window):
        if done:  # beyond the bound: one automaton in a task at a time
            out = materialise(out, "scanned")
        done.append(f"{prefix}{len(done)}_" if done else prefix)
        out = scan_group(out, group, text, window, done[-1])
    if len(done) == 1:
        return out
    runs, items = (F.concat(*[F.col(f"{p}{x}") for p in done]) for x in ("runs", "items"))
    return out.withColumns({f"{prefix}runs": merged(F.array_sort(runs)), f"{prefix}items": F.array_sort(F.array_distinct(items))}).drop(*[f"{p}{x}" for p in done[1:] for x in ("n_words", "runs", "items")])


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, runs and items of each row of docs; see scan_rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    return scan_rows(rows, benchmark, "__text", **options).drop("__text")


def merged(runs):
    """Sorted runs with those that touch or overlap made one."""
    last = lambda a: F.element_at(a, -1)
    joins = lambda a, x: (F.size(a) > 0) & (x["first_word"] <= last(a)["last_word"] + 1)
    wider = lambda a, x: F.struct(last(a)["first_word"].alias("first_word"), F.greatest(last(a)["last_word"], x["last_word"]).alias("last_word"), last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))
    step = lambda a, x: F.when(joins(a, x), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(wider(a, x)))).otherwise(F.concat(a, F.array(x)))
    empty = F.array().cast(ArrayType(RUN))
    return F.aggregate(runs, empty, step)


def n_hit(runs):
    return F.coalesce(F.aggregate(runs, F.lit(0), lambda n, r: n + r["last_word"] - r["first_word"] + 1), F.lit(0)).cast("long")
