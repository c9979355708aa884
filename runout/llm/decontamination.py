"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test texts.

Normalisation lower-cases A-Z and keeps words of digits, letters and every character from U+0080 on.
A window is ``n`` consecutive words of an item; an item with fewer words, but not none, is one window.

The automaton's letters are word numbers. Its windows lie sorted in one array per word place, so a state,
the windows that share their first words, is a range of rows; the next state is found by bisection in
the next array. A failure link leads to the longest suffix that is a state; links and steps are remembered when
they are first needed. That takes 4 bytes a word and place, some 7 times the benchmark's text, in a file that
all workers of a machine map, so that even large benchmarks need no memory of their own in each worker. Pairs of
words that lie next to each other in some window are marked in a table of bits. Only a stretch of a document
whose pairs are all marked can hold a window; the automaton reads those stretches, all others in bulk.

The documents are never shuffled and are read once. Benchmarks of more than ``BLOCK_BYTES`` become several
files, built one after the other, which one scan looks into in turn.

Defined results: a null text has no words; an empty benchmark hits nothing; repeated items count once
per id; a row without an item id marks words but names no item; copies and ties do not matter, as every
document is scanned on its own.
"""

from __future__ import annotations

import atexit
import math
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runout.llm.common import arrow_schema, ship, slices

#: Item text per file; building one takes the driver some 30 bytes for each byte of it.
BLOCK_BYTES = 8_000_000
#: Bytes of a text whose words are held at once, and remembered steps and links of an automaton.
PIECE_BYTES = 4_000_000
REMEMBERED = 400_000

#: A-Z to a-z, other bytes of no word to a space, the rest as it is.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

_SPANS = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"

#: A state: how many words it has, and its rows.
State = tuple[int, int, int]
ROOT: State = (0, 0, 0)
#: Words of a text, (first, last) word of every match, and the ids of the items matched.
Scanned = tuple[int, list[tuple[int, int]], set[str]]


def _pieces_of_words(text: str | None) -> Iterator[list[bytes]]:
    folded = (text or "").encode().translate(_FOLD)
    start = 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def normalised_words(text: str | None) -> list[str]:
    return [w.decode() for words in _pieces_of_words(text) for w in words]


def _pair_places(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed >> np.uint64(64 - bits)


def _marked(table: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of words the table may hold; never one with a word of no window."""
    at = _pair_places(left, right, int(len(table) * 8).bit_length() - 1)
    found = table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
    return (found == 1) & (left > 0) & (right > 0)


def _stretches(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the runs of at least ``least`` true values."""
    edges = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    long = last - first + 1 >= least
    return first[long], last[long]


@dataclass
class Automaton:
    """Windows to the items that hold them. ``places[k]`` has the word number at place k of every window,
    0 past the end of a short one; the windows are sorted and each is there once."""

    places: list[np.ndarray]
    sizes: np.ndarray
    starts: np.ndarray  # per word number, where the windows that begin with it begin
    items_end: np.ndarray  # per window, where its items end in ``items``
    items: np.ndarray
    names: list[str]
    vocabulary: dict[bytes, int]
    pairs: np.ndarray  # bits of the pairs in windows of the largest size
    short_pairs: np.ndarray  # of those in shorter ones
    steps: dict[tuple[int, int, int], State | None] = field(default_factory=dict)
    links: dict[tuple[int, int], State] = field(default_factory=dict)

    _ARRAYS = ("sizes", "starts", "items_end", "items", "pairs", "short_pairs")

    def save(self, path: str) -> None:
        """One file that can be mapped."""
        columns = {f"place{k}": pa.array(p) for k, p in enumerate(self.places)}
        columns |= {name: pa.array(getattr(self, name)) for name in self._ARRAYS}
        columns |= {"names": pa.array(self.names, pa.string()), "words": pa.array(list(self.vocabulary), pa.binary())}
        lists = [pa.LargeListArray.from_arrays(pa.array([0, len(c)], pa.int64()), c) for c in columns.values()]
        batch = pa.RecordBatch.from_arrays(lists, names=list(columns))
        with pa.OSFile(path, "wb") as file, pa.ipc.new_file(file, batch.schema) as writer:
            writer.write_batch(batch)

    @classmethod
    def load(cls, path: str) -> Automaton:
        batch = pa.ipc.open_file(pa.memory_map(path)).get_batch(0)
        columns = {name: batch.column(i).values for i, name in enumerate(batch.schema.names)}
        arrays = {name: columns[name].to_numpy(zero_copy_only=True) for name in cls._ARRAYS}
        places = [columns[f"place{k}"].to_numpy(zero_copy_only=True) for k in range(len(columns) - len(arrays) - 2)]
        words = {w: i for i, w in enumerate(columns["words"].to_pylist(), 1)}
        return cls(places=places, names=columns["names"].to_pylist(), vocabulary=words, **arrays)

    def step(self, state: State, word: int) -> State | None:
        """The state after one more word, if there is one."""
        depth, low, high = state
        if depth == 0:
            low, high = int(self.starts[word]), int(self.starts[word + 1])
            return (1, low, high) if low < high else None
        if depth == len(self.places):
            return None
        key = (depth, low, word)
        if key not in self.steps:
            if len(self.steps) >= REMEMBERED:
                self.steps.clear()
            rows = self.places[depth][low:high]
            first, last = (int(np.searchsorted(rows, word, side)) for side in ("left", "right"))
            self.steps[key] = (depth + 1, low + first, low + last) if first < last else None
        return self.steps[key]

    def link(self, state: State) -> State:
        """The longest proper suffix that is a state."""
        depth, low, _ = state
        key = (depth, low)
        if key not in self.links:
            if len(self.links) >= REMEMBERED:
                self.links.clear()
            words = [int(self.places[k][low]) for k in range(depth)]
            for start in range(1, depth + 1):
                found: State | None = ROOT
                for word in words[start:]:
                    found = self.step(found, word)
                    if found is None:
                        break
                if found is not None:
                    self.links[key] = found
                    break
        return self.links[key]

    def ending(self, state: State) -> Iterator[tuple[int, int]]:
        """Size and row of the windows that end in a state."""
        while state[0]:
            depth, low, _ = state
            if self.sizes[low] == depth:
                yield depth, low
            state = self.link(state)

    def read(self, words: Iterable[int], first: int) -> Iterator[tuple[int, int, int]]:
        """First and last place and row of every match in consecutive words, the first at place ``first``."""
        state = ROOT
        for place, word in enumerate(words, first):
            while (after := self.step(state, word)) is None and state[0]:
                state = self.link(state)
            state = after or ROOT
            for size, row in self.ending(state):
                yield place - size + 1, place, row

    def numbers(self, pieces: Iterable[list[bytes]]) -> np.ndarray:
        """Word numbers, 0 for words of no window."""
        get = self.vocabulary.get
        found = [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)) for words in pieces]
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def may_match(self, words: np.ndarray) -> list[tuple[int, int]]:
        """First and last place of the stretches outside which no window can lie, apart from each other."""
        n = len(self.places)
        left, right = words[:-1], words[1:]
        found = []
        if n > 1 and len(left) >= n - 1:
            found.append(_stretches(_marked(self.pairs, left, right), n - 1))
        short = self.sizes[self.sizes < n] if n > 1 else self.sizes
        if len(short):
            if (short > 1).any() and len(left):
                found.append(_stretches(_marked(self.short_pairs, left, right), int(short[short > 1].min()) - 1))
            if (short == 1).any():
                single = np.zeros(len(self.starts), bool)
                single[self.places[0][self.sizes == 1]] = True
                alone = np.flatnonzero(single[words])
                found.append((alone, alone - 1))
        spans = sorted((int(a), int(b) + 1) for firsts, lasts in found for a, b in zip(firsts, lasts, strict=True))
        merged: list[tuple[int, int]] = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b))
            else:
                merged.append((a, b))
        return merged

    def scan(self, texts: list[list[list[bytes]]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Ranges of words and ids of the items for texts given as pieces of words, all read at once."""
        parts, gap = [], np.zeros(1, np.int32)
        for pieces in texts:
            parts += [self.numbers(pieces), gap]
        begins = np.cumsum([0, *(len(p) + 1 for p in parts[::2])])
        flat = np.concatenate(parts) if parts else gap
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in texts]
        rows: dict[int, set[int]] = {}
        for a, b in self.may_match(flat):
            text = int(np.searchsorted(begins, a, "right")) - 1
            base = int(begins[text])
            for first, last, row in self.read(flat[a : b + 1].tolist(), a - base):
                out[text][0].append((first, last))
                rows.setdefault(text, set()).add(row)
        for text, found in rows.items():
            for row in found:
                begin = int(self.items_end[row - 1]) if row else 0
                out[text][1].update(self.names[i] for i in self.items[begin : int(self.items_end[row])])
        return out


def build_automaton(items: list[tuple[str | None, str | None]], n: int) -> Automaton | None:
    """The automaton of (item id, text) rows; None if there is no window."""
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    words, lengths, owners = [np.zeros(0, np.int32)], [], []
    for item_id, text in items:
        numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for piece in _pieces_of_words(text) for w in piece]
        if numbers:
            words.append(np.array(numbers, np.int32))
            lengths.append(len(numbers))
            owners.append(-1 if item_id is None else names.setdefault(item_id, len(names)))
    if not lengths:
        return None
    flat, length = np.concatenate(words), np.array(lengths)
    windows = np.maximum(length - n + 1, 1)
    item = np.repeat(np.arange(len(length)), windows)
    begins = (np.cumsum(length) - length)[item] + np.arange(len(item)) - (np.cumsum(windows) - windows)[item]
    sizes = np.minimum(length[item], n).astype(np.int32)
    padded = np.concatenate((flat, np.zeros(n, np.int32)))
    places = [np.where(k < sizes, padded[begins + k], 0).astype(np.int32) for k in range(min(n, int(sizes.max())))]
    order = np.lexsort(places[::-1])
    places = [p[order] for p in places]
    new = np.concatenate(([True], np.any([p[1:] != p[:-1] for p in places], axis=0)))
    row, owner = np.cumsum(new) - 1, np.array(owners)[item[order]]
    held = np.unique(np.stack([row, owner])[:, owner >= 0], axis=1)
    places, sizes = [p[new] for p in places], sizes[order][new]
    rows = len(sizes)
    tables = []
    for full in (True, False):
        chosen = (sizes == len(places)) if full else (sizes < len(places))
        bits = np.zeros(1 << max(10, int(16 * max(1, chosen.sum())).bit_length()), bool)
        for a, b in zip(places, places[1:], strict=False):
            both = chosen & (a > 0) & (b > 0)
            bits[_pair_places(a[both], b[both], len(bits).bit_length() - 1)] = True
        tables.append(np.packbits(bits, bitorder="little"))
    return Automaton(
        places=places,
        sizes=sizes,
        starts=np.searchsorted(places[0], np.arange(len(vocabulary) + 2)).astype(np.int64),
        items_end=np.cumsum(np.bincount(held[0], minlength=rows)).astype(np.int64),
        items=held[1].astype(np.int32),
        names=list(names),
        vocabulary=vocabulary,
        pairs=tables[0],
        short_pairs=tables[1],
    )


def scan_texts(automata: list[Automaton], texts: list[str | None]) -> list[Scanned]:
    """Every text looked up in every automaton."""
    words = [list(_pieces_of_words(t)) for t in texts]
    found = [a.scan(words) for a in automata]
    return [
        (sum(map(len, w)), [r for f in found for r in f[i][0]], set().union(*(f[i][1] for f in found)))
        for i, w in enumerate(words)
    ]


def scan(automaton: Automaton | None, text: str | None) -> Scanned:
    return scan_texts([automaton] if automaton else [], [text])[0]


def original_spans(text: str, ranges: list[tuple[int, int]]) -> tuple[int, list[dict[str, int]]]:
    """Number of words in any range, and the merged stretches as offsets of the original text."""
    merged: list[list[int]] = []
    for first, last in sorted(ranges):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    places = [m.span() for m in _WORD.finditer(text)] if merged else []
    spans = [{"start": places[a][0], "end": places[b][1]} for a, b in merged]
    return sum(b - a + 1 for a, b in merged), spans


_loaded: dict[str, Automaton] = {}


def _automata(names: list[str]) -> list[Automaton]:
    """The automata of a scan, mapped once per worker; those of earlier scans are let go."""
    for name in set(_loaded) - set(names):
        del _loaded[name]
    for name in names:
        if name not in _loaded:
            _loaded[name] = Automaton.load(SparkFiles.get(name))
    return [_loaded[name] for name in names]


def _shipped(spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str, n: int, block_bytes: int) -> list[str]:
    """Build the automata, one block of items in the driver's memory at a time, and send their files along."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    items = items.where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    folder = tempfile.mkdtemp(prefix="runout-benchmark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    names = []
    for i in range(blocks):
        rows = sorted(((r.item, r.text) for r in items.where(block == i).collect()), key=str)
        automaton = build_automaton(rows, n)
        if automaton:
            names.append(f"benchmark-{uuid.uuid4().hex}.arrow")
            automaton.save(os.path.join(folder, names[-1]))
            spark.sparkContext.addFile(os.path.join(folder, names[-1]))
    return names


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: id, n_words, n_hit (words inside any occurrence of a window), items (sorted as
    text) and spans (merged stretches of hit words, as character offsets of the original text)."""
    spark = docs.sparkSession
    ship(spark)
    names = _shipped(spark, benchmark, item_col, item_text_col, n, block_bytes)
    df = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    ddl = f"`{id_col}` {df.schema[0].dataType.simpleString()}, {_SPANS}"
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(names)
        for batch in slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            found = scan_texts(automata, texts)
            spans = [original_spans(t or "", ranges) for t, (_, ranges, _) in zip(texts, found, strict=True)]
            columns = [[f[0] for f in found], [s[0] for s in spans], [sorted(f[2]) for f in found], [s[1] for s in spans]]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), *arrays], schema=schema)

    return df.mapInArrow(run, ddl)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``text`` holds no benchmark window."""
    spark = docs.sparkSession
    ship(spark)
    names = _shipped(spark, benchmark, "item_id", "text", n, block_bytes)
    place = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(names)
        for batch in slices(batches, "text"):
            found = scan_texts(automata, batch.column(place).to_pylist())
            yield batch.filter(pa.array([not ranges for _, ranges, _ in found], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
