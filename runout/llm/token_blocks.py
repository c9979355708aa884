"""Token ids in patched frame-of-reference blocks.

Documents are encoded with a public tokenizer, an end id is appended to each, and the ids are written in
ascending document order. A block holds up to ``BLOCK`` ids: its minimum is subtracted, the differences
are packed at the width that holds a given percentile of them, and the outliers go, whole, to a list of
places and values. A file ends with the byte offset of every block, the documents with their lengths, and
a footer with a checksum.

File: ``PFORIDS1``; blocks, each minimum u32, width u8, count u16, outliers u16, packed bits, outlier
places u16 and differences u32; block offsets u64; ids i64, null flags u8 and lengths u64 of the documents;
footer: blocks u64, documents u64, token ids u64, offset of the block offsets u64, crc32 of everything
between blocks and footer u32, ``PFOREND1``. All little-endian.

Documents are shuffled once, by ranges of their id, so that each task writes consecutive documents and
only the counts per file are summed over all. Every attempt writes a new file; a stored list names the
finished ones. Words between spaces and line feeds are encoded once per worker and kept in a cache of
bounded size: this tokenizer never joins text across white space.

Defined results: null and empty texts have the end id only; a null id sorts first; rows with the same id
are ordered by a hash of their text, equal rows are interchangeable; an empty table gives no file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runout.llm.common import arrow_schema, file_folder, ship, slices, stored

MAGIC, END_MAGIC = b"PFORIDS1", b"PFOREND1"
BLOCK = 1024
#: An outlier takes 48 bits, so a bit more for a block of 1024 pays from about 2 % outliers on.
PERCENTILE = 98
#: Blocks that are packed or read at once, ids or documents after which a task begins a new file, and
#: documents that are read at once.
RUN_BLOCKS = 256
FILE_IDS = 1 << 27
FILE_DOCS = 1_000_000
READ_DOCS = 10_000
#: Characters that are encoded at once.
ENCODE_CHARS = 8_000_000
#: Distinct words whose ids a worker keeps.
CACHED_WORDS = 600_000

_MARKS = frozenset(".,!?:;")
_HEAD = struct.Struct("<IBHH")
_FOOTER = struct.Struct("<QQQQI8s")
_MANIFEST = "part int, seq int, path string, documents long, ids long"


class _Places(dict):
    """Words by order of appearance; a new word takes the next place."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


class WordEncoder:
    """Ids of many texts at once; equal words between spaces are encoded once.

    Three properties of the tokenizer make this exact. It splits at white space before anything else, so a
    text's ids are those of its words. It ignores case, so A-Z may be lower-cased first. It marks the last
    id of every piece it cuts a word into, so many plain words (letters, perhaps with one mark behind)
    can be encoded as one text and told apart by counting marks. Texts with special tokens are left to it.
    """

    def __init__(self, path: str, most_words: int | None = None):
        self.most_words = most_words or CACHED_WORDS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_piece = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_piece[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.places = _Places()
        self.ids = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)
        self.batches = np.empty(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Encode the words that have just got places."""
        pieces = np.fromiter(map(_plain_pieces, words), np.int64, len(words))
        plain = np.flatnonzero(pieces)
        lengths = np.zeros(len(words), np.int64)
        joined = [" ".join(words[i] for i in plain[k : k + 500]) for k in range(0, len(plain), 500)]
        flat = np.fromiter((i for ids in self._ids(joined) for i in ids), np.uint32)
        ends = np.flatnonzero(self.ends_piece[flat]) + 1
        last = ends[np.cumsum(pieces[plain]) - 1] if len(plain) else ends
        lengths[plain] = np.diff(last, prepend=0)
        starts = np.zeros(len(words), np.int64)
        starts[plain] = last - lengths[plain]
        others = np.flatnonzero(pieces == 0)
        found = self._ids([words[i] for i in others])
        lengths[others] = [len(ids) for ids in found]
        starts[others] = len(flat) + np.cumsum(lengths[others]) - lengths[others]
        rest = np.fromiter((i for ids in found for i in ids), np.uint32)
        self.starts = np.concatenate([self.starts, starts + len(self.ids)])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, flat, rest])
        self.batches = np.concatenate([self.batches, np.zeros(len(words), np.int64)])

    def _forget_rare(self) -> None:
        """Keep the words that more than one batch has asked for, or none if these are too many."""
        kept = np.flatnonzero(self.batches > 1)
        words = [w for w, n in zip(self.places, self.batches, strict=True) if n > 1]
        starts, lengths, ids = self.starts[kept], self.lengths[kept], self.ids
        self.forget()
        if len(words) <= self.most_words // 2:
            ends = np.cumsum(lengths)
            self.places.update(zip(words, range(len(words)), strict=True))
            self.ids = ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(lengths.sum())]
            self.starts, self.lengths, self.batches = ends - lengths, lengths, np.ones(len(words), np.int64)

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words of the texts in the cache, and how many words each text has.

        The words are cut and their distinct ones found by Arrow; only these pass through Python.
        """
        if len(self.places) > self.most_words:
            self._forget_rare()
        # taken as a copy: ascii_lower reads slices of large strings from the wrong place
        texts = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|")  # lower-cased, these could make a special token
        texts = pc.if_else(special, texts, pc.ascii_lower(texts))
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        known = len(self.places)
        places = np.fromiter(map(self.places.__getitem__, distinct), np.int64, len(distinct))
        if len(self.places) > known:
            self._learn(list(islice(self.places, known, None)))
        self.batches[places] += 1
        return places[words.indices.to_numpy()], pc.list_value_length(cut).to_numpy()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text."""
        if not len(texts):
            return []
        words, sizes = self._places(texts)
        lengths = self.lengths[words]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[words] - (ends - lengths), lengths)
        ids = self.ids[shift + np.arange(len(shift))]
        return np.split(ids, ends[np.cumsum(sizes)[:-1] - 1])

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of every text."""
        if not len(texts):
            return np.empty(0, np.int64)
        words, sizes = self._places(texts)
        return np.add.reduceat(self.lengths[words], np.cumsum(sizes) - sizes)


def _plain_pieces(word: str) -> int:
    """1 for letters, 2 for letters and one mark behind them, 0 for any other word.

    Letters up to U+024F other than U+0130: normalisation leaves each of these one letter.
    """
    letters = word[:-1] if word[-1:] in _MARKS else word
    if not letters.isalpha() or not letters.isascii() and (max(letters) > "\u024f" or "\u0130" in letters):
        return 0
    return 1 + (letters is not word)


class TextEncoder:
    """Ids of many texts at once, each encoded whole: for tokenizers that words cannot be told apart by."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def count(self, texts: pa.Array) -> np.ndarray:
        return np.array([len(ids) for ids in self.encode(texts)], np.int64)


#: Texts that the word encoder must give the tokenizer's own ids for. They have blanks of all
#: kinds and numbers in a row, both cases, marks, contractions, digits, other scripts and special tokens.
PROBES = (
    "Hello, World! Hello,world. HELLO  hello\nhello \n\n x", " leading and trailing ", "a\tb\x0bc\x85d\u00a0e\u2003f",
    "it's we'll don't o're 'S", "12345 1a2b 3.14, 1,000", "A B C ABC abc aBc", "É é e\u0301 \u0301x ß ẞ",
    "中文字 한국어 ΑΣ İ ǅ", "###$$$ ... a😀b", "<|endoftext|> x<|startoftext|>y", "unbelievably antidisestablishmentarianism qqqqzzzz",
)
_encoders: dict[tuple[str, int], WordEncoder | TextEncoder] = {}


def encoder(path: str, most_words: int = CACHED_WORDS) -> WordEncoder | TextEncoder:
    """The worker's encoder of a tokenizer file, by words if that gives the probes' ids; only the latest is kept."""
    if (path, most_words) not in _encoders:
        _encoders.clear()
        whole = TextEncoder(WordEncoder(path, 1).tokenizer)
        probes = pa.array([*PROBES, "\n".join(PROBES)])
        want = [ids.tolist() for ids in whole.encode(probes)]
        try:
            by_words = WordEncoder(path, most_words)
            agrees = [ids.tolist() for ids in by_words.encode(probes)] == want
        except (IndexError, ValueError):  # marks of pieces that do not add up
            agrees = False
        _encoders[path, most_words] = by_words if agrees else whole
    return _encoders[path, most_words]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Encode ids into blocks of ``BLOCK``, the last one possibly shorter."""
    n = -(-len(ids) // BLOCK)
    grid = np.pad(ids.astype(np.int64), (0, n * BLOCK - len(ids)), mode="edge").reshape(n, BLOCK)
    least = grid.min(axis=1)
    grid -= least[:, None]
    rank = max(0, -(-BLOCK * int(percentile) // 100) - 1)
    widths = _bit_length(np.partition(grid, rank, axis=1)[:, rank])
    outlier = grid >= (1 << widths)[:, None]
    packed: list[bytes] = [b""] * n
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        values = np.where(outlier[rows], 0, grid[rows]).astype("<u4")
        if width == 16:  # whole bytes
            for row, line in zip(rows.tolist(), values.astype("<u2"), strict=True):
                packed[row] = line.tobytes()
            continue
        bits = np.unpackbits(values.view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little")
        body = np.packbits(bits[:, :, :width].reshape(len(rows), -1), axis=1, bitorder="little")
        for row, line in zip(rows.tolist(), body, strict=True):
            packed[row] = line.tobytes()
    out = []
    for b in range(n):
        count = min(BLOCK, len(ids) - b * BLOCK)
        places = np.flatnonzero(outlier[b, :count])
        head = _HEAD.pack(int(least[b]), int(widths[b]), count, len(places))
        out.append(head + packed[b] + places.astype("<u2").tobytes() + grid[b, places].astype("<u4").tobytes())
    return out


def _bit_length(values: np.ndarray) -> np.ndarray:
    """Bits that a non-negative number needs, 0 for 0."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1))).astype(np.int64) + 1, 0)


def unpack_blocks(data: bytes, starts: Sequence[int]) -> np.ndarray:
    """Ids of the blocks that begin at ``starts`` in ``data``, blocks of one width together."""
    heads = [_HEAD.unpack_from(data, s) for s in starts]
    widths = np.array([h[1] for h in heads])
    grid = np.zeros((len(heads), BLOCK), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    for width in np.unique(widths).tolist():
        if not width:
            continue
        rows = np.flatnonzero(widths == width)
        size = BLOCK * width // 8
        if width == 16:
            for r in rows.tolist():
                grid[r] = np.frombuffer(data, "<u2", BLOCK, starts[r] + _HEAD.size)
            continue
        places = np.array([starts[r] + _HEAD.size for r in rows])[:, None] + np.arange(size)
        bits = np.unpackbits(raw[places], axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
        whole = np.zeros((len(rows), BLOCK, 32), np.uint8)
        whole[:, :, :width] = bits
        grid[rows] = np.packbits(whole, axis=2, bitorder="little").view("<u4")[:, :, 0]
    out = []
    for row, start, (least, width, count, outliers) in zip(grid, starts, heads, strict=True):
        at = start + _HEAD.size + BLOCK * width // 8
        places = np.frombuffer(data, "<u2", outliers, at)
        row[places] = np.frombuffer(data, "<u4", outliers, at + 2 * outliers)
        out.append(row[:count] + np.uint32(least))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


class BlockWriter:
    """One file of documents, written as a stream."""

    def __init__(self, out):
        self.out = out
        self.at = out.write(MAGIC)
        self.starts: list[int] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= RUN_BLOCKS * BLOCK:
            self._write(self.n_waiting // BLOCK * BLOCK)

    def _write(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        for i in range(0, n, RUN_BLOCKS * BLOCK):
            for block in pack_blocks(ids[i : min(i + RUN_BLOCKS * BLOCK, n)]):
                self.starts.append(self.at)
                self.at += self.out.write(block)
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.n_waiting:
            self._write(self.n_waiting)
        nulls = np.array([d is None for d in self.docs], np.uint8)
        tail = b"".join(
            (
                np.array(self.starts, "<u8").tobytes(),
                np.array([d or 0 for d in self.docs], "<i8").tobytes(),
                nulls.tobytes(),
                np.array(self.lengths, "<u8").tobytes(),
            )
        )
        self.out.write(tail)
        self.out.write(
            _FOOTER.pack(len(self.starts), len(self.docs), self.n_ids, self.at, zlib.crc32(tail), END_MAGIC)
        )
        self.out.close()


class BlockFile:
    """Reads a file of documents: its index at once, its blocks in runs or single."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        footer = source.read_at(_FOOTER.size, size - _FOOTER.size)
        blocks, docs, self.n_ids, at, crc, magic = _FOOTER.unpack(footer)
        tail = source.read_at(size - _FOOTER.size - at, at)
        if magic != END_MAGIC or source.read_at(8, 0) != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError("not a whole file of token blocks")
        self.starts = np.frombuffer(tail, "<u8", blocks).astype(np.int64)
        ids = np.frombuffer(tail, "<i8", docs, 8 * blocks).tolist()
        nulls = np.frombuffer(tail, np.uint8, docs, 8 * (blocks + docs))
        self.docs = [None if null else i for i, null in zip(ids, nulls, strict=True)]
        self.lengths = np.frombuffer(tail, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64)
        if int(self.lengths.sum()) != self.n_ids:
            raise ValueError("lengths of documents do not add up")
        self.ends = np.append(self.starts[1:], at)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks ``first`` up to, not including, ``last``, in one read."""
        if first >= last:
            return np.empty(0, np.uint32)
        base = int(self.starts[first])
        data = self.source.read_at(int(self.ends[last - 1]) - base, base)
        return unpack_blocks(data, (self.starts[first:last] - base).tolist())

    def document(self, i: int) -> np.ndarray:
        """Ids of one document, from its own blocks only."""
        start = int(self.lengths[:i].sum())
        end = start + int(self.lengths[i])
        first = start // BLOCK
        return self.blocks(first, -(-end // BLOCK))[start - first * BLOCK : end - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, int, Iterator[np.ndarray]]]:
        """(id, ids before it in the file, its length, its ids in pieces), in order; use the pieces at once."""
        run, at, block, start = np.empty(0, np.uint32), 0, 0, 0

        def pieces(n: int) -> Iterator[np.ndarray]:
            nonlocal run, at, block
            while n:
                if at == len(run):
                    last = min(block + RUN_BLOCKS, len(self.starts))
                    run, at, block = self.blocks(block, last), 0, last
                    if not len(run):
                        raise ValueError("fewer ids than the documents have")
                piece = run[at : at + n]
                at += len(piece)
                n -= len(piece)
                yield piece

        for doc_id, n in zip(self.docs, self.lengths.tolist(), strict=True):
            yield doc_id, start, n, pieces(n)
            start += n


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        target, root = fs.FileSystem.from_uri(folder)
        part, seq = TaskContext.get().partitionId(), 0
        writer, name = None, ""

        def close() -> pa.RecordBatch:
            writer.close()
            row = (part, seq, f"{folder}/{name}", len(writer.docs), writer.n_ids)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            names = ["part", "seq", "path", "documents", "ids"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in slices(batches, "text", ENCODE_CHARS):
            found = words.encode(batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.pfor"
                    writer = BlockWriter(target.open_output_stream(f"{root}/{name}"))
                writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                if writer.n_ids >= FILE_IDS or len(writer.docs) >= FILE_DOCS:
                    yield close()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield close()

    return run


def write_token_files(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the documents' ids; the stored list of files (part, seq, path, documents, ids) in their order."""
    spark = docs.sparkSession
    ship(spark)
    folder = file_folder(spark)
    target, root = fs.FileSystem.from_uri(folder)
    target.create_dir(root)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.mapInArrow(_writer(folder, tokenizer or default_tokenizer(), end_id), _MANIFEST))


def checksum(pieces: Iterator[np.ndarray]) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    crc = 0
    for piece in pieces:
        crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
    return crc


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the listed files: doc_id, start, n_tokens and ids_crc32, from the stored blocks."""
    spark = files.sparkSession
    ship(spark)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long"
    schema = arrow_schema(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, name = fs.FileSystem.from_uri(path)
                with source.open_input_file(name) as opened:
                    documents = BlockFile(opened).documents()
                    while rows := [
                        (doc_id, base + start, n, checksum(pieces))
                        for doc_id, start, n, pieces in islice(documents, READ_DOCS)
                    ]:
                        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    n = max(1, files.count())
    return based.repartitionByRange(n, "path").mapInArrow(run, ddl)
