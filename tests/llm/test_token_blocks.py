import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from runout.llm import token_blocks as B


def packed(ids, percentile=B.PERCENTILE):
    blocks = B.pack_blocks(np.asarray(ids, np.uint32), percentile)
    data = b"".join(blocks)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].tolist()
    return data, B.unpack_blocks(data, starts)


@pytest.mark.parametrize("percentile", [0, 50, 90, 100])
@pytest.mark.parametrize("kind", ["one", "equal", "small", "wide", "outliers", "extreme", "short"])
def test_blocks_round_trip(kind, percentile):
    rng = np.random.default_rng(3)
    n = 5 * B.BLOCK + 17
    ids = {
        "one": np.array([7]),
        "equal": np.full(n, 49407),
        "small": rng.integers(0, 2, n),
        "wide": rng.integers(0, 1 << 32, n),
        "outliers": np.where(rng.random(n) < 0.03, rng.integers(0, 1 << 32, n), rng.integers(100, 200, n)),
        "extreme": np.array([0, (1 << 32) - 1] * 600),
        "short": rng.integers(0, 50_000, 13),
    }[kind]
    _, got = packed(ids, percentile)
    assert np.array_equal(got, ids.astype(np.uint32))


def test_outliers_cost_less_than_a_wider_block():
    ids = np.where(np.arange(4 * B.BLOCK) % 100 == 0, 1 << 30, np.arange(4 * B.BLOCK) % 64)
    assert len(packed(ids)[0]) < 0.4 * len(packed(ids, 100)[0])


def test_files_give_single_documents_and_refuse_damage(tmp_path):
    rng = np.random.default_rng(1)
    docs = [(i if i != 4 else None, rng.integers(0, 50_000, n).astype(np.uint32)) for i, n in enumerate([1, 5000, 0, 300_000, 2, 1024])]
    local = fs.LocalFileSystem()
    path = str(tmp_path / "x.pfor")
    writer = B.BlockWriter(local.open_output_stream(path))
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    with local.open_input_file(path) as f:
        file = B.BlockFile(f)
        assert file.docs == [0, 1, 2, 3, None, 5]
        for i, (_, ids) in enumerate(docs):
            assert np.array_equal(file.document(i), ids)
        for (doc_id, _, n, pieces), (want, ids) in zip(file.documents(), docs, strict=True):
            assert doc_id == want and n == len(ids)
            assert np.array_equal(np.concatenate([*pieces, np.empty(0, np.uint32)]), ids)
    data = bytearray((tmp_path / "x.pfor").read_bytes())
    data[-60] ^= 1
    with pytest.raises(ValueError):
        B.BlockFile(pa.BufferReader(bytes(data)))


TEXTS = [
    "", " ", "\n\n", "Hello, World! it's we'll 'S", "ÉÀ é\u0301 e\u0301\n \u0301x", "a\tb\x0bc\x85d\u00a0e\u2003f",
    "<|endoftext|> x<|startoftext|>y", "ΑΣ ΣΑΣ İstanbul ǅ", "中文字 한국어", "12345 1a2b", "don't o're. A,b x.. Ü, \u01c5. <|ENDOFTEXT|> ª º ʰ. ǆ! ᄒ\u1161\u11ab. ﬁ, Ⅷ", "###$$$ ... 😀😀 a😀b", "x" * 3000,
]


def test_words_give_the_ids_of_whole_texts(monkeypatch):
    encoder = B.WordEncoder(B.default_tokenizer())
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    for bound in (600_000, 1):
        monkeypatch.setattr(B, "CACHED_WORDS", bound)
        assert [encoder.encode(pa.array([t]))[0].tolist() for t in [*TEXTS, *TEXTS]] == [*whole, *whole]
        assert [ids.tolist() for ids in encoder.encode(pa.array([*TEXTS, *TEXTS]))] == [*whole, *whole]
        assert encoder.count(pa.array(TEXTS)).tolist() == list(map(len, whole))
    for i in range(len(TEXTS)):
        for kind in (pa.string(), pa.large_string()):
            got = encoder.encode(pa.array([*TEXTS, None], kind).slice(i))
            assert [ids.tolist() for ids in got] == [*whole[i:], []]
    assert encoder.encode(pa.array([None], pa.string()))[0].tolist() == []
    assert encoder.encode(pa.array([], pa.string())) == []


def test_words_stay_right_after_rare_ones_are_forgotten(monkeypatch):
    monkeypatch.setattr(B, "CACHED_WORDS", 40)
    encoder = B.WordEncoder(B.default_tokenizer())
    for i in range(60):
        texts = [f"common words here wordno{i} x{i * i}", f"again common other{i % 7}, ende"]
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids.tolist() for ids in encoder.encode(pa.array(texts))] == want
    assert "common" in encoder.places and len(encoder.places) < 60


def test_documents_come_back_in_order(spark, edge):
    got = B.read_token_files(B.write_token_files(edge)).collect()
    encoder = B.WordEncoder(B.default_tokenizer())
    want = sorted(
        (-1 if r.doc_id is None else r.doc_id, zlib.crc32(np.append(encoder.encode(pa.array([r.text], pa.string()))[0], 2).astype("<u4").tobytes()))
        for r in edge.collect()
    )
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    assert B.read_token_files(B.write_token_files(edge.where("false"))).count() == 0


@pytest.mark.parametrize(("ids", "docs", "read"), [(200, 10**6, 10_000), (1 << 27, 3, 2), (1, 10**6, 1)])
def test_files_are_cut_by_size(spark, monkeypatch, ids, docs, read):
    """Several files a task, empty texts among them, and several batches a file."""
    monkeypatch.setattr(B, "FILE_IDS", ids)
    monkeypatch.setattr(B, "FILE_DOCS", docs)
    monkeypatch.setattr(B, "READ_DOCS", read)
    rows = [(i, "" if i % 3 else f"some words of document {i} " * (i % 7)) for i in range(60)]
    files = B.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"))
    listed = files.collect()
    assert len(listed) > len({r.part for r in listed}) and sum(r.documents for r in listed) == 60
    assert all(r.documents <= docs for r in listed)
    got = sorted(B.read_token_files(files).collect(), key=lambda r: r.start)
    encoder = B.WordEncoder(B.default_tokenizer())
    want = [np.append(x, 2).astype("<u4") for x in encoder.encode(pa.array([t for _, t in rows]))]
    assert [r.doc_id for r in got] == list(range(60))
    assert [r.ids_crc32 for r in got] == [zlib.crc32(x.tobytes()) for x in want]
    assert [r.start for r in got] == [0, *np.cumsum([len(x) for x in want])[:-1].tolist()]


def test_tokenizers_that_join_words_encode_whole_texts():
    """Any tokenizer file gives its own ids, whether its words can be told apart or not."""
    kinds = set()
    for path in sorted(Path(B.default_tokenizer()).parent.glob("*.json")):
        try:
            tokenizer = Tokenizer.from_file(str(path))
        except Exception:  # noqa: BLE001 - a file of another kind
            continue
        found = B.encoder(str(path), 1000)
        kinds.add(type(found))
        texts = [*TEXTS, *B.PROBES]
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids.tolist() for ids in found.encode(pa.array(texts))] == want
        assert found.count(pa.array(texts)).tolist() == list(map(len, want))
    assert B.WordEncoder in kinds
    assert isinstance(B.encoder(B.default_tokenizer()), B.WordEncoder)
    whole = B.TextEncoder(Tokenizer.from_file(B.default_tokenizer()))
    assert [ids.tolist() for ids in whole.encode(pa.array(["x y", None], pa.string()))][1] == []
