import io
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyarrow import PythonFile
from tokenizers import Tokenizer

from tallyforge.llm import token_counts, token_files
from tallyforge.llm.encode import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "It's CAN'T we'll 'S", "12 345.6 é é", "x" * 300, "<|endoftext|> x<|startoftext|>y", "a\xa0b\x85c\x1cd", "ÀÉ×ß ª²½", "한국어 テスト", "Σας ΟΔΟΣ İ", "", " \n\t"]


def ids(text, special=True):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = not special
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_is_the_library():
    r = random.Random(1)
    letters = [chr(c) for c in range(256)] + ["'s", "'LL", " ", " "]
    for special in (True, False):
        encoder = Encoder(PATH, special)
        for text in ODD + ["".join(r.choice(letters) for _ in range(40)) for _ in range(300)]:
            assert np.frombuffer(encoder.ids(text), "<u4").tolist() == ids(text, special), text


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_frames_index_and_checksums(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_TOKENS", 50)
    out, close = io.BytesIO(), []
    out.close = lambda: close.append(1)
    writer = token_files.Writer(out)
    r = np.random.default_rng(3)
    docs = [(None if i == 3 else i, r.integers(0, 50_000, n).astype("<u4")) for i, n in enumerate([0, 1, 30, 30, 200, 5, 49, 1])]
    for key, values in docs:
        writer.add(key, values.tobytes())
    writer.close()
    data = out.getvalue()
    reader = token_files.Reader(Source(data))
    assert len(reader.frames) > 3
    assert [(p, k, v.tolist()) for p, k, v in reader.documents()] == [(i, k, v.tolist()) for i, (k, v) in enumerate(docs)]
    read = []
    frame = reader.frame
    monkeypatch.setattr(reader, "frame", lambda k: read.append(k) or frame(k))
    assert [v.tolist() for _, _, v in reader.documents({4})] == [docs[4][1].tolist()] and len(read) == 1
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    assert plain.read(4 * 31) == b"".join(v.tobytes() for _, v in docs[:3])
    broken = bytearray(data)
    broken[int(reader.offsets[1]) + 9] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.Reader(Source(bytes(broken))).documents())
    assert PythonFile is not None


def test_written_and_read_again(spark, table_of):
    rows = [(i * 7 % 101, t) for i, t in enumerate(ODD * 3)] + [(None, "n"), (5, None), (5, "again")]
    found = token_files.read(token_files.write(table_of(rows, "doc_id long, text string"), PATH, 1)).collect()
    found.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    assert found[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))
    want = [(k, len(v) + 1, zlib.crc32(np.array([*v, 1], "<u4").tobytes())) for k, v in ((k, ids(t or "")) for k, t in rows)]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found), key=repr) == sorted(want, key=repr)
    empty = table_of([], "doc_id long, text string")
    assert token_files.read(token_files.write(empty, PATH, 1)).count() == 0


def test_token_counts_across_blocks(spark, table_of):
    rows = [(i, t) for i, t in enumerate([*ODD, "long " * 900, None, ""])] + [(3, "x y"), (None, "x")]
    docs = table_of(rows, "doc_id long, text string")
    want = sorted(((k, len(ids(t or "", special=False))) for k, t in rows), key=repr)
    assert sorted(map(tuple, token_counts.count_documents(docs, PATH, 49407).collect()), key=repr) == want
    names = token_counts.write_flat(docs, PATH, 49407)
    for block in (2, 6, 1001):
        counted = token_counts.count(names.select("file").distinct(), 49407, block)
        met = counted.join(names, ["file", "place"]).select("key", "n_tokens")
        assert sorted(map(tuple, met.collect()), key=repr) == want
    assert token_counts.count_documents(docs.where("false"), PATH, 49407).count() == 0


def test_small_caches_give_the_same_ids(monkeypatch):
    from tallyforge.llm import encode

    monkeypatch.setattr(encode, "KNOWN_PIECES", 5)
    monkeypatch.setattr(encode, "KNOWN_TEXTS", 300)
    monkeypatch.setattr(encode, "LONG_TEXT", 90)
    encoder, plain = encode.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["The cat's mat", "naïve façade", "", "x" * 80 + " y", "a b c d e f g h i j", "日本 text", "<s> mark", "long " * 40]
    for _ in range(3):
        for text in texts:
            assert np.frombuffer(encoder.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) < 60 and encoder.held <= 300 + 500


def test_a_worker_keeps_its_encoder():
    from tallyforge.llm import encode

    assert encode.worker_encoder(PATH) is encode.worker_encoder(PATH) is not encode.worker_encoder(PATH, False)
