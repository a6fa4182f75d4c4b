import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from narrata.llm import tokenfile
from tests.llm.helpers import documents, no_docs, odd_docs


def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 2]


def test_round_trip_equals_the_library(spark, tmp_path):
    encode, start = library(), 0
    got = {r["doc_id"]: r for r in tokenfile.token_file_digest(documents(spark), str(tmp_path / "t")).collect()}
    for r in documents(spark).orderBy("doc_id").collect():
        ids = np.array(encode(r["text"]), "<u4")
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pieces_join_to_what_the_library_gives():
    import random

    rng, encode, own = random.Random(2), library(), tokenfile.Encoder(tokenfile.default_tokenizer())
    letters = "ab Z9 \n\t  .,'s\x1c\x85\xa0é漢<|endoftext|> "
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert own.encode([text])[0].tolist() == encode(text), repr(text)
    for text in ("hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|ENDOFTEXT|> a"):
        assert own.encode(["before", text, "after"])[1].tolist() == encode(text)


def test_planes_and_chunk_index(monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 100)
    ids = np.arange(0, 7_000_000, 20_011, dtype="<u4")
    data, sizes = tokenfile.pack_planes(ids)
    assert sum(sizes) == len(data) and len(sizes) == 4 * -(-len(ids) // 100)
    assert (tokenfile.unpack_planes(data, sizes) == ids).all()
    assert (tokenfile.unpack_planes(data, sizes, 1, 3) == ids[100:300]).all()
    assert len(tokenfile.unpack_planes(b"", [])) == 0


def test_odd_rows_and_small_segments(spark, tmp_path, monkeypatch):
    got = tokenfile.token_file_digest(odd_docs(spark), str(tmp_path / "a")).orderBy("start").collect()
    assert len(got) == 15 and [r["doc_id"] for r in got][:2] == [None, None]
    assert [r["start"] for r in got] == list(np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1])
    assert all(r["n_tokens"] == 1 and r["ids_crc32"] == zlib.crc32(b"\x02\0\0\0") for r in got if r["doc_id"] in (0, 1))
    assert tokenfile.token_file_digest(no_docs(spark), str(tmp_path / "b")).count() == 0
