"""Prefix encoding against the tokenizers library: pair tests, random texts, long pieces, edges, a whole table."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from skyledger.llm import prefix_bpe, queries
from skyledger.llm.common import text_bytes

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"aabcdest   '\n\t!#123", "<|endoftext|>", "'s", "'re", "é", "日", "😀", "▁", "'ſ", "　", "\x85", "\x1c", "՘", "\x00", "<|endof", "text|>"]


@pytest.fixture(scope="module")
def book():
    return prefix_bpe.PrefixBook(prefix_bpe.tables(PATH))


def library(texts, special=True):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = not special
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def own(book, texts, special=True):
    ids, bounds = book.encode(*text_bytes(pa.array(texts, pa.string())), special)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


@pytest.mark.parametrize("special", [True, False])
def test_random_texts(book, special):
    rng = random.Random(2)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(32, 126)])) for _ in range(12)) for _ in range(3000)]
    assert own(book, texts, special) == library(texts, special)


def test_long_pieces_alone_and_together(book, monkeypatch):
    rng = random.Random(3)
    texts = ["a" * 301, "ab" * 900, " " * 700, "ÃÂ" * 300, "".join(rng.choices("abcdefgh", k=3000)), "=" * 513, "x", None, ""]
    want = library(texts)
    assert own(book, texts) == want
    monkeypatch.setattr(prefix_bpe, "LONG", 1 << 20)
    book.known.clear()
    assert own(book, texts) == want


def test_pairs_are_compatible_if_their_bytes_encode_to_them(book):
    rng = np.random.default_rng(4)
    plain = [i for i in range(50256) if book.token[i].isalpha() and book.token[i].isascii()]
    x, y = rng.choice(plain, 4000), rng.choice(plain, 4000)
    tok = Tokenizer.from_file(PATH)
    want = [tok.encode((book.token[a] + book.token[b]).decode(), add_special_tokens=False).ids == [a, b] for a, b in zip(x.tolist(), y.tolist())]
    assert (prefix_bpe.first_join(book.t, x, y) == prefix_bpe.NEVER).tolist() == want and 0 < sum(want) < 4000
    assert [book.compatible(a, b) for a, b in zip(x.tolist(), y.tolist())] == want


def test_hash_collisions_do_no_harm(book, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "span_hashes", lambda data, starts, ends: np.asarray(ends - starts, dtype=np.uint64))
    texts = ["one two six <|endoftext|> ten", "one"]
    assert own(book, texts) == library(texts)


def test_columns_and_edges(spark):
    texts = ["one <|endoftext|> two", None, "", "one <|endoftext|> two"]
    docs = spark.createDataFrame([(str(i) if i else None, t, i) for i, t in enumerate(texts)], "doc_id string, text string, n_tokens int")
    coded = prefix_bpe.encode_column(docs, PATH)
    assert [r["ids"] for r in coded.orderBy("n_tokens").collect()] == library(texts)
    assert [r["decoded"] for r in prefix_bpe.decode_column(coded, PATH).orderBy("n_tokens").collect()] == [t or "" for t in texts]
    assert prefix_bpe.token_digests(docs, PATH).count() == 4 and prefix_bpe.token_digests(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        prefix_bpe.encode_column(docs, PATH, ids_col="text")
    broken = spark.createDataFrame([([0xC3, 72],)], "ids array<int>")
    assert prefix_bpe.decode_column(broken, PATH).first()["decoded"] == Tokenizer.from_file(PATH).decode([0xC3, 72], skip_special_tokens=False)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    tok = Tokenizer.from_file(PATH)
    want = {}
    for d, ids in zip(docs, library([d["text"] for d in docs])):
        back = tok.decode(ids, skip_special_tokens=False)
        want[d["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_prefix_bpe(spark, SF).collect()} == want
