"""Alignment of two tokenizers against plain Python on the libraries' own tokens."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skyledger.llm import align, prefix_bpe, queries

SF = "/root/testdata/sf0.01"
MERGES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*"aabcdest   '\n\t!#123", "<|endoftext|>", "'s", "é", "日", "😀", "▁", "　", "\x85", "\x00", "<s>", "<0x0A>"]


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(MERGES)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=PIECES), prefix_bpe.byte_chars()


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(prefix_bpe.PrefixBook(prefix_bpe.tables(MERGES)), align.PieceBook(PIECES))


def plain(text, libraries):
    """n_a, n_b, n_groups, links and groups by walking the bytes."""
    tok, model, byte_of = libraries
    if not text:
        return 0, 0, 0, [], ""
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    a_bytes = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return 0, 0, 0, [], ""
    of_a = [k for k, t in enumerate(a_bytes) for _ in t]
    of_b = [k for k, t in enumerate(b_bytes) for _ in t]
    links = sorted(set(zip(of_a, of_b)))
    groups = []
    for at in range(len(of_a)):
        if at == 0 or of_a[at] != of_a[at - 1] and of_b[at] != of_b[at - 1]:
            groups.append(([], []))
        for own, ids, of in ((groups[-1][0], a, of_a), (groups[-1][1], b, of_b)):
            if at == 0 or of[at] != of[at - 1]:
                own.append(ids[of[at]])
    written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return len(a), len(b), len(groups), [(a[i], b[j]) for i, j in links], written


def test_random_texts(aligner, libraries):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(1500)] + [None, "", " ", "  ", "a ", "a" * 2000, "xyz qq" * 900, "x▁", "é"]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(32, 126)])) for _ in range(12)) for _ in range(1500)]
    found = aligner.align(pa.array(texts, pa.string()))
    links = [[] for _ in texts]
    for t, a, b in zip(found["text"].tolist(), found["a"].tolist(), found["b"].tolist()):
        links[t].append((a, b))
    for i, text in enumerate(texts):
        want = plain(text, libraries)
        got = *(int(found[c][i]) for c in ("n_a", "n_b", "n_groups")), sorted(links[i]), found["groups"][i].decode()
        assert got == (*want[:3], sorted(want[3]), want[4]), text


@pytest.mark.parametrize("first,entry", [(1, 3), (4, 1 << 20), (64, 5)])
def test_walks_of_any_probe_and_entry(monkeypatch, first, entry):
    monkeypatch.setattr(align, "FIRST", first)
    monkeypatch.setattr(align, "ENTRY", entry)
    rng = np.random.default_rng(6)
    n, docs = 4000, 12
    bounds = np.unique(np.concatenate(([n], rng.choice(n - 1, docs - 1, replace=False) + 1)))
    a = np.unique(np.concatenate((bounds, rng.choice(n, n // 3) + 1)))
    b = np.unique(np.concatenate((bounds, a[a > n // 2][::2], rng.choice(n, n // 5) + 1)))
    a_first, b_first = (np.searchsorted(x, np.concatenate(([0, 0], bounds)), side="right") for x in (a, b))
    a_cut, b_cut, i, j = align.aligned(a, b, a_first, b_first)
    assert (a_cut == np.isin(a, b)).all() and (b_cut == np.isin(b, a)).all()
    ends = np.union1d(a, b)
    assert sorted(zip(i.tolist(), j.tolist())) == list(zip(np.searchsorted(a, ends).tolist(), np.searchsorted(b, ends).tolist()))


def expected(docs, libraries):
    found = {k: plain(t, libraries) for k, t in docs}
    counts = collections.Counter(l for *_, links, _ in found.values() for l in links)
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return counts, {k: (x, y, g, len(links), sum(counts[l] == most[l[1]] for l in links), sum(counts[l] for l in links), hashlib.sha256(w.encode()).hexdigest() if w else "") for k, (x, y, g, links, w) in found.items()}


def test_whole_table(spark, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    _, want = expected(docs, libraries)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in queries.op11_alignment(spark, SF).collect()}
    assert got == want


def test_edges_and_small_blocks(spark, libraries):
    texts = ["the tokens of unalikely words", None, "", "a ▁ b", "the tokens", "the tokens", "x" * 5000, "naïve 日本\n\n"]
    docs = spark.createDataFrame([(f"d{i}", t, i, i) for i, t in enumerate(texts)], "doc_id string, text string, n int, block int").repartition(2)
    counts, want = expected([(f"d{i}", t) for i, t in enumerate(texts)], libraries)
    for size in (1, 1 << 20):
        got = {r["doc_id"]: tuple(r)[1:] for r in align.alignment(docs, MERGES, PIECES, block_text=size).collect()}
        assert got == want
    assert {(r["a"], r["b"]): r["n"] for r in align.links(docs, MERGES, PIECES).collect()} == dict(counts)
    assert align.alignment(docs.limit(0), MERGES, PIECES).count() == 0
    null_id = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r["n_links"] for r in align.alignment(null_id, MERGES, PIECES).collect()] == [2, 2]
