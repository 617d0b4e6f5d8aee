"""The ten operators against brute force on small tables, with null, empty, repeated and clashing input."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from skyledger.llm import bpe, common, decontaminate, kneser_ney, langid, neardup, queries, repeats, rules, sharding, simhash, substring, suffix_array, urls
from skyledger.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def docs_of(spark, texts, **more):
    rows = [(i, t, *[v[i % len(v)] for v in more.values()]) for i, t in enumerate(texts)]
    kinds = {"lang": "string", "source": "string", "node": "int", "doc": "int", "text_crc32": "int", "size_": "int"}
    schema = "doc_id long, text string" + "".join(f", {k} {kinds.get(k, 'string')}" for k in more)
    return spark.createDataFrame(rows, schema).repartition(3)


def sample_texts(seed=3, n=60, letters="abcdefgh", words=40):
    rng = random.Random(seed)
    out = [None, "", " \n\t ", "x"]
    while len(out) < n:
        w = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(words))]
        old = rng.choice(out)
        if old and rng.random() < 0.6:
            o = old.split()
            a = rng.randrange(len(o) + 1)
            w = w[:8] + o[a:] + w[8:]
        out.append(rng.choice([" ", "\n ", "\t"]).join(w))
    return out + [out[5], out[5]]


# 1

def test_simhash_classes_are_those_of_all_pairs(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = list({b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(60)}) + [0]
    f = np.array(fps, dtype=np.uint64)
    nodes = spark.createDataFrame([(int(x), int(x)) for x in f.view(np.int64)], "fp long, node long")
    for short_list, most in ((48, 1 << 16), (2, 1 << 16), (48, 20), (2, 5)):
        got = {r["node"]: r["component"] for r in components(simhash.links(nodes, 3, short_list, most)).collect()}
        near = np.bitwise_count(f[:, None] ^ f[None]) <= 3
        label = f.view(np.int64).copy()
        while True:
            new = np.where(near, label[None], 2**63 - 1).min(axis=1)
            if (new == label).all():
                break
            label = new
        assert {int(n): got.get(int(n), int(n)) for n in f.view(np.int64)} == dict(zip(f.view(np.int64).tolist(), label.tolist()))


def test_long_lists_by_flipping_bits(monkeypatch):
    monkeypatch.setattr(simhash, "FLIPS", 1)
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 12, 900).astype(np.uint64))
    node = np.arange(len(fp))
    pairs = {(int(a), int(b)) for x, y in simhash.forest(fp, node, 2) for a, b in zip(np.minimum(x, y), np.maximum(x, y))}
    want = {(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if np.bitwise_count(fp[i] ^ fp[j]) <= 2}
    assert pairs == want


def test_fingerprint_is_the_contract(spark):
    texts = ["The quick  brown\nFox jumps", "É a b É", "one two", "one", "", None]
    got = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(docs_of(spark, texts), 3).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        g = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        votes = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in g) for b in range(64)]
        assert got[i] & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * votes[b] > len(g))
    assert {r["component_id"] for r in simhash.classes(docs_of(spark, texts)).where("fp = 0").collect()} == {4}


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = ["w%d" % rng.randrange(4000) for _ in range(400)]
    near = list(words)
    near[50] = near[300] = "changed"
    far = ["v%d" % rng.randrange(4000) for _ in range(400)]
    table = docs_of(spark, [" ".join(words), " ".join(near), " ".join(far), None, "", " ".join(far), "a b"], node=[1], lang=["en"])
    kept = neardup.deduplicated(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 6]
    assert neardup.deduplicated(table.unionByName(table)).count() == 4
    assert neardup.deduplicated(table.withColumn("doc_id", F.when(F.col("doc_id") > 1, F.col("doc_id")))).count() == 5
    assert neardup.deduplicated(table.limit(0)).count() == 0 and simhash.classes(table.limit(0)).count() == 0


def five_word_classes(texts):
    """Classes of the texts by all pairs: 0.8 or more of their five-word shingles in common."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    name = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            old, new = max(name[i], name[j]), min(name[i], name[j])
            name = [new if x == old else x for x in name]
    return name


def test_near_duplicates_of_every_length_and_kind_of_edit(spark):
    rng = random.Random(8)
    texts = [None, "", " \n"]
    for n in (6, 9, 14, 25, 40, 80, 300, 1500):
        for _ in range(6):
            w = ["w%d" % rng.randrange(3000) for _ in range(n)]
            more = ["v%d" % rng.randrange(3000) for _ in range(n)]
            texts.append(" ".join(w))
            texts.append(" ".join(w + more[: n // 6]))
            texts.append(" ".join(w[: n - n // 7]))
            texts.append(" ".join(more[: n // 8] + w))
            texts.append(" ".join(more[i] if i % 40 == 7 else x for i, x in enumerate(w)))
            texts.append(" \t".join(w).upper())
    got = {r["doc_id"]: r["component_id"] for r in neardup.similar(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == five_word_classes(texts)


@pytest.mark.parametrize("part,pairs", [(1024, 1 << 15), (4, 7)])
def test_near_duplicates_of_large_groups(spark, monkeypatch, part, pairs):
    """Chains of copies of copies: most are alike to a few of their group only, and unlike its middle."""
    monkeypatch.setattr(neardup, "PART", part)
    monkeypatch.setattr(neardup, "PAIRS", pairs)
    rng = random.Random(9)
    texts = []
    for _ in range(3):
        w = ["w%d" % rng.randrange(5000) for _ in range(120)]
        for _ in range(30):
            texts.append(" ".join(w))
            at = rng.randrange(115)
            w = w[:at] + ["v%d" % rng.randrange(5000)] + w[at + 1 :] if rng.random() < 0.8 else w[6:] + ["u%d" % rng.randrange(5000) for _ in range(6)]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["component_id"] for r in neardup.similar(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == five_word_classes(texts)


def test_parities_tell_pairs_apart():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in rng.integers(1, 900, 40)]
    bits = [neardup.parity(x) for x in sets]
    many = neardup.Parities(bits)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    got = many.differing(i, j)
    assert got.tolist() == [neardup.differing(bits[x], bits[y]) for x, y in zip(i, j)]
    assert all(d <= len(np.setxor1d(sets[x], sets[y])) for d, x, y in zip(got, i, j))


def test_groups_over_batches():
    rows = [(1, 5, b"a"), (1, 6, b"b"), (2, 7, b"c"), (3, 8, b"d"), (3, 9, b"e"), (3, 1, b"f"), (4, 2, b"g")]
    for n in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + n])], names=["k", "v", "w"]) for i in range(0, 7, n)]
        got = [list(zip(k.tolist(), v.tolist(), w)) for k, v, w in neardup.whole_groups(batches, ["k", "v", "w"])]
        assert sum(got, []) == rows and all(x[-1][0] != y[0][0] for x, y in zip(got, got[1:]))


def test_second_round_gives_few_pairs(spark):
    """Texts with one shingle in five in common all meet in lists, and are told apart there."""
    rng = random.Random(10)
    common_part = " ".join("c%d" % i for i in range(14))
    texts = [common_part + " " + " ".join("w%d" % rng.randrange(10**6) for _ in range(40)) for _ in range(300)]
    docs = docs_of(spark, texts).select(F.col("doc_id").alias("node"), "text")
    shared = neardup.stored(neardup.sharing(docs, 5, 0.8, (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))))
    sets = neardup.shingle_sets(pa.array(texts), 5)
    nodes = spark.createDataFrame([(i, len(x).to_bytes(8, "little") + neardup.parity(x)) for i, x in enumerate(sets)], "node long, bits binary")
    lists = shared.where("key is not null")
    assert lists.groupBy("key").count().agg(F.max("count")).first()[0] > 20
    assert neardup.still_apart(lists, spark.createDataFrame([], "node long, component long"), nodes, 0.8).count() == 0


# 2

def test_language_held_out_accuracy(spark):
    rows = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = rows.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.98 * n


def test_language_edges(spark):
    docs = docs_of(spark, ["the cat and the dog"] * 5 + ["le chat et le chien"] * 5 + [None, "", "123 !?"], lang=["en"] * 5 + ["fr"] * 5 + ["en", None, None], score=["x"])
    model = langid.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["accepted"]) for r in langid.predictions(docs, model).collect()}
    assert got[0][0] == "en" and got[7][0] == "fr" and [got[i] for i in (10, 11, 12)] == [("und", False)] * 3
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 10
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predictions(docs, none).collect()} == {"und"}
    assert langid.predictions(docs.limit(0), model).count() == 0


def test_language_rejects_what_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("lang is not null and text is not null")
    rng = random.Random(6)
    junk = docs_of(spark, [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(60)) for _ in range(100)])
    for out in ("de", "es"):
        learned, other = docs.where(F.col("lang") != out), docs.where((F.col("lang") == out) & (F.length("text") > 200))
        model = langid.fit(learned)
        assert langid.accepted(other, model).count() <= 0.1 * other.count()
        assert langid.accepted(junk, model).count() == 0
        assert langid.accepted(learned, model).count() >= 0.985 * learned.count()


# 3

def test_urls(spark):
    rows = [(1, None, None), (2, "abc", ""), (3, "HTTP://A.Example.COM/en/77?x", '<a href="http://b.example.org/es/1">'), (4, "x://b.example.org?q", "<A HREF=//c.net/>"), (5, "x://y://z/", ""), (6, "h://example.net/de/8", ""), (7, "h://a.net/de/9#f", ""), (8, "h://notcom/en/1", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(pages).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/en/77", "example.com/en/7", "allow")
    assert got[4][:3] == ("b.example.org", "", None) and got[5][:2] == ("y:", "//z/")
    assert got[6] == ("example.net", "/de/8", "example.net/de/8", "block") and got[7] == ("a.net", "/de/9", "net/de/", "block") and got[8][2] is None
    assert urls.judged(pages.limit(0)).count() == 0 and urls.judged(pages.unionByName(pages)).count() == 16


def test_rules_of_the_contract(spark):
    urls_ = ["h://a.com/en/1", "h://example.com/en/77", "h://a.net/de/9", "h://b.example.net/de/80", "h://c.org/es/"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls_)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judged(pages).collect()}
    assert got == {0: ("com/en/", "block"), 1: ("example.com/en/7", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: ("org/es/", "block")}


def test_common_shingles_are_counted_over_all_texts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COUNTED", 60)
    rng = random.Random(4)
    texts = [" ".join([f"w{i} x y z"] + [f"often{k} a{k} b{k}" for k in range(12) if rng.random() < 0.01 * k]) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(5)
    n = collections.Counter(h for own in neardup.shingle_sets(pa.array(texts), 3) for h in own.tolist())
    want = {h: k for h, k in n.items() if k >= 20}
    hashes, rank = neardup.common_shingles(docs, 3, len(texts))
    assert set(hashes.tolist()) == set(want) and len(want) > 3
    assert [h for _, h in sorted(zip(rank.tolist(), hashes.tolist()), reverse=True)] == [h for h, _ in sorted(want.items(), key=lambda x: (-x[1], x[0] - (x[0] >> 63 << 64)))]
    assert len(neardup.common_shingles(docs.limit(0), 3, 0)[0]) == 0


def test_trust_against_dense_iteration(spark):
    edges = [("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", 2.0), ("d", "a", 1.0)]
    seeds = [("a", 3, 0, 4), ("c", 0, 5, 6)]
    got = {r["host"]: (r["trusted"], r["distrusted"]) for r in urls.spread(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, allowed long, blocked long, pages long")).collect()}
    names = "abcd"
    w = np.zeros((4, 4))
    for x, y, v in edges:
        w[names.index(x), names.index(y)] = v
    ahead = np.divide(w, w.sum(1, keepdims=True), out=np.zeros_like(w), where=w.sum(1, keepdims=True) > 0)
    back = np.divide(w.T, w.T.sum(1, keepdims=True), out=np.zeros_like(w), where=w.T.sum(1, keepdims=True) > 0)

    def run(seed, m):
        x = np.array(seed, dtype=float)
        for _ in range(urls.ROUNDS):
            x = (1 - urls.DAMPING) * np.array(seed) + urls.DAMPING * x @ m
        return x

    t, d, p, q = run([3, 0, 0, 0], ahead), run([0, 0, 5, 0], back), run([4, 0, 6, 0], ahead), run([4, 0, 6, 0], back)
    for i, n in enumerate(names):
        assert got[n] == pytest.approx((t[i] / p[i] if p[i] else 0, d[i] / q[i] if q[i] else 0))


# 4

def kneser_ney_by_dicts(trusted, texts, order=5):
    """Perplexities by plain dictionaries: interpolated modified Kneser-Ney over characters."""
    white = re.compile("[\x20\xa0\x09-\x0d]+")

    def padded(t):
        return "\x02" * (order - 1) + white.sub(" ", t)

    top = collections.Counter(padded(t)[i - order + 1 : i + 1] for t in trusted for i in range(order - 1, len(padded(t))))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])
    taken = {}
    for k, level in levels.items():
        n = [sum(1 for v in level.values() if v == i) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) if n[i] else (i + 1) * 0.5 for i in range(3)]
        taken[k] = lambda v, d=d: d[min(v, 3) - 1]
    total, left = {k: collections.Counter() for k in levels}, {k: collections.Counter() for k in levels}
    for k, level in levels.items():
        for g, v in level.items():
            total[k][g[:-1]] += v
            left[k][g[:-1]] += taken[k](v)

    def p(gram):
        k, c = len(gram), gram[:-1]
        if not k:
            return 1 / (len(levels[1]) + 1)
        if not total[k][c]:
            return p(gram[1:])
        v = levels[k].get(gram, 0)
        return (v - taken[k](v) if v else 0) / total[k][c] + left[k][c] / total[k][c] * p(gram[1:])

    out = []
    for t in texts:
        w = padded(t or "")
        logs = [np.log(p(w[i - order + 1 : i + 1])) for i in range(order - 1, len(w))]
        out.append(float(np.exp(-np.mean(logs))) if logs else None)
    return out, p, levels[1]


def test_kneser_ney_is_the_dictionaries(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    texts = [None, "", "zzzz", "a\u00a0 \n b"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(80)]
    docs = docs_of(spark, texts, lang=["en", None], h=["clash"], block=[1], rows=["clash"])
    trusted = list(range(4, 60))
    want, p, chars = kneser_ney_by_dicts([texts[i] for i in trusted], texts)
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    model = kneser_ney.train(rows.where(F.col("id").isin(trusted)))
    for block_text in (1 << 20, 200):
        got = {r["id"]: r["perplexity"] for r in kneser_ney.perplexities(rows, model, block_text).collect()}
        assert [got[i] for i in range(len(texts))] == [x if x is None else pytest.approx(x, rel=1e-5) for x in want]
    for context in ("", "a", "ab", "\x02\x02\x02\x02", "abcd", "zzz"):
        assert sum(p(context + c) for c in chars) + p(context + "?") == pytest.approx(1)


def test_kneser_ney_edges(spark):
    texts = ["abcab cab abc", "bca bca", "zzzz", None, "", "abc abc"] * 12
    docs = docs_of(spark, texts, lang=["en", None], h=["clash"])
    trusted = docs.where("text like '%abc%' or text like 'bca%'").select("doc_id")
    got = {r["doc_id"]: (r["perplexity"], r["kept"]) for r in kneser_ney.judged(docs, trusted).collect()}
    assert got[3] == got[4] == (None, False) and got[2][0] > got[0][0] and not got[2][1]
    assert kneser_ney.judged(docs.unionByName(docs), trusted).count() == 144
    assert kneser_ney.judged(docs.limit(0), trusted).count() == 0 and kneser_ney.judged(docs, trusted.limit(0)).where("kept").count() > 0


# 5

def test_shards(spark):
    for n, bits in ((2, 3), (3, 4)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        order = np.argsort(sharding.hilbert_index(points, bits))
        assert sorted(sharding.hilbert_index(points, bits)) == list(range(len(points))) and np.abs(np.diff(points[order], axis=0)).sum(1).max() == 1
    docs = docs_of(spark, sample_texts(n=100), lang=["en", None, "fr"], source=["a"] * 5 + ["b"], cell=["clash"])
    got = sharding.assign(docs, 7).collect()
    counts = collections.Counter(r["shard"] for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 16, zlib.crc32(text[r["doc_id"]])) for r in got)
    assert sharding.assign(docs.limit(0), 7).count() == 0
    again = {r["doc_id"]: r["shard"] for r in sharding.assign(docs.repartition(5), 7).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in got}


def test_shard_files(spark, tmp_path):
    docs = docs_of(spark, sample_texts(n=40), lang=["en", "fr"], source=["a"])
    sharding.write_shards(docs.unionByName(docs.limit(3)), str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() + 3 and {r["shard_id"] for r in back.select("shard_id").distinct().collect()} == set(range(5))


# 6

def test_bpe_is_tiktoken(spark):
    import public_tokenizers
    import tiktoken

    path = queries.rank_file()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(1)
    texts = [None, "", "a'tis 's don't  x\n\n y  z '' 'll'", "日本語 ١٢٣ ²½ 🎉🎉", "aaaaaaaaaaaaa" * 50, "\x00\xff", "<|endoftext|>"]
    texts += ["".join(rng.choice(" 'strevldm\n\t 　é1½日!\"") for _ in range(rng.randrange(30))) for _ in range(3000)]
    docs = docs_of(spark, texts, ids=["clash"])
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_column(docs, path).collect()}
    assert all(got[i] == own.encode_ordinary(t or "") for i, t in enumerate(texts))
    back = bpe.decode_column(bpe.encode_column(docs, path), path)
    assert back.where("decoded <> coalesce(text, '')").count() == 0
    digest = {r["doc_id"]: r for r in bpe.token_digests(docs, path).collect()}
    ids = np.array(own.encode_ordinary(texts[2]), dtype="<u4").tobytes()
    assert (digest[2]["n_tokens"], digest[2]["ids_sha256"], digest[2]["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[2].encode()).hexdigest())
    assert digest[0]["n_tokens"] == 0 and bpe.token_digests(docs.limit(0), path).count() == 0


# 7 and 8

def brute_words(rows, n):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w, gone = WORD.findall(t or ""), set()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            gone |= set(range(i, i + n)) if k in seen else set()
            seen.add(k)
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("letters,words", [("abcdefgh", 40), ("a", 60), ("ab", 50)])
def test_repeated_words(spark, letters, words):
    texts = sample_texts(letters=letters, words=words)
    docs = docs_of(spark, texts, doc=[1], spans=["clash"])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digests(docs, 6, 3).collect()}
    assert got == brute_words(list(enumerate(texts)), 6)
    cut = substring.trimmed(docs, 6, 3)
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest() == got[r["doc_id"]][2]
    assert substring.digests(docs.limit(0)).count() == 0


def test_words_of_a_reference_go(spark):
    reference = sample_texts(seed=5, n=20, letters="abc", words=40)
    texts = sample_texts(seed=6, n=40, letters="abc", words=40) + [" ".join((reference[k] or "").split()[2:30]) + " own end" for k in range(20)]
    known = {tuple(w[i : i + 6]) for t in reference for w in [(t or "").split()] for i in range(len(w) - 5)}
    want = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        gone = {i + j for i in range(len(w) - 5) if tuple(w[i : i + 6]) in known for j in range(6)}
        want[i] = [x for j, x in enumerate(w) if j not in gone]
    docs = docs_of(spark, texts, doc=[1])
    for most in (1 << 20, 50):
        got = substring.stripped(docs, spark.createDataFrame([(t,) for t in reference], "text string"), 6, most)
        assert got.columns == docs.columns and {r["doc_id"]: (r["text"] or "").split() for r in got.collect()} == want
    assert substring.stripped(docs, docs.limit(0), 6).count() == len(texts)


def test_one_id_with_different_texts(spark):
    """They are documents of their own; results are those of the texts with ids in the order of id and hash."""
    rng = random.Random(14)
    passage = " ".join("p%d" % i for i in range(12))
    rows = [(i // 2, f"{rng.random()} {passage} x{rng.random()}") for i in range(20)] + [(3, None), (3, ""), (None, passage), (None, passage + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = spark.createDataFrame(rows, "doc_id long, text string").where("doc_id = 0").orderBy(F.xxhash64("text")).first()["text"]
    got = substring.digests(docs, 6, 3).join(docs.select("doc_id", F.sha2("text", 256).alias("kept_sha256")), ["doc_id", "kept_sha256"], "left_semi").where("n_words > 12").collect()
    assert [r["n_removed"] for r in got if r["doc_id"] is not None] == [0] and substring.digests(docs, 6, 3).where("n_removed = 12").count() == 19
    assert hashlib.sha256(first.encode()).hexdigest() in {r["kept_sha256"] for r in got}
    assert suffix_array.digests(docs, 12, 5).where("n_removed > 30").count() == 19 and substring.trimmed(docs, 6, 3).count() == len(rows)


def brute_bytes(rows, n):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = (t or "").encode()
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - n + 1):
            if w[i : i + n] in seen:
                gone[i : i + n] = True
            seen.add(w[i : i + n])
        out[d] = (len(w), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))[: len(gone)]).sum()), hashlib.sha256(bytes(b for b, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("letters", ["abcdefghé\0", "a", "ab"])
def test_repeated_bytes(spark, letters):
    texts = sample_texts(letters=letters, words=30)
    docs = docs_of(spark, texts, doc=[1])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_array.digests(docs, 12, 5).collect()}
    assert got == brute_bytes(list(enumerate(texts)), 12)
    assert suffix_array.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few_ids,seen", [(1 << 20, 1 << 18), (0, 3)])
def test_repeats_of_hot_anchors(spark, monkeypatch, few_ids, seen):
    """Hot anchors sent to the regions or joined with them, regions remembered or not."""
    monkeypatch.setattr(common, "FEW_IDS", few_ids)
    monkeypatch.setattr(repeats, "SEEN", seen)
    monkeypatch.setattr(repeats, "HOT", 2)
    rng = random.Random(12)
    passage = " ".join("p%d" % i for i in range(9))
    texts = [f"a{i} b{i} c{i} {passage} d{i} e{i} f{i}" for i in range(60)] + sample_texts(letters="ab", words=30)
    rng.shuffle(texts)
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digests(docs, 6, 3).collect()}
    assert got == brute_words(list(enumerate(texts)), 6)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_array.digests(docs, 12, 5).collect()}
    assert got == brute_bytes(list(enumerate(texts)), 12)
    # Regions around the passage all differ, but none of its anchors gathers them.
    units, own = repeats.Units(True, 6, 3), docs.where("text like '%p1 p2%'").select(F.col("doc_id").alias("doc"), "text").coalesce(1)
    hits = repeats.repeated(repeats.anchors(own, units), 2)
    found = repeats.repeat_spans(repeats.regions(own, hits, units, repeats.hot_anchors(hits)), lambda: substring.Shards(6), units)
    assert found.where("key is not null").groupBy("key").count().agg(F.max("count")).first()[0] <= 60
    rows = repeats.regions(own, hits, units, repeats.hot_anchors(hits)).where("payload is not null")
    assert seen < 10 or rows.groupBy("key").count().agg(F.max("count")).first()[0] <= 3


def test_anchors_are_counted_over_blocks(spark, monkeypatch):
    """An anchor that comes once in each block is counted like one that comes often in one."""
    monkeypatch.setattr(repeats, "ANCHOR_BYTES", 1)
    passage = " ".join("p%d" % i for i in range(9))
    units, own = repeats.Units(True, 6, 3), docs_of(spark, [f"a{i} {passage} b{i}" for i in range(30)]).select(F.col("doc_id").alias("doc"), "text")
    found = repeats.anchors(own, units)
    assert repeats.hot_anchors(repeats.repeated(found, 29)).count() > 0 and repeats.hot_anchors(repeats.repeated(found, 30)).isEmpty()


def test_suffix_array_order():
    rng = random.Random(5)
    for t in range(200):
        x = bytes(rng.choice(b"ab\0c" if t % 2 else b"abcdefg") for _ in range(rng.randrange(1, 80)))
        text = np.frombuffer(x, dtype=np.uint8)
        order = suffix_array.suffix_array(text, suffix_array.eights(text), 200).tolist()
        padded = [x[i:].ljust(300, b"\0") for i in order]
        assert sorted(order) == list(range(len(x))) and padded == sorted(padded)


# 9

def test_rule_counts():
    rng = random.Random(2)
    texts = [None, "", "\n", "a\n\na\n b\r\n", " x"] + ["".join(rng.choice(["a ", "b ", "é\n", "c\t", "#", "\n", "\r", "\x0b", " ", "d\nd\n"]) for _ in range(rng.randrange(60))) for _ in range(500)]
    got = rules.count_block(pa.array(texts))
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(three)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len({k + j for k, x in enumerate(three) if n[x] > 1 for j in range(3)})]
        assert [int(got[c][i]) for c in rules.COUNTS] == want


def test_bound_is_clopper_pearson():
    assert rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05**0.01)
    assert rules.upper_bound(5, 5, 0.05) == 1.0
    p = rules.upper_bound(3, 50, 0.01)
    from math import comb

    assert sum(comb(50, k) * p**k * (1 - p) ** (50 - k) for k in range(4)) == pytest.approx(0.01, rel=1e-6)


def test_rule_cutoffs_against_brute_force(spark):
    """The path, the exact test at each step and the cutoffs, from the counts of every text in plain Python."""
    alpha, delta = 0.05, 0.1
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(2400):
        lang = ("en", "de", None)[i % 3] if i % 50 else "rare"
        n = rng.randrange(40, 300)
        junk = rng.random() < 0.2
        row = (i, lang, n, int(n * rng.uniform(3, 13 if junk else 7)), int(n * rng.random() * (0.6 if junk else 0.03)), rng.randrange(6) if junk else 0, int(n * rng.random() * (0.9 if junk else 0.1)))
        rows.append(row)
        if rng.random() < 0.7:
            labels.append((i, int(not junk), 0))
    # Every tenth document has a copy: a text of the same words is one trial.
    copies = [(10**6 + r[0], *r[1:], r[0]) for r in rows[::10]]
    labels += [(10**6 + i, q, t) for i, q, t in labels if i % 10 == 0 and q == 1]
    counted = spark.createDataFrame([(*r, r[0]) for r in rows] + [c for c in copies if c[0] in {i for i, *_ in labels}], "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in (*rules.COUNTS, "same")))
    got = {r["stratum"]: r.asDict() for r in rules.report(counted, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), alpha, delta).collect()}

    def over(row, rule, cutoff):
        v = dict(zip(rules.COUNTS, row[2:]))
        top, bottom = rules.RULES[rule]
        return v[top] / max(v[bottom], 1) > cutoff

    label = {i: q for i, q, _ in labels}
    kept = [r for r in rows if r[2] >= 50 and 100 * r[6] <= 50 * r[2]]
    steps = [(rule, c) for rule in rules.GRID for c in sorted(rules.GRID[rule], reverse=True)]
    strata = {r[1] for r in kept if label.get(r[0]) == 1}
    assert set(got) == strata and sum(g["n_steps"] > 0 for g in got.values()) >= 3 and got["rare"]["n_steps"] == 0
    for s in strata:
        good = [r for r in kept if r[1] == s and label.get(r[0]) == 1]
        bad = [r for r in kept if r[1] == s and label.get(r[0]) == 0]
        rest = [r for r in kept if r[1] == s and label.get(r[0]) != 1]
        cost, most = [], collections.Counter()
        for rule, c in steps:
            share = sum(over(r, rule, c) for r in rest) / len(rest) - len(bad) / (len(good) + len(bad)) * sum(over(r, rule, c) for r in bad) / max(len(bad), 1)
            most[rule] = max(most[rule], share)
            cost.append(most[rule])
        chosen, broken, n = {}, set(), 0
        for i in sorted(range(len(steps)), key=lambda i: (cost[i], i)):
            broken |= {r[0] for r in good if over(r, *steps[i])}
            if rules.upper_bound(len(broken), len(good), delta / len(strata)) > alpha:
                break
            chosen[steps[i][0]] = steps[i][1]
            n += 1
        assert (got[s]["n_good"], got[s]["n_steps"]) == (len(good), n)
        assert {x: got[s][x] for x in rules.RULES} == {x: chosen.get(x) for x in rules.RULES}


def test_rule_cutoffs_keep_their_promise():
    """Over many made holdouts the true rate of false rejections is over alpha in a share of delta at most, about."""
    rng = np.random.default_rng(4)
    true = np.array([0.001, 0.004, 0.01, 0.02, 0.028, 0.035, 0.05, 0.2])
    wrong = 0
    for _ in range(400):
        u = rng.random(600)
        broken = [int(((u < t) & (u >= s)).sum()) for s, t in zip(np.append(0, true[:-1]), true)]
        n = rules.passed(600, broken, 0.05, 0.03)
        wrong += n > 0 and true[n - 1] > 0.03
    assert wrong <= 400 * 0.05 + 3 * (400 * 0.05 * 0.95) ** 0.5


def test_rules_have_cutoffs_where_labels_suffice(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = rules.report(rules.with_counts(docs), labels).collect()
    assert len(found) == 4 and all(r["n_steps"] > 0 and r["n_rejected"] <= rules.ALPHA * r["n_good"] for r in found)


def test_rules_edges(spark):
    docs = docs_of(spark, [None, "", "a b " * 30, " ".join(f"w{i}" for i in range(80))], lang=[None, "en"], kept=["clash"])
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rules.judged(docs, labels).collect()}
    assert got == {0: (True, False), 1: (True, False), 2: (True, False), 3: (False, True)}
    assert rules.judged(docs, labels.limit(0)).count() == 4 and rules.judged(docs.limit(0), labels).count() == 0


# 10

def test_decontamination_is_brute_force(spark):
    rng = random.Random(7)
    pick = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    items = [pick(rng.randrange(6, 40)) for _ in range(12)] + [["short", "one"]]
    texts = [None, "", "short one", "a SHORT One b"]
    for k in range(60):
        w = pick(rng.randrange(80))
        if k % 2:
            item = list(rng.choice(items))
            if k % 4 == 1 and len(item) > 20:
                item[len(item) // 2] = "other"
            w = w[:10] + item + w[10:]
        texts.append(" ".join(w))
    docs = docs_of(spark, texts, item_id=["clash"])
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(50, None), (51, ""), (52, " ".join(items[0]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}

    def bag(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    want = set()
    for d, t in enumerate(texts):
        w = (t or "").lower().split()
        for i, item in [*enumerate(items), (52, items[0])]:
            mine = bag(item)
            for s in range(len(w) - len(item) + 1):
                other = bag(w[s : s + len(item)])
                both = sum((mine & other).values())
                if both >= 0.8 * (sum(mine.values()) + sum(other.values()) - both):
                    want.add((d, i))
    assert got == want and len(want) > 10
    clean = decontaminate.cleaned(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("kind,make", [("string", str), ("int", int), ("date", lambda i: __import__("datetime").date(2024, 1, 1 + i))])
def test_decontamination_with_ids_of_any_type(spark, kind, make):
    passage = " ".join("p%d" % i for i in range(30))
    docs = spark.createDataFrame([("a", f"x y {passage} z"), (None, passage), ("c", "nothing here")], "doc_id string, text string")
    items = spark.createDataFrame([(make(1), passage), (make(2), passage.upper()), (None, "other words of an item"), (make(3), None)], f"item_id {kind}, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(d, make(i)) for d in ("a", None) for i in (1, 2)}
    assert decontaminate.contaminated(docs, items).schema["item_id"].dataType == items.schema["item_id"].dataType


def test_language_scores_are_those_of_plain_sums(spark):
    """The logits of the model from n-grams cut and summed up one by one."""
    texts = ["the Cat sat\non a mat", "x", "", "12 3", "äöü, größe 3 Straße", "a" * 40]
    rows = [(i, t * 30, ("en", "de")[i % 2]) for i, t in enumerate(texts * 8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    codes = langid.letter_codes()
    for text, logits in zip(texts, model.logits(langid.features(pa.array(texts)), len(texts))):
        marked, last = [], None
        for k, c in enumerate(text):
            code = int(codes[ord(c)])
            if code and k == 0:
                code |= 1 << 21
            if code or last != 0 or k == 0:
                marked.append(code)
            last = code
        buckets = []
        for g in langid.GRAMS:
            for k in range(len(marked) - g + 1):
                part = marked[k : k + g]
                if 0 in part[1:-1]:
                    continue
                h = g
                for code in part:
                    h = (h * 0x9E3779B97F4A7C15 + code) % (1 << 64)
                buckets.append(int(common.mix(np.array([h], dtype=np.uint64))[0]) % langid.BUCKETS)
        want = model.table[:, buckets].astype(np.float64).sum(axis=1) / max(len(buckets), 1) + model.bias
        assert np.allclose(logits, want, atol=1e-6)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) < set(out.columns) and 0.5 * docs.count() < out.count() <= docs.count()
    assert out.select("doc_id").distinct().count() == out.count()
