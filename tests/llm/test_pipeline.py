"""Every stage of the pipeline on its own input against plain Python, over all rows of a small table."""

import collections

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from skyledger.llm import bpe, langid
from skyledger.llm.common import stored
from skyledger.llm.queries import rank_file

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))] if w else []


def classes(texts):
    """The least id of each id's class, over all pairs alike in 0.8 of their sets of five-word shingles."""
    ids, sets, name = sorted(texts), {i: set(shingles(t)) for i, t in texts.items()}, {i: i for i in texts}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = {k: new if v == old else v for k, v in name.items()}
    return name


def trimmed(texts, n=50):
    """The words that are left of each text."""
    seen, out = set(), {}
    for i in sorted(texts):
        w, gone = (texts[i] or "").encode().split(), set()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            gone |= set(range(k, k + n)) if key in seen else set()
            seen.add(key)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def holds(text, items):
    """Whether some window of an item's size is alike to it in 0.8 of the weight of their shingles."""
    w = (text or "").encode().lower().split()
    for item in items:
        mine = collections.Counter(shingles(item))
        size, total = len(item.encode().split()), sum(mine.values())
        if not total or not set(mine) & {tuple(w[i : i + min(5, size)]) for i in range(len(w))}:
            continue
        for s in range(len(w) - size + 1):
            own = w[s : s + size]
            other = collections.Counter(tuple(own[i : i + 5]) for i in range(max(len(own) - 4, 1)))
            both = sum((mine & other).values())
            if both >= 0.8 * (total + sum(other.values()) - both):
                return True
    return False


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # Near copies, a passage that many share, and a benchmark item inside a text.
    rows = docs.select("text").where(F.length("text").between(600, 6000)).orderBy("doc_id").limit(6).collect()
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if r["text"]]
    base = [r["text"].split() for r in rows]
    more = [" ".join(w[:10] + ["edited"] + w[11:]) for w in base] + [" ".join(base[0][:60] + w[::-1]) for w in base] + [" ".join([*base[1][:40], items[0], *base[1][40:]])]
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    docs = stored(docs.unionByName(extra.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))))
    texts, columns = {r["doc_id"]: r["text"] for r in docs.collect()}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF))
        got = {r["doc_id"]: r for r in out.collect()}
        assert len(got) == out.count()
        if name == "language":
            want = {r["doc_id"] for r in langid.predictions(docs, langid.fit(docs)).where("accepted").collect()}
            assert set(got) == want and len(want) > 0.9 * len(texts)
        elif name == "near_duplicates":
            assert set(got) == {i for i, c in classes(texts).items() if i == c} and len(got) < len(texts)
        elif name == "repeated_passages":
            want = trimmed(texts)
            gone = {i for i, w in want.items() if not w and (texts[i] or "").strip()}
            assert set(got) == set(want) - gone and all((r["text"] or "").encode().split() == want[i] for i, r in got.items())
            assert all(r["n_chars"] == len(r["text"] or "") for i, r in got.items() if r["text"] is not None)
            assert sum(len(w) for w in want.values()) < sum(len((t or "").split()) for t in texts.values())
        elif name == "benchmark_passages":
            want = {i for i, t in texts.items() if not holds(t, items)}
            assert set(got) == want and len(want) < len(texts)
        else:
            own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(rank_file()), special_tokens={})
            assert all(list(r["token_ids"]) == own.encode_ordinary(texts[i] or "") and r["n_tokens"] == len(r["token_ids"]) for i, r in got.items())
            assert set(got) == set(texts)
            break
        assert out.columns == columns
        docs, texts = out, {i: r["text"] for i, r in got.items()}
