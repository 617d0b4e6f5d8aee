"""Alignment of the tokens of two tokenizers over the same bytes, and how often tokens of either stand for one another.

A text with a space before it is cut by tokenizer A (byte-level BPE, see `prefix_bpe`) and by tokenizer B (pieces with
byte fallback).  Byte offsets where tokens of both end cut the tokens into groups; an A and a B token whose bytes
overlap are linked.

Groups come from diagonal run skipping.  Two indices walk the lists of token ends; as long as tokens are one to one
their shift stays the same, so the ends at the current shift are compared over stretches of doubling length, and
the walk jumps over all that agree.  Where two ends differ an irregular group begins: there the index with the
lesser end goes ahead until both ends agree, each step is a link, and the indices stand at a new shift.  All
texts of a block walk side by side; a long text is entered at several of its common ends.

Spark counts the links of each id pair over the whole corpus.  A task writes its texts in blocks: a row for each text with
the pairs it holds as numbers of the block's list of pairs, and a row for the list.  Lists are summed up by pair, joined
with the sums (a pair in every block is a row for each block, which Spark can split), and the answers go back to their block.
A B id's highest count is a table of at most as many rows as B has ids, and is sent to all tasks.

Cases: a null or empty text, and one whose A or B tokens don't spell a space and the text (say one with U+2581), has no tokens:
zeros and an empty digest.  Repeated rows give repeated results, and each counts.  An empty table gives an empty one.
Ids may be of any type, and null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import bpe, prefix_bpe
from skyledger.llm.common import blocks, span_hashes, stored, text_bytes

#: Ends that are compared first, at a new shift.
FIRST = 4
#: Tokens of A after which a text is entered again.
ENTRY = 256
#: Text bytes of a block of rows.
BLOCK_TEXT = 16 << 20
#: Text bytes that are encoded and aligned at a time.
STEP = 1 << 20
#: Distinct units whose B tokens a worker remembers.
REMEMBERED = 100_000
MARK = "▁"


class PieceBook:
    """A piece vocabulary with byte fallback, and what this worker has encoded so far.

    No piece has a space anywhere but at its start, so a text's pieces are those of its units: runs of
    spaces with what follows them.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in self.pieces) or "".join(model.encode("  a b  ", out_type=str)) != f"{MARK * 3}a{MARK}b{MARK * 2}":
            raise ValueError(f"{path} has pieces over several words, or takes more than a space before the text")
        token = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.lengths = np.array([len(t) for t in token], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(token), dtype=np.uint8)
        self.alone = np.array([model.piece_to_id(MARK)], dtype="<u4").tobytes()
        self.known: dict[bytes, bytes] = {}

    def encode_units(self, units: list[bytes]) -> list[bytes]:
        known = self.known
        out = [known.get(u) for u in units]
        new = [i for i, x in enumerate(out) if x is None]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        # The first space of a unit is the one that the model adds by itself.
        for i, ids in zip(new, self.model.encode([units[i][1:].decode() for i in new], num_threads=1)):
            out[i] = np.array(ids, dtype="<u4").tobytes() if len(units[i]) > 1 else self.alone
        if len(new) <= REMEMBERED:
            known.update((units[i], out[i]) for i in new)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of texts end to end, a space before each, and where each text's begin and end."""
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        whole = data.tobytes()
        space = data == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))
        _, one, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        units = [whole[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())]
        return bpe.Codebook.laid_out(self.encode_units(units), which, starts, offsets)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return bpe.gathered(self.bytes, self.begins, self.lengths, ids)


_pieces: dict[str, PieceBook] = {}


def piece_book(path: str) -> PieceBook:
    if path not in _pieces:
        _pieces[path] = PieceBook(path)
    return _pieces[path]


def same_bytes(lengths: np.ndarray, bounds: np.ndarray, ids: np.ndarray, decoded: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts their tokens spell: byte for byte the same."""
    ends = np.concatenate(([0], np.cumsum(lengths[ids])))[bounds]
    n = np.diff(offsets)
    good = np.diff(ends) == n
    if good.all() and np.array_equal(decoded, data):
        return good
    for i in np.flatnonzero(good).tolist():
        good[i] = np.array_equal(decoded[ends[i] : ends[i + 1]], data[offsets[i] : offsets[i + 1]])
    return good


def entries(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the walks begin and stop, as indices of A and B: at the texts' bounds, and after common ends that a long text has about every ENTRY tokens."""
    a, b = [a_first], [b_first]
    places = np.arange(ENTRY, len(a_ends), ENTRY)
    if len(places):
        at = np.searchsorted(b_ends, a_ends[places - 1])
        common = b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends[places - 1]
        a.append(places[common])
        b.append(at[common] + 1)
    a, one = np.unique(np.concatenate(a), return_index=True)
    b = np.concatenate(b)[one]
    return a[:-1], a[1:], b[:-1], b[1:]


def aligned(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which A and which B tokens end a group, and the links as indices of A and B, in no order.

    The ends are byte offsets, growing over all texts; a_first and b_first the texts' bounds in them.  Every text's
    last ends are common.
    """
    a_cut, b_cut = np.zeros(len(a_ends), dtype=bool), np.zeros(len(b_ends), dtype=bool)
    links_a: list[np.ndarray] = []
    links_b: list[np.ndarray] = []
    i, a_stop, j, b_stop = entries(a_ends, b_ends, a_first, b_first)
    there = i < a_stop
    i, a_stop, j, b_stop = i[there], a_stop[there], j[there], b_stop[there]
    probe = np.full(len(i), FIRST)
    while len(i):
        # Compare the next ends at this shift.
        n = np.minimum(probe, np.minimum(a_stop - i, b_stop - j))
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        a, b = np.repeat(i, n) + step, np.repeat(j, n) + step
        run = np.minimum(np.minimum.reduceat(np.where(a_ends[a] == b_ends[b], n.max(), step), first), n)
        agree = step < np.repeat(run, n)
        a, b = a[agree], b[agree]
        a_cut[a] = b_cut[b] = True
        links_a.append(a)
        links_b.append(b)
        i, j = i + run, j + run
        probe = np.where(run == n, probe * 2, FIRST)
        # Those that met a difference go through one irregular group.
        odd = np.flatnonzero(run < n)
        a, b = i[odd], j[odd]
        while len(odd):
            links_a.append(a)
            links_b.append(b)
            x, y = a_ends[a], b_ends[b]
            done = x == y
            a_cut[a[done]] = b_cut[b[done]] = True
            i[odd[done]], j[odd[done]] = a[done] + 1, b[done] + 1
            odd, a, b = odd[~done], (a + (x < y))[~done], (b + (y < x))[~done]
        on = i < a_stop
        if not on.all():
            i, a_stop, j, b_stop, probe = i[on], a_stop[on], j[on], b_stop[on], probe[on]
    none = np.zeros(0, dtype=np.int64)
    return a_cut, b_cut, np.concatenate([none, *links_a]), np.concatenate([none, *links_b])


def digits(n: int) -> np.ndarray:
    """The decimal digits of 0 to n - 1 from the left, with a free place after them; zeros are free."""
    width = len(str(n - 1)) + 1
    return np.array([str(i) for i in range(n)], dtype=f"S{width}").view(np.uint8).reshape(n, width)


class Written:
    """Groups of ids as text: `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, n: int):
        self.table = digits(n)
        self.size = (self.table > 0).sum(axis=1)

    def of(self, a_ids, b_ids, a_cut, b_cut, a_first, b_first) -> tuple[bytes, np.ndarray]:
        """All texts' groups end to end, each group with a sign after it, and where each text's begin and end."""
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        a_end, b_end = np.flatnonzero(a_cut) + 1, np.flatnonzero(b_cut) + 1
        at_a = np.arange(len(a_ids)) + np.concatenate(([0], b_end))[a_group]
        at_b = np.arange(len(b_ids)) + a_end[b_group]
        ids = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
        sign = np.empty(len(ids), dtype=np.uint8)
        ids[at_a], ids[at_b] = a_ids, b_ids
        sign[at_a], sign[at_b] = np.where(a_cut, ord("|"), ord(",")), np.where(b_cut, ord(";"), ord(","))
        rows = self.table[ids]
        size = self.size[ids]
        rows[np.arange(len(ids)), size] = sign
        ends = np.concatenate(([0], np.cumsum(size + 1)))
        return rows[rows > 0].tobytes(), ends[a_first + b_first]


def compacted(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, bounds: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the good texts, and the texts' bounds in them."""
    n = np.diff(bounds)
    return ids[np.repeat(good, n)].astype(np.int64), np.concatenate(([0], np.cumsum(np.where(good, n, 0))))


class Aligner:
    def __init__(self, book: prefix_bpe.PrefixBook, pieces: PieceBook):
        self.book, self.pieces = book, pieces
        self.written = Written(max(len(book.token), len(pieces.pieces)))

    def align(self, texts: pa.Array) -> dict[str, np.ndarray | list]:
        """Of each text n_a, n_b, n_groups, groups (as text, bytes) and the links: text, a and b of each."""
        filled = texts.fill_null("")
        data, offsets = text_bytes(pc.binary_join_element_wise(pc.if_else(pc.equal(filled, ""), "", " "), filled, ""))
        a_ids, a_bounds = self.book.encode(data, offsets, special=False)
        b_ids, b_bounds = self.pieces.encode(data, offsets)
        good = same_bytes(self.book.lengths, a_bounds, a_ids, self.book.decode(a_ids)[0], data, offsets)
        good &= same_bytes(self.pieces.lengths, b_bounds, b_ids, self.pieces.decode(b_ids), data, offsets)
        a_ids, a_first = compacted(data, offsets, a_ids, a_bounds, good)
        b_ids, b_first = compacted(data, offsets, b_ids, b_bounds, good)
        a_cut, b_cut, a, b = aligned(np.cumsum(self.book.lengths[a_ids]), np.cumsum(self.pieces.lengths[b_ids]), a_first, b_first)
        text, ends = self.written.of(a_ids, b_ids, a_cut, b_cut, a_first, b_first)
        groups = np.concatenate(([0], np.cumsum(a_cut)))[a_first]
        return {
            "n_a": np.diff(a_first),
            "n_b": np.diff(b_first),
            "n_groups": np.diff(groups),
            "groups": [text[x : y - 1] if y > x else b"" for x, y in zip(ends.tolist(), ends[1:].tolist())],
            "text": np.searchsorted(a_first, a, side="right") - 1,
            "a": a_ids[a],
            "b": b_ids[b],
        }


def lists_of(values: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.astype(np.int32)))


def held(docs: DataFrame, merges: str, pieces: str, id_col: str, text_col: str, block_text: int = BLOCK_TEXT) -> DataFrame:
    """Rows of texts (x: numbers of the block's pairs, times) and of blocks (x and y: A and B ids of its pairs, times); a block's row has a null n_a."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, x array<int>, y array<int>, times array<int>"
    sent = prefix_bpe.sent_tables(docs, merges)

    def out(block: int, parts: list[dict], width: int, id_type) -> Iterator[pa.RecordBatch]:
        keys = [p["pair"] for p in parts]
        all_keys = np.concatenate(keys)
        pairs, where = np.unique(all_keys, return_inverse=True)
        times = np.concatenate([p["times"] for p in parts])
        total = np.bincount(where, weights=times, minlength=len(pairs)).astype(np.int64)
        at = 0
        for p in parts:
            n, m = len(p["n_a"]), len(p["pair"])
            own, at = where[at : at + m], at + m
            columns = [pa.array(np.full(n, block)), p["id"], *[pa.array(p[c]) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(p["sha"], pa.string()), lists_of(own, p["held"]), pa.nulls(n, pa.list_(pa.int32())), lists_of(p["times"], p["held"])]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        none = [pa.nulls(1, t) for t in (id_type, *[pa.int64()] * 4, pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *none, *[lists_of(v, [len(pairs)]) for v in (pairs // width, pairs % width, total)]], names=names)

    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "x", "y", "times"]

    def run(batches):
        from pyspark import TaskContext

        aligner = Aligner(prefix_bpe.book_of(sent), piece_book(pieces))
        width = len(aligner.pieces.pieces)
        block, parts, size, id_type = TaskContext.get().partitionId() << 32, [], 0, None
        for step in blocks(batches, text_col, STEP):
            found = aligner.align(step.column(text_col))
            n, id_type = step.num_rows, step.schema.field(id_col).type
            # Of each text its different pairs, and how many links hold each.
            space = len(aligner.book.token) * width
            keys, times = np.unique(found["text"] * space + found["a"] * width + found["b"], return_counts=True)
            parts.append({
                "id": step.column(id_col), "n_a": found["n_a"], "n_b": found["n_b"], "n_groups": found["n_groups"],
                "n_links": np.bincount(found["text"], minlength=n), "sha": [hashlib.sha256(g).hexdigest() if g else "" for g in found["groups"]],
                "pair": keys % space, "times": times, "held": np.bincount(keys // space, minlength=n),
            })
            size += step.nbytes
            if size > block_text:
                yield from out(block, parts, width, id_type)
                block, parts, size = block + 1, [], 0
        if parts:
            yield from out(block, parts, width, id_type)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def links(docs: DataFrame, merges: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b and n: how many links of the corpus hold each A and B id linked."""
    return pair_counts(held(docs, merges, pieces, id_col, text_col))


def pair_counts(rows: DataFrame) -> DataFrame:
    lists = rows.where("y is not null").select(F.explode(F.arrays_zip("x", "y", "times")).alias("p"))
    return lists.groupBy(F.col("p.x").alias("a"), F.col("p.y").alias("b")).agg(F.sum(F.col("p.times").cast("long")).alias("n"))


def alignment(docs: DataFrame, merges: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", block_text: int = BLOCK_TEXT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    rows = stored(held(docs, merges, pieces, id_col, text_col, block_text))
    counts = stored(pair_counts(rows))
    best = counts.groupBy(F.col("b").alias("of")).agg(F.max("n").alias("most"))  # a row for each B id at most
    judged = counts.join(F.broadcast(best), F.col("b") == F.col("of")).select(F.col("a").alias("x"), F.col("b").alias("y"), "n", (F.col("n") == F.col("most")).alias("best"))
    asked = rows.where("y is not null").select(F.col("block").alias("of_block"), F.posexplode(F.arrays_zip("x", "y")).alias("place", "p")).select("of_block", "place", "p.x", "p.y")
    answers = asked.join(judged, ["x", "y"]).select("of_block", "place", "n", "best")

    texts = rows.where("n_a is not null").drop("y")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, dtype=np.int64), np.zeros(right.num_rows, dtype=bool)
        place = right.column("place").to_numpy()
        n[place], best[place] = right.column("n").to_numpy(), right.column("best").to_numpy()
        left = left.combine_chunks()
        out = []
        for batch in left.to_batches():
            x = batch.column("x")
            bounds = x.offsets.to_numpy().astype(np.int64)
            own = x.values.to_numpy()[bounds[0] : bounds[-1]]
            shift = batch.column("times").offsets.to_numpy()
            times = batch.column("times").values.to_numpy()[shift[0] : shift[-1]].astype(np.int64)
            sums = [np.concatenate(([0], np.cumsum(v)))[bounds - bounds[0]] for v in (times * best[own], times * n[own])]
            columns = {c: batch.column(c) for c in names if c in batch.schema.names} | {"n_best": pa.array(np.diff(sums[0])), "count_sum": pa.array(np.diff(sums[1]))}
            out.append(pa.RecordBatch.from_arrays([columns[c] for c in names], names=names))
        return pa.Table.from_batches(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(answer, schema)
