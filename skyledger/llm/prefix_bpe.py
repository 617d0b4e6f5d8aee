"""Byte-level BPE encoding and decoding by dynamic programming over prefixes, from a tokenizer file of merges.

Of every prefix of a piece the encoding ends in one token, and it is the only token that is a suffix of the prefix
and compatible with the last token of what stands before it.  Two tokens are compatible if the merges, run over
their bytes side by side, never join across the seam.  So a left-to-right pass stores the last token of every
prefix, and following these back from the end of the piece gives the exact ids: no merge is ever replayed.

The tokens that are a suffix of a prefix come from a suffix automaton of the vocabulary: the text streams through it,
a state knows the longest token that ends its strings, and each token the next shorter one that ends it.  A pair of
tokens is tested along the right edge of one and the left edge of the other, back in time through the merges
that formed them.  A token that the merges never make of its own bytes is no candidate.

Pieces are cut as the file's byte-level splitting does, with the character classes of the library's own pattern
engine; strings of the added tokens are tokens of their own unless `special` is off.  A piece's tokens depend on
it alone, so each distinct piece of a block is encoded once, all pieces of a block position by position at a
time.  The tables (a few ten MB, bounded by the vocabulary) are built on the driver and sent to all workers; no text is
shuffled.

Cases: a null or empty text has no tokens, and decodes to the empty text.  Repeated rows give repeated results.  An
empty table gives an empty one.  Columns beside the id and the text are kept by `encode_column` (an own column
named as the new one is an error) and ignored by `token_digests`; ids may be of any type, and null.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skyledger.llm import bpe
from skyledger.llm.common import blocks, span_hashes, text_bytes

#: Text bytes that are encoded together.
BLOCK = 2 << 20
#: Distinct pieces whose tokens a worker remembers between blocks.
REMEMBERED = 100_000
#: Bytes from which a piece is encoded by itself.
LONG = 256
NEVER = np.int64(1 << 40)

_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """For each code point what it is to the tokenizers library's patterns: white space, a letter, a number or something else."""
    if not _classes:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        kinds = np.full(0x110000, bpe.OTHER, dtype=np.uint8)
        points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
        for kind, pattern in ((bpe.SPACE, r"\s"), (bpe.LETTER, r"\p{L}"), (bpe.NUMBER, r"\p{N}")):
            cut = Split(Regex(pattern), "removed")
            for at in range(0, len(points), 4096):
                own = np.array(points[at : at + 4096])
                inside = np.ones(len(own), dtype=bool)
                for _, (a, b) in cut.pre_tokenize_str("".join(map(chr, own.tolist()))):
                    inside[a:b] = False
                kinds[own[inside]] = kind
        _classes.append(kinds)
    return _classes[0]


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def automaton(tokens: list[bytes]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """The suffix automaton of all tokens: transitions, suffix link and longest length of each state; state 0 is the root."""
    to: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    for token in tokens:
        last = 0
        for c in token:
            there = to[last].get(c)
            if there is not None and size[there] == size[last] + 1:
                last = there
                continue
            new = -1
            if there is None:
                new = len(to)
                to.append({})
                size.append(size[last] + 1)
                link.append(0)
            p = last
            while p >= 0 and c not in to[p]:
                to[p][c] = new
                p = link[p]
            if p >= 0:
                q = to[p][c]
                if size[q] != size[p] + 1:
                    copy = len(to)
                    to.append(dict(to[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    link[q] = copy
                    while p >= 0 and to[p].get(c) == q:
                        to[p][c] = copy
                        p = link[p]
                    q = copy
                if new >= 0:
                    link[new] = q
                else:
                    new = q
            last = new
    return to, link, size


def tables(path: str) -> dict:
    """What encoding and decoding need of a tokenizer file: the tokens' bytes, merges, automaton and character classes."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path} is no plain byte-level BPE")
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens that take in what stands beside them")
    bytes_of = byte_chars()
    vocab = model["vocab"]
    n = max([*vocab.values(), *added.values()]) + 1
    token = [b""] * n
    for text, i in vocab.items():
        token[i] = bytes(bytes_of[c] for c in text)
    left, right, formed = (np.full(n, -1, dtype=np.int64) for _ in range(3))
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], dtype=np.int64).reshape(-1, 3)
    left[pairs[:, 2]], right[pairs[:, 2]], formed[pairs[:, 2]] = pairs[:, 0], pairs[:, 1], np.arange(len(pairs))
    if len(np.unique(pairs[:, 2])) < len(pairs) or (formed[pairs[:, :2]] >= np.arange(len(pairs))[:, None]).any():
        raise ValueError(f"{path} has a token of two merges, or a merge before those of its parts")
    keys = pairs[:, 0] * n + pairs[:, 1]
    order = np.argsort(keys)
    out = {"n": n, "left": left, "right": right, "formed": formed, "keys": np.append(keys[order], np.int64(1 << 62)), "ranks": np.append(order, NEVER)}
    # A token comes out of its own bytes if its halves do and nothing joins across their seam before it.
    sound = np.array([len(t) == 1 for t in token])
    seam = first_join(out, pairs[:, 0], pairs[:, 1], whole=True)
    for (a, b, ab), join, rank in zip(pairs.tolist(), seam.tolist(), range(len(pairs))):
        sound[ab] = sound[a] and sound[b] and join == rank
    own = [i for i in range(n) if sound[i]]
    to, link, size = automaton([token[i] for i in own])
    ends: list[list[int]] = [[] for _ in to]
    for i in own:
        at = 0
        for c in token[i]:
            at = to[at][c]
        ends[at].append(i)
    longest, shorter = np.full(len(to), -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
    for state in np.argsort(size, kind="stable").tolist():
        below = longest[link[state]] if state else -1
        for i in sorted(ends[state], key=lambda i: len(token[i])):
            shorter[i], below = below, i
        longest[state] = below
    steps = sorted((state << 8 | c, target) for state, row in enumerate(to) for c, target in row.items())
    out |= {"step_keys": np.array([k for k, _ in steps] + [1 << 62], dtype=np.int64), "step_to": np.array([t for _, t in steps] + [-1], dtype=np.int32)}
    out |= {"link": np.array(link, dtype=np.int32), "size": np.array(size, dtype=np.int32), "longest": longest, "shorter": shorter}
    for text, i in added.items():
        token[i] = text.encode()
    return out | {"token": token, "added": {text.encode(): i for text, i in added.items()}, "kinds": char_classes()}


def joined(t: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rank of the merge of x and y; NEVER where there is none."""
    keys = x * t["n"] + y
    at = np.searchsorted(t["keys"], keys)
    return np.where(t["keys"][at] == keys, t["ranks"][at], NEVER)


def first_join(t: dict, x: np.ndarray, y: np.ndarray, whole: bool = False) -> np.ndarray:
    """The rank at which tokens x and y, side by side, join across their seam; NEVER if they don't.

    Back in time: the tokens at the seam stand until the merges that took them in; of the two the one formed later
    comes apart first.  A merge across happens if both stand at its rank; at equal rank the left one goes first.
    whole: as halves of one token, of which the earliest join counts; else any join will do.
    """
    x, y = np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)
    out = np.full(len(x), NEVER)
    which = np.arange(len(x))
    x_until, y_until = np.full(len(x), NEVER), np.full(len(x), NEVER)
    formed, left, right = t["formed"], t["left"], t["right"]
    while len(which):
        rank = joined(t, x, y)
        joins = (rank < x_until) & (rank <= y_until) & (rank < NEVER)
        out[which[joins]] = rank[joins]
        fx, fy = formed[x], formed[y]
        go = (np.maximum(fx, fy) >= 0) & (whole | ~joins)
        which, x, y, fx, fy, x_until, y_until = (v[go] for v in (which, x, y, fx, fy, x_until, y_until))
        undo = fx > fy
        x_until, y_until = np.where(undo, fx, x_until), np.where(undo, y_until, fy)
        x, y = np.where(undo, right[x], x), np.where(undo, y, left[y])
    return out


class PrefixBook:
    """The tables of a tokenizer file, and what this worker has encoded so far."""

    def __init__(self, own: dict):
        self.t = own
        self.token: list[bytes] = own["token"]
        self.lengths = np.array([len(b) for b in self.token], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.added: dict[bytes, int] = own["added"]
        self.specials = regex.compile(b"|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.known: dict[bytes, bytes] = {}
        self.merges: dict[int, int] = {}  # filled when a piece is first encoded alone
        self.halves: dict[int, tuple[int, int, int]] = {}

    def candidates(self, state: np.ndarray, matched: np.ndarray) -> np.ndarray:
        """The longest token that ends each match of so many bytes."""
        t = self.t
        found = t["longest"][state].astype(np.int64)
        while (long := np.flatnonzero(self.lengths[found] > matched)).size:
            found[long] = t["shorter"][found[long]]
        return found

    def stepped(self, state: np.ndarray, matched: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more byte, and how many bytes still match."""
        t = self.t
        state, matched = state.copy(), matched.copy()
        open_ = np.arange(len(state))
        while len(open_):
            keys = state[open_] << 8 | byte[open_]
            at = np.searchsorted(t["step_keys"], keys)
            there = t["step_keys"][at] == keys
            hit = open_[there]
            state[hit], matched[hit] = t["step_to"][at[there]], matched[hit] + 1
            open_ = open_[~there]
            state[open_] = t["link"][state[open_]]
            matched[open_] = t["size"][state[open_]]
        return state, matched

    def last_tokens(self, data: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The last token of every prefix of the pieces, which are in order of size, long ones first."""
        last = np.full(len(data), -1, dtype=np.int64)
        state = np.zeros(len(heads), dtype=np.int64)
        matched = np.zeros(len(heads), dtype=np.int64)
        for i in range(int(sizes[0])):
            k = int(np.searchsorted(-sizes, -i, side="left"))  # the pieces longer than i
            state, matched = self.stepped(state[:k], matched[:k], data[heads[:k] + i].astype(np.int64))
            token, open_ = self.candidates(state, matched), np.arange(k)
            while len(open_):
                start = i + 1 - self.lengths[token]
                fits = start == 0
                rest = np.flatnonzero(~fits)
                before = last[heads[open_[rest]] + start[rest] - 1]
                fits[rest] = first_join(self.t, before, token[rest]) == NEVER
                last[heads[open_[fits]] + i] = token[fits]
                open_, token = open_[~fits], self.t["shorter"][token[~fits]].astype(np.int64)
        return last

    def compatible(self, x: int, y: int) -> bool:
        """As `first_join` of one pair, for pieces that are encoded alone."""
        if not self.merges:
            n = len(self.t["formed"])
            self.merges = dict(zip(self.t["keys"][:-1].tolist(), self.t["ranks"].tolist()))
            self.halves = {i: (int(self.t["formed"][i]), int(self.t["left"][i]), int(self.t["right"][i])) for i in range(n)}
        n, never = self.t["n"], int(NEVER)
        x_until = y_until = never
        while True:
            rank = self.merges.get(x * n + y, never)
            if rank < x_until and rank <= y_until and rank < never:
                return False
            (fx, _, xr), (fy, yl, _) = self.halves[x], self.halves[y]
            if fx > fy:
                x, x_until = xr, fx
            elif fy >= 0:
                y, y_until = yl, fy
            else:
                return True

    def alone(self, piece: bytes) -> np.ndarray:
        """The last token of every prefix of one long piece."""
        t = self.t
        keys, to, link, size, longest, shorter = (memoryview(t[k]) for k in ("step_keys", "step_to", "link", "size", "longest", "shorter"))
        lengths = memoryview(self.lengths)
        last: list[int] = []
        state = matched = 0
        for i, c in enumerate(piece):
            while keys[at := bisect_left(keys, state << 8 | c)] != state << 8 | c:
                state = link[state]
                matched = size[state]
            state, matched = to[at], matched + 1
            token = longest[state]
            while lengths[token] > matched or (start := i + 1 - lengths[token]) and not self.compatible(last[start - 1], token):
                token = shorter[token]
            last.append(token)
        return np.array(last, dtype=np.int64)

    def encode_new(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of each piece as little-endian unsigned 32-bit integers, by back-pointers from its end."""
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        laid = [pieces[i] for i in order]
        sizes = np.array([len(p) for p in laid], dtype=np.int64)
        heads = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(laid), dtype=np.uint8)
        n = int(np.searchsorted(-sizes, -LONG, side="right"))  # those of LONG bytes or more
        last = [self.alone(p) for p in laid[:n]]
        if n < len(laid):
            base = int(heads[n])
            last.append(self.last_tokens(data[base:], heads[n:] - base, sizes[n:]))
        last = np.concatenate(last)
        stands = np.zeros(len(data), dtype=bool)
        end, head = heads + sizes, heads
        while len(end):
            stands[end - 1] = True
            end = end - self.lengths[last[end - 1]]
            more = end > head
            end, head = end[more], head[more]
        at = np.flatnonzero(stands)
        flat = last[at].astype("<u4").tobytes()
        cuts = (np.searchsorted(at, np.append(heads, len(data))) * 4).tolist()
        out = [b""] * len(pieces)
        for i, a, b in zip(order, cuts, cuts[1:]):
            out[i] = flat[a:b]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        out = [known.get(p) for p in pieces]
        new = [i for i, x in enumerate(out) if x is None]
        if not new:
            return out
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        for i, ids in zip(new, self.encode_new([pieces[i] for i in new])):
            out[i] = ids
        if len(new) <= REMEMBERED:
            known.update((pieces[i], out[i]) for i in new)
        return out

    def special_spans(self, whole: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where strings of added tokens stand, within one text each."""
        if self.specials is None or not self.specials.search(whole):
            return []
        bounds = offsets.tolist()
        return [(a + m.start(), a + m.end()) for a, b in zip(bounds, bounds[1:]) for m in self.specials.finditer(whole[a:b])]

    def encode(self, data: np.ndarray, offsets: np.ndarray, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of texts end to end (UTF-8 bytes and the texts' bounds in them), and where each text's begin and end."""
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        whole = data.tobytes()
        chars = np.frombuffer(whole.decode().encode("utf-32-le"), dtype=np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # the byte where each character begins
        spans = self.special_spans(whole, offsets) if special else []
        edges = np.unique(np.concatenate([offsets, *[np.array(s) for s in spans]])) if spans else offsets
        starts = at[bpe.piece_starts(chars, np.searchsorted(at, edges[edges < len(data)]), self.t["kinds"])]
        if spans:
            begin, end = np.array(spans).T
            within = np.searchsorted(begin, starts) - 1  # the span that began last before each piece
            starts = starts[(within < 0) | (starts >= end[within])]
        ends = np.append(starts[1:], len(data))
        marks = span_hashes(data, starts, ends)
        fixed = {}
        for (a, b), k in zip(spans, np.searchsorted(starts, [a for a, _ in spans]).tolist()):
            marks[k] = np.uint64(self.added[whole[a:b]])
            fixed[k] = self.added[whole[a:b]].to_bytes(4, "little")
        _, one, which = np.unique(marks, return_index=True, return_inverse=True)

        def coded(ones: list[int]) -> list[bytes]:
            own = [i for i in ones if i not in fixed]
            found = dict(zip(own, self.encode_pieces([whole[starts[i] : ends[i]] for i in own])))
            return [fixed[i] if i in fixed else found[i] for i in ones]

        ids, bounds = bpe.Codebook.laid_out(coded(one.tolist()), which, starts, offsets)
        if not np.array_equal(self.decode(ids)[0], data):  # two pieces of one hash
            ids, bounds = bpe.Codebook.laid_out(coded(list(range(len(starts)))), np.arange(len(starts)), starts, offsets)
        return ids, bounds

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the tokens, and where each token's bytes begin and end."""
        return bpe.gathered(self.bytes, self.begins, self.lengths, ids), np.concatenate(([0], np.cumsum(self.lengths[ids])))


_books: dict[int, PrefixBook] = {}


def sent_tables(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(tables(path))


def book_of(sent) -> PrefixBook:
    """One for each broadcast table and worker process; the tables stay as long as their book."""
    own = sent.value
    if id(own) not in _books:
        _books.clear()
        _books[id(own)] = PrefixBook(own)
    return _books[id(own)]


def encode_column(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", special: bool = True) -> DataFrame:
    """The rows of `docs` with a column of token ids more."""
    if ids_col in docs.columns:
        raise ValueError(f"there is a column {ids_col} already")
    sent = sent_tables(docs, path)

    def run(batches):
        book = book_of(sent)
        for block in blocks(batches, text_col, BLOCK):
            ids, bounds = book.encode(*text_bytes(block.column(text_col)), special)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*block.columns, lists], names=[*block.schema.names, ids_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode_column(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids more, special ones included; bytes that are no UTF-8 become U+FFFD, null ids the empty text."""
    if text_col in rows.columns:
        raise ValueError(f"there is a column {text_col} already")
    sent = sent_tables(rows, path)

    def run(batches):
        book = book_of(sent)
        for batch in batches:
            texts = [book.decode(np.array(x or [], dtype=np.int64))[0].tobytes().decode("utf-8", "replace") for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=[*batch.schema.names, text_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded, and decoded again."""
    sent = sent_tables(docs, path)

    def run(batches):
        book = book_of(sent)
        for block in blocks(batches, text_col, BLOCK):
            ids, bounds = book.encode(*text_bytes(block.column(text_col)))
            back, ends = book.decode(ids)
            ids, back, cuts = ids.astype("<u4").tobytes(), back.tobytes(), bounds.tolist()
            places = ends[bounds].tolist()
            columns = [
                block.column(id_col),
                pa.array(np.diff(bounds), type=pa.int64()),
                pa.array([hashlib.sha256(ids[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts, cuts[1:])], type=pa.string()),
                pa.array([hashlib.sha256(back[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(places, places[1:])], type=pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
