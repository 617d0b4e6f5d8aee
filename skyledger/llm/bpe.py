"""Byte-level BPE encoding and decoding by replaying the merges over a corpus.

The pieces of many texts are one corpus: each distinct piece stands in it once.  An inverted index
leads from a token pair to the places where it stands; the merges run in rank order over the whole
corpus, each visits only the places of its own pair, and only the two neighbours of a merged place
get new index entries.  A piece's tokens depend on the piece alone, so Spark cuts the input in
blocks, and every block is a corpus of its own; nothing is shuffled, and no vocabulary of the whole
input is gathered anywhere.

Cases: a null or empty text has no tokens, and decodes to no bytes.  Repeated rows give repeated
results.  An empty table gives an empty one.  Columns beside the id and the text are kept by
`encode_column` and ignored by `token_digests`.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from skyledger.llm.common import blocks, span_hashes, text_bytes

#: Text bytes that make one corpus.
CORPUS_BYTES = 2 << 20
#: Distinct pieces whose tokens a worker remembers between corpora.
REMEMBERED = 100_000

_books: dict[str, "Codebook"] = {}
_kinds: list[np.ndarray] = []
SPACE, LETTER, NUMBER, OTHER = range(4)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def char_kinds() -> np.ndarray:
    """For each code point whether it is white space, a letter, a number or something else."""
    if not _kinds:
        every = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
        kinds = np.full(0x110000, OTHER, dtype=np.uint8)
        for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            kinds[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), dtype=np.uint32)] = kind
        _kinds.append(kinds)
    return _kinds[0]


def piece_starts(chars: np.ndarray, firsts: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """Where the matches of the split pattern begin, over the code points of texts laid end to end.

    firsts: where the texts begin; kinds: of all code points, `char_kinds` if not given.  The pattern is public_tokenizers.PATTERN: contractions, runs of
    letters, numbers or other signs with one blank before them, and white space of which the last
    character before a sign stands alone or joins it.  Whatever the texts, the matches cover them.
    """
    n = len(chars)
    kinds = (char_kinds() if kinds is None else kinds)[chars]
    edge = np.zeros(n + 1, dtype=bool)
    edge[firsts] = True
    edge[n] = True
    run = edge[:n].copy()
    run[1:] |= kinds[1:] != kinds[:-1]
    white = kinds == SPACE
    blank = chars == 0x20
    joined = np.zeros(n, dtype=bool)  # a sign right after a blank of its own text
    joined[1:] = ~white[1:] & blank[:-1] & ~edge[1:n]
    start = run & ~joined
    last = np.zeros(n, dtype=bool)  # white space right before a sign of its own text
    last[:-1] = white[:-1] & ~white[1:] & ~edge[1:n]
    start |= last
    quotes = np.flatnonzero((chars == 0x27) & start & run)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[(kinds[quotes + 1] == LETTER) & ~edge[quotes + 1]]
    if len(quotes):
        one = chars[quotes + 1]
        there = (quotes + 2 < n) & ~edge[np.minimum(quotes + 2, n)]
        two = np.where(there, chars[np.minimum(quotes + 2, n - 1)], 0)
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for x, y in ("re", "ve", "ll"):
            length = np.where((one == ord(x)) & (two == ord(y)), 2, length)
        quotes, length = quotes[length > 0], length[length > 0]
        start[quotes + 1] = False
        after = quotes + 1 + length
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Codebook:
    """Ranks, and what this worker has encoded so far."""

    def __init__(self, path: str):
        self.ranks = ranks = read_ranks(path)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        found = [(ranks[token[:i]] << 32 | ranks[token[i:]], rank) for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        found.sort()
        self.pair_keys = np.array([k for k, _ in found] + [1 << 62], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in found] + [-1], dtype=np.int64)
        self.known: dict[bytes, bytes] = {}
        self.joined: dict[int, int] = {}  # pair and rank, filled when a piece is first done alone

    @staticmethod
    def of(path: str) -> "Codebook":
        """One for each worker process, so that the file is read once in it."""
        if path not in _books:
            _books[path] = Codebook(path)
        return _books[path]

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of token pairs joined; -1 where that is no token."""
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def alone(self, piece: bytes) -> list[int]:
        """One piece by itself: of the lowest pairs the leftmost is merged, again and again."""
        n = len(piece)
        token, after, before = [int(self.single[b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        if not self.joined:
            self.joined = dict(zip(self.pair_keys[:-1].tolist(), self.pair_ranks.tolist()))
        joined = self.joined
        waiting: list[tuple[int, int, int]] = []  # rank, place and the token right of it when the pair was found

        def enter(at: int) -> None:
            if at >= 0 and after[at] < n and (rank := joined.get(token[at] << 32 | token[after[at]])) is not None:
                heappush(waiting, (rank, at, token[after[at]]))

        for at in range(n - 1):
            enter(at)
        while waiting:
            rank, at, right = heappop(waiting)
            beside = after[at]
            if token[at] < 0 or beside >= n or token[beside] != right or joined.get(token[at] << 32 | right) != rank:
                continue
            token[at], token[beside] = rank, -1
            after[at] = after[beside]
            if after[at] < n:
                before[after[at]] = at
            enter(before[at])
            enter(at)
        return [t for t in token if t >= 0]

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of each piece as little-endian unsigned 32-bit integers.

        Places of a pair that overlap are taken from left to right.  If a merge brings up a pair of
        lower rank, its piece would have taken that one before the rest; such pieces are done alone.
        """
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        heads = np.cumsum(sizes) - sizes
        n = len(data)
        token = self.single[data]
        before = np.arange(-1, n - 1)
        after = np.arange(1, n + 1)
        before[heads] = -1
        after[heads + sizes - 1] = -1
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            there = ranks >= 0
            ranks, places = ranks[there], places[there]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for a, b, rank in zip(bounds, bounds[1:], ranks[bounds[:-1]].tolist()):
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    heappush(waiting, rank)

        places = np.flatnonzero(after >= 0)
        enter(self.merged(token[places], token[places + 1]), places)
        again: list[np.ndarray] = []
        while waiting:
            rank = heappop(waiting)
            lists = index.pop(rank)
            places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            places = places[token[places] >= 0]
            places = places[after[places] >= 0]
            places = places[self.merged(token[places], token[after[places]]) == rank]
            if not len(places):
                continue
            rights = after[places]
            if len(places) > 1 and (chained := places[1:] == rights[:-1]).any():
                first = np.concatenate(([True], ~chained))
                at = np.arange(len(places))
                even = (at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0
                places, rights = places[even], rights[even]
            token[places] = rank
            token[rights] = -1
            beyond = after[rights]
            after[places] = beyond
            linked = beyond >= 0
            before[beyond[linked]] = places[linked]
            firsts, rest = before[places], places[linked]
            firsts = firsts[firsts >= 0]
            near = np.concatenate((firsts, rest))
            ranks = self.merged(token[near], token[after[near]])
            if (low := (ranks >= 0) & (ranks < rank)).any():
                again.append(near[low])
            enter(ranks, near)
        alive = np.flatnonzero(token >= 0)
        flat = token[alive].astype("<u4").tobytes()
        cuts = (np.searchsorted(alive, np.append(heads, n)) * 4).tolist()
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in np.unique(np.searchsorted(heads, np.concatenate(again), side="right") - 1).tolist() if again else ():
            out[i] = np.array(self.alone(pieces[i]), dtype="<u4").tobytes()
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        known, ranks = self.known, self.ranks
        out = [known.get(p) for p in pieces]
        new = [i for i, x in enumerate(out) if x is None]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
        words = []
        for i in new:
            rank = ranks.get(pieces[i])
            if rank is None:
                words.append(i)
            else:
                out[i] = rank.to_bytes(4, "little")
        for i, ids in zip(words, self.replay([pieces[i] for i in words])):
            out[i] = ids
        if len(new) <= REMEMBERED:
            known.update((pieces[i], out[i]) for i in new)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the texts end to end, and where each text's begin and end; null texts have none."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        whole = data.tobytes()
        chars = np.frombuffer(whole.decode().encode("utf-32-le"), dtype=np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # the byte where each character begins
        firsts = np.searchsorted(at, offsets[:-1][offsets[:-1] < len(data)])
        starts = at[piece_starts(chars, firsts)]
        ends = np.append(starts[1:], len(data))
        _, one, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        pieces = [whole[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())]
        ids, bounds = self.laid_out(self.encode_pieces(pieces), which, starts, offsets)
        if not np.array_equal(self.decode(ids)[0], data):  # two pieces of one hash
            ids, bounds = self.laid_out(self.encode_pieces([whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]), np.arange(len(starts)), starts, offsets)
        return ids, bounds

    @staticmethod
    def laid_out(coded: list[bytes], which: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) // 4 for x in coded], dtype=np.int64)
        ids = gathered(np.frombuffer(b"".join(coded), dtype="<u4"), np.cumsum(sizes) - sizes, sizes, which)
        ends = np.concatenate(([0], np.cumsum(sizes[which])))
        return ids, ends[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the tokens, and where each token's bytes begin and end."""
        return gathered(self.bytes, self.begins, self.lengths, ids), np.concatenate(([0], np.cumsum(self.lengths[ids])))


def gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs flat[begins[i] : begins[i] + sizes[i]] of all i in `which`, end to end."""
    n = sizes[which]
    shift = begins[which] - (np.cumsum(n) - n)
    return flat[np.arange(int(n.sum())) + np.repeat(shift, n)]


def _encoded(batches, path: str, text_col: str):
    book = Codebook.of(path)
    for block in blocks(batches, text_col, CORPUS_BYTES):
        yield block, book, *book.encode(block.column(text_col))


def encode_column(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The rows of `docs` with a column of token ids more; an own column of that name is replaced."""
    kept = docs.drop(ids_col)

    def run(batches):
        for block, _, ids, bounds in _encoded(batches, path, text_col):
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*block.columns, lists], names=[*block.schema.names, ids_col])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode_column(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids more; bytes that are no UTF-8 become U+FFFD; null ids give the empty text."""
    kept = rows.drop(text_col)

    def run(batches):
        book = Codebook.of(path)
        for batch in batches:
            texts = [book.decode(np.array(x or [], dtype=np.int64))[0].tobytes().decode("utf-8", "replace") for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], names=[*batch.schema.names, text_col])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())]))


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded, and decoded again."""

    def run(batches):
        for block, book, ids, bounds in _encoded(batches, path, text_col):
            back, ends = book.decode(ids)
            ids, back, cuts = ids.astype("<u4").tobytes(), back.tobytes(), bounds.tolist()
            places = ends[bounds].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(id_col),
                    pa.array(np.diff(bounds), type=pa.int64()),
                    pa.array([hashlib.sha256(ids[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts, cuts[1:])], type=pa.string()),
                    pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(places, places[1:])], type=pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
