"""Byte-level BPE by prefix dynamic programming.

For a piece of text every byte prefix has exactly one valid last token: the one with which
its BPE encoding ends. A token is that last one when it ends the prefix and the pair (last
token of the shorter prefix, token) is what BPE makes of the two tokens' bytes. Keeping the
last token of each prefix gives the encoding by walking back, lets bytes be appended
without starting over, and after an edit only the prefixes from the edit on change.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, U64, HashTable, SpanHasher, bounded_batches, mix, text_chunks, worker_cache

#: Fixed value: the public split pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


class Vocabulary:
    """Ranks with what the dynamic programme asks of them."""

    PAIRS, EDGES = 500_000, 20_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        # finds every token that ends at each byte, longest first; bytes as Latin-1
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE: merge the lowest-ranked neighbours until none merges."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edge(self, t: int, right: bool) -> list[tuple[int, int, float]]:
        """The tokens that stand at one edge of token t while BPE builds it, each with the
        rank at which it comes and the rank at which a merge takes it (never: infinite)."""
        known = self._edges[right].get(t)
        if known is None:
            data, rank, at = self.token[t], self.ranks.get, -right
            parts = [data[i : i + 1] for i in range(len(data))]
            known, came = [], 0
            while len(parts) > 1:
                best = min(
                    (r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None
                )
                edge, came_next = parts[at], max(came, best[0])
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
                if parts[at] != edge:
                    known.append((self.ranks[edge], came, came_next))
                    came = came_next
            known.append((t, came, float("inf")))
            if len(self._edges[right]) >= self.EDGES:
                self._edges[right].clear()
            self._edges[right][t] = known
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' bytes is these two tokens: no merge across their
        border may come before the merges that build them. Of equal ranks the left one
        goes first."""
        known = self._fits.get(a << 32 | b)
        if known is None:
            known, token, rank = True, self.token, self.ranks.get
            for x, x_from, x_to in self._edge(a, True):
                for y, y_from, y_to in self._edge(b, False):
                    m = rank(token[x] + token[y])
                    if m is not None and (m := max(m, x_from, y_from)) < x_to and m <= y_to:
                        known = False
            if len(self._fits) >= self.PAIRS:
                self._fits.clear()
            self._fits[a << 32 | b] = known
        return known

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PrefixEncoder:
    """The last tokens of all prefixes of one piece; ``append`` and ``replace`` are exact."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last = array("i")  # last[i]: last token of data[:i + 1]
        self.append(data)

    def append(self, more: bytes) -> None:
        v, last, start = self.vocabulary, self.last, len(self.data)
        data = self.data = self.data + more
        last.frombytes(bytes(last.itemsize * len(more)))
        known_fits, fits = v._fits, v.fits
        origin, done = max(0, start - v.longest), start - 1
        for end, (n, token) in v.automaton.iter(data[origin:].decode("latin-1")):
            end += origin
            if end <= done:
                continue
            before = end - n
            if before >= 0:
                known = known_fits.get(last[before] << 32 | token)
                if known is None:
                    known = fits(last[before], token)
                if not known:
                    continue
            last[end] = token
            done = end

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Put ``new`` in place of data[start:stop]. Prefixes before the edit stay. After
        it, last tokens are recomputed only until they agree with the former ones over a
        run as long as the longest token; from there on the former ones hold."""
        tail, was = self.data[stop:], self.last[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(new)
        run = 0
        for i in range(0, len(tail), 64):
            self.append(tail[i : i + 64])
            for now, then in zip(self.last[start + len(new) + i :], was[i : i + 64], strict=True):
                run = run + 1 if now == then else 0
            # every later choice looks back at most `longest` prefixes and all of them agree
            if run > self.vocabulary.longest:
                self.data += tail[i + 64 :]
                self.last += was[i + 64 :]
                return

    def ids(self, upto: int | None = None) -> list[int]:
        out, at, token = [], len(self.last) if upto is None else upto, self.vocabulary.token
        while at:
            t = self.last[at - 1]
            out.append(t)
            at -= len(token[t])
        return out[::-1]


# --- whole chunks ---------------------------------------------------------------------

OTHER, LETTER, NUMBER, SPACE = range(4)
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Letter, number, white space or other, for each code point, as the pattern sees it."""
    if not _KINDS:
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
        kind = np.zeros(0x110000, np.uint8)
        for which, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                kind[m.start() : m.end()] = which
        _KINDS.append(kind)
    return _KINDS[0]


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters of valid UTF-8 start, and their kinds."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    code = buf[at].astype(np.int32)
    wide = np.flatnonzero(code >= 0xC0)
    if len(wide):
        first, where = code[wide], at[wide]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0xFF >> (size + 1))
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | buf[where[more] + k] & 0x3F
        code[wide] = point
    return at, kinds()[code]


def piece_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the matches of PATTERN start in each text of a chunk, sorted.

    Matches are runs of one kind, with these turns: of white space before another kind, the
    last character is apart, and if it is a blank it belongs to what follows; an apostrophe
    that starts a match takes s, t, m, d, re, ve or ll with it and nothing else."""
    at, kind = characters(buf)
    if not len(at):
        return at
    byte = buf[at]
    text = np.zeros(len(buf) + 1, bool)
    text[offs[:-1]] = True
    first = text[at]
    last = np.append(first[1:], True)
    before, after = np.roll(kind, 1), np.roll(kind, -1)
    space = kind == SPACE
    edge = space & ~last & (after != SPACE)  # the last of a run of white space
    joined = edge & (byte == 0x20)  # belongs to what follows
    start = first | (kind != before) | edge
    start[1:] &= ~joined[:-1] | first[1:]
    # contractions, from the left, as each decides where the next match starts
    quote = np.flatnonzero(start & (byte == 0x27) & ~last)
    if len(quote):
        text_end = np.searchsorted(at, offs[1:])[np.searchsorted(offs, at[quote], side="right") - 1]
        one = byte[quote + 1]
        two = byte[np.minimum(quote + 2, len(at) - 1)]
        room = text_end - quote
        length = np.where(np.isin(one, list(b"stmd")), 2, 0)
        pair = ((two == 0x65) & ((one == 0x72) | (one == 0x76))) | ((two == 0x6C) & (one == 0x6C))
        length = np.where(pair & (room > 2), 3, length)
        taken = quote[length > 0]
        length = length[length > 0]
        start[taken + 1] = False
        ends = taken + length
        # what follows a contraction starts a match of its own
        start[ends[ends < len(at)]] = True
    return at[start]


class PieceEncoder:
    """The prefix dynamic programme for many pieces at once: pieces of one length advance
    together, byte by byte. Tokens are looked up by a hash of their bytes; that the tokens
    spell the text is checked afterwards."""

    LONG = 32  # bytes; longer pieces one by one
    WIDTH = 12  # tokens at an edge; longer edges one by one
    BATCH = 200_000  # bytes
    LIKELY = [3, 2, 4, 5, 1, *range(6, 33)]
    SHIFT = U64(64 - 21)

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        tokens = [t for t in v.ranks if len(t) <= self.LONG]
        size = np.array([len(t) for t in tokens])
        ends = np.cumsum(size)
        hasher = SpanHasher(np.frombuffer(b"".join(tokens), np.uint8))
        self.longest = int(size.max())
        h = hasher.of(ends - size, ends)
        self.tokens = HashTable(len(tokens)).put(h, np.array([v.ranks[t] for t in tokens], np.int32))
        self.maybe = np.zeros(2**21, bool)  # most strings are no tokens, and one look shows it
        self.maybe[h >> self.SHIFT] = True
        self.length = np.zeros(max(v.token) + 1, np.int64)
        self.length[list(v.token)] = [len(t) for t in v.token.values()]
        a, b, rank = [], [], []
        get = v.ranks.get
        for t, r in v.ranks.items():
            for i in range(1, len(t)):
                x = get(t[:i])
                if x is not None and (y := get(t[i:])) is not None:
                    a.append(x)
                    b.append(y)
                    rank.append(r)
        self.merges = HashTable(len(a)).put(self._pair(np.array(a, np.int32), np.array(b, np.int32)), np.array(rank, np.int32))
        n = max(v.token) + 1
        self.edges = [[np.full((n, self.WIDTH), -1, np.int32) for _ in range(3)] for _ in range(2)]
        self.known = [np.zeros(n, np.int8), np.zeros(n, np.int8)]  # 1: in edges, 2: too long for them
        self.pairs = HashTable(self.vocabulary.PAIRS)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((a.astype(np.uint64) + U64(1)) << U64(32) | b.astype(np.uint64))  # never 0

    def _with_edges(self, tokens: np.ndarray, right: int) -> None:
        for t in np.unique(tokens[self.known[right][tokens] == 0]).tolist():
            found = self.vocabulary._edge(t, bool(right))
            self.known[right][t] = 1 if len(found) <= self.WIDTH else 2
            if len(found) <= self.WIDTH:
                for column, values in zip(self.edges[right], zip(*found, strict=True), strict=True):
                    column[t, : len(found)] = [min(x, 2**31 - 1) for x in values]

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As Vocabulary.fits, for many pairs."""
        self._with_edges(a, 1)
        self._with_edges(b, 0)
        ok = np.ones(len(a), bool)
        (xs, x_from, x_to), (ys, y_from, y_to) = self.edges[1], self.edges[0]
        x, y = xs[a], ys[b]
        # every token at the one edge beside every token at the other
        row, i, j = np.nonzero((x >= 0)[:, :, None] & (y >= 0)[:, None, :])
        m = self.merges.find(self._pair(x[row, i], y[row, j]))
        hit = np.flatnonzero(m >= 0)
        row, i, j, m = row[hit], i[hit], j[hit], m[hit]
        p, q = a[row], b[row]
        m = np.maximum(m, np.maximum(x_from[p, i], y_from[q, j]))
        ok[row[(m < x_to[p, i]) & (m <= y_to[q, j])]] = False
        for r in np.flatnonzero((self.known[1][a] == 2) | (self.known[0][b] == 2)):
            ok[r] = self.vocabulary.fits(int(a[r]), int(b[r]))
        return ok

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = self._pair(a, b)
        known = self.pairs.find(key)
        new = np.flatnonzero(known < 0)
        if len(new):
            _, pick, back = np.unique(key[new], return_index=True, return_inverse=True)
            value = self._fits(a[new[pick]], b[new[pick]])
            known[new] = value[back]
            if self.pairs.n + len(pick) > self.vocabulary.PAIRS:
                self.pairs = HashTable(self.vocabulary.PAIRS)
            if len(pick) <= self.vocabulary.PAIRS:
                self.pairs.put(key[new[pick]], value.astype(np.int32))
        return known > 0

    def tokens_by_end(self, buf: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        """For k = 1, 2, ...: the token of the k bytes before each end (-1: none), where
        ``place`` bytes of the end's own piece stand before it."""
        hasher, out = SpanHasher(buf), []
        for k in range(1, min(self.longest, int(place.max())) + 1):
            token = np.full(len(place), -1, np.int32)
            end = np.flatnonzero(place >= k)
            h = hasher.of(end - k, end)
            some = np.flatnonzero(self.maybe[h >> self.SHIFT])
            token[end[some]] = self.tokens.find(h[some])
            out.append(token)
        return out

    def last_tokens(self, buf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The last token of each prefix, for pieces one after the other in a buffer, from the
        longest to the shortest."""
        start = np.cumsum(size) - size
        place = np.ones(len(buf) + 1, np.int32)
        place[0] = 0
        place[start[1:] + 1] -= size[:-1]
        by_length = self.tokens_by_end(buf, np.cumsum(place))
        last = np.full((int(size[0]) + 1, len(size)), -1, np.int32)
        for j in range(1, len(last)):
            open_ = np.arange(np.searchsorted(-size, -j, side="right"))
            end = start[open_] + j
            # the prefix itself, then the likeliest lengths
            for k in [j, *(k for k in self.LIKELY if k < j)]:
                if k > len(by_length):
                    continue
                token = by_length[k - 1][end]
                hit = np.flatnonzero(token >= 0)
                if k < j and len(hit):
                    hit = hit[self.fits(last[j - k, open_[hit]], token[hit])]
                if len(hit):
                    last[j, open_[hit]] = token[hit]
                    rest = np.ones(len(open_), bool)
                    rest[hit] = False
                    open_, end = open_[rest], end[rest]
                    if not len(open_):
                        break
        return last

    def encode(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens, all ids) of pieces of a buffer."""
        v, found = self.vocabulary, []  # piece, number from its end, id
        order = np.argsort(-size, kind="stable")
        long = order[: np.searchsorted(-size[order], -self.LONG)]
        for r in long.tolist():
            ids = np.array(PrefixEncoder(v, buf[start[r] : start[r] + size[r]].tobytes()).ids(), np.int32)
            found.append((np.full(len(ids), r), np.arange(len(ids), 0, -1), ids))
        order = order[len(long) :]
        for rows in np.split(order, np.searchsorted(np.cumsum(size[order]), range(self.BATCH, int(size[order].sum()), self.BATCH))):
            if not len(rows):
                continue
            n = size[rows]
            last = self.last_tokens(_gathered(buf, size, rows) if start[0] == 0 and len(size) > 1 else buf[start[rows[0]] :][: n[0]], n)
            at, step, left = n.copy(), 0, np.arange(len(rows))
            while len(left):
                token, step = last[at[left], left], step + 1
                if (token < 0).any():
                    raise ValueError("a byte without a token")
                found.append((rows[left], np.full(len(left), step), token))
                at[left] -= self.length[token]
                left = left[at[left] > 0]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        piece, back, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        count = np.bincount(piece, minlength=len(start))
        out = np.empty(len(ids), np.int32)
        out[np.cumsum(count)[piece] - back] = ids
        return count, out


def _gathered(values: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of ``values`` (run i has count[i]) in the order ``at``."""
    first, size = (np.cumsum(count) - count)[at], count[at]
    return values[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]


class TextEncoder:
    """Encodes chunks of texts: pieces are cut out, the different ones encoded once and the
    texts put together by index. Nothing is kept from chunk to chunk but which pairs of
    tokens fit."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.vocabulary, self.pieces = vocabulary, PieceEncoder(vocabulary)
        self.split = None if pattern == PATTERN else regex.compile(pattern)
        n = max(vocabulary.token) + 1
        self.bytes = pa.array([vocabulary.token.get(i, b"") for i in range(n)], pa.large_binary())
        self.decimal = pa.array([f"{i} ".encode() for i in range(n)], pa.large_binary())

    def starts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.split is None:
            return piece_starts(buf, offs)
        data, out = buf.tobytes(), []
        for low, high in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            at = low
            for piece in self.split.findall(data[low:high].decode("utf-8")):
                out.append(at)
                at += len(piece.encode("utf-8"))
            if at != high:
                raise ValueError("the pattern leaves characters out")
        return np.array(out, np.int64)

    def ids(self, buf: np.ndarray, offs: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of the texts, ids) of a chunk of which pieces start at ``start``."""
        data = pa.py_buffer(np.ascontiguousarray(buf))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(buf)).astype(np.int64)), data])
        coded = pieces.dictionary_encode()
        different, at = coded.dictionary, np.asarray(coded.indices)
        if not len(at):
            return np.zeros(len(offs), np.int64), np.zeros(0, np.int32)
        _, ends, flat = different.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(different) + 1]
        count, ids = self.pieces.encode(np.frombuffer(flat, np.uint8)[: ends[-1]], ends[:-1], np.diff(ends))
        total = np.concatenate([[0], np.cumsum(count[at])])
        return total[np.searchsorted(start, offs)], _gathered(ids, count, at)

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
        return _taken(self.bytes, ids)

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """Each id in decimals with a blank after it."""
        return _taken(self.decimal, ids)

    def encode(self, text: str) -> list[int]:
        buf = np.frombuffer(text.encode("utf-8"), np.uint8)
        offs = np.array([0, len(buf)])
        return self.ids(buf, offs, self.starts(buf, offs))[1].tolist()

    def decode(self, ids) -> bytes:
        return self.vocabulary.decode(ids)


def _taken(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
    flat = table.take(pa.array(ids))
    _, ends, data = flat.buffers()
    if not len(ids):
        return np.zeros(1, np.int64), memoryview(b"")
    ends = np.frombuffer(ends, np.int64)[: len(ids) + 1]
    return ends, memoryview(data).cast("B")[: ends[-1]]


def _encoder(data: bytes, pattern: str) -> TextEncoder:
    return worker_cache(("bpe", hash(data), len(data), pattern), lambda: TextEncoder(Vocabulary(parse_ranks(data)), pattern))


def _parts(encoder: TextEncoder, buf: np.ndarray, offs: np.ndarray):
    """(bytes, offsets, piece starts): the chunk as it is, or one very long text in parts that
    end where pieces end."""
    start = encoder.starts(buf, offs)
    if len(offs) > 2 or len(buf) <= 2 * CHUNK_BYTES:
        yield buf, offs, start
        return
    cut = np.unique(np.searchsorted(start, np.arange(0, len(buf), CHUNK_BYTES)))
    for a, b in zip(cut, np.append(cut[1:], len(start)), strict=True):
        if a < b:
            low, high = start[a], start[b] if b < len(start) else len(buf)
            yield buf[low:high], np.array([0, high - low]), start[a:b] - low


def encode_documents(
    docs: DataFrame, vocabulary_path: str, pattern: str = PATTERN, *, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encode and decode each text: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and,
    if asked for, ``token_ids``.

    One map over the rows: no shuffle. The vocabulary file (under 1 MB) is read on the
    driver and broadcast. A null text is empty: no tokens, and the digests of nothing.
    Repeated rows give repeated results; an empty table gives an empty one; other columns,
    whatever their names, are not read. A very long text is encoded in parts that end where
    units end; what is written for a batch is cut by bytes, not by rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields.append(("token_ids", pa.list_(pa.int32())))

    def run(batches):
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            for at, buf, offs in text_chunks(batch.column(1), 2 * CHUNK_BYTES):
                n = len(offs) - 1
                tokens, ids, sha_ids, sha_data = np.zeros(n, np.int64), [], [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
                for k, (part, cut, start) in enumerate(_parts(encoder, buf, offs)):
                    first, found = encoder.ids(part, cut, start)
                    text_ends, text = encoder.decimals(found)
                    data_ends, data = encoder.decoded(found)
                    if not np.array_equal(np.frombuffer(data, np.uint8), part):
                        raise ValueError("tokens that do not spell the text: two strings of one hash")
                    tokens += np.diff(first)
                    for d in np.flatnonzero(np.diff(first)).tolist():
                        if k:  # a text in parts: the blank between two of them
                            sha_ids[d].update(b" ")
                        sha_ids[d].update(text[text_ends[first[d]] : text_ends[first[d + 1]] - 1])
                        sha_data[d].update(data[data_ends[first[d]] : data_ends[first[d + 1]]])
                    if with_ids:
                        ids.append(found)
                columns = [batch.column(0).slice(at, n), pa.array(tokens), pa.array([x.hexdigest() for x in sha_ids]), pa.array([x.hexdigest() for x in sha_data])]
                if with_ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum(tokens)]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col] + [n for n, _ in fields])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)
