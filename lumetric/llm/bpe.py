"""Byte-level BPE as a lazily determinised finite-state transducer.

Encoding. Let last(i) be the last token of the encoding of a text's first i
bytes. A byte-level BPE encoding is valid exactly if every two neighbours encode
together as themselves, so last(i) is the one token that ends at i and is
compatible with the last token before it. The merge table is compiled into that
relation; the transducer's state is what the future can still depend on:

    live places   the ends i' of the read text from which a token that goes
                  beyond the read text can start (the read text after i' is an
                  inner node of the vocabulary's trie), and the end of the text
    for each      last(i')

On a byte, every live place is extended: one where a token ends gives the new
end its last token, one where no token can go on is dropped. The transition's
output is last(i), from which the ids are read backwards. Ids are emitted at the
end of a piece, and within a long one every WINDOW bytes up to where the ways
back from all live places meet: a live place is at most a token's length back,
so the lookahead is bounded. States are found on demand and numbered: a
(state, byte) entry of the table is computed the first time it is met, the
determinised machine is never built whole, and a full table starts again from
the present state, within a piece too, which changes no result.

Decoding. Tokens are byte strings, and a token may end within a character. An
incremental UTF-8 state machine reads them: its states are the unfinished
sequences (at most 3 bytes), and its transitions by token are memoised. Runs of
tokens that are whole characters don't leave its first state.

Texts come in Arrow batches bounded by bytes. They are split some megabytes at a
time, by the classes of their code points; each distinct piece of a part is encoded
once, and texts of over a million characters go alone, in blocks. A worker holds the machine's table (bounded
by entries) and a memo of short pieces (bounded by bytes).

Defined results
    null text       encoded as the empty text: no ids
    empty text      no ids; digests of nothing
    very long text  whole text; memory follows the text's ids
    repeated rows   each gets its own row
    empty table     empty result
    null doc_id     carried along
    other columns   ignored
    ids outside the vocabulary raise KeyError; bytes that aren't UTF-8 decode to U+FFFD
    as Python's "replace" does
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, take

RANKS = "byte_bpe_50k.tiktoken"
#: Entries after which the transducer's table starts again, and bytes after which the memo of pieces does.
MOST_STATES, MEMO_BYTES = 400_000, 64_000_000
#: Characters of a text that are split at once, of a memoised piece at most, and bytes of a piece between two emissions.
BLOCK, SHORT, WINDOW = 1_000_000, 64, 1 << 16
#: Bits of a token number (and one more value) in packed pairs.
BITS = 17
MASK = (1 << BITS) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[int]:
    """The encoding by its definition: join the lowest-ranked neighbours, leftmost
    first, by the merges of a rank under `below`."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if ranks.get(parts[best] + parts[best + 1], below) >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """step(state, byte) -> next state << BITS | last token; state 0 is the start."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES) -> None:
        if max(ranks.values(), default=0) + 1 >= MASK:
            raise ValueError(f"token numbers up to {MASK - 2} only")
        self.ranks, self.most_states = ranks, most_states
        self.spelled = {i: b for b, i in ranks.items()}
        # the trie of all tokens: node << 8 | byte -> node, its token or -1, whether it goes on, its depth
        self.child: dict[int, int] = {}
        self.token, self.inner, self.depth = [-1], [False], [0]
        for text, i in ranks.items():
            node = 0
            for byte in text:
                at = node << 8 | byte
                if at not in self.child:
                    self.child[at] = len(self.token)
                    self.inner[node] = True
                    self.token.append(-1)
                    self.inner.append(False)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[at]
            self.token[node] = i
        self.fits: dict[int, bool] = {}
        self.edges: dict[int, tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None] = {}
        self.states: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: dict[int, int] = {}
        self.clear()

    def clear(self) -> None:
        # a state: (node << BITS | last token + 1, ...) of the live places, the furthest back first
        for held in (self.states, self.number, self.table, self.fits):
            held.clear()
        self.numbered((0,))

    def numbered(self, state: tuple[int, ...]) -> int:
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
        return number

    def spines(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None:
        """The token's left and right edge parts, each with the rank at which it
        is merged away (the token itself never is); None if it never arises."""
        if token not in self.edges:
            text, whole = self.spelled[token], None
            if merged(text, self.ranks) == [token]:
                whole = ([(text, 1 << 60)], [(text, 1 << 60)])
                if len(text) > 1:
                    left, right = (self.spelled[i] for i in merged(text, self.ranks, below=token))
                    for side, part in ((0, left), (1, right)):
                        inner = self.spines(self.ranks[part])[side]
                        whole[side].extend([(part, token), *inner[1:]])
            self.edges[token] = whole
        return self.edges[token]

    def compatible(self, before: int | None, token: int) -> bool:
        """Whether the two encode together as themselves (and the token alone as
        itself): no part at the left one's end merges with one at the right one's
        beginning while both are there. Equal ranks merge leftmost first."""
        own, rank_of = self.spines(token), self.ranks.get
        if own is None or before is None:
            return own is not None
        for a, until_a in self.spines(before)[1]:
            for b, until_b in own[0]:
                rank = rank_of(a + b)
                if rank is not None and rank < until_a and rank <= until_b:
                    return False
        return True

    def step(self, state: int, byte: int) -> int:
        places = self.states[state]
        if len(self.table) >= self.most_states:
            self.clear()
            state = self.numbered(places)
        child, token, inner, fits = self.child, self.token, self.inner, self.fits
        live, end = [], -1
        for place in places:
            node = child.get((place >> BITS) << 8 | byte)
            if node is None:
                continue
            last = place & MASK
            if end < 0 and (new := token[node]) >= 0:
                pair = last << BITS | new
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = self.compatible(last - 1 if last else None, new)
                if fit:
                    end = new
            if inner[node]:
                live.append(node << BITS | last)
        live.append(end + 1)
        go = self.table[state << 8 | byte] = self.numbered(tuple(live)) << BITS | end
        return go

    def way_back(self, last: array, at: int) -> list[int]:
        out, spelled = [], self.spelled
        while at:
            out.append(last[at - 1])
            at -= len(spelled[last[at - 1]])
        return out[::-1]

    def settle(self, state: int, last: array) -> list[int]:
        """Ids up to where the ways back from all live places meet; `last` then begins there."""
        ends = {len(last) - self.depth[place >> BITS] for place in self.states[state]}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - len(self.spelled[last[far - 1]]))
        at = ends.pop()
        out = self.way_back(last, at)
        del last[:at]
        return out

    def encode(self, piece: bytes) -> list[int]:
        known, step, state, last, out = self.table.get, self.step, 0, array("i"), []
        for at in range(0, len(piece), WINDOW):
            if at:
                out += self.settle(state, last)
            for byte in piece[at : at + WINDOW]:
                go = known(state << 8 | byte)
                if go is None:
                    go = step(state, byte)
                state = go >> BITS
                last.append(go & MASK)
        return out + self.way_back(last, len(last))


def utf8_advance(pending: bytes, data: bytes, final: bool = False) -> tuple[str, bytes]:
    """Reads data in the state `pending` (an unfinished sequence): the text that
    is complete, and the new state. What can't be UTF-8 becomes U+FFFD, one for
    each longest beginning of a sequence."""
    text, seq = [], bytearray(pending)
    for byte in data:
        while True:
            if not seq:
                if byte < 0x80:
                    text.append(chr(byte))
                elif 0xC2 <= byte <= 0xF4:
                    seq.append(byte)
                else:
                    text.append("\ufffd")
                break
            lead, low, high = seq[0], 0x80, 0xBF
            if len(seq) == 1:
                low, high = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low), {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
            if low <= byte <= high:
                seq.append(byte)
                if len(seq) == (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    text.append(seq.decode("utf-8"))
                    seq.clear()
                break
            text.append("\ufffd")
            seq.clear()
    if final and seq:
        text.append("\ufffd")
        seq.clear()
    return "".join(text), bytes(seq)


class StreamDecoder:
    """Ids in, text out, as far as characters are complete."""

    MOST_MOVES = 200_000

    def __init__(self, spelled: dict[int, bytes]) -> None:
        self.spelled = spelled
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        #: By id: the text of tokens that are whole characters, None for all others.
        self.closed = np.full(max(spelled, default=0) + 1, None, object)
        for i, b in spelled.items():
            text, rest = utf8_advance(b"", b)
            if not rest and "\ufffd" not in text:
                self.closed[i] = text
        self.open = np.equal(self.closed, None)

    def move(self, state: bytes, token: int) -> tuple[str, bytes]:
        key = (state, token)
        if key not in self.moves:
            if len(self.moves) >= self.MOST_MOVES:
                self.moves.clear()
            self.moves[key] = utf8_advance(state, self.spelled[token])
        return self.moves[key]

    def decode(self, ids: Iterable[int]) -> str:
        ids = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.closed):
            raise KeyError("an id outside the vocabulary")
        parts, at = self.closed[ids].tolist(), 0
        for begin in np.flatnonzero(self.open[ids]).tolist():
            if begin < at:
                continue
            at, state = begin, b""
            while at == begin or (state and at < len(ids)):
                parts[at], state = self.move(state, int(ids[at]))
                at += 1
            if state:
                parts.append(utf8_advance(state, b"", final=True)[0])
        return "".join(parts)


# ---- splitting -------------------------------------------------------------

SPLIT = regex.compile(public_tokenizers.PATTERN)
LETTER, NUMBER, SPACE, OTHER = range(4)
#: What an apostrophe takes of the letters behind it: one of these, or two (fixed values of the pattern).
ONE, TWO = "stmd", ("re", "ve", "ll")


@functools.cache
def classes() -> np.ndarray:
    """The pattern's class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, text):
            low, high = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
            out[low : high + 1] = kind
    return out


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in texts that stand one after the other.
    points: their code points; text_starts: where each (none empty) begins.

    A match is a run of one class, but for three rules: the last white-space character
    before a run is a match of its own, or part of the run's if it is a blank; an
    apostrophe alone that begins a match takes its one or two letters; white space at
    a text's end is one match.
    """
    kind = classes()[points]
    first = np.zeros(len(points), bool)
    first[text_starts] = True
    run = np.flatnonzero(first | np.r_[True, kind[1:] != kind[:-1]])
    of, size, last = kind[run], np.diff(np.r_[run, len(points)]), np.r_[first[run[1:]], True]
    begins = np.zeros(len(points) + 1, bool)
    begins[run] = True
    after = run[(of == SPACE) & ~last] + size[(of == SPACE) & ~last]  # starts of runs behind white space
    begins[after - 1] = True
    begins[after[points[after - 1] == 0x20]] = False
    at = np.flatnonzero((of == OTHER) & (size == 1) & ~last & (points[run] == ord("'")) & begins[run])
    at = at[of[at + 1] == LETTER]
    letters, length = run[at + 1], size[at + 1]
    one, two = points[letters], points[np.minimum(letters + 1, len(points) - 1)]
    taken = np.isin(one, [ord(c) for c in ONE]).astype(np.int64)
    for a, b in TWO:
        taken[(length > 1) & (one == ord(a)) & (two == ord(b))] = 2
    letters, length, taken = letters[taken > 0], length[taken > 0], taken[taken > 0]
    begins[letters] = False
    rest = letters + taken
    begins[rest[length > taken]] = True
    return np.flatnonzero(begins[:-1])


def offsets_of(texts: pa.StringArray) -> np.ndarray:
    """Where each text ends in the array's bytes, the first's start before."""
    held = texts.buffers()[1]
    return np.frombuffer(held, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if held else np.zeros(len(texts) + 1, np.int64)


def cut(texts: pa.StringArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of the texts (null: empty), each piece's number among them,
    and the texts' offsets among the pieces."""
    ends = offsets_of(texts)
    held = texts.buffers()[2] or pa.py_buffer(b"")
    data = held.slice(int(ends[0]), int(ends[-1] - ends[0]))
    ends -= ends[0]
    if not data.size:
        return [], np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), "<u4")
    byte_at = np.r_[0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64))]
    whole = np.searchsorted(byte_at, ends[:-1][np.diff(ends) > 0])
    starts = byte_at[piece_starts(points, whole)]
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, data.size].astype(np.int32).tobytes()), data).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64), np.searchsorted(starts, ends)


def pieces(text: str, block: int = BLOCK) -> Iterator[list[str]]:
    """The matches of the tokenizer's pattern, in order, by blocks of a long text. A match
    depends on the text from its start to one character behind its end, so all
    but the last of a block are those of the whole text; the next block begins
    with that one."""
    at, size = 0, block
    while len(text) - at > size:
        found = SPLIT.findall(text, at, at + size)
        if len(found) < 2:
            size *= 2
            continue
        last = found.pop()
        yield found
        at, size = at + size - len(last), block
    yield SPLIT.findall(text, at)


def gather(packed: list[bytes], numbers: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text, the ids (4 bytes each) of its pieces."""
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    flat = np.frombuffer(b"".join(packed), "<u4")
    begin = np.r_[0, np.cumsum(sizes)]
    each = sizes[numbers]
    ends = np.r_[0, np.cumsum(each)]
    at = np.repeat(begin[numbers] - ends[:-1], each)
    at += np.arange(len(at))
    ids, ends = flat[at], ends[offsets].tolist()
    return [ids[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]


class Memo(dict):
    """piece -> ids of 4 bytes each, by `encode` (of a list of pieces); forgets all when it
    holds `most` bytes."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], most: int = MEMO_BYTES) -> None:
        self.encode, self.most, self.held = encode, most, 0

    def all(self, distinct: list[str]) -> list[bytes]:
        out = list(map(self.get, distinct))
        if None in out:
            new = [i for i, ids in enumerate(out) if ids is None]
            for i, ids in zip(new, self.encode([distinct[i] for i in new]), strict=True):
                out[i] = ids
                if len(distinct[i]) <= SHORT:
                    self.held += len(distinct[i]) + len(ids) + 180
                    if self.held > self.most:
                        self.clear()
                        self.held = 0
                    self[distinct[i]] = ids
        return out

    def long_ids(self, text: str) -> np.ndarray:
        """The ids of a whole text, block by block."""
        return np.frombuffer(b"".join([x for found in pieces(text) for x in self.all(found)]), "<u4")

    def text_ids(self, texts: pa.StringArray, alone: Callable[[str], np.ndarray] | None = None, apart: Callable[[str], bool] | None = None) -> list[np.ndarray]:
        """The ids of each whole text, uint32. Texts longer than a block go one by one,
        as do those that `apart` names, by `alone`."""
        odd = {}
        if len(texts) == 1 and len(texts[0].as_py() or "") > BLOCK:
            odd[0] = (self.long_ids if apart is None or not apart(texts[0].as_py()) else alone)(texts[0].as_py())
            return [odd[0]]
        if apart is not None:
            odd = {i: alone(t) for i, t in enumerate(texts.to_pylist()) if t and apart(t)}
        out = gather_cut(self, texts)
        for i, ids in odd.items():
            out[i] = ids
        return out


def gather_cut(memo: Memo, texts: pa.StringArray) -> list[np.ndarray]:
    distinct, numbers, offsets = cut(texts)
    return gather(memo.all(distinct), numbers, offsets)


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def sliced(batches: Iterable[pa.RecordBatch], column: int | None = None, rows: int = 2048, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows and, where there are several, bytes of a string column."""
    for batch in batches:
        ends = offsets_of(batch.column(column)) if column is not None else None
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            if ends is not None:
                n = min(n, max(1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1 - at))
            yield batch.slice(at, n)
            at += n


class Codec:
    """The transducer, the decoder and a bounded memo of pieces; one in each worker."""

    _held: dict[int, Codec] = {}

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.machine = Transducer(ranks)
        self.decoder = StreamDecoder(self.machine.spelled)
        self.memo = Memo(lambda found: [pack(self.machine.encode(piece.encode("utf-8"))) for piece in found])

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Codec:
        if id(ranks) not in cls._held:
            cls._held = {id(ranks): cls(ranks)}
        return cls._held[id(ranks)]


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# ---- the operators ---------------------------------------------------------


def _ranks(spark: SparkSession, path: str | None):
    """The vocabulary, read by the driver (its size is the file's: under 1 MB) and broadcast."""
    return spark.sparkContext.broadcast(load_ranks(path or public_tokenizers.path(RANKS)))


def _texts(docs: DataFrame) -> DataFrame:
    return take(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<bigint> for every row."""
    ranks = _ranks(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Codec.of(ranks.value).memo
        for b in sliced(batches, 1):
            ids = [x.astype(np.int64) for x in memo.text_ids(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, ids array<bigint>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; a null list decodes to the empty text."""
    ranks = _ranks(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Codec.of(ranks.value).decoder
        for b in sliced(batches):
            texts = [decoder.decode(x.as_py() or ()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return take(encoded, "doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    ranks = _ranks(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks.value)
        for b in sliced(batches, 1):
            sizes, of_ids, of_text = [], [], []
            for ids in codec.memo.text_ids(b.column(1)):
                sizes.append(len(ids))
                of_ids.append(sha(ids.tobytes()))
                of_text.append(sha(codec.decoder.decode(ids).encode("utf-8")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
