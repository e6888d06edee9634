"""Byte-level BPE encoding and decoding with a public rank file.

A text is cut by the vocabulary's pattern; each match is encoded by itself. A segment tree
over the byte positions of a match holds the lowest pair rank of every span, the leftmost
position winning ties; a merge replaces the ranks at the joined position and at its two live
neighbours, and the nodes above them from leaf to root.

Python in the tasks: the merge loop has no DataFrame form, and cutting by the pattern in the
same pass saves an explode of every word. Text and ids travel as Arrow batches, each row is
independent, so a lost task is simply run again.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that the remembered matches of a worker may take, about; they are kept in two halves.
CACHE_BYTES = 128 << 20
#: Bytes of an entry besides its match and its ids: the slots of the dictionary.
ENTRY_BYTES = 100
#: Longest match worth remembering.
CACHE_CHARS = 32
#: Matches of a text that are listed at once.
MATCHES_AT_ONCE = 50_000
#: Nodes, or leaves, below a node of the segment tree: as many as the least of is found about as fast as of two.
FAN = 16
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of a base64 token and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match of the pattern."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 1:
        raise KeyError(f"the vocabulary lacks the byte {piece!r}")
    # A leaf holds rank * n + position, so that the least value is the leftmost lowest rank. A node is the least of FAN below it.
    find = ranks.get
    leaves = [_NONE if (rank := find(piece[i : i + 2])) is None else rank * n + i for i in range(n - 1)]
    leaves.append(_NONE)
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    top, inner = levels[-1], len(levels) > 1
    end = list(range(1, n + 1))  # of the part that starts at a position
    before = list(range(-1, n - 1))  # start of the part to the left
    while (least := min(top)) != _NONE:
        at = least % n
        gone = end[at]
        end[at] = stop = end[gone]
        leaves[gone] = leaves[at] = _NONE
        if stop < n:
            before[stop] = at
            rank = find(piece[at : end[stop]])
            if rank is not None:
                leaves[at] = rank * n + at
        left = before[at]
        if left >= 0:
            rank = find(piece[left:stop])
            leaves[left] = _NONE if rank is None else rank * n + left
        if inner:
            places = {at, gone, max(left, 0)}
            for below, above in pairwise(levels):
                places = {place // FAN for place in places}
                for place in places:
                    above[place] = min(below[place * FAN : place * FAN + FAN])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


def narrow(pattern: str) -> re.Pattern | None:
    """The pattern as the standard library can match it in texts of characters up to U+00FF; None where it has more than \\p{L}, \\p{N}, \\s and \\S."""
    import regex

    out, inside, i = [], False, 0
    while i < len(pattern):
        kind = next((k for k in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(k, i)), None)
        if kind:
            members = "".join(f"\\x{code:02x}" for code in range(256) if regex.fullmatch(kind, chr(code)))
            out.append(members if inside else f"[{members}]")
            i += len(kind)
            continue
        if pattern[i] == "\\":
            return None
        inside = (inside or pattern[i] == "[") and pattern[i] != "]"
        out.append(pattern[i])
        i += 1
    return re.compile("".join(out))


class _Known(dict):
    """Ids by match; works out what it lacks and keeps what is short. older: what was known before, used again when asked for."""

    def __init__(self, ranks: dict[bytes, int], older: dict[str, tuple[int, ...]]):
        super().__init__()
        self.ranks, self.older, self.bytes = ranks, older, 0

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            ids = tuple(merge_bytes(piece.encode("utf-8"), self.ranks))
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
            self.bytes += sys.getsizeof(piece) + sys.getsizeof(ids) + ENTRY_BYTES
        return ids


class Encoder:
    """Encodes texts in one Python worker; remembers the ids of short matches, CACHE_BYTES at most and what one run of matches adds."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.pattern, self.narrow = regex.compile(pattern), narrow(pattern)
        self.ranks = load_ranks(path)
        self.known = _Known(self.ranks, {})

    def runs(self, text: str) -> Iterator[list[str]]:
        """The matches of a text, in order, in runs of bounded length."""
        pattern = self.narrow if self.narrow and _is_narrow(text) else self.pattern
        if len(text) <= MATCHES_AT_ONCE:
            yield pattern.findall(text)
            return
        matches = (m.group() for m in pattern.finditer(text))
        while run := list(islice(matches, MATCHES_AT_ONCE)):
            yield run

    def __call__(self, text: str) -> array:
        ids = array("i")
        for run in self.runs(text):
            if self.known.bytes > CACHE_BYTES // 2:  # the newer half becomes the older one, which goes
                self.known.older = {}
                self.known = _Known(self.ranks, self.known)
            ids.extend(chain.from_iterable(map(self.known.__getitem__, run)))
        return ids


def _is_narrow(text: str) -> bool:
    """Whether all characters are up to U+00FF."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[tuple[str, str], Encoder] = {}
_tokens: dict[str, list[bytes]] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's own encoder, read from the file once."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def tokens(path: str) -> list[bytes]:
    """Token bytes by id."""
    if path not in _tokens:
        ranks = load_ranks(path)
        found = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            found[rank] = token
        _tokens[path] = found
    return _tokens[path]


def encode(text: Column, path: str, pattern: str) -> Column:
    """array<int> of token ids; [] for an empty or null text. The file must be at path on every machine."""

    @F.arrow_udf("array<int>")
    def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        to_ids = encoder(path, pattern)
        for texts in batches:
            offsets, ids = array("i", [0]), array("i")
            for value in texts:
                ids += to_ids(value.as_py() or "")
                offsets.append(len(ids))
            bounds, values = (pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)]) for x in (offsets, ids))
            yield pa.ListArray.from_arrays(bounds, values)

    return encode_texts(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes that the ids stand for; empty for [] or null. An unknown id is an error."""

    @F.arrow_udf("binary")
    def decode_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = tokens(path)
        for rows in batches:
            ids, ends = rows.values.to_numpy(), rows.offsets.to_pylist()
            spans = zip(ends, ends[1:], rows.is_valid(), strict=False)
            yield pa.array([b"".join(map(known.__getitem__, ids[a:b].tolist())) if there.as_py() else b"" for a, b, there in spans], pa.binary())

    return decode_ids(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the ids of each whole text and the bytes that they decode to.

    Null and empty texts have no ids and decode to no bytes. Repeated rows are encoded each.
    A column of docs already named ids or decoded is replaced.
    """
    return docs.withColumn(ids, encode(F.col(text), path, pattern)).withColumn(decoded, decode(F.col(ids), path))


def digest(text: Column, path: str, pattern: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of a text, encoded and decoded in one pass: the ids stay in the task.

    The digests are of the decimal ids joined by commas, and of the bytes that the ids decode to. A null text counts as empty.
    """

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def encode_and_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        to_ids, known = encoder(path, pattern), tokens(path)
        decimal = list(map(str, range(len(known))))
        for texts in batches:
            counts, coded, decoded = [], [], []
            for value in texts:
                ids = to_ids(value.as_py() or "")
                counts.append(len(ids))
                coded.append(sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha256(b"".join(map(known.__getitem__, ids))).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_and_decode(text)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (as of digest) of every row; other columns play no part."""
    return docs.select("doc_id", digest(F.col("text"), path, pattern).alias("digest")).select("doc_id", "digest.*")
