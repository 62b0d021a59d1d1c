"""Bounded-space online packing of tokenised documents into fixed-length windows.

Every partition keeps a fixed number of open windows. A document's full windows go out as they are; its rest is
placed into the open window that it fits best. When none fits, the fullest window goes out: as it is when its gap is
at most ``max_gap`` tokens, else topped up with the head of the rest. What is open at the end of a partition is
merged in a tree: ``fan`` partitions at a time are packed again by the same rule, until one group is left. Its last
tokens are cut into windows whose lengths are powers of two, which need no padding.

A partition's state is ``open_windows`` windows and one document; a merge sees at most ``fan`` times that many. The
order of a partition's rows decides its windows, so a task that runs again gives the same ones.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they occur; an
empty table gives no window.
"""

from __future__ import annotations

import bisect
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import REMEMBERED as FORGET
from tessera.llm.common import durable, lean, text_of

#: Words whose ids a worker remembers (about 200 bytes each); beyond this it starts afresh.
REMEMBERED = 500_000
#: Bytes of the longest word that is remembered.
LONGEST = 64
#: Characters that are tokenised at a time.
SLICE = 500_000
#: Signs that no token shares with a letter or digit before them, ASCII or a Latin letter of two bytes: from there on the
#: text is encoded alone. Not the apostrophe, which letters may follow in a token, nor the bar of special tokens, nor the
#: separator.
_SIGN = re.compile(rb"[!-&(-/:-@\[-`{}](?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: How byte-level tokenizers write bytes as characters: printable Latin-1 stands for itself, others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)} | {32: " "}


class WordTokenizer:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``, remembering words.

    For a tokenizer that lower-cases, drops white space, and splits letters from other signs, so that what stands
    between white space, and the punctuation after a letter, can be encoded alone. Words that are not known are
    encoded in one call, with a separator between them whose id is known.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {b"": b""}
        (self.separator,) = self._encode("~")
        # Words of lower-case letters alone pass normalising and splitting unchanged: just the model is run on them.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _parted(self, words: list[bytes], ids: list[int]) -> None:
        ids = np.array(ids, dtype="<u4")
        ends = np.flatnonzero(ids == self.separator).tolist()
        raw = ids.tobytes()
        for w, begin, end in zip(words, [0, *[e + 1 for e in ends]], [*ends, len(ids)], strict=True):
            self.known[w] = raw[4 * begin : 4 * end]

    def _learn(self, words: set[bytes]) -> None:
        known, new = self.known, []
        for w in words:
            if b"~" in w:
                known[w] = np.array(self._encode(w.decode()), dtype="<u4").tobytes()
            else:
                new.append(w)
        ascii_letters, letters, others = [], [], []
        for w in new:
            (ascii_letters if w.isalpha() else letters if _LETTERS.fullmatch(w) else others).append(w)
        for words, text in ((ascii_letters, None), (letters, _BYTE_CHARS)):
            if words:
                joined = b" ~ ".join(words).decode("latin-1")
                self._parted(words, self.letters.encode_batch_fast([joined.translate(text) if text else joined], add_special_tokens=False)[0].ids)
        if others:
            self._parted(others, self._encode(b" ~ ".join(others).decode()))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [_SIGN.sub(rb" \g<0>", t.encode().lower().replace(b"\n", b" ")).split(b" ") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {b"": b""}
        if unknown := set().union(*split).difference(self.known):
            self._learn(unknown)
        known = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(known, words)), dtype="<u4") for words in split]
        for w in unknown:
            if len(w) > LONGEST:
                self.known.pop(w, None)
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}
FORGET["packing"] = _TOKENIZERS.clear


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


Piece = tuple  # (id, start, ids, doc_tokens)


class Packer:
    """Bounded-space best fit. ``put`` and ``close`` give back windows that are done: lists of pieces."""

    def __init__(self, length: int, open_windows: int, max_gap: int):
        self.length, self.most, self.max_gap = length, open_windows, max_gap
        self.rooms: list[tuple[int, int]] = []  # (room left, window), ascending
        self.windows: dict[int, list[Piece]] = {}
        self.made = 0

    def put(self, piece: Piece) -> Iterator[list[Piece]]:
        while (n := len(piece[2])) > 0:
            at = bisect.bisect_left(self.rooms, (n, -1))
            if at < len(self.rooms):
                room, w = self.rooms.pop(at)
                self.windows[w].append(piece)
                if room == n:
                    yield self.windows.pop(w)
                else:
                    bisect.insort(self.rooms, (room - n, w))
                return
            if len(self.rooms) < self.most:
                if n == self.length:
                    yield [piece]
                    return
                self.windows[self.made] = [piece]
                bisect.insort(self.rooms, (self.length - n, self.made))
                self.made += 1
                return
            room, w = self.rooms.pop(0)
            if room > self.max_gap:
                head, piece = cut(piece, room)
                self.windows[w].append(head)
            yield self.windows.pop(w)

    def close(self) -> list[list[Piece]]:
        left = [self.windows[w] for _, w in self.rooms]
        self.rooms, self.windows = [], {}
        return left


def cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    id_, start, ids, total = piece
    return (id_, start, ids[:n], total), (id_, start + n, ids[n:], total)


def chained(pieces: list[Piece], length: int) -> Iterator[list[Piece]]:
    """The pieces in order, cut into full windows, then into windows of powers of two."""
    left = sum(len(p[2]) for p in pieces)
    window, room = [], 0
    for piece in pieces:
        while len(piece[2]):
            if not room:
                if window:
                    yield window
                room = length if left >= length else 1 << (left.bit_length() - 1)
                window, left = [], left - room
            head, piece = cut(piece, room)
            window.append(head)
            room -= len(head[2])
    if window:
        yield window


class _Rows:
    """Collects pieces as columns of one Arrow batch."""

    def __init__(self, schema: pa.Schema, first: int):
        self.schema, self.next, self.rows, self.bytes = schema, first, [], 0

    def add(self, window: list[Piece], is_open: bool) -> None:
        offset = 0
        for id_, start, ids, total in window:
            self.rows.append((id_, start, len(ids), ids.tobytes(), total, self.next, offset, is_open))
            offset += len(ids)
        self.bytes += 4 * offset
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.bytes = self.rows, [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(self.schema), self.schema.types, strict=True)], schema=self.schema)


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, length: int = 4096,
    open_windows: int = 32, max_gap: int = 8, fan: int = 32,
) -> DataFrame:
    """One row per piece: ``id``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id`` and ``offset``. Each id of a document, with ``end_id`` after its text, lies in one piece."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    out = T.StructType(
        [T.StructField("id", kind)] + [T.StructField(c, T.LongType()) for c in ("start", "length")] + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")] + [T.StructField("is_open", T.BooleanType())]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def tokenised(batch: pa.RecordBatch) -> Iterator[tuple]:
        """Ids of each row, tokenised in slices of a bounded number of characters or one text."""
        tokens, ids, texts, size = tokenizer(tokenizer_path), batch.column(0).to_pylist(), [], 0
        for i, text in enumerate(batch.column(1)):
            texts.append(text.as_py())
            size += len(texts[-1])
            if size > SLICE or i + 1 == len(ids):
                yield from zip(ids[i + 1 - len(texts) : i + 1], tokens.ids(texts), strict=True)
                texts, size = [], 0

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, done = Packer(length, open_windows, max_gap), _Rows(arrow, TaskContext.get().partitionId() << 24)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for id_, ids in tokenised(batch):
                ids = np.concatenate([ids, end])
                whole = len(ids) - len(ids) % length
                for at in range(0, whole, length):
                    done.add([(id_, at, ids[at : at + length], len(ids))], False)
                for window in packer.put((id_, whole, ids[whole:].copy(), len(ids))):
                    done.add(window, False)
                if done.bytes > 4_000_000:
                    yield done.batch()
        for window in packer.close():
            done.add(window, True)
        yield done.batch()
        pa.default_memory_pool().release_unused()

    def merger(level: int, final: bool):
        def merge(table: pa.Table) -> pa.Table:
            rows = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            group = (rows.column("sequence_id")[0].as_py() >> 24 & (1 << 28) - 1) // fan
            packer, done = Packer(length, open_windows, max_gap), _Rows(arrow, level << 52 | group << 24)
            pieces = [(p["id"], p["start"], np.frombuffer(p["ids"], dtype="<u4"), p["doc_tokens"]) for p in rows.to_pylist()]
            for piece in sorted(pieces, key=lambda p: -len(p[2])):
                for window in packer.put(piece):
                    done.add(window, False)
            rest = packer.close()
            for window in chained([p for w in rest for p in w], length) if final else rest:
                done.add(window, not final)
            return pa.Table.from_batches([done.batch()])

        return merge

    packed = durable(rows.mapInArrow(first, out), "packed")
    closed, left = packed.filter("not is_open"), packed.filter("is_open")
    for level in range(1, 100):
        last = left.agg(F.max(F.shiftright("sequence_id", 24).bitwiseAND((1 << 28) - 1))).first()[0]
        if last is None:
            break
        final = last < fan

        group = F.floor(F.shiftright("sequence_id", 24).bitwiseAND((1 << 28) - 1) / fan)
        merged = durable(left.groupBy(group.alias("group")).applyInArrow(merger(level, final), out), "merged")
        closed, left = closed.unionByName(merged.filter("not is_open")), merged.filter("is_open")
        if final:
            break
    return closed.drop("is_open")
