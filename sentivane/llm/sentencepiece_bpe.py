"""SentencePiece encoding and decoding of merge-type models with a prefix table.

For every prefix of a text its encoding ends in exactly one token.  An automaton yields the tokens
that end at each position; of those, the one that is compatible with the last token of the prefix
before it is the prefix's last token.  The ids are read off backwards from the full text.

Two neighbouring tokens are compatible when encoding their joined string gives these two again.  By
merge ranks: the tokens along the right edge of the first and the left edge of the second live from
the rank that makes them to the rank that uses them up; a merge across the border that falls into
the lives of both its sides would have come first.

Texts are cut where no token can span (between a character and a word mark, beside characters
outside the vocabulary, between characters that are neighbours in no token); the parts are encoded
on their own and remembered.  Null texts count as empty; an empty text has the end id only.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import string
from array import array
from functools import lru_cache
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sentivane.llm.texts import Memo, by_batches, narrow

MARK = "▁"
NEVER = 1 << 60

codecs.register_error("one_per_byte", lambda e: ("�", e.start + 1))


class Pieces:
    """The vocabulary of a merge-type model and the tables that encoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.end = model.eos_id()
        self.text = [model.id_to_piece(i) for i in ids]
        self.plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
                           or model.is_unused(i)) for i in ids]
        order = sorted((i for i in ids if self.plain[i] and len(self.text[i]) > 1),
                       key=lambda i: (-model.get_score(i), i))
        scores = [model.get_score(i) for i in order]
        self.id_of = {self.text[i]: i for i in ids if self.plain[i]}
        # rank of the merge that makes a piece; equal scores share a rank, single characters have -1
        self.rank, rank = {}, -1
        for k, i in enumerate(order):
            rank += not k or scores[k] != scores[k - 1]
            self.rank[self.text[i]] = rank
        self.byte = {int(self.text[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.code = "H" if len(self.text) <= 1 << 16 else "I"
        self.controls = {i for i in ids if model.is_control(i)}
        self.has_ascii = all(c in self.id_of for c in MARK + string.ascii_letters)
        self.spans = {p[k:k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.sides: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if self._reachable(piece):
                self.automaton.add_word(piece, i << 8 | len(piece))
        self.automaton.make_automaton()
        self.edges = Memo(lambda i: (self._edge(self.text[i], 1), self._edge(self.text[i], 0)))
        self.fits = Memo(self._fits, 2_000_000)
        self.known = Memo(self._chunk)
        self.part = Memo(self._part)
        shown = []
        for i in ids:
            if model.is_byte(i):
                shown.append(bytes([int(self.text[i][3:5], 16)]))
            elif model.is_control(i):
                shown.append(b"")
            elif model.is_unknown(i):
                shown.append(" ⁇ ".encode())
            else:
                shown.append(self.text[i].replace(MARK, " ").encode())
        self.shown = shown
        self.shown_table = blob(shown)
        self.digit_table = blob([b"%d " % i for i in ids])

    def _merge(self, piece: str) -> list[str]:
        """Merges by rank, leftmost first; notes the two sides of the last merge."""
        parts = list(piece)
        while len(parts) > 1:
            best = min(range(len(parts) - 1),
                       key=lambda k: (self.rank.get(parts[k] + parts[k + 1], NEVER), k))
            joined = parts[best] + parts[best + 1]
            if joined not in self.rank:
                break
            if joined == piece:
                self.sides[piece] = parts[best], parts[best + 1]
            parts[best:best + 2] = [joined]
        return parts

    def _reachable(self, piece: str) -> bool:
        return len(piece) == 1 or self._merge(piece) == [piece]

    def _edge(self, piece: str, side: int) -> list[tuple[str, int, int]]:
        """(piece, rank that makes it, rank that uses it up) along one edge of the merge tree."""
        out, used = [], NEVER
        while True:
            made = self.rank.get(piece, -1)
            out.append((piece, made, used))
            if len(piece) == 1:
                return out
            if piece not in self.sides:
                self._merge(piece)
            used, piece = made, self.sides[piece][side]

    def _fits(self, pair: int) -> bool:
        """No merge across the border happens while both its sides live."""
        a, b = divmod(pair, 1 << 20)
        for x, made_x, used_x in self.edges[a][0]:
            for y, made_y, used_y in self.edges[b][1]:
                r = self.rank.get(x + y)
                if r is None:
                    continue
                at = max(r, made_x, made_y)
                # a merge of the same piece further left goes first, one further right waits
                if at < used_x and at <= used_y:
                    return False
        return True

    def _part(self, s: str) -> bytes:
        """The prefix table of a string in which no forced cut lies; packed ids."""
        last, size = [-1] * (len(s) + 1), [0] * (len(s) + 1)
        fits = self.fits
        for stop, found in self.automaton.iter(s):
            stop += 1
            if last[stop] < 0:
                start = stop - (found & 255)
                if not start or fits[last[start] << 20 | found >> 8]:
                    last[stop], size[stop] = found >> 8, found & 255
        ids, at = [], len(s)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return self.pack(ids)

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        # a word in ASCII letters, with one other sign behind it or none
        m = _WORD.fullmatch(chunk)
        if m and self.has_ascii:
            if not m[2]:
                return self.part[MARK + chunk]
            if m[1][-1] + m[2] not in self.spans and m[2] in self.id_of:
                return self.part[MARK + m[1]] + self.pack([self.id_of[m[2]]])
        s, out, start = MARK + chunk, [], 0
        for k, c in enumerate(s):
            if c not in self.id_of:
                if k > start:
                    out.append(self.part[s[start:k]])
                out.append(self.pack(
                    [self.byte[b] for b in c.encode()] if self.byte else [self.unknown]))
                start = k + 1
            elif k > start and s[k - 1:k + 1] not in self.spans:
                out.append(self.part[s[start:k]])
                start = k
        if start < len(s):
            out.append(self.part[s[start:]])
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """Packed ids of a text, without the end id."""
        if not text:
            return b""
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            marked = MARK + text.replace(" ", MARK)
            chunks = [c[1:] for c in _CHUNK.findall(marked)]
        else:
            chunks = text.split(" ")
        return b"".join(map(self.known.__getitem__, chunks))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), self.code).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the first mark goes, byte tokens join, each bad byte becomes U+FFFD."""
        if ids and ids[-1] in self.controls:
            ids = ids[:-1]
        if not self.controls.isdisjoint(ids):
            return self._decode_runs(ids)
        return self.unmark(b"".join(map(self.shown.__getitem__, ids)), ids[0] if ids else self.end)

    def unmark(self, shown: bytes, first: int) -> str:
        """The joined bytes of ids as text, without the blank that the first id's mark stands for."""
        shown = shown[1:] if self.text[first].startswith(MARK) else shown
        return shown.decode("utf-8", "one_per_byte")

    def _decode_runs(self, ids: list[int]) -> str:
        """Control tokens show nothing, but bytes on their two sides don't join."""
        runs = [list(g) for control, g in groupby(ids, self.controls.__contains__) if not control]
        return "".join(
            self.decode(run) if not k or not self.text[run[0]].startswith(MARK)
            else " " + self.decode(run) for k, run in enumerate(runs))


def blob(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings laid out in one array, with the start and length of each."""
    size = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(size) - size, size


def gather(ids: np.ndarray, per_text: np.ndarray, data: np.ndarray, start: np.ndarray,
           size: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The byte strings of ids one behind the other, and where each text's part begins and ends."""
    lengths = size[ids]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(start[ids] - (ends - lengths), lengths)
    return data[at].tobytes(), np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(per_text)]])


_WORD = re.compile("([A-Za-z]+)([^A-Za-z]?)")
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
           end: bool = True) -> DataFrame:
    """(id, ids array<int>): the ids of every whole text."""

    def run(batches):
        p = pieces(model)
        tail = [p.end] if end else []
        for b in batches:
            ids = [p.encode(t or "") + tail for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return by_batches(narrow(df, id_col, text_col), run, "id bigint, ids array<int>")


def decode(df: DataFrame, model: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from ids."""

    def run(batches):
        p = pieces(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([p.decode(i or []) for i in b.column(1).to_pylist()])],
                ["id", "text"])

    return by_batches(df.select(df[id_col].alias("id"), df[ids_col].alias("ids")), run,
                      "id bigint, text string")


def digests(df: DataFrame, model: str, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Per row: number of ids with the end id, digest of the ids, digest of the decoded text.

    Encoding and decoding meet in one pass, so the ids (larger than the texts) never leave a task.
    """

    def run(batches):
        p = pieces(model)
        tail = p.pack([p.end])
        for b in batches:
            packed = [p.packed(t or "") + tail for t in b.column(1).to_pylist()]
            n = np.array([len(x) for x in packed], np.int64) // len(tail)
            ids = np.frombuffer(b"".join(packed), p.code)
            shown, at = gather(ids, n, *p.shown_table)
            decoded = [p.unmark(shown[i:j], int(k)) for i, j, k in
                       zip(at, at[1:], ids[np.cumsum(n) - n])]
            digits, at = gather(ids, n, *p.digit_table)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n),
                 # each number has a blank behind it
                 pa.array([hashlib.sha256(digits[i:j - 1]).hexdigest()
                           for i, j in zip(at, at[1:])], pa.string()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_batches(narrow(df, id_col, text_col), run,
                      "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
