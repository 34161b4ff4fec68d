"""Packing by concatenate and cut.

All documents, each closed by an end id, count as one long row of tokens that is cut into windows of
a fixed length.  Pass one tokenises and writes each document's ids beside its place inside its
partition; the token totals of the partitions, one row each, are summed up to offsets.  Pass two
reads the table back, adds the offset and cuts: a document that crosses windows leaves one piece in
each.  Nothing is shuffled but one row per partition.  Only the last window can be short.

Null and empty texts are the end id alone.  The order of documents is that of the partitions read;
repeated rows are packed as often as they are there.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentivane.llm.texts import by_batches, narrow
from sentivane.session import stage

LENGTH = 2048
# Distinct words, and distinct parts of words, a worker remembers before it starts anew.
CACHE_WORDS, CACHE_PARTS = 1_200_000, 800_000
# Parts that are put to the tokenizer as one string.
JOINED = 2_000
_PART = regex.compile(r"\n|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# An apostrophe may begin a contraction, <| a special token; beyond Latin letters characters may be
# composed, and some control signs count as white space here and not there.
_WHOLE = re.compile(r"'|<\||[^\x00-\x1b\x20-\u024f]")


class Numbered:
    """Keys with a number each and the ids of every number, laid out in one array."""

    def __init__(self, kind):
        self.number: dict = {}
        self.ids, self.size = np.zeros(0, kind), np.zeros(0, np.int64)

    def add(self, keys: list, ids: np.ndarray, size: np.ndarray) -> None:
        self.number.update(zip(keys, range(len(self.number), len(self.number) + len(keys))))
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        self.size = np.concatenate([self.size, size])
        self.start = np.cumsum(self.size) - self.size

    def numbers(self, keys: list) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        return np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all numbers one behind the other, and how many each has."""
        if not len(numbers):
            return self.ids[:0], numbers
        size = self.size[numbers]
        shift = self.start[numbers] - (np.cumsum(size) - size)
        return self.ids[np.arange(int(size.sum())) + np.repeat(shift, size)], size


class WordTokens:
    """Ids of a tokenizer that drops white space and never joins across it, word by word.

    Texts are split at ASCII white space; the ids of each word are asked of the tokenizer once and
    remembered.  Words of Latin signs are cut further where the tokenizer's own pattern cuts them,
    and their parts are put to the tokenizer many in one string: the last id of a part is known by
    the word end in its name.
    """

    def __init__(self, path: str, special_as_text: bool, words: int | None = None,
                 parts: int | None = None):
        from tokenizers import Tokenizer

        self.most_words, self.most_parts = words or CACHE_WORDS, parts or CACHE_PARTS
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.code = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.part = Numbered(self.code), Numbered(self.code)

    def _asked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return (np.fromiter(chain.from_iterable(got), np.int64),
                np.fromiter(map(len, got), np.int64, len(got)))

    def _parts(self, new: list[str]) -> None:
        ids, _ = self._asked([" ".join(new[i:i + JOINED]) for i in range(0, len(new), JOINED)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(new) and last[-1] == len(ids) - 1:
            self.part.add(new, ids, np.diff(last, prepend=-1))
        else:  # a tokenizer without word ends
            self.part.add(new, *self._asked(new))

    def learn(self, missing: list[bytes]) -> None:
        if len(self.part.number) > self.most_parts:
            self.part = Numbered(self.code)
        texts = [w.decode("utf-8", "replace") for w in missing]
        whole = [bool(_WHOLE.search(t)) for t in texts]
        if any(whole):
            self.known.add(list(compress(missing, whole)), *self._asked(list(compress(texts, whole))))
            cut = [not x for x in whole]
            missing, texts = list(compress(missing, cut)), list(compress(texts, cut))
        if not missing:
            return
        if "\n" not in self.part.number:
            self.part.add(["\n"], np.zeros(0, np.int64), np.zeros(1, np.int64))
        # one scan over all words; a line feed, which is in no word, closes each
        parts = _PART.findall("\n".join([*texts, ""]).lower())
        new = list(set(parts).difference(self.part.number))
        if new:
            self._parts(new)
        number = self.part.numbers(parts)
        ids, size = self.part.gather(number)
        closes = np.flatnonzero(number == self.part.number["\n"])
        self.known.add(missing, ids, np.diff(np.cumsum(size)[closes], prepend=0))

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts one behind the other, and how many each text has."""
        texts = column.cast(pa.binary()).fill_null(b"").view(pa.string())
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        number = self.known.numbers(distinct)
        if (number < 0).any():
            if len(self.known.number) + int((number < 0).sum()) > self.most_words:
                self._forget()
                number[:] = -1
            missing = list(compress(distinct, (number < 0).tolist()))
            self.learn(missing)
            number[number < 0] = self.known.numbers(missing)
        ids, size = self.known.gather(number[words.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(bounds)

    def packed(self, column: pa.Array) -> list[bytes]:
        """The ids of each text as bytes."""
        ids, size = self.flat(column)
        ends = np.cumsum(size).tolist()
        return [ids[i:j].tobytes() for i, j in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def word_tokens(path: str, special_as_text: bool, words: int | None = None,
                parts: int | None = None) -> WordTokens:
    return WordTokens(path, special_as_text, words, parts)


def placed(df: DataFrame, path: str, end: int, id_col: str, text_col: str) -> DataFrame:
    """(part, at, id, n, ids): ids of every document and the tokens before it in its partition."""

    def run(batches):
        t = word_tokens(path, False)
        part, at = TaskContext.get().partitionId(), 0
        tail = np.array([end], t.code).tobytes()
        for b in batches:
            ids = [x + tail for x in t.packed(b.column(1))]
            n = np.array([len(x) for x in ids], np.int64) // len(tail)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(before), b.column(0),
                 pa.array(n), pa.array(ids, pa.binary())], ["part", "at", "id", "n", "ids"])

    return by_batches(narrow(df, id_col, text_col), run,
                      "part int, at bigint, id bigint, n bigint, ids binary")


def pieces(df: DataFrame, path: str, end: int = 1, length: int = LENGTH, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every piece.

    `ids` holds little-endian unsigned 32-bit numbers.
    """
    written = stage(placed(df, path, end, id_col, text_col), "tokens")
    totals = written.groupBy("part").agg(F.sum("n").alias("n"))
    # one row per partition read
    offsets = totals.select("part", (
        F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    wide = 2 if written_as_short(path) else 4

    def cut(batches):
        for b in batches:
            first = b.column("base").to_numpy() + b.column("at").to_numpy()
            n = b.column("n").to_numpy()
            low, high = first // length, (first + n - 1) // length
            many = high - low + 1
            row = np.repeat(np.arange(len(n)), many)
            seq = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = np.maximum(seq * length - first[row], 0)
            stop = np.minimum((seq + 1) * length - first[row], n[row])
            docs = [np.frombuffer(x, f"<u{wide}") for x in b.column("ids").to_pylist()]
            ids = [docs[r][i:j].astype("<u4").tobytes()
                   for r, i, j in zip(row.tolist(), start.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(row)), pa.array(start), pa.array(stop - start),
                 pa.array(n[row]), pa.array(seq), pa.array(first[row] + start - seq * length),
                 pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return by_batches(
        written.join(F.broadcast(offsets), "part").select("base", "at", "id", "n", "ids"), cut,
        "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, ids binary")


@lru_cache(maxsize=2)
def written_as_short(path: str) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size() <= 1 << 16


def padded_length(used: int, length: int = LENGTH) -> int:
    """A short sequence is padded to `length`, unless its length is a power of two."""
    return used if used & (used - 1) == 0 else length


def sequences(cut: DataFrame, pad: int = 0, length: int = LENGTH) -> DataFrame:
    """(sequence_id, ids array<bigint>): pieces put together and padded; groups hold one window."""
    joined = cut.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    padded = F.udf(lambda parts: _numbers(parts, pad, length), "array<bigint>")
    return joined.select("sequence_id", padded("p.ids").alias("ids"))


def _numbers(parts, pad: int, length: int) -> list[int]:
    ids = np.frombuffer(b"".join(map(bytes, parts)), "<u4").tolist()
    return ids + [pad] * (padded_length(len(ids), length) - len(ids))


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset")
