"""Language-model scores by context-tree weighting over the bytes of whole texts.

A text is its words in lower case (A-Z) with a blank between them, and a line feed as its end; what
comes before a text counts as line feeds.  Each byte is eight binary decisions (high bit first).  Each
decision has a tree of contexts: the `DEPTH` bytes before the byte, whatever words they belong to.  A
node of the tree has the Krichevsky-Trofimov estimate of what followed its context in the training
texts, and the weighted probability: at full depth its own estimate, above it half its own estimate and
half the product of its children's.  The probability of a bit is the ratio of the weighted probabilities
of the root with and without it, which mixes the estimates of all depths; below the last context that
training has seen every node says 1/2.  The score of a text is the sum of the log10 probabilities of its
bits, and so depends on the order of its words.

How it runs.  Texts are written once in blocks of bounded size.  A block counts its different contexts
with the byte that follows, packed by lots of contexts that end in the same `TOP` bytes (`index_contexts`).
A lot builds its trees down from depth `TOP`, the few levels above are joined per decision, and every
block gets back one number for each of its different contexts (`tree_scores`).  It then meets its texts
again and sums (`_block_scores`): no row per byte or word is shuffled.  The counts of words for the base score
take the same way.  A lot is sized by the corpus; the largest holds the commonest `TOP` bytes.

Null and empty texts are the end alone.  A row without an id counts as training; repeated rows are all
counted and all scored.  Without training texts every decision has probability 1/2 and every count is 0.
An empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentivane.llm.texts import LOWER, by_batches, narrow, raw
from sentivane.session import new_path, stage

DEPTH = 6
TOP = 3  # lots hold whole subtrees of this depth
BLOCK_BYTES = 16 << 20
PIECE_BYTES = 2 << 20  # what a block sorts at once
LOT_BYTES = 256 << 10  # text per lot
MAX_LOTS = 1 << 16
PAD = b"\n" * DEPTH
HALF = np.log(0.5)
REST = 8 * (DEPTH + 1 - TOP)  # bits of a key below its TOP bytes


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, id, text): rows in their order, a new block once one is full."""

    def run(batches):
        n, size = 0, 0
        for b in batches:
            block = []
            for length in pc.binary_length(b.column(1)).to_pylist():
                if size and size + (length or 0) > BLOCK_BYTES:
                    n, size = n + 1, 0
                size += length or 0
                block.append(TaskContext.get().partitionId() << 32 | n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int64()), *b.columns], ["block", "id", "text"])

    return by_batches(docs, run, "block bigint, id bigint, text string")


def _words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _by_block(batches):
    """(block, ids, texts) of runs of rows of one block."""
    block, ids, texts = None, [], []
    for b in batches:
        for at, i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2))):
            if ids and at != block:
                yield block, ids, texts
                ids, texts = [], []
            block = at
            ids.append(i)
            texts.append(text)
    if ids:
        yield block, ids, texts


@functools.cache
def _zstd():
    """One of each per worker: making them costs more than a small row."""
    return zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()


def _packed(x: np.ndarray) -> bytes:
    """First the lowest bytes of all numbers, then all second ones, ..., compressed."""
    planes = x.view(np.uint8).reshape(-1, x.itemsize).T
    return _zstd()[0].compress(planes.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(_zstd()[1].decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _packed_keys(key: np.ndarray) -> bytes:
    """Ordered keys, as their differences."""
    return _packed(np.diff(key, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8"), dtype=np.uint64)


def _words_by_lot(words, lots: int) -> dict[int, list[bytes]]:
    """The different words of a block, in order, by lot."""
    out = defaultdict(list)
    for w in words:
        out[zlib.crc32(w) % lots].append(w)
    for some in out.values():
        some.sort()
    return out


def index_words(blocks: DataFrame, lots: int) -> DataFrame:
    """(lot, block, words, counts): a block's words and how often its training texts have them, packed.

    The end is the empty word.
    """

    def run(batches):
        for block, ids, texts in _by_block(batches):
            n = Counter()
            for i, text in zip(ids, texts):
                words = _words(text)
                words.append(b"")
                n.update(dict.fromkeys(words, 0) if held_out(i) else words)
            of_lot = _words_by_lot(n, lots)
            names, counts = [], []
            for words in of_lot.values():
                names.append(_zstd()[0].compress(b"\n".join(words)))
                counts.append(_packed(np.array([n[w] for w in words], "<i8")))
            yield pa.RecordBatch.from_arrays([
                pa.array(list(of_lot), pa.int64()), pa.array([block] * len(names), pa.int64()),
                pa.array(names, pa.binary()), pa.array(counts, pa.binary()),
            ], ["lot", "block", "words", "counts"])

    return by_batches(blocks, run, "lot bigint, block bigint, words binary, counts binary")


def _unpacked_words(data: bytes) -> list[bytes]:
    return _zstd()[1].decompress(data).split(b"\n")


def _rows_of_blocks(rows: pa.Table) -> dict[int, list[int]]:
    """Which rows each block has: one, unless the scan has cut the block."""
    out = defaultdict(list)
    for k, block in enumerate(rows["block"].to_pylist()):
        out[block].append(k)
    return out


def _lot_words(rows: pa.Table, lot: int) -> pa.Table:
    """Per block: the corpus counts of its words of this lot, in the order of the words.

    The first row has the lot's tokens and known words beside.
    """
    words = [_unpacked_words(x) for x in rows["words"].to_pylist()]
    c = Counter()
    for some, counts in zip(words, rows["counts"].to_pylist()):
        for w, n in zip(some, _unpacked(counts, "<i8").tolist()):
            c[w] += n
    blocks = _rows_of_blocks(rows)
    data = [_packed(np.array([c[w] for w in sorted(set().union(*(words[k] for k in of)))], "<i8"))
            for of in blocks.values()]
    more = [0] * (len(blocks) - 1)
    return pa.table({
        "block": pa.array(list(blocks), pa.int64()), "lot": pa.array([lot] * len(blocks), pa.int64()),
        "data": pa.array(data, pa.binary()), "tokens": pa.array([sum(c.values()), *more], pa.int64()),
        "known": pa.array([sum(x > 0 for x in c.values()), *more], pa.int64())})


def stream(text: bytes) -> bytes:
    return b" ".join(_words(text)) + b"\n"


def grams(streams: list[bytes]) -> np.ndarray:
    """For every byte of every stream: its context and the byte, the nearest byte of the context highest."""
    joined = b"".join([x for s in streams for x in (PAD, s)])
    data = np.frombuffer(joined + bytes(8), np.uint8)
    # eight bytes from every place, the first of them lowest
    eight = np.ndarray(len(joined) - DEPTH, "<u8", data, 0, (1,))
    key = eight & np.uint64((1 << 8 * DEPTH) - 1)
    key <<= np.uint64(8)
    key |= data[DEPTH:len(joined)]
    size = np.full(2 * len(streams), DEPTH)
    size[::2] = [len(s) for s in streams]
    return key[np.repeat(np.arange(len(size)) % 2 == 0, size)[:len(key)]]


def _pieces(streams: list[bytes]):
    """Slices of the list with a bounded number of bytes, one stream at least."""
    first, size = 0, 0
    for k, s in enumerate(streams):
        if size and size + len(s) > PIECE_BYTES:
            yield slice(first, k)
            first, size = k, 0
        size += len(s)
    if streams:
        yield slice(first, len(streams))


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]):
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = _starts(key)
    return key[first], np.add.reduceat(n[order], first)


def lot_of(top: np.ndarray, lots: int) -> np.ndarray:
    """The lot of contexts that end in the bytes `top`."""
    mixed = top.astype(np.uint64) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)
    return (mixed * np.uint64(lots) >> np.uint64(32)).astype(np.int64)


def _block_contexts(ids, streams: list[bytes], lots: int):
    """(lot, key, count in training texts) of a block's different keys, ordered by lot and key."""
    keys, counts = [], []
    for out in (False, True):
        fold = [s for i, s in zip(ids, streams) if held_out(i) == out]
        for piece in _pieces(fold):
            key = grams(fold[piece])
            key.sort()
            first = _starts(key)
            keys.append(key[first])
            counts.append(np.diff(np.append(first, len(key))) * (not out))
    key, n = _merged(keys, counts)
    lot, order = _by_lot(key, lots)
    return lot[order], key[order], n[order]


def _by_lot(key: np.ndarray, lots: int):
    """The lots of ordered keys, and the order by lot and key."""
    lot = lot_of(key >> np.uint64(REST), lots)
    return lot, np.argsort(lot.astype(np.uint16), kind="stable")


def index_contexts(blocks: DataFrame, lots: int) -> DataFrame:
    """(lot, block, keys, counts): a block's different contexts with the byte that follows, packed."""

    def run(batches):
        for block, ids, texts in _by_block(batches):
            lot, key, n = _block_contexts(ids, [stream(t) for t in texts], lots)
            first = _starts(lot)
            key, n = np.split(key, first[1:]), np.split(n, first[1:])
            yield pa.RecordBatch.from_arrays([
                pa.array(lot[first]), pa.array(np.full(len(first), block, np.int64)),
                pa.array(map(_packed_keys, key), pa.binary()), pa.array(map(_packed, n), pa.binary()),
            ], ["lot", "block", "keys", "counts"])

    return by_batches(blocks, run, "lot bigint, block bigint, keys binary, counts binary")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2: Stirling's series eight steps up, and back."""
    up = x + 8
    back = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    inv = 1 / up
    tail = inv * (1 / 12 - inv ** 2 * (1 / 360 - inv ** 2 * (1 / 1260 - inv ** 2 / 1680)))
    return (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + tail - back


# the values for small counts, looked up
SMALL = 1 << 14
LOG_GAMMA_HALF = log_gamma(np.arange(SMALL) + 0.5)
LOG_GAMMA_ONE = log_gamma(np.arange(SMALL) + 1.0)


def _log_gamma_of(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(n, SMALL - 1)]
    large = np.flatnonzero(n >= SMALL)
    out[large] = log_gamma(n[large] + shift)
    return out


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the estimate of any order of `a` zeros and `b` ones."""
    return (_log_gamma_of(a, LOG_GAMMA_HALF, 0.5) + _log_gamma_of(b, LOG_GAMMA_HALF, 0.5)
            - _log_gamma_of(a + b, LOG_GAMMA_ONE, 1.0) - np.log(np.pi))


def _up(at, a, b, low):
    """One level up: (place, zeros, ones, weighted, own estimate, parent of each node below)."""
    first = _starts(at)
    a, b, low = (np.add.reduceat(x, first) for x in (a, b, low))
    own = kt(a, b)
    parent = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
    return at[first], a, b, np.logaddexp(HALF + own, HALF + low), own, parent


def _down(a, b, own, weighted, sofar, rest):
    """One level down: what is mixed so far of the probability of a one, and the weight that is left."""
    share = np.exp(HALF + own - weighted)
    return sofar + rest * share * (b + 0.5) / (a + b + 1.0), rest * (1 - share)


def _levels(key: np.ndarray, n: np.ndarray, k: int):
    """For the k-th bit: the levels from full depth up to TOP, and the leaf and bit of every key.

    `key` is in order, so leaves are runs of it; sorted by the bits before, then by context, every
    level above is runs of the one below.
    """
    prefix = key >> np.uint64(8 - k)
    first = _starts(prefix)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    bit = (key >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
    ones = np.add.reduceat(n * bit, first)
    zeros = np.add.reduceat(n, first) - ones
    node = (1 << k | (prefix[first] & np.uint64((1 << k) - 1)).astype(np.int64)).astype(np.uint8)
    order = np.argsort(node, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = node[order].astype(np.uint64) << np.uint64(8 * DEPTH) | key[first][order] >> np.uint64(8)
    a, b = zeros[order], ones[order]
    own = kt(a, b)
    levels = [(at, a, b, own, own, None)]
    for _ in range(DEPTH - TOP):
        at, a, b, low = levels[-1][:4]
        levels.append(_up(at >> np.uint64(8), a, b, low))
    return levels, place[run], bit


def _contexts(rows: pa.Table):
    """All keys of a lot once, their counts, and the keys of each row."""
    keys = [_unpacked_keys(x) for x in rows["keys"].to_pylist()]
    counts = [_unpacked(x, "<i8") for x in rows["counts"].to_pylist()]
    key, n = _merged(keys, counts)
    return key, n, keys


def _lot_roots(rows: pa.Table) -> pa.Table:
    key, n, _ = _contexts(rows)
    out = []
    for k in range(8):
        at, a, b, weighted = _levels(key, n, k)[0][-1][:4]
        out.append((at >> np.uint64(8 * TOP), at & np.uint64((1 << 8 * TOP) - 1), a, b, weighted))
    node, ctx, a, b, weighted = (np.concatenate(x) for x in zip(*out))
    return pa.table({"node": node.astype(np.int64), "ctx": ctx.astype(np.int64), "a": a, "b": b,
                     "weighted": weighted})


def _above(table: pa.Table, lots: int) -> pa.Table:
    """For one decision: the depths above TOP, and what they hand down to each context of TOP bytes."""
    order = np.argsort(table["ctx"].to_numpy(), kind="stable")
    ctx, a, b, weighted = (table[c].to_numpy()[order] for c in ("ctx", "a", "b", "weighted"))
    levels = [(ctx, a, b, weighted)]
    for _ in range(TOP):
        at, a, b, low = levels[-1][:4]
        levels.append(_up(at >> 8, a, b, low))
    sofar, rest = np.zeros(1), np.ones(1)
    for _, a, b, weighted, own, parent in levels[:0:-1]:
        sofar, rest = _down(a, b, own, weighted, sofar, rest)
        sofar, rest = sofar[parent], rest[parent]
    return pa.table({"lot": lot_of(ctx, lots), "node": table["node"].to_numpy()[order], "ctx": ctx,
                     "sofar": sofar, "rest": rest})


def _lot_scores(rows: pa.Table, above: pa.Table, lot: int) -> pa.Table:
    """Per block: the log10 probabilities of its keys of this lot, in the order of the keys.

    They travel in single precision, which leaves a sum right to seven digits.
    """
    key, n, keys = _contexts(rows)
    known = (above["node"].to_numpy() << 8 * TOP | above["ctx"].to_numpy()).astype(np.uint64)
    order = np.argsort(known)
    known = known[order]
    log = np.zeros(len(key))
    for k in range(8):
        levels, leaf, bit = _levels(key, n, k)
        at = order[np.searchsorted(known, levels[-1][0])]
        sofar, rest = above["sofar"].to_numpy()[at], above["rest"].to_numpy()[at]
        for _, a, b, weighted, own, parent in levels[:0:-1]:
            sofar, rest = _down(a, b, own, weighted, sofar, rest)
            sofar, rest = sofar[parent], rest[parent]
        _, a, b, *_ = levels[0]
        # at full depth a node is its own estimate
        one = (sofar + rest * (b + 0.5) / (a + b + 1.0))[leaf]
        log += np.log10(np.where(bit == 1, one, 1 - one))
    blocks = _rows_of_blocks(rows)
    data = []
    for of in blocks.values():
        own = keys[of[0]] if len(of) == 1 else np.unique(np.concatenate([keys[k] for k in of]))
        data.append(_packed(log[np.searchsorted(key, own)].astype("<f4")))
    return pa.table({
        "block": pa.array(list(blocks), pa.int64()), "lot": pa.array([lot] * len(blocks), pa.int64()),
        "data": pa.array(data, pa.binary())})


def tree_scores(index: DataFrame, lots: int, partitions: int) -> DataFrame:
    """(block, lot, data): packed log10 probabilities of the byte after each context of a block."""
    rows = index.repartition(partitions, "lot")
    roots = rows.groupBy("lot").applyInArrow(
        lambda t: _lot_roots(t), "node bigint, ctx bigint, a bigint, b bigint, weighted double")
    above = roots.groupBy("node").applyInArrow(
        lambda t: _above(t, lots), "lot bigint, node bigint, ctx bigint, sofar double, rest double")
    return rows.groupBy("lot").cogroup(
        above.repartition(partitions, "lot").groupBy("lot")).applyInArrow(
        lambda key, a, b: _lot_scores(a, b, key[0].as_py()), "block bigint, lot bigint, data binary")


def _block_scores(rows: pa.Table, found: pa.Table, lots: int, smoothed: int) -> pa.Table:
    """Sums over the tokens and bytes of every text of a block.

    What was found comes without words and keys: the block knows them from its texts.
    """
    ids, texts = rows["id"].to_pylist(), raw(rows["text"].combine_chunks())
    counts, logs = {}, {}
    for is_words, lot, data in zip(*(found[x].to_pylist() for x in ("words", "lot", "data"))):
        (counts if is_words else logs)[lot] = data
    words = [_words(t) for t in texts]
    c = {}
    for lot, some in _words_by_lot({b""}.union(*words), lots).items():
        c.update(zip(some, _unpacked(counts[lot], "<i8").tolist(), strict=True))
    tokens = np.array([len(w) + 1 for w in words])
    starts = np.cumsum(tokens) - tokens
    n = np.fromiter((c[w] for some in words for w in (*some, b"")), np.int64, int(tokens.sum()))
    known, base = np.add.reduceat(n > 0, starts, dtype=np.int64), np.add.reduceat(
        np.log10((n + 1) / smoothed), starts)
    streams = [b" ".join(some) + b"\n" for some in words]
    lengths = np.array([len(s) for s in streams])
    # every piece: its different keys, where each byte's key is among them
    pieces = []
    for piece in _pieces(streams):
        key = grams(streams[piece])
        order = np.argsort(key)
        key = key[order]
        first = _starts(key)
        run = np.empty(len(key), np.int32)
        run[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(key))))
        pieces.append((piece, key[first], run))
    key = np.concatenate([own for _, own, _ in pieces])
    key.sort(kind="stable")
    key = key[_starts(key)]
    lot, order = _by_lot(key, lots)
    found_logs = np.concatenate([_unpacked(logs[x], "<f4") for x in np.unique(lot).tolist()])
    if len(found_logs) != len(key):
        raise ValueError("the contexts of a block have changed since they were counted")
    log = np.empty(len(key))
    log[order] = found_logs
    score = []
    for piece, own, run in pieces:
        at = np.cumsum(lengths[piece]) - lengths[piece]
        score.append(np.add.reduceat(log[np.searchsorted(key, own)][run], at))
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(i) for i in ids]),
        "n_tokens": tokens, "n_known": known,
        "base_score": base, "score": np.concatenate(score),
        "n_bytes": lengths})


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), and
    the code length in bits per byte."""
    spark = docs.sparkSession
    path = new_path(spark, "blocks")
    split = in_blocks(narrow(docs, id_col, text_col))
    split.write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(split.schema).parquet(path)
    size = blocks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = min(MAX_LOTS, 16 + size // LOT_BYTES)
    # tasks by the work, which is far larger than the packed rows look
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (2 * BLOCK_BYTES))
    by_word = stage(index_words(blocks, lots).repartition(partitions, "lot").groupBy("lot").applyInArrow(
        lambda key, t: _lot_words(t, key[0].as_py()),
        "block bigint, lot bigint, data binary, tokens bigint, known bigint"), "words")
    # one row: all training tokens, different ones
    n, v = by_word.agg(F.sum("tokens"), F.sum("known")).first()
    n, v = n or 0, v or 0
    logs = tree_scores(index_contexts(blocks, lots), lots, partitions)
    found = logs.select("block", F.lit(False).alias("words"), "lot", "data").union(
        by_word.select("block", F.lit(True), "lot", "data"))
    return blocks.repartition(partitions, "block").groupBy("block").cogroup(
        found.repartition(partitions, "block").groupBy("block")).applyInArrow(
        lambda a, b: _block_scores(a, b, lots, n + v + 1),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, "
        "score double, n_bytes bigint").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"),
        "base_score", "score", (-F.col("score") * F.log2(F.lit(10.0)) / F.col("n_bytes"))
        .alias("bits_per_byte"))
