"""Removal of repeated byte strings by distributed prefix doubling over all positions.

A byte goes if a string of LENGTH bytes that covers it also starts in a document
with a smaller id.  Every position that has LENGTH bytes before its document's end
takes part.  Its rank at 8 bytes is those bytes as a number; its rank at twice the
length is the pair of the ranks at the position and at the offset, named anew:

1.  Offset 8, rank pairs name 16 bytes.
2.  Offset 16, rank pairs name 32 bytes, of the positions that are left.
3.  Offset 18, rank pairs name 50 bytes, the threshold, where doubling ends.

In each round the pairs of all positions left are dealt by ranges of their names,
sorted and compared; positions whose name stands nowhere else leave.  The last round
finds the smallest document of each name, and windows of larger documents go; it is
run for PARTS ranges of names one after another, as its names are the longest and
what lies on disk at once would be the most.

Names are hashes of the pairs, since only equality counts here, not order.  In the
first rounds they have SPARE bits more than number all positions: a name that is
taken for repeated by chance only stays for another round.  The last names have
2 log2(positions) + MARGIN bits (64 at least), so that at every size two different
strings of one name are unlikely (below 2 ** -MARGIN for the whole table).

Documents are first sorted by id and written in blocks of about BLOCK bytes with a
number, so that the smallest document of a name is in the first block that has it
(blocks meet in one id at most, which two bits a name tell apart).  A block sends each different name once per round (map-side combine), sorted, as differences
(quotients in unary, remainders in fixed width; about two bytes a name); a bucket
answers with one bit a name.  A passage that a third of all documents share so is one
name in each block.  Answers meet their block by its number, whatever order tasks run
in.  A document is whole within one block.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; a
null id orders before every other id; rows that share an id are not smaller than
one another; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, utf8_column

LENGTH = 50
#: Bytes that a name stands for after each round; each is a doubling, the last one cut at the threshold.
LENGTHS = (16, 32, LENGTH)
#: Bytes of text of a block; names of a bucket on average; positions that are named at once.
BLOCK, BUCKET, CHUNK = 8 << 20, 1 << 21, 1 << 17
SPARE, MARGIN = 5, 10
#: Ranges of names of the last round; a power of two.
PARTS = 2
#: Rounds: bytes named, and the range of names out of how many.
ROUNDS = [(16, 0, 1), (32, 0, 1), *((LENGTH, p, PARTS) for p in range(PARTS))]
#: Stands for a null id.
NONE = -(2**63)

DOC = np.dtype([("doc", "<i8"), ("known", "?"), ("size", "<i8")])
BLOCKS = "origin long, docs binary, text binary, raw long"
SENT = "bucket int, origin long, n int, names binary, more binary, flags binary, first long, last long, mask binary"
BACK = "origin long, bucket int, bits binary, mask binary"
DONE = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in the order of their ids, block by block."""
    origin, held, size = TaskContext.get().partitionId() << 32, [], 0

    def send() -> pa.RecordBatch:
        held.sort(key=lambda x: x[0])
        docs = np.array([(d, known, len(raw)) for d, known, raw in held], DOC)
        text = b"".join(raw for _, _, raw in held)
        packed = pa.Codec("zstd", 1).compress(text, asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([origin]), pa.array([docs.tobytes()]), pa.array([packed], pa.binary()), pa.array([len(text)])], names=["origin", "docs", "text", "raw"])

    for batch in batches:
        data, offsets = utf8_column(batch.column("text"))
        ids, known = batch.column("doc").to_pylist(), batch.column("known").to_pylist()
        for i, (d, k) in enumerate(zip(ids, known)):
            held.append((d, k, data[offsets[i] : offsets[i + 1]].tobytes()))
            size += len(held[-1][2])
            # short texts count for their entries too
            if size + 16 * len(held) >= BLOCK:
                yield send()
                origin, held, size = origin + 1, [], 0
    if held:
        yield send()


class Block:
    def __init__(self, docs: bytes, text: bytes, raw: int):
        self.docs = np.frombuffer(docs, DOC)
        self.text = np.frombuffer(pa.Codec("zstd").decompress(text, decompressed_size=raw, asbytes=True), np.uint8)
        self.offsets = np.r_[0, np.cumsum(self.docs["size"])].astype(np.int64)

    def windows(self) -> np.ndarray:
        """Whether LENGTH bytes of one document start at each position."""
        edges = np.zeros(len(self.text) + 1, np.int32)
        some = self.docs["size"] >= LENGTH
        np.add.at(edges, self.offsets[:-1][some], 1)
        np.add.at(edges, self.offsets[1:][some] - LENGTH + 1, -1)
        return np.cumsum(edges[:-1]) > 0


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A name of each pair of ranks; for either one fixed it is a bijection of the other."""
    x = left * _A
    x ^= x >> np.uint64(31)
    x += right
    x *= _B
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def ranks(text: np.ndarray, length: int, second: bool = False) -> np.ndarray:
    """The rank of every position of a stretch of text at so many bytes, a length of LENGTHS; positions too near to the end are left out."""
    n = len(text) - 7
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    rank = np.empty(max(n, 0), np.uint64)
    for k in range(min(8, len(rank))):
        m = len(rank[k::8])
        rank[k::8] = padded[k : k + 8 * m].view(">u8")
    have = 8
    for to in LENGTHS:
        offset = to - have
        left, right = rank[: max(len(rank) - offset, 0)], rank[offset:]
        rank, have = (pair(right, left) if second and to == length else pair(left, right)), to
        if to == length:
            break
    return rank


def named(block: Block, mask: np.ndarray, length: int, second: bool = False) -> np.ndarray:
    """The names of the positions in the mask, in order."""
    out, done = np.empty(int(mask.sum()), np.uint64), 0
    for s in range(0, len(mask), CHUNK):
        part = mask[s : s + CHUNK]
        at = np.flatnonzero(part)
        if len(at):
            out[done : done + len(at)] = ranks(block.text[s : s + CHUNK + length - 1], length, second)[at]
            done += len(at)
    return out


def pack(values: np.ndarray, width: int) -> bytes:
    """Sorted different numbers below 2 ** width: the steps of the upper bits in unary, the lower bits as they are."""
    if not len(values):
        return b""
    low = min(60, max(0, 4 * round((width - math.log2(len(values))) / 4)))
    high = (values >> np.uint64(low)).astype(np.int64) + np.arange(len(values))
    bits = np.zeros(int(high[-1]) + 1, np.uint8)
    bits[high] = 1
    rest = values & np.uint64((1 << low) - 1)
    whole, half = low // 8, low % 8
    raw = np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, : whole + 1])
    parts = [np.ascontiguousarray(raw[:, :whole]).tobytes()]
    if half:
        nibbles = raw[:, whole] & 15
        nibbles = np.r_[nibbles, np.zeros(len(nibbles) % 2, np.uint8)]
        parts.append((nibbles[::2] | nibbles[1::2] << 4).tobytes())
    return bytes([low]) + b"".join(parts) + np.packbits(bits).tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    low, at = raw[0], 1
    whole, half = low // 8, low % 8
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :whole] = np.frombuffer(raw, np.uint8, n * whole, at).reshape(n, whole)
    at += n * whole
    if half:
        nibbles = np.frombuffer(raw, np.uint8, (n + 1) // 2, at)
        at += len(nibbles)
        wide[:, whole] = np.column_stack([nibbles & 15, nibbles >> 4]).ravel()[:n]
    high = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=at)))[:n] - np.arange(n)
    return wide.view(np.uint64).ravel() | high.astype(np.uint64) << np.uint64(low)


class Plan:
    """Bits of names and buckets for so many positions."""

    def __init__(self, positions: int):
        size = math.log2(max(positions, 2))
        self.low = max(0, math.ceil(math.log2(max(positions / BUCKET, PARTS))))
        self.bits = min(64, max(math.ceil(size) + SPARE, self.low + 1))
        #: Bytes of a last name beyond its 64 bits.
        self.more = min(8, max(0, math.ceil((2 * size + MARGIN - 64) / 8)))

    def width(self, last: bool) -> int:
        return 64 if last else self.bits

    def cut(self, names: np.ndarray, last: bool) -> np.ndarray:
        return names if last else names >> np.uint64(64 - self.bits)

    def split(self, names: np.ndarray, last: bool) -> np.ndarray:
        """Where each bucket's range of sorted names starts, and the end."""
        if not self.low:
            return np.array([0, len(names)])
        edges = np.arange(1, 1 << self.low, dtype=np.uint64) << np.uint64(self.width(last) - self.low)
        return np.r_[0, np.searchsorted(names, edges), len(names)]


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different names in order, and whether each stands several times; names are sorted in place."""
    names.sort()
    start = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, np.int64)
    return names[start], np.diff(np.r_[start, len(names)]) > 1


class Winners:
    """Names of the last round in order, the smallest document of each in the block, and the name of each position."""

    def __init__(self, block: Block, mask: np.ndarray, more: int, part: int = 0, parts: int = 1):
        name, place = named(block, mask, LENGTH), np.flatnonzero(mask)
        extra = named(block, mask, LENGTH, second=True) >> np.uint64(64 - 8 * more) if more else None
        if parts > 1:
            mine = np.flatnonzero(name >> np.uint64(65 - parts.bit_length()) == part)
            name, place, extra = name[mine], place[mine], extra[mine] if more else None
        order = self._order(name, extra)
        n = name[order]
        new = np.r_[True, n[1:] != n[:-1]] if len(n) else np.zeros(0, bool)
        if more:
            e = extra[order]
            new[1:] |= e[1:] != e[:-1]
        start = np.flatnonzero(new)
        self.of = np.empty(len(n), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.names, self.extra = n[start], e[start] if more else None
        self.doc = np.searchsorted(block.offsets, place, "right") - 1
        # documents of a block are in order, so the first position is in the smallest
        self.first = self.doc[np.minimum.reduceat(order, start)] if len(start) else start

    @staticmethod
    def _order(name: np.ndarray, extra: np.ndarray | None) -> np.ndarray:
        """The order by name and by what there is beyond it."""
        if len(name) >> 24:
            return np.lexsort((name,) if extra is None else (extra, name))
        # the upper bits of a name and the position as one number; what these bits confuse is put right afterwards
        low = np.uint64((1 << 24) - 1)
        key = (name & ~low) | np.arange(len(name), dtype=np.uint64)
        key.sort()
        order = (key & low).astype(np.int64)
        key >>= np.uint64(24)
        n = name[order]
        same, differ = key[1:] == key[:-1], n[1:] != n[:-1]
        if extra is not None:
            e = extra[order]
            differ |= e[1:] != e[:-1]
        confused = same & differ
        if confused.any():
            group = np.cumsum(np.r_[True, ~same]) - 1
            some = np.flatnonzero(np.isin(group, group[1:][confused]))
            part = order[some]
            order[some] = part[np.lexsort((name[part],) if extra is None else (extra[part], name[part]))]
        return order


def _squeeze(mask: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(np.packbits(mask).tobytes(), asbytes=True)


def _spread(raw: bytes, n: int) -> np.ndarray:
    size = (n + 7) // 8
    return np.unpackbits(np.frombuffer(pa.Codec("zstd").decompress(raw, decompressed_size=size, asbytes=True), np.uint8), count=n).astype(bool)


def _left(block: Block, mask: np.ndarray, length: int, plan: Plan, bits: np.ndarray) -> np.ndarray:
    """The positions of a round whose names also stand elsewhere."""
    name = plan.cut(named(block, mask, length), False)
    different, several = distinct(name.copy())
    stay = different[bits | several]
    # a table of the lower bits; what it lets through by chance takes part once more
    table = np.zeros(1 << 25, bool)
    table[stay & np.uint64(len(table) - 1)] = True
    out = np.zeros(len(mask), bool)
    out[np.flatnonzero(mask)[table[name & np.uint64(len(table) - 1)]]] = True
    return out


def _send(origin: int, block: Block, mask: np.ndarray, k: int, plan: Plan) -> pd.DataFrame:
    """A row for each bucket of the names of a round, and the mask, which comes back with the answers."""
    length, part, parts = ROUNDS[k]
    last = length == LENGTH
    rows = [(int(origin % (1 << plan.low)), origin, 0, None, None, None, None, None, _squeeze(mask))]
    if last:
        w = Winners(block, mask, plan.more, part, parts)
        names, ids = w.names, block.docs["doc"]
        least = ids[w.first]
    else:
        names, _ = distinct(plan.cut(named(block, mask, length), False))
    edge = plan.split(names, last)
    for b, (s, e) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
        if s == e:
            continue
        more = flags = None
        part = names[s:e] - np.uint64(b << (plan.width(last) - plan.low))
        if last:
            # bytes beyond the names, which may repeat then; whether a name's smallest document is the block's first or last
            more = np.ascontiguousarray(w.extra[s:e].view(np.uint8).reshape(-1, 8)[:, : plan.more]).tobytes() if plan.more else b""
            flags = np.packbits(np.r_[least[s:e] == ids[0], least[s:e] == ids[-1]]).tobytes()
        ends = (int(ids[0]), int(ids[-1])) if last else (None, None)
        rows.append((b, origin, e - s, pack(part, plan.width(last) - plan.low), more, flags, *ends, None))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SENT.split(", ")]).astype({"first": "Int64", "last": "Int64"})


def _first(plan: Plan):
    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for origin, docs, text, raw in zip(frame["origin"], frame["docs"], frame["text"], frame["raw"]):
                block = Block(docs, text, raw)
                yield _send(origin, block, block.windows(), 0, plan)

    return first


def _answers(back: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mask of a round, and its bits, bucket after bucket."""
    mask = _spread(back["mask"].dropna().iloc[0], n)
    some = back[back["bits"].notna()].sort_values("bucket")
    # each bucket's bits say first how many they are
    bits = [np.unpackbits(np.frombuffer(x, np.uint8, offset=4), count=int.from_bytes(x[:4], "little")).astype(bool) for x in some["bits"]]
    return mask, np.concatenate(bits) if bits else np.zeros(0, bool)


def _next(k: int, plan: Plan):
    def step(mine: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        block = Block(*mine.iloc[0][["docs", "text", "raw"]])
        mask, bits = _answers(back, len(block.text))
        before = ROUNDS[k - 1][0]
        return _send(int(mine["origin"].iloc[0]), block, mask if before == ROUNDS[k][0] else _left(block, mask, before, plan, bits), k, plan)

    return step


def _bits(x: np.ndarray) -> bytes:
    return len(x).to_bytes(4, "little") + np.packbits(x).tobytes()


def _several(names: np.ndarray, width: int) -> np.ndarray:
    """Whether each name stands several times."""
    if width > 32 or len(names) >> 32:
        _, at, times = np.unique(names, return_inverse=True, return_counts=True)
        return times[at] > 1
    key = (names << np.uint64(32)) | np.arange(len(names), dtype=np.uint64)
    key.sort()
    name = key >> np.uint64(32)
    same = name[1:] == name[:-1]
    inside = np.r_[False, same] | np.r_[same, False]
    out = np.zeros(len(names), bool)
    out[(key[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    return out


def _compare(k: int, plan: Plan):
    last = ROUNDS[k][0] == LENGTH
    width = plan.width(last) - plan.low

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        """A bit for each name that a block sent: it stands in another block too; in the last round, in a smaller document of another block."""
        masks = frame[frame["mask"].notna()]
        some = frame[frame["mask"].isna()]
        names = [unpack(x, n) for x, n in zip(some["names"], some["n"])]
        ends = np.cumsum([len(x) for x in names])[:-1]
        if not names:
            bits = []
        elif not last:
            bits = np.split(_several(np.concatenate(names), width), ends)
        else:
            ids, extra = [], []
            for n, more, flags, first, final in zip(some["n"], some["more"], some["flags"], some["first"], some["last"]):
                at_first, at_last = np.unpackbits(np.frombuffer(flags, np.uint8), count=2 * n).astype(bool).reshape(2, n)
                # no other block has ids between
                ids.append(np.where(at_first, int(first), np.where(at_last, int(final), int(first) + 1)))
                wide = np.zeros((n, 8), np.uint8)
                wide[:, : plan.more] = np.frombuffer(more, np.uint8).reshape(n, plan.more)
                extra.append(wide.view(np.uint64).ravel())
            names, ids, extra = np.concatenate(names), np.concatenate(ids), np.concatenate(extra)
            order = np.argsort(names)
            x, e = names[order], extra[order]
            if ((x[1:] == x[:-1]) & (e[1:] != e[:-1])).any():
                order = np.lexsort((extra, names))
                x, e = names[order], extra[order]
            new = np.r_[True, (x[1:] != x[:-1]) | (e[1:] != e[:-1])]
            d = ids[order]
            least = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
            larger = np.zeros(len(names), bool)
            larger[order] = d > least
            bits = np.split(larger, ends)
        out = pd.DataFrame({"origin": some["origin"].to_numpy(), "bucket": some["bucket"].to_numpy(), "bits": [_bits(b) for b in bits], "mask": None})
        return pd.concat([out, pd.DataFrame({"origin": masks["origin"].to_numpy(), "bucket": masks["bucket"].to_numpy(), "bits": None, "mask": masks["mask"].to_numpy()})], ignore_index=True)

    return compare


def spans_of(windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the windows cover; windows sorted."""
    if not len(windows):
        return windows, windows
    new = np.r_[True, windows[1:] > windows[:-1] + length]
    start = np.flatnonzero(new)
    return windows[start], windows[np.r_[start[1:] - 1, len(windows) - 1]] + length


def _result(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    gone = int((ends - starts).sum())
    keep, at = hashlib.sha256(), 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        keep.update(data[at:s])
        at = e
    keep.update(data[at:])
    return len(data), gone, len(starts), keep.hexdigest()


def _settle(plan: Plan):
    def settle(mine: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        block = Block(*mine.iloc[0][["docs", "text", "raw"]])
        mask, bits = _answers(back, len(block.text))
        w = Winners(block, mask, plan.more)
        ids = block.docs["doc"]
        gone = np.flatnonzero(mask)[bits[w.of] | (ids[w.doc] > ids[w.first][w.of])]
        first = np.searchsorted(gone, block.offsets)
        rows = []
        for i, d in enumerate(block.docs):
            s, e = block.offsets[i], block.offsets[i + 1]
            starts, ends = spans_of(gone[first[i] : first[i + 1]] - s, LENGTH)
            rows.append((int(d["doc"]) if d["known"] else None, *_result(block.text[s:e].tobytes(), starts, ends)))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        return out.astype({"doc_id": "Int64"})

    return settle


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc"), F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc").sortWithinPartitions("doc")
    blocks = materialise(rows.mapInArrow(_blocks, BLOCKS), "blocks", "uncompressed")
    plan = Plan(blocks.agg(F.coalesce(F.sum("raw"), F.lit(0))).first()[0])
    # answers that are still to be read
    kept: list[DataFrame] = []
    for k, (_, part, _) in enumerate(ROUNDS):
        if k == 0:
            sent = blocks.mapInPandas(_first(plan), SENT)
        else:
            sent = blocks.groupBy("origin").cogroup(kept[-1].groupBy("origin")).applyInPandas(_next(k, plan), SENT)
        replies = materialise(sent.groupBy("bucket").applyInPandas(_compare(k, plan), BACK), "answers")
        if part == 0:
            for done in kept:
                discard(done)
            kept = []
        kept.append(replies)
    back = kept[0]
    for more in kept[1:]:
        back = back.union(more)
    return blocks.groupBy("origin").cogroup(back.groupBy("origin")).applyInPandas(_settle(plan), DONE)
