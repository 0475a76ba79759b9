"""N-gram Jaccard join by parity sketches.

A document's set is its distinct 5-word shingles.  XOR-ing the hashes of a set's
members into the cells of a sketch gives parities: each member that only one of
two sets has changes one cell, so the number of cells that differ (and likewise
the Hamming distance of one-bit cells) is at most the symmetric difference.

Sets of a Jaccard similarity of at least 4/5 differ in at most a/4 members, where
a is the smaller size.  So if the sketch of the smaller set has more than a/4
cells in use, one of them is the same in both: documents are joined on (size band,
cell number, cell of 64 bits).  Bands grow by BAND; a set of the next band that is
near enough also emits the lower band's cells, so each pair meets in the band of
its smaller set.  Sets with too few cells in use (never seen; their chance falls
exponentially) turn their band's cells into single members, where the bound always
holds, so nothing is lost.  Cells travel in packed blocks by hash, not as rows.

A cell that many sets share (a frequent phrase) tells little, and need not be looked
at: cells are ordered by how many sets hold them, and as linked sets differ in a/4
cells at most, they share one of the a/4 + 1 rarest of each (a/5 + 1 of single
members).  So a set leaves the lists of more than LONG sets, the longest first, as
long as that many of its cells remain.  What stays in a long list is dealt in rows;
a task that gathers lists sends entries of long ones on as it meets them.

Equal sets are first reduced to one representative with map-side combine.  Sets
that share a cell form a list; its pairs are not emitted.  A star from the list's
first member comes first, pruned by the Hamming distance of the one-bit sketches
and verified on the full sets; then only pairs of a list that are still in
different components are looked at, in tiles, pruned and verified.  Then any two
linked documents are in one component, and no link between components is missed;
where only classes are asked for (components_only()) the work ends here.

Links are whole: as linked sets are in one component, every pair of different sets
of a component is compared, each pair in one tile, by products of 0/1 matrices of
the sets' members.  A document's n_links is the number of other documents whose sets
are linked or equal to its own; only these sums leave the tiles.  An id with several
texts counts once for each of their sets.

Defined results: null, empty and blank texts have empty sets and no links; null
ids take no part in links; rows that share an id are one document; rows that
repeat change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, mix64, row_key, shuffle_partitions, utf8_column
from .graph import components
from .words import LOWER, chunks, prefix_hash, slice_hash, words

N, BAND, LITTLE = 5, 1.5, 40
#: Cells of a bucket on average; cells gathered before blocks are sent on; members of a tile.
BUCKET, FLUSH, TILE = 1 << 20, 1 << 20, 512
#: Sets of a list at most, beyond which it is dealt in rows; entries that a task gathers before it looks for such lists.
LONG, GATHER = 512, 4 << 20
#: Sets and members of a tile of a component at most; columns of a matrix of members.
SIDE, HELD, COLUMNS = 1024, 1 << 20, 4096
#: One-bit cells per member at least.
BITS = 2
ONE = np.uint64(1)


def edges_of_bands() -> np.ndarray:
    """The largest size of each band."""
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out)


BANDS = edges_of_bands()


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, sizes, "left")


def cells_of(band: np.ndarray) -> np.ndarray:
    """Cells of a band's sketch; 0 where every member is a cell of its own."""
    top = BANDS[band]
    return np.where(top < LITTLE, 0, (top * 42) // 100 + 8)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of every text, sorted by text and hash."""
    starts, ends, of = words(data, offsets)
    if not len(of):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = slice_hash(prefix_hash(LOWER[data]), starts, ends)
    per = np.bincount(of, minlength=len(offsets) - 1)
    first = np.r_[0, np.cumsum(per)[:-1]]
    at = np.arange(len(of))
    rank = at - first[of]
    room = per[of] - rank
    # the words of a shingle, and how many they are, as one polynomial
    total = np.zeros(len(h), np.uint64)
    for k in range(n):
        word = np.zeros(len(h), np.uint64)
        word[: max(len(h) - k, 0)] = h[k:]
        total = np.where(k < room, total * np.uint64(0xD6E8FEB86659FD93) + word, total)
    total = mix64(total + np.minimum(room, n).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    starts_here = (room >= n) | (rank == 0)
    of, total = of[starts_here], total[starts_here]
    order = np.lexsort((total, of))
    of, total = of[order], total[order]
    new = np.r_[True, (of[1:] != of[:-1]) | (total[1:] != total[:-1])]
    return of[new], total[new]


def sketch(members: np.ndarray) -> bytes:
    """One-bit cells, a power of two of them, at least BITS times the members: parities of how many members fall into each."""
    bits = 64
    while bits < BITS * len(members):
        bits *= 2
    odd = np.bincount((members % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(raw: bytes, size: int) -> np.ndarray:
    """A sketch with fewer cells (bytes) of the same set."""
    x = np.frombuffer(raw, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def xor_cells(of: np.ndarray, members: np.ndarray, bands: np.ndarray, plain: frozenset) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the cells in use, for the given band of each text (-1: none)."""
    band = bands[of]
    use = band >= 0
    of, members, band = of[use], members[use], band[use]
    cells = cells_of(band)
    if plain:
        cells = np.where(np.isin(band, list(plain)), 0, cells)
    place = mix64(members ^ np.uint64(0x5851F42D4C957F2D))
    cell = np.where(cells > 0, place % np.maximum(cells, 1).astype(np.uint64), members)
    order = np.lexsort((cell, of))
    of, cell, members, band = of[order], cell[order], members[order], band[order]
    start = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (cell[1:] != cell[:-1])]) if len(of) else np.zeros(0, np.int64)
    value = np.bitwise_xor.reduceat(members, start) if len(start) else members
    return of[start], mix64(value ^ mix64(cell[start] * np.uint64(0x9E3779B97F4A7C15) + band[start].astype(np.uint64)))


def roles(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band of each size (-1 for empty sets) and the lower band in which it is the larger set of a pair (-1: none)."""
    own = np.where(sizes > 0, band_of(np.maximum(sizes, 1)), -1)
    below = BANDS[np.maximum(own - 1, 0)]
    lower = np.where((own > 0) & (4 * sizes <= 5 * below), own - 1, -1)
    return own, lower


def spare(sizes: np.ndarray, bands: np.ndarray, used: np.ndarray, plain: frozenset) -> np.ndarray:
    """How many of its cells in use a set can leave out, whichever they are in an order that all sets share."""
    single = (cells_of(np.maximum(bands, 0)) == 0) | np.isin(bands, list(plain))
    return np.clip(used - np.where(single, sizes // 5, sizes // 4) - 1, 0, 2**15 - 1)


def _profiles(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("rkey", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.binary()), ("weak", pa.int32())])

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            sizes, keys, sketches, weak = [], [], [], []
            for a, b in chunks(offsets):
                of, members = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                per = np.bincount(of, minlength=b - a)
                ends = np.cumsum(per)
                own, _ = roles(per)
                used = np.bincount(xor_cells(of, members, own, frozenset())[0], minlength=b - a)
                weak.append(np.where((per > 0) & (used <= per // 4), own, -1))
                sizes.append(per)
                for s, e in zip(ends - per, ends):
                    part = members[s:e]
                    keys.append(hashlib.blake2b(part.tobytes(), digest_size=16).digest())
                    sketches.append(sketch(part))
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            columns = [batch.column("doc_id"), batch.column("rkey"), pa.array(join(sizes).astype(np.int64)), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(join(weak).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return profiles


BLOCK = pa.schema([("bucket", pa.int32()), ("sets", pa.binary()), ("at", pa.binary()), ("keys", pa.binary())])
#: A set in a block: its size, and the cells it can spare in its own band and in the lower one; tag tells texts of one id apart.
SET = np.dtype([("doc", "<i8"), ("n", "<i4"), ("own", "<i2"), ("lower", "<i2"), ("tag", "<i4")])
ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("spare", "<i2"), ("role", "<i2"), ("tag", "<i4")])


def _cells(n: int, buckets: int, plain: frozenset):
    def send(held: list) -> pa.RecordBatch:
        sets, of, keys = (np.concatenate(x) for x in zip(*held))
        # the last bit of an entry tells whether it is the band's own (0) or the next band's (1)
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, of, keys = bucket[order], of[order], keys[order]
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows = []
        for s, e in zip(start, [*start[1:], len(keys)]):
            here, at = np.unique(of[s:e] >> 1, return_inverse=True)
            rows.append((int(bucket[s]), sets[here].tobytes(), ((at << 1) | (of[s:e] & 1)).astype(np.uint32).tobytes(), keys[s:e].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), BLOCK)], schema=BLOCK)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            ids, tags = batch.column("doc_id").to_numpy(), batch.column("rkey").to_numpy() & 0x7FFFFFFF
            for a, b in chunks(offsets):
                of, members = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                per = np.bincount(of, minlength=b - a)
                own, lower = roles(np.where(per > 3, per, 0))  # smaller sets are linked to equal ones only
                o1, k1 = xor_cells(of, members, own, plain)
                o2, k2 = xor_cells(of, members, lower, plain)
                sets = np.zeros(b - a, SET)
                sets["doc"], sets["n"], sets["tag"] = ids[a:b], per, tags[a:b]
                sets["own"], sets["lower"] = spare(per, own, np.bincount(o1, minlength=b - a), plain), spare(per, lower, np.bincount(o2, minlength=b - a), plain)
                held.append((sets, np.r_[(o1 + texts) << 1, ((o2 + texts) << 1) | 1], np.r_[k1, k2]))
                texts += b - a
                size += len(k1) + len(k2)
                if size >= FLUSH:
                    yield send(held)
                    held, size, texts = [], 0, 0
        if size:
            yield send(held)

    return cells


LISTS = "a long, b long, own binary, others binary, entries binary"


def _entries(block: pd.Series) -> np.ndarray:
    sets, at = np.frombuffer(block["sets"], SET), np.frombuffer(block["at"], np.uint32)
    mine, role = sets[at >> 1], at & 1
    out = np.zeros(len(at), ENTRY)
    out["key"], out["role"], out["spare"] = np.frombuffer(block["keys"], np.uint64), role, np.where(role == 1, mine["lower"], mine["own"])
    for name in ("doc", "n", "tag"):
        out[name] = mine[name]
    return out


def _shared(entries: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of key, role and document; where lists start; and how many entries each has, LONG + 1 at least for frequent keys."""
    entries = entries[np.lexsort((entries["tag"], entries["doc"], entries["role"], entries["key"]))]
    k, d, t = entries["key"], entries["doc"], entries["tag"]
    entries = entries[np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (t[1:] != t[:-1])]] if len(k) else entries
    k = entries["key"]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    count = np.diff(np.r_[start, len(k)])
    return entries, start, np.where(np.isin(k[start], frequent), np.maximum(count, LONG + 1), count)


def _list_rows(entries: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """The star pairs (a, b) of each list, and lists of three and more: their members of the band itself and of the next."""
    keys, doc, size, role = (entries[x].astype(np.int64) if x != "key" else entries[x] for x in ("key", "doc", "n", "role"))
    count = np.diff(np.r_[start, len(keys)])
    leader = np.repeat(start, count)
    star = (np.arange(len(keys)) != leader) & (role[leader] == 0)
    a, b = doc[leader[star]], doc[star.nonzero()[0]]
    near = (5 * np.minimum(size[leader[star]], size[star]) >= 4 * np.maximum(size[leader[star]], size[star])) & (a != b)
    lo, hi = np.minimum(a, b)[near], np.maximum(a, b)[near]
    pairs = np.unique(np.column_stack([lo, hi]), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
    seen, more = set(), []
    for s, c in zip(start[count > 2], count[count > 2]):
        if role[s] == 0:
            n_own = int((role[s : s + c] == 0).sum())
            seen.add((doc[s : s + n_own].tobytes(), doc[s + n_own : s + c].tobytes()))
    more = sorted(seen)
    none = pd.array([pd.NA] * len(more), dtype="Int64")
    out = pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "own": None, "others": None}).astype({"a": "Int64", "b": "Int64"})
    return pd.concat([out, pd.DataFrame({"a": none, "b": none, "own": [x for x, _ in more], "others": [x for _, x in more]})], ignore_index=True).assign(entries=None)


def _long_rows(entries: np.ndarray) -> pd.DataFrame:
    parts = [entries[s : s + FLUSH // 16].tobytes() for s in range(0, len(entries), FLUSH // 16)]
    none = pd.array([pd.NA] * len(parts), dtype="Int64")
    return pd.DataFrame({"a": none, "b": none, "own": None, "others": None, "entries": parts})


def _lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lists of each bucket.  Entries of lists that have become long leave at once, so what is held has a bound whatever one key holds."""
    bucket, held, size, most = None, [], 0, GATHER
    frequent = np.zeros(0, np.uint64)

    def flush(last: bool) -> Iterator[pd.DataFrame]:
        nonlocal held, size, most, frequent
        entries, start, count = _shared(np.concatenate(held), frequent)
        long = np.repeat(count > LONG, np.diff(np.r_[start, len(entries)]))
        if long.any():
            frequent = np.union1d(frequent, entries["key"][start[count > LONG]])
            yield _long_rows(entries[long])
        entries = entries[~long]
        held, size, most = [entries], len(entries), len(entries) + GATHER
        if last:
            entries, start, count = _shared(entries, frequent[:0])
            some = np.repeat(count > 1, count)
            entries, start, _ = _shared(entries[some], frequent[:0])
            if len(entries):
                yield _list_rows(entries, start)
            held, size, most, frequent = [], 0, GATHER, np.zeros(0, np.uint64)

    for frame in frames:
        for _, block in frame.iterrows():
            if held and block["bucket"] != bucket:
                yield from flush(True)
            bucket = block["bucket"]
            held.append(_entries(block))
            size += len(held[-1])
            if size >= most:
                yield from flush(False)
    if held:
        yield from flush(True)


def _open_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"key": pa.int64(), "doc": pa.int64(), "n": pa.int32(), "spare": pa.int32(), "own": pa.bool_(), "tag": pa.int32()}
    for batch in batches:
        for raw in batch.column("entries"):
            x = np.frombuffer(raw.as_buffer(), ENTRY)
            columns = {"key": x["key"].view(np.int64), "doc": x["doc"], "n": x["n"], "spare": x["spare"], "own": x["role"] == 0, "tag": x["tag"]}
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(columns[c]), t) for c, t in kinds.items()], names=list(kinds))


def _hamming_ok(sa: bytes, sb: bytes, na: int, nb: int) -> bool:
    size = min(len(sa), len(sb))
    differ = int(np.bitwise_count(fold(sa, size) ^ fold(sb, size)).sum())
    return 9 * differ <= na + nb


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
        na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
        keep = [_hamming_ok(*x) for x in zip(sa, sb, na, nb)]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _sets(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            out = []
            for a, b in chunks(offsets):
                of, members = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                ends = np.cumsum(np.bincount(of, minlength=b - a))
                raw = np.ascontiguousarray(members.view(np.uint8).reshape(-1, 8)[:, :6])
                out += [raw[s:e].tobytes() for s, e in zip(np.r_[0, ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rkey"), pa.array(out, pa.binary())], names=["doc_id", "rkey", "members"])

    return sets


def _members(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("ma"), batch.column("mb")):
            p, q = _members(x.as_py()), _members(y.as_py())
            both = np.sort(np.r_[p, q])
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= 80 * (len(p) + len(q) - common))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _cross_sorted(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Pairs within tiles of lists that are in different components, pruned by size and by Hamming distance.

    Rows of a tile stand together; a row meets the next, the next but one and so on of its tile, for all tiles at once.
    Pairs leave as packed blocks, so that those of overlapping lists can be made one.
    """
    lid, t, u = (frame[c].to_numpy() for c in ("lid", "t", "u"))
    group = np.cumsum(np.r_[True, (lid[1:] != lid[:-1]) | (t[1:] != t[:-1]) | (u[1:] != u[:-1])])
    own, comp, doc, n, tile = (frame[c].to_numpy() for c in ("own", "comp", "doc", "n", "tile"))
    last = np.searchsorted(group, group, "right") - 1
    pairs, left = [], np.arange(len(frame))
    step = 1
    while len(left := left[left + step <= last[left]]):
        right = left + step
        ok = (comp[left] != comp[right]) & (own[left] | own[right]) & ((t == u)[left] | (tile[left] != tile[right])) & (doc[left] != doc[right])
        ok &= 5 * np.minimum(n[left], n[right]) >= 4 * np.maximum(n[left], n[right])
        pairs.append(np.column_stack([left[ok], right[ok]]))
        step += 1
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    ids = np.sort(doc[pairs], axis=1)
    _, first = np.unique(ids, axis=0, return_index=True)
    near = first[_near(list(frame["sketch"]), n, pairs[first])]
    return _packed(ids[near], buckets)


def _packed(pairs: np.ndarray, buckets: int) -> pd.DataFrame:
    """Pairs by hash in packed blocks."""
    bucket = (mix64(pairs[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pairs[:, 1].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, pairs = bucket[order], pairs[order]
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    rows = [(int(bucket[s]), pairs[s:e].astype(np.int64).tobytes()) for s, e in zip(start, [*start[1:], len(bucket)])]
    return pd.DataFrame(rows, columns=["bucket", "pairs"])


def _unpacked(frame: pd.DataFrame) -> pd.DataFrame:
    """The different pairs of a bucket; lists that overlap have sent some of them several times."""
    pairs = np.unique(np.frombuffer(b"".join(frame["pairs"]), np.int64).reshape(-1, 2), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _near(sketches: list[bytes], n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether the Hamming distances of pairs of rows let them be linked; sketches are folded to the shorter one's size."""
    size = np.array([len(s) for s in sketches])
    out = np.zeros(len(pairs), bool)
    need = np.minimum(size[pairs[:, 0]], size[pairs[:, 1]]) if len(pairs) else np.zeros(0, np.int64)
    for width in np.unique(need):
        which = np.flatnonzero(need == width)
        used, at = np.unique(pairs[which], return_inverse=True)
        folded, at = np.stack([fold(sketches[i], width) for i in used]), at.reshape(-1, 2)
        for s in range(0, len(which), max(1, (8 << 20) // int(width))):
            part = slice(s, s + max(1, (8 << 20) // int(width)))
            differ = np.bitwise_count(folded[at[part, 0]] ^ folded[at[part, 1]]).sum(1, dtype=np.int64)
            out[which[part]] = 9 * differ <= n[pairs[which[part]]].sum(1)
    return out


def _cross(buckets: int):
    def cross(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            # the last tile may go on in the next batch
            end = frame.iloc[-1]
            tail = (frame["lid"] == end["lid"]) & (frame["t"] == end["t"]) & (frame["u"] == end["u"])
            held = frame[tail]
            if not tail.all():
                yield _cross_sorted(frame[~tail], buckets)
        if held is not None and len(held):
            yield _cross_sorted(held, buckets)

    return cross


def _common(members: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many members each of the left sets has in common with each of the right ones."""
    every = _members(b"".join(members))
    of = np.repeat(np.arange(len(members)), [len(m) // 6 for m in members])
    _, at, times = np.unique(every, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    some = np.flatnonzero(times[at] > 1)
    some = some[np.argsort(at[some], kind="stable")]
    of, at = of[some], column[at[some]]
    kind = np.float32 if len(every) < 1 << 24 else np.float64
    out = np.zeros((len(left), len(right)), kind)
    for s in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, [s, s + COLUMNS])
        has = np.zeros((len(members), int(at[b - 1]) + 1 - s), kind)
        has[of[a:b], at[a:b] - s] = 1
        out += has[left] @ has[right].T
    return out


def _linked(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, linked) of one tile, rows and a matrix; within one part of a component every pair comes both ways."""
    tile, doc = frame["tile"].to_numpy(), frame["doc_id"].to_numpy()
    inner = frame["t"].iloc[0] == frame["u"].iloc[0]
    left = np.flatnonzero(tile == frame["t"].iloc[0])
    right = left if inner else np.flatnonzero(tile == frame["u"].iloc[0])
    members = list(frame["members"])
    n = np.array([len(m) // 6 for m in members])
    common = _common(members, left, right)
    return left, right, (100 * common >= 80 * (n[left][:, None] + n[right] - common)) & (doc[left][:, None] != doc[right])


def _tile_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    left, right, linked = _linked(frame)
    doc = frame["doc_id"].to_numpy()
    x, y = np.nonzero(linked)
    pairs = np.unique(np.sort(np.column_stack([doc[left[x]], doc[right[y]]]), axis=1), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _tile_sums(frame: pd.DataFrame) -> pd.DataFrame:
    left, right, linked = _linked(frame)
    doc, rkey, copies = (frame[c].to_numpy() for c in ("doc_id", "rkey", "copies"))
    linked = linked.astype(np.float64)
    at, sums = left, linked @ copies[right]
    if left is not right:
        at, sums = np.r_[left, right], np.r_[sums, copies[left] @ linked]
    return pd.DataFrame({"doc_id": doc[at], "rkey": rkey[at], "links": sums.astype(np.int64)})


def _each_tile(work):
    def tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            # a text that comes in several rows of its id has equal rows here, one after another
            named = frame[["comp", "t", "u", "doc_id", "rkey"]].to_numpy()
            frame = frame[np.r_[True, (named[1:] != named[:-1]).any(1)]]
            comp, t, u = (frame[c].to_numpy() for c in ("comp", "t", "u"))
            start = np.flatnonzero(np.r_[True, (comp[1:] != comp[:-1]) | (t[1:] != t[:-1]) | (u[1:] != u[:-1])])
            done = [work(frame.iloc[s:e]) for s, e in zip(start, start[1:])]
            if done:
                yield pd.concat(done, ignore_index=True)
            # the last tile may go on in the next batch
            held = frame.iloc[start[-1] :]
        if held is not None and len(held):
            yield work(held)

    return tiles


class Join:
    """The similarity join of a table; links() and classes() give its results, components_only() only the components."""

    def __init__(self, docs: DataFrame, n: int = N):
        self.n, self.spark = n, docs.sparkSession
        text = F.coalesce(F.col("text"), F.lit(""))
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), text).alias("rkey"), text.alias("text"))
        self.rows = materialise(self.docs.mapInArrow(_profiles(n), "doc_id long, rkey long, n long, set_key binary, sketch binary, weak int"), "profiles")
        some = self.rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        # one row of each set of equal sets; all rows of its id stand for it
        first = some.groupBy("set_key").agg(F.min(F.struct("doc_id", "rkey", "n", "sketch")).alias("f"))
        self.first = materialise(first.select("set_key", "f.*"), "sets")
        #: Tables of the members of sets, as they are needed; the sets of all components are among them in the end.
        self.members: list[DataFrame] = []

    def _texts(self, chosen: DataFrame) -> DataFrame:
        """The texts of chosen (doc_id, rkey)."""
        return self.docs.join(chosen, ["doc_id", "rkey"], "left_semi").select("doc_id", "rkey", "text")

    def _sketch_pairs(self, pairs: DataFrame) -> DataFrame:
        p = self.first.select("doc_id", "n", "sketch")
        one = pairs.join(p.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
        two = one.join(p.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
        return two.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_prune, "a long, b long").distinct()

    def _verified(self, pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
        chosen = self.first.join(ids, "doc_id", "left_semi").select("doc_id", "rkey")
        sets = materialise(self._texts(chosen).mapInArrow(_sets(self.n), "doc_id long, rkey long, members binary"), "members")
        self.members.append(sets)
        one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("ma")), "a")
        two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("mb")), "b")
        return materialise(two.select("a", "b", "ma", "mb").mapInArrow(_verify, "a long, b long").distinct(), "links")

    def spanning_links(self) -> DataFrame:
        """a, b: verified links between representatives that connect every component; not all links."""
        parts = shuffle_partitions(self.spark)
        total = self.first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        buckets = max(2 * parts, -(-total // (2 * BUCKET)))
        plain = frozenset(r[0] for r in self.rows.where("weak >= 0").select("weak").distinct().collect())
        cells = self._texts(self.first.select("doc_id", "rkey")).mapInArrow(_cells(self.n, buckets, plain), "bucket int, sets binary, at binary, keys binary")
        found = materialise(cells.repartition(2 * parts, "bucket").sortWithinPartitions("bucket").mapInPandas(_lists, LISTS), "lists")
        long = self._long_lists(found)
        centres = long.groupBy("lid").agg(F.min(F.when(F.col("own"), F.struct(F.col("doc").alias("first"), F.col("n").alias("m")))).alias("f")).select("lid", "f.*")
        rays = long.join(centres, "lid").where((F.col("doc") != F.col("first")) & (5 * F.least("n", "m") >= 4 * F.greatest("n", "m"))).select(F.least("doc", "first").alias("a"), F.greatest("doc", "first").alias("b"))
        star = materialise(self._sketch_pairs(found.where(F.col("a").isNotNull()).select("a", "b").union(rays).distinct()), "star")
        # first one pair for each document: most then are in one component already
        nearest = materialise(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "nearest")
        links = self._verified(nearest)
        known = components(links)
        # what is linked already is in one component and does not come again
        again = materialise(self._different(star, known).union(self._cross_pairs(found, long, known)).distinct(), "cross")
        return links.union(self._verified(again))

    def _long_lists(self, found: DataFrame) -> DataFrame:
        """lid, doc, n, own, size: the entries of long lists that their sets cannot spare."""
        every = materialise(found.where(F.col("entries").isNotNull()).mapInArrow(_open_long, "key long, doc long, n int, spare int, own boolean, tag int"), "long")
        held = every.join(every.groupBy("key").agg(F.count(F.lit(1)).alias("held")), "key")
        # each set leaves the longest of its long lists first
        w = Window.partitionBy("doc", "tag", "n", "own").orderBy(F.desc("held"), "key")
        kept = held.withColumn("at", F.row_number().over(w)).where(F.col("at") > F.col("spare"))
        kept = materialise(kept.select(F.col("key").alias("lid"), "doc", "n", "own"), "kept")
        sizes = kept.groupBy("lid").agg(F.count(F.lit(1)).alias("size"), F.max("own").alias("some")).where("size > 1 AND some").select("lid", F.col("size").cast("int"))
        return materialise(kept.join(sizes, "lid"), "long-lists")

    @staticmethod
    def _different(pairs: DataFrame, known: DataFrame) -> DataFrame:
        ca, cb = known.select(F.col("v").alias("a"), F.col("c").alias("ca")), known.select(F.col("v").alias("b"), F.col("c").alias("cb"))
        both = pairs.join(ca, "a", "left").join(cb, "b", "left")
        return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def _cross_pairs(self, found: DataFrame, long: DataFrame, known: DataFrame) -> DataFrame:
        lists = found.where(F.col("own").isNotNull()).select("own", "others").distinct()
        lists = lists.withColumn("lid", F.xxhash64(F.sha2("own", 256), F.sha2("others", 256)))
        opened = lists.mapInArrow(_open, "lid long, doc long, own boolean, size int")
        opened = opened.union(long.select("lid", "doc", "own", "size"))
        at = opened.join(known.select(F.col("v").alias("doc"), F.col("c").alias("comp")), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        at = materialise(at, "placed")
        split = at.groupBy("lid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("lid")
        inside = at.join(split, "lid", "left_semi").join(self.first.select(F.col("doc_id").alias("doc"), "n", "sketch"), "doc")
        tiles = F.ceil(F.col("size") / TILE).cast("int")
        rest = inside.withColumn("tile", F.pmod(F.xxhash64("doc"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        rest = rest.withColumn("t", F.least("tile", "other")).withColumn("u", F.greatest("tile", "other"))
        dealt = rest.select("lid", "t", "u", "tile", "own", "comp", "doc", "n", "sketch").repartition("lid", "t", "u").sortWithinPartitions("lid", "t", "u")
        packed = dealt.mapInPandas(_cross(2 * shuffle_partitions(self.spark)), "bucket int, pairs binary")
        return packed.groupBy("bucket").applyInPandas(_unpacked, "a long, b long")

    def _tiles(self, known: DataFrame) -> DataFrame:
        """The sets of components in tiles, so that any two of a component meet in one."""
        some = self.rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        self.copies = materialise(some.select("set_key", "doc_id").distinct().groupBy("set_key").agg(F.count("*").alias("copies")), "copies")
        inside = self.first.select("set_key", "doc_id", "rkey", "n").join(known.select(F.col("v").alias("doc_id"), F.col("c").alias("comp")), "doc_id").join(self.copies, "set_key")
        inside = materialise(inside.select("doc_id", "rkey", "n", "comp", "copies"), "inside")
        sizes = inside.groupBy("comp").agg(F.count("*").alias("size"), F.max("n").alias("most"))
        side = F.greatest(F.least(F.lit(SIDE), F.floor(F.lit(HELD) / F.col("most"))), F.lit(1))
        sizes = sizes.select("comp", F.ceil(F.col("size") / side).cast("int").alias("tiles"))
        members = self.members[0]
        for more in self.members[1:]:
            members = members.union(more.join(members.select("doc_id", "rkey"), ["doc_id", "rkey"], "left_anti").select("doc_id", "rkey", "members"))
        rows = inside.join(sizes, "comp").withColumn("tile", F.pmod(F.xxhash64("doc_id", "rkey"), F.col("tiles")).cast("int"))
        rows = rows.join(members, ["doc_id", "rkey"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        rows = rows.select("comp", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "tile", "doc_id", "rkey", "copies", "members")
        return rows.repartition("comp", "t", "u").sortWithinPartitions("comp", "t", "u", "doc_id", "rkey")

    def links(self) -> DataFrame:
        """a, b: all links between representatives of different sets, a < b."""
        known = components(self.spanning_links())
        return self._tiles(known).mapInPandas(_each_tile(_tile_pairs), "a long, b long").distinct()

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id, n_links for every row."""
        known = components(self.spanning_links())
        sums = self._tiles(known).mapInPandas(_each_tile(_tile_sums), "doc_id long, rkey long, links long")
        sums = materialise(sums.groupBy("doc_id", "rkey").agg(F.sum("links").alias("links")), "sums")
        counts = self.first.select("set_key", "doc_id", "rkey").join(sums, ["doc_id", "rkey"], "left").join(self.copies, "set_key")
        return self._named(known, counts.select("set_key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))

    def components_only(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row: classes without their numbers of links, which needs fewer pairs."""
        return self._named(components(self.spanning_links()))

    def _named(self, known: DataFrame, counts: DataFrame | None = None) -> DataFrame:
        # rows that share an id are one document: their sets' representatives belong together
        named = self.first.select("set_key", F.col("doc_id").alias("rep")).join(known.select(F.col("v").alias("rep"), F.col("c").alias("comp")), "rep", "left")
        named = named.select("set_key", F.coalesce("comp", "rep").alias("comp"))
        more = [] if counts is None else ["n_links"]
        named = materialise(named if counts is None else named.join(counts, "set_key"), "named")
        rows = self.rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key"))
        some = rows.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).join(named, "set_key")
        none = rows.where(F.col("set_key").isNull() | F.col("doc_id").isNull()).withColumn("comp", F.col("doc_id"))
        none = none.withColumn("n_links", F.lit(0).cast("long"))
        every = some.select("doc_id", "n", "comp", *more).union(none.select("doc_id", "n", "comp", *more))
        return every.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), *more)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lid", pa.int64()), ("doc", pa.int64()), ("own", pa.bool_()), ("size", pa.int32())])
    for batch in batches:
        names, docs, own, sizes = [], [], [], []
        for x, y, name in zip(batch.column("own").to_pylist(), batch.column("others").to_pylist(), batch.column("lid").to_pylist()):
            p, q = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            n = len(p) + len(q)
            names += [name] * n
            docs.append(np.r_[p, q])
            own.append(np.r_[np.ones(len(p), bool), np.zeros(len(q), bool)])
            sizes.append(np.full(n, n, np.int32))
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(join(docs, np.int64)), pa.array(join(own, bool)), pa.array(join(sizes, np.int32))], schema=schema)


def jaccard_classes(docs: DataFrame, n: int = N) -> DataFrame:
    return Join(docs, n).classes()


def one_of_each(docs: DataFrame, n: int = N) -> DataFrame:
    """The columns of documents; of each class of near-duplicates the row with the smallest id stays.

    Documents without words are not near-duplicates of anything and stay.  Of rows that repeat id and text one stays;
    rows that share an id but not a text are one document and stay together.
    """
    classes = Join(docs, n).components_only()
    keep = materialise(classes.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")), "keep")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    some = docs.select(*columns)
    once = some.join(keep.where("times = 1"), "doc_id", "left_semi")
    often = some.join(keep.where("times > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(often).union(some.where(F.col("doc_id").isNull()))
