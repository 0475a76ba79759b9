"""Cross-entropy difference of matched target and background n-gram models.

Two models of the same order, with the same smoothing and one shared vocabulary,
are counted: one over the target documents, one over all documents.  A token's
loss is minus the logarithm of its probability; a document's score is the mean of
the losses under the target model less those under the background model (Moore
and Lewis), so lower is closer to the target.

Vocabulary: the different words of all documents, named by 64-bit hashes, the same
for both models.  Probabilities of a word after another:

    p(w | v) = (c(v, w) + MASS * p1(w)) / (c(v) + MASS),   p1(w) = (c(w) + 1) / (N + words)

Counts leave out the document that is scored (leave-one-out), in the pairs and
their histories, so that a target document does not recognise itself.

Neither pair counts nor word counts can be broadcast; only those of frequent words
are (a word of at least 1 in 2**FREQUENT tokens, so no more than that many).  A
document's losses are first added up as far as frequent words go, as if no other
document had any of its pairs.  Its pairs are dealt into buckets as packed blocks:
those that end in a frequent word by the hash of the pair, those that end in another
word by the hash of that word.  So a bucket has every occurrence of its pairs, and
every occurrence of its words that are not frequent, from which it counts these as
words and histories.  It sends back by how much a document's losses change, summed
per document.  Traffic follows the number of pairs, and no task holds more than a
bucket.

Texts stay where they lie: the ids of target documents, as a set of 65,536-id chunks,
are broadcast while that set, counted first, has at most IDS bytes (a bit per document
where ids are dense).  Beyond that rows are merged with the ids instead.

With bits= words and histories are counted by 2**bits hash classes instead, all of
them broadcast.

Defined results: null and blank texts have no tokens and null losses and scores;
a document whose id is null is no target; rows that repeat are documents of their
own; without target documents the target model is uniform; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, shuffle_partitions, utf8_column
from .words import LOWER, chunks, prefix_hash, slice_hash, words

FREQUENT, MASS = 16, 20.0
#: Pairs of a bucket on average; pairs gathered before blocks are sent on.
BUCKET, FLUSH = 1 << 20, 1 << 20
#: Bytes of the broadcast set of target ids at most.
IDS = 32 << 20
START = 0


def classes(data: np.ndarray, offsets: np.ndarray, bits: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 64-bit hash of the word, name under which it is counted: its hash or class) of every word."""
    starts, ends, of = words(data, offsets)
    h = slice_hash(prefix_hash(LOWER[data]), starts, ends) if len(of) else np.zeros(0, np.uint64)
    return of, h, h >> np.uint64(64 - bits) if bits else h


def pairs(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of history, hash of pair) of every token; a text's first token follows START."""
    before = np.zeros(len(h), np.uint64)
    if len(h):
        before[1:] = np.where(of[1:] == of[:-1], h[:-1], np.uint64(START))
    return before, mix64(before * np.uint64(0x9E3779B97F4A7C15) + h)


class Ids:
    """A set of ids by chunks of 65,536: the lower 16 bits of a few, or a bit for each."""

    FEW, CHUNK = 4096, 1 << 16
    SCHEMA = "chunk long, ids binary"

    def __init__(self, rows: list):
        self.chunks = np.array(sorted(r["chunk"] for r in rows), np.int64)
        self.parts = [bytes(r["ids"]) for r in sorted(rows, key=lambda r: r["chunk"])]

    @classmethod
    def pack(cls, pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.unique(pdf["doc_id"].to_numpy(np.int64) & (cls.CHUNK - 1))
        if len(low) > cls.FEW:
            low = np.packbits(np.bincount(low, minlength=cls.CHUNK).astype(bool))
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "ids": [low.astype(np.uint8 if low.dtype == np.uint8 else np.uint16).tobytes()]})

    @classmethod
    def of(cls, ids: DataFrame) -> DataFrame:
        """ids: doc_id, different ones and none null; so a group has a chunk's ids at most."""
        return ids.withColumn("chunk", F.shiftright("doc_id", 16)).groupBy("chunk").applyInPandas(lambda pdf: cls.pack(pdf), cls.SCHEMA)

    def holds(self, ids: pa.Array) -> np.ndarray:
        values, valid = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(values), bool)
        chunks, which = np.unique(values >> 16, return_inverse=True)
        places = np.searchsorted(self.chunks, chunks)
        order, ends = np.argsort(which, kind="stable"), np.cumsum(np.bincount(which, minlength=len(chunks)))
        for i, (chunk, place) in enumerate(zip(chunks, places)):
            if place == len(self.chunks) or self.chunks[place] != chunk:
                continue
            at = order[ends[i - 1] if i else 0 : ends[i]]
            low, part = values[at] & (self.CHUNK - 1), self.parts[place]
            if len(part) == self.CHUNK // 8:
                bits = np.frombuffer(part, np.uint8)
                out[at] = (bits[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1
            else:
                few = np.frombuffer(part, np.uint16)
                out[at] = few[np.minimum(np.searchsorted(few, low), len(few) - 1)] == low
        return out & valid


def _flags(batch: pa.RecordBatch, ids: Ids | None) -> np.ndarray:
    return ids.holds(batch.column("doc_id")) if ids else batch.column("target").to_numpy(zero_copy_only=False).astype(bool)


def _summed(held: list) -> list:
    names, counts = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held], axis=1)
    names, at = np.unique(names, return_inverse=True)
    return [(names, np.stack([np.bincount(at, c, len(names)).astype(np.int64) for c in counts]))]


def _unigrams(bits: int | None, ids: Ids | None):
    def rows(names: np.ndarray, counts: np.ndarray, texts: bool) -> pa.RecordBatch:
        columns = [pa.array(names.view(np.int64)), pa.array(counts[0]), pa.array(counts[1]), pa.array(np.full(len(names), texts))]
        return pa.RecordBatch.from_arrays(columns, names=["name", "target", "background", "texts"])

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, np.zeros((2, 1), np.int64)
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            target = _flags(batch, ids)
            for a, b in chunks(offsets):
                of, _, name = classes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                per = np.bincount(of, minlength=b - a) > 0
                held += _summed([(name, np.stack([target[a:b][of], np.ones(len(of), bool)]))])
                size += len(held[-1][0])
                texts += [[int((per & target[a:b]).sum())], [int(per.sum())]]
                if size > FLUSH:
                    held = _summed(held)
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield rows(*held[0], False)
                        held, size = [], 0
        if held:
            yield rows(*_summed(held)[0], False)
        yield rows(np.zeros(1, np.uint64), texts, True)

    return unigrams


def _most(most: int | None):
    """The most frequent words of a part of the words, and a row with its totals; the rows of texts as they are."""

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, total = [], np.zeros(3, np.int64)
        for frame in frames:
            yield frame[frame["texts"]].assign(kind=2, words=0)[["kind", "name", "target", "background", "words"]]
            frame = frame[~frame["texts"]]
            total += [frame["target"].sum(), frame["background"].sum(), len(frame)]
            top.append(frame[["name", "target", "background"]])
            if most:
                top = [pd.concat(top).nlargest(most, "background")]
        if total[2]:
            yield pd.DataFrame([(1, 0, *total)], columns=["kind", "name", "target", "background", "words"])
            yield pd.concat(top).assign(kind=0, words=0)[["kind", "name", "target", "background", "words"]]

    return found


#: cls: places among the broadcast words; or instead of it, for other words, names and which is the end of a text.
FIELDS = ("at", "cls", "names", "last", "times", "target", "keys", "base")
BLOCK = pa.schema([("bucket", pa.int32()), ("origin", pa.int64()), *((f, pa.binary()) for f in FIELDS)])
ENTRY = "bucket int, origin long, " + ", ".join(f"{f} binary" for f in FIELDS)
BASE = np.dtype([("doc_id", "<i8"), ("known", "?"), ("tokens", "<i8"), ("target", "<f8"), ("background", "<f8")])


class Unigrams:
    """Counts of both models (0 target, 1 background) of the broadcast names, in order of name; of all tokens; of non-empty texts, the counts of START; number of words."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, tokens: np.ndarray, texts: np.ndarray, n_words: int):
        self.names, self.counts, self.tokens, self.texts, self.n_words = names, counts, tokens, texts, n_words
        self.p1 = np.stack([self.share(k, counts[k]) for k in range(2)])

    def share(self, k: int, counts: np.ndarray) -> np.ndarray:
        return (counts + 1.0) / (self.tokens[k] + self.n_words)

    def place(self, names: np.ndarray) -> np.ndarray:
        """The place of each name, -1 for those that aren't broadcast."""
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, -1)


def _short(x: np.ndarray) -> bytes:
    """The lower 48 bits."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _wide(parts: pd.Series) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).ravel()


def _small(x: np.ndarray) -> bytes:
    """Numbers, most of them small, in a byte each: one byte of 255 for each 255, then the rest."""
    whole, rest = np.divmod(x, 255)
    ends = np.cumsum(whole + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = rest
    return out.tobytes()


def _sums(raw: bytes) -> np.ndarray:
    """The running sums of the numbers of _small()."""
    steps = np.frombuffer(raw, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _bits(parts: pd.Series, lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(parts, lengths)]).astype(bool)


def _send(unigrams: Unigrams, bits: int | None, buckets: int, targets: Ids | None = None):
    """Blocks of (document, pair), and for each origin one row with the losses of its documents as if all pairs were new."""

    def flush(held: list, origin: int) -> Iterator[pa.RecordBatch]:
        at, keys, names, cls, last, times, target = (np.concatenate(x) for x in zip(*held))
        bucket = (np.where(cls < 0, names, keys) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((cls < 0, bucket))
        bucket, at, keys, names, cls, last, times, target = (x[order] for x in (bucket, at, keys, names, cls, last, times, target))
        start = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | ((cls[1:] < 0) != (cls[:-1] < 0))])
        rows = []
        for s, e in zip(start, [*start[1:], len(keys)]):
            steps = _small(np.diff(at[s:e], prepend=0))
            how = (_small(times[s:e]), np.packbits(target[s:e]).tobytes(), _short(keys[s:e] // np.uint64(buckets)), None)
            if cls[s] < 0:
                rows.append((int(bucket[s]), origin, steps, None, _short(names[s:e] // np.uint64(buckets)), np.packbits(last[s:e]).tobytes(), *how))
            else:
                rows.append((int(bucket[s]), origin, steps, cls[s:e].astype(np.uint32 if len(unigrams.names) > 1 << 16 else np.uint16).tobytes(), None, None, *how))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), BLOCK)], schema=BLOCK)

    def base_row(base: np.ndarray, origin: int) -> pa.RecordBatch:
        row = (origin % buckets, origin, *[None] * (len(FIELDS) - 1), base.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, BLOCK)], schema=BLOCK)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = utf8_column(batch.column("text"))
            target = _flags(batch, targets)
            for a, b in chunks(offsets, 6 * FLUSH):
                base, held = np.zeros(b - a, BASE), []
                ids = batch.column("doc_id").slice(a, b - a)
                base["known"] = ids.is_valid().to_numpy(zero_copy_only=False)
                base["doc_id"] = ids.fill_null(0).to_numpy()
                for c, d in chunks(offsets[a : b + 1]):
                    c, d = a + c, a + d
                    of, h, name = classes(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c], bits)
                    if not len(of):
                        continue
                    cls = unigrams.place(name)
                    past = np.r_[-1, cls[:-1]]
                    before, key = pairs(of, h)
                    first = before == START
                    by = np.lexsort((before, of))
                    new = np.r_[True, (of[by][1:] != of[by][:-1]) | (before[by][1:] != before[by][:-1])]
                    group = np.cumsum(new) - 1
                    own = np.empty(len(of))
                    own[by] = np.bincount(group)[group]
                    flags = target[c:d]
                    here = slice(c - a, d - a)
                    base["tokens"][here] = np.bincount(of, minlength=d - c)
                    for k, model in enumerate(("target", "background")):
                        seen = np.where(first, unigrams.texts[k], np.r_[unigrams.counts[k], 0][past])
                        seen = np.maximum(seen - own * (flags[of] if k == 0 else 1), 0)
                        loss = np.where(first | (past >= 0), np.log(seen + MASS), 0) - np.r_[np.log(MASS * unigrams.p1[k]), 0][cls]
                        base[model][here] = np.bincount(of, loss, d - c)
                    order = np.lexsort((key, of))
                    last = np.r_[of[1:] != of[:-1], True][order]
                    of, key, name, cls = of[order], key[order], name[order], cls[order]
                    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])])
                    held.append((of[new] + (c - a), key[new], name[new], cls[new], np.logical_or.reduceat(last, new), np.diff(np.r_[new, len(of)]), flags[of[new]]))
                if held:
                    yield from flush(held, origin)
                yield base_row(base, origin)
                origin += 1

    return send


def _others(group: np.ndarray, mine: np.ndarray) -> np.ndarray:
    return np.bincount(group, mine)[group] - mine


def _groups(*keys: np.ndarray) -> np.ndarray:
    """The number of each row's group of equal keys."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _gains(unigrams: Unigrams):
    """What each document's losses fall by because other documents have its pairs too, and for words that aren't broadcast by their own counts."""
    kind = np.uint32 if len(unigrams.names) > 1 << 16 else np.uint16

    def falls(some: pd.DataFrame, lengths: np.ndarray, places: np.ndarray, frequent: bool) -> list[np.ndarray]:
        times = np.diff(_sums(b"".join(some["times"])), prepend=0).astype(np.float64)
        target = _bits(some["target"], lengths)
        keys, fall = _wide(some["keys"]), []
        if frequent:
            cls, group = np.frombuffer(b"".join(some["cls"]), kind), _groups(keys)
        else:
            word = _groups(_wide(some["names"]))
            group = _groups(keys, word)
            # as a history: each time but at the end of the text
            inside = _groups(places, np.repeat(np.arange(len(some)), lengths), word)
            _, one = np.unique(inside, return_index=True)
            before = np.bincount(inside, times - _bits(some["last"], lengths))
        for k in range(2):
            mine = times * target if k == 0 else times
            if frequent:
                fall.append(times * np.log1p(_others(group, mine) / (MASS * unigrams.p1[k][cls])))
                continue
            count = np.bincount(word, mine)[word]
            p1 = MASS * unigrams.share(k, count)
            out = times * np.log(p1 + _others(group, mine))
            own = before * target[one] if k == 0 else before
            out[one] -= before * np.log(np.maximum(count[one] - own, 0) + MASS)
            fall.append(out)
        return fall

    def gains(frame: pd.DataFrame) -> pd.DataFrame:
        base = frame[frame["base"].notna()]
        out = [pd.DataFrame({"origin": base["origin"], "at": None, "target": None, "background": None, "base": base["base"]})]
        for frequent in (True, False):
            some = frame[frame["cls" if frequent else "names"].notna()]
            if not len(some):
                continue
            lengths = np.array([len(x) // 6 for x in some["keys"]])
            steps = [_sums(x) for x in some["at"]]
            fall = falls(some, lengths, np.concatenate(steps), frequent)
            rows, at = [], 0
            for origin, places, n in zip(some["origin"], steps, lengths):
                hit = np.flatnonzero((fall[0][at : at + n] != 0) | (fall[1][at : at + n] != 0))
                if len(hit):
                    docs, where = np.unique(places[hit], return_inverse=True)
                    sums = [np.bincount(where, f[at : at + n][hit]).astype(np.float32).tobytes() for f in fall]
                    rows.append((int(origin), _small(np.diff(docs, prepend=0)), *sums, None))
                at += n
            out.append(pd.DataFrame(rows, columns=["origin", "at", "target", "background", "base"]))
        return pd.concat(out, ignore_index=True)

    return gains


def _sum(frame: pd.DataFrame) -> pd.DataFrame:
    base = np.frombuffer(frame["base"].dropna().iloc[0], BASE).copy()
    for at, t, b in zip(frame["at"], frame["target"], frame["background"]):
        if at is not None:
            at = _sums(at)
            base["target"][at] -= np.frombuffer(t, np.float32)
            base["background"][at] -= np.frombuffer(b, np.float32)
    ids = pd.array(base["doc_id"], dtype="Int64")
    ids[~base["known"]] = pd.NA
    n = np.where(base["tokens"] > 0, base["tokens"], np.nan)
    return pd.DataFrame({"doc_id": ids, "n_tokens": base["tokens"], "target_loss": base["target"] / n, "background_loss": base["background"] / n, "score": (base["target"] - base["background"]) / n})


def count_unigrams(rows: DataFrame, bits: int | None = None, targets: Ids | None = None) -> Unigrams:
    """rows: text, and target or, with targets, doc_id."""
    parts = shuffle_partitions(rows.sparkSession)
    counted = rows.select("text", "doc_id" if targets else "target").mapInArrow(_unigrams(bits, targets), "name long, target long, background long, texts boolean")
    counted = counted.repartition(parts, "name", "texts").groupBy("name", "texts").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    # a part has few more than its share of the frequent words; one that is left out is counted in its bucket
    most = None if bits else (2 << FREQUENT) // parts + 1024
    found = materialise(counted.mapInPandas(_most(most), "kind int, name long, target long, background long, words long"), "words").toPandas()
    both = ["target", "background"]
    texts, totals = found[found["kind"] == 2][both].sum().to_numpy(np.int64), found[found["kind"] == 1]
    tokens = totals[both].sum().to_numpy(np.int64)
    found = found[(found["kind"] == 0) & ((bits is not None) | (found["background"] * (1 << FREQUENT) >= tokens[1]))]
    names = found["name"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    return Unigrams(names[order], found[both].to_numpy(np.int64).T[:, order], tokens, texts, 1 << bits if bits else max(1, int(totals["words"].sum())))


def lm_scores(docs: DataFrame, targets: DataFrame, bits: int | None = None, stored: bool = False) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for every row.  targets: doc_id of the target documents.

    stored: docs is read from files, so that a task that runs again has the same rows
    in the same order; otherwise docs is written first.
    """
    marked = targets.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    packed, ids = materialise(Ids.of(marked), "targets"), None
    if packed.agg(F.coalesce(F.sum(F.octet_length("ids") + 16), F.lit(0))).first()[0] <= IDS:
        ids = Ids(packed.collect())
        rows = rows if stored else materialise(rows, "texts", compression="zstd")
    else:
        # merged by id: a task's rows then come in the same order when it runs again
        rows = rows.join(marked.withColumn("target", F.lit(True)).hint("merge"), "doc_id", "left")
        rows = materialise(rows.withColumn("target", F.coalesce("target", F.lit(False))), "marked", compression="zstd")
    unigrams = count_unigrams(rows, bits, ids)
    buckets = int(max(2 * shuffle_partitions(docs.sparkSession), -(-int(unigrams.tokens[1]) // BUCKET)))
    sent = rows.mapInArrow(_send(unigrams, bits, buckets, ids), ENTRY)
    back = sent.groupBy("bucket").applyInPandas(_gains(unigrams), "origin long, at binary, target binary, background binary, base binary")
    return back.groupBy("origin").applyInPandas(_sum, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
