"""Packing by vector bins: tokens, segments and loss-bearing tokens.

Documents are tokenised where they are read; nothing is shuffled.  A document
longer than a sequence gives whole sequences and a rest.  Rests wait in a bounded
pool.  A bin takes, again and again, the piece whose demand (tokens, segments,
loss-bearing tokens) has the largest dot product with the bin's free room, the
classic heuristic of vector bin packing, over one representative per class of
demand; when no piece fits whole, the best one is cut to fill the bin.  What is
left at the end of a task is cut into sequences whose sizes are powers of two,
which need no padding.

Defined results: a null text is an empty document, its only id is the end id;
rows that repeat are documents of their own; sequence ids are unique over the
table and follow the table's partitions; a piece never has more tokens than the
sequence; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: Rests that wait in a task at most; words whose ids a task remembers at most, and their characters; texts' bytes encoded at once.
POOL, WORDS, LETTERS, CHUNK = 4096, 300_000, 64, 4 << 20


class PieceEncoder:
    """Ids of many words at once for a word-end BPE file that lower-cases, splits as PIECES says and drops white space.

    The file's vocabulary serves as ranks of byte strings; the word end is one more
    byte, which always merges first because its merges with single bytes rank first.
    Gives the ids that the tokenizer itself gives for words of characters below
    U+0300 without END, separators (U+001C to U+001F) and the start of a special token.
    """

    #: The split pattern of word-end BPE files, here with the space that separates words.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    END, SUFFIX = "\x01", "</w>"

    def __init__(self, spec: dict):
        import tiktoken

        # PIECES without property classes: below U+0300 the numbers that are no digits are named
        self.find = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+| ").findall
        self.odd = re.compile(r"[\x01\x1c-\x1f\u0300-\U0010ffff]|<\|").search
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        odd = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            ends = token.endswith(self.SUFFIX) and token != self.SUFFIX
            ranks[bytes(byte_of[c] for c in token.removesuffix(self.SUFFIX if ends else "")) + self.END.encode() * ends] = i
        self.space = ranks[b" " + self.END.encode()]
        self.encode = tiktoken.Encoding("words", pat_str=f"[^{self.END}]*{self.END}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def made_for(cls, spec: dict) -> bool:
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        model = spec.get("model", {})
        fits = kinds == ["NFC", "Replace", "Lowercase"] and first.get("pattern", {}).get("Regex") == cls.PIECES and first.get("behavior") == "Removed" and first.get("invert") is True
        return fits and model.get("type") == "BPE" and model.get("end_of_word_suffix") == cls.SUFFIX and not model.get("dropout") and not model.get("ignore_merges")

    def takes(self, words: list[str]) -> list[str]:
        """Those of the words that ids() may be asked for."""
        return words if not self.odd(" ".join(words)) else [w for w in words if not self.odd(w)]

    def ids(self, words: list[str]) -> list[bytes]:
        """The little-endian 32-bit ids of each word; words hold no space."""
        if not words:
            return []
        pieces = self.find(" ".join(words).lower() + " ")
        ids = np.array(self.encode(self.END.join(pieces) + self.END), "<u4")
        ends = np.flatnonzero(ids == self.space)
        raw, starts = ids.tobytes(), np.r_[0, ends[:-1] + 1]
        return [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]


class WordCache:
    """Ids of texts by a tokenizer that drops white space: words are looked up, and encoded once if new.

    Sound for tokenizers whose ids never depend on what stands across a space or a
    line end, as for word-end BPE that splits there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = PieceEncoder(spec) if PieceEncoder.made_for(spec) else None

    @staticmethod
    @functools.lru_cache(1)
    def of(path: str) -> WordCache:
        """One for each process; later tasks of a worker go on with its words."""
        return WordCache(path)

    def learn(self, words: list[str]) -> None:
        slow = words
        if self.fast:
            quick = self.fast.takes(words)
            self.known.update(zip(quick, self.fast.ids(quick)))
            slow = [w for w in words if w not in self.known] if len(quick) < len(words) else []
        for word, found in zip(slow, self.tokenizer.encode_batch_fast(slow, add_special_tokens=False)):
            self.known[word] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split) - self.known.keys()
        if len(self.known) + len(new) > WORDS:
            self.known.clear()
            new = set().union(*split)
        self.learn(list(new))
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, words)), "<u4") for words in split]
        # texts without spaces are words too; remembered, they would fill the memory
        for word in new:
            if len(word) > LETTERS:
                del self.known[word]
        return out


class Packer:
    """Places pieces into bins.  Pieces of equal demand wait in one stack."""

    def __init__(self, tokens: int, segments: int, loss: int, base: int):
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.most = np.array([tokens, segments, loss], np.float64)
        self.n, self.left, self.next, self.rows = 0, 0, base, []
        self.reset({})

    def reset(self, stacks: dict[tuple[int, int], list]) -> None:
        """Numbers the classes of demand anew."""
        self.stacks = list(stacks.values())
        self.classes = {k: i for i, k in enumerate(stacks)}
        self.need = np.zeros((3, max(256, 2 * len(stacks))))
        self.filled = np.zeros(self.need.shape[1], bool)
        for (tokens, loss), i in self.classes.items():
            self.need[:, i], self.filled[i] = np.array([tokens, 1, loss]) / self.most, True

    def add(self, piece: tuple) -> None:
        """piece: doc_id, start, ids, loss mask or None (all bear loss), tokens of the document."""
        ids, mask = piece[2], piece[3]
        key = (len(ids), len(ids) if mask is None else int(mask.sum()))
        if key not in self.classes and len(self.stacks) == self.need.shape[1]:
            self.reset({k: self.stacks[i] for k, i in self.classes.items() if self.stacks[i]})
        at = self.classes.setdefault(key, len(self.stacks))
        if at == len(self.stacks):
            self.stacks.append([])
            self.need[:, at] = np.array([key[0], 1, key[1]]) / self.most
        self.stacks[at].append(piece)
        self.filled[at] = True
        self.n, self.left = self.n + 1, self.left + len(ids)

    def take(self, room: np.ndarray) -> tuple[tuple, bool]:
        """A piece of the class of demand with the largest dot product among those that fit whole, else among all."""
        m = len(self.stacks)
        need, share = self.need[:, :m], room / self.most
        score = np.where(self.filled[:m], share @ need, -1)
        fits = self.filled[:m].copy()
        for row, most in zip(need, (share + 1e-12).tolist()):
            fits &= row <= most
        whole = bool(fits.any())
        at = int(np.where(fits, score, -1).argmax() if whole else score.argmax())
        piece = self.stacks[at].pop()
        self.filled[at] = bool(self.stacks[at])
        self.n, self.left = self.n - 1, self.left - len(piece[2])
        return piece, whole

    def emit(self, piece: tuple, offset: int) -> None:
        doc, start, ids, mask, total = piece
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), total, self.next, offset, len(ids) if mask is None else int(mask.sum())))

    def whole(self, piece: tuple) -> bool:
        """Puts a piece of a sequence's length alone into one, if the limits let it."""
        loss = len(piece[2]) if piece[3] is None else int(piece[3].sum())
        if loss > self.loss:
            return False
        self.emit(piece, 0)
        self.next += 1
        return True

    @staticmethod
    def cut(piece: tuple, tokens: int, loss: int) -> tuple[tuple | None, tuple]:
        doc, start, ids, mask, total = piece
        n = min(tokens, len(ids))
        if mask is None:
            n = min(n, loss)
        elif mask.sum() > loss:
            n = min(n, int(np.searchsorted(np.cumsum(mask), loss, "right")))
        if n <= 0:
            return None, piece
        rest = (doc, start + n, ids[n:], None if mask is None else mask[n:], total)
        return (doc, start, ids[:n], None if mask is None else mask[:n], total), rest

    def fill(self, size: int) -> None:
        """Closes one sequence of at most so many tokens."""
        room, offset = np.array([size, self.segments, self.loss], np.float64), 0
        while self.n and room[0] > 0 and room[1] > 0:
            piece, fits = self.take(room)
            if not fits:
                head, rest = self.cut(piece, int(room[0]), int(room[2]))
                if head is None:
                    self.add(piece)
                    break
                if len(rest[2]):
                    self.add(rest)
                piece = head
            self.emit(piece, offset)
            offset += len(piece[2])
            room -= [len(piece[2]), 1, len(piece[2]) if piece[3] is None else int(piece[3].sum())]
        self.next += offset > 0

    def close(self) -> None:
        while self.n:
            self.fill(self.tokens if self.left >= self.tokens else 1 << (self.left.bit_length() - 1))


def _pack(tokenizer: str, tokens: int, segments: int, loss: int, loss_from: bool):
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECE.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache.of(tokenizer)
        packer = Packer(tokens, segments, loss, TaskContext.get().partitionId() << 40)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.rows)) if packer.rows else [[]] * len(schema)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            at, n = 0, batch.num_rows
            while at < n:
                end, size = at, 0
                while end < n and (end == at or size < CHUNK):
                    size += len(batch.column(1)[end].as_buffer())
                    end += 1
                part = batch.slice(at, end - at)
                at = end
                free = part.column(2).to_pylist()
                for doc, skip, ids in zip(part.column(0).to_pylist(), free, cache.encode(part.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(END_ID))
                    mask = np.arange(len(ids)) >= skip if loss_from and skip else None
                    for start in range(0, len(ids), tokens):
                        piece = (doc, start, ids[start : start + tokens], None if mask is None else mask[start : start + tokens], len(ids))
                        if len(piece[2]) < tokens or not packer.whole(piece):
                            packer.add(piece)
                    while packer.n > POOL and packer.left >= tokens:
                        packer.fill(tokens)
                yield rows()
        packer.close()
        yield rows()

    return pack


def pack(docs: DataFrame, tokenizer: str, tokens: int = 2048, segments: int = 1024, loss: int | None = None, prompt_tokens: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    tokenizer: the file of a tokenizer, seen by every executor.  prompt_tokens names a
    column with the number of leading tokens of a row that bear no loss (instruction
    data); without it every token bears loss.  loss limits the loss-bearing tokens of
    a sequence, by default as many as tokens.
    """
    skip = F.coalesce(F.col(prompt_tokens).cast("long"), F.lit(0)) if prompt_tokens else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), skip.alias("skip"))
    return rows.mapInArrow(_pack(tokenizer, tokens, segments, tokens if loss is None else loss, prompt_tokens is not None), PIECE)
