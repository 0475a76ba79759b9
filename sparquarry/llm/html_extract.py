"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks in page order.  Each block is a vector: hashed tags,
classes and ids of its path, hashed words of its whole text, and a few measures.
Only names and words that several training pages have count (cookie, sidebar, reply);
names that a site makes up and the words of its prose say nothing.
A bidirectional LSTM, plain numpy, reads the sequence of all blocks of the page and
labels every block; blocks labelled as article are joined.  Pages are labelled
where they are read, many of them side by side, so nothing is shuffled.

The model is trained from pages that a seeded generator makes in many layouts and
made-up languages with known labels (TRAIN_PAGES of them); no page and no word of the
input is used for training.  The weights that running this module writes are kept
beside it.

Defined results: a null or empty page has an empty text; markup may be broken or
cut off; rows that repeat are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64
from .html_blocks import Block, blocks
from .words import LOWER, prefix_hash, slice_hash, words

LABELS = ("article", "menu", "header", "footer", "sidebar", "notice", "advert", "form", "comment", "title")
PATH, WORDS, MEASURES = 128, 48, 8
WIDTH = PATH + WORDS + MEASURES
HIDDEN, TRAIN_PAGES, EPOCHS, SEED = 24, 2500, 12, 7
#: Training pages that must have a name or word for it to count.
PAGES_OF_NAME, PAGES_OF_WORD = 12, 60
#: Pages labelled side by side; steps times pages at most at once.
SIDE, STEPS = 128, 1 << 15


def _slot(word: str, size: int) -> tuple[int, float]:
    h = 1469598103934665603
    for c in word.encode():
        h = ((h ^ c) * 1099511628211) & (2**64 - 1)
    h = int(mix64(np.array([h], np.uint64))[0])
    return h % size, 1.0 if h >> 63 else -1.0


@functools.lru_cache(4096)
def path_vector(path: tuple[str, ...], known: frozenset) -> np.ndarray:
    """Hashed words of the path that are known; the innermost element counts in slots of its own as well."""
    out = np.zeros(PATH, np.float32)
    for depth, element in enumerate(path):
        for word in element.split():
            if word not in known:
                continue
            at, sign = _slot(word, PATH)
            out[at] += sign
            if depth == len(path) - 1:
                at, sign = _slot("leaf " + word, PATH)
                out[at] += sign
    return np.clip(out, -2, 2)


class Known:
    """Names of paths and words of texts that count."""

    def __init__(self, names=(), words=()):
        self.names, self.words = frozenset(names), sorted(words)
        raw = [w.encode() for w in self.words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([0, *map(len, raw)])
        self.hashes = np.sort(slice_hash(prefix_hash(data), ends[:-1], ends[1:]))

    def says(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h


def vectors(found: list[Block], known: Known) -> np.ndarray:
    """One row of WIDTH per block."""
    out = np.zeros((len(found), WIDTH), np.float32)
    if not found:
        return out
    texts = [b.text.encode() for b in found]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, of = words(data, offsets)
    h = slice_hash(prefix_hash(LOWER[data]), starts, ends)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0) * known.says(h)
    bag = np.bincount(of * WORDS + (h % np.uint64(WORDS)).astype(np.int64), sign, len(found) * WORDS).reshape(-1, WORDS)
    per = np.bincount(of, minlength=len(found))
    out[:, PATH : PATH + WORDS] = 2 * bag / np.maximum(per, 1)[:, None]
    stops = np.bincount(of, np.isin(data[ends - 1], list(b".!?")), len(found))
    commas = np.bincount(of, np.isin(data[ends - 1], list(b",;:")), len(found))
    linked = np.array([b.linked for b in found])
    depth = np.array([sum(not e.startswith(("html", "body")) for e in b.path) for b in found])
    place = np.arange(len(found)) / max(1, len(found) - 1)
    out[:, -MEASURES:] = np.column_stack([np.log1p(np.minimum(per, 100)) / 3, np.minimum(stops, 10) / 5, stops / np.maximum(per, 1), commas / np.maximum(per, 1), linked, depth / 8, place, np.clip(np.diff(offsets) / np.maximum(per, 1) / 10, 0.4, 5)])
    for i, b in enumerate(found):
        out[i, :PATH] = path_vector(b.path, known.names)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction.  w: (inputs + hidden + 1, 4 * hidden); gates are in, forget, out, cell."""

    def __init__(self, w: np.ndarray):
        self.w = w
        self.hidden = w.shape[1] // 4

    @classmethod
    def start(cls, rng: np.random.Generator, inputs: int, hidden: int) -> Lstm:
        w = rng.normal(0, 1 / np.sqrt(inputs / 4 + hidden), (inputs + hidden + 1, 4 * hidden)).astype(np.float32)
        w[-1] = 0
        w[-1, hidden : 2 * hidden] = 1
        return cls(w)

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: (steps, pages, inputs); mask: (steps, pages), 0 where a page has ended (its state stays)."""
        steps, pages, inputs = x.shape
        n = self.hidden
        ahead = x.reshape(-1, inputs) @ self.w[:inputs] + self.w[-1]
        ahead = ahead.reshape(steps, pages, 4 * n)
        h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
        out, saved = np.zeros((steps, pages, n), np.float32), []
        for t in range(steps):
            z = ahead[t] + h @ self.w[inputs:-1]
            gates, g = sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            new = f * c + i * g
            tanh = np.tanh(new)
            on = mask[t][:, None]
            if keep:
                saved.append((h, c, i, f, o, g, tanh))
            h, c = np.where(on, o * tanh, h), np.where(on, new, c)
            out[t] = h
        return out, saved

    def backward(self, x: np.ndarray, mask: np.ndarray, saved: list, grad_out: np.ndarray) -> np.ndarray:
        """The gradient of w, given that of the outputs."""
        steps, pages, inputs = x.shape
        n = self.hidden
        dw = np.zeros_like(self.w)
        dh, dc = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
        dz_all = np.zeros((steps, pages, 4 * n), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tanh = saved[t]
            on = mask[t][:, None]
            dh = dh + grad_out[t]
            dnew = on * (dc + dh * o * (1 - tanh**2))
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), on * dh * tanh * o * (1 - o), dnew * i * (1 - g**2)], 1)
            dw[inputs:-1] += h.T @ dz
            dz_all[t] = dz
            dh = np.where(on, dz @ self.w[inputs:-1].T, dh)
            dc = np.where(on, dnew * f, dc)
        flat = dz_all.reshape(-1, 4 * n)
        dw[:inputs] = x.reshape(-1, inputs).T @ flat
        dw[-1] = flat.sum(0)
        return dw


def _pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, pages, width) in page order and from the end, and the mask of both."""
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), WIDTH), np.float32)
    back, mask = np.zeros_like(x), np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], back[: len(p), j], mask[: len(p), j] = p, p[::-1], True
    return x, back, mask


class Labeller:
    def __init__(self, ahead: np.ndarray, back: np.ndarray, out: np.ndarray, known: Known | None = None):
        self.ahead, self.back, self.out, self.known = Lstm(ahead), Lstm(back), out, known or Known()

    def _states(self, pages: list[np.ndarray], keep: bool = False):
        x, xb, mask = _pad(pages)
        h, sa = self.ahead.forward(x, mask, keep)
        hb, sb = self.back.forward(xb, mask, keep)
        return x, xb, mask, h, sa, hb, sb

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page the number of the label of each of its blocks."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        while order:
            most = max(1, min(SIDE, STEPS // len(pages[order[-1]])))
            some, order = order[-most:], order[:-most]
            _, _, _, h, _, hb, _ = self._states([pages[i] for i in some])
            for j, i in enumerate(some):
                n = len(pages[i])
                both = np.concatenate([h[:n, j], hb[:n, j][::-1]], 1)
                out[i] = (both @ self.out[:-1] + self.out[-1]).argmax(1)
        return out

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
        x, xb, mask, h, sa, hb, sb = self._states(pages, True)
        n, total = h.shape[2], mask.sum()
        gh, ghb, gout, loss = np.zeros_like(h), np.zeros_like(hb), np.zeros_like(self.out), 0.0
        for j, y in enumerate(labels):
            m = len(y)
            both = np.concatenate([h[:m, j], hb[:m, j][::-1]], 1)
            z = both @ self.out[:-1] + self.out[-1]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            loss -= float(np.log(p[np.arange(m), y] + 1e-9).sum())
            p[np.arange(m), y] -= 1
            p /= total
            gout[:-1] += both.T @ p
            gout[-1] += p.sum(0)
            g = p @ self.out[:-1].T
            gh[:m, j], ghb[:m, j] = g[:, :n], g[::-1, n:]
        return loss / total, [self.ahead.backward(x, mask, sa, gh), self.back.backward(xb, mask, sb, ghb), gout]

    @classmethod
    def train(cls, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = SEED) -> Labeller:
        rng = np.random.default_rng(seed)
        out = rng.normal(0, 0.1, (2 * hidden + 1, len(LABELS))).astype(np.float32)
        model = cls(Lstm.start(rng, WIDTH, hidden).w, Lstm.start(rng, WIDTH, hidden).w, out)
        weights = [model.ahead.w, model.back.w, model.out]
        first, second, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        n_batches = -(-len(pages) // 32)
        for epoch in range(epochs):
            # pages of like length together, batches in random order
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i]) + rng.random() * 4))
            for b in rng.permutation(n_batches):
                some = order[b * 32 : b * 32 + 32]
                _, grads = model.gradients([pages[i] for i in some], [labels[i] for i in some])
                t += 1
                rate = 0.012 * min(1, t / 20) * (1 - 0.9 * t / (epochs * n_batches))
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
                for w, g, a, v in zip(weights, grads, first, second):
                    g = g * min(1, 1 / (norm + 1e-9))
                    a += 0.1 * (g - a)
                    v += 0.01 * (g**2 - v)
                    w -= rate * (a / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        return model


#: The trained weights; python -m sparquarry.llm.html_extract makes them anew.
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "html_weights.npz")


@functools.lru_cache(1)
def trained() -> Labeller:
    """The model of the weights' file; trained where there is none."""
    if not os.path.exists(WEIGHTS):
        return train_anew()
    with np.load(WEIGHTS) as stored:
        return Labeller(stored["ahead"].astype(np.float32), stored["back"].astype(np.float32), stored["out"].astype(np.float32), Known(str(stored["names"]).split(), str(stored["words"]).split()))


def train_anew() -> Labeller:
    """The model trained from generated pages."""
    from .html_pages import generate, unmark

    pages, labels, has, says = [], [], Counter(), Counter()
    for page in generate(TRAIN_PAGES, SEED):
        found, y = [], []
        for b in blocks(page):
            label, text = unmark(b.text)
            y.append(label)
            found.append(Block(text, b.path, b.linked))
        pages.append(found)
        labels.append(np.array(y, np.int64))
        has.update({word for b in found for element in b.path for word in element.split()})
        says.update({word.lower() for b in found for word in b.text.split() if word.isascii()})
    known = Known([name for name, n in has.items() if n >= PAGES_OF_NAME and name not in ("html", "body")], [word for word, n in says.items() if n >= PAGES_OF_WORD])
    some = [i for i, found in enumerate(pages) if found]
    model = Labeller.train([vectors(pages[i], known) for i in some], [labels[i] for i in some])
    model.known = known
    return model


def article(page: str | None, model: Labeller | None = None) -> str:
    """The main text of one page."""
    return articles([page or ""], model or trained())[0]


def articles(pages: list[str], model: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    flat = vectors([b for page in found for b in page], model.known)
    ends = np.cumsum([0, *map(len, found)])
    rows = []
    for page, a, b in zip(found, ends, ends[1:]):
        x = flat[a:b].copy()
        if b - a > 1:  # the place within the page, not within the batch
            x[:, WIDTH - MEASURES + 6] = np.arange(b - a) / (b - a - 1)
        else:
            x[:, WIDTH - MEASURES + 6] = 0
        rows.append(x)
    return ["\n\n".join(b.text for b, y in zip(page, labels) if y == 0) for page, labels in zip(found, model.label(rows))]


def _extract(weights: tuple):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(*weights)
        for batch in batches:
            n, at, size, texts = batch.num_rows, 0, 0, []
            pages: list[str] = []
            for i in range(n):
                pages.append(batch.column("html")[i].as_py())
                size += len(pages[-1])
                if size > 4 << 20 or i == n - 1:
                    texts += articles(pages, model)
                    pages, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return extract


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    model = trained()
    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(_extract((model.ahead.w, model.back.w, model.out, model.known)), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


if __name__ == "__main__":
    m = train_anew()
    np.savez_compressed(WEIGHTS, ahead=m.ahead.w.astype(np.float16), back=m.back.w.astype(np.float16), out=m.out.astype(np.float16), names=" ".join(sorted(m.known.names)), words=" ".join(m.known.words))
