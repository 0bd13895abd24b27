"""A recurrent block labeller: a bidirectional LSTM in numpy over a page's leaf blocks.

Each block is a vector of its tag path (hashed names of its ancestors and of their
classes), its hashed words, and a few figures, among them what part of the page's text
stands in the same element; the network reads the page's blocks from
both ends and gives each a probability of being main text. The weights beside this
module were trained by ``python -m foliospark.llm.train_labeller`` on generated pages.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

from foliospark.llm.html_blocks import Block, Path
from foliospark.llm.kernels import U64, Texts, Words

PATH, LEAF, WORDS, FIGURES = 192, 48, 96, 18
WIDTH = PATH + LEAF + WORDS + FIGURES
HIDDEN = 24
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "labeller.npz")
_PART = re.compile(r"[a-z]+")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_ENDS = re.compile(r"[.!?…。！？؟।]")
_COMMAS = re.compile(r"[,;:，、；：،]")
_DIGITS = re.compile(r"[0-9]")
_ASIDE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu"}
_MAIN = {"article", "main"}
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@lru_cache(maxsize=20_000)
def _name_dims(name: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Dimensions of an element's name: its tag, and the words of its classes."""
    tag, *words = name.split(".")
    dims = [zlib.crc32(f"t:{tag}".encode()) % PATH]
    for w in words:
        dims += [zlib.crc32(f"c:{p}".encode()) % PATH for p in _PART.findall(w)]
    return tuple(dims), (zlib.crc32(f"t:{tag}".encode()) % LEAF,)


def _path_dims(path: Path, seen: dict[Path, np.ndarray]) -> np.ndarray:
    """The dimensions of all names of a path; what an element shares with those below is kept."""
    todo, at = [], path
    while at is not None and at not in seen:
        todo.append(at)
        at = at.up
    have = seen[at] if at is not None else np.zeros(PATH, bool)
    for at in reversed(todo):
        dims = _name_dims(at.name)[0]
        if not have[list(dims)].all():
            have = have.copy()
            have[list(dims)] = True
        seen[at] = have
    return have


def _parts(path: Path | None, seen: dict[Path, tuple[bool, bool]]) -> tuple[bool, bool]:
    """Whether a path leads through an element beside the text, and through one for the text."""
    todo, at = [], path
    while at is not None and at not in seen:
        todo.append(at)
        at = at.up
    have = seen[at] if at is not None else (False, False)
    for at in reversed(todo):
        tag = at.name.split(".", 1)[0]
        have = (have[0] or tag in _ASIDE, have[1] or tag in _MAIN)
        seen[at] = have
    return have


def _shares(page: list[Block], weight: np.ndarray) -> np.ndarray:
    """For each block the part of the page's text that its parent, and the parent above, hold.

    The second pair counts blocks by themselves that are not links.
    """
    out = np.zeros((len(page), 4), np.float32)
    free = weight * np.array([2 * b.linked < len(b.text) for b in page])
    for k in (0, 1):
        held: dict[Path | None, list[float]] = {}
        at = [b.path.up if b.path is not None else None for b in page]
        if k:
            at = [p.up if p is not None else None for p in at]
        for p, w, u in zip(at, weight.tolist(), free.tolist(), strict=True):
            sums = held.setdefault(p, [0.0, 0.0])
            sums[0] += w
            sums[1] += u
        out[:, 2 * k : 2 * k + 2] = [held[p] for p in at]
    out[:, 0::2] /= max(float(weight.sum()), 1.0)
    out[:, 1::2] /= max(float(free.sum()), 1.0)
    return out


def features(pages: list[list[Block]]) -> np.ndarray:
    """A row for each block of all pages, in order."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), WIDTH), np.float32)
    if not flat:
        return out
    seen: dict[Path, np.ndarray] = {}
    for i, b in enumerate(flat):
        if b.path is not None:
            out[i, :PATH] = _path_dims(b.path, seen)
            out[i, PATH + _name_dims(b.path.name)[1][0]] = 1
    t = Texts(pa.array([b.text for b in flat]))
    w = Words(t, lower=True)
    n = w.counts()
    each = np.bincount(w.doc() * WORDS + (w.code % U64(WORDS)).astype(np.int64), minlength=len(flat) * WORDS).reshape(-1, WORDS)
    out[:, PATH + LEAF : PATH + LEAF + WORDS] = each / np.maximum(np.sqrt((each * each).sum(axis=1)), 1)[:, None]
    chars = np.array([len(b.text) for b in flat], np.float32)
    f = out[:, -FIGURES:]
    wide = np.array([len(_WIDE.findall(b.text)) for b in flat], np.float32)
    weight = chars + 2 * wide  # a letter of these scripts says about as much as three
    f[:, 0] = np.log1p(weight) / 6
    f[:, 1] = np.array([b.linked for b in flat], np.float32) / np.maximum(chars, 1)
    f[:, 2] = np.log1p(n) / 5
    f[:, 3] = [b.text[-1] in ".!?\"'…:;)。！？」”»؟" for b in flat]
    f[:, 4] = [b.hidden for b in flat]
    f[:, 5] = np.concatenate([np.arange(len(p)) / max(len(p), 1) for p in pages]) if pages else 0
    f[:, 6] = [min(len(b.path or ()), 12) / 12 for b in flat]
    f[:, 7] = 1
    f[:, 8] = np.log1p([len(_ENDS.findall(b.text)) for b in flat]) / 3
    f[:, 9] = 10 * np.array([len(_COMMAS.findall(b.text)) for b in flat]) / np.maximum(weight, 10)
    f[:, 10] = np.array([len(_DIGITS.findall(b.text)) for b in flat]) / chars
    parts: dict[Path, tuple[bool, bool]] = {}
    f[:, 11:13] = [_parts(b.path, parts) for b in flat]
    f[:, 13] = [b.path is not None and b.path.name.split(".", 1)[0] in _HEADS for b in flat]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    for p, a, z in zip(pages, edges, edges[1:], strict=False):
        if len(p):
            f[a:z, 14:18] = _shares(p, weight[a:z])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Labeller:
    """Weights: for each direction input, recurrent and bias; then the output layer."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    @staticmethod
    def fresh(seed: int = 0) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN))
            w[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            w[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        w["out"] = rng.normal(0, 0.2, (2 * HIDDEN, 1))
        w["bias"] = np.zeros(1)
        return Labeller(w)

    def scan(self, d: str, z: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, page, hidden) from input sums; backwards for direction b."""
        steps, pages, _ = z.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        for s in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[s] + h @ self.w[f"h{d}"]
            i, f, o = (sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[s][:, None]
            new = f * c + i * u
            t = np.tanh(new)
            if keep is not None:
                keep.append((s, h, c, i, f, o, u, t, m))
            c = np.where(m, new, c)
            h = np.where(m, o * t, h)
            out[s] = h * m
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Scores (time, page) of padded feature blocks (time, page, WIDTH)."""
        hs = [self.scan(d, x @ self.w[f"x{d}"] + self.w[f"c{d}"], mask) for d in "fb"]
        return (np.concatenate(hs, axis=2) @ self.w["out"])[:, :, 0] + self.w["bias"]

    def label(self, pages: list[list[Block]], at_once: int = 64, most: int = 20_000) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        x = features(pages)
        size = np.array([len(p) for p in pages], np.int64)
        off = np.concatenate([[0], np.cumsum(size)])
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [int(i) for i in np.argsort(size, kind="stable") if size[i]]
        k = 0
        while k < len(order):  # pages of like length together, padded blocks bounded
            take = order[k : k + at_once]
            while len(take) > 1 and len(take) * size[take[-1]] > most:
                take = take[: len(take) // 2]
            k += len(take)
            steps = int(size[take[-1]])
            padded = np.zeros((steps, len(take), WIDTH), np.float32)
            mask = np.zeros((steps, len(take)), bool)
            for j, i in enumerate(take):
                padded[: size[i], j] = x[off[i] : off[i + 1]]
                mask[: size[i], j] = True
            score = self.logits(padded, mask)
            for j, i in enumerate(take):
                out[i] = score[: size[i], j] > 0
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by back-propagation through time."""
        keeps: dict[str, list] = {"f": [], "b": []}
        hs = [self.scan(d, x @ self.w[f"x{d}"] + self.w[f"c{d}"], mask, keeps[d]) for d in "fb"]
        both = np.concatenate(hs, axis=2)
        score = (both @ self.w["out"])[:, :, 0] + self.w["bias"]
        p, n = sigmoid(score), max(mask.sum(), 1)
        loss = float((np.logaddexp(0, score) - y * score)[mask].sum() / n)
        e = np.where(mask, (p - y) / n, 0).astype(np.float32)
        grad = {"out": np.tensordot(both, e, ((0, 1), (0, 1)))[:, None], "bias": e.sum(keepdims=True)[0, :1]}
        down = e[:, :, None] * self.w["out"][:, 0]
        for k, d in enumerate("fb"):
            dh_out = down[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            gz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            dh, dc = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0])
            for s, h0, c0, i, f, o, u, t, m in reversed(keeps[d]):
                total = dh + dh_out[s] * m
                g_h, pass_h = np.where(m, total, 0), np.where(m, 0, total)
                g_c = np.where(m, dc + g_h * o * (1 - t * t), 0)
                z = np.concatenate([g_c * u * i * (1 - i), g_c * c0 * f * (1 - f), g_h * t * o * (1 - o), g_c * i * (1 - u * u)], axis=1)
                gz[s] = z
                gh += h0.T @ z
                dh = z @ self.w[f"h{d}"].T + pass_h
                dc = np.where(m, g_c * f, dc)
            grad[f"x{d}"] = np.tensordot(x, gz, ((0, 1), (0, 1)))
            grad[f"h{d}"], grad[f"c{d}"] = gh, gz.sum(axis=(0, 1))
        return loss, grad


@lru_cache(maxsize=1)
def trained() -> Labeller:
    """The trained labeller, read once by each worker."""
    with np.load(WEIGHTS) as z:
        return Labeller({k: z[k] for k in z.files})
