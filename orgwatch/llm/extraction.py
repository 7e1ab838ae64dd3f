"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks. A block's vector is made of its tag path and its words, both hashed, and of
a few sizes. A bidirectional LSTM in numpy reads the whole sequence, and each block is kept or not by what stands
before and after it too.

No page comes with labels, so the labeller is fitted on a bounded sample of pages (``sample``, a documented parameter)
with labels that their own markup gives (blocks under article or main, and not under navigation, footers and the
like), and on the same blocks laid out anew under other templates, where such tags are missing, renamed or nested, so
that it does not rest on one of them. Fitting is seeded; every page is labelled.

Defined cases: a null or empty page has an empty text; a page without any text too; pages are labelled one by one, so
repeats agree; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, Element, leaf_blocks

PATH, WORDS, SIZES = 96, 48, 8
WIDTH = PATH + WORDS + SIZES
HIDDEN = 24

#: Words of tags and attributes; fixed values.
MAIN = {"article", "main"}
ASIDE = {
    "nav", "footer", "aside", "form", "menu", "sidebar", "ad", "ads", "advert", "advertisement", "banner", "comment", "comments", "cookie", "notice",
    "breadcrumb", "breadcrumbs", "related", "share", "social", "promo", "sponsored", "newsletter", "header", "dialog", "popup",
}


@lru_cache(maxsize=200_000)
def _bucket(word: str, width: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % width


def _chain(at: Element | None, mark: str) -> list[Element]:
    """The elements from the outermost one without the mark down to ``at``."""
    chain: list[Element] = []
    while at and mark not in at.marks:
        chain.append(at)
        at = at.above
    return chain[::-1]


def _path_vector(at: Element | None) -> np.ndarray:
    """The hashed steps of a path; an element's sum is that of the one around it and its own."""
    for e in _chain(at, "sum"):
        v = e.above.marks["sum"].copy() if e.above else np.zeros(PATH, dtype=np.float32)
        v[_bucket(f"t {e.tag}", PATH)] += 1
        v[_bucket(f"p {e.above.tag if e.above else ''}>{e.tag}", PATH)] += 0.5
        for name in e.step.split(" ")[1:]:
            v[_bucket(f"n {name}", PATH)] += 1
        e.marks["sum"] = v
    if at is None:
        return np.zeros(PATH, dtype=np.float32)
    if "all" not in at.marks:
        v = at.marks["sum"].copy()
        v[_bucket(f"l {at.tag}", PATH)] += 1
        at.marks["all"] = np.minimum(v, 2)
    return at.marks["all"]


def vectors(blocks: list[Block]) -> np.ndarray:
    """A row for each block."""
    out = np.zeros((len(blocks), WIDTH), dtype=np.float32)
    for i, b in enumerate(blocks):
        out[i, :PATH] = _path_vector(b.at)
        words = b.text.lower().split(" ")
        counts = np.bincount([_bucket(w, WORDS) for w in words], minlength=WORDS)
        out[i, PATH : PATH + WORDS] = np.log1p(counts) / np.log1p(len(words)) * 0.5
        n, at = len(words), i / max(1, len(blocks) - 1)
        ends = sum(b.text.count(c) for c in ".!?")
        out[i, PATH + WORDS :] = (np.log1p(n) / 5, np.log1p(len(b.text)) / 7, b.linked, at, 1 - at, min(1.0, ends / n * 5), float(n < 4), float(b.at.depth if b.at else 0) / 8)
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output for each step, in numpy. Sequences come padded, with a mask."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def cell() -> tuple[np.ndarray, np.ndarray]:
            w = rng.normal(0, 1 / np.sqrt(WIDTH + HIDDEN), (WIDTH + HIDDEN, 4 * HIDDEN)).astype(np.float32)
            b = np.zeros(4 * HIDDEN, dtype=np.float32)
            b[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            return w, b

        (fw, fb), (bw, bb) = cell(), cell()
        self.p = {"fw": fw, "fb": fb, "bw": bw, "bb": bb, "ow": rng.normal(0, 0.1, 2 * HIDDEN).astype(np.float32), "ob": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states of one direction. A masked step carries the state on."""
        n, steps, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, steps, HIDDEN), np.float32)
        xw = x @ w[:WIDTH] + b
        for t in range(steps):
            z = xw[:, t] + h @ w[WIDTH:]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = mask[:, t, None]
            if keep is not None:
                keep.append((h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, t] = h
        return out

    def _back(self, x: np.ndarray, dout: np.ndarray, w: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        n, steps, _ = x.shape
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        dz_all = np.zeros((n, steps, 4 * HIDDEN), np.float32)
        dwh = np.zeros((HIDDEN, 4 * HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h0, c0, i, f, o, g, tc, m = kept[t]
            total = dh + dout[:, t]
            dhm, dcm = total * m, dc * m
            dct = dcm + dhm * o * (1 - tc * tc)
            dz = np.concatenate((dct * g * i * (1 - i), dct * c0 * f * (1 - f), dhm * tc * o * (1 - o), dct * i * (1 - g * g)), axis=1)
            dz_all[:, t] = dz
            dwh += h0.T @ dz
            dh = dz @ w[WIDTH:].T + total * (1 - m)
            dc = dct * f + dc * (1 - m)
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        return np.concatenate((x.reshape(-1, WIDTH).T @ flat, dwh)), flat.sum(axis=0)

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        fwd = self._run(x, mask, self.p["fw"], self.p["fb"], None)
        bwd = self._run(x[:, ::-1], mask[:, ::-1], self.p["bw"], self.p["bb"], None)[:, ::-1]
        return 1 / (1 + np.exp(-(np.concatenate((fwd, bwd), axis=2) @ self.p["ow"] + self.p["ob"][0])))

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int, batch: int, rate: float, seed: int) -> None:
        """Adam on the mean log loss of all steps."""
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][1]) + rng.random() * 8)
            batches = [order[k : k + batch] for k in range(0, len(order), batch)]
            rng.shuffle(batches)
            for ids in batches:
                x, mask = padded([sequences[i][0] for i in ids])
                y = np.zeros(mask.shape, np.float32)
                for r, i in enumerate(ids):
                    y[r, : len(sequences[i][1])] = sequences[i][1]
                kf: list = []
                kb: list = []
                fwd = self._run(x, mask, self.p["fw"], self.p["fb"], kf)
                back = x[:, ::-1]
                bwd = self._run(back, mask[:, ::-1], self.p["bw"], self.p["bb"], kb)[:, ::-1]
                both = np.concatenate((fwd, bwd), axis=2)
                p = 1 / (1 + np.exp(-(both @ self.p["ow"] + self.p["ob"][0])))
                d = (p - y) * mask / max(1.0, mask.sum())
                dboth = d[:, :, None] * self.p["ow"]
                grads = {"ow": np.einsum("nt,nth->h", d, both), "ob": np.array([d.sum()], np.float32)}
                grads["fw"], grads["fb"] = self._back(x, dboth[:, :, :HIDDEN], self.p["fw"], kf)
                grads["bw"], grads["bb"] = self._back(back, dboth[:, ::-1, HIDDEN:], self.p["bw"], kb)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-9))
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((len(rows), steps, WIDTH), np.float32), np.zeros((len(rows), steps), np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
        mask[i, : len(r)] = 1
    return x, mask


def markup_label(b: Block) -> bool | None:
    """What the markup itself says of a block; None where it says nothing."""
    for e in _chain(b.at, "label"):
        found = e.above.marks["label"] if e.above else None
        words = set(e.step.split(" "))
        if found is not False:
            if words & MAIN and not words & ASIDE:
                found = True
            elif words & ASIDE and not (found and words == {"header"}):
                found = False
        e.marks["label"] = found
    return b.at.marks["label"] if b.at else None


def _relaid(good: list[str], filler: list[str], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The main blocks of a page in a new template, with boilerplate made of ``filler`` words; (blocks, labels)."""

    def some(low: int, high: int, *said: str) -> str:
        words = list(rng.choice(filler, int(rng.integers(low, high + 1))))
        if said and rng.random() < 0.6:
            words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(said)))
        text = " ".join(words)
        return text[:1].upper() + text[1:] + ("." if rng.random() < 0.5 else "")

    def pick(*items):
        return items[int(rng.integers(0, len(items)))]

    blocks: list[Block] = []
    labels: list[int] = []

    def put(text: str, path: tuple[str, ...], label: int, linked: float = 0.0) -> None:
        blocks.append(Block(text, Element.of(path), linked))
        labels.append(label)

    root = pick((), ("html", "body"), ("html", "body", "div page"), ("html", "body", "div wrapper", "div"))
    shell = root + pick((), ("div container",), ("div row",), ("table", "tr", "td"))
    main = pick(("article",), ("main",), ("main", "article"), ("div content",), ("div post body",), ("section", "div story"), ("div entry content",), ("div",), ("div main", "div text"), ("main", "section"), ("article post", "div body"))
    holder = shell + main

    def menu(base: tuple[str, ...]) -> None:
        path = base + pick(("nav", "ul", "li"), ("div menu", "ul", "li"), ("header", "nav", "ul", "li"), ("ul nav", "li"), ("nav",), ("div breadcrumbs",), ("header", "div"))
        for _ in range(int(rng.integers(1, 9))):
            put(some(1, 3), path, 0, pick(1.0, 1.0, 0.0))

    def advert(base: tuple[str, ...]) -> None:
        put(some(3, 14, "sponsored", "advertisement", "buy"), base + pick(("div ad",), ("div advert",), ("aside ad", "p"), ("div banner", "p"), ("div sponsored",), ("aside", "div promo")), 0, pick(0.0, 0.0, 1.0))

    def notice(base: tuple[str, ...]) -> None:
        put(some(5, 20, "cookies", "cookie", "privacy"), base + pick(("div cookie notice",), ("div notice", "p"), ("div cookie banner", "p"), ("div popup", "div"), ("dialog", "p")), 0)

    def form(base: tuple[str, ...]) -> None:
        path = base + pick(("form",), ("form search", "div"), ("div newsletter", "form", "p"), ("form", "button"))
        for _ in range(int(rng.integers(1, 4))):
            put(some(1, 6, "subscribe", "search", "e-mail"), path, 0)

    def sidebar(base: tuple[str, ...]) -> None:
        path = base + pick(("aside", "ul", "li"), ("div sidebar", "p"), ("aside sidebar", "div"), ("div related", "ul", "li"), ("section related", "h3"))
        for _ in range(int(rng.integers(1, 6))):
            put(some(2, 14, "related", "popular"), path, 0, pick(0.0, 1.0))

    def comments(base: tuple[str, ...]) -> None:
        top = base + pick(("div comments",), ("section comments",), ("div comments", "article comment"), ("ul comments", "li comment"), ("section", "div comment"))
        if rng.random() < 0.5:
            put(some(1, 2, "comments"), top + (pick("h2", "h3"),), 0)
        for _ in range(int(rng.integers(1, 6))):
            put(some(4, 50), top + pick(("p",), ("div", "p"), ()), 0)

    def footer(base: tuple[str, ...]) -> None:
        put(pick("© ", "", "Copyright ") + some(2, 20), base + pick(("footer",), ("footer", "p"), ("div footer",), ("footer", "div"), ("div footer", "ul", "li")), 0, pick(0.0, 0.0, 1.0))

    def header(base: tuple[str, ...]) -> None:
        put(some(1, 8), base + pick(("header", "h2"), ("header", "p"), ("div header",), ("header", "div logo"), ("header site", "h1")), 0)

    before = [menu, header, notice, advert, form, sidebar]
    for k in rng.permutation(len(before))[: int(rng.integers(0, 5))]:
        before[k](root)
    many = len(good)
    middle = int(rng.integers(0, many)) if many > 1 and rng.random() < 0.3 else -1
    headed = rng.random() < 0.3
    for i, text in enumerate(good):
        tag = pick("h1", "h2") if i == 0 else pick("p", "p", "p", "p", "p", "h2", "li", "blockquote", "div", "pre") if rng.random() < 0.4 else "p"
        path = holder + (("header",) if headed and i == 0 else ()) + (("ul", "li") if tag == "li" else (tag,))
        put(text, path, 1, pick(0.0, 0.0, 0.0, 0.3))
        if i == middle:
            pick(advert, sidebar, form, notice)(holder)
    after = [footer, comments, sidebar, advert, form, notice, menu]
    for k in rng.permutation(len(after))[: int(rng.integers(0, 6))]:
        after[k](pick(root, shell, holder) if after[k] is not footer else root)
    return blocks, labels


def training_sequences(pages: list[str], variants: int = 3, longest: int = 96, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labelled sequences from sample pages: as they are, where their markup labels some block as main, and laid out anew.

    A sequence for fitting is cut at ``longest`` blocks; for labelling nothing is cut.
    """
    rng = np.random.default_rng(seed)
    found = [leaf_blocks(p) for p in pages]
    out = []
    for blocks in found:
        marks = [markup_label(b) for b in blocks]
        if True not in marks:
            continue
        labels = np.array([m is True for m in marks], np.float32)
        out.append((vectors(blocks)[:longest], labels[:longest]))
        good = [b.text for b, m in zip(blocks, marks) if m]
        filler = sorted({w for b in blocks for w in b.text.split(" ") if len(w) < 20})
        for _ in range(variants):
            cut = int(rng.integers(1, min(len(good), 24) + 1)) if rng.random() < 0.5 else min(len(good), 40)
            again, marked = _relaid(good[:cut], filler, rng)
            out.append((vectors(again)[:longest], np.array(marked, np.float32)[:longest]))
    return out


def fit_labeller(pages: DataFrame, html: str = "html", sample: int = 250, longest_page: int = 60_000, epochs: int = 10) -> Labeller:
    """Fit on at most about ``sample`` pages of at most ``longest_page`` characters, drawn by the hash of their content."""
    rows = pages.select(F.col(html).alias("html"))
    n = max(1, rows.count())
    draw = F.pmod(F.xxhash64("html"), F.lit(1 << 40))
    drawn = rows.where((draw / F.lit(float(1 << 40)) < min(1.0, sample / n)) & (F.length("html") <= longest_page)).distinct()
    texts = sorted(r["html"] for r in drawn.orderBy(draw, "html").limit(2 * sample).collect())
    model = Labeller()
    sequences = training_sequences(texts)
    if sequences:
        model.fit(sequences, epochs=epochs, batch=32, rate=0.01, seed=5)
    return model


def main_texts(pages: list[str | None], model: Labeller, block: int = 128, steps: int = 20_000, threshold: float = 0.5) -> list[str]:
    """The main text of each page: its kept blocks, a line each. Pages go through the labeller in groups of at most
    ``block`` pages and ``steps`` padded steps (one page alone may have more)."""
    found = [leaf_blocks(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        size = 1
        # The next page would be the longest of the group, which all are padded to.
        while size < block and at + size < len(order) and (size + 1) * len(found[order[at + size]]) <= steps:
            size += 1
        ids = order[at : at + size]
        x, mask = padded([vectors(found[i]) for i in ids])
        p = model.probabilities(x, mask)
        for r, i in enumerate(ids):
            out[i] = "\n".join(b.text for b, q in zip(found[i], p[r]) if q >= threshold)
        at += size
    return out


def extract(pages: DataFrame, model: Labeller, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with the main ``text`` and its length ``n_chars``."""
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some tens of thousand numbers

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(main_texts(list(batch), shared.value))

    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    return pages.withColumn("text", texts(F.col(html))).select(*rest, "text", F.length("text").cast("long").alias("n_chars"))
