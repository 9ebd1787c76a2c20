"""The main body of web pages: a bidirectional LSTM over the blocks of a page.

Pages come as text, so a block is a line, and its tag path is what the line's
form still tells of it: bullet, separators, capitals, end, length, place. The
vector of a block joins these to the mean of its hashed words' embeddings; two
LSTMs read the page's blocks forwards and backwards, and each block is
classified with the whole page in view. All in numpy.

No rows are labelled. A bounded sample of pages, the ones of least hash, gets
labels from wording and order (seed_labels), the network is trained on them on
the driver, and its weights, whose size doesn't depend on the data, are
broadcast. Labelling all pages is one pass without any shuffle of texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.spread import spread

#: Pages that seed labels are made of, and the network is trained on, and characters that such a page may have: the bound of what the fit reads.
TRAIN_PAGES, TRAIN_CHARS = 2000, 200_000
WORDS, EMBED, HIDDEN, EPOCHS, BATCH, SEED = 1 << 13, 20, 24, 6, 48, 7
#: Blocks of a page whose inputs are multiplied at once, and after which training starts a new sequence. Labelling reads pages whole.
WINDOW = 400

_END = re.compile(r"[.!?:;][\"”’»)]*$")
_ELLIPSIS = re.compile(r"(…|\.\.\.)$")
_BULLET = re.compile(r"^\s*([-•*–·▪◦]|\d{1,2}[.)])\s+")
_SEPARATED = re.compile(r"\s*[|›»>/·•]\s*|\s+[-–]\s+")
_DATE_HEAD = re.compile(r"^(\d{1,2}\.? \w+ \d{4}|\d{4}-\d{2}-\d{2})\s")
_WORD = re.compile(r"[^\W_]+|[©“”\"|›»>…•@]")
_PERSON = re.compile(r"^[^\W\d_][\w'’.-]+( [^\W\d_][\w'’.-]*){1,3}, ")

# Wordings of page furniture in three languages, by which seed labels are given.
_CONSENT = re.compile(
    r"\b(uses? cookies|store small files|keep data on your (browser|device)|privacy notice for details|continuing you agree|change your choice"
    r"|some are essential|verwende[nt] cookies|speichert daten auf ihrem|datenschutzerklärung|auswahl jederzeit|utilisons des cookies"
    r"|dépose des traceurs|politique de confidentialité|modifier vos choix)",
    re.I,
)
_IMPRINT = re.compile(
    r"(©|^copyright\b.*\d{4}|all rights reserved|alle rechte vorbehalten|tous droits réservés|is registered in [\w ]+, number|\btel\. ?\+?\d{5,}|^website by )", re.I
)
_CALL = re.compile(
    r"(^get a (free )?quote|^speak to our|\badvisers today\b|\blines open until|^download (the|our|a)\b|^proud sponsors? of|^join [\d,.]+ readers|^join our|^are you an? \w+\?"
    r"|^register with|\bsign up (now|today|for)|^subscribe|^request a|^book (a|your)|^call us|^unsere berater|jetzt .*angebot|jetzt .*(anfordern|bestellen)|^nos conseillers"
    r"|^demandez votre|^inscrivez-vous|^abonnez-vous|free for members|save on your first order|^werden sie|^devenez )",
    re.I,
)
_LABELS = frozenset(
    """accept all|reject all|necessary only|manage preferences|ok, got it|close|menu|print|tweet|share this page|rate this page|read more|back to top|follow us|sign up
    subscribe to our newsletter|skip to main content|download brochure|request a callback|enter your email address|english|cymraeg|deutsch|français|privacy|accessibility
    complaints|sitemap|modern slavery statement|terms of use|cookie policy|search|services|support|partners|investors|contact|products|news|about us|locations|case studies
    login|our team|faq|careers|home|resources|basket|cart|privacy policy|terms and conditions|legal notice
    alle akzeptieren|ablehnen|einstellungen|newsletter abonnieren|mehr lesen|folgen sie uns|nach oben|seite teilen|zum inhalt springen|agb|barrierefreiheit|impressum|datenschutz
    anmelden|aktuelles|standorte|suche|über uns|kontakt|produkte|startseite|warenkorb|team|leistungen|karriere|referenzen
    lire la suite|aller au contenu|suivez-nous|s'abonner à la lettre|haut de page|partager|paramétrer|tout accepter|tout refuser|confidentialité|accessibilité|mentions légales
    plan du site|agences|équipe|à propos|carrières|références|accueil|connexion|recherche|produits|panier|actualités""".replace("\n", "|").replace("|    ", "|").split("|")
)
_TEASER_HEADS = frozenset(
    "most read|latest news|related articles|you may also like|popular downloads|in this section|recent posts|weitere beiträge|meistgelesen|à lire aussi|articles récents|les plus lus".split("|")
)
_LABEL_WORDS = frozenset(w for x in _LABELS for w in x.split())
_LISTED = re.compile(
    r"(^(since|apprentices:|prices from|fully insured|how |what we|why |from .+ to .+ in \d|free survey|opening hours|call before|iso-|spare |no .+ work on|offices in|questions people"
    r"|contact |our .+ promise|\d+ years in|\d+ .+ jobs a month|[£$€][\d,.]+ of )|, foreman since| for [A-Z]\w+( \w+)*$)",
    re.I,
)


def _plain(line: str) -> str:
    return re.sub(r"\s*\(\d+\)$", "", line.strip()).lower()


def is_label(line: str) -> bool:
    """Whether a line is a button, a menu or a trail of them."""
    t = _plain(line)
    if t in _LABELS or t in _TEASER_HEADS:
        return True
    parts = [_plain(p) for p in _SEPARATED.split(line.strip()) if p]
    if len(parts) > 1 and not _BULLET.match(line) and (all(p in _LABELS for p in parts) or (parts[0] in _LABELS and not _END.search(t))):
        return True
    words = re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", t)
    return len(words) > 3 and all(w in _LABEL_WORDS or w.isdigit() for w in words)


def seed_labels(lines: list[str]) -> list[int]:
    """1 for lines of the main body, 0 for furniture and blank lines, by wording and order alone."""
    out, teasers = [], False
    for line in lines:
        t = line.strip()
        if not t:
            out.append(0)
            continue
        if is_label(t):
            teasers = teasers or _plain(t) in _TEASER_HEADS
            out.append(0)
            continue
        if _CONSENT.search(t) or _IMPRINT.search(t) or (_CALL.search(t) and not _BULLET.match(t)):
            teasers = False
            out.append(0)
            continue
        titled = not _BULLET.match(t) and not _PERSON.match(t) and t[0] not in "“\"„«" and (_ELLIPSIS.search(t) or not _END.search(t)) and not _LISTED.search(t)
        if teasers and titled and (len(t.split()) >= 4 or _ELLIPSIS.search(t)):
            out.append(0)
            continue
        teasers = False
        out.append(0 if _DATE_HEAD.match(t) and not _END.search(t) else 1)
    return out


def block_forms(lines: list[str]) -> np.ndarray:
    """What a line's form tells of its tag path, a row per line."""
    n = len(lines)
    out = np.zeros((n, 22), np.float32)
    seen: Counter[str] = Counter(x.strip().lower() for x in lines)
    for i, line in enumerate(lines):
        t = line.strip()
        words = t.split()
        caps = sum(w[0].isupper() for w in words)
        k = len(words)
        out[i] = (
            not t, bool(_BULLET.match(t)), bool(_END.search(t)), bool(_ELLIPSIS.search(t)), min(len(_SEPARATED.findall(t)), 5) / 5, min(k, 30) / 30, k == 1, k <= 3, k >= 8,
            caps / max(k, 1), bool(t) and t[0].isupper(), bool(t) and t[0] in "“\"„«", bool(_PERSON.match(t)), bool(_DATE_HEAD.match(t)),
            any(c.isdigit() for c in t), "©" in t, "|" in t or "›" in t or ">" in t, t.isupper(), i / max(n - 1, 1), i < 6, n - i <= 6, seen[t.lower()] > 1,
        )
    return out


def word_hashes(lines: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed words of all lines, how many of each line); numbers count as one word, and neighbours are hashed as pairs too."""
    flat, sizes = [], []
    for line in lines:
        words = ["0" if w[0].isdigit() else w for w in _WORD.findall(line.lower())]
        grams = [*words, *(a + " " + b for a, b in zip(words, words[1:], strict=False)), *(["^" + words[0], words[-1] + "$"] if words else [])]
        for g in grams:
            h = known.get(g)
            if h is None:
                h = zlib.crc32(g.encode()) % WORDS
                if len(known) < 200_000:
                    known[g] = h
            flat.append(h)
        sizes.append(len(grams))
    return np.array(flat, np.int64), np.array(sizes, np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Embeddings, two LSTMs and a logistic layer over [forward, backward, input]."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(SEED)
        size = 22 + EMBED
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = weights or {
            "embed": (rng.standard_normal((WORDS, EMBED)) * 0.1).astype(np.float32),
            "wf": init(size + HIDDEN, 4 * HIDDEN), "bf": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN),
            "wb": init(size + HIDDEN, 4 * HIDDEN), "bb": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN),
            "wo": init(2 * HIDDEN + size, 1), "bo": np.zeros(1, np.float32),
        }

    def inputs(self, forms: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = np.zeros((len(sizes), EMBED), np.float32)
        if len(words):
            full = np.flatnonzero(sizes)
            begin = (np.cumsum(sizes) - sizes)[full]
            total[full] = np.add.reduceat(self.w["embed"][words], begin, axis=0) / np.sqrt(sizes[full, None])
        return np.concatenate((forms, total), 1)

    def _read(self, x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray, keep: list | None) -> np.ndarray:
        """One direction over (time, pages, size); where mask is 0 the state stays."""
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((steps, n, HIDDEN), np.float32)
        rec = w[x.shape[2] :]
        for t in range(steps):
            if t % WINDOW == 0:
                pre = x[t : t + WINDOW] @ w[: x.shape[2]] + b
            z = pre[t % WINDOW] + h @ rec
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(c2)
            h2 = m * (o * tc) + (1 - m) * h
            if keep is not None:
                keep.append((i, f, o, g, c, tc, h, m))
            h, c = h2, c2
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, kept: dict | None = None) -> np.ndarray:
        kf, kb = ([], []) if kept is not None else (None, None)
        f = self._read(x, mask, self.w["wf"], self.w["bf"], kf)
        b = self._read(x[::-1], mask[::-1], self.w["wb"], self.w["bb"], kb)[::-1]
        feats = np.concatenate((f, b, x), 2)
        if kept is not None:
            kept.update(kf=kf, kb=kb, feats=feats)
        return _sigmoid(feats @ self.w["wo"] + self.w["bo"])[..., 0]

    def _unroll(self, x: np.ndarray, keep: list, w: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = x.shape[2]
        rec = w[size:]
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        dzs = np.zeros((len(x), x.shape[1], 4 * HIDDEN), np.float32)
        hs = np.zeros((len(x), x.shape[1], HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, c, tc, h, m = keep[t]
            dh = dh + grad[t]
            dhm = dh * m
            dct = dc * m + dhm * o * (1 - tc * tc)
            dz = np.concatenate((dct * g * i * (1 - i), dct * c * f * (1 - f), dhm * tc * o * (1 - o), dct * i * (1 - g * g)), 1)
            dzs[t], hs[t] = dz, h
            dh = dz @ rec.T + dh * (1 - m)
            dc = dct * f + dc * (1 - m)
        flat = dzs.reshape(-1, 4 * HIDDEN)
        dw = np.concatenate((x.reshape(-1, size).T @ flat, hs.reshape(-1, HIDDEN).T @ flat))
        return dw, flat.sum(0), dzs @ w[:size].T

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """pages: (forms, words, sizes, labels) each; Adam on the mean cross entropy of the blocks."""
        rng = np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i][2]), i))
            groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            rng.shuffle(groups)
            rate = 0.01 * 0.6**epoch
            for group in groups:
                part = [pages[i] for i in group]
                x, mask = self.batch([p[:3] for p in part])
                y = np.zeros(mask.shape, np.float32)
                for j, p in enumerate(part):
                    y[: len(p[3]), j] = p[3]
                kept: dict = {}
                p = self.forward(x, mask, kept)
                d = ((p - y) * mask / mask.sum())[..., None]
                feats = kept["feats"]
                grads = {"wo": feats.reshape(-1, feats.shape[2]).T @ d.reshape(-1, 1), "bo": d.sum((0, 1))}
                dfeats = d @ self.w["wo"].T
                grads["wf"], grads["bf"], dx1 = self._unroll(x, kept["kf"], self.w["wf"], dfeats[..., :HIDDEN])
                grads["wb"], grads["bb"], dx2 = self._unroll(x[::-1], kept["kb"], self.w["wb"], dfeats[::-1, :, HIDDEN : 2 * HIDDEN])
                dx = dfeats[..., 2 * HIDDEN :] + dx1 + dx2[::-1]
                sizes = np.concatenate([p[2] for p in part])
                per = np.concatenate([dx[: len(p[2]), j, 22:] for j, p in enumerate(part)]) / np.sqrt(np.maximum(sizes, 1))[:, None]
                words = np.concatenate([p[1] for p in part])
                by = np.argsort(words, kind="stable")
                met, begin = np.unique(words[by], return_index=True)
                de = np.zeros_like(self.w["embed"])
                de[met] = np.add.reduceat(per[np.repeat(np.arange(len(sizes)), sizes)[by]], begin, axis=0)
                grads["embed"] = de
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def batch(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(p[2]) for p in pages)
        x = np.zeros((steps, len(pages), 22 + EMBED), np.float32)
        mask = np.zeros((steps, len(pages)), np.float32)
        for j, p in enumerate(pages):
            x[: len(p[2]), j] = self.inputs(*p)
            mask[: len(p[2]), j] = 1
        return x, mask


def page_vectors(lines: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, sizes = word_hashes(lines, known)
    return block_forms(lines), words, sizes


def train(texts: list[str]) -> BlockLabeller:
    """A labeller fitted to the seed labels of these pages."""
    known: dict[str, int] = {}
    pages = []
    for text in texts:
        lines = text.split("\n")
        forms, words, sizes = page_vectors(lines, known)
        labels, ends = np.array(seed_labels(lines), np.float32), np.concatenate(([0], np.cumsum(sizes)))
        for at in range(0, len(lines), WINDOW):
            to = min(at + WINDOW, len(lines))
            pages.append((forms[at:to], words[ends[at] : ends[to]], sizes[at:to], labels[at:to]))
    model = BlockLabeller()
    if pages:
        model.fit(pages)
    return model


def label_pages(model: BlockLabeller, texts: list[str], known: dict[str, int]) -> list[np.ndarray]:
    """Numbers of the body's lines, for each text."""
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    lines = [text.split("\n") for text in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(lines[i]))
    while order:
        # The longest first; as many with it as are 128 windows together, padded.
        n = min(128, max(1, 128 * WINDOW // len(lines[order[0]])))
        part, order = order[:n], order[n:]
        x, mask = model.batch([page_vectors(lines[i], known) for i in part])
        p = model.forward(x, mask)
        for k, i in enumerate(part):
            blank = np.array([not t.strip() for t in lines[i]])
            found[i] = np.flatnonzero((p[: len(blank), k] >= 0.5) & ~blank)
    return found


def body_lines(pages: DataFrame) -> DataFrame:
    """(page_id, text) -> (page_id, line_no) of every line of the main body, lines counted from 0.

    Null and empty texts, and pages without body, have no rows; repeated rows
    count once. Blank lines are never body.
    """
    read = pages.select("page_id", "text").where("page_id is not null and text is not null and text <> ''")
    sample = read.where(F.length("text") <= TRAIN_CHARS).orderBy(F.xxhash64("page_id"), "text").limit(TRAIN_PAGES).select("text").collect()
    weights = read.sparkSession.sparkContext.broadcast(train([r.text for r in sample]).w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = BlockLabeller(weights.value), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = label_pages(model, part.column(1).to_pylist(), known)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(found), pa.int64())], ["page_id", "line_no"])

    return spread(read, "page_id").mapInArrow(run, "page_id bigint, line_no bigint").distinct()
