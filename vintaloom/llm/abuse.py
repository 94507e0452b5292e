"""Scores for abusive, hateful or sexual content.

A linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios, trained
on labelled pages. Texts are read through a skeleton in which vowels look alike and case, accents, look-alike
letters, digits for letters, hidden characters, blanks and repeated letters vanish, so disguised spellings
meet their plain form. Labels hold for pages but abuse sits in sentences: training alternates between
choosing the most telling sentences of each page and fitting the classifier to them.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut

HASH_BITS = 20
ORDERS = (4, 6, 8)
VOWEL, FIRST, BREAK = 1, 2, 31
MAX_LABELLED = 5_000
MAX_BYTES = 128 << 20
DAMPING = 60.0  # keeps short lines from reaching the margin of a whole sentence

# Letters of other scripts and digits that stand for Latin letters.
LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "і": "i", "ї": "i", "у": "y", "р": "p", "с": "c", "х": "x", "к": "k", "м": "m", "н": "h", "т": "t", "в": "b", "ѕ": "s", "ј": "j", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "ս": "u",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "υ": "u", "ν": "v", "ρ": "p", "κ": "k", "τ": "t", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "ð": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "*": "a",
}
_CP1252 = {"€": 0x80, "‚": 0x82, "ƒ": 0x83, "„": 0x84, "…": 0x85, "†": 0x86, "‡": 0x87, "ˆ": 0x88, "‰": 0x89, "Š": 0x8A, "‹": 0x8B, "Œ": 0x8C, "Ž": 0x8E, "‘": 0x91, "’": 0x92, "“": 0x93, "”": 0x94, "•": 0x95, "–": 0x96, "—": 0x97, "˜": 0x98, "™": 0x99, "š": 0x9A, "›": 0x9B, "œ": 0x9C, "ž": 0x9E, "Ÿ": 0x9F}
_TWICE = re.compile("[Â-ßâ-ïð][\u0080-¿" + "".join(_CP1252) + "]{1,3}")


def repair(text: str) -> str:
    """Undo UTF-8 read as a one-byte charset, piece by piece; anything else stays."""

    def back(m: re.Match) -> str:
        s = m.group()
        for end in range(len(s), 1, -1):
            try:
                return bytes(_CP1252.get(c, ord(c) if ord(c) < 256 else 256) for c in s[:end]).decode("utf-8") + s[end:]
            except (UnicodeDecodeError, ValueError):
                continue
        return s

    return _TWICE.sub(back, text)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code of each character of the basic plane: 0 none, VOWEL, FIRST.. for consonants."""
    table = np.zeros(65_536, dtype=np.uint8)
    consonants = "bcdfghjklmnpqrstvwxz"
    codes = {c: FIRST + i for i, c in enumerate(consonants)} | dict.fromkeys("aeiouy", VOWEL)
    for cp in range(65_536):
        if 0xD800 <= cp < 0xE000:
            continue
        c = LOOKALIKE.get(chr(cp).casefold(), chr(cp))
        for d in unicodedata.normalize("NFKD", c).casefold():
            d = LOOKALIKE.get(d, d)
            if d in codes:
                table[cp] = codes[d]
                break
    return table


def skeleton(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts in a row, BREAK before every sentence, and the text number of every code."""
    fixed = [repair(t) if t and _TWICE.search(t) else (t or "") for t in texts]
    lengths = np.array([len(t) for t in fixed], dtype=np.int64)
    cp = np.frombuffer("".join(["\n" + t for t in fixed]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(fixed)), lengths + 1)
    low = np.where(cp < 65_536, cp, 0)
    codes = letter_table()[low]
    blank = (low == 32) | (low == 10) | (low == 9) | (low == 13) | (low == 160)
    after = np.append(blank[1:], True)
    stop = ((low == 46) | (low == 33) | (low == 63)) & after | (low == 10)
    # digits count as letters only inside a word that has letters, so bare numbers vanish
    digit = (low >= 48) & (low <= 57)
    lone = digit & ~(np.append(False, (codes[:-1] > 0) & ~digit[:-1]) | np.append((codes[1:] > 0) & ~digit[1:], False))
    runs = digit & ~lone
    codes = np.where(lone & ~_beside(runs, digit), 0, codes)
    codes = np.where(stop, BREAK, codes).astype(np.uint8)
    kept = codes > 0
    codes, owner = codes[kept], owner[kept]
    new = np.append(True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1]))
    return codes[new], owner[new]


def _beside(seed: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Positions of runs of `within` that hold a position of `seed`."""
    start = np.append(True, within[1:] != within[:-1])
    run = np.cumsum(start) - 1
    hit = np.zeros(run[-1] + 1 if len(run) else 0, dtype=bool)
    hit[run[seed]] = True
    return hit[run] & within if len(run) else within


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """For each order the hashed n-gram starting at every code; -1 where it would reach beyond its sentence."""
    out = []
    size = len(codes)
    for n in ORDERS:
        h = np.zeros(size, dtype=np.uint64)
        bad = np.zeros(size, dtype=bool)
        for k in range(min(n, size)):
            c = np.zeros(size, dtype=np.uint64)
            c[: size - k] = codes[k:]
            h = h * np.uint64(31) + c
            if k:
                bad[: size - k] |= codes[k:] == BREAK
        bad[max(0, size - n + 1) :] = True
        h = (h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
        ids = (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        ids[bad] = -1
        out.append(ids)
    return out


@dataclass(frozen=True)
class AbuseModel:
    """weight and scale per hashed n-gram (float32), the bias, and the probability from which a page is flagged."""

    weight: np.ndarray
    scale: np.ndarray
    bias: float
    threshold: float

    def sentence_margins(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margin of every sentence and the position where it starts."""
        starts = np.flatnonzero(codes == BREAK)
        if not len(starts):
            return np.zeros(0), starts
        s1, s2 = np.zeros(len(codes)), np.zeros(len(codes))
        for ids in grams(codes):
            ok = ids >= 0
            s1[ok] += (self.weight * self.scale)[ids[ok]]
            s2[ok] += (self.scale * self.scale)[ids[ok]]
        a, b = np.add.reduceat(s1, starts), np.add.reduceat(s2, starts)
        letters = np.diff(np.append(starts, len(codes))) > 1
        return np.where(letters, a / np.sqrt(b + DAMPING) + self.bias, -np.inf), starts

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of the most abusive sentence of each text; 0 for a text without letters."""
        codes, owner = skeleton(texts)
        margins, starts = self.sentence_margins(codes)
        top = np.full(len(texts), -np.inf)
        if len(starts):
            np.maximum.at(top, owner[starts], margins)
        return np.where(np.isfinite(top), 1 / (1 + np.exp(-np.clip(top, -700, 700))), 0.0)


def _fit(x: list[np.ndarray], y: np.ndarray, scale: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; every sentence weighs the same, so a wrong mark can't outweigh many right ones."""
    rows = np.repeat(np.arange(len(x)), [len(g) for g in x])
    ids, cols = np.unique(np.concatenate(x), return_inverse=True)
    v = scale[ids][cols]
    v = v / np.sqrt(np.bincount(rows, v * v, minlength=len(x)) + DAMPING)[rows]
    cost = np.full(len(y), 1 / len(y))
    u, most = np.random.default_rng(0).standard_normal(len(ids)), 1.0
    for _ in range(8):  # the greatest curvature sets the step
        z = np.bincount(rows, v * u[cols], minlength=len(x))
        u = np.bincount(cols, v * (cost * z)[rows], minlength=len(ids))
        most = float(np.linalg.norm(u)) or 1.0
        u = u / most
    rate = 1 / (0.25 * (most + 0.5) + ridge)
    w, b = np.zeros(len(ids)), 0.0
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        z = np.bincount(rows, v * pw[cols], minlength=len(x)) + pb
        g = cost * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        nw = pw - rate * (np.bincount(cols, v * g[rows], minlength=len(ids)) + ridge * pw)
        nb = pb - rate * float(g.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    weight = np.zeros(len(scale))
    weight[ids] = w
    return weight, b


def train(texts: list[str], labels: np.ndarray, rounds: int = 4, per_page: int = 3, ridge: float = 3e-6, steps: int = 200, threshold: float = 0.5) -> AbuseModel:
    """Fit the classifier to labelled pages; a page is flagged from the given probability on.

    With no page or only one class the model scores everything 0.
    """
    labels = np.asarray(labels, dtype=int)
    width = 1 << HASH_BITS
    if not len(labels) or labels.min() == labels.max():
        return AbuseModel(np.zeros(width, np.float32), np.ones(width, np.float32), -20.0, 0.5)
    pages = [_sentences(t) for t in texts]
    model = _train(pages, labels, rounds, per_page, ridge, steps)
    return AbuseModel(model[0].astype(np.float32), model[1].astype(np.float32), model[2], threshold)


def _sentences(text: str) -> list[np.ndarray]:
    codes, _ = skeleton([text])
    if not len(codes):
        return []
    part = np.cumsum(codes == BREAK)
    out: dict[int, list[np.ndarray]] = {}
    for ids in grams(codes):
        ok = ids >= 0
        for p, g in zip(*_split(part[ok], ids[ok])):
            out.setdefault(p, []).append(g)
    return [np.concatenate(g) for _, g in sorted(out.items())]


def _split(part: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(part):
        return [], []
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return part[at].tolist(), np.split(ids, at[1:])


def _margin(model: tuple, g: np.ndarray) -> float:
    w, s, b = model
    return float((w[g] * s[g]).sum() / np.sqrt((s[g] * s[g]).sum() + DAMPING) + b)


def _train(pages: list[list[np.ndarray]], labels: np.ndarray, rounds: int, per_page: int, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    width = 1 << HASH_BITS
    counts = np.zeros((2, width))
    for page, y in zip(pages, labels):
        if page:
            counts[y, np.unique(np.concatenate(page))] += 1
    n = np.array([(labels == k).sum() for k in (0, 1)], dtype=float)
    rate = (counts + 0.5) / (n[:, None] + 1)
    ratio = np.log(rate[1] / rate[0])
    # an n-gram of a single page says little about either class
    seen = counts.sum(axis=0)
    scale = np.where(seen > 0, np.abs(ratio) * seen / (seen + 1), 0.0) + 1e-3
    first = np.where((counts[1] >= 2) | (counts[0] >= 2), ratio, 0.0)
    value = lambda g: float(np.clip(first[g], -1, 3).sum() / np.sqrt(len(g) + 8))
    model = None
    for _ in range(rounds):
        x, y = [], []
        for page, label in zip(pages, labels):
            if not page:
                continue
            score = [value(g) if model is None else _margin(model, g) for g in page]
            order = np.argsort(score)[::-1]
            take = order[:1] if label else order[:per_page]
            if label and model is not None:
                take = [i for j, i in enumerate(order[:per_page]) if j == 0 or score[i] > 0]
            x += [page[i] for i in take]
            y += [label] * len(take)
        if not x or len(set(y)) < 2:
            return np.zeros(width), scale, -20.0
        w, b = _fit(x, np.array(y), scale, ridge, steps)
        model = (w, scale, b)
    return model


def fit_abuse(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES) -> AbuseModel:
    """Train on the labelled pages: at most max_labelled of them and max_bytes of text, whole texts in the order of a hash of doc_id.

    A page's label is the majority of its annotators (repeated marks of one annotator count once); ties are left out.
    """
    votes = labels.filter("doc_id is not null and is_abusive is not null").select("doc_id", "annotator", "is_abusive").distinct().groupBy("doc_id").agg(F.avg("is_abusive").alias("share"))
    chosen = votes.filter("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    pages = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))  # at most max_labelled rows
    pages = cut(pages)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    upto = pages.select("doc_id", F.sum(size).over(W.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("upto"))  # lengths of at most max_labelled pages
    rows = pages.join(F.broadcast(upto.filter(F.col("upto") <= max_bytes)), "doc_id").orderBy("doc_id").toPandas()
    return train([t if isinstance(t, str) else "" for t in rows["text"]], rows["label"].to_numpy())


def score_pages(documents: DataFrame, model: AbuseModel) -> DataFrame:
    """(doc_id, source, score, flagged) of every page; NULL or empty texts score 0. Repeated rows of a page give repeated rows."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            score = np.zeros(len(texts))
            start, size = 0, 0  # about a million characters at a time, whole texts only
            for i, t in enumerate([*texts, None]):
                if t is None or (size and size + len(t) > 1_000_000):
                    score[start:i] = shipped.value.scores(texts[start:i]) if i > start else []
                    start, size = i, 0
                size += len(t or "")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": score, "flagged": score >= shipped.value.threshold})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, score double, flagged boolean")


def rates(scored: DataFrame) -> DataFrame:
    """Per source: pages, flagged pages, their rate and the mean score; each doc_id counts once."""
    one = scored.groupBy("doc_id").agg(F.max(F.struct("source", "flagged", "score")).alias("x")).select("x.*")
    return one.groupBy("source").agg(F.count("*").alias("pages"), F.sum(F.col("flagged").cast("long")).alias("flagged_pages"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
