"""Toxic spans by a linear-chain conditional random field.

Training (on the driver, over a bounded sample of labelled documents):
1. Labelled tokens. Labels are of documents, so marks are chosen by greedy
   covering: the word or character n-gram that is in most of the toxic documents
   not yet explained, beyond what its share of clean documents lets expect, until
   what is left is too rare. A mark may be in clean documents too, as long as
   toxic ones have it far more often; so a language with few toxic documents
   keeps its marks. Tokens of toxic documents that carry a mark are labelled 1.
2. A two-state linear-chain CRF over hashed word and n-gram features is fitted to
   these token sequences by gradient ascent on the conditional likelihood
   (forward-backward expectations). Clean sentences with a marked token are all
   used, of the other clean sentences at most OTHER_SENTENCES, picked uniformly
   and weighted up to their number. Sentences of toxic documents without a mark
   are not used: nothing says what their tokens are.
3. A logistic curve maps a document's marginals (largest, sum of the noticeable
   ones, and that sum by its length) to its score. It is fitted on marginals of
   chains that didn't see the document (two folds), so that what a chain knows by
   heart doesn't count.

Scoring (Arrow batches): emissions are computed once for each distinct word of a
worker; forward-backward runs over all sentences of a batch at once. A sequence
is a sentence, however long: pieces of MAX_SEQUENCE tokens run in step and pass
their messages on to the next piece, which gives the marginals of the whole.

Defined results: null and empty texts have no tokens and get the curve's lowest
score; unlabelled or one-sided samples give a model that scores every text 0;
rows with equal ids are scored each; a label row without id is ignored, and of
several for a document the largest counts. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import F, T, map_batches, strings

#: Labelled documents of each class that training reads at most.
SAMPLE_PER_CLASS = 1_500
#: Clean sentences without a marked token that training reads at most.
OTHER_SENTENCES = 5_000
#: Tokens that run in step; longer sentences are chained from such pieces.
MAX_SEQUENCE = 128
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
MARK_BITS = 21
#: How many times as often as clean documents toxic ones must have a mark at least.
ODDS = 3.0
GRAMS = (4, 5, 6)
THRESHOLD = 0.3
TOKEN = re.compile(r"[^ \n]+")
EDGES = re.compile(r"^\W+|\W+$")


def normal(token: str) -> str:
    token = token.lower()
    return token if token.isalnum() else EDGES.sub("", token)


def features(word: str) -> list[str]:
    """Of a normalised word: itself and its n-grams, with the word's bounds."""
    w = f"<{word}>"
    return ["=" + word, *dict.fromkeys(w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1))]


def gram_hashes(words: list[str]) -> tuple[str, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The words in a row, each in <>, and for each n-gram length the begins,
    owners (word numbers) and 64-bit hashes of all n-grams inside a word."""
    row = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(row.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    out = []
    for n in GRAMS:
        m = max(0, len(points) - n + 1)
        at = np.flatnonzero(owner[:m] == owner[n - 1 : n - 1 + m])
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + points[at + k]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        out.append((n, at, owner[at], h))
    return row, out


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, feature buckets) of all features of normalised words; empty
    words have none."""
    _, grams = gram_hashes(words)
    whole = [(k, zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS) for k, w in enumerate(words) if w]
    owner = [np.array([k for k, _ in whole], np.int64)]
    where = [np.array([b for _, b in whole], np.int64)]
    empty = np.fromiter((not w for w in words), bool, len(words))
    for _, _, own, h in grams:
        keep = ~empty[own]
        owner.append(own[keep])
        where.append((h[keep] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(owner), np.concatenate(where)


def _signature(words: set[str]) -> tuple[int, ...]:
    """Equal for near copies as a rule, different for other documents."""
    return tuple(sorted(zlib.crc32(w.encode("utf-8")) for w in words if len(w) > 5)[:4])


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def find_marks(rows: list[tuple[set[str], int]], least: int = 4, depth: int = 3, surprise: float = 4.0) -> set[str]:
    """Features of toxic tokens; rows: (normalised words, label).

    A feature in n toxic and p plain documents has an excess of n - ODDS * e, where
    e is p scaled to the number of toxic documents. The excess must be `least` at
    least, and n - e `surprise` standard deviations. Documents count until `depth` marks explain
    them. Near copies count once, so that the rare words of a copied document
    don't seem to be common among toxic ones. Documents are counted in hashed slots
    first; only features in slots that pass are then held by name.
    """
    seen: set = set()
    toxic, plain = [], []
    for words, label in rows:
        key = (label, _signature(words) or tuple(sorted(words)))
        if key not in seen:
            seen.add(key)
            (toxic if label else plain).append(words)
    if not toxic:
        return set()
    counts = np.zeros((2, 1 << MARK_BITS), np.int32)
    in_toxic = Counter(w for words in toxic for w in words)
    in_toxic = {w: n for w, n in in_toxic.items() if n >= least}
    in_plain: Counter = Counter()
    for label, group in ((0, plain), (1, toxic)):
        for words in group:
            if not label:
                in_plain.update(words & in_toxic.keys())
            slots = np.unique(np.concatenate([_slots(h) for *_, h in gram_hashes(list(words))[1]]))
            counts[label, slots] += 1
    scale = len(toxic) / max(1, len(plain))

    def passes(n, p):
        return (n - ODDS * scale * p >= least) & (n - scale * p >= surprise * np.sqrt(1 + scale * p))

    good = passes(counts[1], counts[0])
    expected = {"=" + w: ODDS * scale * in_plain[w] for w, n in in_toxic.items() if passes(n, in_plain[w])}
    found: dict[str, set[int]] = defaultdict(set)
    for d, words in enumerate(toxic):
        for w in words & in_toxic.keys():
            if "=" + w in expected:
                found["=" + w].add(d)
        row, grams = gram_hashes(list(words))
        for n, at, _, h in grams:
            slots = _slots(h)
            for k, slot in zip(at[good[slots]].tolist(), slots[good[slots]].tolist()):
                found[row[k : k + n]].add(d)
                expected[row[k : k + n]] = ODDS * scale * int(counts[0, slot])
    pure = {f: ds for f, ds in found.items() if len(ds) - expected[f] >= least}
    strong = max(2 * least, len(toxic) // 100)
    marks = {f for f, ds in pure.items() if f[0] == "=" and len(ds) - expected[f] >= strong}
    left = dict.fromkeys(range(len(toxic)), depth)
    while pure:
        excess = {f: sum(d in left for d in ds) - expected[f] for f, ds in pure.items()}
        most = max(excess.values())
        if most < least:
            break
        # of those that explain nearly as much as the best, the longest
        f = max((f for f, n in excess.items() if n >= 0.97 * most), key=lambda k: (len(k), excess[k], k))
        marks.add(f)
        for d in pure[f]:
            if d in left:
                left[d] -= 1
                if not left[d]:
                    del left[d]
        pure = {k: v for k, v in pure.items() if excess[k] >= least and k != f}
    return marks


class Marked:
    """Which tokens carry a mark, looked up once for each distinct word."""

    def __init__(self, marks: set[str]):
        self.whole = {m[1:] for m in marks if m[0] == "="}
        own = [m for m in marks if m[0] != "="]
        self.grams = {n: {m for m in own if len(m) == n} for n in GRAMS}
        self.known: dict[str, bool] = {}

    def __call__(self, token: str) -> bool:
        held = self.known.get(token)
        if held is None:
            if len(self.known) > 300_000:
                self.known.clear()
            w = normal(token)
            row = f"<{w}>"
            held = bool(w) and (w in self.whole or any(row[i : i + n] in own for n, own in self.grams.items() if own for i in range(len(row) - n + 1)))
            self.known[token] = held
        return held


@dataclass
class Crf:
    """weights: of each feature bucket for state 1 against 0; trans: log potentials."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    start: float
    curve: tuple[float, ...]

    def emission(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -20.0)
        for block in range(0, len(words), 8192):  # bounds the features that are held at once
            own = [normal(w) for w in words[block : block + 8192]]
            owner, where = buckets(own)
            sums = self.bias + np.bincount(owner, self.weights[where], len(own))
            out[block : block + len(own)] = np.where([bool(w) for w in own], sums, -20.0)
        return np.clip(out, -20, 20).astype(np.float32)

    def document_scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(curve_inputs(evidence) @ np.array(self.curve), -40, 40)))


def document_evidence(marginals: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents, 3): largest marginal, sum of those over 0.1, tokens."""
    n = np.diff(bounds)
    top = np.zeros(len(n))
    some = np.flatnonzero(n)
    if len(some):
        top[some] = np.maximum.reduceat(marginals, bounds[some])
    run = np.concatenate(([0.0], np.cumsum(np.where(marginals > 0.1, marginals, 0.0))))
    return np.stack([top, run[bounds[1:]] - run[bounds[:-1]], n.astype(float)], axis=1)


def curve_inputs(evidence: np.ndarray) -> np.ndarray:
    """Of a document: how sure the surest token is, how much toxic text there is, how
    dense it is, and both at once."""
    top, mass, n = evidence.T
    much, dense = np.log1p(mass), np.log1p(500 * mass / (n + 20))
    return np.stack([np.ones(len(top)), top, much, dense, much * dense], axis=1)


def sequences(n: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of sequences in n tokens; ends: True at a sentence's last token."""
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.flatnonzero(ends)
    begins = np.concatenate(([0], last + 1)) if not len(last) or last[-1] != n - 1 else np.concatenate(([0], last[:-1] + 1))
    lengths = np.diff(np.append(begins, n))
    parts = -(-lengths // MAX_SEQUENCE)
    if (parts > 1).any():
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        begins = np.repeat(begins, parts) + k * MAX_SEQUENCE
        lengths = np.diff(np.append(begins, n))
    return begins, lengths


def continued(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which sequences go on where the one before them was cut."""
    out = np.zeros(len(begins), bool)
    out[1:] = ~ends[begins[1:] - 1]
    return out


def _messages(e1, begins, lengths, t, joined, start):
    """For chains of pieces: the forward message into each piece and the backward
    message out of it. A piece is a product of 2x2 matrices, all pieces in step;
    only their chain is walked."""
    into, out = np.ones((len(begins), 2)), np.ones((len(begins), 2))
    part = np.flatnonzero(joined | np.append(joined[1:], False))
    m = np.broadcast_to(np.eye(2), (len(part), 2, 2)).copy()
    for k in range(int(lengths[part].max())):
        on = np.flatnonzero(lengths[part] > k)
        at = begins[part[on]] + k
        if k:
            step = m[on] @ t
        else:  # a chain's first token has the start potential and no transition
            step = np.where(joined[part[on]][:, None, None], t[None], np.array([[1.0, np.exp(start)], [0.0, 0.0]])[None])
        step[:, :, 1] *= e1[at][:, None]
        m[on] = step / step.sum(axis=(1, 2), keepdims=True)
    for j, p in enumerate(part[:-1].tolist()):
        if joined[p + 1]:
            v = (into[p] if joined[p] else np.array([1.0, 0.0])) @ m[j]
            into[p + 1] = v / v.sum()
    for j in range(len(part) - 1, 0, -1):
        p = int(part[j])
        if joined[p]:
            v = m[j] @ out[p]
            out[p - 1] = v / v.sum()
    return into, out


def forward_backward(score: np.ndarray, begins: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: float, pairs: bool = False, joined: np.ndarray | None = None, weight: np.ndarray | None = None):
    """Marginals of state 1, all sequences in step; with pairs, also the expected
    transition counts (2x2, by the weight of each token) and the log normaliser.
    joined: sequences that continue the one before them."""
    n = len(score)
    e1 = np.exp(score.astype(np.float64))
    t = np.exp(trans)
    chained = joined is not None and bool(joined.any())
    first = np.ones(len(begins), bool) if not chained else ~joined
    into, beyond = _messages(e1, begins, lengths, t, joined, start) if chained else (None, None)
    heads = begins[first]
    order = np.argsort(-lengths, kind="stable")
    begins, lengths, first = begins[order], lengths[order], first[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")  # sequences with more than k tokens
    fwd, norm = np.empty((n, 2)), np.empty(n)
    for k in range(longest):
        at = begins[: active[k]] + k
        if k == 0:
            a0, a1 = np.ones(len(at)), e1[at] * np.exp(start)
            if chained:
                p = into[order[: active[0]]]
                a0 = np.where(first[: active[0]], a0, p[:, 0] * t[0, 0] + p[:, 1] * t[1, 0])
                a1 = np.where(first[: active[0]], a1, e1[at] * (p[:, 0] * t[0, 1] + p[:, 1] * t[1, 1]))
        else:
            p = fwd[at - 1]
            a0 = p[:, 0] * t[0, 0] + p[:, 1] * t[1, 0]
            a1 = e1[at] * (p[:, 0] * t[0, 1] + p[:, 1] * t[1, 1])
        z = a0 + a1
        fwd[at, 0], fwd[at, 1], norm[at] = a0 / z, a1 / z, z
    bwd = np.ones((n, 2))
    if chained:
        last = begins + lengths - 1
        own = beyond[order]
        bwd[last] = own / (fwd[last] * own).sum(axis=1, keepdims=True)
    for k in range(longest - 2, -1, -1):
        at = begins[: active[k + 1]] + k
        nx = bwd[at + 1]
        b0 = (t[0, 0] * nx[:, 0] + t[0, 1] * e1[at + 1] * nx[:, 1]) / norm[at + 1]
        b1 = (t[1, 0] * nx[:, 0] + t[1, 1] * e1[at + 1] * nx[:, 1]) / norm[at + 1]
        bwd[at, 0], bwd[at, 1] = b0, b1
    post = fwd * bwd
    marginal = post[:, 1] / post.sum(axis=1)
    if not pairs:
        return marginal
    inner = np.ones(n, bool)
    inner[heads] = False
    at = np.flatnonzero(inner)
    expected = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            own = fwd[at - 1, a] * t[a, b] * (e1[at] if b else 1.0) * bwd[at, b] / norm[at]
            expected[a, b] = (own if weight is None else own * weight[at]).sum()
    return marginal, expected, float(np.log(norm).sum())


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text)


def sentence_ends(tokens: list[str]) -> np.ndarray:
    return np.fromiter((t[-1] in ".!?" for t in tokens), bool, len(tokens))


def fit_chain(token_docs: list[tuple[list[str], np.ndarray, float]], rounds: int = 30, rate: float = 0.5, l2: float = 1e-4) -> Crf:
    """token_docs: (tokens, 0/1 labels, weight), each a sequence."""
    words = list(dict.fromkeys(normal(t) for ts, *_ in token_docs for t in ts))
    number = {w: k for k, w in enumerate(words)}
    owner, flat = buckets(words)
    tok = np.fromiter((number[normal(t)] for ts, *_ in token_docs for t in ts), np.int64)
    gold = np.concatenate([y for _, y, _ in token_docs]).astype(np.float64)
    lengths = np.fromiter((len(ts) for ts, *_ in token_docs), np.int64, len(token_docs))
    weight = np.repeat(np.fromiter((w for *_, w in token_docs), np.float64, len(token_docs)), lengths)
    heads = np.cumsum(lengths) - lengths
    ends = np.zeros(len(tok), bool)
    ends[heads + lengths - 1] = True
    begins, lengths = sequences(len(tok), ends)
    joined = continued(begins, ends)
    inner = np.ones(len(tok), bool)
    inner[heads] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[at - 1].astype(int), gold[at].astype(int)), weight[at])
    model = Crf(np.zeros(BUCKETS), -3.0, np.zeros((2, 2)), 0.0, (0.0,) * 5)
    gw, gb, gt, gs = np.full(BUCKETS, 1e-8), 1e-8, np.full((2, 2), 1e-8), 1e-8
    scale = max(1.0, gold.sum())
    for _ in range(rounds):
        per_word = model.bias + np.bincount(owner, model.weights[flat], len(words))
        score = np.clip(per_word[tok], -20, 20)
        marginal, expected, _ = forward_backward(score, begins, lengths, model.trans, model.start, pairs=True, joined=joined, weight=weight)
        diff = weight * (gold - marginal) / scale
        by_word = np.bincount(tok, diff, len(words))
        g = np.bincount(flat, by_word[owner], BUCKETS) - l2 * model.weights
        gw += g * g
        model.weights += rate * g / np.sqrt(gw)
        g = diff.sum()
        gb += g * g
        model.bias += rate * g / np.sqrt(gb)
        g = (seen - expected) / scale
        gt += g * g
        model.trans += rate * g / np.sqrt(gt)
        model.trans[0, 0] = 0.0
        g = diff[heads].sum()
        gs += g * g
        model.start += rate * g / np.sqrt(gs)
    return model


def fit_curve(evidence: np.ndarray, label: np.ndarray, rounds: int = 25) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge. More evidence never
    lowers a score: inputs that would are left out."""
    x = curve_inputs(evidence)
    use = np.ones(x.shape[1], bool)
    while True:
        own = x[:, use]
        w = np.zeros(own.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            h = (own * (p * (1 - p))[:, None]).T @ own + 0.1 * np.eye(len(w))
            w += np.linalg.solve(h, own.T @ (label - p) - 0.1 * w)
        out = np.zeros(x.shape[1])
        out[use] = w
        if not (out[1:] < 0).any():
            return tuple(float(v) for v in out)
        use[1 + np.flatnonzero(out[1:] < 0)] = False


def chain_of(rows: list[tuple[list[str], set[str], int]], others: int) -> Crf | None:
    """The chain without its curve; rows: (tokens, words, label). None without marks."""
    marked = Marked(find_marks([(words, y) for _, words, y in rows]))
    own, rest = [], []
    for ts, _, y in rows:
        if not ts:
            continue
        flags = np.fromiter((marked(t) for t in ts), bool, len(ts))
        cuts = np.flatnonzero(sentence_ends(ts)) + 1
        for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ts)]):
            if b == e:
                continue
            if flags[b:e].any():
                own.append((ts[b:e], flags[b:e] & bool(y), 1.0))
            elif not y:
                rest.append(ts[b:e])
    if not any(f.any() for _, f, _ in own):
        return None
    number = len(rest)
    if number > others:
        rest = [rest[k] for k in np.random.default_rng(7).choice(number, others, replace=False)]
    return fit_chain(own + [(ts, np.zeros(len(ts), bool), number / len(rest)) for ts in rest])


def evidence_of(model: Crf, texts: list[str]) -> np.ndarray:
    scorer = Scorer(model)
    return np.concatenate([document_evidence(*scorer.token_marginals(pa.array(texts[k : k + 200], pa.string()))) for k in range(0, len(texts), 200)])


def train(rows: list[tuple[str, int]], others: int = OTHER_SENTENCES) -> Crf | None:
    """rows: (text, label). None if a class is missing, or no mark is found."""
    if not any(y for _, y in rows) or all(y for _, y in rows):
        return None
    known_by: dict[str, str] = {}

    def prepared(text, y):
        ts = tokens_of(text)
        own = set(ts)
        for t in own:
            if t not in known_by:
                known_by[t] = normal(t)
        return ts, {known_by[t] for t in own} - {""}, y

    docs = [prepared(t, y) for t, y in rows]
    known_by.clear()
    model = chain_of(docs, others)
    if model is None:
        return None
    label = np.array([y for _, y in rows], float)
    # near copies stay in one fold
    fold_of = np.fromiter((zlib.crc32(repr(_signature(words)).encode()) % 2 for _, words, _ in docs), np.int64, len(rows))
    evidence, known = np.zeros((len(rows), 3)), np.zeros(len(rows), bool)
    for side in (0, 1):
        test = np.flatnonzero(fold_of == side)
        part = chain_of([docs[k] for k in np.flatnonzero(fold_of != side)], others)
        if part is not None and len(test):
            evidence[test], known[test] = evidence_of(part, [rows[k][0] for k in test]), True
    if not (known.any() and label[known].any() and not label[known].all()):
        evidence, known = evidence_of(model, [t for t, _ in rows]), np.ones(len(rows), bool)
    model.curve = fit_curve(evidence[known], label[known])
    return model


class Scorer:
    """Marginals of all tokens of texts; emissions are held by word."""

    LIMIT = 300_000

    def __init__(self, model: Crf):
        self.model = model
        self._start()

    def _start(self):
        self.code: dict[str, int] = {}
        self.score = np.zeros(0, np.float32)
        self.end = np.zeros(0, bool)

    def token_marginals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(marginals, token offsets of each text); tokens are TOKEN's matches."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        offsets -= offsets[0]
        full = pc.not_equal(values, "").to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(full)))[offsets]
        values = values.filter(pa.array(full))
        n = len(values)
        if not n:
            return np.zeros(0), bounds
        if len(self.code) > self.LIMIT:
            self._start()
        coded = values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.code]
        if new:
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
            self.score = np.concatenate((self.score, self.model.emission(new)))
            self.end = np.concatenate((self.end, sentence_ends(new)))
        codes = np.fromiter((self.code[w] for w in distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        ends = self.end[codes]
        ends[bounds[1:][bounds[1:] > 0] - 1] = True  # a text ends a sequence
        begins, lengths = sequences(n, ends)
        return forward_backward(self.score[codes], begins, lengths, self.model.trans, self.model.start, joined=continued(begins, ends)), bounds


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])


def text_spans(text: str, marginals: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of toxic tokens as code point offsets."""
    out: list[dict] = []
    hot = marginals >= least
    if not hot.any():
        return out
    last = int(np.flatnonzero(hot)[-1])
    before = False
    for k, m in enumerate(TOKEN.finditer(text)):
        if hot[k]:
            if before:
                out[-1] = {"start": out[-1]["start"], "end": m.end(), "p": max(out[-1]["p"], float(marginals[k]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(marginals[k])})
        before = bool(hot[k])
        if k == last:
            break
    return out


def fold(doc_id):
    return F.crc32(doc_id.cast("string")) % 4


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Crf | None:
    """Train on labelled documents outside the held-out fold, per_class of each
    class at most, in the order of a hash of their ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 2))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    picks = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    # bounded by per_class, so this side can be broadcast
    chosen = F.broadcast(picks[0].unionByName(picks[1]))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(chosen, "_id")
    rows = texts.groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"), F.max("_y").alias("_y")).orderBy("_id").collect()
    return train([(r["_text"] or "", r["_y"]) for r in rows])


def _score_batches(model: Crf | None, spans: bool):
    scorers: list[Scorer] = []

    def score(texts: pa.Array):
        if model is None:
            return np.zeros(len(texts)), [[] for _ in range(len(texts))]
        if not scorers:
            scorers.append(Scorer(model))
        marginals, bounds = scorers[0].token_marginals(texts)
        evidence = document_evidence(marginals, bounds)
        found = [[] for _ in range(len(texts))]
        if spans:
            for k in np.flatnonzero(evidence[:, 0] >= 0.5):
                found[k] = text_spans(texts[int(k)].as_py(), marginals[bounds[k] : bounds[k + 1]])
        return model.document_scores(evidence), found

    return score


def score(docs: DataFrame, model: Crf | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every row."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))]
    )
    of = _score_batches(model, True)

    def run(batch):
        values, spans = of(strings(batch.column(2)))
        arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values), pa.array(spans, arrow)], names=schema.names)

    narrow = docs.select(F.col(id_col).cast("long"), (F.coalesce(fold(F.col(id_col).cast("long")), F.lit(0)) == 2).alias("h"), F.col(text_col).cast("string"))
    out = map_batches(narrow, schema, run)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def reject(docs: DataFrame, model: Crf | None, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold."""
    at = docs.columns.index(text_col)
    of = _score_batches(model, False)

    def run(batch):
        values, _ = of(strings(batch.column(at)))
        return batch.filter(pa.array(values < threshold))

    return map_batches(docs, docs.schema, run)
