"""Toxicity by a subsequence string-kernel support vector machine.

The kernel compares two words by their common subsequences of three characters,
each weighted by ``decay`` to the power of its span in either word, so gapped
insults and inserted characters lose a little similarity instead of all of it.
A Nystrom map on landmark words makes the machine linear; as its weights act on
kernel values, which are sums over subsequences, they fold into one table with a
number for each subsequence, and a word's decision is a sum of table entries over
its subsequences, divided by its norm.

The machine is trained on labelled sentences. A sentence's decision is that of its
worst word. Sentences of clean texts are labelled 0; of a toxic text at least one
sentence is 1, and which ones is learnt along with the machine (multiple-instance
learning): in each round a toxic text's worst sentence counts as 1, by its worst
word, and the worst words of clean sentences are counterexamples. The first round
takes words that toxic texts favour. A text's
score is a logistic function of how many of its sentences the machine marks, the
density of marked words and the largest decision.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sampling import held_out, labelled_sample
from tessera.llm.subword import pieces, word_hashes, word_spans

#: Symbols: 0 matches nothing (padding, punctuation), 1-26 are a-z, the last two a word's start and end, the rest share other letters.
SYMBOLS = 64
#: Words are read in windows of so many characters, each overlapping the one before by half.
WINDOW = 16
# Characters that often stand in for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: A sentence ends with a word that ends in one of these, quotes and brackets aside.
_STOPS = frozenset(b".!?")


def _symbol(c: str) -> int:
    c = STAND_INS.get(c, c)
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (SYMBOLS - 29) if c.isalpha() else 0


def encode(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the words as rows of symbols, and each row's word."""
    memo: dict[str, int] = {}
    rows, owner = [], []
    for k, word in enumerate(words):
        codes = []
        for c in word.lower():
            s = memo.get(c)
            if s is None:
                s = memo[c] = _symbol(c)
            codes.append(s)
        # Punctuation around a word isn't part of it, inside it is a gap.
        lo, hi = 0, len(codes)
        while lo < hi and not (codes[lo] and word[lo].isalpha()):
            lo += 1
        while hi > lo and not (codes[hi - 1] and word[min(hi, len(word)) - 1].isalpha()):
            hi -= 1
        codes = [SYMBOLS - 2, *codes[lo:hi], SYMBOLS - 1]
        for at in range(0, max(1, len(codes) - WINDOW // 2), WINDOW // 2):
            part = codes[at : at + WINDOW]
            rows.append(bytes(part) + bytes(WINDOW - len(part)))
            owner.append(k)
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, WINDOW).astype(np.int64), np.array(owner, dtype=np.int64)


_TRIPLES = np.array([(i, j, k) for i in range(WINDOW) for j in range(i + 1, WINDOW) for k in range(j + 1, WINDOW)])


def self_kernel(rows: np.ndarray, decay: float) -> np.ndarray:
    """k(s, s) of each row by dynamic programming over prefix pairs."""
    n, w = rows.shape
    same = [[(rows[:, i] == rows[:, j]) & (rows[:, i] > 0) for j in range(w)] for i in range(w)]
    # tail[i][j]: weight of matched subsequences of the current length in prefixes i and j, gaps up to their ends included
    tail = np.ones((w + 1, w + 1, n), dtype=np.float32)
    total = np.zeros(n, dtype=np.float32)
    for length in range(3):
        last = length == 2
        new = np.zeros((w + 1, w + 1, n), dtype=np.float32)
        for i in range(1, w + 1):
            run = np.zeros(n, dtype=np.float32)
            for j in range(1, w + 1):
                hit = same[i - 1][j - 1] * tail[i - 1, j - 1] * np.float32(decay * decay)
                if last:
                    total += hit
                else:
                    run = run * np.float32(decay) + hit
                    new[i, j] = new[i - 1, j] * np.float32(decay) + run
        tail = new
    return total


def kernel_rows(rows: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """(subsequence codes, weights) of each row's triples; weight 0 where a symbol matches nothing."""
    a, b, c = (rows[:, _TRIPLES[:, k]] for k in range(3))
    weight = np.where((a > 0) & (b > 0) & (c > 0), np.float32(decay) ** (_TRIPLES[:, 2] - _TRIPLES[:, 0] + 1).astype(np.float32), np.float32(0))
    return (a * SYMBOLS + b) * SYMBOLS + c, weight


@dataclass
class Model:
    """``table``: the machine's weight of each subsequence; ``bias``: of the machine; ``final``: logistic weights.

    ``marks`` and ``alpha`` are the landmarks and their weights, which ``table`` folds up.
    """

    table: np.ndarray
    bias: float
    final: np.ndarray
    decay: float = 0.6
    marks: tuple[str, ...] = ()
    alpha: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)
    known: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def decide(self, words: Sequence[str]) -> np.ndarray:
        """Decision of each word; of a long word the largest of its windows."""
        out = np.full(len(words), -1e9)
        table = self.table
        for lo in range(0, len(words), 20_000):
            rows, owner = encode(words[lo : lo + 20_000])
            size = WINDOW - (rows[:, ::-1] > 0).argmax(axis=1)
            value = np.zeros(len(rows), dtype=np.float32)
            order = np.argsort(size, kind="stable")
            order = order[(rows[order] > 0).sum(axis=1) >= 4]
            # Rows of like length go together, so short words cost little.
            for at in range(0, len(order), 2000):
                part = order[at : at + 2000]
                width = int(size[part].max())
                some = np.ascontiguousarray(rows[part, :width])
                columns = np.ascontiguousarray(some.T.astype(np.int32))
                total = np.zeros(len(part), dtype=np.float32)
                pair = {}
                for i, j, k in _TRIPLES[_TRIPLES[:, 2] < width].tolist():
                    head = pair.get((i, j))
                    if head is None:
                        head = pair[i, j] = (columns[i] * SYMBOLS + columns[j]) * SYMBOLS
                    total += table[head + columns[k]] * np.float32(self.decay ** (k - i + 1))
                value[part] = total / np.sqrt(np.maximum(self_kernel(some, self.decay), 1e-6))
            np.maximum.at(out, owner + lo, value + self.bias)
        return out

    def text_features(self, texts: Sequence[str | None]) -> np.ndarray:
        """Rows of (1, log of marked sentences, marked words in a hundred, largest decision) for whole texts.

        A sentence that a window of a very long text cuts counts as two.
        """
        marked, words, sentences = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        most = np.full(len(texts), -2.0)
        for first, last, data, starts, old in pieces(texts):
            raw = np.frombuffer(data, dtype=np.uint8)
            begin, end = word_spans(raw)
            if old:
                begin, end = begin[begin >= old], end[begin >= old]
            if not len(begin):
                continue
            hashes = word_hashes(raw, begin, end)
            spelled = _spelled_out(raw, begin, end)
            unique, at, back = np.unique(hashes, return_index=True, return_inverse=True)
            value = np.array([self.known.get(h, np.nan) for h in unique.tolist()])
            new = np.flatnonzero(np.isnan(value))
            if len(new):
                spelt = [data[begin[i] : end[i]].decode("utf-8", "replace") for i in at[new]]
                value[new] = self.decide(spelt)
                if len(self.known) > 400_000:
                    self.known.clear()
                self.known.update(zip(unique[new].tolist(), value[new].tolist(), strict=True))
            each = value[back]
            if spelled:
                whole = self.decide([data[begin[i] : end[j - 1]].decode("utf-8", "replace").replace(" ", "") for i, j in spelled])
                for (i, _), v in zip(spelled, whole, strict=True):
                    each[i] = max(each[i], v)
            doc = np.searchsorted(starts, begin, side="right") - 1
            n = last - first
            head = sentence_starts(raw, begin, end, doc)
            bad = np.maximum.reduceat(each, head) > 0
            sentences[first:last] += np.bincount(doc[head], weights=bad, minlength=n)
            marked[first:last] += np.bincount(doc, weights=each > 0, minlength=n)
            words[first:last] += np.bincount(doc, minlength=n)
            np.maximum.at(most, doc + first, np.clip(each, -2, 2))
        return np.column_stack([np.ones(len(texts)), np.log1p(sentences), np.minimum(10, 100 * marked / np.maximum(words, 1)), most])

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.text_features(texts) @ self.final, -40, 40)))


def sentence_starts(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Numbers of the words that begin a sentence; no sentence goes on in another text."""
    last = end - 1
    # A closing quote or bracket may follow the stop.
    closing = np.isin(raw[last], np.frombuffer(b"\"')]}", dtype=np.uint8)) & (last > begin)
    stop = np.isin(raw[last - closing], np.array(sorted(_STOPS), dtype=np.uint8))
    return np.flatnonzero(np.concatenate(([True], stop[:-1] | (doc[1:] != doc[:-1]))))


def _sentences(texts: Sequence[str]) -> list[list[list[str]]]:
    """The sentences of each text as lists of words, bare of the punctuation around them."""
    out: list[list[list[str]]] = [[] for _ in texts]
    for first, _, data, starts, old in pieces([t.lower() for t in texts]):
        raw = np.frombuffer(data, dtype=np.uint8)
        begin, end = word_spans(raw)
        if old:
            begin, end = begin[begin >= old], end[begin >= old]
        if not len(begin):
            continue
        doc = np.searchsorted(starts, begin, side="right") - 1
        heads = sentence_starts(raw, begin, end, doc)
        words = [data[a:b].decode("utf-8", "replace").strip(_AROUND) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(words)], strict=True):
            out[first + int(doc[a])].append([w for w in words[a:b] if len(w) >= 3])
    return out


def _spelled_out(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Runs of at least four words of one character, one space apart: (first word, word after)."""
    single = (end - begin) == 1
    joined = single[1:] & single[:-1] & (begin[1:] - end[:-1] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).astype(np.int8)))
    return [(int(a), int(b) + 1) for a, b in zip(edge[0::2], edge[1::2], strict=True) if b - a >= 3]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penal = ridge * np.eye(x.shape[1])
    penal[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penal, x.T @ (weight * (p - y)) + penal @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton's method; the last column of x is 1."""
    w = np.zeros(x.shape[1])
    penal = ridge * np.eye(x.shape[1])
    penal[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        a = x[active] * weight[active, None]
        new = np.linalg.solve(a.T @ x[active] + penal, a.T @ y[active])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


#: Punctuation around a word.
_AROUND = "#$%&*,;:|\"'().!?"
#: Rounds of training, each with the sentences' worst words under the machine of the one before.
ROUNDS = 3
#: The most words of either kind that a round trains on, by weight: more sentences than these stand for is beyond a driver's dense matrix.
WITNESSES, HARD = 1000, 3000


def _unit(words: Sequence[str], decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(subsequence codes, weights, norm, word) of each window of the words."""
    rows, owner = encode(words)
    code, value = kernel_rows(rows, decay)
    return code, value, np.sqrt(np.maximum(self_kernel(rows, decay), 1e-6)), owner


def _fit_words(witness: Sequence[str], seen: Sequence[float], other: Sequence[str], common: Sequence[float], marks: Sequence[str], decay: float, ridge: float, before: Model | None) -> Model:
    """The machine for the worst words of toxic sentences against others, folded into a table by way of the Nystrom map on ``marks``.

    All windows of a long counterexample train; of a long witness, the worst window under the machine ``before``.
    """
    words = [*witness, *other]
    weight = np.array([*seen, *common], dtype=float) ** 0.5
    # A landmark is one window: the first of a long word.
    code, value, norm, owner = _unit(marks, decay)
    first = np.unique(owner, return_index=True)[1]
    code, value, norm = code[first], value[first], norm[first]
    dense = np.zeros((len(marks), SYMBOLS**3), dtype=np.float32)
    for k in range(len(marks)):
        np.add.at(dense[k], code[k], value[k] / norm[k])
    used = np.flatnonzero(dense.any(axis=0))
    small, place = np.ascontiguousarray(dense[:, used].T), np.full(SYMBOLS**3, -1)
    place[used] = np.arange(len(used))
    lam, u = np.linalg.eigh((small.T @ small).astype(float))
    whiten = u / np.sqrt(np.maximum(lam, 1e-3)) @ u.T
    x, whose = [], []
    for lo in range(0, len(words), 500):
        code, value, norm, owner = _unit(words[lo : lo + 500], decay)
        at = place[code]
        for k in range(len(code)):
            ok = (at[k] >= 0) & (value[k] > 0)
            x.append(value[k][ok] @ small[at[k][ok]] / norm[k])
            whose.append(owner[k] + lo)
    x, whose = np.array(x, dtype=float), np.array(whose)
    old = x @ before.alpha if before is not None and before.marks == tuple(marks) else -np.arange(len(x), dtype=float)
    order = np.lexsort((-old, whose))
    worst = np.zeros(len(x), dtype=bool)
    worst[order[np.unique(whose[order], return_index=True)[1]]] = True
    use = worst | (whose >= len(witness))
    x, whose = x[use], whose[use]
    target, weight = np.where(whose < len(witness), 1.0, -1.0), weight[whose]
    weight[target > 0] *= weight[target < 0].sum() / weight[target > 0].sum() * 0.5
    w = _machine(np.hstack([x @ whiten, np.ones((len(x), 1))]), target, weight, ridge)
    alpha = whiten @ w[:-1]
    table = np.zeros(SYMBOLS**3, dtype=np.float32)
    table[used] = small @ alpha
    return Model(table, float(w[-1]), np.zeros(4), decay, tuple(marks), alpha)


def train(texts: Sequence[str], labels: Sequence[int], *, share: float = 0.1, decay: float = 0.6, landmarks: int = 160, counterexamples: int = 8000, ridge: float = 1.0, seed: int = 5) -> Model:
    """Fit machine and final weights; ``share``: that of label 1 in the corpus. Without both labels, or without words: ``share`` for all."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.int64)
    nothing = Model(np.zeros(SYMBOLS**3, dtype=np.float32), -1.0, np.array([np.log(share / (1 - share)), 0, 0, 0]), decay)
    if not 0 < y.sum() < len(y):
        return nothing
    split = _sentences(texts)
    toxic, clean = Counter(), Counter()
    for sentences, label in zip(split, y, strict=True):
        (toxic if label else clean).update({w for s in sentences for w in s})
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = {w: np.log((k + 0.1) / (n1 + 1)) - np.log((clean[w] + 0.5) / (n0 + 1)) for w, k in toxic.items() if k >= max(3, 0.002 * n1)}
    favoured = sorted((w for w, o in odds.items() if o > 1.5), key=lambda w: (-toxic[w] * odds[w], w))
    harmless = sorted(w for w in clean if w not in set(favoured))
    if not favoured or not harmless:
        return nothing
    p = np.array([clean[w] for w in harmless], dtype=float) ** 0.25
    other = [harmless[i] for i in np.sort(rng.choice(len(harmless), min(counterexamples, len(harmless)), replace=False, p=p / p.sum()))]
    # Sentences as places in one list of all words; only sentences with words can be judged.
    words = sorted(set(toxic) | set(clean))
    number = {w: k for k, w in enumerate(words)}
    flat = [(t, [number[w] for w in s]) for t, sentences in enumerate(split) for s in sentences if s]
    text_of = np.array([t for t, _ in flat])
    heads = np.cumsum([0, *[len(s) for _, s in flat]])[:-1]
    inner, size = np.concatenate([s for _, s in flat]), np.array([len(s) for _, s in flat])
    may = np.array([(toxic[w] + 0.1) / (n1 + 1) > 1.5 * (clean[w] + 0.5) / (n0 + 1) for w in words])
    witness, hard = Counter({w: toxic[w] for w in favoured[:WITNESSES]}), Counter()
    model = None
    for turn in range(ROUNDS):
        if turn:
            value = model.decide(words)
            # A word that toxic texts don't favour makes no sentence toxic.
            chosen = np.where(may, value, -np.inf)
            bad = y[text_of] == 1
            each = np.where(np.repeat(bad, size), chosen[inner], value[inner])
            top = np.maximum.reduceat(each, heads)
            # The first word that has its sentence's decision.
            hit = np.flatnonzero(each == np.repeat(top, size))
            worst = inner[hit[np.searchsorted(hit, heads)]]
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, text_of, top)
            ones = bad & (top > -np.inf) & (top == best[text_of])
            witness = Counter(words[w] for w in worst[ones].tolist())
            taken = set(other)
            hard = Counter(words[w] for w in worst[~bad & (top > -0.3)].tolist()) | Counter({w: hard[w] for w in hard})
            hard = Counter({w: n for w, n in hard.items() if w not in taken})
        ranked = [w for w, _ in sorted(witness.items(), key=lambda x: (-x[1], x[0]))][:WITNESSES]
        wrong = [w for w, _ in sorted(hard.items(), key=lambda x: (-x[1], x[0]))][:HARD]
        marks = list(dict.fromkeys(ranked[: landmarks // 2] + wrong[: landmarks // 4] + other[: landmarks // 4]))
        model = _fit_words(ranked, [witness[w] for w in ranked], wrong + other, [1.0 + clean[w] for w in wrong + other], marks, decay, ridge, model)
    balance = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    model.final = _logistic(model.text_features(list(texts)), y.astype(float), balance)
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", modulus: int = 5, remainder: int = 0, rows: int = 1500, longest: int = 20_000) -> Model:
    """Fit on a bounded sample: at most ``rows`` texts of each class, of at most ``longest`` characters, outside the held-out fold."""
    texts, y, share = labelled_sample(docs, labels, label, modulus=modulus, remainder=remainder, rows=rows, longest=longest)
    return train(texts, y, share=share)


def score_toxicity(docs: DataFrame, model: Model, *, threshold: float = 0.5, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Score every whole text of ``docs``; keeps its columns and adds score, predicted and held_out.

    Clashing columns of those names are replaced. Null and empty texts get the
    score of no words. Null ids are not held out. Repeated rows are scored alike;
    an empty table gives an empty table.
    """
    docs = docs.drop("score", "predicted", "held_out")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()))

    score = F.pandas_udf(run, "double")
    scored = docs.withColumn("score", score(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
