"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters that occurs in a text with at most k edits shares at
least m - q + 1 - k*q of its q-grams with it, and their diagonals (place in the
text less place in the passage) lie within k of each other. So q-gram hits are
counted in diagonal bands as wide as the next power of two above k, each running k
diagonals into the next; a band with enough hits for the passage's edit budget is
a region, and a banded alignment of passage and region decides.

Rulers, tables and other repetitions have grams that stand at many places of text
and passage alike. Equal grams in a row are one run on either side, and what two
runs add to a band is an interval length; a passage's hits are counted slice by
slice, at most SLICE at a time, so memory depends on neither the text nor on how
often a gram repeats. Equal passages are one, and regions with equal contents are
aligned once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; fewer for passages so short that their edits could touch every gram of that size.
Q = 8
#: Share of a passage's characters that edits may touch.
RATE = 0.1
#: Characters of passages that one pass over the texts looks for; a larger benchmark takes more passes.
PASS_CHARS = 2_000_000
#: The most characters of a benchmark, as the driver reads it.
MOST_CHARS = 200_000_000
#: Characters of text handled together; a longer text is cut into overlapping segments.
SEGMENT = 1 << 20
#: Run pairs and bands counted, and cells aligned, at a time.
SLICE = 1 << 18
#: Hits of a passage beyond which its rare short grams are looked at first, and the size of those.
HOT, SHORT = 20_000, 4
_GAP = re.compile(r"[ \t\n\r]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 21


def normal(text: str | None) -> str:
    """Lower case, white space as single spaces, trimmed."""
    text = text or ""
    if len(text) <= SEGMENT:
        return " ".join(text.lower().split())
    parts, at = [], 0
    while at < len(text):
        # Cut at white space, so that no word is lower-cased in two parts.
        gap = _GAP.search(text, at + SEGMENT)
        end = gap.start() if gap else len(text)
        parts.append(" ".join(text[at:end].lower().split()))
        at = end
    return " ".join(filter(None, parts))


def _bytes(text: str) -> bytes:
    """A byte for each character, its low eight bits; different characters may share one, which only adds regions to align."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") & 0xFF).astype(np.uint8).tobytes()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)


def _grams(data: bytes, q: int = Q) -> np.ndarray:
    """The grams of q bytes at each place of data, which ends in Q bytes of padding."""
    n = len(data) - Q + 1
    every = np.ndarray((max(n, 0),), dtype="<u8", buffer=data, strides=(1,)) if n > 0 else np.empty(0, dtype="<u8")
    return every if q == Q else every & np.uint64((1 << 8 * q) - 1)


def _runs(values: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal values (and, with ``more``, equal in those too)."""
    fresh = np.ones(len(values), dtype=bool)
    if len(values):
        fresh[1:] = values[1:] != values[:-1]
        for other in more:
            fresh[1:] |= other[1:] != other[:-1]
    first = np.flatnonzero(fresh)
    return first, np.diff(np.append(first, len(values)))


def _spread(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts: the owner of each of their units, and the unit's number with its owner."""
    owner = np.repeat(np.arange(len(many)), many)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, count
    order = np.argsort(key, kind="stable")
    key = key[order]
    first, _ = _runs(key)
    return key[first], np.add.reduceat(count[order], first)


def aligned(passage: np.ndarray, windows: np.ndarray, width: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of the passage against stretches of each window (a row) that begin in its first ``width`` places, and their ends.

    The alignment stays on these ``width`` diagonals. Windows that cannot keep to
    the budget get budget + 1 and are left as soon as that is certain.
    """
    m, at = len(passage), np.arange(width, dtype=np.int32)
    edits, end = np.full(len(windows), budget + 1, dtype=np.int64), np.zeros(len(windows), dtype=np.int64)
    alive = np.arange(len(windows))
    row = np.zeros((len(windows), width), dtype=np.int32)
    for i in range(m):
        down = np.full_like(row, budget + m)
        down[:, :-1] = row[:, 1:] + 1
        row = np.minimum(row + (windows[:, i : i + width] != passage[i]), down)
        row = np.minimum.accumulate(row - at, axis=1) + at
        if i % 8 == 7 or len(alive) == 1:
            fine = row.min(axis=1) <= budget
            if not fine.all():
                alive, row, windows = alive[fine], row[fine], windows[fine]
                if not len(alive):
                    return edits, end
    best = row.argmin(axis=1)
    least = row[np.arange(len(alive)), best]
    edits[alive] = np.minimum(least, budget + 1)
    end[alive] = m + best
    return edits, end


def _windows(text: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``size`` codes from each start on, -1 outside of the text."""
    at = starts[:, None] + np.arange(size)
    out = text[np.clip(at, 0, max(0, len(text) - 1))] if len(text) else np.zeros(at.shape, dtype=np.int32)
    out[(at < 0) | (at >= len(text))] = -1
    return out


def banded_distance(passage: np.ndarray, text: np.ndarray, start: int, width: int, budget: int) -> tuple[int, int]:
    """Least edits of the passage against a stretch of the text that begins on one of ``width`` diagonals from ``start`` on.

    Returns (edits, end of that stretch), or (budget + 1, 0) if none can keep to the budget.
    """
    edits, end = aligned(np.asarray(passage), _windows(np.asarray(text), np.array([start]), len(passage) + width), width, budget)
    return (int(edits[0]), max(0, start + int(end[0]))) if edits[0] <= budget else (budget + 1, 0)


def _short(data: bytes) -> np.ndarray:
    """A 16-bit hash value of the short gram at each place."""
    grams = np.ndarray((max(0, len(data) - SHORT + 1),), dtype="<u4", buffer=data, strides=(1,)).astype(np.uint32)
    return ((grams * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)


class _Index:
    """Runs of equal q-grams of passages that have one gram size."""

    def __init__(self, q: int, members: np.ndarray, data: list[bytes], longest: int, budget: np.ndarray) -> None:
        self.q, self.longest = q, longest
        parts = [_grams(d + bytes(Q), q)[: len(d) - q + 1] for d in data]
        runs = [_runs(g) for g in parts]
        flat = np.concatenate([g[first] for g, (first, _) in zip(parts, runs, strict=True)])
        order = np.argsort(flat, kind="stable")
        self.gram, self.slot = np.unique(flat[order], return_inverse=True)
        self.owner = np.repeat(members, [len(first) for first, _ in runs])[order]
        self.place = np.concatenate([first for first, _ in runs])[order]
        self.length = np.concatenate([length for _, length in runs])[order]
        self.band = np.array([1 << int(k).bit_length() for k in budget], dtype=np.int64)
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[(self.gram * _MIX) >> np.uint64(64 - _BITS)] = True

    def regions(self, data: bytes, starts: np.ndarray, budget: np.ndarray, least: np.ndarray, possible: np.ndarray, fine: Callable[[int], bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, passage, band) with enough hits; ``starts`` are the texts' places in ``data``, ``possible`` tells which passages to look for, ``fine`` is a further test of those with very many hits."""
        grams = _grams(data, self.q)
        at = np.flatnonzero(self.seen[(grams * _MIX) >> np.uint64(64 - _BITS)])
        slot = np.minimum(np.searchsorted(self.gram, grams[at]), len(self.gram) - 1)
        ok = self.gram[slot] == grams[at]
        at, slot = at[ok], slot[ok]
        none = (np.empty(0, np.int64),) * 3
        if not len(at):
            return none
        text = np.searchsorted(starts, at, side="right") - 1
        first, length = _runs(slot, text, at - np.arange(len(at)))
        at, slot, text = at[first], slot[first], text[first]
        by_slot = np.argsort(slot, kind="stable")
        at, slot, text, length = at[by_slot], slot[by_slot], text[by_slot], length[by_slot]
        bounds = np.searchsorted(slot, np.arange(len(self.gram) + 1))
        many = np.diff(bounds)
        total = np.concatenate(([0], np.cumsum(length)))
        entries = np.flatnonzero(possible[self.owner] & (many[self.slot] > 0))
        if not len(entries):
            return none
        mine = self.slot[entries]
        # A pair of runs meets about so many bands.
        cost = self._cost(entries, mine, many, bounds, total)
        by_owner = np.bincount(self.owner[entries], weights=cost, minlength=len(possible))
        for i in np.flatnonzero(by_owner > HOT).tolist():
            possible[i] = fine(i)
        entries = entries[possible[self.owner[entries]]]
        if not len(entries):
            return none
        cost = self._cost(entries, self.slot[entries], many, bounds, total)
        by_owner = np.bincount(self.owner[entries], weights=cost, minlength=len(possible))
        # Passages are taken together until their hits fill a slice; the hits of one passage alone may take several.
        part = np.floor(np.concatenate(([0], np.cumsum(by_owner)))[:-1] / SLICE).astype(np.int64)
        order = np.argsort(part[self.owner[entries]], kind="stable")
        entries, cost = entries[order], cost[order]
        cuts, size = _runs(part[self.owner[entries]])
        bands = len(data) + 2 * self.longest + 2
        out = []
        for lo, hi in zip(cuts, cuts + size, strict=True):
            key, count = np.empty(0, np.int64), np.empty(0, np.int64)
            for some, run_lo, run_hi in self._jobs(entries[lo:hi], cost[lo:hi], many, bounds):
                pair, inner = _spread(run_hi - run_lo)
                entry, run = some[pair], run_lo[pair] + inner
                item = self.owner[entry]
                band, reach = self.band[item], self.band[item] + budget[item]
                t0, t1 = at[run] - starts[text[run]] + self.longest, at[run] - starts[text[run]] + self.longest + length[run] - 1
                p0, p1 = self.place[entry], self.place[entry] + self.length[entry] - 1
                low = (t0 - p1 - reach) // band + 1
                unit, step = _spread((t1 - p0) // band - low + 1)
                b = low[unit] + step
                edge = b * band[unit]
                places = np.minimum(p1[unit], t1[unit] - edge) - np.maximum(p0[unit], t0[unit] - edge - reach[unit] + 1) + 1
                new = _summed((text[run][unit] * len(possible) + item[unit]) * bands + b + 1, places)
                key, count = _summed(np.concatenate((key, new[0])), np.concatenate((count, new[1]))) if len(key) else new
            rest, band = np.divmod(key, bands)
            t, i = np.divmod(rest, len(possible))
            keep = count >= least[i]
            out.append((t[keep], i[keep], band[keep] - 1))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _cost(self, entries: np.ndarray, slot: np.ndarray, many: np.ndarray, bounds: np.ndarray, total: np.ndarray) -> np.ndarray:
        band = self.band[self.owner[entries]]
        return many[slot] * (3 + self.length[entries] // band) + (total[bounds[slot + 1]] - total[bounds[slot]]) // band

    def _jobs(self, entries: np.ndarray, cost: np.ndarray, many: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(entries, first run, run after) of about SLICE pairs and bands each; an entry with more is split by its runs."""
        pieces = 1 + cost // SLICE
        owner, piece = _spread(pieces)
        lo, runs = bounds[self.slot[entries]], many[self.slot[entries]]
        share = -(-runs // pieces)
        first = lo[owner] + np.minimum(piece * share[owner], runs[owner])
        after = lo[owner] + np.minimum((piece + 1) * share[owner], runs[owner])
        cuts, size = _runs(np.cumsum(cost[owner] / pieces[owner]) // SLICE)
        for a, b in zip(cuts, cuts + size, strict=True):
            yield entries[owner[a:b]], first[a:b], after[a:b]


class Passages:
    """q-gram index of passages, with their edit budgets. Equal passages are one with several ids."""

    def __init__(self, ids: Sequence[int | None], texts: Sequence[str | None], rate: float = RATE, shortest: int = 1) -> None:
        held: dict[str, list[int | None]] = {}
        for i, t in zip(ids, map(normal, texts), strict=True):
            if len(t) >= max(1, shortest):
                held.setdefault(t, []).append(i)
        self.texts, self.ids = list(held), list(held.values())
        self.codes = [_codes(t) for t in self.texts]
        sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.budget = (sizes * rate).astype(np.int64)
        # The largest gram up to Q of which the lemma leaves one, whatever the edits.
        grams = np.minimum(Q, sizes // (self.budget + 1))
        self.least = sizes - grams + 1 - self.budget * grams
        self.longest = int(sizes.max(initial=0))
        data = [_bytes(t) for t in self.texts]
        self.band = np.array([1 << int(k).bit_length() for k in self.budget], dtype=np.int64)
        self.index = []
        for q in sorted(set(grams.tolist())):
            members = np.flatnonzero(grams == q)
            self.index.append(_Index(q, members, [data[i] for i in members], self.longest, self.budget))
        self.letters = np.array([np.bincount(np.frombuffer(d, dtype=np.uint8), minlength=256) for d in data]).reshape(len(data), 256)
        #: Characters that an occurrence may spread over, and so the overlap of a long text's segments.
        self.reach = int((sizes + 2 * (self.band + self.budget)).max(initial=0))

    def regions(self, data: bytes, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, passage, band) with enough hits; ``starts`` are the texts' places in ``data``."""
        have = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) > 0
        # Each character that no text has needs an edit.
        possible = self.letters @ ~have <= self.budget
        short = _short(data) if len(data) > SHORT else np.empty(0, np.int64)

        def fine(i: int) -> bool:
            rare, need = self.rare(i)
            if need <= 0:
                return True
            size = len(self.texts[i]) + int(self.band[i] + self.budget[i])
            sums = np.concatenate(([0], np.cumsum(rare[short], dtype=np.int32)))
            most = sums[-1] if len(short) <= size else (sums[size:] - sums[:-size]).max()
            return bool(most >= need)

        for index in self.index:
            yield index.regions(data, starts, self.budget, self.least, possible, fine)

    def rare(self, i: int) -> tuple[np.ndarray, int]:
        """The passage's short grams that repeat at most once in it, and how many places with one of them any occurrence has.

        By the lemma again: of all its places with a short gram so many survive the
        edits, and at most all those with other short grams are among them.
        """
        grams = _short(_bytes(self.texts[i]) + bytes(SHORT))[: max(0, len(self.texts[i]) - SHORT + 1)]
        many = np.bincount(grams, minlength=1 << 16)
        rare = (many > 0) & (many <= 2)
        return rare, len(grams) - int(self.budget[i]) * SHORT - int(many[~rare].sum())

    def _best(self, held: list[str], parts: list[bytes], starts: list[int]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, passage) -> (edits, start, end) of the best place."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        code: dict[int, np.ndarray] = {}
        for texts, items, bands in self.regions(b"".join(parts), np.array(starts, dtype=np.int64)):
            order = np.lexsort((bands, texts, items))
            texts, items, bands = texts[order], items[order], bands[order]
            cuts, size = _runs(items, texts)
            inexact = np.zeros(len(texts), dtype=bool)
            for lo, hi in zip(cuts, cuts + size, strict=True):
                t, i = int(texts[lo]), int(items[lo])
                exact = held[t].find(self.texts[i])
                if exact >= 0:
                    best[t, i] = (0, exact, exact + len(self.texts[i]))
                else:
                    inexact[lo:hi] = True
                    if t not in code:
                        code[t] = _codes(held[t])
            texts, items, bands = texts[inexact], items[inexact], bands[inexact]
            cuts, size = _runs(items, texts)
            for lo, hi in zip(cuts, cuts + size, strict=True):
                t, i = int(texts[lo]), int(items[lo])
                at = bands[lo:hi] * int(self.band[i]) - self.longest
                found = self._align(i, code[t], self._dense(i, held[t], at) if hi - lo > 16 else at)
                if found is not None:
                    best[t, i] = found
        return best

    def _dense(self, i: int, text: str, starts: np.ndarray) -> np.ndarray:
        """Those of the regions that hold enough of the passage's rare short grams."""
        rare, need = self.rare(i)
        sums = np.concatenate(([0], np.cumsum(rare[_short(_bytes(text))], dtype=np.int32)))
        size = len(self.texts[i]) + int(self.band[i] + self.budget[i])
        return starts[sums[np.clip(starts + size, 0, len(sums) - 1)] - sums[np.clip(starts, 0, len(sums) - 1)] >= need]

    def _align(self, i: int, text: np.ndarray, starts: np.ndarray) -> tuple[int, int, int] | None:
        """Best place of a passage among regions from ``starts`` (ascending) on."""
        width, budget = int(self.band[i] + self.budget[i]), int(self.budget[i])
        size = len(self.codes[i]) + width
        best = None
        seen: dict[int, None] = {}
        for lo in range(0, len(starts), step := max(1, SLICE // size)):
            some = starts[lo : lo + step]
            windows = _windows(text, some, size)
            if len(starts) > 16:
                # Regions with equal contents give equal edits: the first stands for all.
                rng = np.random.default_rng(size)
                name = (windows.astype(np.uint64) * rng.integers(1, 1 << 63, size, dtype=np.uint64)).sum(axis=1)
                _, first = np.unique(name, return_index=True)
                first = np.sort(first)
                first = first[[h not in seen for h in name[first].tolist()]]
                seen.update(dict.fromkeys(name[first].tolist()))
                some, windows = some[first], windows[first]
            edits, end = aligned(self.codes[i], windows, width, budget)
            for k in np.flatnonzero(edits <= budget).tolist():
                at = int(some[k])
                place = (int(edits[k]), max(0, at), min(max(0, at + int(end[k])), len(text)))
                best = place if best is None else min(best, place)
        return best

    def find(self, texts: Sequence[str | None]) -> list[list[list[int | None]]]:
        """For each text, [passage id, start, end, edits] of each passage in it, in the passages' order: its best place in the normal text."""
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        held: list[str] = []
        whose: list[tuple[int, int]] = []
        parts: list[bytes] = []
        starts: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for (t, i), (edits, start, end) in self._best(held, parts, starts).items():
                owner, offset = whose[t]
                place = (edits, start + offset, end + offset)
                best[owner][i] = min(best[owner].get(i, place), place)
            held.clear(), parts.clear(), starts.clear(), whose.clear()
            size = 0

        for k, text in enumerate(texts):
            plain = normal(text)
            for at in range(0, max(1, len(plain)), SEGMENT):
                piece = plain[at : at + SEGMENT + self.reach]
                held.append(piece), whose.append((k, at)), starts.append(size)
                parts.append(_bytes(piece) + bytes(Q))
                size += len(piece) + Q
                if size > SEGMENT:
                    flush()
        flush()
        return [[[i, start, end, edits] for p, (edits, start, end) in sorted(found.items()) for i in self.ids[p]] for found in best]


def _matcher(passages: Passages):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(passages.find(texts.tolist()), dtype=object)

    return F.pandas_udf(run, "array<array<bigint>>")


def find_passages(docs: DataFrame, benchmark: DataFrame, *, rate: float = RATE, shortest: int = 1, pass_chars: int = PASS_CHARS, most_chars: int = MOST_CHARS) -> DataFrame:
    """Benchmark passages in the whole texts of ``docs`` (text, ...).

    Keeps the columns of ``docs`` and adds contaminated (boolean) and matches
    (array of passage id, start, end, edits; places in the text in lower case with
    single spaces). A passage occurs in a text if a stretch of it differs by at most
    ``rate`` of the passage's characters, rounded down. Clashing columns are
    replaced. Passages of fewer than ``shortest`` characters, empty or null ones are
    never found; null ids are reported as null, an id that repeats for each of its
    passages that occurs; null and empty texts hold nothing. Repeated rows are
    handled alike. An empty benchmark finds nothing and an empty table gives an
    empty table.

    The benchmark is held in blocks of about ``pass_chars`` characters, whatever its
    size: each block is one more scalar function over the texts, so a worker's index
    is bounded. The driver keeps all blocks until the plan has run, and so is bounded
    by the benchmark, never by the texts; a benchmark of more than ``most_chars``
    characters is refused, as the driver could not hold it.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if total > most_chars:
        raise ValueError(f"the benchmark has {total} characters, more than most_chars")
    blocks = max(1, -(-int(total) // pass_chars))
    found: list[Column] = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        found.append(_matcher(Passages([r[0] for r in rows], [r[1] for r in rows], rate, shortest))(F.col("text")))
    out = docs.drop("contaminated", "matches").withColumn("matches", found[0])
    for more in found[1:]:
        out = out.withColumn("matches", F.concat("matches", more))
    return out.withColumn("contaminated", F.size("matches") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kind) -> DataFrame:
    """The rows of ``docs`` whose texts hold no passage, with the columns they had, whatever their names."""
    own = [f"`{c}`" for c in docs.columns]
    packed = docs.select("text", F.struct(*own).alias("row"))
    return find_passages(packed, benchmark, **kind).where(~F.col("contaminated")).select("row.*")
