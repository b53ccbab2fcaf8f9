"""Periodic runs of words, found on a Re-Pair grammar.

A run is a stretch of words with smallest period q, at least four periods and six words
long, that no neighbouring word extends. The texts of a block are paired together:

* A round counts all pairs of neighbouring symbols, never across texts, and replaces by a
  new nonterminal every repeated pair that is more frequent than the pairs it overlaps
  (ties by key; equal pairs in a row by turns). Rounds go on until no pair is found twice.
  Only pairs that still repeat or that a replacement has made are counted again. What is
  left of each text is paired off level by level, so that each text has one root.
* Each nonterminal is one stretch ``[s, e)`` with a boundary m, and is looked at once, at its
  first place. A run that crosses m has two periods on one side of it, so the pair of words
  there recurs one period away; only such distances are tried. Equal stretches are told by
  two rolling hashes modulo primes near 2^31 (62 bits together), ends found by halving.
  Periods that are powers of a smaller one are left to that.
* The runs of a nonterminal are copied to all places where the grammar derives it. Every
  run of a text crosses the boundary of the smallest node that contains it, hence is found
  whole; pieces of it that lie in other nodes merge into it, for they share its period and
  overlap it by at least one period.

A task holds one block of texts (about BLOCK_BYTES, a longer text by itself) and nothing is
shuffled. Time is about words x log words, at any number of repeats.

Defined results: a null text has no words and no runs; a null doc_id is passed on; repeated
rows each give their row; an empty table gives an empty result; other columns play no part;
the results do not depend on how texts are dealt to blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import blocks, column, pick, utf8

BLOCK_BYTES = 4 << 20
#: Fixed values of the run definition: periods and words that a run has at least.
PERIODS, WORDS = 4, 6
PRIMES = (2147483629, 2147483587)
BASES = (1103515249, 1299709601)
#: Candidates tried at once.
CANDIDATES = 1 << 21

RUNS = "array<struct<start: long, length: long, period: long>>"


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids, edges, words): a number for each word, where each text's words begin, and the words by number."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(flat, pa.scalar("", pa.large_string()))
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    coded = flat.filter(real).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), before[offsets - offsets[0]], coded.dictionary


class Hashes:
    """Tells whether stretches of a sequence are equal."""

    def __init__(self, ids: np.ndarray) -> None:
        self.sums, self.powers = [], []
        n = len(ids)
        for k, (p, base) in enumerate(zip(PRIMES, BASES, strict=True)):
            value = np.random.default_rng(k).integers(1, p, int(ids.max(initial=0)) + 1)[ids]
            powers = np.ones(n + 1, np.int64)
            done, step = 1, base
            while done <= n:  # as many again, each time
                more = min(done, n + 1 - done)
                powers[done : done + more] = powers[:more] * step % p
                done, step = done + more, step * step % p
            sums = np.zeros(n + 1, np.int64)
            np.cumsum(value * powers[:n] % p, out=sums[1:])
            self.sums.append(sums % p)
            self.powers.append(powers)

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from i on are those from j on; i < j."""
        same = np.ones(len(i), bool)
        for p, sums, powers in zip(PRIMES, self.sums, self.powers, strict=True):
            a, b, m = i[same], j[same], n[same]
            same[same] = (sums[a + m] - sums[a]) % p * powers[b - a] % p == (sums[b + m] - sums[b]) % p
        return same

    def longest(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from i and j on (before them, if ``back``) are equal, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            mid = (low[open_] + high[open_] + 1) // 2
            shift = mid if back else 0
            same = self.equal(i[open_] - shift, j[open_] - shift, mid)
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)
        return low


def grammar(ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rule, s, m, e) of every node above the words: its nonterminal, where it begins, its boundary and its end."""
    n = len(ids)
    sym, at = ids.astype(np.int64), np.arange(n)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    next_id = int(ids.max(initial=-1)) + 1
    nodes: list[tuple[np.ndarray, ...]] = []

    def replace(k: np.ndarray, rule: np.ndarray) -> np.ndarray:
        """Join the symbols at k with their right neighbours; returns what is left, by place."""
        nonlocal sym, at, text
        ends = np.append(at[1:], n)
        nodes.append((rule, at[k], at[k + 1], ends[k + 1]))
        sym[k] = rule
        left = np.ones(len(sym), bool)
        left[k + 1] = False
        sym, at, text = sym[left], at[left], text[left]
        return left

    hot = np.ones(max(n - 1, 0), bool)
    hot &= text[1:] == text[:-1]
    while (k := np.flatnonzero(hot)).size:
        key = sym[k] * (next_id + 1) + sym[k + 1]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        many = counts[inverse]
        k, inverse, many = k[many > 1], inverse[many > 1], many[many > 1]
        hot[:] = False
        if not len(k):
            break
        hot[k] = True
        # rank by count, then key; equal pairs in a row are taken by turns
        weight = many * (inverse.max() + 1) + inverse
        full = np.full(len(hot) + 2, -1, np.int64)
        full[k + 1] = weight
        before, after = full[k], full[k + 2]
        chain = np.flatnonzero(before != weight)
        turn = np.arange(len(k)) - np.repeat(chain, np.diff(np.append(chain, len(k))))
        chosen = (turn % 2 == 0) & (before <= weight) & (after <= weight)
        k, inverse = k[chosen], inverse[chosen]
        _, rule = np.unique(inverse, return_inverse=True)
        left = replace(k, next_id + rule)
        next_id += int(rule.max()) + 1
        moved = np.zeros(len(left) + 1, bool)
        moved[k] = True
        kept = np.flatnonzero(left)
        changed = moved[kept]
        still = np.append(hot, False)[np.where(changed, kept + 1, kept)]  # the pair that now begins here
        hot = still[:-1] & ~changed[:-1] & ~changed[1:] | changed[:-1] | changed[1:]
        hot &= text[1:] == text[:-1]
    while len(sym) > 1 and (text[1:] == text[:-1]).any():
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        place = np.arange(len(sym)) - np.repeat(first, np.diff(np.append(first, len(sym))))
        k = np.flatnonzero((place[:-1] % 2 == 0) & (text[1:] == text[:-1]))
        replace(k, next_id + np.arange(len(k)))
        next_id += len(k)
    if not nodes:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*nodes, strict=True))


def least_factors(n: int) -> np.ndarray:
    out = np.arange(n + 1)
    for p in range(2, int(n**0.5) + 1):
        if out[p] == p:
            rest = out[p * p :: p]
            rest[rest == np.arange(p * p, n + 1, p)] = p
    return out


def crossing(ids: np.ndarray, edges: np.ndarray, s: np.ndarray, m: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, start, end, period): runs of the stretches [s, e) that cross their boundaries m."""
    n = len(ids)
    none = tuple(np.empty(0, np.int64) for _ in range(4))
    if n < WORDS or not len(s):
        return none
    pair = np.full(n, -1, np.int64)  # the number of the pair of words that begins here
    inner = np.ones(n, bool)
    inner[edges[1:][edges[1:] > edges[:-1]] - 1] = False
    i = np.flatnonzero(inner)
    pair[i] = np.unique(ids[i] * (int(ids.max()) + 1) + ids[i + 1], return_inverse=True)[1]
    i = i[np.argsort(pair[i], kind="stable")]
    line = pair[i] * (n + 1) + i  # all pairs by number, then place
    where = np.zeros(n, np.int64)
    where[i] = np.arange(len(i))
    h, factor = Hashes(ids), least_factors(int((e - s).max()) // PERIODS + 1)
    found = [none]
    for right in (True, False):
        most = np.minimum((e - m if right else m - s) // 2, (e - s) // PERIODS)
        own = np.flatnonzero((most > 0) & ((e - s) >= WORDS) & ((e - m if right else m - s) >= 2))
        b = m[own] if right else m[own] - 2
        here = where[b]
        if right:
            low, high = here + 1, np.searchsorted(line, pair[b] * (n + 1) + b + most[own], "right")
        else:
            low, high = np.searchsorted(line, pair[b] * (n + 1) + b - most[own], "left"), here
        sizes = np.maximum(high - low, 0)
        upto = np.cumsum(sizes)
        begin = 0
        while begin < len(own):
            done = upto[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(upto, done + CANDIDATES, "right")))
            size = sizes[begin:stop]
            node = np.repeat(own[begin:stop], size)
            other = i[np.repeat(low[begin:stop], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            q = np.abs(other - np.repeat(b[begin:stop], size))
            begin = stop
            twice = m[node] if right else m[node] - 2 * q  # where the two periods beside the boundary begin
            ok = h.equal(twice, twice + q, q)
            node, q, twice = node[ok], q[ok], twice[ok]
            whole, rest = np.ones(len(q), bool), q.copy()
            while (rest > 1).any():
                p = np.where(rest > 1, factor[rest], 1)
                test = np.flatnonzero(whole & (rest > 1))
                whole[test] = ~h.equal(twice[test], twice[test] + q[test] // p[test], q[test])
                rest = np.where(whole, rest // p, 1)
            node, q = node[whole], q[whole]
            a = m[node] if right else m[node] - q
            t = h.longest(a, a + q, e[node] - q - a, False)
            u = h.longest(a, a + q, a - s[node], True)
            long_ = (u + q + t >= np.maximum(WORDS, PERIODS * q)) & (a - u < m[node])
            found.append(tuple(x[long_] for x in (node, a - u, a + q + t, q)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that overlap by at least it become one; by start, then period."""
    if not len(start):
        return start, end, period
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]]))
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(group * wide + end) - group * wide
    head = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1] - period[1:])])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(start)) - 1
    out = start[first], reach[last], period[first]
    order = np.lexsort((out[2], out[0]))
    return tuple(x[order] for x in out)


def find_runs(ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the texts ids[edges[i]:edges[i + 1]], by start, then period."""
    rule, s, m, e = grammar(ids, edges)
    once = np.unique(rule, return_index=True)[1]
    node, start, end, period = crossing(ids, edges, s[once], m[once], e[once])
    if not len(node):
        return start, end, period
    # to every place of the nonterminals that have runs
    order = np.argsort(rule[once[node]], kind="stable")
    node, start, end, period = node[order], start[order], end[order], period[order]
    name = rule[once[node]]
    places = np.flatnonzero(np.isin(rule, name))
    low, high = np.searchsorted(name, rule[places], "left"), np.searchsorted(name, rule[places], "right")
    size = high - low
    run = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    shift = np.repeat(s[places], size) - s[once[node]][run]
    return merged(start[run] + shift, end[run] + shift, period[run])


def kept_words(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay when each run is cut down to its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth)[:n] == 0


#: Given the ids of a block and its texts' word counts: for each text the places its words are read from, or None.
Rewrite = Callable[[list, np.ndarray], list]


def runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs by start, then period, and the text without the repeats.

    collapsed: the words that are not in a run after its first period, joined by blanks.
    rewrite: reads the words of some texts from other places first.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = column(batch, "text"), column(batch, "doc_id")
            for i, j in blocks(utf8(texts)[1], BLOCK_BYTES):
                yield block(names.slice(i, j - i), texts.slice(i, j - i))

    def block(names: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ids, edges, words = word_ids(texts)
        n = np.diff(edges)
        if rewrite is not None:
            for k, at in enumerate(rewrite(names.to_pylist(), n)):
                if at is not None:
                    own = ids[edges[k] : edges[k + 1]]
                    own[:] = own[at]
        start, end, period = find_runs(ids, edges)
        keep = kept_words(len(ids), start, end, period)
        left = np.concatenate([[0], np.cumsum(keep)])[edges]
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left), words.take(pa.array(ids[keep]))), pa.scalar(" ", pa.large_string()))
        cuts = np.searchsorted(start, edges)
        of = np.repeat(np.arange(len(n)), np.diff(cuts))
        fields = [pa.array(start - edges[of]), pa.array(end - start), pa.array(period)]
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        return pa.RecordBatch.from_arrays([names, pa.array(n), lists, text.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    return pick(docs, "doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")
