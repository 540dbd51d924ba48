"""Periodic runs: maximal stretches of words that repeat with a smallest
period, found with suffix-tree longest common extensions.

Per text, words are numbered and a suffix tree is built online (Ukkonen) of
the sequence and of its reversal. An Euler tour of each tree with range minima
over its depths answers the longest common extension of two positions, forward
and backward, in constant time. The order of the leaves gives for every
position the longest Lyndon word that starts there, under the order of the
words and under its inverse; each is a candidate root, extended in both
directions. A run is where root and extensions hold two periods; every run has
such a root (Bannai et al., 2017), so the candidates are complete and linear
in number.

Only stretches that can hold a run enter the trees: every word of a run of
``least`` words or more lies in a ``least / 2``-word window that occurs twice in
the text, so a maximal stretch of words under repeated windows holds each of
its runs whole. Stretches of many texts, with a separator of its own after
each, share one tree up to ``BATCH`` words; a longer one has its own. Memory
follows BATCH or the longest single stretch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystack.llm import arrays as A
from tallystack.llm.common import prepare, two_columns

BATCH = 1 << 15
INNER = 16                     # tour entries per block of the range minima
RUNS = "array<struct<start:long,period:long,length:long>>"


class SuffixTree:
    """Ukkonen's suffix tree of a list of integers >= 1, closed by a 0."""

    def __init__(self, symbols):
        s = self.s = [*symbols, 0]
        n = self.n = len(s)
        width = self.width = max(s) + 1
        # node 0 is the root; the edge into a node covers s[start:end] (leaves: to the end)
        start, end, link, edges = [0], [0], [0], {}
        node, edge, length, open_ = 0, 0, 0, 0
        for i, c in enumerate(s):
            open_ += 1
            last = 0
            while open_:
                if not length:
                    edge = i
                key = node * width + s[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    a = start[child]
                    b = end[child]
                    size = (b if b < i + 1 else i + 1) - a
                    if length >= size:                      # walk down
                        edge += size
                        length -= size
                        node = child
                        continue
                    if s[a + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    mid = len(start)                        # split, then a new leaf
                    start += [a, i]
                    end += [a + length, n]
                    link += [0, 0]
                    edges[key] = mid
                    edges[mid * width + c] = mid + 1
                    start[child] = a + length
                    edges[mid * width + s[a + length]] = child
                    if last:
                        link[last] = mid
                    last = mid
                open_ -= 1
                if node == 0 and length:
                    length -= 1
                    edge = i - open_ + 1
                elif node:
                    node = link[node]
        self._tour(np.array(start), np.array(end), edges)

    def _tour(self, start, end, edges):
        """Depths along the Euler tour, children in symbol order, and where
        each suffix's leaf stands in it."""
        n, m = self.n, len(start)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        child = np.fromiter(edges.values(), np.int64, len(edges))
        parent = keys // self.width
        order = np.argsort(keys)                            # by parent, then symbol
        child, parent = child[order], parent[order]
        begin = np.searchsorted(parent, np.arange(m + 1)).tolist()
        child = child.tolist()
        size, leaf = (end - start).tolist(), (end == n).tolist()
        tour, depth_of, first = [0], [0] * m, [0] * n
        stack, at = [0], begin[:-1]
        while stack:
            v = stack[-1]
            k = at[v]
            if k < begin[v + 1]:
                at[v] = k + 1
                u = child[k]
                d = depth_of[v] + size[u]
                depth_of[u] = d
                if leaf[u]:                                 # there and back
                    first[n - d] = len(tour)
                    tour += (d, depth_of[v])
                else:
                    tour.append(d)
                    stack.append(u)
            else:
                stack.pop()
                if stack:
                    tour.append(depth_of[stack[-1]])
        self.first = np.array(first)
        pad = -len(tour) % INNER
        flat = np.array(tour + [n + 1] * pad, np.int32)
        rows = flat.reshape(-1, INNER)
        self.flat = flat
        self.head = np.minimum.accumulate(rows, axis=1).ravel()             # least up to here in the block
        self.tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        levels = [rows.min(axis=1)]
        while 2 << len(levels) - 1 <= len(levels[0]):
            half, last = 1 << len(levels) - 1, levels[-1]
            levels.append(np.minimum(last[:len(last) - half], last[half:]))
        self.levels = levels

    def ranks(self):
        """Place of every suffix in the order of all suffixes."""
        r = np.empty(self.n, np.int64)
        r[np.argsort(self.first)] = np.arange(self.n)
        return r

    def common(self, i, j):
        """Lengths of the longest common prefixes of suffixes i and j (arrays,
        i and j different): depth of the lowest common ancestor, the least
        depth between the two leaves on the tour."""
        x, y = self.first[i], self.first[j]
        x, y = np.minimum(x, y), np.maximum(x, y)
        p, q = x // INNER, y // INNER
        out = np.minimum(self.tail[x], self.head[y])
        far = np.flatnonzero(q - p > 1)
        if len(far):
            lo, hi = p[far] + 1, q[far]                     # whole blocks lo..hi-1
            lv = np.frexp(hi - lo)[1] - 1
            for v in np.unique(lv):
                k = lv == v
                t = self.levels[v]
                out[far[k]] = np.minimum(out[far[k]], np.minimum(t[lo[k]], t[hi[k] - (1 << int(v))]))
        near = np.flatnonzero(p == q)
        if len(near):
            a, b = x[near], y[near]
            least = self.flat[a].copy()
            for step in range(1, INNER):
                least = np.where(a + step <= b, np.minimum(least, self.flat[np.minimum(a + step, len(self.flat) - 1)]), least)
            out[near] = least
        return out


def next_smaller(rank):
    """For every position the next one with a smaller rank (none: the length)."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(symbols, least: int = 2):
    """Sorted arrays (start, end, period) of all runs of at least ``least``
    and two periods in a list of integers >= 1."""
    n = len(symbols)
    if n < 2:
        return (np.empty(0, np.int64),) * 3
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    rank = ahead.ranks()[:n].tolist()
    i = np.concatenate([np.arange(n)] * 2)
    j = np.concatenate([next_smaller(rank), next_smaller([-r for r in rank])])
    i, j = i[j < n], j[j < n]
    p = j - i
    end = j + ahead.common(i, j)
    start = i.copy()
    inner = np.flatnonzero(i > 0)
    # the word before position i is word n - i of the reversal
    start[inner] -= back.common(n - i[inner], n - j[inner])
    good = end - start >= np.maximum(2 * p, least)
    found = np.unique(np.stack([start[good], p[good], end[good]]), axis=1)
    return found[0], found[2], found[1]


def stretches(h, text, window: int):
    """(first, end) of the maximal runs of words covered by ``window``-word
    windows that occur again in the same text."""
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    g, c = h.copy(), np.uint64(0xFF51AFD7ED558CCD)
    with np.errstate(over="ignore"):
        for k in range(1, window):
            g = A.mix(g[:-1] * c + h[k:])
        g = g ^ A.mix(text[:len(g)].astype(np.uint64) + np.uint64(1))
    ok = np.flatnonzero(text[:len(g)] == text[window - 1:])
    order = ok[np.argsort(g[ok], kind="stable")]
    same = g[order][1:] == g[order][:-1]
    edge = np.zeros(len(h) + 1, np.int64)
    hit = np.zeros(len(g), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.cumsum(edge)[:-1] > 0
    # a stretch ends where cover ends or the text changes
    first = np.flatnonzero(covered & np.concatenate([[True], ~covered[:-1] | (text[1:] != text[:-1])]))
    last = np.flatnonzero(covered & np.concatenate([~covered[1:] | (text[1:] != text[:-1]), [True]]))
    return first, last + 1


def _solve(todo, least, out):
    """Runs of the stretches ``todo`` [(text, first word, words)] in one tree."""
    code, flat, base = {}, [], []
    for _t, _f, w in todo:
        base.append(len(flat))
        flat += [code.setdefault(x, len(code) + 1) for x in w]
        flat.append(-len(base))
    gaps = len(code)
    flat = [x if x > 0 else gaps - x for x in flat]          # separators come after all words, each its own
    base = np.array(base)
    for s, e, p in zip(*runs_of(flat, least)):
        k = int(np.searchsorted(base, s, "right")) - 1
        text, first, _w = todo[k]
        out[text].append((int(s - base[k] + first), int(p), int(e - s)))


def find_runs(raw, least: int):
    """For each UTF-8 text its words and its sorted runs (start, period, length)."""
    out = [[] for _ in raw]
    all_words = [None] * len(raw)
    todo, size = [], 0
    for i, j in A.blocks(raw, A.BLOCK):
        h, text, s, e = A.words(raw[i:j], lower=False)
        data = b"\n".join([*raw[i:j], b""])
        cut = np.searchsorted(text, np.arange(j - i + 1))
        spans = list(zip(s.tolist(), e.tolist()))
        for k in range(j - i):
            all_words[i + k] = [data[a:b] for a, b in spans[cut[k]:cut[k + 1]]]
        for a, b in zip(*stretches(h, text, least // 2)):
            t = int(text[a])
            if b - a < least:
                continue
            todo.append((i + t, int(a - cut[t]), all_words[i + t][a - cut[t]:b - cut[t]]))
            size += int(b - a) + 1
            if size >= BATCH:
                _solve(todo, least, out)
                todo, size = [], 0
    if todo:
        _solve(todo, least, out)
    for x in out:
        x.sort()
    return all_words, out


def collapse(words, runs):
    """The words left when every run keeps its first period, joined by a space."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for s, p, n in runs:
            edge[s + p] += 1
            edge[s + n] -= 1
        words = [w for w, k in zip(words, np.cumsum(edge)[:-1]) if not k]
    return b" ".join(words).decode("utf-8")


def _scan(least):
    def run(frames):
        for pdf in frames:
            raw = [x.encode("utf-8") for x in pdf["text"]]
            for i, j in A.blocks(raw, 4 * A.BLOCK):
                words, runs = find_runs(raw[i:j], least)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[i:j].to_numpy(), "n_words": [len(w) for w in words],
                                    "runs": [[{"start": s, "period": p, "length": n} for s, p, n in r] for r in runs],
                                    "collapsed": [collapse(w, r) for w, r in zip(words, runs)]})
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """One row per document: (doc_id, n_words, runs, collapsed). A run is a
    stretch of at least ``least`` (even, 4 or more) words and two periods that
    no neighbouring word extends, with its smallest period; ``runs`` holds
    (start, period, length) by start, then period, in words from 0.
    ``collapsed`` is the text without the words that any run holds after its
    first period, the others joined by one space. Words are
    ``[^\\x20\\x09-\\x0D]+`` of the whole text.

    A null or empty text has no words, no runs and an empty ``collapsed``;
    repeated rows are documents of their own; null ids stay null; other
    columns are ignored; an empty table gives none."""
    if least < 4 or least % 2:
        raise ValueError("least must be even and at least 4")
    prepare(docs.sparkSession)
    d = two_columns(docs, id_col, text_col, "string")
    return (d.mapInPandas(_scan(least), f"doc_id string, n_words long, runs {RUNS}, collapsed string")
            .withColumn("doc_id", F.col("doc_id").cast("long")))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents whose crc32 of the id is divisible by ten
    repeat a stretch of their words up to their end."""
    d = two_columns(docs, "doc_id", "text")
    d = d.withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+', -1), x -> x <> '')")
    d = d.withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_w"))
    d = d.withColumn("_g", F.expr("_h div 10")).withColumn("_a", F.expr("if(_n > 0, _g % _n, 0)"))
    d = d.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    moved = F.expr("array_join(transform(_w, (x, i) -> if(i < _a, x, _w[int(_a + (i - _a) % _p)])), ' ')")
    return d.select("doc_id", F.when((F.col("_h") % 10 == 0) & (F.col("_n") > 0), moved).otherwise(F.col("text")).alias("text"))
