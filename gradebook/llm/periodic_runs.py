"""Maximal periodic runs of words, found with a suffix automaton and link-cut access."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.llm.tokens import NOT_SPACE, Words, mixed, pieces, shingles, words_of

_RUN = "struct<start: bigint, length: bigint, period: bigint>"


def periodic_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_repeats: int = 3,
) -> DataFrame:
    """The periodic stretches of each text, and the text without their repeats.

    Words are runs of characters other than space, tab and line ends, as written. A run is a
    stretch with smallest period q of at least ``min_length`` words and ``min_repeats`` periods that no
    neighbouring word extends. A word is dropped from ``collapsed`` if a run contains it after that run's first q words.

    Method: the words of a stretch go through a suffix automaton. Each word's path of suffix
    links is accessed in a link-cut forest whose preferred paths carry the
    position that touched them last. A path of position e that reaches length l, met at position i, is a
    repeat at distance i - e of l words: a square if l is at least the distance, and with
    l + distance words a run if it is long enough and the next word differs. Only
    stretches around windows of words that occur earlier in the same text are looked at, widened so that each run lies
    in one of them with its neighbours: no run can lie elsewhere.

    One row per row of ``docs``: id, n_words, runs (by start, then period), best (the run of the greatest
    length / period; ties: smallest start, then period; null without runs), collapsed (kept words
    with one space between them). A null or empty text has no words and an empty ``collapsed``. Rows
    are judged on their own; ids may repeat or be null. Other columns are not looked at. A text is
    worked on in one task, with about 100 bytes of memory per word of a stretch.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in pieces(batch.column("text")):
                words = words_of(data, bounds, NOT_SPACE)
                runs = [[] for _ in range(len(bounds) - 1)]
                for text, a, b in _stretches(words, min_length, min_repeats):
                    first = int(words.first[text])
                    known: dict[bytes, int] = {}
                    ids = [known.setdefault(data[s:e].tobytes(), len(known)) for s, e in zip(words.start[first + a:first + b], words.end[first + a:first + b])]
                    runs[text] += [(a + start, length, period) for start, length, period in runs_of(ids, min_length, min_repeats)]
                keep = np.ones(len(words.start), bool)
                for text, found in enumerate(runs):
                    found.sort(key=lambda r: (r[0], r[2]))
                    for start, length, period in found:
                        at = int(words.first[text]) + start
                        keep[at + period:at + length] = False
                best = [max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None for found in runs]
                yield pa.record_batch(
                    [batch.column("id").slice(row, len(runs)), pa.array(np.diff(words.first).astype(np.int64)),
                     pa.array([[_named(r) for r in found] for found in runs], _ARROW_RUNS), pa.array([_named(r) for r in best], _ARROW_RUN),
                     _joined(data, words, keep)],
                    names=["id", "n_words", "runs", "best", "collapsed"])

    found = source.mapInArrow(find, f"id {kind}, n_words bigint, runs array<{_RUN}>, best {_RUN}, collapsed string")
    return found.withColumnRenamed("id", id_col)


_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW_RUNS = pa.list_(_ARROW_RUN)


def _named(run: tuple[int, int, int] | None) -> dict[str, int] | None:
    return None if run is None else dict(zip(("start", "length", "period"), run))


def _stretches(words: Words, min_length: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """(text, first word, end) of the stretches of a piece in which runs can lie.

    In a run of period q at least k = min over q of max(min_length - q, (min_repeats - 1) q) words equal the
    word q before, so windows of k words occur again. Where h windows in a row have occurred
    before, a run among them has a period of at most (h + k - 1) / (min_repeats - 1).
    """
    more = max(1, min_repeats - 1)
    k = max(1, min(max(min_length - q, more * q) for q in range(1, min_length + 1)))
    gram, whole = shingles(words, k)
    if not len(gram):
        return []
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[:len(gram)]
    at = np.flatnonzero(whole)
    key = mixed(gram[at] + mixed(text[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(gram), bool)
    again[at[order[1:][key[order][1:] == key[order][:-1]]]] = True
    edge = np.diff(np.concatenate(([False], again, [False])).astype(np.int8))
    out: list[tuple[int, int, int]] = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        # Windows of different texts are never in one row, as windows across texts lie between them (or k is 1).
        while a < b:
            t = int(text[a])
            end = min(b, int(words.first[t + 1]))
            first, size = int(words.first[t]), int(words.first[t + 1] - words.first[t])
            low = max(0, a - first - 1 - (end - a + k - 1) // more)
            high = min(size, end - first + k)
            while out and out[-1][0] == t and low <= out[-1][2]:
                low = min(low, out.pop()[1])
            out.append((t, low, high))
            a = end
    return out


def _joined(data: np.ndarray, words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text with one space between them."""
    texts = len(words.first) - 1
    at = np.flatnonzero(keep)
    text = np.searchsorted(words.first, at, "right") - 1
    last = np.concatenate((text[1:] != text[:-1], [True])) if len(at) else np.zeros(0, bool)
    # A kept word that is not a text's last is followed by the byte after it, which becomes a space.
    start, end = words.start[at], words.end[at] + ~last
    delta = np.zeros(len(data) + 2, np.int8)
    np.add.at(delta, start, 1)
    np.add.at(delta, end, -1)
    mask = np.cumsum(delta[:len(data)]).astype(bool)
    out = data.copy()
    out[words.end[at][~last]] = 0x20
    size = np.zeros(texts + 1, np.int64)
    np.add.at(size, text + 1, end - start)
    return pa.Array.from_buffers(
        pa.large_string(), texts, [None, pa.py_buffer(np.cumsum(size)), pa.py_buffer(out[mask])]).cast(pa.string())


def runs_of(word: list[int], min_length: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbered words.

    States are numbered from 1, the root; 0 is none. After ``access`` of the state of a prefix, the path from
    the root to it is one splay tree, ordered by length; ``last`` at a splay tree's
    root is the position that touched its path last.
    """
    size, link, ends = _automaton(word)
    none = bytes(4 * len(size))
    left, right, up = array("i", none), array("i", none), array("i", link)
    last = array("i", [-1]) * len(size)
    found, n = [], len(word)
    for i, state in enumerate(ends):
        below, x = 0, state
        while x:
            while True:  # splay x
                p = up[x]
                if left[p] != x and right[p] != x:
                    break
                g = up[p]
                at_root = left[g] != p and right[g] != p
                if not at_root and (left[g] == p) == (left[p] == x):
                    turns = ((p, g), (x, p))
                else:
                    turns = ((x, p),)
                for a, b in turns:  # a goes above its parent b
                    c = up[b]
                    if left[b] == a:
                        mid = left[b] = right[a]
                        right[a] = b
                    else:
                        mid = right[b] = left[a]
                        left[a] = b
                    if mid:
                        up[mid] = b
                    up[b], up[a] = a, c
                    if left[c] == b:
                        left[c] = a
                    elif right[c] == b:
                        right[c] = a
                    else:
                        last[a] = last[b]
            e = last[x]
            if e >= 0:
                d, l = i - e, size[x]
                if l >= (min_repeats - 1) * d and l + d >= min_length and (i + 1 == n or word[i + 1] != word[i + 1 - d]):
                    found.append((i - l - d + 1, l + d, d))
            cut = right[x]
            if cut:
                last[cut] = e
            right[x] = below
            below, x = x, up[x]
        last[below] = i
    return found


def _automaton(word: list[int]) -> tuple[array, array, array]:
    """(longest length, suffix link) of every state of the suffix automaton, and the state of each prefix.

    Most states have one transition; only the others get a dictionary.
    """
    size, link = array("i", [0, 0]), array("i", [0, 0])
    symbol, to, others = array("i", [-1, -1]), array("i", [0, 0]), {}
    ends = array("i")
    tip = 1
    for c in word:
        new = len(size)
        size.append(size[tip] + 1)
        link.append(0)
        symbol.append(-1)
        to.append(0)
        p = tip
        while p:
            if symbol[p] == c:
                q = to[p]
                break
            if symbol[p] < 0:
                symbol[p], to[p] = c, new
            else:
                known = others.setdefault(p, {})
                if c in known:
                    q = known[c]
                    break
                known[c] = new
            p = link[p]
        if not p:
            link[new] = 1
        elif size[q] == size[p] + 1:
            link[new] = q
        else:
            clone = len(size)
            size.append(size[p] + 1)
            link.append(link[q])
            symbol.append(symbol[q])
            to.append(to[q])
            if q in others:
                others[clone] = dict(others[q])
            link[q] = link[new] = clone
            while p:
                if symbol[p] == c:
                    if to[p] != q:
                        break
                    to[p] = clone
                elif others.get(p, {}).get(c) == q:
                    others[p][c] = clone
                else:
                    break
                p = link[p]
        ends.append(new)
        tip = new
    return size, link, ends
