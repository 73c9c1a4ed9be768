"""Replace phrases, the leftmost and there the longest one, by a trie in flat arrays.

An edge of the trie is one integer, its state and a character; all edges are one ascending array, and a
step of any number of places is one binary search.  All places of a batch of texts walk down the trie
together, and only those that still follow a phrase take the next step, so the cost of a text hardly
depends on how many phrases there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401

CHARACTER = 21  # bits of a code point


class PhraseTrie:
    """Phrases with what each becomes; an empty phrase is left out."""

    def __init__(self, mapping: Mapping[str, str]) -> None:
        phrases = sorted(p for p in mapping if p)
        self.results = [mapping[p] for p in phrases]
        points, sizes = _points(phrases)
        starts = np.cumsum(sizes) - sizes
        state = np.zeros(len(phrases), np.int64)  # where each phrase has come to
        alive, made, edges, targets = np.arange(len(phrases)), 1, [], []
        ends = [np.full(1, -1, np.int64)]
        for depth in range(int(sizes.max(initial=0))):
            alive = alive[sizes[alive] > depth]
            keys, which = np.unique(state[alive] << CHARACTER | points[starts[alive] + depth], return_inverse=True)
            edges.append(keys)
            targets.append(made + np.arange(len(keys)))
            state[alive] = made + which
            end = np.full(len(keys), -1, np.int64)
            done = alive[sizes[alive] == depth + 1]
            end[state[done] - made] = done
            ends.append(end)
            made += len(keys)
        keys = np.concatenate(edges or [np.zeros(0, np.int64)])
        order = np.argsort(keys)
        self.edges, self.targets = keys[order], np.concatenate(targets or [np.zeros(0, np.int64)])[order]
        self.ends = np.concatenate(ends)  # of each state, the phrase that ends there
        self.sizes = sizes

    def longest(self, points: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """For each place the longest phrase that begins there and ends before `stops`, or -1."""
        best = np.full(len(points), -1, np.int64)
        at, state, depth = np.arange(len(points)), np.zeros(len(points), np.int64), 0
        while len(at) and len(self.edges):
            inside = at + depth < stops[at]
            at, state = at[inside], state[inside]
            keys = state << CHARACTER | points[at + depth]
            edge = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            hit = self.edges[edge] == keys
            at, state = at[hit], self.targets[edge[hit]]
            depth += 1
            whole = self.ends[state]
            best[at[whole >= 0]] = whole[whole >= 0]
        return best

    def replace(self, texts: list[str]) -> list[str]:
        points, sizes = _points(texts)
        stops = np.cumsum(sizes)
        best = self.longest(points, np.repeat(stops, sizes))
        places = np.flatnonzero(best >= 0)
        bounds = np.searchsorted(places, np.concatenate((stops - sizes, stops)))
        out = []
        for i, text in enumerate(texts):
            begin, done, parts = int(stops[i] - sizes[i]), 0, []
            for place in places[bounds[i]:bounds[i + len(texts)]].tolist():
                if place - begin >= done:
                    parts += [text[done:place - begin], self.results[best[place]]]
                    done = place - begin + int(self.sizes[best[place]])
            out.append("".join([*parts, text[done:]]) if parts else text)
        return out


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and their numbers."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), sizes


def replaced(series: pd.Series, trie: PhraseTrie, most: int = 1 << 20) -> pd.Series:
    """Texts with their phrases replaced, some `most` characters at a time; NULL stays NULL."""
    def slices() -> Iterator[list[int]]:
        some, filled = [], 0
        for i, text in enumerate(series):
            if text is not None:
                some.append(i)
                filled += len(text)
            if filled >= most:
                yield some
                some, filled = [], 0
        if some:
            yield some

    out: list[str | None] = [None] * len(series)
    for some in slices():
        for i, text in zip(some, trie.replace([series.iloc[i] for i in some]), strict=True):
            out[i] = text
    return pd.Series(out, dtype=object)


def replaced_in_slices(texts: pa.Array, trie: PhraseTrie, most: int = 1 << 18) -> pa.Array:
    """`replaced` of an Arrow column, of which about `most` bytes at a time are Python objects."""
    out, start, filled = [], 0, 0
    cut = lambda stop: pa.array(replaced(pd.Series(texts.slice(start, stop - start).to_pylist(), dtype=object), trie, most).tolist(), pa.string())
    for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()):
        if i > start and filled + n > most:
            out.append(cut(i))
            start, filled = i, 0
        filled += n
    return pa.concat_arrays([*out, cut(len(texts))])
