"""Removal of repeated word windows, by super-k-mers and exact sorting of windows in each bucket.

Words are runs of other characters than spaces and tab to carriage return, unchanged. A window is
`size` consecutive words of one document. Each word covered by a window whose words also start
earlier (in a document with a smaller id, or earlier in the same document) is removed; windows are
judged on the input. Null texts have no words; texts with fewer words than a window lose none.

Rows with the same id and text are copies of one document and give the same result; rows with the
same id and other texts don't remove from one another. A null id counts as the smallest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from huemill.llm import superkmers as sk
from huemill.llm.common import gather, ragged

SIZE = 20
GRAM = 3
_WORD = np.ones(256, bool)
_WORD[[32, *range(9, 14)]] = False


def word_ranges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word of all texts, and the bounds of each text in words."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    touching = cuts[inside[cuts] & inside[cuts + 1]]  # words of two texts that meet
    starts[touching] = True
    ends[touching] = True
    a, b = np.flatnonzero(starts), np.flatnonzero(ends)
    return a, b, np.searchsorted(a, bounds)


def _words(data: np.ndarray, bounds: np.ndarray):
    """Words of all texts, each followed by one space."""
    a, b, word_bounds = word_ranges(data, bounds)
    size = b - a
    ends_at = np.cumsum(size + 1)
    first = ends_at - size - 1
    body = np.full(int(ends_at[-1]) if len(a) else 0, 32, np.uint8)
    body[ragged(first, size)] = data[ragged(a, size)]
    h = sk.range_hashes(body, first, first + size)
    n = max(0, len(a) - GRAM + 1)
    grams = sk.mixed(h[:n] * sk.C1 + h[1 : n + 1] * sk.C2 + h[2 : n + 2] * sk.C3)
    return body, word_bounds, first, first + size, grams


def _compare(size: int):
    def compare(s: sk.Strings) -> list[tuple[np.ndarray, ...]]:
        if not len(s.sizes):
            return []
        which = np.arange(len(s.sizes))
        for exact in (False, True):
            if exact:
                s = s.take(which)
            starts = np.cumsum(s.sizes) - s.sizes
            # words of all strings; a string is its words with single spaces between
            spaces = np.flatnonzero(s.data == 32)
            n_words = s.counts + size - 1
            word_at = np.cumsum(n_words) - n_words
            first = np.empty(int(n_words.sum()), np.int64)
            first[word_at] = starts
            inner = np.ones(len(first), bool)
            inner[word_at] = False
            first[inner] = spaces + 1
            last = np.empty_like(first)
            last[word_at + n_words - 1] = starts + s.sizes
            inner[:] = True
            inner[word_at + n_words - 1] = False
            last[inner] = spaces
            at = ragged(word_at, s.counts)
            owner = np.repeat(np.arange(len(s.sizes)), s.counts)
            if not exact:
                twin = sk.repeated_values(sk.range_hashes(s.data, first[at], last[at + size - 1]))
                which = np.unique(owner[twin])
                if not len(which):
                    return []
        # windows as rows of word numbers, sorted
        words = sk.classes(gather(s.data, first, last - first), last - first)
        rows = words[at[:, None] + np.arange(size)]
        window = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, 8 * size))).reshape(-1), return_inverse=True)[1].reshape(-1)
        # every open occurrence of every window
        by = np.argsort(s.of, kind="stable")
        cuts = np.searchsorted(s.of[by], np.arange(len(s.sizes) + 1))
        n = np.diff(cuts)[owner]
        occ, w = by[ragged(cuts[owner], n)], np.repeat(window, n)
        doc, key, place = s.doc[occ], s.key[occ], s.at[occ] + np.repeat(at - word_at[owner], n)
        order = np.lexsort((place, key, doc, w))
        head = np.ones(len(order), bool)
        head[1:] = w[order][1:] != w[order][:-1]
        own = head.copy()
        own[1:] |= (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1])
        repeat = doc[order] > doc[order][np.flatnonzero(head)][np.cumsum(head) - 1]
        repeat |= place[order] > place[order][np.flatnonzero(own)][np.cumsum(own) - 1]
        gone = order[repeat]
        gone = gone[np.lexsort((place[gone], key[gone], doc[gone]))]
        return [(doc[gone], key[gone], place[gone], np.full(len(gone), size, np.int64))]

    return compare


RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """A row per row of docs: words, words removed, the maximal removed runs of words (end exclusive), the kept words joined by spaces."""

    def finish(text: bytes, spans: list[tuple[int, int]]) -> tuple:
        words = text.split()
        kept, at = [], 0
        for a, b in spans:
            kept += words[at:a]
            at = b
        kept += words[at:]
        return len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans], b" ".join(kept).decode()

    return sk.finished(sk.removed(docs, _words, _compare(size), size, GRAM, True), RESULT, finish)
