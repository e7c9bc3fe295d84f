"""The k best stories of many queries, kept inside a task while scores arrive tile by tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Candidates that wait for the next merge: 6 MB.
WAITING = 1 << 18
#: Queries in one tile.
ROWS = 1024


class Best:
    """For each of n queries the k best stories so far: higher scores (rounded to `digits`) first, then smaller ids.

    A score below `least` matches nothing. A tile is compared with what each query has to beat; only what passes is
    sorted, so that a pair of query and story costs one comparison, and memory is the k best and a tile.
    """

    def __init__(self, n: int, k: int, digits: int, least: float) -> None:
        self.k, self.digits, self.least = k, digits, least
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self._waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._n_waiting = 0

    def offer(self, at: int, tile: np.ndarray, ids: np.ndarray) -> None:
        """tile: what the stories (by column) score for the queries at, at + 1 and so on."""
        if not tile.size:
            return
        step, own = 10.0**-self.digits, slice(at, at + len(tile))
        floor, last = self.scores[own, -1], self.ids[own, -1]
        least = np.maximum(np.where(ids.min() > last, floor + 0.4 * step, floor - 0.6 * step), self.least)
        whole = tile.dtype.kind == "u"
        hit = tile >= (np.ceil(least).astype(tile.dtype) if whole else least)[:, None]
        n_hit = np.count_nonzero(hit)
        if n_hit > 4 * len(tile):
            many = np.flatnonzero(hit.sum(axis=1) > 2 * self.k)
            if len(many):
                part = tile[many]
                kth = np.partition(part, -self.k, axis=1)[:, -self.k]
                hit[many] &= part >= (kth if whole else kth - step)[:, None]
        if n_hit:
            q, s = np.divmod(np.flatnonzero(hit), tile.shape[1])
            self.offer_pairs(q + at, np.round(tile[q, s].astype(float), self.digits), ids[s])

    def offer_pairs(self, q: np.ndarray, score: np.ndarray, story: np.ndarray) -> None:
        """Single pairs, by the place of the query, with their scores, which are rounded."""
        better = (score > self.scores[q, -1]) | ((score == self.scores[q, -1]) & (story < self.ids[q, -1]))
        self._waiting.append((q[better], score[better], story[better]))
        self._n_waiting += len(self._waiting[-1][0])
        if self._n_waiting > WAITING:
            self._merge()

    def _merge(self) -> None:
        if not self._n_waiting:
            return
        q, score, story = (np.concatenate(x) for x in zip(*self._waiting, strict=True))
        self._waiting, self._n_waiting = [], 0
        asked = np.unique(q)
        q = np.concatenate([q, np.repeat(asked, self.k)])
        score, story = np.concatenate([score, self.scores[asked].ravel()]), np.concatenate([story, self.ids[asked].ravel()])
        order = np.lexsort((story, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        first = place < self.k
        q, place, order = q[first], place[first], order[first]
        self.scores[q, place], self.ids[q, place] = score[order], story[order]

    def rows(self, ids: np.ndarray, of: np.ndarray | None = None, score: str = "score") -> pa.RecordBatch:
        """query_id, story_id and the score of the queries `ids`, whose places are `of` (else their own)."""
        self._merge()
        scores, stories = (self.scores, self.ids) if of is None else (self.scores[of], self.ids[of])
        keep = np.isfinite(scores)
        query = np.repeat(ids, keep.sum(1))
        return pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), pa.array(stories[keep]), pa.array(scores[keep])], names=["query_id", "story_id", score])
