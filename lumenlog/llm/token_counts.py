"""Operator 2, token counts: trie-shared dynamic programming.

Distinct pre-tokens (a blank's sign and a word) go into a trie. The best unigram score of a pre-token's beginning does not depend on what follows, so
each node keeps the best score and the number of tokens up to it, computed once from the nodes above; the node where a pre-token ends stores its
count. A document's count is the sum over its pre-tokens. Texts stream through, each worker with its own trie of bounded
size (it starts anew when full); nothing is shuffled.

Among equal scores the segmentation with fewer tokens counts. Defined results: pre-tokens are split at ASCII white space; null and empty texts count 0; rows that repeat, and null ids,
are counted each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.chunks import Hasher, Table, of_worker, pieces_of
from lumenlog.llm.pieces import Pieces, pieces

NODES = 600_000
IN_TRIE = 48
COUNTS = "doc_id long, n_pretokens long, n_tokens long"


class TrieCounter:
    """Numbers of tokens of words. A node is the beginning that leads to it."""

    def __init__(self, table: Pieces):
        self.score, self.longest = table.score, max(map(len, table.score))
        self.byte = table.BYTE
        self.nodes: dict[str, tuple[float, int]] = {"": (0.0, 0)}

    def _best(self, text: str, end: int, above: list[tuple[float, int]], first: int = 0) -> tuple[float, int]:
        """Score and negated count at `end`, from those of shorter beginnings: above[i] is that of length first + i."""
        score, n = above[end - 1 - first]
        char = text[end - 1]
        best = (score + self.score[char], n - 1) if char in self.score else (score + self.byte * (k := len(char.encode())), n - k)
        get = self.score.get
        for start in range(max(0, end - self.longest), end - 1):
            s = get(text[start:end])
            if s is not None and (found := (above[start - first][0] + s, above[start - first][1] - 1)) > best:
                best = found
        return best

    def _insert(self, token: str) -> int:
        nodes, held = self.nodes, len(token)
        while token[:held] not in nodes:
            held -= 1
        above = [nodes[token[:i]] for i in range(held + 1)]
        for end in range(held + 1, len(token) + 1):
            above.append(self._best(token, end, above))
            nodes[token[:end]] = above[-1]
        return -above[-1][1]

    def _long(self, token: str) -> int:
        """A word that is too long for the trie: only the scores that a piece may still reach back to are kept."""
        above, first = [(0.0, 0)], 0
        for end in range(1, len(token) + 1):
            above.append(self._best(token, end, above, first))
            if len(above) > 64 * self.longest:
                cut = len(above) - self.longest - 1
                above, first = above[cut:], first + cut
        return -above[-1][1]

    def __call__(self, word: str) -> int:
        if len(self.nodes) > NODES:
            self.nodes = {"": (0.0, 0)}
        return self._insert("▁" + word) if len(word) < IN_TRIE else self._long("▁" + word)


def _table(model: str) -> Table:
    """The worker's own table; tasks that run one after the other in a worker share what it has seen."""
    return of_worker("counts", model, lambda: Table(TrieCounter(pieces(model)), np.int64))


_hasher = Hasher()


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model)
        for batch in batches:
            at = 0
            for held in pieces_of(batch.column("text")):
                spans = _hasher(held)
                counts = np.concatenate([[0], np.cumsum(table(spans))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(held)), pa.array(np.diff(spans.first)), pa.array(np.diff(counts[spans.first]))], names=["doc_id", "n_pretokens", "n_tokens"])
                at += len(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, COUNTS)
