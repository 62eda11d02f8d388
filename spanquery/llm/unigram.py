"""Token counts by dynamic programming over a shared trie (operator 5).

A vocabulary of pieces with log-probabilities (a unigram model) segments each pre-token so that
the sum of its pieces' scores is largest.  Distinct pre-tokens are inserted in a trie of code
points; a node holds the best score and the fewest tokens of the prefix that leads to it, computed
once from its ancestors, so that pre-tokens with a common prefix share that part of the work and
the terminal node stores a pre-token's count.

The registered query uses the pieces of the public 32,000-piece model.  That file ranks its
pieces instead of giving probabilities, so a piece of rank r gets the Zipf score -ln(r + 3).  A
character outside the vocabulary is spelled by its UTF-8 bytes, one token each, at a score below
all pieces.  A text gets a leading space and spaces are written as U+2581, as the file's
normaliser says; pre-tokens start at runs of spaces, which no piece crosses (checked on loading).

Defined cases: null and empty texts have no tokens; bytes that are no UTF-8 count as U+FFFD; rows
that repeat are counted one by one; a pre-token of any length is counted whole, in memory that is
bounded but for the pre-token itself; an empty table gives an empty result; an input column named
as the new one is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mapping import map_text
from .textkit import _byte_values, per_row_sum, span_hashes

SPACE = "▁"
MAX_NODES = 400_000
MAX_KNOWN, KNOWN_BYTES = 400_000, 64  # pre-tokens whose counts are at hand, and the longest of them
CHUNK = 1 << 20  # bytes of text whose pre-tokens are told apart at a time


def default_model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_scores(path: str) -> dict[str, float]:
    """Pieces of a model file with Zipf scores by rank; control, unknown and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(rank + 3) for rank, i in enumerate(ranked)}


class PrefixTrie:
    """Forward scores of all prefixes seen; it has ``MAX_NODES`` nodes at most and is cleared when full."""

    def __init__(self, scores: dict[str, float]):
        for piece in scores:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} crosses a pre-token border")
        self.longest = max(map(len, scores), default=0)
        self.spelled = min(scores.values(), default=0.0) - 10.0
        self.known: dict[bytes, int] = {}
        #: What pieces end with, with the score of a whole piece.
        self.ends: dict[str, float | None] = dict.fromkeys(p[i:] for p in scores for i in range(1, len(p)))
        self.ends.update(scores)
        self.clear()

    def restart(self) -> None:
        """Forget the walk of the pre-token before."""
        self.last, self.nodes, self.sums, self.numbers = "", [0], [0.0], [0]

    def clear(self) -> None:
        self.restart()
        self.children: dict[tuple[int, str], int] = {}
        self.best = [0.0]
        self.tokens = [0]

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        """``count`` of each UTF-8 pre-token; short ones that a chunk before had are looked up as a whole."""
        known = self.known
        out = [known.get(p, -1) for p in pretokens]
        new = [(pretokens[i].decode("utf-8", "replace").replace(" ", SPACE), i) for i, n in enumerate(out) if n < 0]
        new.sort()
        for text, i in new:
            out[i] = n = self.count(text)
            if len(pretokens[i]) <= KNOWN_BYTES:
                if len(known) >= MAX_KNOWN:
                    known.clear()
                known[pretokens[i]] = n
        return np.array(out, dtype=np.int64)

    def count(self, pretoken: str) -> int:
        """Number of tokens of the best segmentation; the fewest among equal scores.

        The scores of the last prefixes, as far back as a piece reaches, are at hand in two short
        lists; what goes beyond a full trie is computed from them and not inserted.  The walk starts where
        this pre-token parts from the one before, so that pre-tokens in order share it, too.
        """
        if len(self.best) >= MAX_NODES:
            self.clear()
        children, best, tokens, ends = self.children, self.best, self.tokens, self.ends
        nodes, sums, numbers = self.nodes, self.sums, self.numbers
        at = 0
        for x, y in zip(self.last, pretoken, strict=False):
            if x != y:
                break
            at += 1
        del nodes[at + 1 :], sums[at + 1 :], numbers[at + 1 :]
        self.last, node, behind, most = pretoken, nodes[at], 0, 4 * self.longest + 64
        for i in range(at, len(pretoken)):
            c = pretoken[i]
            child = children.get((node, c), -1) if node >= 0 else -1
            if child >= 0:
                top, n = best[child], tokens[child]
            else:
                top, n = sums[-1] + self.spelled, numbers[-1] + (1 if c < "\x80" else len(c.encode("utf-8", "replace")))
                for j in range(i, -1, -1):
                    score = ends.get(pretoken[j : i + 1], False)
                    if score is False:  # no piece ends so
                        break
                    if score is not None:
                        total = sums[j - behind] + score
                        if total > top or total == top and numbers[j - behind] + 1 < n:
                            top, n = total, numbers[j - behind] + 1
                if node >= 0 and len(best) < MAX_NODES:
                    child = len(best)
                    children[node, c] = child
                    best.append(top)
                    tokens.append(n)
            node = child
            sums.append(top)
            numbers.append(n)
            if not behind:
                nodes.append(node)
            if len(sums) > most:
                behind += len(sums) - self.longest - 1
                del sums[: -self.longest - 1], numbers[: -self.longest - 1]
        total = numbers[-1]
        if behind:
            self.restart()
        return total


_values = _byte_values(0x7E1E)


def chunk_counts(trie: PrefixTrie, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Token count of each row."""
    if not len(data):
        return np.zeros(len(offsets) - 1, dtype=np.int64)
    space = data == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    rows = offsets[:-1][np.diff(offsets) > 0]
    start[rows] = True
    cuts = np.append(np.flatnonzero(start), len(data))
    lead = np.zeros(len(data), dtype=bool)
    lead[rows] = True
    lead = lead[cuts[:-1]]
    h = span_hashes(_values[data], cuts[:-1], cuts[1:])
    h[lead] ^= np.uint64(0x9E3779B97F4A7C15)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    told = [b" " * dummy + raw[a:b] for a, b, dummy in zip(cuts[first].tolist(), cuts[first + 1].tolist(), lead[first].tolist(), strict=True)]
    return per_row_sum(trie.counts(told)[which], np.searchsorted(cuts[:-1], offsets))


def token_counts(docs: DataFrame, text: str = "text", out: str = "n_tokens", model_file: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Append the number of tokens of each text; the model file must be installed on every machine."""
    path = model_file or default_model_file()

    def start():
        trie = PrefixTrie(load_scores(path))
        return lambda data, offsets: [pa.array(chunk_counts(trie, data, offsets))]

    return map_text(docs, text, start, [T.StructField(out, T.LongType(), False)], keep, CHUNK)


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and bytes_per_token of every document."""
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).alias("bytes"))
    counted = token_counts(sized, keep=["doc_id", "bytes"])
    return counted.select("doc_id", "n_tokens", (F.col("bytes") / F.nullif(F.col("n_tokens"), F.lit(0))).alias("bytes_per_token"))
