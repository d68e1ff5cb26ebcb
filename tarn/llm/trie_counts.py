"""Token counts of a unigram model, by dynamic programming shared in a trie.

Each task keeps a trie of the distinct pre-tokens that it has met. A node holds the best forward
score of its prefix and the number of tokens on that best path; both are computed once, when the
node is made, from its ancestors. A pre-token's count is that of its last node. A document's count
is the sum over its pre-tokens.

The pieces are those of a public vocabulary file. It has no unigram probabilities, and tokenizers are
not trained here, so the log probabilities follow Zipf's law by the piece's rank in that file:
-log(rank + 1) - log(sum). A vocabulary with probabilities of its own can be given as ``scores``.

Scale: no shuffle, and bounded memory: nodes are made up to ``MOST_NODES`` and to the depth
``MOST_DEPTH``; what is beyond is computed in a window of the longest piece's length. Texts are read in
stretches of about ``STRETCH`` characters; a full trie is emptied after one.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm.common import importable, slices

MOST_NODES = 500_000
MOST_DEPTH = 256
STRETCH = 500_000

#: A pre-token: a word and the space before it, a newline, or the spaces before another space.
PRE_TOKEN = re.compile(r" +(?= )|\n| ?[^ \n]+| ")

#: Below the least likely piece, for a character that has no piece and becomes bytes.
BYTES_PENALTY = 10.0


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def unigram_scores(path: str) -> dict[str, float]:
    """The log probability of each ordinary piece, spaces written as spaces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(ordinary))))
    return {model.id_to_piece(i).replace("▁", " "): -math.log(r + 1) - total for r, i in enumerate(ordinary)}


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in parts of about that size, which no pre-token crosses: each but the first begins with the first of some spaces."""
    start = 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and text[at - 1] == " ":
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:] if start else text


class TokenTrie:
    """A trie of pre-tokens; see the module. Nodes are numbers; children are found by node and character."""

    def __init__(self, scores: dict[str, float], most_nodes: int = MOST_NODES, most_depth: int = MOST_DEPTH) -> None:
        self.scores = scores
        self.suffixes = {piece[k:] for piece in scores for k in range(len(piece))}
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - BYTES_PENALTY
        self.most_nodes, self.most_depth = most_nodes, most_depth
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best = array("d", [0.0])
        self.tokens = array("q", [0])
        #: The last node of each pre-token that is in the trie as a whole.
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """The number of tokens of the word; new nodes are made for what no earlier word shares."""
        child, best, tokens = self.child, self.best, self.tokens
        scores, suffixes = self.scores, self.suffixes
        node, path, i, n = 0, [0], 0, len(word)
        deepest = min(n, self.most_depth)
        while i < deepest and (following := child.get(node << 21 | ord(word[i]))) is not None:
            node = following
            path.append(node)
            i += 1
        if i == n:
            self.terminal[word] = node
            return tokens[node]
        # scores and counts of the last prefixes, as many as a piece can reach back to
        score_of = [best[k] for k in path[-self.longest :]]
        count_of = [tokens[k] for k in path[-self.longest :]]
        while i < n:
            char = word[i]
            own = scores.get(char)
            if own is None:
                score, count = score_of[-1] + self.unknown, count_of[-1] + len(char.encode("utf-8", "surrogatepass"))
            else:
                score, count = score_of[-1] + own, count_of[-1] + 1
            # the best last piece: the shorter pieces first, so that ties go to fewer tokens only
            j, k = i - 1, len(score_of) - 2
            while k >= 0 and (piece := word[j : i + 1]) in suffixes:
                if (own := scores.get(piece)) is not None:
                    total = score_of[k] + own
                    if total > score or total == score and count_of[k] + 1 < count:
                        score, count = total, count_of[k] + 1
                j -= 1
                k -= 1
            score_of.append(score)
            count_of.append(count)
            i += 1
            if node >= 0 and i <= deepest and len(best) < self.most_nodes:
                child[node << 21 | ord(char)] = node = len(best)
                best.append(score)
                tokens.append(count)
            else:
                node = -1
            if len(score_of) >= 4096 + self.longest:
                del score_of[:4096], count_of[:4096]
        if node >= 0:
            self.terminal[word] = node
        return count_of[-1]

    def count(self, text: str) -> int:
        """The number of tokens of a text, which starts as if a space came before it."""
        total = 0
        for part in stretches(" " + text) if text else ():
            words = PRE_TOKEN.findall(part)
            terminal = self.terminal
            apart = {}  # words that the trie has no room for
            for word in set(words).difference(terminal):
                n = self.insert(word)
                if word not in terminal:
                    apart[word] = n
            if apart:
                total += sum(apart[w] if w in apart else self.tokens[terminal[w]] for w in words)
            else:
                total += sum(map(self.tokens.__getitem__, map(terminal.__getitem__, words)))
            if len(self.best) >= self.most_nodes:
                self.clear()
        return total


def token_counts(docs: DataFrame, vocabulary: str | None = None, scores: dict[str, float] | None = None) -> DataFrame:
    """doc_id and n_tokens of each document, by the log probabilities in ``scores`` or else those of a vocabulary file.

    A null or empty text has none. Characters without a piece count as their UTF-8 bytes.
    Null ids and repeated rows are rows like any other; an empty table gives no rows. Only doc_id
    and text are read.
    """
    path = None if scores else vocabulary or default_vocabulary()
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TokenTrie(scores or unigram_scores(path))
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            tokens = [trie.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
