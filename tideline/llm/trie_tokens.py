"""Token counts of texts under a unigram model, with scores shared along a trie.

Distinct pre-tokens are inserted in a trie, in order. The best score of a prefix depends on the
prefix alone, so each trie node is scored once, from the nodes above it; where a pre-token ends
its token count is kept for every later occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import sliced, utf8

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


def load_pieces(path: str) -> tuple[dict[str, float], float]:
    """Piece scores and the score of one fallback byte.

    The file's order is the order of frequency, so a piece's score is its log probability under
    Zipf's law: -ln(rank + 1) less a constant. Nothing is fitted. Control and byte pieces are
    left out; a character no piece covers costs one byte token for each of its UTF-8 bytes.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
    norm = math.log(sum(1.0 / (k + 1) for k in range(len(names))))
    return {x: -math.log(k + 1) - norm for k, x in enumerate(names)}, -math.log(len(names) + 1) - norm - 1.0


class UnigramTrie:
    """Best scores of prefixes, one for each node of the trie of the pre-tokens.

    Distinct pre-tokens are inserted in order, so the nodes that one shares with the trie are
    those that it shares with the pre-token before: the path to that is at hand, and only the
    nodes behind the shared prefix are scored. The counts where pre-tokens end are kept for
    later occurrences; most_held bounds those counts and, in steps of 64 bytes, the pre-tokens
    they belong to. Fuller, they are forgotten. A pre-token of more than `depth` characters is
    scored by itself, in a window as long as the longest piece.
    """

    def __init__(self, pieces: dict[str, float], byte_score: float, most_held: int = 1_000_000, depth: int = 2000):
        self.byte_score, self.most_held, self.depth = byte_score, most_held, depth
        self.longest = max(map(len, pieces), default=1)
        # Scores of pieces; ends of pieces that are none have none. What is no end of a piece ends a search.
        self.ends: dict[str, float | None] = {x[k:]: None for x in pieces for k in range(len(x))} | pieces
        self.nodes_scored = 0
        self.terminal: dict[bytes, tuple[int, int]] = {}
        self.held = 0

    def _score(self, chars: str, first: int, score: list[float], count: list[int], fallback: list[int], base: int = 0) -> None:
        """Append (score, tokens, byte tokens) of the best way to chars[: i + 1], from i = first on; the lists hold those of chars[:k] at k - base."""
        ends, byte_score = self.ends, self.byte_score
        for i in range(first, len(chars)):
            char = chars[i]
            n = 1 if char < "\x80" else len(char.encode("utf-8", "surrogatepass"))
            k = i - base
            best, tokens, byte, piece = score[k] + n * byte_score, count[k] + n, fallback[k] + n, False
            j = i
            while j >= base:
                s = ends.get(chars[j : i + 1], 0.0)
                if s == 0.0:
                    break
                if s is not None:
                    x = score[j - base] + s
                    if x > best or (piece and x == best):
                        best, tokens, byte, piece = x, count[j - base] + 1, fallback[j - base], True
                j -= 1
            score.append(best)
            count.append(tokens)
            fallback.append(byte)
            if len(score) > 2 * self.depth + 2 * self.longest:
                drop = len(score) - self.longest - 1
                del score[:drop], count[:drop], fallback[:drop]
                base += drop

    def insert(self, words: list[bytes]) -> None:
        """Score pre-tokens, sorted and distinct; a space mark goes before each."""
        score, count, fallback, before = [0.0], [0], [0], ""
        for word in words:
            if self.held > self.most_held:
                self.terminal, self.held = {}, 0
            chars = SPACE + word.decode("utf-8", "replace")
            if len(chars) > self.depth:
                path = [0.0], [0], [0]
                self._score(chars, 0, *path)
                found = path[1][-1], path[2][-1]
                self.nodes_scored += len(chars)
            else:
                shared, most = 0, min(len(before), len(chars))
                while shared < most and before[shared] == chars[shared]:
                    shared += 1
                del score[shared + 1 :], count[shared + 1 :], fallback[shared + 1 :]
                self._score(chars, shared, score, count, fallback)
                self.nodes_scored += len(chars) - shared
                found, before = (count[-1], fallback[-1]), chars
            self.terminal[word] = found
            self.held += 1 + len(word) // 64

    def tokens(self, word: bytes) -> tuple[int, int]:
        """(tokens, byte tokens) of one pre-token."""
        if word not in self.terminal:
            self.insert([word])
        return self.terminal[word]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, most_held: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, n_pretokens, n_tokens, n_byte_tokens.

    Pre-tokens are the words of the whole text (runs other than space and U+0009-000D), each
    with a space mark before it. Null, empty and wordless texts count 0. A task scores the distinct
    pre-tokens of some thousands of rows at a time that it does not know yet, so nothing is
    shuffled and memory is bounded. The scores are a proxy (see load_pieces). Equal scores prefer byte tokens, then the
    longest last piece. An empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = UnigramTrie(*load_pieces(vocabulary), most_held)
        for b in sliced(batches, 4096):
            out = []
            texts = utf8(b.column(1))
            distinct: set[bytes] = set()
            for x in texts:
                distinct.update(x.split() if x else ())
            trie.insert(sorted(distinct.difference(trie.terminal)))
            known = trie.terminal.get
            for x in texts:
                found = [known(w) or trie.tokens(w) for w in x.split()] if x else []
                out.append((len(found), sum(map(itemgetter(0), found)), sum(map(itemgetter(1), found))))
            cols = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[:, k]) for k in range(3))], names=["doc_id", "n_pretokens", "n_tokens", "n_byte_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, "doc_id long, n_pretokens long, n_tokens long, n_byte_tokens long")
