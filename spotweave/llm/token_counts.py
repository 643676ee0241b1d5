"""Token counts under a unigram model, by dynamic programming over a trie of the distinct pre-tokens.

A pre-token is a word (a run of anything but ASCII white space) with the word mark before it. A task inserts the distinct
pre-tokens of its documents into a trie; when a node is made, the best score of its prefix and the fewest tokens that reach it
are computed from the nodes above, once, however many pre-tokens share the prefix. A terminal keeps its count, so a word met again, in
this batch of rows or a later one, costs a lookup. Documents never move: each one's count is the sum over its words.
The trie is bounded: at `MAX_NODES` (some 150 MB) it begins anew, which changes no count.

The vocabulary file (a parameter, read by the driver and broadcast: 32,000 pieces here, `max_pieces` at most) holds
merge ranks rather than probabilities, so a piece of rank r gets log(1 / (r + 2.7)), after Zipf. A character that no
piece covers counts as its UTF-8 bytes, each a token of score `byte_score`. Of equally likely segmentations the one
with fewer tokens counts.

Defined cases: texts of any length are counted whole, and words of more than LONG characters leave no nodes; null and empty texts have no tokens; repeated rows each get their result; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_SCORE = -12.0
MAX_NODES = 500_000
#: Words of more characters get no nodes of their own: hardly any other shares them.
LONG = 10_000
MARK = "\u2581"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read_pieces(path: str = VOCABULARY, max_pieces: int = 1_000_000) -> dict[str, float]:
    """Piece to score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    if n > max_pieces:
        raise ValueError(f"{n} pieces are more than max_pieces ({max_pieces})")
    ids = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and model.get_score(i) > -1e8]
    return {model.id_to_piece(i): -math.log(2.7 + k) for k, i in enumerate(ids)}


class Trie:
    """Nodes by number: children by (node, character) in one table, best score and fewest tokens of the prefix; terminals: tokens of a word."""

    def __init__(self, pieces: dict[str, float], byte_score: float = BYTE_SCORE, max_nodes: int = MAX_NODES):
        # ends of pieces: the score of those that are pieces themselves, else nothing; what isn't there ends no piece
        self.ends: dict[str, float | None] = {p[k:]: None for p in pieces for k in range(len(p))} | pieces
        self.byte_score, self.max_nodes = byte_score, max_nodes
        self._clear()

    def _clear(self) -> None:
        self.children: dict[int, int] = {}
        self.scores, self.tokens = [0.0], [0]
        self.terminals: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a word with the mark before it."""
        found = self.terminals.get(word)
        if found is None:
            if len(word) > LONG:
                before, found = len(self.scores), self._insert(MARK + word, keep=False)
                del self.scores[before:], self.tokens[before:]
                return found
            if len(self.scores) > self.max_nodes:
                self._clear()
            found = self.terminals[word] = self._insert(MARK + word)
        return found

    def _insert(self, text: str, keep: bool = True) -> int:
        """Walks down, making what nodes are missing. keep=False: for one very long word, whose nodes are its prefixes' numbers alone."""
        path = [0]
        ends, children, scores, tokens = self.ends, self.children, self.scores, self.tokens
        for end, c in enumerate(text, 1):
            above = path[-1]
            node = children.get(above << 21 | ord(c)) if keep else None
            if node is None:
                size = len(c.encode("utf-8", "surrogatepass"))
                best, count = scores[above] + self.byte_score * size, tokens[above] + size
                for begin in range(end - 1, -1, -1):
                    part = text[begin:end]
                    if part not in ends:
                        break
                    s = ends[part]
                    if s is not None:
                        s += scores[path[begin]]
                        if s > best or s == best and tokens[path[begin]] + 1 < count:
                            best, count = s, tokens[path[begin]] + 1
                node = len(scores)
                if keep:
                    children[above << 21 | ord(c)] = node
                scores.append(best)
                tokens.append(count)
            path.append(node)
        return tokens[path[-1]]


def count_all(words: set[str], pieces: dict[str, float], byte_score: float = BYTE_SCORE) -> dict[str, int]:
    """Tokens of each word with the mark before it."""
    trie = Trie(pieces, byte_score)
    return {w: trie.count(w) for w in words}


def count_tokens(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", byte_score: float = BYTE_SCORE) -> DataFrame:
    """Per row: the id, n_words, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        trie = Trie(shared.value, byte_score)
        for batch in batches:
            text = [_WORD.findall(t.as_py() or "") for t in batch.column("text")]
            counts = {w: trie.count(w) for w in set().union(*text)}
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(w) for w in text], pa.int64()), pa.array([sum(map(counts.__getitem__, w)) for w in text], pa.int64())], [id_col, "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as id", "text").mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long")
