"""Token counts of greedy longest-match word pieces, by an automaton that never builds the pieces.

The vocabulary is a trie over bytes. Each node has a failure link (where matching goes on once the tokens that end
inside its string are popped) and the number of tokens popped on the way. Moves for all bytes, failures resolved,
are laid out in one table, so a byte costs one look-up, and a count is linear in the length of a word.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAILED = -1


class Automaton:
    """Counts word pieces. ``first`` are the pieces that may start a word, ``rest`` those that may go on with it."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        children: list[dict[int, int]] = [{}, {}]
        token = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                at = root
                for byte in piece:
                    nxt = children[at].get(byte)
                    if nxt is None:
                        nxt = children[at][byte] = len(children)
                        children.append({})
                        token.append(False)
                    at = nxt
                token[at] = at > 1
        n = len(children)
        # The last row is the state of a word that no pieces spell: nothing leaves it.
        self.failed = n
        move = np.full((n + 1, 256), n, np.int32)
        pops = np.zeros((n + 1, 256), np.int16)
        link = np.full(n + 1, n, np.int32)
        popped = np.zeros(n + 1, np.int16)
        drain = np.zeros(n + 1, np.int16)
        drain[n] = FAILED
        level = np.array([0, 1])
        while len(level):
            # Links of a level are known and lead to nodes less deep, whose rows are done.
            above = link[level]
            move[level] = move[above]
            pops[level] = pops[above] + popped[level, None]
            drain[level] = np.where(drain[above] == FAILED, FAILED, drain[above] + popped[level])
            drain[level[level < 2]] = 0
            edges = [(v, b, c) for v in level.tolist() for b, c in children[v].items()]
            if not edges:
                break
            v, b, c = (np.array(x) for x in zip(*edges, strict=True))
            ends = np.array([token[k] for k in c.tolist()])
            link[c] = np.where(ends, 1, move[link[v], b])
            popped[c] = np.where(ends, 1, popped[v] + pops[link[v], b])
            move[v, b] = c
            pops[v, b] = 0
            level = c
        self.move, self.drain = move, drain
        self.pops = pops.astype(np.uint8) if pops.max() < 256 else pops

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word: all words move on by one byte at a time. A word that can't be spelled counts as one."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state = np.zeros(len(words), np.int64)
        total = np.zeros(len(words), np.int64)
        alive = len(words)
        for t in range(int(lengths[0]) if len(words) else 0):
            alive = int(np.searchsorted(-lengths[:alive], -t, side="left"))
            byte = data[starts[:alive] + t]
            now = state[:alive]
            total[:alive] += self.pops[now, byte]
            state[:alive] = self.move[now, byte]
        end = self.drain[state]
        out = np.empty(len(words), np.int64)
        out[order] = np.where((state == self.failed) | (end == FAILED), 1, total + end)
        out[order[lengths == 0]] = 0
        return out


@lru_cache(1)
def _automaton(pieces: tuple[bytes, ...]) -> Automaton:
    """Built once in each Python worker."""
    return Automaton(pieces, pieces)


def word_end_vocabulary(path: str) -> tuple[list[bytes], bytes]:
    """The pieces of a tokenizer file whose last pieces of a word end in a mark, and the mark, as bytes of the text.

    The file spells bytes as printable characters: those that print are themselves, the others follow from 256 on.
    """
    with open(path, encoding="utf-8") as lines:
        model = json.load(lines)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}
    mark = model["end_of_word_suffix"]
    end = b"\xff"  # no byte of UTF-8 text
    pieces = []
    for piece in model["vocab"]:
        body = piece.removesuffix(mark)
        if body and all(c in byte_of for c in body):
            pieces.append(bytes(byte_of[c] for c in body) + (end if piece != body else b""))
    return pieces, end


def count_tokens(docs: DataFrame, pieces: list[bytes], end: bytes = b"", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of greedy longest-match pieces of each whole text.

    Words are lower-cased runs without white space, each followed by ``end``, and a text's count is the sum of its
    words'. A word is counted once per batch. Null, empty and blank texts count 0. A column named ``out`` is
    replaced; other columns pass through. The vocabulary is a bounded table that every task gets.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(pieces))

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(shared.value)
        for texts in batches:
            known: dict[str, int] = {}
            rows = [
                np.fromiter((known.setdefault(w, len(known)) for w in t.lower().split()), np.int64) if t else np.empty(0, np.int64)
                for t in texts
            ]
            counts = automaton.counts([w.encode() + end for w in known])
            yield pd.Series([int(counts[r].sum()) for r in rows])

    return docs.withColumn(out, counted(F.col("text")))
