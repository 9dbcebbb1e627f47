"""Splitting oversized texts at natural boundaries, all greedy cuts at once by pointer doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.tokens import COMPILED, token_count

#: Ends of sentences and of clauses, as last character of a token.
SENTENCE, CLAUSE = ".!?…。！？", ",;:，；、"


def successors(strong: np.ndarray, weak: np.ndarray, last: np.ndarray, piece: int, overlap: int) -> np.ndarray:
    """End of the piece that begins at each token position, for many texts laid end to end.

    strong[p], weak[p]: the text pauses before position p. last[p]: end position of p's text. The
    farthest strong pause within reach ends the piece, else the farthest weak one, else the limit. A
    pause must lie beyond the overlap, or the next piece would not begin further on.
    """
    at = np.arange(len(strong))
    reach = np.minimum(at + piece, last)
    end = reach.copy()
    found = reach == last
    for pauses in (strong, weak):
        before = np.maximum.accumulate(np.where(pauses, at, -1))[reach]
        use = ~found & (before > at + overlap)
        end[use] = before[use]
        found |= use
    return end


def greedy_starts(end: np.ndarray, last: np.ndarray, first: np.ndarray, overlap: int) -> np.ndarray:
    """Positions where pieces begin: those reached from each text's first position.

    The successor table (begin -> next begin) is squared until every pointer has run out; what
    was reached so far is sent through each power, so a text of k pieces takes log2(k) rounds.
    """
    done = end == last
    jump = np.where(done, len(end), end - overlap)
    jump = np.append(jump, len(end))  # position len(end): past all texts
    reached = np.zeros(len(jump), bool)
    reached[first] = True
    while True:
        to = jump[np.flatnonzero(reached)]
        reached[to] = True
        if (jump == len(end)).all():
            break
        jump = jump[jump]
    return np.flatnonzero(reached[:-1])


def cut_batch(texts: list[str], piece: int, overlap: int) -> list[list[tuple[int, int, int, int]]]:
    """Per text its pieces as (first token, end token, first character, end character)."""
    spans, strong, weak, sizes = [], [], [], []
    for text in texts:
        s = [m.span() for m in COMPILED.finditer(text)]
        spans.append(s)
        sizes.append(len(s))
        st, wk = np.zeros(len(s) + 1, bool), np.zeros(len(s) + 1, bool)
        for i in range(len(s) - 1):
            gap = text[s[i][1] : s[i + 1][0]]
            if gap:
                mark = text[s[i][1] - 1]
                st[i + 1] = "\n" in gap or "\r" in gap or mark in SENTENCE
                wk[i + 1] = mark in CLAUSE
        strong.append(st)
        weak.append(wk)
    first = np.concatenate([[0], np.cumsum([n + 1 for n in sizes])[:-1]]).astype(np.int64)
    last = np.repeat(first + sizes, [n + 1 for n in sizes])
    end = successors(np.concatenate(strong), np.concatenate(weak), last, piece, overlap)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    owner = np.repeat(np.arange(len(texts)), [n + 1 for n in sizes])
    for p in greedy_starts(end, last, first, overlap):
        k = owner[p]
        a, z = int(p - first[k]), int(end[p] - first[k])
        if z > a:
            out[k].append((a, z, spans[k][a][0], spans[k][z - 1][1]))
    return out


#: Characters of text worked on at once; a longer text makes a batch of its own.
BATCH_CHARS = 4_000_000


def pieces(df: DataFrame, key: str, text: str, *, piece: int, overlap: int, with_text: bool = True) -> DataFrame:
    """(key, piece_no, first_token, end_token, piece_text): each text of `df` as consecutive pieces.

    A piece has at most `piece` tokens and ends where the text pauses (line, sentence, else clause)
    if such a place lies within reach. Two neighbours share exactly `overlap` tokens, which must be
    fewer than `piece`. A text within the limit is one piece; null, empty and blank texts have none.
    Texts are read whole; only those beyond the limit go to Python. Nothing is shuffled: the tables of positions live with their text.
    Only `key` and `text` are read; the key is passed through, repeated rows give their pieces again.

    with_text: False leaves piece_text null, for callers that need the cuts only.
    """
    if not 0 <= overlap < piece:
        raise ValueError("overlap must be from 0 to piece - 1")
    kind = df.schema[key].dataType.simpleString()
    sized = df.select(df[key].alias("k"), df[text].alias("t"), token_count(df[text]).alias("n"))
    rows = sized.filter(F.col("n") > piece).select("k", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, keys = b["t"].tolist(), b["k"].tolist()
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= BATCH_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                cuts = cut_batch(texts[at:stop], piece, overlap)
                rows_ = [(k, i + 1, a, z, t[ca:cz] if with_text else None) for k, t, c in zip(keys[at:stop], texts[at:stop], cuts) for i, (a, z, ca, cz) in enumerate(c)]
                yield pd.DataFrame(rows_, columns=["k", "piece_no", "first_token", "end_token", "piece_text"])
                at = stop

    out = rows.mapInPandas(run, f"k {kind}, piece_no int, first_token int, end_token int, piece_text string")
    # A text within the limit is its own piece; it never leaves the JVM.
    own = F.regexp_extract("t", r"(?Us)^\s*+(.*\S)", 1) if with_text else F.lit(None).cast("string")
    short = sized.filter(F.col("n").between(1, piece)).select("k", F.lit(1).alias("piece_no"), F.lit(0).alias("first_token"), F.col("n").alias("end_token"), own.alias("piece_text"))
    return short.unionByName(out).withColumnRenamed("k", key)
