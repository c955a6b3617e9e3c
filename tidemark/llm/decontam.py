"""Benchmark decontamination by greedy string tiling.

Words are lower-cased and stripped of ASCII symbols. Five-word seeds shared with the benchmark select the pairs of a document and an
item; a pair whose seeds cannot reach the threshold is dropped. The others are tiled by running Karp-Rabin: prefix hashes give
the hash of any window, so all unmarked windows of a search length are matched at once, matches are extended as far as
they go and marked longest first, and the search length falls until it reaches the seed width. The share of an
item's words under tiles is its coverage, whatever the order in which its passages stand in the document.

The benchmark goes to the executors in blocks of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import shingles, token_hashes

MATCHES = "doc_id long, item_id long, item_words long, matched_words long, n_tiles long, coverage double"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Rolling:
    """Karp-Rabin hashes of every window of a token sequence, for any width."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, n = tokens, len(tokens)
        self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE, np.uint64))), dtype=np.uint64)
        self.prefix = np.zeros(n + 1, np.uint64)
        for i in range(n):
            self.prefix[i + 1] = self.prefix[i] * _BASE + tokens[i]

    def windows(self, width: int) -> np.ndarray:
        return self.prefix[width:] - self.prefix[: len(self.prefix) - width] * self.power[width]


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(marked)))
    return total[width:] == total[: len(total) - width]


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(item position, document position, length)``, none shorter than ``least``."""
    with np.errstate(over="ignore"):
        a, b = Rolling(item), Rolling(doc)
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    found: list[tuple[int, int, int]] = []
    width = min(len(item), len(doc))
    while width >= least:
        ha, hb = a.windows(width), b.windows(width)
        pa = np.flatnonzero(_free(in_item, width) & np.isin(ha, hb))
        matches = []
        if len(pa):
            pb = np.flatnonzero(_free(in_doc, width) & np.isin(hb, ha[pa]))
            at = defaultdict(list)
            for j in pb:
                at[hb[j]].append(int(j))
            for i in map(int, pa):
                for j in at.get(ha[i], ()):
                    if i and j and item[i - 1] == doc[j - 1] and not in_item[i - 1] and not in_doc[j - 1]:
                        continue  # part of the match that starts one word earlier
                    n = width
                    while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not in_item[i + n] and not in_doc[j + n]:
                        n += 1
                    matches.append((-n, i, j))
        again = False
        for n, i, j in sorted(matches):
            n = -n
            if in_item[i : i + n].any() or in_doc[j : j + n].any():
                again = True  # what a longer tile left of it is found at this width or a smaller one
                continue
            in_item[i : i + n] = True
            in_doc[j : j + n] = True
            found.append((i, j, n))
        if not again:
            width = width // 2 if width // 2 > least else (least if width > least else 0)
    return found


def _matcher(index: dict, least: int, threshold: float):
    seeds, owners, items = index["seeds"], index["owners"], index["items"]

    def run(frames):
        for pdf in frames:
            out = []
            for r, h in token_hashes(pdf["text"].tolist(), letters_only=True):
                s = shingles(h, least)
                if len(h) < least or not len(seeds):
                    continue
                at = np.minimum(np.searchsorted(seeds, s), len(seeds) - 1)
                hits = np.unique(at[seeds[at] == s])
                reach: dict[int, set] = defaultdict(set)
                for k in hits:
                    for item, i in owners[k]:
                        reach[item].update(range(i, i + least))
                for item, words in sorted(reach.items()):
                    own = items[item]
                    if len(words) >= threshold * len(own):
                        t = tiles(own, h, least)
                        n = sum(x[2] for x in t)
                        if n >= threshold * len(own):
                            out.append((int(pdf["doc_id"].iat[r]), item, len(own), n, len(t), n / len(own)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MATCHES.split(", ")])

    return run


def _index(rows, least: int) -> dict:
    items, owners = {}, defaultdict(list)
    for k, h in token_hashes([r["text"] for r in rows], letters_only=True):
        if len(h) >= least:
            items[rows[k]["item_id"]] = h.copy()
            for i, s in enumerate(shingles(h, least).tolist()):
                owners[s].append((rows[k]["item_id"], i))
    seeds = np.array(sorted(owners), np.uint64)
    return {"seeds": seeds, "owners": [owners[int(s)] for s in seeds], "items": items}


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.6,
    id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20,
) -> DataFrame:
    """``(doc_id, item_id, item_words, matched_words, n_tiles, coverage)`` for every pair that reaches the threshold.

    Items and documents of fewer than ``least`` words, null and empty ones among them, match nothing. Rows of ``docs`` without an id are
    not searched; repeated rows give repeated matches. Items with equal ids keep one text, the largest. Empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.max("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = max(1, math.ceil(total / block_bytes)), None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        shared = spark.sparkContext.broadcast(_index(rows, least))
        part = docs.mapInPandas(_lazy(shared, least, threshold), MATCHES)
        out = part if out is None else out.union(part)
    return out


def _lazy(shared, least: int, threshold: float):
    def run(frames):
        yield from _matcher(shared.value, least, threshold)(frames)

    return run
