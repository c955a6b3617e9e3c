"""Near-duplicate passages by compact windows.

A text is a sequence of hashed 5-word shingles. Under a hash function, all stretches of it that contain position c, lie
between l and r and have their least hash at c share one signature: (l, c, r) is a compact window, a node of the
Cartesian tree over the hashes. Of the stretches only those of the shortest passage's width matter: a node groups those that
start from max(l, c - width + 1) to min(c, r - width + 1). These intervals are the runs of equal minima over a sliding window, so those of all functions are
read off with a few vectorised minima; ``cartesian_windows`` builds the tree itself, and the tests hold the two against each other.

Functions are taken in bands. The intervals of the functions of a band are joined in each text: a cell (lo, hi) holds the
starts at which all of them agree on one tuple of signatures, and cells of different texts meet by equality of the tuple. A pair of windows of Jaccard similarity s
agrees in a band of two functions with probability s ** 2, in one of the four bands at 0.8 with 0.98, and a passage longer than the shortest has many windows.

The members of a bucket are compared with its smallest text; a passage is verified by its shingles: Jaccard similarity at least ``percent``.
Cells that no verified passage covers, often those of a frequent phrase shorter than a passage, are looked up by single shingles:
a passage leaves few shingles of a window unmatched, so one of the rarest few of each window is in both texts. Each such shingle's texts are compared with a
growing number of the smallest ones until every one is settled by a verified passage or has met all others. There is one way for
buckets of every size, and no text is dropped unsettled. Identical texts are put behind one representative first.

Verified passages are joined into classes: the passages of a text that overlap are one member, and a class is a connected component of members.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, discard, only, without
from .tokens import scramble, shingles, token_hashes

WIDTH = 5
#: Functions of a band, bands.
FUNCTIONS, BANDS = 2, 4
#: What is not settled is compared with FIRST, then FIRST * GROWTH, then FIRST * GROWTH ** 2 .. of the texts that have its rare shingle.
FIRST, GROWTH = 8, 16
#: Characters of the texts that are compared at a time.
SLICE = 1 << 21
#: Keys that a task holds before it hands them on.
KEYS = 1 << 17
PASSAGES = "doc_id long, begin_word long, n_words long, source_doc_id long, source_begin_word long, source_n_words long, similarity double"


def cartesian_windows(h: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Compact windows (l, c, r), both ends included, of at least ``least`` positions, by the stack that builds the tree."""
    left, right, stack = [0] * len(h), [len(h) - 1] * len(h), []
    for i, v in enumerate(h):
        while stack and h[stack[-1]] > v:
            right[stack.pop()] = i - 1
        left[i] = stack[-1] + 1 if stack else 0
        stack.append(i)
    return [(left[c], c, right[c]) for c in range(len(h)) if right[c] - left[c] + 1 >= least]


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` positions of the last axis, by doubling."""
    span, m, n = 1, h, h.shape[-1]
    while span * 2 <= width:
        m = np.minimum(m[..., :-span], m[..., span:])
        span *= 2
    return np.minimum(m[..., : n - width + 1], m[..., width - span : width - span + n - width + 1])


def minima(s: np.ndarray, least: int) -> np.ndarray:
    """A row per function: its least hash in the window at each start. Equal neighbours are the starts of one compact window."""
    salts = scramble(np.arange(1, FUNCTIONS * BANDS + 1, dtype=np.uint64), 91)[:, None]
    return sliding_min(scramble(s[None, :] ^ salts), least)


def cells(s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, lo, hi)``: the intervals of starts on which the compact windows of all functions of a band meet."""
    low = minima(s, least)
    turns = low[:, 1:] != low[:, :-1]
    keys, los, his = [], [], []
    for b in range(BANDS):
        own = slice(b * FUNCTIONS, (b + 1) * FUNCTIONS)
        lo = np.concatenate(([0], np.flatnonzero(turns[own].any(0)) + 1))
        key = np.zeros(len(lo), np.uint64)
        for v in low[own][:, lo]:
            key = scramble(key * np.uint64(0x100000001B3) + v, 57 + b)
        keys.append(key)
        los.append(lo)
        his.append(np.append(lo[1:] - 1, low.shape[1] - 1))
    return np.concatenate(keys), np.concatenate(los), np.concatenate(his)


def _signed(least: int):
    def rows(ids: list, found: list) -> pd.DataFrame:
        key, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = np.repeat(np.array(ids, np.int64), [len(k) for k, *_ in found])
        return pd.DataFrame({"key": key.view(np.int64), "doc": doc, "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)})

    def run(frames):
        for pdf in frames:
            ids, found, held = [], [], 0
            for i, h in token_hashes(pdf["text"].tolist()):
                s = shingles(h, WIDTH)
                if len(s) < least:
                    continue
                ids.append(pdf["doc_id"].iat[i])
                found.append(cells(s, least))
                held += len(found[-1][0])
                if held > KEYS:
                    yield rows(ids, found)
                    ids, found, held = [], [], 0
            if ids:
                yield rows(ids, found)

    return run


def _needed(least: int, percent: int) -> int:
    """Shingles of a window of a passage that occur in its source, at least."""
    return int(np.ceil(2 * percent / (100 + percent) * least - 1e-9))


def _batched(found):
    """Rows ``(key, doc, place)`` of what ``found`` yields a text, handed on when more than KEYS are held."""

    def rows(held: list) -> pd.DataFrame:
        ids, keys, places = zip(*held, strict=True)
        doc = np.repeat(np.array(ids, np.int64), [len(k) for k in keys])
        return pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "doc": doc, "place": np.concatenate(places).astype(np.int32)})

    def run(frames):
        held, n = [], 0
        for pdf in frames:
            for x in found(pdf):
                held.append(x)
                n += len(x[1])
                if n > KEYS:
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)

    return run


def _distinct(least: int):
    """The shingles in and near the windows of the cells of each text, and the first place of each."""

    def found(pdf):
        for i, h in token_hashes(pdf["text"].tolist()):
            s = shingles(h, WIDTH)
            inside = np.zeros(len(s) + 1, np.int32)
            for x in (*pdf["cells"].iat[i], *pdf["near"].iat[i]):
                inside[max(0, x["lo"] - least // 4)] += 1
                inside[min(len(s), x["hi"] + least + least // 4)] -= 1
            at = np.flatnonzero(np.cumsum(inside[:-1]))
            keys, first = np.unique(s[at], return_index=True)
            yield pdf["doc_id"].iat[i], keys, at[first]

    return _batched(found)


def rare_places(count: np.ndarray, starts: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Places of the rarest shingles of the windows at ``starts``, of which one at least is matched wherever a window is.

    ``count`` has the texts with the shingle of each place, 1 for those that no other text has. Windows with too many of these match nowhere.
    """
    spare = min(least - _needed(least, percent), least - 1)
    near = np.lib.stride_tricks.sliding_window_view(count, least)[starts]
    able = (near == 1).sum(1) <= spare
    places = np.unique(starts[able][:, None] + np.argpartition(near[able], spare, axis=1)[:, : spare + 1])
    return places[count[places] > 1]


def _probes(least: int, percent: int):
    def found(pdf):
        for i, h in token_hashes(pdf["text"].tolist()):
            s = shingles(h, WIDTH)
            shared = np.array(pdf["shared"].iat[i], np.int64).view(np.uint64)
            order = np.argsort(shared)
            at = np.minimum(np.searchsorted(shared, s, sorter=order), len(shared) - 1)
            count = np.where(shared[order][at] == s, np.array(pdf["counts"].iat[i], np.int64)[order][at], 1)
            starts = np.unique(np.concatenate([np.arange(x["lo"], x["hi"] + 1) for x in pdf["cells"].iat[i]]))
            at = rare_places(count, starts, least, percent)
            yield pdf["doc_id"].iat[i], s[at], at

    return _batched(found)


def passages(a: np.ndarray, b: np.ndarray, least: int, percent: int, order: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """Verified passages ``(begin, end, source begin, source end, similarity)`` of shingle sequence a in b.

    Windows of a in which enough shingles occur in b are merged; each stretch is matched to the places in b near
    its main diagonal and kept if the two sets of shingles are similar enough. ``order`` is the stable order of b, where it is known.
    """
    order = np.argsort(b, kind="stable") if order is None else order
    ranked = b[order]
    at = np.minimum(np.searchsorted(ranked, a), len(b) - 1)
    hit = ranked[at] == a
    need = _needed(least, percent)
    total = np.concatenate(([0], np.cumsum(hit)))
    good = np.flatnonzero(total[least:] - total[: len(total) - least] >= need)
    out = []
    if not len(good):
        return out

    def match(lo: int, end: int) -> bool:
        on = np.flatnonzero(hit[lo:end]) + lo
        if on[-1] + 1 - on[0] >= least:
            lo, end = int(on[0]), int(on[-1]) + 1
        # occurrences in b: the first of each shingle, then those near the median offset
        where = order[at[on]]
        offset = where - on
        close = np.abs(offset - np.median(offset)) <= max(least, (end - lo) // 4)
        if not close.any():
            return False
        i, j = int(where[close].min()), int(where[close].max()) + 1
        x = np.unique(a[lo:end])
        # repeated shingles were placed at their first occurrence only
        reach = b[j : i + (end - lo)]
        more = np.isin(reach, x)
        j += int(np.argmin(more)) if len(more) and not more.all() else len(more)
        y = np.unique(b[i:j])
        both = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * both < percent * (len(x) + len(y) - both):
            return False
        out.append((lo, end, i, j, both / (len(x) + len(y) - both)))
        return True

    for lo, hi in _spans(good):
        if match(lo, hi + least) or hi == lo:
            continue
        # scattered changes made the stretch too different as a whole: its equal parts, then its best windows
        count = total[lo + least : hi + least + 1] - total[lo : hi + 1]
        free = np.ones(len(count), bool)
        for first, last in _spans(np.flatnonzero(count == least)):
            if match(lo + first, lo + last + least):
                free[max(0, first - least + 1) : last + least] = False
        while free.any():
            k = int(np.argmax(np.where(free, count, -1)))
            match(lo + k, lo + k + least)
            free[max(0, k - least + 1) : k + least] = False
    return out


def _spans(places: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of neighbouring places."""
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate(([0], breaks + 1))].tolist(), places[np.concatenate((breaks, [len(places) - 1]))].tolist(), strict=True))


def _verify(least: int, percent: int):
    def run(frames):
        for pdf in frames:
            # slices of bounded length; in each a text is hashed once and a source sorted once
            length = (pdf["ta"].str.len() + pdf["tb"].str.len()).cumsum()
            for _, part in pdf.groupby((length // SLICE).to_numpy(), sort=False):
                yield pd.DataFrame(_compared(part, least, percent), columns=[c.split()[0] for c in PASSAGES.split(", ")])

    return run


def _compared(pdf: pd.DataFrame, least: int, percent: int) -> list[tuple]:
    code, once = pd.factorize(np.concatenate((pdf["ta"].to_numpy(object), pdf["tb"].to_numpy(object))))
    sets = {i: shingles(h, WIDTH) for i, h in token_hashes(list(once))}
    code = code.reshape(2, len(pdf)).tolist()
    orders = {y: np.argsort(sets[y], kind="stable") for y in set(code[1])}
    rows = []
    for a, b, x, y in zip(pdf["a"].tolist(), pdf["b"].tolist(), *code, strict=True):
        for lo, end, at, stop, similarity in passages(sets[x], sets[y], least, percent, orders[y]):
            rows.append((a, lo, end - lo + WIDTH - 1, b, at, stop - at + WIDTH - 1, similarity))
    return rows


def repeated_passages(
    docs: DataFrame, min_words: int = 50, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Classes of passages of at least ``min_words`` words that several documents have, a row per member.

    ``kind`` is 'passage' or, for identical whole texts, 'text'. A member is a stretch of a document (``begin_word``, ``n_words``); its class is named by the
    first one, ``class_doc_id`` and ``class_begin_word`` (itself for the first). ``n_links`` counts the members of other texts that it
    was verified against, ``similarity`` is the largest of theirs; both are null for a text. Of identical texts only the smallest id is compared with other texts.
    Null and shorter texts have no passages; very long ones are searched whole. Rows without an id are not searched; repeated rows count once. Ties of
    equal passages go to the smaller id and place. An empty table gives no rows. Other columns are ignored.
    """
    verified, copies = links(docs, min_words, percent, id_col, text_col)
    rows = verified.select("doc_id", "begin_word", (F.col("begin_word") + F.col("n_words")).alias("end"), "source_doc_id", "source_begin_word", (F.col("source_begin_word") + F.col("source_n_words")).alias("source_end"), "similarity")
    # places of a text are summed up before they meet, so a source of very many texts is as many rows as it has places
    places = rows.select(F.col("doc_id").alias("doc"), F.col("begin_word").alias("at"), "end").union(rows.select("source_doc_id", "source_begin_word", "source_end"))
    places = places.groupBy("doc", "at").agg(F.max("end").alias("end"))
    before = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("at") < F.max("end").over(before), None).otherwise(F.col("at"))
    places = places.withColumn("opens", opens).withColumn("begin", F.last("opens", ignorenulls=True).over(Window.partitionBy("doc").orderBy("at")))
    places = cut(places.select("doc", "at", "end", F.struct("doc", "begin").alias("member")), "places")
    named = lambda doc, at, name: places.select(F.col("doc").alias(doc), F.col("at").alias(at), F.col("member").alias(name))
    edges = cut(rows.join(named("doc_id", "begin_word", "a"), ["doc_id", "begin_word"]).join(named("source_doc_id", "source_begin_word", "b"), ["source_doc_id", "source_begin_word"]).groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "edges")
    found = components(edges, "a", "b")
    degree = edges.select(F.col("a").alias("id"), "similarity").union(edges.select("b", "similarity")).groupBy("id").agg(F.count("*").alias("n_links"), F.max("similarity").alias("similarity"))
    members = places.groupBy(F.col("member").alias("id")).agg((F.max("end") - F.min("at")).alias("n_words")).join(found, "id").join(degree, "id")
    members = members.select(F.lit("passage").alias("kind"), F.col("id.doc").alias("doc_id"), F.col("id.begin").alias("begin_word"), "n_words", F.col("component.doc").alias("class_doc_id"), F.col("component.begin").alias("class_begin_word"), "n_links", "similarity")
    copies = copies.where(F.col("n") >= min_words)
    copied = copies.select("doc_id", "n", "rep").union(copies.groupBy("rep").agg(F.max("n").alias("n")).select("rep", "n", "rep"))
    zero, none = F.lit(0).cast("long"), F.lit(None)
    return members.union(copied.select(F.lit("text"), "doc_id", zero, "n", "rep", zero, none.cast("long"), none.cast("double")))


def links(docs: DataFrame, min_words: int = 50, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The verified passages between different texts (a row each, the columns of ``PASSAGES``), and the copies ``(doc_id, rep, n)``."""
    least = min_words - WIDTH + 1
    docs = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    same = F.md5("text").alias("h")
    ids = cut(docs.select("doc_id", same), "ids")
    first = cut(ids.groupBy("h").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "first")
    # words are counted in one text of each group of copies only
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("long")
    sizes = only(docs, first.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select(same, "text").join(first.select("h"), "h", "left_semi").groupBy("h").agg(F.max(words).alias("n"))
    copies = cut(ids.join(first.join(sizes, "h"), "h").where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("n").alias("n")), "copies")
    found: list[DataFrame] = []
    tested: list[DataFrame] = []
    whole = lambda tables: functools.reduce(DataFrame.union, tables)
    covers = lambda least: F.greatest("lo", F.col("begin_word") - least // 2) <= F.least("hi", F.col("end") - (least - least // 2))
    hold = lambda a, b: whole(found).select(F.col("doc_id").alias(a), F.col("source_doc_id").alias(b), "begin_word", (F.col("begin_word") + F.col("n_words") - WIDTH + 1).alias("end"), "similarity")

    def verify(pairs: DataFrame) -> None:
        pairs = cut(pairs.join(whole(tested), ["a", "b"], "left_anti") if tested else pairs, "pairs")
        tested.append(pairs)
        if found and pairs.isEmpty():
            return
        wanted = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "wanted")
        texts = cut(only(docs, wanted, "doc_id"), "texts")
        wide = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        wide = wide.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
        found.append(cut(wide.mapInPandas(_verify(least, percent), PASSAGES), "passages"))
        discard(wanted, texts)

    # counts and the smallest id are summed before they are shuffled: a signature that a third of all texts has is no hot row
    pool = without(docs, copies.select("doc_id"), "doc_id")
    signed = cut(pool.mapInPandas(_signed(least), "key long, doc long, lo int, hi int"), "signed")
    groups = cut(signed.groupBy("key").agg(F.min("doc").alias("pivot"), F.max("doc").alias("last")).where("pivot <> last").drop("last"), "groups")
    shared = cut(signed.join(groups, "key").where("doc <> pivot"), "shared")
    discard(signed)
    verify(shared.select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct())
    covered = shared.join(hold("doc", "pivot"), ["doc", "pivot"]).where(covers(least)).groupBy("key", "doc", "lo").agg(F.max("similarity").alias("similarity"))
    state = cut(shared.join(covered, ["key", "doc", "lo"], "left"), "state")
    # two texts that met alone have met all others of their bucket
    several = F.col("first") != F.col("last")
    buckets = state.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count_if(F.col("similarity").isNull()).alias("c")).where(several & (F.col("c") > 0)).select("key")
    open_keys = cut(buckets, "open")
    rest = state.where("similarity is null").join(open_keys, "key", "left_semi")
    # a text that is near to the smallest one, but not equal, can still be near to one that is not
    near = state.where("similarity < 1").join(open_keys, "key", "left_semi").groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.struct("lo", "hi")).alias("near"))
    probing = rest.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.struct("lo", "hi")).alias("cells"))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    spans = cut(probing.join(near, "doc_id", "full").select("doc_id", F.coalesce("cells", none).alias("cells"), F.coalesce("near", none).alias("near")), "spans")
    if not spans.isEmpty():
        texts = cut(only(docs, spans.select("doc_id"), "doc_id").dropDuplicates(["doc_id"]).join(spans, "doc_id"), "texts")
        index = cut(texts.mapInPandas(_distinct(least), "key long, doc long, place int"), "index")
        common = cut(index.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "common")
        index = cut(index.join(common, "key"), "common")
        counts = index.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("key").alias("shared"), F.collect_list("c").alias("counts"))
        probes = cut(texts.where(F.size("cells") > 0).join(counts, "doc_id").mapInPandas(_probes(least, percent), "key long, doc long, place int"), "probes")
        members = cut(index.join(probes.select("key").distinct(), "key", "left_semi").select("key", "doc").distinct(), "members")
        discard(texts, index, common)
        pivots = FIRST
        while not probes.isEmpty():
            rank = F.row_number().over(Window.partitionBy("key").orderBy("doc"))  # limited before the shuffle, too
            smallest = members.withColumn("r", rank).where(F.col("r") <= pivots).select("key", F.col("doc").alias("b"))
            pairs = cut(probes.withColumnRenamed("doc", "a").join(smallest, "key").where("a <> b"), "probed")
            verify(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
            mirror = whole(found).select("source_doc_id", "doc_id", "source_begin_word", F.col("source_begin_word") + F.col("source_n_words") - WIDTH + 1, "similarity")
            both = hold("a", "b").union(mirror)
            settled = pairs.join(both, ["a", "b"]).where((F.col("place") < F.col("end")) & (F.col("place") >= F.col("begin_word"))).select("key", F.col("a").alias("doc"), "place").distinct()
            more = members.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > pivots).select("key")
            probes = cut(probes.join(settled, ["key", "doc", "place"], "left_anti").join(more, "key", "left_semi"), "left")
            members = cut(members.join(probes.select("key").distinct(), "key", "left_semi"), "members")
            discard(pairs)
            pivots *= GROWTH
    return whole(found).distinct(), copies
