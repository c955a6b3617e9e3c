"""N-gram Jaccard join by parity sketches.

The distinct shingles of a text flip bits of a sketch at the places their hashes name, so two sketches differ in at most as many bits as
the sets have elements in their symmetric difference. Sizes fall into overlapping bands by the smaller set of a pair: a Jaccard similarity t
bounds the difference by (1 - t) / t of that size, k at the upper end of the band. In a band the sketch is cut into
k + 1 + z parts; a pair within the bound agrees in more than z parts, in z + 1 - e at least that are not empty if one of the two has
e <= z empty ones. A part of a very long sparse sketch is held as the XOR of the hashes of its shingles.

Since a pair agrees in several parts, a text needs to be looked up only by its rarest ones: of the parts that some other text has too, all but
the ``need - 1`` most frequent (in one order for all texts, so that the rarest common part of a pair is kept on both sides). What is kept
of parts is joined on equality, compared by the Hamming distance of a short sketch, and last by the shingles.

Equal sets are first put behind one representative. In each group of equal parts the members are compared with the smallest id.
Only groups that hold several components after that are looked into again, each set of members once. Small ones give their pairs of different
components; large ones that are connected by members are one group, where that is less work, and such a group is cut into blocks, and each pair of blocks is one task's worth of sketches, so that only pairs whose sketches
allow a link come out. Its largest component is not compared with itself. No pair is lost.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, discard, only, without
from .tokens import scramble, shingles, token_hashes

#: Ratio of the lower ends of neighbouring size bands.
STEP = 1.5
#: Groups up to this size are compared pair by pair.
SMALL = 32
#: Members of a block of a large group.
BLOCK = 256
#: Slices of the keys of parts that are counted and joined one after the other.
SLICES = 4


def bands(n: int, percent: int) -> list[tuple[int, int, int]]:
    """``(band, k, z)`` for each band that a set of n shingles belongs to; bands with k = 0 hold equal sets only."""
    found, top = [], int(np.floor(np.log(n) / np.log(STEP) + 1e-9))
    for g in range(max(0, top - 3), top + 1):
        low, high = STEP**g, STEP ** (g + 1)
        if low - 1e-9 <= n <= high * 100 / percent + 1e-9 and (k := int(high * (100 - percent) / percent + 1e-9)):
            found.append((g, k, 4 + k // 4))
    return found


def width_of(n: int, percent: int) -> int:
    """Bits of the short sketch of a set: eight for each element by which a set of its size may differ, as a power of two."""
    return 1 << max(6, int(16 * n * (100 - percent) / (100 + percent)).bit_length())


def parts(distinct: np.ndarray, count: int, band: int) -> tuple[np.ndarray, int]:
    """Keys of the parts of the sketch, and how many parts are empty; the keys of empty parts stand last."""
    x = scramble(distinct, 101)
    order = np.argsort(x)
    at = ((x[order] >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    running = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(scramble(distinct[order], 11))))
    cuts = np.searchsorted(at, np.arange(count + 1, dtype=np.uint64))
    word, empty = running[cuts[1:]] ^ running[cuts[:-1]], cuts[1:] == cuts[:-1]
    keys = scramble(word + np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), band)
    return np.concatenate((keys[~empty], keys[empty])), int(empty.sum())


def sketch(distinct: np.ndarray, bits: int) -> np.ndarray:
    """The parity sketch of ``bits`` bits."""
    return np.bincount((scramble(distinct, 5) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1


def _packed(distinct: np.ndarray, percent: int) -> bytes:
    return np.packbits(sketch(distinct, width_of(len(distinct), percent)).astype(np.uint8)).tobytes()


def _sketched(width: int, percent: int):
    def run(frames):
        for pdf in frames:
            cols: dict[str, list] = {c.split()[0]: [] for c in SKETCHES.split(", ")}
            for i, h in token_hashes(pdf["text"].tolist()):
                s = np.unique(shingles(h, width))
                own = (pdf["doc_id"].iat[i], len(s), int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0, int(np.bitwise_xor.reduce(scramble(s, 7)).view(np.int64)) if len(s) else 0)
                for j, (g, k, z) in enumerate((bands(len(s), percent) if len(s) else []) or [(-1, 0, 0)]):
                    keys, empty = parts(s, k + 1 + z, g) if k else (np.zeros(0, np.uint64), 0)
                    need = 1
                    if k and empty <= z:
                        keys, need = keys[: len(keys) - empty], z + 1 - empty
                    for c, v in zip(cols, (*own, j == 0, g, need, keys.view(np.int64), _packed(s, percent) if j == 0 and len(s) else None), strict=True):
                        cols[c].append(v)
            yield pd.DataFrame(cols)

    return run


SKETCHES = "doc_id long, n long, h1 long, h2 long, first boolean, band int, need int, keys array<long>, bits binary"


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A packed sketch at a smaller power of two: parities of the places that fall together."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def apart(x: bytes, y: bytes) -> int:
    """Hamming distance of two packed sketches at the smaller of their sizes."""
    one, two = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(one), len(two))
    return int(np.bitwise_count(folded(one, size) ^ folded(two, size)).sum())


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _exact(width: int, percent: int):
    def run(frames):
        for pdf in frames:
            code, once = pd.factorize(np.concatenate((pdf["ta"].to_numpy(object), pdf["tb"].to_numpy(object))))
            sets = {i: np.unique(shingles(h, width)) for i, h in token_hashes(list(once))}
            code = code.reshape(2, len(pdf)).tolist()
            yield pdf[["a", "b"]][[_linked(sets[x], sets[y], percent) for x, y in zip(*code, strict=True)]]

    return run


def _near(percent: int):
    """The pairs whose sketches allow a link."""

    def run(frames):
        for pdf in frames:
            ok = [(100 + percent) * apart(x, y) <= (100 - percent) * n for x, y, n in zip(pdf["sa"], pdf["sb"], pdf["na"] + pdf["nb"], strict=True)]
            yield pdf[["a", "b"]][ok]

    return run


def _block_pairs(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iat[0]), int(pdf["j"].iat[0])
        sides, out = [], []
        for b in (i, j):
            side = pdf[pdf["b"] == b]
            by_size = [(len(k), side.loc[rows.index]) for k, rows in side.groupby(side["bits"].str.len()) for k in [rows["bits"].iat[0]]]
            sides.append([(size, np.frombuffer(b"".join(x["bits"]), np.uint8).reshape(len(x), size), x[["id", "c", "n"]].to_numpy()) for size, x in by_size])
        for size1, bits1, own1 in sides[0]:
            for size2, bits2, own2 in sides[1]:
                size = min(size1, size2)
                one, two = folded(bits1.T, size).T, folded(bits2.T, size).T
                for (a, c, n), x in zip(own1.tolist(), one, strict=True):
                    ids, parts_of, sizes = own2.T
                    ok = (parts_of != c) & (100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes)) & ((ids > a) if i == j else True)
                    ok &= (100 + percent) * np.bitwise_count(two ^ x).sum(1, dtype=np.int64) <= (100 - percent) * (n + sizes)
                    out.extend((min(a, other), max(a, other)) for other in ids[ok].tolist())
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _blocks(size: Column) -> Column:
    return F.ceil(size / BLOCK).cast("int")


def _sizes(members: DataFrame, *by: str) -> DataFrame:
    """Members ``m`` of each group and its largest component ``top``."""
    each = members.groupBy(*by, "c").agg(F.count("*").alias("size"))
    return each.groupBy(*by).agg(F.sum("size").alias("m"), F.max(F.struct("size", "c")).alias("top"))


def _units(many: DataFrame) -> DataFrame:
    """``(whole, key, doc, c)``: what large groups ``(key, doc, c)`` are compared as.

    Near copies meet in nearly all their parts, so that hundreds of groups hold the same members but for a few, and each pair would be
    compared in each of them. Groups that are connected by members are therefore one group, unless the blocks of its members come to more
    rows than those of all its groups.
    """
    pivots = many.groupBy("key").agg(F.min("doc").alias("p"))
    cluster = cut(components(many.join(pivots, "key").where("doc <> p").select("doc", "p"), "doc", "p"), "clusters")
    many = cut(many.join(cluster.toDF("doc", "cluster"), "doc"), "placed")
    together = many.select("cluster", "doc", "c").distinct()
    size, rest = F.col("top.size"), F.col("m") - F.col("top.size")
    rows = F.sum(size * _blocks(rest) + rest * (_blocks(size) + _blocks(rest)))
    apart_, whole = (_sizes(x, *by).groupBy("cluster").agg(rows.alias(n)) for x, by, n in ((many, ("cluster", "key"), "each"), (together, ("cluster",), "once")))
    better = cut(apart_.join(whole, "cluster").where("once <= each").select("cluster"), "whole")
    found = only(together, better, "cluster").select(F.lit(True).alias("whole"), F.col("cluster").alias("key"), "doc", "c")
    return cut(found.union(without(many, better, "cluster").select(F.lit(False), "key", "doc", "c")), "units")


def _verified(pairs: DataFrame, bits: DataFrame, docs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The links among candidates ``(a, b)``. ``bits`` has ``(id, n, bits)`` once for each id."""
    side = lambda x: bits.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    near = cut(pairs.join(side("a"), "a").join(side("b"), "b").where(sized).mapInPandas(_near(percent), "a long, b long"), f"{name}-near")
    ids = cut(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), f"{name}-ids")
    texts = cut(only(docs, ids, "doc_id"), f"{name}-texts")
    wide = near.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    wide = wide.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    links = cut(wide.mapInPandas(_exact(width, percent), "a long, b long").distinct(), name)
    discard(near, ids, texts)
    return links


def ngram_join(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row: the components of the links with 100 |A∩B| >= percent |A∪B|.

    Null and empty texts have no shingles and link with nothing. Rows that repeat an id count as one document with
    the smallest of their sets' representatives; a row without an id has no component. A very long text has as many parts as
    its size asks for. An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(docs.where("doc_id is not null").mapInPandas(_sketched(width, percent), SKETCHES), "sketches")
    sets = cut(rows.where("first").select("doc_id", "n", "h1", "h2"), "sets")
    copies = sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    copied = cut(sets.join(copies, ["n", "h1", "h2"]).where("doc_id <> rep").select("doc_id", "rep").groupBy("doc_id").agg(F.min("rep").alias("rep")), "copied")
    # several texts under one id are not told apart by their parts: such an id is looked up by all of them
    again = cut(sets.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "again")
    whole = rows.where(F.size("keys") > 0).select("doc_id", "band", "need", "keys")
    if not again.isEmpty():
        whole = whole.join(again.withColumn("more", F.lit(True)), "doc_id", "left").withColumn("need", F.when(F.col("more"), 1).otherwise(F.col("need"))).drop("more")
    keys = without(whole, copied.select("doc_id"), "doc_id").select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc"), F.col("band").cast("byte").alias("band"), F.col("need").cast("int").alias("need"))

    # counts are summed before they are shuffled, so that a part that a third of all texts has is no hot row; slices of the keys follow each
    # other, so that only one slice is shuffled at a time
    found = []
    for i in range(SLICES):
        some = keys.where(F.pmod("key", F.lit(SLICES)) == i)
        common = cut(some.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "common")
        found.append(cut(some.join(common, "key"), "found"))
        discard(common)
    # the sketches with all their parts are the largest table; the result needs only the sets
    bits = cut(rows.where("first and n > 0").select(F.col("doc_id").alias("id"), "n", "bits").dropDuplicates(["id"]), "bits")
    discard(rows)
    shared = functools.reduce(DataFrame.union, found)
    own = Window.partitionBy("doc", "band")
    rank = F.row_number().over(own.orderBy("m", "key"))
    kept = shared.withColumns({"r": rank, "s": F.count("*").over(own)}).where(F.col("r") <= F.col("s") - F.col("need") + 1).select("key", "doc")
    kept = cut(kept, "kept")
    discard(*found)
    groups = kept.groupBy("key").agg(F.min("doc").alias("pivot"), F.max("doc").alias("last")).where("pivot <> last").select("key", "pivot")
    shared = cut(kept.join(groups, "key"), "shared")
    discard(kept)
    tested = cut(shared.where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct(), "pairs")
    if not again.isEmpty():
        bits = cut(without(bits, again.withColumnRenamed("doc_id", "id"), "id"), "bits")
    links = _verified(tested, bits, docs, width, percent, "links")
    found = cut(components(links, "a", "b"), "components")

    named = shared.select("key", "doc").join(found.withColumnRenamed("id", "doc"), "doc", "left").withColumn("c", F.coalesce("component", "doc")).drop("component")
    # many parts have the same members: each such set once, told by its size and two sums of hashes
    print_of = [F.sum(F.xxhash64("doc", F.lit(i)).cast("decimal(38,0)")).alias(f"f{i}") for i in (1, 2)]
    mixed = named.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("m"), *print_of).where("c1 <> c2")
    mixed = mixed.groupBy("m", "f1", "f2").agg(F.min("key").alias("key")).select("key", "m")
    named = cut(named.join(mixed, "key").join(bits.withColumnRenamed("id", "doc"), "doc"), "mixed")
    few = named.where(F.col("m") <= SMALL).select("key", "doc", "n", "c")
    pairs = few.select("key", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca")).join(few.select("key", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb")), "key")
    pairs = pairs.where("a < b and ca <> cb").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct()
    # the largest component of a large group meets only the others, never itself: blocks of it have numbers below zero
    many = named.where(F.col("m") > SMALL).select("key", "doc", "c")
    if not many.isEmpty():
        units = _units(many)
        sizes = _sizes(units, "whole", "key").withColumns({"own": _blocks(F.col("top.size")), "blocks": _blocks(F.col("m") - F.col("top.size"))})
        many = units.join(sizes, ["whole", "key"]).join(bits.withColumnRenamed("id", "doc"), "doc")
        inside, h = F.col("c") == F.col("top.c"), F.xxhash64("doc")
        many = many.withColumn("b", F.when(inside, -1 - F.pmod(h, F.col("own"))).otherwise(F.pmod(h, F.col("blocks"))).cast("int"))
        many = many.withColumn("o", F.explode(F.sequence(F.when(inside, 0).otherwise(-F.col("own")), F.col("blocks") - 1)))
        dealt = many.select("whole", "key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", F.col("doc").alias("id"), "c", "n", "bits")
        pairs = pairs.union(dealt.groupBy("whole", "key", "i", "j").applyInPandas(_block_pairs(percent), "a long, b long"))
    pairs = cut(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "more-pairs")
    if not pairs.isEmpty():
        links = cut(links.union(_verified(pairs, bits, docs, width, percent, "more-links")), "all-links")
        found = cut(components(links, "a", "b"), "components")
    discard(shared, tested, pairs, bits, named)

    named = sets.join(copied, "doc_id", "left").withColumn("id", F.coalesce("rep", "doc_id")).join(found, "id", "left")
    named = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    nameless = docs.where("doc_id is null").mapInPandas(_sketched(width, percent), SKETCHES).where("first")
    return named.union(nameless.select(F.lit(None).cast("long"), "n", F.lit(None).cast("long")))


def oracle() -> str:
    """DuckDB SQL of the same components."""
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT l.a, r.reach FROM r JOIN l ON l.b = r.id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.reach) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id GROUP BY 1, 2"""
