"""Near-duplicate texts by a grouped prefix join over word shingles.

A text is represented by its ``sample`` smallest hashes of five-word shingles. Texts of the same
hashes and size form one group. Of each group the ``keys`` rarest of all its hashes that occur in at least
two groups are its prefix; groups are joined on them if their sizes and bitmaps allow, and the
texts of joined groups are verified on all their words. Exact copies are one class throughout. A hash
in the prefixes of very many groups is joined block by block.

Two texts whose shingles have a Jaccard similarity s share about 2s / (1 + s) of their hashes; with
eight keys the chance that a pair of a small family shares none is about 2e-4 at s = 0.5 and below 1e-6
at 0.7. In large families members differ in which hashes are the rarest and more pairs share none: so
versions of the same third text are compared as well, until no more are found.

``exact=True`` loses no pair: the sets are then all words of the texts, and the prefixes as long as
the difference allowed by :func:`same_text` demands. Words are far more frequent than shingles, so it
costs far more; it is meant for small tables, and for measuring the recall of the sketch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm import folding, shingles

_CELLS = 1 << 21
#: 64-bit words of a group's bitmap.
_MAPS = 4
#: Bits of a hash that are kept.
_BITS = 48
#: Groups with the same prefix hash that are compared in one piece.
_HOT = 4096
#: A hash is frequent if some task has it in this part of its groups, and in so many.
_OFTEN, _FEW = 1 / 400, 64
#: Hashes of so many groups are set apart, so many of them at most: at least all of 24 / 10,000 of the groups and more.
_MANY, _APART = 1_000_000, 10_000
#: Bytes of a word's hash by which texts are compared: among the words of two texts hardly any fall together.
_WORD = 3
#: By how much more than the allowed edits the bags of words may differ.
_SLACK = 4.6
#: Texts of which a list is sent to all tasks.
_LISTED = 1_000_000


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """How many members of two bags have no equal in the other."""
    x, y = np.sort(a), np.sort(b)
    both = np.unique(x)
    ca = np.searchsorted(x, both, "right") - np.searchsorted(x, both)
    cb = np.searchsorted(y, both, "right") - np.searchsorted(y, both)
    return len(x) + len(y) - 2 * int(np.minimum(ca, cb).sum())


def allowance(n: float, share: float, least: int) -> float:
    """How much the bags of words of two texts of up to ``n`` words may differ.

    Each may differ from a third by ``share`` of its words, ``least`` at least, and a change of a word
    counts twice in the difference of the bags.
    """
    return _SLACK * max(least, share * n)


def same_text(a: np.ndarray, b: np.ndarray, share: float, least: int, shingle: float) -> bool:
    """Whether two texts, as hashes of their words in order, are versions of one another.

    Their bags of words must differ by no more than :func:`allowance`. They must also share the part
    ``shingle`` of their shingles or, as edits with a moved sentence spoil more of those, their pairs of
    neighbouring words: of these a change counts four times, and the sentences moved in both break
    twelve more.
    """
    most = allowance(max(len(a), len(b)), share, least)
    if _apart(a, b) > most:
        return False
    s, t = np.unique(shingles.shingle_hashes(a)), np.unique(shingles.shingle_hashes(b))
    common = len(np.intersect1d(s, t, assume_unique=True))
    if common >= shingle * (len(s) + len(t) - common):
        return True
    return _apart(shingles.shingle_hashes(a, 2), shingles.shingle_hashes(b, 2)) <= 2 * most + 12


def sketches(texts: DataFrame, sample: int, exact: bool = False) -> DataFrame:
    """(src, id, class, grp, n, upper, lower, parity) of texts (src, id, text): the class is one of exact copies.

    The texts of a group have the same hashes (given as their upper 32 and lower 16 bits), size and
    bitmap of words. Hashes and bitmap are given only where a task first meets the group; they are
    null beside its other texts. ``exact``: the hashes are those of all words, each occurrence its own.
    Rows without an id are hashes that many of a task's groups have, and of how many (n).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = shingles.Hashes()
        seen: set[int] = set()
        kept: list[np.ndarray] = []
        for frame in batches:
            which, texts = pd.factorize(frame["text"])  # equal texts of a batch are read once
            found, flat, lengths = shingles.sketched(texts.tolist(), sample, hashes)
            odd = shingles.parities(flat, lengths)[which]
            salt = [hashes["src " + s] for s in frame["src"]]
            if exact:
                ends = np.cumsum(lengths)
                sets = [shingles.occurrences(flat[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            else:
                sets = [h for _, _, h in found]
            found, sets = [found[k] for k in which], [sets[k] for k in which]
            small = [((h ^ np.uint64(s)) >> np.uint64(64 - _BITS)).view(np.int64) for h, s in zip(sets, salt, strict=True)]
            groups = [shingles.xxhash.xxh3_64_intdigest(h.tobytes() + n.to_bytes(8, "little") + o.tobytes()) - 2**63 for h, (_, n, _), o in zip(small, found, odd, strict=True)]
            first = [not (g in seen or seen.add(g)) for g in groups]
            kept += [h for h, f in zip(small, first, strict=True) if f]
            yield pd.DataFrame(
                {
                    "src": frame["src"],
                    "id": frame["id"],
                    "class": [(int.from_bytes(d[:8], "little") ^ s) - 2**63 for (d, _, _), s in zip(found, salt, strict=True)],
                    "grp": groups,
                    "n": [n for _, n, _ in found],
                    "upper": [(h >> 16).astype(np.uint32).view(np.int32) if f else None for h, f in zip(small, first, strict=True)],
                    "lower": [h.astype(np.uint16).view(np.int16) if f else None for h, f in zip(small, first, strict=True)],
                    "parity": [o if f else None for o, f in zip(odd, first, strict=True)],
                }
            )
        if kept:
            values, counts = np.unique(np.concatenate(kept), return_counts=True)
            many = counts >= max(_FEW, _OFTEN * len(seen))
            if not many.any():
                return
            found, times = values[many], counts[many]
            none = pd.array([None] * len(found), dtype="Int64")
            upper, lower = [[x] for x in (found >> 16).astype(np.uint32).view(np.int32)], [[x] for x in found.astype(np.uint16).view(np.int16)]
            yield pd.DataFrame({"src": "", "id": none, "class": none, "grp": none, "n": times, "upper": upper, "lower": lower, "parity": None})

    return texts.mapInPandas(run, "src string, id bigint, class bigint, grp bigint, n int, upper array<int>, lower array<smallint>, parity array<bigint>")


def _candidates(stored: DataFrame, frequent: DataFrame, hashes: int, keys: int, share: float, least: int, exact: bool) -> DataFrame:
    """(a, b): pairs of groups that share a prefix hash, of fitting sizes and bitmaps; ``hashes``: how many there are.

    Hashes so ``frequent`` that one task could not hold their groups are never gathered: how many have
    them is taken from the tasks' own counts, and their groups are joined in blocks.
    """
    own = stored.filter(F.col("upper").isNotNull())
    # as many bits of a hash as tell nearly all apart; two that fall together only make a candidate more
    bits = min(_BITS, math.ceil(math.log2(hashes)) + 16)
    whole = F.shiftleft(F.col("h.upper").cast("bigint"), 16).bitwiseOR(F.col("h.lower").cast("bigint").bitwiseAND(F.lit(65535)))
    cut = F.shiftright(whole, _BITS - bits).bitwiseAND(F.lit((1 << bits) - 1))
    zipped = F.explode(F.arrays_zip("upper", "lower")).alias("h")
    long = own.select("grp", zipped).select("grp", cut.alias("hash"))
    often = frequent.select("n", zipped).select(cut.alias("hash"), "n").groupBy("hash").agg(F.sum("n").alias("often")).filter(F.col("often") >= _MANY).orderBy(F.desc("often"), "hash").limit(_APART).collect()
    busiest = F.broadcast(stored.sparkSession.createDataFrame([tuple(r) for r in often], "hash bigint, often bigint"))
    rest = long.join(busiest, "hash", "left") if often else long.withColumn("often", F.lit(None).cast("bigint"))
    # a group met by several tasks is counted once; all three windows need one shuffle
    ordered = Window.partitionBy("hash").orderBy("grp")
    fresh = F.coalesce(F.lag("grp").over(ordered) != F.col("grp"), F.lit(True))
    counted = rest.filter("often is null").withColumn("fresh", fresh.cast("int")).withColumn("df", F.sum("fresh").over(Window.partitionBy("hash")))
    key = lambda n: F.shiftleft(F.least(F.floor(2 * F.log2(n)), F.lit(62)).cast("bigint"), bits).bitwiseOR(F.col("hash")).alias("key")
    shared = counted.filter("fresh = 1 and df >= 2").select("grp", key("df"))
    if often:
        shared = shared.unionByName(rest.filter("often is not null").select("grp", key("often")))
    maps = [f"m{i}" for i in range(_MAPS)]
    outlines = own.groupBy("grp").agg(F.first("n").alias("n"), *[F.first(F.get("parity", F.lit(i))).alias(m) for i, m in enumerate(maps)])
    # the same in half the bits; in the maps' order, so that the outlines are shuffled once for both their uses
    folds = [F.col("m0").bitwiseXOR(F.col("m1")).alias("f0"), F.col("m2").bitwiseXOR(F.col("m3")).alias("f1")]
    most = lambda n: _SLACK * F.greatest(F.lit(float(least)), share * n)
    # exact: of the words of a text one more than may differ from the largest text that is near in size
    length = F.floor(_SLACK * F.greatest(F.lit(float(least)), F.lit(share / (1 - _SLACK * share)) * F.col("n"))).cast("int") + 1 if exact else F.lit(keys)
    # dealt out before they are collected: lists collected by half would be shuffled with all their overhead
    chosen = shared.repartition("grp").groupBy("grp").agg(F.sort_array(F.array_distinct(F.collect_list("key"))).alias("all")).join(outlines.select("grp", "n", *folds), "grp")
    columns = ["grp", "n", "f0", "f1"]
    prefix = chosen.select(F.explode(F.slice("all", F.lit(1), length)).alias("key"), *columns).withColumn("hash", F.col("key").bitwiseAND(F.lit((1 << bits) - 1)))
    if often:
        prefix = prefix.join(busiest, "hash", "left")
        few = prefix.filter("often is null").drop("often").withColumn("of", F.count("*").over(Window.partitionBy("hash")))
        busy = prefix.filter("often is not null").drop("often")
        prefix = few.unionByName(busy.join(F.broadcast(busy.groupBy("hash").agg(F.count("*").alias("of"))), "hash"))
    else:
        prefix = prefix.withColumn("of", F.count("*").over(Window.partitionBy("hash")))
    prefix = prefix.filter("of >= 2").drop("key")
    a = prefix.select("hash", "of", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = prefix.select("hash", "of", *[F.col(c).alias(f"{c}_b") for c in columns])
    longer = F.greatest("n_a", "n_b")
    apart = lambda m: F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b")))
    # sizes, and bitmaps of words, differ by no more than the bags of words do, so nothing is lost by them
    fit = (F.abs(F.col("n_a") - F.col("n_b")) <= most(longer)) & (apart("f0") + apart("f1") <= most(longer))
    met = a.filter(F.col("of") <= _HOT).join(b.drop("of"), "hash").filter((F.col("grp_a") < F.col("grp_b")) & fit)
    blocks = F.ceil(F.col("of") / _HOT).cast("int")
    block = lambda c: F.pmod(F.xxhash64(c), blocks).cast("int")
    hot_a = a.filter(F.col("of") > _HOT).withColumn("i", block("grp_a")).withColumn("j", F.explode(F.sequence(F.col("i"), blocks - 1))).drop("of")
    hot_b = b.filter(F.col("of") > _HOT).withColumn("j", block("grp_b")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j")))).drop("of")
    busy = hot_a.join(hot_b, ["hash", "i", "j"]).filter(((F.col("i") < F.col("j")) | (F.col("grp_a") < F.col("grp_b"))) & fit)
    both = met.select("grp_a", "grp_b").unionByName(busy.select(F.least("grp_a", "grp_b").alias("grp_a"), F.greatest("grp_a", "grp_b").alias("grp_b")))
    whole = both.distinct()
    for side in ("a", "b"):
        whole = whole.join(outlines.select(F.col("grp").alias(f"grp_{side}"), F.col("n").alias(f"n_{side}"), *[F.col(m).alias(f"{m}_{side}") for m in maps]), f"grp_{side}")
    close = whole.filter(reduce(lambda x, y: x + y, [apart(m) for m in maps]) <= most(longer))
    return close.select(F.col("grp_a").alias("a"), F.col("grp_b").alias("b"))


def _unpacked(data: bytes) -> np.ndarray:
    """Hashes of words of which ``_WORD`` bytes each were kept."""
    out = np.zeros((len(data) // _WORD, 8), dtype=np.uint8)
    out[:, :_WORD] = np.frombuffer(data, dtype=np.uint8).reshape(-1, _WORD)
    return out.view(np.uint64).ravel()


def _families(ends: DataFrame) -> DataFrame:
    """(src, class, family) of linked texts, links given both ways: the smallest class to which links lead."""
    found = ends.groupBy("src", F.col("class_a").alias("class")).agg(F.least(F.min("class_a"), F.min("class_b")).alias("family")).checkpoint()
    while True:
        beside = found.select("src", F.col("class").alias("class_b"), "family")
        near = ends.join(beside, ["src", "class_b"]).groupBy("src", F.col("class_a").alias("class")).agg(F.min("family").alias("near"))
        lower = found.join(near, ["src", "class"]).withColumn("near", F.least("family", "near"))
        # a family's own family halves the way
        top = found.select("src", F.col("class").alias("near"), F.col("family").alias("top"))
        moved = lower.join(top, ["src", "near"]).select("src", "class", F.col("top").alias("family"), (F.col("top") != F.col("family")).alias("moved")).checkpoint()
        found = moved.select("src", "class", "family")
        if moved.filter("moved").isEmpty():
            return found


def _of_a_third(met: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """All pairs neither met nor ``tried`` whose texts were both found to be versions of a third, and perhaps more.

    Of a family with more pairs by way of thirds than pairs at all, each pair not met is given.
    """
    columns, pair = ["src", "class_a", "id_a", "class_b", "id_b"], ["src", "class_a", "class_b"]
    there = met.select(*columns)
    turned = there.select("src", F.col("class_b").alias("class_a"), F.col("id_b").alias("id_a"), F.col("class_a").alias("class_b"), F.col("id_a").alias("id_b"))
    ends = there.unionByName(turned).dropDuplicates(pair)
    degrees = ends.groupBy("src", F.col("class_a").alias("class")).agg(F.min("id_a").alias("id"), F.count("*").alias("links"))
    nodes = degrees.join(_families(ends), ["src", "class"])
    size = F.count("*")
    by_thirds = F.sum(F.col("links") * F.col("links"))
    kinds = nodes.groupBy("src", "family").agg(size.alias("size"), (size * size <= by_thirds).alias("close"), (F.sum("links") < size * (size - 1)).alias("open"))
    placed = nodes.join(kinds.filter("open").drop("open"), ["src", "family"]).checkpoint()
    # a large family is joined block by block
    close = placed.filter("close").withColumn("blocks", F.ceil(F.col("size") / _HOT).cast("int"))
    x = close.select("src", "family", F.col("class").alias("class_a"), F.col("id").alias("id_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    y = close.select("src", "family", F.col("class").alias("class_b"), F.col("id").alias("id_b"), F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"))
    inside = x.join(y, ["src", "family", "block"]).filter("class_a < class_b").select(*columns)
    loose = ends.join(placed.filter("not close").select("src", F.col("class").alias("class_a")), ["src", "class_a"], "left_semi")
    x = loose.select("src", F.col("class_b").alias("pivot"), "class_a", "id_a")
    y = loose.select("src", F.col("class_b").alias("pivot"), F.col("class_a").alias("class_b"), F.col("id_a").alias("id_b"))
    across = x.join(y, ["src", "pivot"]).filter("class_a < class_b").select(*columns).dropDuplicates(pair)
    known = there.select(*pair) if tried is None else there.select(*pair).unionByName(tried.select(*pair))
    known = known.select("src", F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"))
    return inside.unionByName(across).join(known, pair, "left_anti").select(*columns)


def _verified(some: DataFrame, pairs: DataFrame, share: float, least: int, shingle: float) -> DataFrame:
    """The pairs (src, class_a, id_a, class_b, id_b) whose texts are versions of one another."""
    wanted = pairs.select("src", F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    words = _chosen(some, wanted, 2 * pairs.count()).mapInPandas(_hashed, "src string, id bigint, words binary").join(wanted, ["src", "id"], "left_semi")
    wa = words.select("src", F.col("id").alias("id_a"), F.col("words").alias("words_a"))
    wb = words.select("src", F.col("id").alias("id_b"), F.col("words").alias("words_b"))

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([same_text(_unpacked(p), _unpacked(q), share, least, shingle) for p, q in zip(x, y, strict=True)], dtype=bool)

    return pairs.join(wa, ["src", "id_a"]).join(wb, ["src", "id_b"]).filter(alike("words_a", "words_b")).select("src", "class_a", "id_a", "class_b", "id_b")


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts (src, id, text) as the first bytes of their words' hashes, in order."""
    known = shingles.Hashes()
    for frame in batches:
        lists = [np.fromiter(map(known.__getitem__, shingles.words(t)), dtype=np.uint64).view(np.uint8).reshape(-1, 8)[:, :_WORD].tobytes() for t in frame["text"]]
        yield pd.DataFrame({"src": frame["src"], "id": frame["id"], "words": lists})


def _chosen(some: DataFrame, wanted: DataFrame, at_most: int) -> DataFrame:
    """The texts wanted, and perhaps more; they are not shuffled for it.

    Of up to ``_LISTED`` the list itself goes to all tasks, of more a table of fixed size.
    """
    if at_most <= _LISTED:
        return some.join(F.broadcast(wanted), ["src", "id"], "left_semi")
    place = lambda frame: ((frame["id"].to_numpy() * 2654435761) % (2**40) + np.array([len(s) for s in frame["src"]]) * 7919) % _CELLS

    def flag(out: np.ndarray, frame: pd.DataFrame) -> None:
        out[place(frame)] = 1

    used = some.sparkSession.sparkContext.broadcast(np.packbits(folding.total(wanted, ["src", "id"], _CELLS, flag) != 0))

    @F.pandas_udf("boolean")
    def maybe(src: pd.Series, ident: pd.Series) -> pd.Series:
        cell = place(pd.DataFrame({"src": src, "id": ident}))
        return pd.Series((used.value[cell >> 3] >> (7 - (cell & 7))) & 1).astype(bool)

    return some.filter(maybe("src", "id"))


def versions(texts: DataFrame, sample: int = 24, keys: int = 8, share: float = 0.04, least: int = 3, shingle: float = 0.35, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of exact copies that are versions of one another, and the members of classes.

    ``texts`` has src, id and text; texts of different src are not compared. Null ids and texts and
    texts without words are left out. Returns (src, a, b) with a < b, each pair once, and
    (src, id, class). Extra columns are not carried; repeated rows are members of their class.
    """
    some = texts.select("src", "id", "text").filter(F.col("text").isNotNull() & F.col("id").isNotNull())
    stored = sketches(some, sample, exact).filter("n > 0").checkpoint()
    stored, frequent = stored.filter(F.col("id").isNotNull()), stored.filter(F.col("id").isNull())
    groups, hashes = stored.agg(F.count("upper"), F.sum(F.when(F.col("upper").isNotNull(), F.size("upper")))).first()
    # groups by so many bits that two of all fall together with a chance below 1e-4
    stored = stored.withColumn("grp", F.shiftrightunsigned("grp", max(0, 64 - (2 * math.ceil(math.log2(max(2, groups))) + 14))))
    members = stored.select("src", "id", "class")
    classes = stored.groupBy("src", "grp", "class").agg(F.min("id").alias("id"))
    across = _candidates(stored, frequent, hashes or 1, keys, share, least, exact)
    left = classes.select(F.col("grp").alias("a"), "src", F.col("class").alias("class_a"), F.col("id").alias("id_a"))
    right = classes.select(F.col("grp").alias("b"), "src", F.col("class").alias("class_b"), F.col("id").alias("id_b"))
    # src belongs to the keys only so that both joins shuffle the classes alike, once
    within = left.withColumnRenamed("a", "b").join(right, ["b", "src"]).filter("class_a < class_b")
    columns = ["src", "class_a", "id_a", "class_b", "id_b"]
    pairs = across.join(left, "a").join(right, ["b", "src"]).select(*columns).unionByName(within.select(*columns)).checkpoint()

    met = _verified(some, pairs, share, least, shingle).checkpoint()
    tried = pairs
    while not (more := _of_a_third(met, tried).checkpoint()).isEmpty():
        found = _verified(some, more, share, least, shingle).checkpoint()
        if found.isEmpty():
            break
        met, tried = met.unionByName(found), tried.unionByName(more)
    return met.select("src", F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct(), members


def pairs(texts: DataFrame, **options) -> DataFrame:
    """(src, id_a, id_b), id_a < id_b: all pairs of rows of the same wording or versions of one another."""
    linked, members = versions(texts, **options)
    x = members.select("src", F.col("class").alias("a"), F.col("id").alias("x"))
    y = members.select("src", F.col("class").alias("b"), F.col("id").alias("y"))
    copies = x.join(y.withColumnRenamed("b", "a"), ["src", "a"]).filter("x < y")
    across = linked.join(x, ["src", "a"]).join(y, ["src", "b"])
    both = copies.select("src", "x", "y").unionByName(across.select("src", "x", "y"))
    return both.select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def classes(texts: DataFrame, **options) -> DataFrame:
    """(src, id, class, copies, links) of each text: its exact copies' class, and other classes alike."""
    linked, members = versions(texts, **options)
    sizes = members.groupBy("src", "class").agg(F.count("*").alias("copies"))
    ends = linked.select("src", F.explode(F.array("a", "b")).alias("class")).groupBy("src", "class").agg(F.count("*").alias("links"))
    counted = sizes.join(ends, ["src", "class"], "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return members.join(counted, ["src", "class"])
