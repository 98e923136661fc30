"""MinHash near-dedup with SuperMinHash signatures.

Each set element gets a random permutation of the signature's slots and a random
fraction for each rank; a slot keeps the smallest rank plus fraction of all
elements (Ertl 2017).  The ranks of one element being a permutation, slots are
negatively correlated and the signature's variance is below plain MinHash.  Ranks
are tried in ascending order and a set stops as soon as no slot can still fall,
so a set of n elements takes about (slots / n) log slots ranks each.

Signatures are cut into bands.  Documents with equal shingle sets form a class,
whose smallest id stands for it.  Of the members of each band bucket, the one
that shares the most bucket-mates is the head, and every document is first
compared with the best head of its buckets.  Where a bucket still holds
several components, its members are compared with each other, block against block:
set sizes and signatures first, then the full sets of those that may have a link to
another component.  Documents that share no bucket are never compared, and a pair
that shares several meets in the first.  Links are confirmed on full sets;
components come from their union.

Null and empty texts, and texts without words, have empty sets: they link with
nothing and are their own component.  Rows that repeat an id share its smallest
component.  Rows without id form no links, and their component is null.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import U64, Workspace, groups, map_rows, mix64, ship, unused
from weft.llm.textsets import shingle_sets
from weft.operators.components import components, find

BANDS, ROWS = 25, 5
#: Shingles of the documents that are compared at once, about.
BLOCK = 1 << 20
#: Members of a bucket whose signatures are compared at once, about.
MEMBERS = 1024
#: Standard deviations by which a link's equal slots may stay below their mean: one in 1e9 stays lower.
DEVIATIONS = 6.0
#: A member of a bucket of documents, and the pair of blocks in which it is compared.
PAIR = ("key", "s1", "i", "s2", "j")
#: Ids of 8 bytes that are broadcast at most.
BROADCAST_IDS = 2_000_000


def signatures(sets: list[np.ndarray], slots: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures, one row for each set: rank << 32 | fraction; empty sets keep the largest value."""
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, U64)
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    swaps: list[np.ndarray] = []
    flat = out.reshape(-1)
    for j in range(slots):
        if not len(x):
            break
        z = mix64(x + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((z >> U64(32)) * U64(slots - j) >> U64(32)).astype(np.int32)
        slot = k.copy()
        for t in range(j - 1, -1, -1):
            slot[slot == swaps[t]] = t
        np.minimum.at(flat, doc * slots + slot, U64(j << 32) | (z & U64(0xFFFFFFFF)))
        swaps.append(k)
        # A set is done when every slot is below what the next rank could give.
        live = np.unique(doc)
        open_ = np.zeros(len(sets), bool)
        open_[live] = out[live].max(axis=1) >= U64((j + 1) << 32)
        keep = open_[doc]
        if not keep.all():
            x, doc, swaps = x[keep], doc[keep], [s[keep] for s in swaps]
    return out


def bands_of(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands differ."""
    out = np.zeros((len(sig), bands), U64) + np.arange(1, bands + 1, dtype=U64)
    for r in range(rows):
        out = mix64(out ^ sig[:, r::rows][:, :bands]) * U64(0xD6E8FEB86659FD93) + U64(r)
    return out.view(np.int64)


def digest(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signed(k: int):
    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b["text"], k))
            for i in range(0, len(sets), 256):
                part = sets[i : i + 256]
                sig = signatures(part)
                # 16 bits of each slot: slots that differ agree once in 65,536, which only adds to what is compared.
                brief = (mix64(sig) >> U64(48)).astype(np.uint16)
                yield {
                    "doc_id": b["doc_id"][i : i + 256], "n_shingles": [len(s) for s in part], "digest": [digest(s) if len(s) else None for s in part],
                    "bands": list(bands_of(sig)), "sig": [x.tobytes() for x in brief],
                }

    return run


def _sets(k: int):
    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "items": [s.tobytes() for s in shingle_sets(b["text"], k)]}

    return run


def _confirmed(num: int, den: int):
    def run(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b["x"], b["y"])):
                p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
                if den * min(len(p), len(q)) >= num * max(len(p), len(q)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if den * both >= num * (len(p) + len(q) - both):
                        keep.append(i)
            yield {"a": [b["a"][i] for i in keep], "b": [b["b"][i] for i in keep]}

    return run


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of documents with an id in ``ids``, which are broadcast if there are at most BROADCAST_IDS, so texts stay where they are."""
    small = ids.count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def _confirm(pairs: DataFrame, docs: DataFrame, space: Workspace, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet ``den * intersection >= num * union``."""
    pairs = space.write(pairs.distinct(), "pairs")
    ids = space.write(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    sets = space.write(map_rows(_only(docs, ids), _sets(k), "doc_id bigint, items binary"), "sets")
    joined = (
        pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
        .join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").select("a", "b", "x", "y")
    )
    out = space.write(map_rows(joined, _confirmed(num, den), "a bigint, b bigint"), "links")
    space.drop(sets)
    return out


def _labelled(keys: DataFrame, comps: DataFrame) -> DataFrame:
    """Bucket memberships with each document's component so far."""
    return keys.join(comps.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")


def _mixed(members: DataFrame) -> DataFrame:
    """Memberships of buckets that hold several components."""
    many = members.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    return members.join(many, "key", "left_semi")


def cross_links(sets: list[np.ndarray], comps: list[int], side: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Index pairs that join all components which links between the sides join; if there is one side only, links inside it.

    An inverted index counts the intersections of one set with all others at once.
    """
    one = not any(side)
    left = [i for i, x in enumerate(side) if x == 0]
    right = left if one else [i for i, x in enumerate(side) if x]
    if not left or not right:
        return []
    sizes = np.array([len(sets[i]) for i in right])
    items = np.concatenate([sets[i] for i in right])
    owner = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    parent: dict = {}
    out = []
    for i in left:
        own = sets[i]
        lo, hi = np.searchsorted(items, own, "left"), np.searchsorted(items, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(right))
        for j in np.flatnonzero(den * both >= num * (len(own) + sizes - both)).tolist():
            a, b = find(parent, comps[i]), find(parent, comps[right[j]])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, right[j]))
    return out


def _cross(num: int, den: int, block: tuple[str, ...]):
    def run(batches):
        for _, g in groups(batches, block):
            ids = g["doc_id"]
            found = cross_links([np.frombuffer(x, U64) for x in g["items"]], g["c"], g["side"], num, den)
            yield {"a": [min(ids[i], ids[j]) for i, j in found], "b": [max(ids[i], ids[j]) for i, j in found]}

    return run


def least_equal(num: int, den: int, slots: int = BANDS * ROWS) -> int:
    """Equal slots that sets at the threshold have at least; the variance is at most that of independent slots."""
    t = num / den
    return max(0, math.floor(slots * t - DEVIATIONS * math.sqrt(slots * t * (1 - t)) - 1))


def partners(n: np.ndarray, comp: np.ndarray, sig: np.ndarray, bands: np.ndarray, side: np.ndarray, key: int, one: bool, num: int, den: int) -> np.ndarray:
    """Which members of a pair of blocks may have a link to another component that no earlier bucket holds."""
    least = least_equal(num, den, sig.shape[1])
    hit = np.zeros(len(n), bool)
    left = np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    for i in left.tolist():
        r = right[right > i] if one else right
        lo, hi = np.minimum(n[r], n[i]), np.maximum(n[r], n[i])
        r = r[(comp[r] != comp[i]) & (den * lo >= num * hi)]
        r = r[(sig[r] == sig[i]).sum(axis=1) >= least]
        if len(r):
            first = bands[i][(bands[r] == bands[i]).argmax(axis=1)]
            r = r[first == key]
            hit[r] = True
            hit[i] |= len(r) > 0
    return hit


def _partners(num: int, den: int):
    def run(batches):
        for at, g in groups(batches, PAIR):
            n = len(g["n"])
            hit = partners(
                np.array(g["n"], np.int64), np.array(g["c"], np.int64), np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(n, -1), np.array(g["bands"], np.int64).reshape(n, -1),
                np.array(g["side"]), at[0], at[1] == at[3] and at[2] == at[4], num, den,
            )
            k = np.flatnonzero(hit).tolist()
            yield {"key": [at[0]] * len(k), "doc_id": [g["doc_id"][x] for x in k], "c": [g["c"][x] for x in k]}

    return run


def candidates(mixed: DataFrame, signed: DataFrame, space: Workspace, num: int, den: int) -> DataFrame:
    """(key, doc_id, c): members of buckets that may have a link to another component there.

    A bucket of more than ``MEMBERS`` is cut by set size into classes, of which only
    the same and the next can link, and each class into blocks; pairs of blocks are
    compared in different tasks.
    """
    rows = mixed.select("key", "doc_id", "c").join(signed.where("n_shingles > 0").select("doc_id", F.col("n_shingles").alias("n"), "sig", "bands"), "doc_id")
    large = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MEMBERS).select("key")
    large = space.write(large, "large")
    cols = [*PAIR, "side", "doc_id", "c", "n", "sig", "bands"]
    zero = {c: F.lit(0) for c in ("s1", "i", "s2", "j", "side")}
    small = rows.join(large, "key", "left_anti").withColumns(zero).select(cols)
    big = rows.join(large, "key").withColumn("s", F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("int"))
    sizes = big.groupBy("key", "s").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("nb"))
    # Classes of a bucket are as many as the logarithm of its largest set allows.
    sizes = space.write(sizes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("s", "nb"))).alias("nbs")), "classes")
    at = lambda d: F.coalesce(F.try_element_at("nbs", F.col("s") + d), F.lit(0))
    big = big.join(sizes, "key").withColumns({"nb": at(F.lit(0)), "up": at(F.lit(1)), "down": at(F.lit(-1))}).withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
    pair = lambda s1, i, s2, j, side: F.struct(s1.alias("s1"), i.alias("i"), s2.alias("s2"), j.alias("j"), side.alias("side"))
    s, b = F.col("s"), F.col("b")
    to = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(F.array())
    met = F.concat(
        to("nb", lambda x: pair(s, F.least(b, x), s, F.greatest(b, x), F.when(b <= x, 0).otherwise(1))),
        to("up", lambda x: pair(s, b, s + 1, x, F.lit(0))), to("down", lambda x: pair(s - 1, x, s, b, F.lit(1))),
    )
    big = big.withColumn("x", F.explode(met)).select("key", "x.*", "doc_id", "c", "n", "sig", "bands").select(cols)
    both = small.unionByName(big).repartition(*PAIR).sortWithinPartitions(*PAIR)
    return space.write(map_rows(both, _partners(num, den), "key bigint, doc_id bigint, c bigint").distinct(), "candidates")


def _rest(mixed: DataFrame, signed: DataFrame, docs: DataFrame, space: Workspace, k: int, num: int, den: int) -> DataFrame:
    """Links that join components which share a bucket.

    The candidates of a bucket are dealt to blocks of about ``BLOCK`` shingles, a
    large component to blocks of its own, and all pairs of blocks are compared on
    full sets, except those inside one component.  A pair of blocks yields at most
    one link for each document.
    """
    member = candidates(mixed, signed, space, num, den)
    rows = space.write(map_rows(_only(docs, member.select("doc_id").distinct()), _sets(k), "doc_id bigint, items binary"), "bucket-sets")
    size = F.length("items") / 8
    rows = member.join(rows.withColumn("size", size), "doc_id")
    sizes = space.write(rows.groupBy("key", "c").agg(F.sum("size").alias("s")), "sizes-in-buckets")
    small = sizes.where(F.col("s") <= BLOCK).groupBy("key").agg(F.sum("s").alias("small"))
    dealt = rows.join(sizes, ["key", "c"]).join(small, "key", "left")
    own = F.col("s") > BLOCK
    dealt = space.write(dealt.select(
        "key", "c", "doc_id", "items", own.alias("own"), F.when(own, F.col("c")).otherwise(0).alias("p"),
        F.when(own, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("s") / BLOCK))).otherwise(F.pmod(F.xxhash64("c"), F.ceil(F.coalesce("small", F.lit(1)) / BLOCK))).alias("i"),
    ), "dealt")
    dealt = dealt.withColumn("x", F.struct("own", "p", "i")).select("key", "c", "doc_id", "items", "x")
    blocks = dealt.select("key", "x").distinct()
    pairs = blocks.join(blocks.withColumnRenamed("x", "y"), "key").where("x <= y and not (x.own and y.own and x.p = y.p)")
    one = dealt.join(pairs, ["key", "x"]).withColumn("side", F.lit(0))
    two = dealt.withColumnRenamed("x", "y").join(pairs.where("x != y"), ["key", "y"]).withColumn("side", F.lit(1))
    cols = ["key", "side", "doc_id", "c", "items", *(F.col(f"{v}.{f}").alias(v + f) for v in "xy" for f in ("own", "p", "i"))]
    block = ("key", "xown", "xp", "xi", "yown", "yp", "yi")
    both = one.select(cols).unionByName(two.select(cols)).repartition(*block).sortWithinPartitions(*block)
    return space.write(map_rows(both, _cross(num, den, block), "a bigint, b bigint"), "cross")


def near_duplicates(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; links have ``den * intersection >= num * union`` over ``k``-word shingles."""
    ship(docs.sparkSession)
    space = Workspace(docs.sparkSession, "superminhash")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = space.write(map_rows(docs, _signed(k), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sig binary"), "signed")
    some = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # Classes of equal sets; the smallest id stands for each. Written first, so Spark can split the join of a large class.
    classes = space.write(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    member = some.select("digest", "doc_id").join(classes.where("n > 1"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b")
    reps = some.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "digest"])
    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    # Buckets of one member have nothing to compare.
    # Tables of buckets are written before they are joined, so Spark can split the join of a hot bucket.
    sizes = space.write(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    shared = space.write(keys.join(sizes, "key"), "buckets")
    weight = shared.groupBy("doc_id").agg(F.sum(F.log2(F.col("n").cast("double"))).alias("w"))
    members = space.write(shared.select("key", "doc_id").join(weight, "doc_id"), "members")
    space.drop(shared)
    # The member that shares the most bucket-mates is nearest to the middle of its group.
    head = members.groupBy("key").agg(F.max(F.struct(F.col("w"), (-F.col("doc_id")).alias("m"))).alias("h")).select("key", (-F.col("h.m")).alias("head"), F.col("h.w").alias("hw"))
    head = space.write(head, "heads")
    # Each document meets the best head of all its buckets; the rest is left to the blocks.
    best = members.join(head, "key").where(F.col("doc_id") != F.col("head")).groupBy("doc_id").agg(F.max(F.struct("hw", (-F.col("head")).alias("m"))).alias("h"))
    pairs = best.withColumn("head", -F.col("h.m")).select(F.least("doc_id", "head").alias("a"), F.greatest("doc_id", "head").alias("b"))
    links = _confirm(pairs, docs, space, k, num, den)
    mixed = space.write(_mixed(_labelled(members, space.write(components(links), "stars"))), "mixed")
    if not mixed.isEmpty():
        links = links.unionByName(_rest(mixed, signed, docs, space, k, num, den))
    comps = space.write(components(member.unionByName(links)), "components")
    out = signed.select("doc_id", "n_shingles").join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of ``docs``, all columns as they are: that of the smallest doc_id, rows without id last.

    Rows are told apart by their place, so rows that repeat an id or have none are
    documents like others; of rows that tie, any one stays.  Rows without words are
    groups of their own.
    """
    space = Workspace(docs.sparkSession, "one-of-each")
    row, group = unused(docs.columns, "row", "group")
    # Numbers given while writing stay with the rows.
    numbered = space.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), k, num, den)
    ids = numbered.select(F.col(row).alias("doc_id"), F.col("doc_id").cast("bigint").alias("id"))
    # Only groups of several rows are joined with their ids.
    several = found.where(~F.col("kept")).select("component_id").distinct()
    many = space.write(found.join(several, "component_id", "left_semi").select("doc_id", F.col("component_id").alias(group)), "groups")
    named = many.join(ids, "doc_id")
    best = named.groupBy(group).agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id")).alias("x")).select(F.col("x.doc_id").alias("doc_id"))
    gone = space.write(many.select("doc_id").join(best, "doc_id", "left_anti").withColumnRenamed("doc_id", row), "gone")
    small = gone.count() <= BROADCAST_IDS
    return numbered.join(F.broadcast(gone) if small else gone, row, "left_anti").select(*docs.columns)
