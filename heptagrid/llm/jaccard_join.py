"""N-gram Jaccard join over count vectors in R-trees, and the components of its links.

A document's set holds the 64-bit hashes of its distinct shingles, of 5 words unless others are asked for. Documents with equal sets form a class, and only
classes are joined. Tokens are hashed into groups, about one for two tokens, and the numbers of a set's tokens by group are
its point. The sum of the coordinates' minima of two points bounds the overlap of the sets from above, and so does that of
a point and the upper corner of an R-tree node's box for every point in it. What survives is verified on the sets.

Sets that share a token which comes early in both belong to a block, and an R-tree's points are placed by block first, then by
size, then by the coordinates that differ most. In one order of all tokens, two sets that link share a token among the first
``n - ceil(0.85 n) + 1`` of each (at 85 percent); tokens found to be frequent come last in that order, so a passage that many documents
share seldom brings two of them together. The order decides the amount of work only: the join is exact. A block is named by its
pivot, the smallest class with the token; tokens with the same pivot have one block.

All candidates are found by searching trees, each over many blocks or a part of a large one, three times. First each class is
sought by its smallest pivot, which links most copies. Blocks whose classes are one component after that need no more. In the
others, every class that isn't of the pivot's component looks for its BEST nearest of other components, by the bound; these
are verified, and components joined. Last, it looks for all classes of other components that the bound lets through. So a
group of copies costs some verifications per class, and not all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dealt, dropped, hot_keys, salted_join, spread, staged, table
from .components import components

#: What near duplicates are unless others are asked for; the query op9 asks for 4 words and 85 percent.
WORDS = 5
PERCENT = 80
#: The least number of groups; there are as many more, a power of two, as leave at most two tokens to a group.
GROUPS = 64
NODE = 16
#: Classes of a block that meet as many others at once; larger blocks are cut.
LEAF = 512
#: A tree is built once it has so many points, or so many bytes of them, at the end of a block's part.
TREE, TREE_BYTES = 8192, 1 << 22
#: Bytes of the coordinates whose sums are taken at once.
SUMS = 1 << 21
#: Nearest classes of other components that a class is verified against before all that are left.
BEST = 4
#: Tokens that were met so often, by counts over whole partitions, come last in the order; so many at most are sent out. Of
#: these the hot ones, with more sets than a leaf has room for, come after the others; so many at most, those met most.
FREQUENT = 50
FREQUENT_KEPT, HOT_KEPT = 200_000, 10_000
#: Tokens counted together in the first pass.
CHUNK = 1_000_000
#: Sets sent on at a time.
SETS = 500
#: Bits of the filter of those classes whose sets are to be read, per class, and in all; false positives are dropped by the
#: join that follows. Of more classes than the filter has room for the documents are joined instead.
FILTER_BITS, FILTER_MOST = 32, 1 << 28
#: Bits of a digest that name a class at first; names that two classes share are changed.
NAME_BITS = 64
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes, ascending. Fewer words than a shingle has: the sequence as one; none: no hash."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as bytes: only A-Z, and only blank and 9 to 13
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n, k = len(h), min(words, len(h))
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += h[i : n - k + 1 + i] * MULTIPLIERS[i % 4]
    total = np.sort(_mix(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def groups_of(n: int) -> int:
    return max(GROUPS, 1 << (-(-n // 2) - 1).bit_length())


def point_of(tokens: np.ndarray) -> np.ndarray:
    """Numbers of tokens by group. A group of over 255 tokens, if ever there is one, lets everything through."""
    m = groups_of(len(tokens))
    counts = np.bincount((tokens >> np.uint64(7)) & np.uint64(m - 1), minlength=m)
    return (counts if counts.max() < 256 else np.full(m, 255)).astype(np.uint8)


def folded(points: np.ndarray, m: int) -> np.ndarray:
    """Points of more groups as points of m: groups that are one modulo m are added up."""
    return points.reshape(len(points), -1, m).sum(1, dtype=np.int32)


def digest_of(tokens: np.ndarray) -> bytes:
    """128 bits of the set, which stand for it."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def needed(n, percent: int):
    """The least overlap for which sets of n tokens together reach the similarity: 100 o >= p (n - o)."""
    return -(-percent * n // (100 + percent))


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens met often, ascending, and whether each is hot. Every partition counts all its tokens, a chunk after another, and
    drops what a chunk has twice at most; the counts that are left are added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often(parts):
            tokens, n = np.unique(np.concatenate(parts), return_counts=True)
            tokens, n = tokens[n > 2], n[n > 2]
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])

        parts, size, seen = [], 0, set()
        for batch in batches:
            for text in batch.column(1):
                tokens = shingles(text.as_py(), words)
                if len(tokens) and (k := digest_of(tokens)) not in seen:
                    seen.add(k)
                    parts.append(tokens)
                    size += len(tokens)
                    if size >= CHUNK:
                        yield often(parts)
                        parts, size, seen = [], 0, set()
        if parts:
            yield often(parts)

    counted = docs.mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(FREQUENT_KEPT)
    rows = top.collect()
    tokens, n = np.array([r["token"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    hot, order = (n > LEAF) & (np.arange(len(n)) < HOT_KEPT), np.argsort(tokens)
    return tokens[order], hot[order]


def _signatures(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int, words: int) -> DataFrame:
    """id, n, digest, prefix (tokens), rare (how many of these come first and aren't hot), point (numbers by group); null but
    for id and n for an empty set."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hot = sent.value
        for batch in batches:
            n, found = [], []
            for text in batch.column(1):
                tokens = shingles(text.as_py(), words)
                n.append(len(tokens))
                if not len(tokens):
                    found.append((None,) * 4)
                    continue
                late = np.zeros(len(tokens), np.int8)
                if len(last):
                    at = np.minimum(np.searchsorted(last, tokens), len(last) - 1)
                    late = np.where(last[at] == tokens, 1 + hot[at], 0)
                first = len(tokens) + (-percent * len(tokens) // 100) + 1
                order = tokens[np.argsort(late, kind="stable")] if late.any() else tokens
                rare = min(first, int((late < 2).sum()))
                found.append((digest_of(tokens), order[:first].view(np.int64), rare, point_of(tokens).tobytes()))
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary())
            rest = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *rest], names=["id", "n", "digest", "prefix", "rare", "point"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"id {kind}, n bigint, digest binary, prefix array<bigint>, rare int, point binary")


def name_of(digest: bytes) -> int:
    """The number that names a class, the digest's end."""
    return int.from_bytes(digest[8:], "big", signed=True) & ((1 << NAME_BITS) - 1 if NAME_BITS < 64 else -1)


def _classes(signed: DataFrame) -> tuple[DataFrame, bool]:
    """A row per set: class (a number of its own), digest, copies, id (the smallest), n, prefix, rare, point.

    The number is the digest's, unless that of another class is the same, as may come about in some thousand million; then
    the second value is true.
    """
    found = signed.where("digest IS NOT NULL").groupBy("digest")
    found = found.agg(F.count("*").alias("copies"), F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "prefix", "rare", "point")])
    name = F.conv(F.hex(F.substring("digest", 9, 8)), 16, -10).cast("long")
    found = staged(found.withColumn("class", name.bitwiseAND(F.lit((1 << NAME_BITS) - 1 if NAME_BITS < 64 else -1))), "classes")
    seed = 0
    while True:
        twice = found.groupBy("class").agg(F.count("*").alias("n"), F.min("digest").alias("first")).where("n > 1").select("class", "first")
        if twice.isEmpty():
            return found, seed > 0
        seed += 1
        keeps = F.col("first").isNull() | (F.col("digest") == F.col("first"))
        again = F.when(keeps, F.col("class")).otherwise(F.xxhash64("digest", F.lit(seed)))
        found = staged(found.join(twice, "class", "left").withColumn("class", again).drop("first"), "classes")


def _blocks(classes: DataFrame, percent: int) -> DataFrame:
    """class, pivot: a row for each block that a class is in and isn't the pivot of.

    Hot tokens, HOT_KEPT at most, are looked at on the map side, and the pivot of each is sent out, so the classes of one never
    meet in a task. Any other token is dealt by an exchange: there a class stays in a shard if the next by size, either way, can
    link with it: sizes have to be alike, and what it has from the shared token on has to hold the overlap needed. Twice, as
    those that go thin shards out.
    """
    tokens = classes.select("class", "n", "rare", F.posexplode("prefix").alias("place", "token"))
    shared, by_size = tokens.where("place < rare").drop("rare"), Window.partitionBy("token").orderBy("n")
    for _ in range(2):
        shared = shared.withColumns({"up": F.lead("n").over(by_size), "down": F.lag("n").over(by_size)})
        rest = (F.col("n") - F.col("place")) * (100 + percent) >= (F.col("n") + F.col("up")) * percent
        up = F.coalesce((F.col("n") * 100 >= F.col("up") * percent) & rest, F.lit(False))
        shared = shared.where(up | F.coalesce(F.col("down") * 100 >= F.col("n") * percent, F.lit(False))).drop("up", "down")
    all_of = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = shared.select(
        "class", F.count("*").over(all_of).alias("size"), F.min("class").over(all_of).alias("pivot"),
        F.min(F.col("n") - F.col("place")).over(all_of).alias("rest"), F.sum("n").over(all_of).alias("both"),
    )
    fits = F.col("rest") * (100 + percent) >= F.col("both") * percent
    shared = shared.where((F.col("size") > 2) | (F.col("size") == 2) & fits).select("class", "pivot")
    common = classes.where("size(prefix) > rare")
    common = common.select("class", F.explode(F.slice("prefix", F.col("rare") + 1, F.size("prefix") - F.col("rare"))).alias("token"))
    pivots = common.groupBy("token").agg(F.min("class").alias("pivot"))
    common = common.join(F.broadcast(pivots), "token").select("class", "pivot")
    return shared.union(common).where("class <> pivot").distinct()


def most_shared(x: bytes, y: bytes) -> int:
    """The bound of the overlap of two sets, by their points."""
    m = min(len(x), len(y))
    x, y = (folded(np.frombuffer(v, np.uint8)[None], m)[0] for v in (x, y))
    return int(np.minimum(x, y).sum())


def _filter_of(keys: DataFrame, size: int) -> np.ndarray:
    """A bit map of so many slots for 64-bit keys: partitions make pages of it, equal pages are joined, and it is collected."""
    page = min(1 << 16, size)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, bool)
        for batch in batches:
            found[_slots(batch.column(0).to_numpy(), size)] = True
        pages = [p for p in range(size // page) if found[p * page : (p + 1) * page].any()]
        data = [np.packbits(found[p * page : (p + 1) * page]).tobytes() for p in pages]
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int64()), pa.array(data, pa.binary())], names=["page", "bits"])

    def join(t: pa.Table) -> pa.Table:
        data = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        return pa.table({"page": t.column("page").slice(0, 1), "bits": pa.array([data.tobytes()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    joined = keys.mapInArrow(bits, "page bigint, bits binary").groupBy("page").applyInArrow(join, "page bigint, bits binary")
    for r in joined.collect():
        out[r["page"] * page // 8 : (r["page"] + 1) * page // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return (_mix(keys.astype(np.int64).view(np.uint64)) % np.uint64(size)).astype(np.int64)


def _sets(rows: DataFrame, classes: DataFrame, renamed: bool, pairs: DataFrame, words: int) -> DataFrame:
    """class, tokens of the classes in pairs, and maybe of some others. Sets are made again from the texts: a document of each
    class is known, and the scan makes the sets of the documents whose hashed id is in a bit map. Where ids repeat, a class may
    come more than once, with the same set."""
    spark = rows.sparkSession
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = staged(classes.join(wanted, "class").select("class", "digest", F.xxhash64("id").alias("key")), "wanted")
    n, texts = wanted.count(), rows.select(F.xxhash64("id").alias("key"), "text")
    size = 1 << max(13, (FILTER_BITS * n - 1).bit_length()) if n else 1 << 13
    if size > FILTER_MOST:
        texts, sent = texts.join(wanted.select("key").distinct(), "key", "left_semi"), None
    else:
        sent = spark.sparkContext.broadcast(_filter_of(wanted.select("key"), size))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = range(batch.num_rows)
            if sent is not None:
                slot = _slots(batch.column(0).to_numpy(), size)
                asked = np.flatnonzero(sent.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).tolist()
            for at in range(0, len(asked), SETS):
                made = [t for t in (shingles(batch.column(1)[k].as_py(), words) for k in asked[at : at + SETS]) if len(t)]
                digests = [digest_of(t) for t in made]
                columns = [pa.array(map(name_of, digests), pa.int64()), pa.array(digests, pa.binary()), pa.array([t.tobytes() for t in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "digest", "tokens"])

    found = texts.mapInArrow(sets, "class bigint, digest binary, tokens binary")
    if renamed:
        found = found.drop("class").join(wanted, "digest")
    found = staged(found.select("class", "tokens"), "sets")
    dropped(wanted)
    return found


def _verified(found: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of classes whose sets link; found: their class and tokens. b's set travels with the pair, to where a's set comes first of all rows with
    that a; an a, or b, of very many pairs is dealt to many tasks."""
    hot, hot_b = (hot_keys(pairs.groupBy(c).agg(F.count("*").alias("n"))) for c in "ab")
    with_b = salted_join(pairs, found.toDF("b", "tokens"), ["b"], hot_b, ["a"])
    with_b = dealt(with_b, ["a"], hot, ["b"]).select("a", "__salt", "b", "tokens")
    firsts = found.toDF("a", "tokens").join(pairs.select("a").distinct(), "a", "left_semi")
    firsts = spread(firsts, ["a"], hot).select("a", "__salt", F.lit(None).cast("long").alias("b"), "tokens")
    met = firsts.union(with_b).repartition("a", "__salt").sortWithinPartitions("a", "__salt", F.col("b").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.empty(0, np.uint64)
        for batch in batches:
            kept, first = [], batch.column(2).is_null().to_pylist()
            for y, new in zip(batch.column(3), first):
                y = np.frombuffer(y.as_buffer(), np.uint64)
                if new:
                    x = y.copy()
                    kept.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                overlap = int((both[1:] == both[:-1]).sum())
                kept.append(100 * overlap >= percent * (len(x) + len(y) - overlap))
            kept = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(kept) for k in (0, 2)], names=["a", "b"])

    return met.mapInArrow(check, "a bigint, b bigint")


class RTree:
    """Points in nodes of NODE, nodes in nodes. A box has its points' least and greatest block and n, and their upper corner.

    Points are placed by block; those of a block are halved, again and again, by n or the coordinate that varies most.
    """

    def __init__(self, block: np.ndarray, n: np.ndarray, points: np.ndarray):
        order = np.lexsort((n, block))
        ends = np.flatnonzero(np.diff(block[order])) + 1
        self.order = np.concatenate([self._placed(part, n, points) for part in np.split(order, ends)])
        upper, sides = points[self.order], [v[self.order] for v in (block, block, n, n)]
        self.levels = [(upper, *sides)]
        while len(self.levels[-1][0]) > NODE:
            starts = np.arange(0, len(self.levels[-1][0]), NODE)
            by = (np.maximum, np.minimum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(f.reduceat(v, starts) for f, v in zip(by, self.levels[-1])))

    @staticmethod
    def _placed(part: np.ndarray, n: np.ndarray, points: np.ndarray) -> np.ndarray:
        out, left = [], [part]
        while left:
            part = left.pop()
            if len(part) <= NODE:
                out.append(part)
                continue
            values = np.column_stack([n[part], points[part]]).astype(np.float32)
            part = part[np.argsort(values[:, values.var(0).argmax()], kind="stable")]
            half = -(-len(part) // (2 * NODE)) * NODE
            left += [part[half:], part[:half]]
        return np.concatenate(out)

    def search(self, block: np.ndarray, n: np.ndarray, points: np.ndarray, percent: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query, the points of its block and of a fitting size whose sum of minima with it reaches the overlap needed:
        query, place in the order given, and by how much the sum is over. Queries may have fewer groups than the tree.
        seen: gets, by level, pairs of query and node met, those within the ranges, and those within the bound."""
        m = points.shape[1]
        query = np.repeat(np.arange(len(n)), len(self.levels[-1][0]))
        at = np.tile(np.arange(len(self.levels[-1][0])), len(n))
        for k in range(len(self.levels) - 1, -1, -1):
            upper, low, high, least, most = self.levels[k]
            upper, met = folded(upper, m) if upper.shape[1] > m else upper, len(at)
            fits = (low[at] <= block[query]) & (block[query] <= high[at])
            fits &= (least[at] * percent <= 100 * n[query]) & (most[at] * 100 >= percent * n[query])
            query, at = query[fits], at[fits]
            over = np.empty(len(at), np.int64)
            step = max(1, SUMS // (m * upper.itemsize))
            for s in range(0, len(at), step):
                over[s : s + step] = np.minimum(upper[at[s : s + step]], points[query[s : s + step]]).sum(1, dtype=np.int64)
            over -= needed(n[query] + least[at], percent)
            if seen is not None:
                seen[k] = seen.get(k, np.zeros(3, int)) + (met, len(at), (over >= 0).sum())
            query, at, over = query[over >= 0], at[over >= 0], over[over >= 0]
            if k:
                below = len(self.levels[k - 1][0])
                query = np.repeat(query, NODE)
                at = (at[:, None] * NODE + np.arange(NODE)).ravel()
                query, at = query[at < below], at[at < below]
        return query, self.order[at], over


def tree_pairs(block, classes, labels, n, points: list[bytes], guest, percent: int, best: int = 0, seen: dict | None = None) -> np.ndarray:
    """(pairs, 2) classes: a guest, and one of the others in its block that has another label and is within the bound. best:
    no more than so many for a guest, those furthest within the bound. A tree holds the others, the guests are its queries."""
    out, sizes = [np.empty((0, 2), np.int64)], np.array([len(p) for p in points])

    def matrix(rows: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join(points[k] for k in rows), np.uint8).reshape(len(rows), -1)

    for m in np.unique(sizes[~guest]).tolist():
        own = np.flatnonzero(~guest & (sizes == m))
        tree = RTree(block[own], n[own], matrix(own))
        for w in np.unique(sizes[guest]).tolist():
            if max(m, w) // min(m, w) * percent > 400:  # sets that link differ little in size
                continue
            asked = np.flatnonzero(guest & (sizes == w))
            points_ = matrix(asked)
            query, place, over = tree.search(block[asked], n[asked], folded(points_, m) if w > m else points_, percent, seen)
            apart = labels[asked[query]] != labels[own[place]]
            query, place, over = query[apart], place[apart], over[apart]
            if best:
                order = np.lexsort((-over / n[own[place]], query))
                nth = np.arange(len(order)) - np.searchsorted(query[order], query[order])
                query, place = query[order[nth < best]], place[order[nth < best]]
            out.append(np.column_stack([classes[asked[query]], classes[own[place]]]))
    return np.concatenate(out)


def _tree_pairs(own: DataFrame, guests: DataFrame, percent: int, best: int = 0) -> DataFrame:
    """Pairs a < b of :func:`tree_pairs`. Both: pivot, leaf, slice, which name a part of a block, class, label, n, point."""
    columns = ("pivot", "leaf", "slice", "class", "label", "n", "point")
    met = own.select(*columns, F.lit(False).alias("guest")).union(guests.select(*columns, F.lit(True).alias("guest")))
    met = met.repartition("pivot", "leaf", "slice").sortWithinPartitions("pivot", "leaf", "slice")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[pa.RecordBatch]):
            t = pa.Table.from_batches(held)
            key = np.column_stack([t.column(k).to_numpy() for k in range(3)])
            block = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).any(1)]))
            classes, labels, n = (t.column(k).to_numpy() for k in (3, 4, 5))
            pairs = tree_pairs(block, classes, labels, n, t.column(6).to_pylist(), t.column(7).to_numpy(), percent, best)
            pairs = np.unique(np.sort(pairs, 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in (0, 1)], names=["a", "b"])

        held, rows, size = [], 0, 0
        for batch in batches:
            key = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            if held and batch.num_rows and tuple(key[0]) != last:
                cuts = np.concatenate([[0], cuts])
            at = 0
            for cut in cuts.tolist():
                if rows + cut - at >= TREE or size + batch.slice(at, cut - at).nbytes >= TREE_BYTES:
                    yield out([*held, batch.slice(at, cut - at)])
                    held, rows, size, at = [], 0, 0, cut
            if batch.num_rows:
                held.append(batch.slice(at))
                rows, size, last = rows + batch.num_rows - at, size + held[-1].nbytes, tuple(key[-1])
        if rows:
            yield out(held)

    return met.mapInArrow(join, "a bigint, b bigint").distinct()


def jaccard_components(
    docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS
) -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, component_id (the smallest id reachable by links).

    Two documents link when ``100 * overlap >= percent * union`` of their shingles of so many words. A text that is null, empty or white space has an empty
    set, and is linked with nothing: its component is its own id. Rows with equal texts are each returned; each row is a
    document of its own, even if ids repeat. A null id doesn't count as smallest, so a component of null ids alone has a
    null id. An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col), F.col(text_col)).toDF("id", "text")
    signed = staged(_signatures(rows, _frequent(rows, words), percent, words), "signatures")
    classes, renamed = _classes(signed)
    blocks = staged(_blocks(classes, percent), "blocks")
    points = classes.select("class", "n", "point")
    larger = blocks.groupBy("pivot").agg(F.count("*").alias("n"))
    hot = hot_keys(larger)
    members = blocks.select("pivot", "class").union(larger.select("pivot", "pivot"))
    members = staged(dealt(members, ["pivot"], hot, ["class"]), "members")
    leaves = F.ceil((F.col("n") + 1) / LEAF).cast("int").alias("leaves")

    def part(of: str, kind: str) -> Column:
        return F.pmod(F.xxhash64("class", F.lit(kind)), F.col(of)).cast("int").alias(kind)

    def every(of: str, kind: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias(kind)

    def stars() -> DataFrame:
        """Each class with its smallest pivot, which is the one guest of its block's parts."""
        first = members.where("class <> pivot").groupBy("class").agg(F.min_by("__salt", "pivot").alias("__salt"), F.min("pivot").alias("pivot"))
        sizes = first.groupBy("pivot").agg(F.count("*").alias("n")).select("pivot", leaves)
        shape = (F.lit(0).alias("slice"), "class", F.col("class").alias("label"), "n", "point")
        own = first.join(spread(sizes, ["pivot"], hot), ["pivot", "__salt"]).join(points, "class").select("pivot", part("leaves", "leaf"), *shape)
        guests = sizes.withColumn("class", F.col("pivot")).join(points, "class").select("pivot", every("leaves", "leaf"), *shape)
        return _tree_pairs(own, guests, percent)

    def others(labels: DataFrame, best: int) -> DataFrame:
        """Within blocks, each class that isn't of the pivot's component with those of other components."""

        def label(df: DataFrame, of: str, name: str) -> DataFrame:
            found = df.join(labels.toDF(of, "found"), of, "left")
            return found.withColumn(name, F.coalesce("found", of)).drop("found")

        known = spread(label(larger.select("pivot", leaves), "pivot", "home"), ["pivot"], hot)
        tagged = staged(label(members, "class", "label").join(known, ["pivot", "__salt"]), "tagged")
        strange = tagged.where("label <> home").groupBy("pivot").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("slices"))
        mixed = staged(tagged.join(spread(strange, ["pivot"], hot), ["pivot", "__salt"]).join(points, "class"), "mixed")
        own = mixed.withColumn("leaf", part("leaves", "leaf")).withColumn("slice", every("slices", "slice"))
        guests = mixed.where("label <> home").withColumn("slice", part("slices", "slice")).withColumn("leaf", every("leaves", "leaf"))
        found = staged(_tree_pairs(own, guests, percent, best).join(tried, ["a", "b"], "left_anti"), "more")
        dropped(tagged, mixed)
        return found

    def verified(pairs: DataFrame) -> DataFrame:
        sets = _sets(rows, classes, renamed, pairs, words)
        found = staged(_verified(sets, pairs, percent), "links")
        dropped(sets)
        return found

    tried = staged(stars(), "stars")
    labels = components(verified(tried))
    for best in (BEST, 0):
        more = others(labels, best)
        tried, before = tried.union(more), labels
        labels = components(before.toDF("a", "b").union(verified(more)))
        dropped(before)

    named = classes.select("digest", "class", "id").join(labels.toDF("class", "label"), "class", "left")
    named = named.select("digest", "id", F.coalesce("label", "class").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    larger_groups = hot_keys(named.groupBy("label").agg(F.count("*").alias("n")))
    component = salted_join(named, least, ["label"], larger_groups, ["digest"]).select("digest", "component_id")
    copied = hot_keys(classes.select("digest", F.col("copies").alias("n")))
    found = salted_join(signed.select("id", "n", "digest"), component, ["digest"], copied, ["id"], "left")
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The documents whose id is their component's: one of each group stays, the one with the smallest id, with all columns.

    Rows whose texts are null or empty are each a group of their own and stay. Of a group all of whose ids are null every row
    stays, as none can be told to be the smallest; so do all rows that share the smallest id. An empty table gives an empty result.
    """
    found = jaccard_components(docs, percent, id_col, text_col, words)
    kept = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"), percent=85, words=4)
