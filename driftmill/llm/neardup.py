"""Near-duplicate documents by bottom-k sketches.

A document's sketch is the k smallest values of one hash over its word shingles. Inverted lists of retained values give
candidate pairs, the sketch of the pair's union estimates their similarity, and the full sets decide. Documents with
equal sets are one class, so that copies are never paired; components are found over classes.

Two sets of similarity 0.8 or more share at least LEAST of 64 retained values but for a chance under 1e-6 (binomial
tail). Two sketches with LEAST common values meet in one of their k - LEAST + 1 rarest values, so only these are listed:
very common shingles produce no pairs. Every list first links its members with a few leaders one after the other, by the same
order in all lists, so that a group of near copies has few; after joining what they link, only members outside the leader's component are compared with the rest of the list:
first within parts of a list, then, after joining again, across the parts of lists that have several. Where two parts
meet, maps of 256 bits are held against each other, one bit for each retained value: maps of sketches with c common
values of a and b differ in at most a + b - 2c bits, so that this test loses no pair. It is left to the list of the
rarest value that two sketches have in common. No pair becomes a row: a list names the members that still have a
partner, each once, and their whole sets meet in one task, which estimates from sketches, verifies on full sets and
gives the links of a spanning forest. So no list is ever expanded into all pairs, and no pair between different
components goes unchecked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, codes, discard, files, hashes, mixed, prepare, written
from .tokens import forget

#: Values in a sketch, and common values that a pair of similarity 0.8 has at least.
K, LEAST = 64, 33

#: Members of a block of a list, and of a tile of small groups, on average.
BLOCK, TILE = 200, 256

#: Leaders that every list has, one after the other.
LEADERS = 2

#: Edges whose components one task finds.
LOCAL = 1_000_000

#: Shingles of all sets that meet in one task, on average.
WEIGHT = 2_000_000

#: Pairs of a set that are verified before the rest of its pairs, the likeliest ones.
LIKELIEST = 16

#: Fills sketches of fewer than K values.
PAD = np.iinfo(np.int64).max

#: Blocks in a part of a list; parts are also bounded by WEIGHT.
TOGETHER = 16

#: Columns of 64 bits that map a sketch's values.
MAP = [f"b{k}" for k in range(4)]

#: Rows of up to 60 bytes (ids and a class's key) that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 300_000


def shingles(values: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, ascending; of all words together where there are fewer than size."""
    word, distinct, counts = codes(values, LOWER)
    h = hashes(distinct)[word] if len(word) else np.zeros(0, np.uint64)
    out = []
    for end, n in zip(np.cumsum(counts), counts):
        own = h[end - n : end]
        width = min(size, n)
        if not n:
            out.append(own)
            continue
        rows = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            rows *= np.uint64(0x9E3779B97F4A7C15)
            rows += own[k : k + len(rows)]
        if n < size:  # fewer words than a shingle: apart from shingles of the same words
            rows += np.uint64(n)
        out.append(np.unique(mixed(rows)))
    return out


def _key(own: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def _maps(sets: list[np.ndarray]) -> list[pa.Array]:
    bits = 64 * len(MAP)
    marked = np.zeros((len(sets), bits), bool)
    for row, own in zip(marked, sets):
        row[(own[:K] % np.uint64(bits)).astype(np.int64)] = True
    return [pa.array(c) for c in np.packbits(marked, axis=1).view(np.int64).reshape(len(sets), len(MAP)).T]


def _signatures(size: int):
    def run(batches):
        forget()
        for b in batches:
            sets = shingles(b.column(1), size)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.binary()), pa.array([s[:K].view(np.int64) for s in sets], pa.list_(pa.int64())), *_maps(sets)],
                names=["doc_id", "n_shingles", "cls", "sketch", *MAP],
            )

    return run


def _sets(size: int):
    def run(batches):
        forget()
        seen: set[int] = set()
        for b in batches:
            sets = shingles(b.column("text"), size)
            # of repeated ids, one row of the class alone
            keep = []
            for own, k, n in zip(sets, b.column("cls").to_pylist(), b.column("node").to_pylist()):
                keep.append(n not in seen and _key(own) == k)
                if keep[-1]:
                    seen.add(n)
            keep = pa.array(keep, pa.bool_())
            found = pa.RecordBatch.from_arrays([b.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"])
            yield found.filter(keep)

    return run


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(ends, ends[1:])]


def _block(members: pa.ListScalar) -> tuple[np.ndarray, ...]:
    flat = members.values
    maps = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in MAP], axis=1).view(np.uint64)
    return *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "comp", "head")), maps, _lists(flat.field("before"))


def _compared(percent: int):
    """Blocks xs and ys of one list: pairs of different components that may be similar."""

    def pairs(xs: tuple, ys: tuple) -> tuple[np.ndarray, np.ndarray]:
        (xi, xn, xc, _, xm, xb), (yi, yn, yc, head, ym, yb) = xs, ys
        small, large = np.minimum(xn[:, None], yn[None]), np.maximum(xn[:, None], yn[None])
        open_ = (xc[:, None] != yc[None]) & (100 * small >= percent * large)
        # two that are both outside meet in both orders
        open_ &= (yc == head)[None] | (xi[:, None] < yi[None])
        i, j = np.nonzero(open_)
        apart = np.zeros(len(i), np.int64)
        for k in range(len(MAP)):
            apart += np.bitwise_count(xm[i, k] ^ ym[j, k])
        small = small[i, j]
        most = np.minimum(xn[i], K) + np.minimum(yn[j], K) - 2 * np.minimum(LEAST, -(-small * percent // 100))
        i, j = i[apart <= most], j[apart <= most]
        if not len(i):
            return i, j
        # nothing rarer than the list's own value may be common
        counts = np.array([len(c) for c in xb + yb])
        _, at = np.unique(np.concatenate(xb + yb), return_inverse=True)
        seen = np.zeros((len(counts), at.max(initial=0) + 1), np.float32)
        seen[np.repeat(np.arange(len(counts)), counts), at] = 1
        first = (seen[: len(xb)] @ seen[len(xb) :].T == 0)[i, j]
        return i[first], j[first]

    def run(batches):
        forget()
        # rows of one key follow each other, so that a member comes out once
        at, found = None, []

        def named():
            columns = [np.concatenate(c) for c in zip(*found)]
            _, first = np.unique(columns[0] * 4 + columns[3], return_index=True)
            key = np.full(len(first), at)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (key, *(c[first] for c in columns))], names=["key", "node", "n", "comp", "side"])

        for b in batches:
            for r in range(b.num_rows):
                key = b.column("key")[r].as_py()
                if key != at:
                    if found:
                        yield named()
                    at, found = key, []
                xs, ys = (_block(b.column(c)[r]) for c in ("xs", "ys"))
                for side, own, ends in zip((1, 2), (xs, ys), map(np.unique, pairs(xs, ys))):
                    if len(ends):
                        found.append((*(c[ends] for c in own[:3]), np.full(len(ends), side)))
        if found:
            yield named()

    return run


def _joined(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the pairs (i, j), each once, and the smallest end that each is joined with."""
    ends, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    label = np.arange(len(ends))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return ends, ends[label]
        label = new


def _forest(node: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of similarity percent or more between the first side (bit 1) and the second (bit 2) that join components.

    A set's open partners are estimated from the sketch of the union; the likeliest are verified first, and the others
    only while they are in another component.
    """
    counts = np.array([len(s) for s in sets])
    ends = np.cumsum(counts)
    distinct, terms = np.unique(np.concatenate(sets), return_inverse=True)
    own = [terms[e - c : e] for e, c in zip(ends, counts)]
    _, label = np.unique(comp, return_inverse=True)
    second = np.flatnonzero(side & 2)
    kept = np.minimum(counts, K)
    # the numbers of terms ascend with their values, so that a sketch is a set's first numbers
    sketch = np.full((len(second), K), len(distinct))
    for row, y in zip(sketch, second):
        row[: kept[y]] = own[y][:K]
    place = np.full(len(distinct) + 1, -1, np.int16)
    held = np.zeros(len(distinct), bool)
    links = []
    for x in np.flatnonzero(side & 1):
        small, large = np.minimum(counts[x], counts[second]), np.maximum(counts[x], counts[second])
        open_ = (label[second] != label[x]) & (100 * small >= percent * large)
        if side[x] & 2:  # two that are on both sides meet once
            open_ &= (side[second] & 1 == 0) | (second > x)
        rows = np.flatnonzero(open_)
        if not len(rows):
            continue
        place[own[x][:K]] = np.arange(kept[x])
        found = place[sketch[rows]]
        place[own[x][:K]] = -1
        both = found >= 0
        rank = found + np.arange(K) - (np.cumsum(both, axis=1) - 1)
        common = (both & (rank < K)).sum(axis=1)
        union = np.minimum(kept[x] + kept[second[rows]] - both.sum(axis=1), K)
        likely = common * K >= union * LEAST
        todo = second[rows[likely][np.argsort(-(common / union)[likely], kind="stable")]]
        held[own[x]] = True
        for todo in (todo[:LIKELIEST], todo[LIKELIEST:]):
            todo = todo[label[todo] != label[x]]
            if not len(todo):
                continue
            begin = np.concatenate([[0], np.cumsum(counts[todo])[:-1]])
            shared = np.add.reduceat(held[np.concatenate([own[y] for y in todo])].astype(np.int64), begin)
            for y in todo[100 * shared >= percent * (counts[x] + counts[todo] - shared)]:
                if label[y] != label[x]:
                    links.append((node[x], node[y]))
                    label[label == label[y]] = label[x]
        held[own[x]] = False
    return links


def _verified(percent: int):
    """One tile's groups of sets: the links that join components."""

    def run(tile: pa.Table) -> pa.Table:
        forget()
        order = np.lexsort([tile.column(c).to_numpy() for c in ("node", "group")])
        group, node = (tile.column(c).to_numpy()[order] for c in ("group", "node"))
        # rows with repeated ids bring a set more than once
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(group) != 0) | (np.diff(node) != 0)
        order = order[first]
        group, node, comp, side = (tile.column(c).to_numpy()[order] for c in ("group", "node", "comp", "side"))
        held = tile.column("shingles").to_pylist()
        sets = [np.frombuffer(held[k], np.uint64) for k in order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        links = [link for i, j in zip(cuts, cuts[1:]) for link in _forest(node[i:j], comp[i:j], side[i:j], sets[i:j], percent)]
        found = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return run


def _contracted(batches):
    """All edges of a partition as links of every node with the smallest one that they join it with."""
    forget()
    own = [b for b in batches if b.num_rows]
    if own:
        a, b = (np.concatenate([x.column(c).to_numpy() for x in own]) for c in "ab")
        ends, label = _joined(a, b)
        far = ends != label
        yield pa.RecordBatch.from_arrays([pa.array(ends[far]), pa.array(label[far])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node and comp, the smallest node reachable; nodes without edges are absent.

    Edges are contracted in parts of LOCAL, each in one task. As long as there are several parts, a round of large-star and
    small-star steps follows, until a round changes nothing. Each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    before = None
    while True:
        parts = -(-now.count() // LOCAL)
        new, new_path = written(now.repartition(max(parts, 1)).mapInArrow(_contracted, "a bigint, b bigint"), "edges")
        discard(spark, path)
        now, path = new, new_path
        if parts > 1:
            # large star: each node's larger neighbours link to its smallest neighbour or itself
            near = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            # small star: each node and its smaller neighbours link to the smallest of them
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
            new, new_path = written(small, "edges")
            discard(spark, path)
            now, path = new, new_path
            # the links' count and a sum over their hashes tell whether the set changed
            sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if sign != before:
                before = sign
                continue
        return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _earlier(values: Column, v: Column) -> Column:
    """What a member has before the list's value v, all 64 bits: others that only look alike must not rule a pair out."""
    return F.slice(values, 1, F.array_position(values, v).cast("int") - 1)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its shingle count and component: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; percent must be 80 or more, which the sketches rely on.
    component_id is the smallest id reachable over links of similarity percent or more, kept where it is the row's own.
    Null, empty and blank texts have no shingles and are kept with their own id. Rows with a null id count for nothing
    else: they get the component of their set's other rows, or null, and are kept only if that is null. Repeated ids
    are kept together. Other columns are ignored.
    """
    if percent < 80:
        raise ValueError("sketches of this size find similarities of 80 percent and more")
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    maps = ", ".join(f"{c} bigint" for c in MAP)
    rows, rows_at = written(source.mapInArrow(_signatures(size), f"doc_id {kind}, n_shingles bigint, cls binary, sketch array<bigint>, {maps}"), "signatures")
    most = files(spark, rows.count())
    least = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("sketch").alias("sketch"), *(F.min(c).alias(c) for c in MAP))
    classes, classes_at = written(least.withColumn("node", F.monotonically_increasing_id()), "classes", most)

    # each class's rarest retained values, without those that no other class retains
    posted = classes.where("rep is not null").select("node", F.explode("sketch").alias("v"))
    shared = posted.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    # a smaller set is its own sketch, but a larger partner's sketch may lack some of what they share
    beyond = F.greatest(F.floor(F.col("n") * 100 / percent) - K, F.lit(0))
    least_common = F.when(F.col("n") < K, F.ceil(F.col("n") * percent / 100) - beyond).otherwise(F.lit(LEAST))
    prefix = F.least(F.col("n"), F.lit(K)) - F.greatest(least_common, F.lit(1)) + 1
    own = posted.join(shared, "v").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("common"))
    own = own.join(classes.select("node", "n", *MAP), "node")
    # values of df 1 come first in the order by rarity
    alone = F.least(F.col("n"), F.lit(K)) - F.size("common")
    own = own.withColumn("first", F.slice("common.v", 1, F.greatest(prefix - alone, F.lit(0)).cast("int"))).where(F.size("first") > 0)
    listed, listed_at = written(own.select("node", "n", "first", *MAP), "listed", most)
    lists = listed.select("node", "n", F.explode("first").alias("v"))
    sizes_of = [F.count("*").alias("members"), F.sum("n").alias("weight")]
    def verified(members: DataFrame) -> tuple[DataFrame, str]:
        """Links among members (key, node, n, comp, side): a key's two sides meet in one task."""
        members, all_at = written(members.groupBy("key", "node", "n", "comp").agg(F.bit_or("side").alias("side")), "members", most)
        rows, weight = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        tiles = max(1, rows // TILE, weight // WEIGHT)
        nodes = members.select("node").distinct().join(classes.select("node", "cls", "rep"), "node").select(F.col("rep").alias("doc_id"), "cls", "node")
        sets = source.join(_bounded(nodes), "doc_id").select("text", "cls", "node").mapInArrow(_sets(size), "node bigint, shingles binary")
        together = sets.join(_bounded(members.withColumnRenamed("key", "group").drop("n")), "node").withColumn("tile", F.pmod(F.xxhash64("group"), F.lit(tiles)))
        links, links_at = written(together.groupBy("tile").applyInArrow(_verified(percent), "a bigint, b bigint"), "links")
        discard(spark, all_at)
        return links, links_at

    sizes = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    apart = sum((F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))) for c in MAP), F.lit(0))
    common = F.least(F.lit(LEAST), F.ceil(F.least("xn", "yn") * percent / 100))
    near = apart <= F.least("xn", F.lit(K)) + F.least("yn", F.lit(K)) - 2 * common
    # a leader meets the members of a long list in several tasks
    chunks = F.ceil(F.greatest(F.col("members") / TILE, F.col("weight") / WEIGHT))
    placed, placed_at = listed.withColumn("comp", F.col("node")), None
    links, kept_at = None, []
    for k in range(LEADERS):
        lists = placed.select("node", "n", "comp", F.explode("first").alias("v"))
        leaders = lists.groupBy("v").agg(F.min_by(F.struct("node", "n", "comp"), F.xxhash64("node", F.lit(k))).alias("leader"), *sizes_of).where("members > 1")
        leaders, leaders_at = written(leaders, "leaders", most)
        stars = lists.join(leaders, "v").where((F.col("comp") != F.col("leader.comp")) & sizes(F.col("n"), F.col("leader.n")))
        stars = stars.groupBy(F.col("node").alias("x"), F.col("leader.node").alias("y")).agg(F.max("members").alias("members"), F.max("weight").alias("weight"))
        for end in "xy":
            stars = stars.join(placed.select("node", "n", "comp", *MAP).toDF(end, f"{end}n", f"{end}comp", *(f"{end}{c}" for c in MAP)), end)
        stars = stars.where(near).select("x", "xn", "xcomp", "y", "yn", "ycomp", F.xxhash64("y", chunks, F.pmod(F.xxhash64("x"), chunks)).alias("key"))
        stars, stars_at = written(stars, "stars", most)
        one = lambda c, side: stars.select("key", F.col(c).alias("node"), F.col(f"{c}n").alias("n"), F.col(f"{c}comp").alias("comp"), F.lit(side).cast("bigint").alias("side"))  # noqa: B023, E731
        found, found_at = verified(one("x", 1).unionByName(one("y", 2).distinct()))
        links = found if links is None else links.unionByName(found)
        kept_at.append(found_at)
        joined, joined_at = written(components(links), "joined", most)
        new, new_at = written(listed.join(joined, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp"), "first", *MAP), "placed", most)
        discard(spark, stars_at, joined_at, *([placed_at] if placed_at else []))
        placed, placed_at = new, new_at
        if k < LEADERS - 1:
            discard(spark, leaders_at)

    before = _earlier(F.col("first"), F.col("v"))
    parts = F.ceil(F.greatest(F.col("members") / (BLOCK * TOGETHER), F.col("weight") / WEIGHT))
    leaders = leaders.withColumn("parts", parts.cast("bigint"))
    several = not leaders.where("parts > 1").isEmpty()
    for across in (False, True) if several else (False,):
        # in each list, who is not yet joined with the last leader against all who are in other components
        if across:
            joined, joined_at = written(components(links), "joined", most)
            new, new_at = written(listed.join(joined, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp"), "first", *MAP), "placed", most)
            discard(spark, joined_at, placed_at)
            placed, placed_at = new, new_at
        heads = leaders.where("parts > 1" if across else "true").select("v", "members", "parts", F.col("leader.node").alias("node")).join(placed.select("node", F.col("comp").alias("head")), "node").drop("node")
        outside = placed.select("node", "comp", F.explode("first").alias("v")).join(heads, "v").where("comp <> head").select("v", "node", "members", "parts", "head")
        outside, outside_at = written(outside, "outside", most)
        inside = outside.groupBy("v").agg(F.max("members").alias("members"), F.max("parts").alias("parts"), F.max("head").alias("head"))
        both = placed.select("node", F.explode("first").alias("v")).join(inside, "v")
        part = F.pmod("block", "parts")
        other = F.explode(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda p: p != part)) if across else part

        def blocks(of: DataFrame, name: str, mine: str, theirs: str) -> DataFrame:
            """Blocks of a list's members, grouped where they meet."""
            of = of.join(placed, "node").withColumns({"block": F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / (F.col("parts") * BLOCK)) * F.col("parts")), "before": before})
            of = of.select("v", part.alias(mine), other.alias(theirs), "block", F.struct("node", "n", "comp", "head", *MAP, "before").alias("one"))
            return of.repartition("v", "xp", "yp").groupBy("v", "xp", "yp", "block").agg(F.collect_list("one").alias(name)).drop("block")

        xs, ys = blocks(outside, "xs", "xp", "yp"), blocks(both, "ys", "yp", "xp")
        rest = xs.join(ys, ["v", "xp", "yp"]).select(F.xxhash64("v", "xp", "yp").alias("key"), "xs", "ys").mapInArrow(_compared(percent), "key bigint, node bigint, n bigint, comp bigint, side bigint")
        more, more_at = verified(rest)
        links = links.unionByName(more)
        kept_at.append(more_at)
        discard(spark, outside_at)
    final = components(links).withColumnRenamed("node", "__node")

    ends = classes.select("cls", "rep", "node").join(final, F.col("node") == F.col("__node"), "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = ends.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class, _ = written(ends.join(lowest, "comp").select("cls", "component_id"), "components", most)
    discard(spark, classes_at, listed_at, leaders_at, placed_at, *kept_at)
    out = rows.select("doc_id", "n_shingles", "cls").join(by_class, "cls", "left").withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of their component."""
    found = near_duplicates(docs, size, percent, id_col, text_col)
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
