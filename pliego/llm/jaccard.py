"""Exact Jaccard join of word shingle sets by set relations, and the components of its links.

Three relations between sets save work, none of which loses a link:

* Equal sets are one node.
* Sets that share too little with anything are out of question: a shingle of one set only is no part of any intersection, so a set with more
  of them than a link may leave out has no partner.
* Highly similar sets are a cluster, a leader and members with what they have more and less than it. Whatever is known of the leader
  bounds the answers of its members: |x & z| = |y & z| + |z & (x - y)| - |z & (y - x)| for a member x of leader y. Two clusters are told apart, or
  linked, by one intersection of their leaders where the bound decides, and by these increments where it doesn't.

Candidates come from an index of prefixes, rarest shingles first. A shingle's list has one entry for each cluster, in blocks ordered by
how many shingles follow its position; a pair of blocks whose positions leave too few for a link is skipped whole, likewise one of sizes too different.

Clusters are found by rounds over minimum hashes; these only save work. Clusters in one component need no comparison. A link is found for every
two components that have one, so components are exact, while groups of copies never become all their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pliego.llm import tables
from pliego.llm.simhash import components

WORDS = 4
SHARE = 85
SEED = 0
#: One of so many shingles, by hash, is counted to tell which sets may have partners at all; of those that may, all are.
PART = 4
#: Shingles that a task holds before it sends the sets on.
HELD = 500_000
#: Sets, and shingles, that one task clusters at a time.
GROUP = 256
GROUP_SHINGLES = 2_000_000
#: Entries of an index list that are compared at a time, and of one block of it.
TILE = 2048
BLOCK = 32
#: Clustering ends when a round joins less than this share of the leaders, or after ROUNDS.
LEAST_JOINED = 0.05
ROUNDS = 12
#: Shingles whose holders are multiplied at a time.
STRIP = 8192


# Sets


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes (signed 64 bits) of the text's shingles."""
    w = text.encode().lower().split()
    if not w:
        return np.empty(0, np.int64)
    joined = b" ".join(w)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, SEED)], np.uint64).view(np.int64)
    sizes = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(sizes + 1) - 1
    pairs = zip((ends - sizes)[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64).view(np.int64))


def sets_of(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, key, grams) of each row: a set's size, 128 bits that stand for it, and its hashes, sorted."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def row_batch(ids: pa.Array, grams: list[np.ndarray]) -> pa.RecordBatch:
        keys = [np.frombuffer(xxhash.xxh3_128_digest(g.tobytes()), np.int64) for g in grams]
        offsets = pa.array(np.cumsum([0, *map(len, grams)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *grams])))
        halves = [pa.array([int(k[i]) for k in keys], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([ids, pa.array([len(g) for g in grams], pa.int64()), *halves, lists], ["id", "n", "key_a", "key_b", "grams"])

    def run(batches):
        for b in batches:
            at, grams, held = 0, [], 0
            for i in range(b.num_rows):
                grams.append(shingles(b.column("text")[i].as_py(), words))
                held += len(grams[-1])
                if held >= HELD or i == b.num_rows - 1:
                    yield row_batch(b.column("id").slice(at, len(grams)), grams)
                    at, grams, held = i + 1, [], 0

    schema = T.StructType([T.StructField("id", base.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in ("n", "key_a", "key_b")], T.StructField("grams", T.ArrayType(T.LongType()))])
    return base.mapInArrow(run, schema)


def least_shared(n: Column | int, share: int) -> Column | int:
    """The smallest intersection that a set of n can have with a partner: ceil(share * n / 100), as the union is no smaller than n."""
    return F.floor((F.lit(share) * n + 99) / 100).cast("long") if isinstance(n, Column) else -(-share * n // 100)


def linked(common, n_a, n_b, share: int):
    """100 * intersection >= share * union; the union is n_a + n_b - common."""
    return (100 + share) * common >= share * (n_a + n_b)


def without_loners(sets: DataFrame, share: int, part: int) -> DataFrame:
    """The rows of sets whose set may have a partner other than an equal one.

    Of every part-th shingle by hash (part: a power of two), those in a single distinct set are counted for that set. A set with more of them than it may
    leave out has no partner. Such a count is a lower bound of the true one, so nothing is lost; tasks add up before they send, so a shingle of all sets is one row a task.
    """
    some = F.filter("grams", lambda h: h.bitwiseAND(F.lit(part - 1)) == 0) if part > 1 else F.col("grams")
    grams = sets.select("key_a", F.explode(some).alias("h"))
    owners = grams.groupBy("h").agg(F.min("key_a").alias("key_a"), F.max("key_a").alias("_other")).where("key_a = _other")
    own = owners.groupBy("key_a").agg(F.count("*").alias("own"))
    sizes = sets.groupBy("key_a").agg(F.max("n").alias("n"))
    kept = sizes.join(own, "key_a", "left").where(F.coalesce("own", F.lit(0)) <= F.col("n") - least_shared(F.col("n"), share))
    return sets.join(tables.small(tables.written(kept.where("n > 0").select("key_a"))), "key_a", "left_semi")


# Clusters


def overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of one sorted set with each of others."""
    if not others:
        return np.empty(0, np.int64)
    every = np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every if len(own) else np.zeros(len(every), bool)
    ends = np.cumsum([len(o) for o in others])
    sums = np.concatenate([[0], np.cumsum(hit)])
    return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]


def common_of(grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    every, owner = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, name, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[name] > 1
    _, name = np.unique(name[shared], return_inverse=True)
    owner, out = owner[shared], np.zeros((len(grams), len(grams)), np.float32)
    order = np.argsort(name, kind="stable")
    name, owner = name[order], owner[order]
    for at in range(0, int(name.max(initial=-1)) + 1, STRIP):
        low, high = np.searchsorted(name, [at, at + STRIP])
        held = np.zeros((len(grams), STRIP), np.float32)
        held[owner[low:high], name[low:high] - at] = 1
        out += held @ held.T  # sums of ones, exact
    return out.astype(np.int64)


def led(t: pa.Table, share: int) -> pa.Table:
    """The sets of one group as clusters: (node, leader, direct).

    The set with the most links to sets that are in no cluster yet leads these, again and again, so that the text others were made from leads them. Direct rows say that a
    node links to its leader; the others, that the leader `node` is joined to `leader` by links over several sets of the group.
    """
    nodes, grams = t.column("node").to_numpy(), [g.values.to_numpy() for g in t.column("grams")]
    sizes = np.array([len(g) for g in grams], np.int64)
    links = linked(common_of(grams), sizes[:, None], sizes[None, :], share)
    np.fill_diagonal(links, True)
    place = np.lexsort((nodes, -sizes))  # ties of links: the larger set, then the smaller node
    links, free, leader = links[place][:, place], np.ones(len(nodes), bool), np.arange(len(nodes))
    while free.any():
        first = int(np.argmax(np.where(free, (links & free).sum(axis=1), 0)))
        leader[links[first] & free] = first
        free &= ~links[first]
    root = np.arange(len(nodes))
    while True:
        low = np.where(links, root[None, :], len(nodes)).min(axis=1)
        if (low == root).all():
            break
        root = low
    own = np.arange(len(nodes))
    members, others = own[leader != own], own[leader == own]
    heads = np.full(len(nodes), len(nodes))
    np.minimum.at(heads, root[others], others)
    far = others[heads[root[others]] != others]
    pairs = [(members, leader[members], 1), (far, heads[root[far]], 0)]
    cols = [np.concatenate([nodes[place[p[k]]] for p in pairs]) for k in (0, 1)]
    return pa.table({"node": pa.array(cols[0], pa.int64()), "leader": pa.array(cols[1], pa.int64()), "direct": pa.array(np.repeat([p[2] for p in pairs], [len(p[0]) for p in pairs]).astype(np.int32))})


def grouped(nodes: DataFrame, seed: int) -> DataFrame:
    """nodes with a group (low, part): sets of equal minimum hash, in parts that one task can hold."""
    marked = nodes.withColumn("low", F.array_min(F.transform("grams", lambda h: F.xxhash64(h, F.lit(seed)))))
    counts = marked.groupBy("low").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int").alias("parts"), F.count("*").alias("_size")).where("_size > 1")
    return marked.join(counts, "low").withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts")).cast("int")).drop("_size", "parts")


def clusters(nodes: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """((node, leader) of every node, (u, v) of nodes that are known to be joined by links).

    The first round makes the clusters, some GROUP sets each at most. Later rounds group the leaders in the same way by other hashes, so that even
    millions of near copies become few components before candidates are searched.
    """
    found, edges, alive = None, None, nodes
    for seed in range(1, ROUNDS + 1):
        groups = grouped(alive.select("node", "n", "grams"), seed).select("node", "grams", "low", "part")
        new = tables.written(groups.groupBy("low", "part").applyInArrow(lambda t: led(t, share), "node long, leader long, direct int"))
        joined = new.select(F.col("node").alias("u"), F.col("leader").alias("v"))
        edges = joined if edges is None else edges.unionByName(joined)
        members = new.where("direct = 1").select("node", "leader")
        if found is None:
            found = tables.written(nodes.select("node").join(members, "node", "left").select("node", F.coalesce("leader", "node").alias("leader")))
        n_new, n_alive = members.count(), alive.count()
        alive = tables.written(alive.join(members.select("node"), "node", "left_anti"))
        if n_new <= LEAST_JOINED * n_alive and seed > 1:
            break
    return found, edges


# Candidates


def postings(nodes: DataFrame, share: int) -> DataFrame:
    """(h, node, n, left): the prefix of each set without the shingles of one node only; left: shingles from this position on, itself included.

    Positions are in the order of frequency, rarest first, ties by hash. Two sets that link share a shingle of both prefixes.
    """
    every = nodes.select("node", "n", F.explode("grams").alias("h"))
    often = every.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = every.join(often, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    single = F.col("n") - F.size("shared")
    length = F.col("n") - least_shared(F.col("n"), share) + 1 - single  # of the prefix, beyond what no other set has
    prefix = F.slice("shared", 1, F.greatest(F.lit(0), length).cast("int"))
    return shared.select("node", "n", single.alias("single"), F.posexplode(prefix).alias("at", "s")).select(F.col("s.h").alias("h"), "node", "n", (F.col("n") - F.col("single") - F.col("at")).alias("left"))


ENTRY = ("cluster", "comp", "low", "high", "left")


def near_blocks(a: dict[str, np.ndarray], b: dict[str, np.ndarray], share: int) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, cluster) of the entries of two parts of one list that may link; both are sorted by `left`, largest first.

    Sets of low to high shingles whose first common one leaves `left` at most can share no more than the smaller `left`. Blocks are judged by
    their largest left and high and their smallest low, and skipped whole; of the others each pair of entries is.
    """
    starts_a, starts_b = (np.arange(0, len(x["left"]), BLOCK) for x in (a, b))

    def may(x, y):
        common = np.minimum(x["left"][:, None], y["left"][None, :])
        low = x["low"][:, None] + y["low"][None, :]
        sizes = (100 * x["high"][:, None] >= share * y["low"][None, :]) & (100 * y["high"][None, :] >= share * x["low"][:, None])
        return ((100 + share) * common >= share * low) & sizes

    of_block = lambda x, s: {"left": x["left"][s], "low": np.minimum.reduceat(x["low"], s), "high": np.maximum.reduceat(x["high"], s)}
    out: tuple[list, list] = ([], [])
    for i, j in zip(*np.nonzero(may(of_block(a, starts_a), of_block(b, starts_b))), strict=True):
        x = {k: v[i * BLOCK : (i + 1) * BLOCK] for k, v in a.items()}
        y = {k: v[j * BLOCK : (j + 1) * BLOCK] for k, v in b.items()}
        u, v = np.nonzero(may(x, y) & (x["comp"][:, None] != y["comp"][None, :]))
        out[0].append(x["cluster"][u])
        out[1].append(y["cluster"][v])
    first, second = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)
    return np.minimum(first, second), np.maximum(first, second)


def pivots(lists: DataFrame, share: int) -> DataFrame:
    """(u, v): pairs of each list's largest cluster with its other clusters of other components that may link to it.

    They are as many as there are entries. If a text has many variants that do not link to each other, it leads the largest cluster, and these pairs
    join all of them through it, where all pairs of the variants would have been candidates.
    """
    big = lists.groupBy("h").agg(F.max_by(F.struct(*ENTRY), F.struct("size", "cluster")).alias("p"), F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a <> _b").select("h", "p")
    both = lists.join(big, "h").where(F.col("comp") != F.col("p.comp"))
    may = (F.lit(100 + share) * F.least("left", "p.left") >= F.lit(share) * (F.col("low") + F.col("p.low"))) & (100 * F.col("high") >= share * F.col("p.low")) & (100 * F.col("p.high") >= share * F.col("low"))
    near = both.where(may)
    return near.select(F.least("cluster", "p.cluster").alias("u"), F.greatest("cluster", "p.cluster").alias("v")).distinct()


def candidates(lists: DataFrame, share: int) -> DataFrame:
    """(u, v): distinct pairs of clusters, of different components, that may hold a link. lists: (h, *ENTRY), one row for each cluster of h."""
    counted = lists.groupBy("h").agg(F.count("*").alias("_n"), F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a <> _b")
    sized = lists.join(counted.select("h", "_n"), "h")
    part = F.pmod(F.xxhash64("cluster"), F.ceil(F.col("_n") / TILE)).cast("int")
    tiles = sized.withColumn("part", part).groupBy("h", "part").agg(F.collect_list(F.struct(*ENTRY)).alias("tile"))
    tiles = tables.written(tiles)
    right = tiles.select("h", F.col("part").alias("part_b"), F.col("tile").alias("tile_b"))
    pairs = tiles.join(right, "h").where("part <= part_b").select("tile", "tile_b")

    def compare(batches):
        for b in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k in range(b.num_rows):
                sides = []
                for c in ("tile", "tile_b"):
                    rows = b.column(c)[k].values
                    cols = {name: rows.field(name).to_numpy() for name in ENTRY}
                    order = np.lexsort((cols["cluster"], -cols["left"]))
                    sides.append({name: v[order] for name, v in cols.items()})
                u, v = near_blocks(*sides, share)
                us.append(u)
                vs.append(v)
            both = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long").distinct()


# Answers


def judged(b: pa.RecordBatch, share: int) -> np.ndarray:
    """For each pair of clusters, from their leaders' sets and what members have more and less: 1 linked, 0 no link, -1 left to the members."""
    col = lambda name: b.column(name).to_numpy()
    n_a, n_b = (np.fromiter((len(g) for g in b.column(c)), np.int64, b.num_rows) for c in ("grams", "grams_b"))
    common = np.fromiter((overlaps(x.values.to_numpy(), [y.values.to_numpy()])[0] for x, y in zip(b.column("grams"), b.column("grams_b"), strict=True)), np.int64, b.num_rows)
    most = common + col("more") + col("more_b")
    may = linked(most, col("low"), col("low_b"), share) & ((col("size") > 1) | (col("size_b") > 1))
    return np.where(linked(common, n_a, n_b, share), 1, np.where(may, -1, 0)).astype(np.int32)


def members_link(a: dict, b: dict, share: int) -> bool:
    """Whether a set of cluster a links to one of cluster b. Each: lead (the leader's set), plus and minus (lists of what each member has more and less).

    The intersection of the leaders is taken once. That of a member of a with b's leader follows from its own few shingles, and bounds what b's
    members can reach with it; only where that is enough are their few shingles looked up in it.
    """
    y, z = a["lead"], b["lead"]
    base = overlaps(y, [z])[0]
    with_z = base + overlaps(z, a["plus"]) - overlaps(z, a["minus"])
    n_a = len(y) + np.array([len(p) - len(m) for p, m in zip(a["plus"], a["minus"], strict=True)])
    plus_b, minus_b = (np.array([len(x) for x in b[c]]) for c in ("plus", "minus"))
    n_b = len(z) + plus_b - minus_b
    for i in np.argsort(-with_z, kind="stable").tolist():
        may = np.flatnonzero(linked(np.minimum(with_z[i] + plus_b, np.minimum(n_a[i], n_b)), n_a[i], n_b, share))
        if not len(may):
            continue
        x = np.union1d(np.setdiff1d(y, a["minus"][i], assume_unique=True), a["plus"][i])
        common = with_z[i] + overlaps(x, [b["plus"][k] for k in may]) - overlaps(x, [b["minus"][k] for k in may])
        if linked(common, n_a[i], n_b[may], share).any():
            return True
    return False


def leader_rows(nodes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((cluster, grams, size, low, more) of each cluster: its leader's set, its sets, their smallest size, and most that one has beyond the leader;
    (cluster, lead, plus, minus) of those with members: all differences to the leader, the leader's own first)."""
    pairs = found.where("node <> leader").join(nodes.select("node", F.col("grams").alias("own")), "node").join(nodes.select(F.col("node").alias("leader"), F.col("grams").alias("lead")), "leader")

    def differ(batches):
        for b in batches:
            gaps = [(np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)) for x, y in ((b.column("own")[k].values.to_numpy(), b.column("lead")[k].values.to_numpy()) for k in range(b.num_rows))]
            lists = [pa.array([g[k] for g in gaps], pa.list_(pa.int64())) for k in (0, 1)]
            sizes = pa.array([len(x) for x in b.column("own")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("leader"), *lists, sizes], ["leader", "plus", "minus", "n"])

    gaps = tables.written(pairs.select("leader", "own", "lead").mapInArrow(differ, "leader long, plus array<long>, minus array<long>, n long"))
    sums = gaps.groupBy("leader").agg(F.count("*").alias("members"), F.min("n").alias("least"), F.max(F.size("plus")).cast("long").alias("most"))
    leaders = found.where("node = leader").select("leader").join(nodes.select(F.col("node").alias("leader"), "n", "grams"), "leader").join(sums, "leader", "left")
    zero = F.lit(0).cast("long")
    heads = leaders.select(F.col("leader").alias("cluster"), "grams", (1 + F.coalesce("members", zero)).alias("size"), F.least("n", F.coalesce("least", "n")).alias("low"), F.coalesce("most", zero).alias("more"))
    bodies = gaps.groupBy("leader").agg(F.collect_list(F.struct("plus", "minus")).alias("gaps"))  # some GROUP members at most
    return heads, bodies.select(F.col("leader").alias("cluster"), "gaps")


def answers(pairs: DataFrame, heads: DataFrame, bodies: DataFrame, share: int) -> DataFrame:
    """(u, v): those pairs of clusters of which a set of the one links to a set of the other."""
    sides = [heads.withColumnRenamed("cluster", "u"), heads.select(F.col("cluster").alias("v"), *[F.col(c).alias(f"{c}_b") for c in ("grams", "size", "low", "more")])]

    def leaders(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(judged(b, share))], ["u", "v", "state"])

    first = tables.written(pairs.join(sides[0], "u").join(sides[1], "v").mapInArrow(leaders, "u long, v long, state int").where("state <> 0"))
    full = heads.select("cluster", "grams").join(bodies, "cluster", "left")
    left, right = (full.select(F.col("cluster").alias(k), F.col("grams").alias(f"lead_{k}"), F.col("gaps").alias(f"gaps_{k}")) for k in ("u", "v"))

    def members(batches):
        for b in batches:
            out = []
            for k in range(b.num_rows):
                side = []
                for c in ("u", "v"):
                    gaps = b.column(f"gaps_{c}")[k]
                    empty = np.empty(0, np.int64)
                    own = {"lead": b.column(f"lead_{c}")[k].values.to_numpy(), "plus": [empty], "minus": [empty]}
                    for name in ("plus", "minus"):
                        own[name] += [g.values.to_numpy() for g in gaps.values.field(name)] if gaps.is_valid else []
                    side.append(own)
                out.append(members_link(*side, share))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(out, pa.bool_()))

    open_pairs = first.where("state = -1").select("u", "v")
    # a row with all members is large: few go into one task, and one Arrow batch
    wide = open_pairs.join(left, "u").join(right, "v")
    return first.where("state = 1").select("u", "v").unionByName(wide.mapInArrow(members, "u long, v long"))


def node_components(nodes: DataFrame, share: int) -> DataFrame:
    """(node, root) of every node that links join to another one. nodes: (node, n, grams), distinct sets, written."""
    found, edges = clusters(nodes, share)
    sizes = found.groupBy(F.col("leader").alias("cluster")).agg(F.count("*").alias("size"))
    heads, bodies = leader_rows(nodes, found)
    heads = tables.written(heads)
    own = postings(nodes, share).join(found.withColumnRenamed("leader", "cluster"), "node").groupBy("h", "cluster").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("left").alias("left"))
    own = tables.written(own)

    def placed(edges: DataFrame) -> DataFrame:
        """The entries with the components that are known so far."""
        known = sizes.join(components(edges).withColumnRenamed("node", "cluster"), "cluster", "left").select("cluster", "size", F.coalesce("root", "cluster").alias("comp"))
        return tables.written(own.join(known, "cluster"))

    edges = tables.written(edges)
    edges = tables.written(edges.unionByName(answers(pivots(placed(edges), share), heads, bodies, share)))
    return components(tables.written(edges.unionByName(answers(candidates(placed(edges), share), heads, bodies, share))))


def similar_documents(docs: DataFrame, share: int = SHARE, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id_col, n_shingles (size of its set) and component_id, the smallest id that links reach from it, itself included.

    A set holds the distinct shingles of `words` words of the whole text, A-Z lower-cased, words parted by the six ASCII white-space
    characters; a text of fewer words has one shingle, all its words. Two sets link when 100 * intersection >= share * union (share: 1 to 100).
    Null texts and texts without words have the empty set, which links with nothing, not even another of its kind. Shingles are compared by 64-bit hash. Rows with a null id
    are linked too and stay; a component without any id has null. Repeated ids stay, a row each. Other columns are left out; an empty table gives an empty one.
    """
    if not 1 <= share <= 100:
        raise ValueError("share has to be 1 to 100")
    sets = tables.written(sets_of(docs, id_col, text_col, words))
    keys = ["key_a", "key_b"]
    lows = sets.where("n > 0").groupBy(*keys).agg(F.min("id").alias("low"))
    some = without_loners(without_loners(sets, share, PART), share, 1)
    one = Window.partitionBy(*keys).orderBy(F.lit(0))
    nodes = some.select(*keys, "n", "grams").withColumn("_rn", F.row_number().over(one)).where("_rn = 1").drop("_rn")
    nodes = tables.written(nodes.withColumn("node", F.monotonically_increasing_id()))
    roots = node_components(nodes, share)
    named = lows.join(nodes.select(*keys, "node"), keys, "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = tables.written(named.select(*keys, "low", "root"))
    per_root = named.where("root IS NOT NULL").groupBy("root").agg(F.min("low").alias("component_id"))
    final = named.join(per_root, "root", "left").select(*keys, F.coalesce("component_id", "low").alias("component_id"))
    rows = sets.select("id", "n", *keys)
    linked_rows = rows.where("n > 0").join(final, keys).select("id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked_rows.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
