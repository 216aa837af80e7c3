"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's set is its distinct 2-word shingles; fewer words make one shingle;
no words make an empty set, linked with nothing. Two documents are linked if the
Jaccard similarity of their sets is at least ``PERCENT`` hundredths. Groups are the
connected components of the links.

1. Each document gets a signature of ``COORDINATES`` minima. Equal sets form one class, which
   goes on with one representative. Under four shingles only equal sets can be linked.
2. Classes are posted under the (coordinate, value) pairs of the first ``POSTED`` coordinates. A pair of classes must
   agree in ``AGREE`` of them, so a class leaves out its ``AGREE - 1`` commonest ones (prefix filter): any two
   that agree often enough still meet under a rarer one. Values of one class only are never posted. Lists are kept by
   size band as well, a class standing in its own band's and in the next one's, as sizes of linked sets are close.
   A pair of similarity 0.8 agrees in fewer than 9 of 24 coordinates with a probability of about 1e-6.
3. Each posting list goes to its hub, the member whose coordinates are the commonest overall (the
   original among edited copies), so the many lists of one group of copies become one group. Groups are dealt in
   chunks of at most about ``CHUNK`` members. Each member is held against its chunk and the hub: collisions are counted over the
   whole signature, one byte a coordinate (which can only add collisions). Members without a partner there that agrees in ``MATCHES``
   coordinates and has a compatible size meet the group's other chunks; those without any partner
   drop out. (At similarity 0.8 fewer than 35 of 64 agree with probability under 1e-6.)
4. Only now are the full sets of what is left fetched. Inside a chunk, which also holds its group's hub, pairs above
   the threshold that are not connected yet are confirmed on the full sets; connected ones are skipped.
   What comes out is a star for each part of a chunk that hangs together, never a row for every pair. In groups of several chunks the
   members outside the group's largest component are then compared with all of its chunks, block by
   block; nothing is left out.
5. Components are found by alternating large-star and small-star steps on the executors.

Keys with many rows (a set that a third of the documents share, a common coordinate value, the centre of a star)
never meet in one task: their side of a join is broadcast, at most ``HEAVY_KEYS`` of them.

Defined results
  * null or empty text: n_shingles 0, its own component, kept;
  * null doc_id: component_id null, kept, linked with nothing (it can't be named);
  * rows with one doc_id are one document: it holds the classes of all its rows together, and all its rows, those without words
    too, get one component and one verdict; each row reports its own set's size;
  * ties: equal scores of a hub go to the larger node, which changes no result;
  * very long texts are treated whole; a worker holds one such text's words and set at a time, and one chunk's sets;
  * an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pigmenta.llm.common import checkpointed, hash_words, heavy_from, mixed, small_side, spread_join

PERCENT = 80
COORDINATES, MATCHES = 64, 35
POSTED, AGREE = 24, 9
#: Most members, and about the most shingles, to a chunk, which bounds what a worker holds.
CHUNK = 1024
MOST = 1 << 22
#: Ratio of sizes in one band; over 100 / PERCENT, so that linked sets are at most one band apart.
BAND = 1.26
#: Shingles to a step of the minima, which bounds a worker's memory on very long texts.
STEP = 1 << 16

_MULTIPLY = np.random.default_rng(24).integers(1, 1 << 63, COORDINATES, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes of a document's set."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hash_words(words)
    return np.unique(mixed(h[:-1], h[1:])) if len(h) > 1 else h ^ np.uint64(0x5851F42D4C957F2D)


def signature(own: np.ndarray) -> np.ndarray:
    """Minimum of each coordinate's hash over the set."""
    x = own ^ (own >> np.uint64(32))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), STEP):
        out = np.minimum(out, ((x[a : a + STEP, None] * _MULTIPLY) >> np.uint64(32)).astype(np.uint32).min(0))
    return out


SIGNED = "doc_id long, n long, h1 long, h2 long, sig array<int>, bytes binary"


def _prints(own: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(own.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The posted coordinates as an array, and the last byte of all of them."""
    for b in it:
        n, h1, h2, sig = [], [], [], []
        for value in b.column(1):
            own = shingles(words_of(value.as_py()))
            p = _prints(own)
            n.append(len(own))
            h1.append(p[0])
            h2.append(p[1])
            sig.append(signature(own))
        posted = np.concatenate([x[:POSTED] for x in sig]).view(np.int32) if sig else []
        posted = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * POSTED, pa.int32()), pa.array(posted, pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), posted, pa.array([x.astype(np.uint8).tobytes() for x in sig], pa.binary())], ["doc_id", "n", "h1", "h2", "sig", "bytes"])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The print of each document's set, and its words, compressed: a third of the size of the set's hashes."""
    pack = zstandard.ZstdCompressor(level=3)
    for b in it:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            words = [words_of(v.as_py()) for v in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_prints(shingles(x))[0] for x in words], pa.int64()), pa.array([pack.compress(b" ".join(x)) for x in words], pa.binary())], ["node", "h1", "own"])


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets are similar enough."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def close_pairs(sigs: np.ndarray, size: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs between members marked in ``first`` and in ``second`` that agree often enough and have compatible sizes, with their collisions."""
    rows, cols = np.flatnonzero(first), np.flatnonzero(second)
    if len(rows) * len(cols) <= 2048:
        hits = (sigs[rows][:, None, :] == sigs[cols][None, :, :]).sum(2)
    else:
        hits = np.zeros((len(rows), len(cols)), np.uint8)
        for c in range(COORDINATES):
            hits += sigs[rows, c][:, None] == sigs[cols, c][None, :]
    x, y = np.nonzero(hits >= MATCHES)
    n = hits[x, y].astype(np.int64)
    x, y = rows[x], cols[y]
    fit = (np.minimum(size[x], size[y]) * 100 >= np.maximum(size[x], size[y]) * PERCENT) & ((x < y) | ((x > y) & ~(first[y] & second[x])))
    return x[fit], y[fit], n[fit]  # a pair that is there both ways comes once


def link_block(nodes: list[int], comps: list[int], first: np.ndarray, second: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect different components, between members marked in ``first`` and in ``second``.

    What was connected comes out as stars: each member's link to the first of those it is connected with.
    """
    place: dict[int, int] = {}
    forest = Forest(len(nodes))
    for i, c in enumerate(comps):
        forest.join(place.setdefault(c, i), i)
    a, b, hits = close_pairs(np.stack([signature(x) for x in sets]), np.array([len(x) for x in sets]), first, second)
    order = np.argsort(-hits, kind="stable")
    a, b = a[order], b[order]
    met, step = set(), 256
    while len(a):
        for i, j in zip(a[:step].tolist(), b[:step].tolist(), strict=True):
            if forest.find(i) != forest.find(j) and linked(sets[i], sets[j]):
                forest.join(i, j)
                met |= {i, j}
        a, b, step = a[step:], b[step:], step * 2
        root = forest.roots()
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    heads: dict[int, int] = {}
    stars = [(i, heads.setdefault(forest.find(i), i)) for i in sorted(met)]
    return [(nodes[i], nodes[j]) for i, j in stars if i != j]


GROUP = ["hub", "hub_h1"]
PLACED = [*GROUP, "chunk", "other", "side", "node", "h1"]
LINKS = "a long, b long"
MEMBERS = "hub long, hub_h1 long, node long, h1 long, n long"


def _blocks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[tuple[int, int], list]]]:
    """Blocks of a partition sorted by (hub, chunk, other): key, and for each member (node, h1) its side, its component or size, and its data.

    side: 1 first, 2 second, 3 both.
    """
    now, held = None, {}
    for b in it:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[:4] != now:
                if len(held) > 1:
                    yield now, held
                now, held = r[:4], {}
            held.setdefault((r[5], r[6]), [0, r[7], r[8]])[0] |= r[4]
    if len(held) > 1:
        yield now, held


def _with_partner(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each block that have a close partner there."""
    out: list[tuple] = []
    for key, by in _blocks(it):
        side = np.array([x[0] for x in by.values()])
        sigs = np.frombuffer(b"".join(x[2] for x in by.values()), np.uint8).reshape(-1, COORDINATES)
        a, b, _ = close_pairs(sigs, np.array([x[1] for x in by.values()]), (side & 1) > 0, (side & 2) > 0)
        names = list(by)
        out += [(*key[:2], *names[i], by[names[i]][1]) for i in np.unique(np.concatenate((a, b))).tolist()]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(5)], [x.split(" ")[0] for x in MEMBERS.split(", ")])


def _link_blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    unpack = zstandard.ZstdDecompressor()
    for _, by in _blocks(it):
        side = np.array([x[0] for x in by.values()])
        out += link_block([k[0] for k in by], [x[1] for x in by.values()], (side & 1) > 0, (side & 2) > 0, [shingles(unpack.decompress(x[2]).split()) for x in by.values()])
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def _rows(df: DataFrame, names: tuple[str, str], *pairs: tuple) -> DataFrame:
    """A row (columns ``names``) for each of ``pairs`` of columns or numbers, from every row of ``df``; they are read once."""
    value = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    return df.select(F.explode(F.array(*(F.struct(*(value(x).alias(n) for x, n in zip(p, names, strict=True))) for p in pairs))).alias("e")).select("e.*")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``links`` (a, b); comp is the smallest node reachable."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        edges = checkpointed(edges)
        # Done when each node either only has others above it or has one edge, which leads to such a node.
        ends = _rows(edges, ("node", "up"), ("u", 1), ("v", 0)).groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        n, unsettled = ends.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("least") == 0)))).first()
        if not unsettled:
            return _rows(edges, ("node", "comp"), ("u", "v"), ("v", "v")).distinct()
        gc.collect()  # plans of the rounds before live on the driver as long as Python holds them
        heavy = heavy_from(2 * n)
        both = _rows(edges, ("u", "v"), ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k"))
        large = checkpointed(spread_join(both, least, ["u"], "k", heavy).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        edges = _rows(spread_join(large, least, ["u"], "k", heavy), ("u", "v"), ("u", "m"), ("v", "m")).where("u <> v").distinct()


def _members(classes: DataFrame) -> DataFrame:
    """Groups of classes that may be linked (see ``MEMBERS``), the hub itself among them."""
    heavy = heavy_from(classes.count() * POSTED)
    coords = classes.select("node", "h1", "n", F.posexplode("sig").alias("c", "v"))
    common = coords.groupBy("c", "v").agg(F.count("*").alias("df")).where("df > 1")
    ranked = spread_join(coords, common, ["c", "v"], "df", heavy).groupBy("node", "h1", "n").agg(F.array_sort(F.collect_list(F.struct("df", "c", "v"))).alias("s"), F.sum("df").alias("score"))
    rare = F.transform(F.slice("s", F.lit(1), F.size("s") - (AGREE - 1)), lambda x: F.struct(x["c"].alias("c"), x["v"].alias("v")))
    ranked = checkpointed(ranked.where(F.size("s") >= AGREE).select("node", "h1", "n", "score", rare.alias("p")))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int")
    posts = ranked.select("node", "h1", "n", "score", F.explode("p").alias("p")).select("node", "h1", "n", "score", "p.c", "p.v", F.explode(F.array(band, band + 1)).alias("band"))
    lists = posts.groupBy("c", "v", "band").agg(F.max(F.struct("score", "node", "h1")).alias("hub"), F.count("*").alias("k")).where("k > 1")
    met = spread_join(posts.drop("score"), lists, ["c", "v", "band"], "k", heavy)
    return met.select(F.col("hub.node").alias("hub"), F.col("hub.h1").alias("hub_h1"), "node", "h1", "n").distinct()


def _chunk_of(n: str) -> F.Column:
    return F.pmod(F.xxhash64("node", "h1"), F.col(n)).cast("int")


def _chunked(members: DataFrame) -> DataFrame:
    """``members`` with their group's number of chunks and their own chunk. Only groups of several chunks are broadcast: at most one row for each ``CHUNK`` members or ``MOST`` shingles."""
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / MOST)).cast("int")
    sized = small_side(checkpointed(members.groupBy(*GROUP).agg(chunks.alias("chunks")).where("chunks > 1")))
    return members.join(sized, GROUP, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).select(*GROUP, "chunks", _chunk_of("chunks").alias("chunk"), "node", "h1", "n")


def _with_heads(own: DataFrame) -> DataFrame:
    """Chunks of ``_chunked`` members, each with its group's hub, as blocks in which all meet all."""
    heads = own.where("hub = node and hub_h1 = h1").select(*GROUP, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", "h1")
    return own.select(*heads.columns).union(heads).distinct().select(*GROUP, "chunk", F.lit(0).alias("other"), F.lit(3).alias("side"), "node", "h1")


def _dealt(blocks: DataFrame, data: DataFrame, worker, schema: str) -> DataFrame:
    """Run ``worker`` on blocks (columns as in ``PLACED``, and perhaps one more) after joining ``data`` (node, h1 and one more, or two) to their members."""
    more = [c for c in (*blocks.columns, *data.columns) if c not in PLACED]
    full = data.join(small_side(checkpointed(blocks)), ["node", "h1"]).select(*PLACED, *more)
    place = PLACED[:4]
    return full.repartition(*(F.col(c) for c in place)).sortWithinPartitions(*place, "node", "h1").mapInArrow(worker, schema)


def _against(wide: DataFrame, apart: DataFrame, *more: str) -> DataFrame:
    """Blocks in which the members ``apart`` of groups of several chunks meet all members of their groups, chunk by chunk."""
    sized = small_side(checkpointed(apart.groupBy(*GROUP).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("others"))))
    second = wide.join(sized, GROUP).select(*GROUP, "chunk", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), F.lit(2).alias("side"), "node", "h1", *more)
    first = apart.join(sized, GROUP).select(*GROUP, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), _chunk_of("others").alias("other"), F.lit(1).alias("side"), "node", "h1", *more)
    return second.union(first)


def _close_members(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``members`` without those that have no close partner in their group.

    Each is held against its own chunk and the hub; only those without a partner there meet the other chunks.
    """
    own, data = checkpointed(_chunked(members)), classes.select("node", "h1", "n", "bytes")
    near = checkpointed(_dealt(_with_heads(own), data, _with_partner, MEMBERS).distinct())
    wide = own.where("chunks > 1")
    lonely = checkpointed(wide.join(near, [*GROUP, "node", "h1"], "left_anti"))
    if lonely.limit(1).count():
        near = near.union(_dealt(_against(wide, lonely), data, _with_partner, MEMBERS)).distinct()
    return near


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (it is that one)."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = checkpointed(docs.mapInArrow(_sign, SIGNED))
    rows = signed.select("doc_id", "n", "h1", "h2")
    named, print_ = rows.where("n > 0 and doc_id is not null"), ["h1", "h2", "n"]
    sets = signed.where("n > 0 and doc_id is not null").groupBy(*print_)
    classes = checkpointed(sets.agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first(F.struct("sig", "bytes")).alias("s")).select(*print_, "node", "copies", "s.sig", "s.bytes"))
    heavy = heavy_from(signed.count())

    least = next(n for n in range(1, 101) if 100 * n >= PERCENT * (n + 1))
    large = classes.where(F.col("n") >= least)
    members = checkpointed(_close_members(checkpointed(_members(large)), large))
    wanted = checkpointed(members.select("node").distinct())
    near = docs.join(small_side(wanted), docs["doc_id"] == wanted["node"], "left_semi")
    sets = near.mapInArrow(_sets, "node long, h1 long, own binary")

    again = checkpointed(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k"), (F.min("h1") != F.max("h1")).alias("differ")).where("k > 1"))
    repeated = again.limit(1).count() > 0
    if repeated:
        sets = sets.dropDuplicates(["node", "h1"])
    own = checkpointed(_chunked(members))
    links = _dealt(_with_heads(own).withColumn("comp", F.col("node")), sets, _link_blocks, LINKS)
    if repeated:  # a document of several sets holds their classes together
        several = named.join(small_side(again.where("differ").select("doc_id")), "doc_id", "left_semi").distinct()
        links = links.union(spread_join(several, classes.select(*print_, "node", "copies"), print_, "copies", heavy).select("doc_id", "node"))
    comps = checkpointed(components(checkpointed(links)))
    wide = own.where("chunks > 1")
    if wide.limit(1).count():
        comps = _merge(comps, checkpointed(_dealt(_rest(wide, comps), sets, _link_blocks, LINKS)))

    component = lambda at: F.coalesce("comp", at).alias("component_id")
    placed = checkpointed(classes.select(*print_, "node", "copies").join(comps, "node", "left").select(*print_, "copies", component("node")))
    out = spread_join(named, placed, print_, "copies", heavy).select("doc_id", "n", "component_id")
    empty = rows.where("n = 0 and doc_id is not null").select("doc_id", "n").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", component("doc_id"))
    out = out.union(empty).union(rows.where("doc_id is null").select("doc_id", "n", F.lit(None).cast("long")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _rest(wide: DataFrame, comps: DataFrame) -> DataFrame:
    """Blocks for what the chunks of a group left apart: members outside its largest component against all its members."""
    own = checkpointed(wide.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    most = own.groupBy(*GROUP, "comp").agg(F.count("*").alias("k")).groupBy(*GROUP).agg(F.max(F.struct("k", "comp"))["comp"].alias("main"))
    apart = own.join(small_side(checkpointed(most)), GROUP).where("comp <> main").select(*own.columns)
    return _against(own, checkpointed(apart), "comp")


def _merge(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links between their nodes."""
    named = links
    for c in ("a", "b"):
        named = named.join(comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}c")), c, "left").withColumn(c, F.coalesce(f"{c}c", c)).drop(f"{c}c")
    above = components(named).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    old = comps.join(above, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    fresh = above.join(comps.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("top").alias("comp"))
    return checkpointed(old.union(fresh))
