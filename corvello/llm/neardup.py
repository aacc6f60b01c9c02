"""Near-duplicate groups by an inverted join on MinHash signature coordinates.

Documents are sets of distinct five-word shingles; two are linked if the Jaccard similarity of their sets is at least
0.75.  Rows with equal sets are one class, known by the set's digest (summed before the shuffle, so a class of any size
is one row), and one row stands for it.  Each representative is posted under its COORDINATES coordinate-value pairs.
Two sets of the wanted similarity collide in at least MATCHES coordinates but for a chance of 6e-7 at 0.75 exactly
(1e-10 at 0.8), hence collisions are counted so:

* values that one representative has cannot collide, and one with fewer than MATCHES others is done;
* prefix: of the others it needs only its rarest ones, all but MATCHES - 1, so frequent passages are hardly posted.  What
  the lists of the prefix have begun to count is completed on the two signatures;
* skip: a list is first merged against one leader only, the member that shares most values with others, and a document
  goes on with the leader that it meets in most lists.  That connects most of a group of near copies, however large,
  with one pair for each.  Lists whose members are all connected by then are skipped, and so is in each other list
  whatever pair is connected already.  The lists that are left are merged by clusters, those of the same least component
  together; a cluster's members meet in blocks of bounded size, of which one holds documents outside the cluster's largest
  component, and collisions are counted for the pairs of two blocks.

Pairs with at least MATCHES collisions are confirmed on the full shingle sets: only the texts of documents with such a
pair are compared, and what leaves a pair of blocks is a spanning forest of its links, not all of them.  Leaders precede
their members in one order, so their links are trees, whose roots are found by pointer jumping; the links between trees go
through alternating large-star and small-star steps, with salted hubs.  Every round is a written table.

Defined results: null or empty texts and texts of white space have an empty set and are linked with nothing; a document's
component_id is the least doc_id of all rows that can be reached from its row, null if none of these has one, so rows
that repeat a doc_id are judged each by its own text, in whatever order they come; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvello.llm.common import HOT_SHARE, bounded, discard, hot_limit, materialise, with_text

SHINGLE = 5
#: Similarity as a fraction of integers, so that the test is exact: NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 75, 100
COORDINATES = 64
MATCHES = 30
#: Shingles of a block's sets together and members of it, on average at most.
BLOCK_SHINGLES, BLOCK_MEMBERS = 400_000, 512
#: Members that are held against one copy of a leader's text, at least, before its group is dealt to several tasks.
MEMBERS = 256
#: Shares that the rows of a hub are dealt to.
SALTS = 64

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hashes of the words that came before; bounded, so that a worker's memory is."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z lower-cased, words between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    each = np.array([hashes[w] for w in words], np.uint64)
    n = min(SHINGLE, len(each))
    total = np.full(len(each) - n + 1, n, np.uint64)
    for k in range(n):
        total = total * _MULTIPLIER + each[k : len(each) - n + 1 + k]
    return np.unique(_mixed(total))


@lru_cache(1)
def _factors() -> np.ndarray:
    return np.random.default_rng(COORDINATES).integers(1, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, (found[at : at + 1024, None] * _factors()).min(axis=0))
    return least


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            sizes, digests, signatures = [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), hashes)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signatures.append(signature(found).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.list_(pa.int64()))], ["node", "doc_id", "n_shingles", "digest", "signature"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if DENOMINATOR * len(small) < NUMERATOR * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _alike(a, b):
    """Whether two set sizes allow the similarity."""
    return DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)


def collisions(a: Column, b: Column) -> Column:
    """Coordinates in which two signatures have the same value."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, b, text) in order: a leader's own text (b is null), then its members' texts, one at a time."""
    hashes, leader, own = _WordHashes(), None, None
    for whole in batches:
        found = []
        for a, salt, b, text in zip(*whole.columns, strict=True):
            a, salt, b = a.as_py(), salt.as_py(), b.as_py()
            if b is None:
                leader, own = (a, salt), shingles(text.as_py(), hashes)
            elif (a, salt) == leader and similar(own, shingles(text.as_py(), hashes)):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets are similar; pairs are written.  texts: node, text."""
    limit = hot_limit(pairs, MEMBERS)
    # A leader of many is dealt to several tasks; there are few such leaders by the choice of the limit.
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("a", F.ceil(F.col("n") / limit).alias("parts"))
    dealt = pairs.join(bounded(hubs), "a", "left").select("a", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("b"), F.col("parts"))).otherwise(0).alias("salt"), "b")
    members = dealt.join(texts.hint("merge"), F.col("b") == F.col("node")).select("a", "salt", "b", "text")
    leaders = dealt.select("a", "salt").distinct().join(texts.hint("merge"), F.col("a") == F.col("node")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    both = members.unionByName(leaders).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return both.mapInArrow(_confirm, "a long, b long")


def _by_blocks(work, names: list[str]):
    """A mapInArrow function: rows (cluster, i, j, ...), in order of these three, as lists of the rows of each (i, j) to ``work``.

    The last column is given to ``work`` one by one as the rows come, as (number, value), so it need not be held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, hashes = None, [], _WordHashes()

        def packed() -> Iterator[pa.RecordBatch]:
            if rows and (out := work(key, rows)):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(len(names))], names)

        for batch in batches:
            for *head, last in zip(*batch.columns, strict=True):
                head = [x.as_py() for x in head]
                if tuple(head[:3]) != key:
                    yield from packed()
                    key, rows = tuple(head[:3]), []
                value = np.array(last.as_py(), np.int64) if pa.types.is_list(last.type) else shingles(last.as_py(), hashes)
                rows.append((*head[3:], value))
        yield from packed()

    return run


def _sides(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows (node, component, block, ...) in the first and in the second block; the same if there is one."""
    block = np.array([r[2] for r in rows])
    return np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())


def _retained(key: tuple, rows: list[tuple]) -> list[tuple]:
    """Rows (cluster, i, j, node, component, block) of documents that have at least MATCHES collisions with one of another component."""
    component, size = (np.array([r[k] for r in rows]) for k in (1, 3))
    if (component == component[0]).all():
        return []
    signatures = np.array([r[4] for r in rows])
    first, second = _sides(rows)
    kept, there = np.zeros(len(rows), bool), signatures[second]
    for x in first:
        near = (there == signatures[x]).sum(axis=1) >= MATCHES
        near &= (component[second] != component[x]) & (DENOMINATOR * np.minimum(size[second], size[x]) >= NUMERATOR * np.maximum(size[second], size[x]))
        kept[x] |= near.any()
        kept[second[near]] = True
    return [(*key, *rows[k][:3]) for k in np.flatnonzero(kept)]


def _forest(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
    """Links between components of two blocks' documents (node, component, block, set) that join all that are linked.

    A set's intersections with all sets of the other block come from one merge with the inverted index of that block.
    """
    component, sets = np.array([r[1] for r in rows]), [r[3] for r in rows]
    size = np.array([len(s) for s in sets])
    first, second = _sides(rows)
    held, of = np.concatenate([sets[k] for k in second]), np.repeat(second, size[second])
    order = np.argsort(held, kind="stable")
    held, of = held[order], of[order]
    out = []
    for x in first:
        both = np.zeros(len(rows), np.int64)
        for at in range(0, size[x], 2048):
            some = sets[x][at : at + 2048]
            low, high = np.searchsorted(held, some, "left"), np.searchsorted(held, some, "right")
            n = high - low
            both += np.bincount(of[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(rows))
        for y in np.flatnonzero((DENOMINATOR * both >= NUMERATOR * (size + size[x] - both)) & (component != component[x]) & (both > 0)):
            if component[y] != component[x]:
                component[component == component[y]] = component[x]
                out.append((rows[x][0], rows[y][0]))
    return out


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of all ends of the written edges (a, b), the component being its least node; one row for each node but the least.

    Alternating large-star and small-star steps.  Each round is written, so no lineage grows; the driver sees sums only.
    """

    def with_least(pairs: DataFrame, limit: int) -> DataFrame:
        """Pairs (u, v) with m, the least v of their u; the rows of a u of more than ``limit`` are dealt to SALTS tasks."""
        least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        if 2 * n <= limit:  # no u can have more
            return pairs.join(least.select("u", "m").hint("merge"), "u")
        hubs = bounded(least.where(F.col("n") > limit).select("u", F.lit(True).alias("hub")))
        salted = pairs.join(hubs, "u", "left").select("u", "v", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
        every = F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return salted.join(least.select("u", "m", F.explode(every).alias("salt")).hint("merge"), ["u", "salt"])

    n = edges.count()
    if not n:
        return materialise(edges.toDF("node", "component"), name, 1)
    stars, before = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name, n), None
    while True:
        limit = 2 * max(1000, -(-n // HOT_SHARE))
        both = stars.union(stars.select("v", "u").toDF("u", "v"))
        large = with_least(both, limit).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v").distinct()
        joined = with_least(large, limit)
        after = materialise(joined.select("u", F.col("m").alias("v")).union(joined.where("v > m").select("v", "m")).distinct(), name, 2 * n)
        sums = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(stars)
        stars = after
        if sums == before or not sums[0]:
            return stars.toDF("node", "component")
        before, n = sums, sums[0]


#: Postings of a representative at most.
PREFIX = COORDINATES - MATCHES + 1


def roots(links: DataFrame, n: int) -> DataFrame:
    """(node, component) of the b of n links (a, b), of which each b has one and no chain returns: the end of its chain."""
    found = materialise(links.select(F.col("b").alias("node"), F.col("a").alias("component")), "roots", n, 16)
    while True:
        above = found.select(F.col("node").alias("component"), F.col("component").alias("next")).hint("merge")
        after = materialise(found.join(above, "component", "left").select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved")), "roots", n)
        discard(found)
        found = after.select("node", "component")
        found.corvello_path = after.corvello_path
        if not after.where("moved").limit(1).count():
            return found


def _posts(signatures: DataFrame, n: int) -> DataFrame:
    """(node, size, weight, token): the coordinate-value pairs of the prefix of each of n representatives.  Written."""
    posted = signatures.select("node", "n_shingles", F.posexplode("signature")).select("node", "n_shingles", F.xxhash64("pos", "col").alias("token"))
    counted = materialise(posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "values", COORDINATES * n // 2, 16)
    shared = posted.join(counted.hint("merge"), "token").groupBy("node").agg(F.max("n_shingles").alias("size"), F.sum(F.log("n")).alias("weight"), F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))  # 64 at most
    rarest = shared.where(F.size("shared") >= MATCHES).select("node", "size", "weight", F.explode(F.slice("shared", F.lit(1), F.size("shared") - MATCHES + 1)).alias("post"))
    posts = materialise(rarest.select("node", "size", "weight", F.col("post.token").alias("token")), "posts", PREFIX * n)
    discard(counted)
    return posts


def _led(posts: DataFrame, signatures: DataFrame, n: int) -> DataFrame:
    """(a, b): each representative b with the leader a that it meets in most lists, if they have MATCHES collisions.  Written."""
    leaders = materialise(posts.groupBy("token").agg(F.max(F.struct("weight", "node")).alias("leader")), "leaders", PREFIX * n // 2)
    met = posts.join(leaders.hint("merge"), "token").select(F.col("node").alias("b"), F.col("leader.node").alias("a")).where("a <> b")
    best = met.groupBy("b", "a").agg(F.count(F.lit(1)).alias("lists")).groupBy("b").agg(F.max_by("a", F.struct("lists", "a")).alias("a"))
    side = lambda n: signatures.select(F.col("node").alias(n), F.col("n_shingles").alias(f"{n}_size"), F.col("signature").alias(f"{n}_signature")).hint("merge")
    both = best.join(side("b"), "b").join(side("a"), "a")
    pairs = materialise(both.where(_alike(F.col("a_size"), F.col("b_size")) & (collisions(F.col("a_signature"), F.col("b_signature")) >= MATCHES)).select("a", "b"), "pairs", n, 16 * COORDINATES)  # the tasks that write these read two signatures for each
    discard(leaders)
    return pairs


def _clusters(posts: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """(node, size, component, cluster) of the members of lists that two components share; a list's cluster is its least component.  Written."""
    labelled = materialise(posts.select("node", "size", "token").join(found.hint("merge"), "node", "left").select("node", "size", "token", F.coalesce("component", "node").alias("component")), "lists", PREFIX * n)
    shared = materialise(labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token", "low"), "open-lists", PREFIX * n // 2, 16)
    out = labelled.join(shared.hint("merge"), "token").select("node", "size", "component", F.col("low").alias("cluster")).distinct()
    out = materialise(out, "clusters", PREFIX * n)
    discard(labelled, shared)
    return out


def _across(clusters: DataFrame, signatures: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Links (a, b) between components of one cluster, enough to join all that are linked."""
    if not clusters.limit(1).count():
        return clusters.select(F.col("node").alias("a"), F.col("node").alias("b"))
    weight = F.greatest("size", F.lit(BLOCK_SHINGLES // BLOCK_MEMBERS))
    blocks = lambda w: F.ceil(w / BLOCK_SHINGLES).cast("int")
    sizes = clusters.groupBy("cluster", "component").agg(F.sum(weight).alias("w"))
    sizes = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("w", "component")).alias("largest"), F.max("w").alias("in"), F.sum("w").alias("w"))
    sizes = materialise(sizes.select("cluster", "largest", blocks(F.col("w") - F.col("in")).alias("outer"), blocks(F.col("in")).alias("inner")), "sizes", PREFIX * n)
    outside, hashed = F.col("component") != F.col("largest"), F.xxhash64("node")
    block = F.when(outside, F.pmod(hashed, F.col("outer"))).otherwise(F.col("outer") + F.pmod(hashed, F.col("inner"))).cast("int")
    last = F.when(outside, F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1)
    placed = clusters.join(sizes.hint("merge"), "cluster").withColumn("block", block).withColumn("last", last)
    # Blocks 0 to outer - 1 are those outside the largest component; each of them meets all blocks, itself included.
    dealt = placed.join(signatures.select("node", "signature").hint("merge"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select("cluster", F.least("block", "other").cast("long").alias("i"), F.greatest("block", "other").cast("long").alias("j"), "node", "component", F.col("block").cast("long"), "size", "signature")
    key = ["cluster", "i", "j"]
    in_blocks = lambda rows: rows.repartition(*key).sortWithinPartitions(*key)
    names = [*key, "node", "component", "block"]
    kept = materialise(in_blocks(dealt).mapInArrow(_by_blocks(_retained, names), ", ".join(f"{n} long" for n in names)), "retained")
    links = in_blocks(kept.join(texts.hint("merge"), "node").select(*names, "text")).mapInArrow(_by_blocks(_forest, ["a", "b"]), "a long, b long")
    links = materialise(links, "links")
    discard(sizes, kept)
    return links


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What rows (node, doc_id, text; node is unique; a written table) have: (node, doc_id, n_shingles, digest) of each row, and
    (digest, component_id) of each distinct set.  Written."""
    base = materialise(with_text(rows, ["node", "doc_id"])[0].mapInArrow(_sketch, "node long, doc_id long, n_shingles long, digest binary, signature array<long>"), "sketch")
    sets = materialise(base.where("digest IS NOT NULL").groupBy("digest").agg(F.min("node").alias("node"), F.min("doc_id").alias("least")), "sets", base.count())
    n = sets.count()
    signatures = materialise(base.select("node", "n_shingles", "signature").join(sets.select("node").hint("merge"), "node", "left_semi"), "signatures", n, 8 * COORDINATES)
    posts = _posts(signatures, n)
    texts = materialise(rows.select("node", "text").join(posts.select("node").distinct().hint("merge"), "node", "left_semi"), "texts")

    pairs = _led(posts, signatures, n)
    links = materialise(confirmed(pairs, texts), "links")
    found = roots(links, n)
    clusters = _clusters(posts, found, n)
    more = _across(clusters, signatures, texts, n)
    named = more.join(found.toDF("a", "ca").hint("merge"), "a", "left").join(found.toDF("b", "cb").hint("merge"), "b", "left")
    named = materialise(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct(), "between", more.count() + 2 * n, 16)
    upper = components(named)
    discard(named)

    linked = sets.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")).join(upper.toDF("component", "to").hint("merge"), "component", "left")
    linked = materialise(linked.select("digest", "least", F.coalesce("to", "component").alias("component")), "linked", n, 64)
    least = materialise(linked.groupBy("component").agg(F.min("least").alias("component_id")), "least", n, 16)
    named = materialise(linked.join(least.hint("merge"), "component").select("digest", "component_id"), "component-ids", n, 64)
    discard(sets, signatures, posts, texts, pairs, links, found, clusters, more, upper, linked, least)
    slim = materialise(base.drop("signature"), "classes")
    discard(base)
    return slim, named


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "rows")
    base, named = classes(rows)
    discard(rows)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = base.join(named.hint("merge"), "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
