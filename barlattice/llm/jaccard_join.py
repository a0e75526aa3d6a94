"""Jaccard join of shingle sets, heavy and light by size; exact.

Identical sets are one class (a 128-bit digest of the set), so copies never meet in pairs.

* Light sets (at most `boundary` shingles): sizes n <= m link if they share ceil(3 (n + m) / 7) shingles (at similarity
  3/4). For every partner size a set emits its subsets of exactly that size. Two sets of a (n, m) group with one subset
  in common are linked if one of them has size n, so each group is a star around its smallest such member.
* Heavy sets: inverted lists. In an order of shingles, two linked sets of sizes n and m share one of their first
  n - ceil(3 n / 4) + 1 shingles, so only those enter the lists. The order is by estimated frequency (a small merged
  sketch), rare first: the lists scanned are short, and very common passages stay out of them.
* The boundary is the largest size for which the subsets of a set cost less than scanning its lists.

Scanning a list goes in rounds, and links are merged into components after each: every class is compared with one
other, the smallest center of its lists; then light sets with the centers of all their subset keys that lie in other
components; then, a few times, with centers of each list, more in every round, that aren't in its component yet;
then members of different components, where they can still be linked. Groups of thousands of near copies so cost a
few comparisons a member, and no link between components is lost. Lists whose members are all in one component, or
were all centers, are left out from then on.

No list is joined with itself as a whole. The first shingle that two linked sets share stands so early in both that what
follows is long enough for the intersection they need, so an entry at place i of a set of n bounds its partners' size
(`largest_partner`). Sizes are cut into narrow bands; an entry goes to the bands from its own size up to that bound
(mostly none or one: later entries only wait for smaller sets) and meets the entries of sets in that band. A common
passage, which stands behind a set's own shingles, therefore makes no pairs, however many sets hold it.
Candidate pairs first compare small profiles (a lower bound of how far their sets are apart); those that pass are checked
on the full sets. All rounds are stored tables, dropped when nothing reads them any more.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.llm.common import pruned_joins, staged, table
from barlattice.llm.components import components
from barlattice.llm.sketch import few_tasks
from barlattice.llm.textbytes import Words, mixed, pieces, signed
from barlattice.session import drop_staged

SHINGLE = 5
PER_CENT = 75
LARGEST_BOUNDARY = 14
ORDER_CELLS = 1 << 21
LIST_SCAN = 20.0  # cost of one place in a scanned list, in subset keys
PROFILE = 128
CENTERS = (1, 16, 256)  # of a list, by round; only save comparisons: the last round is exact after any number
_BLOCK = 1 << 17
_NO_ID = -(1 << 63)  # a null id is below all others


def needed(n: int, m: int, per_cent: int = PER_CENT) -> int:
    """Smallest intersection of linked sets of sizes n and m."""
    return -(-per_cent * (n + m) // (100 + per_cent))


def partner_sizes(n: int, per_cent: int = PER_CENT) -> range:
    return range(max(1, -(-per_cent * n // 100)), 100 * n // per_cent + 1)


def prefix_length(n: int, per_cent: int = PER_CENT) -> int:
    return n - -(-per_cent * n // 100) + 1


def largest_partner(per_cent: int = PER_CENT) -> str:
    """SQL over n and place: the largest m with needed(n, m) <= n - place, for a first shared shingle at `place` from 0."""
    return f"cast(least((n - place) * {100 + per_cent} div {per_cent} - n, 100 * n div {per_cent}) as int)"


def band(n: str) -> str:
    """Sizes of one band are within some 8 % of each other."""
    return f"cast(floor(12 * ln({n})) as int)"


def subset_cost(n: int, most: int, per_cent: int = PER_CENT) -> int:
    return sum(math.comb(n, needed(n, m, per_cent)) for m in partner_sizes(n, per_cent) if m <= most)


def choose_boundary(sizes: dict[int, int], per_cent: int = PER_CENT) -> int:
    """The boundary whose total cost is least: subset keys below it, list entries and their scans above it."""
    def total(x: int) -> float:
        light = sum(rows * subset_cost(n, x, per_cent) for n, rows in sizes.items() if n <= x)
        scanned = sum(rows * prefix_length(n, per_cent) for n, rows in sizes.items() if 100 * n >= per_cent * (x + 1))
        return light + LIST_SCAN * scanned

    return min(range(LARGEST_BOUNDARY + 1), key=lambda x: (total(x), x))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a text of fewer words is one shingle; no words: empty."""
    words = Words(texts, lower=True)
    starts, grams = words.grams(shingle)
    at = np.searchsorted(starts, words.first)
    out = []
    for k, n in enumerate(words.counts):
        if n >= shingle:
            out.append(np.unique(grams[at[k] : at[k + 1]]))
        elif n:
            low, high = words.first[k : k + 1], words.first[k + 1 : k + 2]
            out.append(words.spans(low, high))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _profile(s: np.ndarray) -> bytes:
    """How many shingles fall in each of PROFILE cells, up to 255: what two profiles differ by, their sets do at least."""
    cells = np.bincount((s >> np.uint64(40) & np.uint64(PROFILE - 1)).astype(np.int64), minlength=PROFILE)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def _digest(s: np.ndarray) -> tuple[int, int]:
    a, b = mixed(s + np.uint64(0x243F6A8885A308D3)), mixed(s ^ np.uint64(0x13198A2E03707344))
    return int(signed(a.sum(dtype=np.uint64, keepdims=True))[0]), int(signed(b.sum(dtype=np.uint64, keepdims=True))[0])


_SIGNED = "doc_id long, n long, d1 long, d2 long, profile binary, block int, counters binary"

_NAMES = ["doc_id", "n", "d1", "d2", "profile", "block", "counters"]


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows of documents (doc_id, n, d1, d2, profile) and, at the end of each partition, rows of its sketch (block, counters)."""

    def sign(batches):
        counts = np.zeros(ORDER_CELLS, np.uint32)
        for batch in pieces(batches):
            sets = shingle_sets(batch.column("text"), shingle)
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            counts += np.bincount((every & np.uint64(ORDER_CELLS - 1)).astype(np.int64), minlength=ORDER_CELLS).astype(np.uint32)
            digests = [_digest(s) for s in sets]
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()),
                pa.array([d[1] for d in digests], pa.int64()), pa.array([_profile(s) for s in sets], pa.binary()),
                none.cast(pa.int32()), none.cast(pa.binary())], names=_NAMES)
        filled = [k for k in range(ORDER_CELLS // _BLOCK) if counts[k * _BLOCK : (k + 1) * _BLOCK].any()]
        none = pa.nulls(len(filled), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.nulls(len(filled), pa.binary()), pa.array(filled, pa.int32()), pa.array([counts[k * _BLOCK : (k + 1) * _BLOCK].tobytes() for k in filled], pa.binary())],
            names=_NAMES)

    return staged(few_tasks(docs).mapInArrow(sign, _SIGNED), "jaccard-signatures")


def _frequency(signatures: DataFrame) -> np.ndarray:
    """The merged sketch: ORDER_CELLS counters, whatever the input's size."""

    def add(blocks: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK, np.uint64)
        for part in blocks["counters"]:
            total += np.frombuffer(part.as_buffer(), np.uint32)
        top = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"block": blocks["block"].slice(0, 1), "counters": pa.array([top.tobytes()], pa.binary())})

    out = np.zeros(ORDER_CELLS, np.uint32)
    rows = signatures.filter("block IS NOT NULL").select("block", "counters")
    for row in rows.groupBy("block").applyInArrow(add, "block int, counters binary").toLocalIterator():
        out[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(bytes(row["counters"]), np.uint32)
    return out


def _postings(docs: DataFrame, frequency: np.ndarray, boundary: int, shingle: int, per_cent: int) -> DataFrame:
    """key, d1, n, role, place: list entries (role 0, at that place of the set's order); subset keys of the smaller (1) and
    the larger (2) size of a size pair."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def post(batches):
        seen: set[int] = set()
        for batch in pieces(batches):
            keys, owners, sizes, roles, places = [], [], [], [], []

            def put(found, owner, n, role):
                keys.append(found)
                owners.append(np.full(len(found), owner, np.int64))
                sizes.append(np.full(len(found), n, np.int32))
                roles.append(np.full(len(found), role, np.int32))
                places.append(np.zeros(len(found), np.int32) if role else np.arange(len(found), dtype=np.int32))

            for s in shingle_sets(batch.column("text"), shingle):
                n, owner = len(s), _digest(s)[0] if len(s) else 0
                if not n or owner in seen:
                    continue
                seen.add(owner)
                if len(seen) > 200_000:  # only saves repeats; what is sent twice counts once later
                    seen.clear()
                if n <= boundary:
                    for m in partner_sizes(n, per_cent):
                        if m > boundary:
                            continue
                        low, high, take = min(n, m), max(n, m), needed(n, m, per_cent)
                        salt = np.uint64((low << 40) | (high << 20) | take)
                        mixed_set = mixed(s ^ np.uint64(0xA4093822299F31D0))
                        parts = np.array([mixed_set[list(c)].sum(dtype=np.uint64) for c in itertools.combinations(range(n), take)], np.uint64)
                        put(mixed(parts + salt), owner, n, 1 if n == low else 2)
                if 100 * n >= per_cent * (boundary + 1):
                    times = shared.value[(s & np.uint64(ORDER_CELLS - 1)).astype(np.int64)]
                    put(s[np.lexsort((s, times))[: prefix_length(n, per_cent)]], owner, n, 0)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(keys))), *(pa.array(np.concatenate(x)) for x in (owners, sizes, roles, places))],
                    names=["key", "d1", "n", "role", "place"])

    return docs.select("text").mapInArrow(post, "key long, d1 long, n int, role int, place int")


def _fits(a: str, b: str, per_cent: int) -> str:
    return f"100 * least({a}, {b}) >= {per_cent} * greatest({a}, {b})"


def links(docs: DataFrame, signatures: DataFrame, shingle: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """node, component: class representatives that have a link, and the smallest representative they reach."""
    spark = docs.sparkSession
    classes = staged(
        signatures.filter("n > 0").groupBy("n", "d1", "d2").agg(
            F.min("doc_id").alias("node"), F.first("profile").alias("profile")), "jaccard-classes")
    sizes = {r["n"]: r["count"] for r in classes.filter(f"n <= {2 * LARGEST_BOUNDARY}").groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, per_cent)
    posted = _postings(docs, _frequency(signatures), boundary, shingle, per_cent)
    posted = staged(posted.withColumn("listed", F.expr("role = 0")), "jaccard-postings")
    # The center of a list is its smallest class (of a size pair: of the smaller size), from partial aggregates; keys that one class has go.
    of_lists = posted.filter("listed").groupBy("key", "listed").agg(F.min("d1").alias("center"), F.max("d1").alias("high"))
    of_lists = of_lists.filter("center < high").select("key", "listed", "center")
    of_pairs = posted.filter("NOT listed").groupBy("key", "listed").agg(
        F.min("d1").alias("low"), F.max("d1").alias("high"), F.min(F.when(F.col("role") == 1, F.col("d1"))).alias("first"))
    of_pairs = of_pairs.filter("low < high AND first IS NOT NULL").select("key", "listed", "first")
    shared_keys = staged(of_lists.union(of_pairs).withColumn("many", F.lit(1)), "jaccard-keys").filter("many > 0").drop("many")
    with pruned_joins(spark):
        lists = staged(posted.join(shared_keys, ["key", "listed"]), "jaccard-lists")
    drop_staged(posted)
    drop_staged(shared_keys)

    def close(batches):
        """Pairs whose profiles allow the similarity."""
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PROFILE).astype(np.int16) for c in ("p", "q"))
            total = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            apart = np.abs(p - q).sum(axis=1, dtype=np.int64)
            yield batch.filter(pa.array((100 + per_cent) * apart <= (100 - per_cent) * total)).select(["a", "u", "b", "v"])

    def to_sets(batches):
        for batch in pieces(batches):
            sets = shingle_sets(batch.column("text"), shingle)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([_digest(s)[0] for s in sets], pa.int64()), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))],
                names=["node", "d1", "shingles"])

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        """u, v: the pairs (a, b of d1) whose sets are similar enough, as representatives; stored. Sets are made for those
        only that pass by their profiles."""
        first = classes.select(F.col("d1").alias("a"), F.col("node").alias("u"), "n", F.col("profile").alias("p"))
        second = classes.select(F.col("d1").alias("b"), F.col("node").alias("v"), F.col("n").alias("m"), F.col("profile").alias("q"))
        near = pairs.join(first, "a").join(second, "b").select("a", "u", "n", "p", "b", "v", "m", "q")
        near = staged(near.mapInArrow(close, "a long, u long, b long, v long"), f"jaccard-{name}-near")
        ids = near.select(F.col("u").alias("doc_id")).unionByName(near.select(F.col("v").alias("doc_id"))).distinct()
        ids = staged(ids.withColumn("listed", F.lit(1)), f"jaccard-{name}-members").filter("listed > 0").select("doc_id")
        with pruned_joins(spark):
            texts = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text")
            sets = staged(texts.mapInArrow(to_sets, "node long, d1 long, shingles array<long>"), f"jaccard-{name}-sets")
        s = sets.select(F.col("node").alias("u"), F.col("d1").alias("a"), F.col("shingles").alias("s"))
        t = sets.select(F.col("node").alias("v"), F.col("d1").alias("b"), F.col("shingles").alias("t"))
        met = near.join(s, ["u", "a"]).join(t, ["v", "b"]).withColumn("shared", F.size(F.array_intersect("s", "t")))
        met = met.filter(f"100 * shared >= {per_cent} * (size(s) + size(t) - shared)").select("u", "v")
        met = staged(met, f"jaccard-{name}-links")
        for done in (near, ids, sets):
            drop_staged(done)
        return met

    def unordered(pairs: DataFrame, other: str) -> DataFrame:
        return pairs.select(F.least("d1", other).alias("a"), F.greatest("d1", other).alias("b")).distinct()

    def labelled(found: DataFrame, name: str) -> DataFrame:
        """d1, label: the component of each class; a class without a link is its own."""
        reached = components(found)
        label = classes.select("node", "d1").join(reached, "node", "left").groupBy("d1")
        label = staged(label.agg(F.min(F.coalesce("component", "node")).alias("label")), f"jaccard-{name}-labels")
        drop_staged(reached)
        return label

    def still_open(entries: DataFrame, ends: DataFrame, name: str, tried: int) -> DataFrame:
        """Entries, with their labels (`ends`), of the lists that hold several components and more than `tried` members."""
        now = entries.drop("label").join(ends, "d1")
        lists = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"))
        now = staged(now.join(lists.filter(f"low < high AND members > {tried}").select("key"), "key"), f"jaccard-{name}-open")
        drop_staged(entries)
        return now

    # First each member meets one center only, the smallest of all its lists: a pair a member, however long the lists.
    sized = classes.select(F.col("d1").alias("center"), F.col("n").alias("m"))
    spokes = lists.filter("d1 <> center").select("d1", "n", "center").distinct().join(sized, "center").filter(_fits("n", "m", per_cent))
    once = spokes.groupBy("d1").agg(F.min("center").alias("other"))
    tested = staged(unordered(once, "other"), "jaccard-once")
    found = checked(tested, "once")

    # The centers of all other subset keys: those keys go no further, so each that still parts two components is compared.
    ends = labelled(found, "once")
    spokes = lists.filter("NOT listed AND d1 <> center").select("d1", "center").distinct().join(ends, "d1")
    spokes = spokes.join(ends.select(F.col("d1").alias("center"), F.col("label").alias("other")), "center")
    pairs = staged(unordered(spokes.filter("label <> other"), "center").join(tested, ["a", "b"], "left_anti"), "jaccard-pairs")
    if not pairs.isEmpty():
        drop_staged(ends)
        tested = tested.unionByName(pairs)
        found = found.unionByName(checked(pairs, "pairs"))
        ends = labelled(found, "pairs")

    # Then, a few times, centers of each list that still holds several components, chosen anew by a hash, with those of
    # other components that they can be linked with. The outliers of near copies so find one of their many neighbours.
    entries = lists.filter("listed").select("key", "d1", "n", "place").withColumn("most", F.expr(largest_partner(per_cent)))
    entries = staged(entries.groupBy("key", "d1", "n").agg(F.max("most").alias("most")), "jaccard-entries")
    drop_staged(lists)
    tried = 0
    for k, centers in enumerate(CENTERS):
        entries = still_open(entries, ends, f"round-{k}", tried)
        turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("d1", F.lit(k)), "d1"))
        chosen = entries.withColumn("turn", turn).filter(F.col("turn") <= centers)
        chosen = staged(chosen.select("key", F.struct("d1", "n", "most", "label").alias("c")), f"jaccard-centers-{k}")
        spokes = entries.join(chosen, "key").filter("label <> c.label AND n <= c.most AND c.n <= most")
        spokes = unordered(spokes.select("d1", F.col("c.d1").alias("other")), "other")
        star = staged(spokes.join(tested, ["a", "b"], "left_anti"), f"jaccard-star-{k}")
        drop_staged(chosen)
        tried = centers
        if star.isEmpty():
            break
        tested = tested.unionByName(star)
        found = found.unionByName(checked(star, f"star-{k}"))
        drop_staged(ends)
        ends = labelled(found, f"star-{k}")

    # Then what is left: entries that can reach sets of their size or larger meet these, band by band.
    entries = still_open(entries, ends, "rest", tried)
    drop_staged(ends)
    left = entries.filter("most >= n").select(
        "key", F.explode(F.expr(f"sequence({band('n')}, {band('most')})")).alias("band"),
        F.col("d1").alias("a"), F.col("n").alias("na"), F.col("most").alias("reach_a"), F.col("label").alias("la"))
    left = staged(left, "jaccard-reaching")
    right = entries.withColumn("band", F.expr(band("n"))).select(
        "key", "band", F.col("d1").alias("b"), F.col("n").alias("nb"), F.col("most").alias("reach_b"), F.col("label").alias("lb"))
    rest = left.join(right, ["key", "band"]).filter(
        "(nb > na OR nb = na AND a < b) AND nb <= reach_a AND na <= reach_b AND la <> lb")
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = staged(rest.join(tested, ["a", "b"], "left_anti"), "jaccard-rest")
    drop_staged(left)
    drop_staged(entries)
    return components(found.unionByName(checked(rest, "rest")))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, per_cent: int = PER_CENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Words are parted by ASCII white space, A-Z in lower case. Null or wordless text has an empty set and links with nothing:
    its component is itself. Null ids are one document below all others (component null). Rows that repeat an id:
    each text counts, and all belong to that id. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text")
    signatures = _signatures(rows, shingle)
    reached = links(rows, signatures, shingle, per_cent)
    signed_rows = signatures.filter("block IS NULL").select("doc_id", "n", "d1", "d2")
    classes = signed_rows.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node"))
    classes = classes.join(reached, "node", "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("component_id"))
    classes = staged(classes, "jaccard-class-components")
    out = signed_rows.join(classes, ["n", "d1", "d2"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    given = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return out.select(given("doc_id"), F.col("n").alias("n_shingles"), given("component_id"))


def op10_jaccard_join(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))
