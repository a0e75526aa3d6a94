"""Approximate nearest neighbours by largest inner product: robust-pruned directed graphs, one a shard, and beam search.

1. Rows with the same vector are one class, which keeps its smallest ids (as many as any answer can use). A third of all
   rows may be copies of one vector; the rest of such a class never travels, for ranks up to k are cut before the shuffle.
2. Classes are dealt to shards by a hash, SHARD_ROWS to a shard on average, so a shard's memory doesn't grow with the
   table; vectors of other lengths, or whose norms differ by more than a factor of two, are in other shards.
3. Each shard builds its graph (`vamana`) in one task. The graph is a table: node, vector, ids, links, and the node that a
   vector follows, if it is a near copy.
4. Every query goes to every shard of its length: shards and their queries are sorted together, and a task streams them,
   holding one shard and one batch of queries. The found nodes are scored in double precision on the original vectors.

Every row is indexed; nothing is fitted on a sample. Results are approximate; tests measure recall against brute force.

Rows without an id, and vectors that are null, empty, all zero or hold a null or non-finite component, take no part. Rows
that repeat an id and its vector count once; of several vectors with one id the smallest (in array order) takes part.
Equal scores go to the smaller id. A query with fewer than k candidates gets all of them; a query or a table without
any gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.llm.common import own_names, staged, table

SHARD_ROWS, SEARCH_BEAM, SLICE_QUERIES, PAIRS = 8192, 128, 1024, 1 << 16


def usable(vector) -> F.Column:
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return fine & F.exists(vector, lambda x: x != 0)


def one_vector_an_id(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    own = own_names(rows, vec_id=id_col, embedding=vector_col).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return own.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))


def matrix(column) -> np.ndarray:
    """Rows of equally long lists as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build_index(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """dim, band, shard, node, home, radius, entry, ids (the class's k + 1 smallest), embedding, links (nodes of the shard): a
    stored table."""
    from barlattice.llm import vamana

    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = one_vector_an_id(rows, id_col, vector_col).withColumn("turn", F.row_number().over(first)).filter(F.col("turn") <= k + 1)
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    scaled = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))
    classes = staged(
        few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("most", most)
        .withColumn("band", F.floor(F.log2("most") + 0.5 * F.log2(scaled)).cast("int")).drop("most")
        .withColumn("dim", F.size("embedding")), "graph-classes")
    bands = {r["band"]: r["n"] for r in classes.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # exponents: some 2,100 at most
    if not bands:
        return classes.select("dim", "band", F.lit(0).alias("shard"), F.lit(0).alias("node"), F.lit(0).alias("home"), F.lit(0.0).alias("radius"),
                              F.lit(0).alias("entry"), "ids", "embedding", F.array().cast("array<int>").alias("links"))
    shards = F.create_map(*(F.lit(x) for b, n in bands.items() for x in (b, -(-n // shard_rows))))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("ids"), shards[F.col("band")].cast("long")).cast("int"))

    def graph(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort([x[0].as_py() for x in group["ids"]])))
        links, home, entry, radius = vamana.build(vamana.lifted(matrix(group["embedding"])))
        n, there = len(group), links >= 0
        offsets = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
        return pa.table({
            "dim": group["dim"], "band": group["band"], "shard": group["shard"], "node": pa.array(np.arange(n, dtype=np.int32)),
            "home": pa.array(home), "radius": pa.array(np.full(n, radius)), "entry": pa.array(np.full(n, entry, np.int32)), "ids": group["ids"], "embedding": group["embedding"],
            "links": pa.ListArray.from_arrays(pa.array(offsets), pa.array(links[there].astype(np.int32)))})

    kind = dict(classes.dtypes)["embedding"]
    schema = f"dim int, band int, shard int, node int, home int, radius double, entry int, ids array<long>, embedding {kind}, links array<int>"
    return staged(dealt.groupBy("dim", "band", "shard").applyInArrow(graph, schema), "graph-index")


def _padded(lists: pa.Array, kind, held: bool = False) -> np.ndarray:
    """Lists as rows of one width, filled with -1; or (held) where these hold something."""
    counts = np.diff(lists.offsets.to_numpy())
    out = np.full((len(lists), max(1, counts.max(initial=0))), -1, kind)
    there = np.arange(out.shape[1]) < counts[:, None]
    out[there] = lists.flatten().to_numpy(zero_copy_only=False)
    return there if held else out


class _Shard:
    """A shard's graph, ready for queries."""

    def __init__(self, parts: list[pa.RecordBatch]):
        from barlattice.llm import vamana

        rows = pa.Table.from_batches(parts).combine_chunks()
        self.vectors = matrix(rows["embedding"])
        self.z = vamana.lifted(self.vectors)
        self.links = _padded(rows["links"].combine_chunks(), np.int32)
        ids = rows["ids"].combine_chunks()
        self.ids, self.there = _padded(ids, np.int64), _padded(ids, np.int64, held=True)
        self.entry, self.radius = rows["entry"][0].as_py(), rows["radius"][0].as_py()
        home = rows["home"].to_numpy()
        self.followers = np.argsort(home, kind="stable")
        self.first = np.searchsorted(home[self.followers], np.arange(len(home) + 1))

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
        """For each query its k best (own id, id, score) in this shard, that own id left out."""
        from barlattice.llm import vamana

        flat = queries / np.abs(queries).max(axis=1, keepdims=True)  # a positive factor changes no order
        flat = flat / np.sqrt(np.einsum("bd,bd->b", flat, flat))[:, None]
        flat = np.column_stack([flat, np.zeros(len(queries))]).astype(np.float32)
        found, _ = vamana.beam(self.z, self.links, self.entry, flat, max(width, k + 1))
        sims = np.where(found >= 0, np.einsum("bcd,bd->bc", self.z[found], flat), -np.inf)
        least = -np.partition(-sims, k, axis=1)[:, k]
        wanted = (found >= 0) & (sims >= least[:, None] - self.radius - 1e-5)  # no follower of another node can be among the k + 1
        counts = np.where(wanted, self.first[found + 1] - self.first[found], 0).sum(axis=1)
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(np.cumsum(counts[at:]), PAIRS, "right")) + at)
            row, column = np.nonzero(wanted[at:to])
            node = found[at:to][row, column]
            times = self.first[node + 1] - self.first[node]
            row, begin = np.repeat(row, times), np.cumsum(times) - times
            member = self.followers[np.arange(times.sum()) - np.repeat(begin - self.first[node], times)]
            score = np.einsum("pd,pd->p", self.vectors[member], queries[at:to][row])
            fits = self.there[member] & (self.ids[member] != own[at:to][row][:, None])
            row, score = (np.repeat(x, self.ids.shape[1])[fits.ravel()] for x in (row, score))
            ids = self.ids[member][fits]
            order = np.lexsort((ids, -score, row))
            row, score, ids = row[order], score[order], ids[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield own[at:to][row[best]], ids[best], score[best]
            at = to


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, width: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score for queries (query_id: distinct, embedding: usable), which are sent to every shard."""
    spark = index.sparkSession
    bands = index.groupBy("band").agg((F.max("shard") + 1).alias("shards")).collect()
    total = sum(r["shards"] for r in bands)
    cores = spark.sparkContext.defaultParallelism
    slices = max(1, min(-(-queries.count() // SLICE_QUERIES), -(-2 * cores // max(1, total))))  # copies of a graph, for small indexes
    if not bands:
        return queries.limit(0).select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))
    everywhere = F.explode(F.array(*(F.struct(F.lit(r["band"]).alias("band"), F.lit(r["shards"]).alias("shards")) for r in bands)))
    kind = dict(index.dtypes)["embedding"]
    sent = (
        queries.select("query_id", F.col("embedding").cast(kind).alias("embedding"), everywhere.alias("at"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("at.shards") - 1)))
        .select(F.size("embedding").alias("dim"), "at.band", "shard", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int").alias("slice"),
                F.lit(1).alias("kind"), F.lit(0).alias("node"), F.lit(0).alias("home"), F.lit(0.0).alias("radius"), F.lit(0).alias("entry"), F.array("query_id").alias("ids"), "embedding",
                F.array().cast("array<int>").alias("links")))
    held = index.select("dim", "band", "shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"),
                        "node", "home", "radius", "entry", "ids", "embedding", "links")
    part = ["dim", "band", "shard", "slice"]
    streams = held.unionByName(sent).repartition(max(1, min(total * slices, 4096 * cores)), *part).sortWithinPartitions(*part, "kind", "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in (*part, "kind")])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for at, to in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if tuple(keys[at][:4]) != now:
                    now, parts, shard = tuple(keys[at][:4]), [], None
                if keys[at][4] == 0:
                    parts.append(batch.slice(at, to - at))
                    continue
                if shard is None and parts:
                    shard, parts = _Shard(parts), []
                for k0 in range(at, to, 512) if shard else ():
                    some = batch.slice(k0, min(512, to - k0))
                    own = some.column("ids").flatten().to_numpy()
                    for asked, ids, score in shard.nearest(own, matrix(some.column("embedding")), k, width):
                        yield pa.record_batch({"query_id": pa.array(asked), "vec_id": pa.array(ids), "score": pa.array(score)})

    found = streams.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame, asks, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, **sizes) -> DataFrame:
    """The k nearest of each row for which `asks` (a condition on vec_id) holds, against all other rows."""
    index = build_index(rows, id_col, vector_col, k, **sizes)
    queries = staged(one_vector_an_id(rows.filter(F.col(f"`{id_col}`").isNotNull()), id_col, vector_col).filter(asks)
                     .withColumnRenamed("vec_id", "query_id"), "graph-queries")
    return search_index(index, queries, k)


def op12_graph_neighbours(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
