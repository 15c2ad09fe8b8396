"""Operator 4, n-gram Jaccard join: token-combination prefixes, then exact verification.

A document is its set of distinct k-word shingles (64-bit hashes); two link when 100 * intersection >= T * union.

1. Isolation. With n shingles, a linked document shares at least ceil(T n / 100) of them, so one with
   p = n - ceil(T n / 100) + 1 shingles found in no other text has no link. Shingles whose hash lies in a fixed
   region are counted for all documents; only documents that the counts cannot clear go on, with all their shingles.
2. Prefixes. Shingles are ordered by document frequency, rarest first. Linked documents share one of their first p
   shingles. If one shared there is rare (at most RARE documents), a single shingle finds the pair. If not, all that
   they share are frequent, and they share K of the first p + K - 1: the prefix is extended so far, its frequent
   shingles are split into K - 1 classes by hash, so some class holds two shared ones, and all pairs of shingles
   within a class are indexed. K depends on the size class (sizes that can link differ by one class at most). Where a
   class's linked documents may share fewer than K (one shingle), single shingles are indexed whatever their frequency.
3. Stars. In each index bucket all documents are compared with one pivot only, the one with fewest shingles of its
   own; components follow from the links found.
4. Rest. Where a bucket's documents are still in different components, those not with the pivot are compared with the
   bucket's others in blocks of at most BLOCK x BLOCK documents (products of 0/1 matrices), which return links between
   components, not pairs. So no link that joins two components is lost, and no group's pairs are listed.

Documents are identified by a 64-bit hash of their word sequence: equal sequences are one node. A second 64-bit hash goes with
it; where sequences of one hash differ in the other, they are renamed by both, so 128 bits tell documents apart.

Defined results: null, empty or wordless texts have no shingles and are their own component. The component's id is
its smallest doc_id (null ids count only if there is no other). Repeated rows are reported as often as they come. An
empty table gives no rows. Extra columns are ignored, and kept by one_of_each(). It keeps, of each component, the row with
the smallest doc_id (null ids last; of equal ids the one with the smaller node; of equal rows the least by their other
columns), and every row without words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cinderlake.llm.common import Filter, fresh, materialise, one_row, table
from cinderlake.operators.graph import components

RARE = 16
BLOCK = 512
CACHE = 400_000
_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Shingler:
    """Distinct shingles of a text in UTF-8, and two hashes of its word sequence."""

    def __init__(self, k: int):
        self.k, self.cache = k, {}

    def __call__(self, text: bytes | None) -> tuple[int | None, int | None, np.ndarray]:
        words = (text or b"").lower().split()
        if not words:
            return None, None, np.zeros(0, np.uint64)
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        h = []
        for w in words:
            x = cache.get(w)
            if x is None:
                x = cache[w] = xxhash.xxh3_64_intdigest(w)
            h.append(x)
        h = np.array(h, np.uint64)
        size = min(self.k, len(h))
        t = h[: len(h) - size + 1]
        for i in range(1, size):
            t = t * _A + h[i : len(h) - size + 1 + i]
        if size < self.k:
            t = t + np.uint64(size)
        return *self.hashes(words), np.unique(_mixed(t))

    @staticmethod
    def hashes(words: list[bytes]) -> tuple[int, int]:
        both = xxhash.xxh3_128_intdigest(b" ".join(words))
        return _signed(both >> 64), _signed(both & (1 << 64) - 1)


def required(n, t: int):
    """Shingles that a linked document shares at least."""
    return (t * n + 99) // 100


def prefix(n, t: int):
    return n - required(n, t) + 1


def linked(shared, n, m, t: int):
    return 100 * shared >= t * (n + m - shared)


def size_classes(most: int, t: int) -> np.ndarray:
    """Lower bounds of size classes; sizes that can link lie in one class or in two adjacent ones."""
    bounds = [1]
    while len(bounds) < 3 or bounds[-3] <= most:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // t)))
    return np.array(bounds, np.int64)


def keys_of(n: int, own: int, tokens: np.ndarray, df: np.ndarray, t: int, rare: int = RARE) -> np.ndarray:
    """Index keys of a document with n shingles, own of them in no other; tokens: the rest, by (df, token)."""
    p = prefix(n, t)
    first = slice(0, max(0, p - own))
    keys = [_mixed(tokens[first][df[first] <= rare] ^ np.uint64(1))]
    if (df[first] > rare).any():
        bounds = size_classes(2 * n + 2, t)
        c = int(np.searchsorted(bounds, n, side="right")) - 1
        for size_class in (c, c + 1):
            k = max(2, 1 + prefix(int(bounds[size_class + 1]), t) // 2)
            if k > required(int(bounds[size_class]), t):  # too small to share k: one shingle of the prefix finds the pair
                keys.append(_mixed(_mixed(tokens[first][df[first] > rare]) + np.uint64(size_class)))
                continue
            reach = slice(0, max(0, p + k - 1 - own))
            frequent = tokens[reach][df[reach] > rare]
            group = frequent % np.uint64(k - 1)
            by = np.lexsort((frequent, group))
            frequent, group = frequent[by], group[by]
            for gap in range(1, len(frequent)):
                same = np.flatnonzero(group[gap:] == group[:-gap])
                if not len(same):
                    break
                keys.append(_mixed(_mixed(frequent[same] * _A + frequent[same + gap]) + np.uint64(size_class)))
    return np.unique(np.concatenate(keys))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes | None]:
    return batch.column(at).cast(pa.binary()).to_pylist()


def _some(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def signatures(docs: DataFrame, k: int, t: int) -> DataFrame:
    """doc_id, node, check, n and the shingles in the region of each row."""
    share = min(1.0, 2 * (100 - t) / 100 + 0.05)
    below = np.uint64(min(share * 2.0**64, 2.0**64 - 2048))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(k)
        for batch in (x for b in batches for x in _some(b)):
            found = [shingles(x) for x in _texts(batch, 1)]
            node, check, sets = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists([s[s < below] for s in sets])],
                names=["doc_id", "node", "check", "n", "region"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, node bigint, check bigint, n bigint, region array<bigint>")


def _full(docs: DataFrame, going: Filter, k: int) -> DataFrame:
    """node, check and all shingles of the documents that the filter passes."""
    packed, buckets = docs.sparkSession.sparkContext.broadcast(going.collected()), going.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bits = Shingler(k), packed.value

        def passes(node: int) -> bool:
            row = (node & (buckets - 1)) * (Filter.BUCKET // 8)
            return all(bits[row + (at >> 3)] >> (at & 7) & 1 for at in ((node >> (16 * j + 4)) & (Filter.BUCKET - 1) for j in range(1, Filter.PROBES + 1)))

        for batch in (x for b in batches for x in _some(b)):
            found = [x for x in map(shingles, _texts(batch, 0)) if x[0] is not None and passes(x[0])]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.int64()), _lists([s for _, _, s in found])], names=["node", "check", "tokens"])

    return docs.select("text").mapInArrow(run, "node bigint, check bigint, tokens array<bigint>")


def _told_apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """rows with node and check, where nodes of several sequences are renamed by both hashes."""
    if clashes is None:
        return rows
    marked = rows.join(clashes.withColumn("_several", F.lit(True)), "node", "left")
    return marked.withColumn("node", F.when(F.col("_several"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("_several").select(*rows.columns)


def _indexed(nodes: DataFrame, t: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in _some(b, 200)):
            ids, n, own = (batch.column(i).to_numpy() for i in range(3))
            tokens, df = _arrays(batch.column(3)), _arrays(batch.column(4))
            keys = [keys_of(int(n[i]), int(own[i]), tokens[i].view(np.uint64), df[i], t) for i in range(len(ids))]
            at = np.repeat(np.arange(len(ids)), [len(x) for x in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids[at]), pa.array(own[at])], names=["key", "node", "own"])

    return nodes.select("node", "n", "own", "tokens", "df").mapInArrow(run, "key bigint, node bigint, own bigint")


def _with_pivot(pairs: DataFrame, nodes: DataFrame, t: int) -> DataFrame:
    """pivot, node, linked of each pair."""
    x = nodes.select("node", "n", "tokens")
    y = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("m"), F.col("tokens").alias("others"))
    joined = pairs.join(x, "node").join(y, "pivot").select("pivot", "node", "n", "m", "tokens", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in _some(b)):
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            shared = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(_arrays(batch.column(4)), _arrays(batch.column(5)), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked(shared, n, m, t))], names=["pivot", "node", "linked"])

    return joined.mapInArrow(run, "pivot bigint, node bigint, linked boolean")


def block_links(part: pd.DataFrame, t: int) -> pd.DataFrame:
    """Links between components, one for each pair of components, among a block's rows of role r and y."""
    r, y = part[part.role == "r"], part[part.role == "y"]
    if r.empty or y.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    ids, inverse = np.unique(np.concatenate([*r.tokens, *y.tokens]), return_inverse=True)
    sizes = np.array([*map(len, r.tokens), *map(len, y.tokens)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = np.zeros((len(r), len(y)), np.float32)
    step = max(1, (1 << 24) // len(sizes))  # columns at a time: 64 MB of matrix
    for at in range(0, len(ids), step):
        inside = (inverse >= at) & (inverse < at + step)
        dense = np.zeros((len(sizes), min(step, len(ids) - at)), np.float32)
        dense[row[inside], inverse[inside] - at] = 1
        shared += dense[: len(r)] @ dense[len(r) :].T
    ok = linked(shared.astype(np.int64), r.n.to_numpy()[:, None], y.n.to_numpy()[None, :], t)
    ok &= r.label.to_numpy()[:, None] != y.label.to_numpy()[None, :]
    i, j = np.nonzero(ok)
    found = pd.DataFrame({"a": r.node.to_numpy()[i], "b": y.node.to_numpy()[j], "s": r.label.to_numpy()[i], "t": y.label.to_numpy()[j]})
    return found.drop_duplicates(["s", "t"])[["a", "b"]]


def _rest_links(stars: DataFrame, labels: DataFrame, nodes: DataFrame, t: int) -> DataFrame:
    """Links found among the documents of stars that have more than one component."""
    at = stars.join(labels.withColumnRenamed("label", "own_label"), "node", "left").join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("pivot_label")), "pivot", "left")
    at = at.select("pivot", "node", F.coalesce("own_label", "node").alias("label"), F.coalesce("pivot_label", "pivot").alias("pivot_label"))
    at = materialise(at.withColumn("apart", F.col("label") != F.col("pivot_label")), "members")
    stat = at.groupBy("pivot").agg(F.count("*").alias("members"), F.sum(F.col("apart").cast("long")).alias("rest"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("rest > 0 AND members > 1 AND (lo <> hi OR rest < members)")
    stat = materialise(stat.select("pivot", F.ceil(F.col("members") / BLOCK).alias("y_blocks"), F.ceil(F.col("rest") / BLOCK).alias("r_blocks")), "unresolved")
    known = at.join(stat, "pivot")
    mine = lambda blocks: F.pmod(F.hash("node"), F.col(blocks))
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    r = known.where("apart").select("pivot", "node", "label", F.lit("r").alias("role"), mine("r_blocks").cast("long").alias("i"), all_of("y_blocks").alias("j"))
    y = known.select("pivot", "node", "label", F.lit("y").alias("role"), mine("y_blocks").cast("long").alias("j"), all_of("r_blocks").alias("i")).select("pivot", "node", "label", "role", "i", "j")
    placed = r.unionByName(y).join(nodes.select("node", "n", "tokens"), "node")
    return placed.groupBy("pivot", "i", "j").applyInPandas(lambda part: block_links(part, t), "a bigint, b bigint")


def _nodes(signed: DataFrame) -> DataFrame:
    wordy = signed.where("node IS NOT NULL")
    return materialise(wordy.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi")), "nodes")


def _components(docs: DataFrame, k: int, t: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Signatures of the rows; node, component_id, least_node of the nodes; nodes that were renamed."""
    signed, clashes = materialise(signatures(docs, k, t), "signatures"), None
    every = _nodes(signed)
    if not (several := every.where("lo <> hi").select("node")).isEmpty():
        clashes = materialise(several, "clashes")
        signed = materialise(_told_apart(signed, clashes), "signatures")
        every = _nodes(signed)
    by_token = signed.where("node IS NOT NULL").select("node", F.explode("region").alias("token")).groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    own = by_token.where("a = b").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("own"))
    need = F.col("n") - F.floor((F.lit(t) * F.col("n") + 99) / 100) + 1
    going = materialise(every.join(own, "node", "left").where(F.coalesce("own", F.lit(0)) < need).select("node"), "going")
    # The filter knows documents by the hash of the text alone: renamed ones pass by the hash they had.
    hashes = going if clashes is None else going.unionByName(clashes)
    full = _told_apart(_full(docs, Filter(hashes, "node"), k), clashes)
    full = materialise(full.groupBy("node").agg(F.first("tokens").alias("tokens")).join(going, "node", "left_semi"), "full")
    exploded = full.select("node", F.explode("tokens").alias("token"))
    common = materialise(exploded.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    spread = exploded.join(common, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("pairs"))
    counted = spread.join(every, "node").select("node", "n", (F.col("n") - F.size("pairs")).alias("own"), F.col("pairs.token").alias("tokens"), F.col("pairs.df").alias("df"))
    nodes = materialise(counted.where(F.col("own") < need), "sets")
    keys = materialise(_indexed(nodes, t), "keys")
    pivots = materialise(keys.groupBy("key").agg(F.min(F.struct("own", "node")).alias("least"), F.count("*").alias("size")).where("size > 1").select("key", F.col("least.node").alias("pivot")), "pivots")
    pairs = keys.join(pivots, "key").where("node <> pivot").select("pivot", "node").distinct()
    stars = materialise(_with_pivot(pairs, nodes, t), "stars")
    links = stars.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    labels = components(links)
    rest = materialise(_rest_links(stars.select("pivot", "node"), labels, nodes, t), "rest")
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))
    joined = materialise(labels.join(every.select("node", "rep"), "node"), "placed")
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node"))  # null ids last
    least = materialise(joined.groupBy("label").agg(first.alias("first")), "least")
    component = materialise(joined.join(least, "label").select("node", F.col("first.rep").alias("component"), F.col("first.node").alias("first_node")), "component")
    final = every.join(component, "node", "left").select("node", F.coalesce("component", "rep").alias("component_id"), F.coalesce("first_node", "node").alias("least_node"))
    return signed, materialise(final, "final"), clashes


def similar_groups(docs: DataFrame, k: int, t: int) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; t: per cent of the union that must be shared."""
    signed, final, _ = _components(docs, k, t)
    out = signed.select("doc_id", "node", F.col("n").alias("n_shingles")).join(final, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _with_nodes(docs: DataFrame, node: str, check: str) -> DataFrame:
    """docs with two columns more, the hashes of each row's word sequence."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in _some(b)):
            words = [(x or b"").lower().split() for x in _texts(batch, at)]
            both = [Shingler.hashes(w) if w else (None, None) for w in words]
            hashes = [pa.array([x[i] for x in both], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *hashes], names=[*batch.schema.names, node, check])

    schema = StructType([*docs.schema.fields, StructField(node, LongType()), StructField(check, LongType())])
    return docs.mapInArrow(run, schema)


def one_of_each(docs: DataFrame, k: int = 5, t: int = 80) -> DataFrame:
    """One row of each group of similar documents and all rows without words, with all columns."""
    signed, final, clashes = _components(docs, k, t)
    kept = signed.join(final.where("node = least_node"), "node").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = materialise(kept.groupBy("node", "check").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")), "kept")
    if clashes is not None:  # back to the hash of the text alone, which docs is marked by
        hashes = materialise(signatures(docs, k, t).select("node", "check"), "hashes").distinct()
        kept = _told_apart(hashes.withColumn("plain", F.col("node")), clashes).join(kept, ["node", "check"]).select(F.col("plain").alias("node"), "check", "id", "rows")
    node, check, id_, hit = (fresh(docs, c) for c in ("_kept_node", "_kept_check", "_kept_id", "_kept_hit"))
    marked = _with_nodes(docs, node, check)
    found = kept.select(F.col("node").alias(f"{node}_"), F.col("check").alias(f"{check}_"), F.col("id").alias(id_), F.lit(True).alias(hit))
    # Rows without words find nothing (their check is null) and are dealt out by id.
    same = (F.coalesce(F.col(node), F.xxhash64("doc_id")) == F.col(f"{node}_")) & (F.col(check) == F.col(f"{check}_")) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_))
    out = marked.join(found, same, "left").where(F.col(hit) | F.col(node).isNull()).drop(f"{node}_", f"{check}_", id_, hit)
    if not kept.where("rows > 1").isEmpty():
        out = materialise(out, "repeated")
        out = one_row(out.where(F.col(node).isNotNull()), ["doc_id", node, check]).unionByName(out.where(F.col(node).isNull()))
    return out.drop(node, check)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), k=3, t=90)


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.y FROM reach JOIN links ON reach.b = links.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
