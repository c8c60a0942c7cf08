"""Near copies: operator 2's SimHash links, and those by shingle Jaccard that 2 bits do not reach (MinHash bands propose pairs, exact comparison of shingle sets decides); star rounds join both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NON_SPACE, bit_filter, chunks, map_batches, may_hold, mix, one_of_each, ship, stored, text_bytes, word_bounds, word_hashes
from .simhash_dedup import _chunk_fingerprints, components, near_links

SHINGLE_WORDS = 5
#: Least Jaccard similarity of linked texts, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Bands of ROWS minima each. A pair of similarity 0.8 shares no band with probability (1 - 0.8^5)^32, 3 in a million.
BANDS, ROWS = 32, 5
#: Nodes and shingles of a block, about; a task compares two blocks, by so many shingles at once.
BLOCK_NODES, BLOCK_SHINGLES, DENSE_TOKENS = 256, 1 << 18, 4096
_draw = np.random.default_rng(5)
_XOR, _ODD = (_draw.integers(0, 1 << 64, n, np.uint64, endpoint=False) for n in (BANDS * ROWS, BANDS * ROWS))
_ODD |= np.uint64(1)
_PLACE = _draw.integers(0, 1 << 64, SHINGLE_WORDS, np.uint64, endpoint=False) | np.uint64(1)


def _chunk_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' distinct shingles, ascending in each row, and each row's first (one entry more than rows)."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, NON_SPACE)
    words, n = word_hashes(data, starts, ends), np.diff(first)
    count = np.where(n == 0, 0, np.maximum(1, n - SHINGLE_WORDS + 1))
    row = np.repeat(np.arange(len(n)), count)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = first[row] + np.arange(len(row)) - begin[row]
    hashes = np.zeros(len(row), np.uint64)
    for k in range(SHINGLE_WORDS):
        there = at + k < first[row + 1]  # a shorter text is one shingle
        hashes[there] += (words[at[there] + k] + np.uint64(k + 1)) * _PLACE[k]
    hashes = mix(hashes)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(n)))])


def _nodes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number per shingle set; 0 for the empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ _XOR[0]), dtype=np.uint64)])
    return np.where(np.diff(first) == 0, np.uint64(0), np.maximum(mix(sums[first[1:]] - sums[first[:-1]]), np.uint64(1)))


def _band_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each row with shingles."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(some), BANDS), np.uint64)
    for band in range(BANDS if len(some) else 0):
        key = np.full(len(some), band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * _ODD[0] + np.minimum.reduceat((hashes ^ _XOR[k]) * _ODD[k], first[some]))
        out[:, band] = key
    return out


def _mapped(docs: DataFrame, carry: list[str], text: str, names: list[str], schema: T.StructType, columns) -> DataFrame:
    """``carry`` columns and what ``columns`` makes of a chunk of texts."""
    rows = docs.select(*[F.col(c).alias(f"_j_c{i}") for i, c in enumerate(carry)], F.col(text).alias("_j_text"))
    whole = T.StructType([*[rows.schema[f"_j_c{i}"] for i in range(len(carry))], *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_j_text"))
            for i, j in chunks(offsets):
                lo, hi = int(offsets[i]), int(offsets[j])
                got = columns(data[lo:hi], offsets[i : j + 1] - lo)
                yield pa.RecordBatch.from_arrays([*[batch.column(f"_j_c{c}").slice(i, j - i) for c in range(len(carry))], *got], names=whole.names)

    return map_batches(rows, run, whole).toDF(*carry, *names)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _signed(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    hashes, first = _chunk_shingles(data, offsets)
    keys, many = _band_keys(hashes, first), np.where(np.diff(first) == 0, 0, BANDS)
    bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), _longs(keys.ravel()))
    return [_longs(_nodes(hashes, first)), pa.array(np.diff(first)), bands, _longs(_chunk_fingerprints(data, offsets))]


def _sets(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    hashes, first = _chunk_shingles(data, offsets)
    return [_longs(_nodes(hashes, first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), _longs(hashes))]


def _may_be(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose shingle ``sets`` (node, shingles) have a Jaccard similarity of at least SIMILAR."""
    s, t = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(s, "a").join(t, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("same"), (F.size("sa") + F.size("sb")).alias("sum"))
    return both.where(F.col("same") * SIMILAR[1] >= (F.col("sum") - F.col("same")) * SIMILAR[0]).select("a", "b")


def copy_links(nodes: DataFrame, sets_of, known: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of all similar sets that share a band. ``nodes`` has (node, n, bands), one row a node.

    Every member of a group (a band's key) is compared with the group's least node; with the links ``known`` besides, these
    join most. All pairs of a group whose members are then in several components are compared by ``torn_links``.
    ``sets_of`` gives (node, shingles) of a table of nodes.
    """
    bands = nodes.select("node", "n", F.explode("bands").alias("key"))
    groups = bands.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
    # Spark sizes what an explode makes as what goes in, many times too low: neither side may be broadcast.
    members = stored(bands.join(groups.hint("merge"), "key"), "band-members")
    sets = stored(sets_of(members.select("node").distinct()), "shingle-sets")
    pairs = members.where((F.col("node") != F.col("head.node")) & _may_be(F.col("n"), F.col("head.n"))).select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()
    roots = components(verified(stored(pairs, "pairs"), sets).unionByName(known))
    placed = members.where("c > 2").select("key", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    torn = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    placed = stored(placed.join(torn.hint("merge"), "key", "left_semi"), "torn-members")
    # What is joined by now goes on as one star a component, which takes few rounds.
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(stored(torn_links(placed, sets), "torn-links"))


def torn_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all similar sets of a group, from ``members`` (key, node, n, root); pairs of one root are joined already.

    Only sets of a size class and the next can be similar, so a group is cut by two classes in a row; of groups of the same
    members one is taken. What has the group's most frequent root is dealt into blocks apart from the rest: the blocks
    of the rest are compared with each other and with those, pair by pair of blocks, so no task has more than two blocks.
    """
    cut = ["key", "class"]
    wide = F.floor(F.log(F.col("n").cast("double")) / float(np.log(SIMILAR[1] / SIMILAR[0]) * (1 + 1e-9)))
    rows = members.where("n > 0").withColumn("class", F.explode(F.array(wide, wide + 1)))
    cells = rows.groupBy(*cut, "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("node")).alias("h"))
    whole = cells.groupBy(*cut).agg(F.max(F.struct("c", "root", "w")).alias("most"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.bit_xor("h").alias("h"), F.count(F.lit(1)).alias("roots"))
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK_NODES), F.ceil(w / BLOCK_SHINGLES), F.lit(1)).cast("int")
    shape = whole.where("roots > 1").groupBy("c", "h").agg(F.min(F.struct(*cut, "most", "w")).alias("g")).select(
        "g.key", "g.class", F.col("g.most.root").alias("most"), blocks(F.col("g.most.c"), F.col("g.most.w")).alias("fore"), blocks(F.col("c") - F.col("g.most.c"), F.col("g.w") - F.col("g.most.w")).alias("rest"))
    dealt = rows.join(shape.hint("merge"), cut).withColumn("is_most", F.col("root") == F.col("most"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "node"), F.when(F.col("is_most"), F.col("fore")).otherwise(F.col("rest"))).cast("int"))
    unit = lambda most, i, j: F.struct(F.lit(most).alias("most"), i.alias("i"), j.alias("j"))
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    block = F.col("block")
    with_rest = upto(F.col("rest"), lambda k: unit(False, F.least(block, k), F.greatest(block, k)))
    units = F.when(F.col("is_most"), upto(F.col("rest"), lambda k: unit(True, k, block))).otherwise(F.concat(with_rest, upto(F.col("fore"), lambda k: unit(True, block, k))))
    each = dealt.select(*cut, "node", "root", "is_most", "block", F.explode(units).alias("unit"))
    left = F.when(F.col("unit.most"), ~F.col("is_most")).otherwise(F.col("block") == F.col("unit.i")).alias("left")
    right = F.when(F.col("unit.most"), F.col("is_most")).otherwise(F.col("block") == F.col("unit.j")).alias("right")
    full = each.select(*cut, "unit", "node", "root", left, right).join(sets.hint("merge"), "node")
    ship(members.sparkSession)
    return full.groupBy(*cut, "unit").applyInArrow(_unit_links, "a long, b long").distinct()


def _unit_links(part: pa.Table) -> pa.Table:
    """Links between nodes of the left and the right block that join all similar ones of different roots."""
    node, root = part.column("node").to_numpy(), part.column("root").to_numpy()
    left, right = (np.flatnonzero(part.column(c).to_numpy()) for c in ("left", "right"))
    shingles = part.column("shingles")
    n = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in shingles.chunks]).astype(np.int64)
    _, token = np.unique(np.concatenate([c.flatten().to_numpy() for c in shingles.chunks]), return_inverse=True)
    first = np.cumsum(n) - n
    entries = lambda rows: (np.repeat(np.arange(len(rows)), n[rows]), token[np.repeat(first[rows] - np.cumsum(n[rows]) + n[rows], n[rows]) + np.arange(n[rows].sum())])
    (row, t), (other, u) = entries(left), entries(right)
    size = token.max(initial=-1) + 1
    common = (np.bincount(t, minlength=size) > 0) & (np.bincount(u, minlength=size) > 0)
    at = np.cumsum(common) - 1
    (row, t), (other, u) = ((r[common[x]], at[x[common[x]]]) for r, x in ((row, t), (other, u)))
    same = np.zeros((len(left), len(right)))
    for lo in range(0, int(common.sum()), DENSE_TOKENS):
        sides = []
        for rows, r, x in ((left, row, t), (right, other, u)):
            held, dense = (x >= lo) & (x < lo + DENSE_TOKENS), np.zeros((len(rows), DENSE_TOKENS), np.float32)
            dense[r[held], x[held] - lo] = 1
            sides.append(dense)
        same += sides[0] @ sides[1].T
    close = same * SIMILAR[1] >= (n[left][:, None] + n[right][None, :] - same) * SIMILAR[0]
    a, b = np.nonzero(close & (root[left][:, None] != root[right][None, :]))
    a, b, label, out = left[a], right[b], np.unique(root, return_inverse=True)[1], []
    while len(a):  # one link joins two labels
        out.append((node[a[0]], node[b[0]]))
        label[label == label[a[0]]] = label[b[0]]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    out = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": out[:, 0], "b": out[:, 1]})


def simhash_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of nodes that operator 2 links, from (node, fp): those of one fingerprint with their least one, and the least ones of linked fingerprints."""
    prints = stored(prints.distinct(), "node-fingerprints")
    least = stored(prints.groupBy("fp").agg(F.min("node").alias("least")), "least-of-fingerprint")
    of = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"l{c}"))
    equal = prints.join(least, "fp").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = near_links(least.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    return equal.unionByName(near).where("a <> b")


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents, one of each component of near copies: the row of its least id, null last (of repeated ids, the least text hash).

    Two texts are near copies if operator 2 links them (SimHash fingerprints within 2 bits, by deletion variants), or if the
    Jaccard similarity of their sets of five-word shingles is at least 0.8 and they share a MinHash band. Links are verified, and every pair of a band is joined if it is similar, see ``copy_links``.
    Words are lower-cased (A-Z) runs of other bytes than the six white-space ones; a shorter text is one shingle,
    and all texts without words are copies of each other.
    """
    names = docs.columns
    keys = {"_n_k1": F.xxhash64(F.col(doc_id), F.col(text)), "_n_k2": F.xxhash64(F.lit(1), F.col(doc_id), F.col(text))}
    key = ["_n_k1", "_n_k2"]
    marked = docs.select(*[F.col(c).alias(f"_n_c{i}") for i, c in enumerate(names)], F.col(doc_id).alias("_n_id"), *[k.alias(c) for c, k in keys.items()], F.col(text).alias("_n_text"))
    own = [f"_n_c{i}" for i in range(len(names))]
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    rows = _mapped(marked, ["_n_id", *key], "_n_text", ["node", "n", "bands", "fp"], T.StructType([T.StructField("node", long), T.StructField("n", long), T.StructField("bands", longs), T.StructField("fp", long)]), _signed)
    rows = stored(rows, "signatures")
    least = F.min(F.struct(F.col("_n_id").isNull().alias("none"), F.col("_n_id").alias("id"), *key)).alias("of")

    def looked_up(wanted: DataFrame) -> DataFrame:
        """The documents of ``wanted`` keys; only rows that may be among them are shuffled."""
        return may_hold(marked, F.col("_n_k1"), bit_filter(wanted.select("_n_k1")), "_n_maybe").where("_n_maybe").join(wanted, key, "left_semi")

    def sets_of(nodes: DataFrame) -> DataFrame:
        one = stored(rows.join(nodes, "node", "left_semi").groupBy("node").agg(least).select("of._n_k1", "of._n_k2"), "set-rows")
        got = _mapped(looked_up(one).select("_n_text"), [], "_n_text", ["node", "shingles"], T.StructType([T.StructField("node", long), T.StructField("shingles", longs)]), _sets)
        return got.dropDuplicates(["node"])

    distinct = stored(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("c")), "distinct-sets")
    roots = components(copy_links(distinct.drop("c"), sets_of, simhash_links(rows.select("node", "fp"))))
    # Rows of a set that is linked to no other and occurs once stay without being looked at again.
    several = stored(distinct.where("c > 1").select("node").unionByName(roots.select("node")).unionByName(roots.select(F.col("root").alias("node"))).distinct(), "shared-sets")
    placed = stored(rows.select("_n_id", *key, "node").join(several, "node", "left_semi").join(roots, "node", "left").select("_n_id", *key, F.coalesce("root", "node").alias("root")), "placed")
    keep = placed.groupBy("root").agg(least).select("of._n_k1", "of._n_k2", F.lit(True).alias("_n_keep"))
    status = stored(placed.select(*key).distinct().join(keep, key, "left"), "status")
    seen = may_hold(marked, F.col("_n_k1"), bit_filter(status.select("_n_k1")), "_n_maybe")
    # A row that the filter lets through by chance has no status, is in no component and stays as well.
    kept = seen.where("_n_maybe").join(status.withColumn("_n_known", F.lit(True)), key, "left").where("_n_known is null or _n_keep")
    return seen.where("not _n_maybe").select(own).unionByName(one_of_each(kept, key, own)).toDF(*names)
