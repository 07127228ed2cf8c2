"""Near-duplicate documents by DartMinHash signatures and banded joining, verified exactly.

A document is the multiset of its shingles of five words (lower-cased A-Z, split at ASCII white space; a text of one to four
words is one shingle), an element weighing as often as it occurs. Two documents are linked if their weighted Jaccard
similarity is 0.8 or more, and classes are connected components of links.

Equal texts are one node, whose key is the MD5 of the text. A signature has 128 darts. Two nodes are candidates if they agree in all
darts of one of 21 bands of 6, and in ``AGREE`` of the 128 darts: at a similarity of exactly 0.8 that fails with a probability of
0.0026 (0.0017 by the bands, 0.0009 by the count), at 0.85 with one below 1e-4. Candidates of different classes are verified
on their texts, in three rounds whatever the data:

1. every node with one node, of the least ones of its buckets that which is the least in most of them,
2. every node outside the largest class of a bucket with the ``NEAREST`` nodes of other classes there whose signatures agree best: what was
   copied from one text finds it,
3. all candidates that are still in different classes, compared where they are found: in their tile.

So every pair of candidates is in one class or was compared, and most are never made: nodes of one class are not compared again.
Rounds 2 and 3 look only at buckets with several classes, and there at nodes outside the largest class against the others, in tiles of
at most about ``TILE`` by ``TILE`` signatures that a task holds one at a time, so a bucket of any size is spread over tasks. A pair that shares
several bands counts in the first one alone. In round 3 the shingles of the nodes that have a candidate go to its tiles, and a tile returns
only links that connect classes, so that no join has a row per pair.

Defined cases: a text that is null or has no word is in no bucket and forms a class of its own row; rows with equal text are
one class; the class id is the least document id (nulls only if there is no other); an empty table gives an empty result;
columns of other names play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.operators.ordered import top_k_per
from depotlens.sources.scratch import materialise, workspace

from .arrow import mix, raw, slices
from .components import components
from .dart_minhash import signatures

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 21, 6
DARTS = 128
AGREE = 88
TILE = 512
NEAREST = 3
BROADCAST_KEYS = 1 << 19
SLICE_BYTES = 4 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: bytes) -> np.ndarray:
    words = text.translate(_LOWER).split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending, and how often each occurs."""
    size = min(size, len(words))
    if not size:
        return words, np.zeros(0, np.int64)
    n = len(words) - size + 1
    value = np.full(n, size, np.uint64)
    for k in range(size):
        value = (value ^ words[k:k + n]) * _FACTOR
        value ^= value >> np.uint64(29)
    return np.unique(mix(value), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    _, in_a, in_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][in_a], b[1][in_b]).sum())
    total = int(a[1].sum()) + int(b[1].sum()) - shared
    return shared / total if total else 0.0


def text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _has_words(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _signed(nodes: DataFrame, size: int) -> DataFrame:
    """(key, n, bands, sketch) of each distinct text; the sketch is 16 bits of each dart, then the bands."""
    def sign(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            rows = dict(zip(batch.column("key").to_pylist(), raw(batch.column("text"))))
            sets = [shingles(word_hashes(t), size) for t in rows.values()]
            owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
            darts = signatures(owner, np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]).astype(float), len(sets), DARTS)
            banded = darts[:, :BANDS * ROWS].reshape(len(sets), BANDS, ROWS)
            value = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), banded.shape[:2])
            for k in range(ROWS):
                value = mix((value + np.uint64(1)) * _FACTOR ^ banded[:, :, k])
            short = (mix(darts) >> np.uint64(48)).astype("<u2")
            yield pa.RecordBatch.from_arrays([
                pa.array(list(rows), pa.binary()), pa.array([int(s[1].sum()) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, pa.array(value.reshape(-1).view(np.int64))),
                pa.array([d.tobytes() + v.tobytes() for d, v in zip(short, value)], pa.binary())], names=["key", "n", "bands", "sketch"])

    signed = nodes.mapInArrow(sign, "key binary, n long, bands array<long>, sketch binary")
    # Equal texts of several slices have equal rows.
    return signed.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))


def _sketches(column) -> tuple[np.ndarray, np.ndarray]:
    """Short darts and bands of sketches, a row each."""
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return data[:, :2 * DARTS].copy().view("<u2"), data[:, 2 * DARTS:].copy().view("<i8")


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ``AGREE`` darts."""
    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (_sketches(batch.column(c))[0] for c in ("a_sketch", "b_sketch"))
                keep = pa.array(np.flatnonzero((a == b).sum(axis=1) >= AGREE))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], names=["a", "b"])

    of = lambda end: sketches.select(F.col("key").alias(end), F.col("sketch").alias(f"{end}_sketch"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "a_sketch", "b_sketch")
    return materialise(both.mapInArrow(likely, "a binary, b binary"), "pairs")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    def verify(batches):
        last, leader = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = []
            for key, x, y in zip(a, raw(batch.column("a_text")), raw(batch.column("b_text"))):
                if key != last:
                    last, leader = key, shingles(word_hashes(x), size)
                good.append(similarity(leader, shingles(word_hashes(y), size)) >= least)
            keep = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.binary()), pa.array([b[i] for i in keep], pa.binary())], names=["a", "b"])

    with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("b_text")), "b")
    with_both = with_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("a_text")), "a")
    return materialise(with_both.select("a", "b", "a_text", "b_text").mapInArrow(verify, "a binary, b binary"), "links")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after the classes that ``links`` connect have become one."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    labels = labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    labels = materialise(labels, "labels")
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
    newer = components(between).select(F.col("node").alias("label"), F.col("label").alias("_new"))
    return materialise(labels.join(newer, "label", "left").select("node", F.coalesce("_new", "label").alias("label")), "labels")


def _runs(batches, columns):
    """Batches cut so that rows of equal ``columns``, which follow each other, stay together."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if held and (keys[0] != held[1]).any():
            yield pa.Table.from_batches(held[0]).combine_chunks().to_batches()[0]
            held = []
        if len(edges):
            whole = batch.slice(0, int(edges[-1]))
            yield pa.Table.from_batches([*held[0], whole] if held else [whole]).combine_chunks().to_batches()[0]
            held = [[batch.slice(int(edges[-1]))], keys[-1]]
        else:
            held = [[*held[0], batch] if held else [batch], keys[-1]]
    if held:
        yield pa.Table.from_batches(held[0]).combine_chunks().to_batches()[0]


def _tiles(mixed: DataFrame, sketches: DataFrame) -> DataFrame:
    """(band, i, j, waiting, key, n, label, sketch): the nodes of tile (i, j) of each bucket with several classes.

    Tile (i, j) compares part j of the waiting nodes, those outside the bucket's largest class, with part i of all nodes.
    """
    part = lambda of: F.pmod(F.xxhash64("key"), F.ceil(F.col(of) / TILE)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.ceil(F.col(of) / TILE).cast("int") - 1))
    rows = mixed.join(sketches, "key").withColumn("waiting", F.col("label") != F.col("largest"))
    columns = ["band", "i", "j", "waiting", "key", "n", "label", "sketch"]
    nodes = rows.withColumn("i", part("members")).withColumn("j", every("open")).withColumn("waiting", F.lit(False))
    waiting = rows.where("waiting").withColumn("j", part("open")).withColumn("i", every("members"))
    return nodes.select(columns).unionByName(waiting.select(columns)).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def _pairs_of_tiles(batches, least: float):
    """(batch, x, agree, y) of each tile: rows of candidates of different classes, ``x`` the waiting ones, and in how many darts they agree."""
    for batch in _runs(batches, ["band", "i", "j"]):
        band, i, j = (batch.column(c).to_numpy() for c in ("band", "i", "j"))
        waits, n = batch.column("waiting").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
        codes = np.unique(np.array(batch.column("label").to_pylist(), object), return_inverse=True)[1]
        darts, bands = _sketches(batch.column("sketch"))
        edges = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for run in np.split(np.arange(len(band)), edges):
            left, right = run[waits[run]], run[~waits[run]]
            if not len(left) or not len(right):
                continue
            ok = codes[left][:, None] != codes[right]
            ok &= np.minimum(n[left][:, None], n[right]) >= least * np.maximum(n[left][:, None], n[right])
            x, y = np.nonzero(ok)
            x, y = left[x], right[y]
            found = []
            for some in np.split(np.arange(len(x)), range(1 << 16, len(x), 1 << 16)):
                agree = (darts[x[some]] == darts[y[some]]).sum(axis=1)
                some, agree = some[agree >= AGREE], agree[agree >= AGREE]
                # A pair that shares several bands counts in the first.
                first = (bands[x[some]] == bands[y[some]]).argmax(axis=1)
                real = bands[x[some], first] == band[x[some]]
                found.append(np.stack([x[some][real], agree[real], y[some][real]]))
            x, agree, y = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            if len(x):
                yield batch, x, agree, y


def _nearest(tiles: DataFrame, least: float) -> DataFrame:
    """(node, agree, a, b): the ``NEAREST`` candidates of other classes that each waiting node has in each tile; ``node`` is the waiting one."""
    def find(batches):
        for batch, x, agree, y in _pairs_of_tiles(batches, least):
            keys = np.array(batch.column("key").to_pylist(), object)
            order = np.unique(keys, return_inverse=True)[1]
            best = np.lexsort((order[y], -agree, x))
            x, agree, y = x[best], agree[best], y[best]
            keep = np.arange(len(x)) - np.searchsorted(x, x) < NEAREST
            x, agree, y = x[keep], agree[keep], y[keep]
            flip = order[x] > order[y]
            node, a, b = keys[x], keys[np.where(flip, y, x)], keys[np.where(flip, x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(agree, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                                             names=["node", "agree", "a", "b"])

    return tiles.mapInArrow(find, "node binary, agree long, a binary, b binary")


def _elements(texts: DataFrame, size: int) -> DataFrame:
    """(key, elements): 64-bit hashes of each text's shingles, every occurrence with a hash of its own."""
    def make(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            rows = []
            for text in raw(batch.column("text")):
                value, count = shingles(word_hashes(text), size)
                again = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                rows.append(mix(np.repeat(value, count) + again.astype(np.uint64) * _FACTOR).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, pa.binary())], names=["key", "elements"])

    return texts.mapInArrow(make, "key binary, elements binary")


def _similar(items: list[np.ndarray], x: np.ndarray, y: np.ndarray, codes: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Of the pairs (x, y), those with a similarity of ``least`` or more that connect classes (``codes``) not connected by others before them."""
    root = {}

    def top(code: int) -> int:
        while root.get(code, code) != code:
            code = root[code]
        return code

    sizes = np.array(list(map(len, items)))
    distinct, ids = np.unique(np.concatenate(items), return_inverse=True)
    first, here, links = np.cumsum(sizes) - sizes, np.zeros(len(distinct), bool), []
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    for run in np.split(np.arange(len(x)), np.flatnonzero(x[1:] != x[:-1]) + 1):
        one = int(x[run[0]])
        own = ids[first[one]:first[one] + sizes[one]]
        here[own] = True
        for some in np.array_split(y[run], -(-len(run) // 64)):
            some = some[[top(int(c)) != top(int(codes[one])) for c in codes[some]]]
            if not len(some):
                continue
            n = sizes[some]
            starts = np.cumsum(n) - n
            shared = np.add.reduceat(here[ids[np.repeat(first[some] - starts, n) + np.arange(int(n.sum()))]].astype(np.int64), starts)
            for other in some[shared / (n + sizes[one] - shared) >= least].tolist():
                low, high = sorted((top(int(codes[one])), top(int(codes[other]))))
                if low != high:
                    root[high] = low
                    links.append((one, other))
        here[own] = False
    return links


def _links_of_tiles(tiles: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b): links between different classes, enough of each tile to connect all that its links connect.

    Candidates are found and compared inside their tile, so that a group of texts just below the similarity adds its nodes, not its pairs, to any join.
    """
    def involved(batches):
        for batch, x, _, y in _pairs_of_tiles(batches, least):
            yield batch.take(pa.array(np.unique(np.r_[x, y])))

    def link(batches):
        for batch, x, _, y in _pairs_of_tiles(batches, least):
            used, at = np.unique(np.r_[x, y], return_inverse=True)
            rows = batch.take(pa.array(used))
            items = [np.frombuffer(e, np.uint64) for e in rows.column("elements").to_pylist()]
            codes, keys = np.unique(np.array(rows.column("label").to_pylist(), object), return_inverse=True)[1], rows.column("key").to_pylist()
            found = _similar(items, at[:len(x)], at[len(x):], codes, least)
            yield pa.RecordBatch.from_arrays([pa.array([keys[pair[k]] for pair in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    some = materialise(tiles.mapInArrow(involved, tiles.schema), "involved")
    elements = materialise(_elements(texts.join(some.select("key").distinct(), "key", "left_semi"), size), "elements")
    dealt = some.join(elements, "key").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return materialise(dealt.mapInArrow(link, "a binary, b binary"), "links")


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, key, n, label, largest, members, open) of the buckets that hold several classes."""
    labelled = buckets.select("band", "key", "n").join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        "band", "key", "n", F.coalesce("label", "key").alias("label"))
    labelled = materialise(labelled, "labelled")
    classes = labelled.groupBy("band", "label").agg(F.count("*").alias("_n")).groupBy("band").agg(
        F.max_by("label", F.struct("_n", "label")).alias("largest"), F.sum("_n").alias("members"), (F.sum("_n") - F.max("_n")).alias("open"))
    # Stored, so that both sides of the join are exchanged and a hot bucket can be split.
    return materialise(labelled.join(materialise(classes.where("open > 0"), "classes"), "band"), "mixed")


def text_classes(docs: DataFrame, text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(node, label) of every text that is similar to another one: their keys; the label is the least key of the class."""
    return workspace(docs.sparkSession, "text-classes", lambda: _text_classes(docs, text_col, size, least))


def _text_classes(docs: DataFrame, text_col: str, size: int, least: float) -> DataFrame:
    nodes = docs.where(_has_words(text_col)).select(text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    signed = materialise(_signed(nodes, size), "signatures")
    shared = signed.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("_n")).where("_n > 1").select("band")
    buckets = materialise(signed.select("key", "n", F.explode("bands").alias("band")).join(materialise(shared, "shared"), "band"), "buckets")
    members = materialise(buckets.select("key").distinct(), "members")
    # Keys of 16 bytes: few enough are broadcast, so that texts need not be exchanged to find those that matter.
    few = F.broadcast(members) if members.count() <= BROADCAST_KEYS else members
    texts = nodes.join(few, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    texts = materialise(texts, "texts")
    sketches = materialise(signed.select("key", "sketch").join(members, "key", "left_semi"), "sketches")
    # Similarity of two multisets is at most the ratio of their sizes.
    heads = materialise(buckets.groupBy("band").agg(F.min(F.struct("key", "n")).alias("h")).select("band", F.col("h.key").alias("a"), F.col("h.n").alias("a_n")), "heads")
    pairs = buckets.join(heads, "band").where("key <> a").where(F.least("n", "a_n") >= least * F.greatest("n", "a_n"))
    pairs = pairs.groupBy("key", "a").agg(F.count("*").alias("_n")).groupBy("key").agg(F.max(F.struct("_n", "a")).alias("h"))
    pairs = _likely(materialise(pairs.select("h.a", F.col("key").alias("b")), "headed"), sketches)
    labels, compared = materialise(components(_verified(pairs, texts, size, least)), "labels"), pairs
    # Classes only grow, so only buckets that were mixed before can be mixed now.
    buckets = _mixed(buckets, labels)
    pairs = top_k_per(_nearest(_tiles(buckets, sketches), least), ["node"], [F.desc("agree"), F.asc("a"), F.asc("b")], NEAREST)
    pairs = materialise(pairs.select("a", "b").distinct().join(compared, ["a", "b"], "left_anti"), "pairs")
    links = _verified(pairs, texts, size, least)
    if not links.isEmpty():
        labels = _merged(labels, links)
    links = _links_of_tiles(_tiles(_mixed(buckets, labels), sketches), texts, size, least)
    if not links.isEmpty():
        labels = _merged(labels, links)
    return labels


def _labelled(docs: DataFrame, columns: list[Column], text_col: str, **options) -> DataFrame:
    """``columns`` of every row and ``label``: the key of its class, null for rows without words."""
    labels = text_classes(docs, text_col, **options).select(F.col("node").alias("key"), F.col("label").alias("root"))
    keyed = docs.select(F.struct(*columns).alias("row"), F.when(_has_words(text_col), text_key(text_col)).alias("key"))
    return keyed.join(labels, "key", "left").select("row", "key", F.coalesce("root", "key").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, class_id, class_size) of every row; rows without words are their own class."""
    rows = _labelled(docs, [F.col(id_col).alias("doc_id")], text_col, **options)
    rows = materialise(rows.select("row.doc_id", "label"), "classes")
    heads = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    joined = rows.join(materialise(heads, "class-heads"), "label", "left")
    own = F.col("label").isNull()
    return joined.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                         F.when(own, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"))


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with one row of each class: the one with the least id (then key); rows without words all stay.

    Which text stays is found from ids and keys alone; whole rows are exchanged once, copies of a text combined before it.
    """
    id_of = lambda value: F.struct(value.isNull(), value)
    keyed = _labelled(docs, [F.col(id_col).alias("doc_id")], text_col, **options).where("label is not null")
    least = keyed.groupBy("label").agg(F.min(F.struct(id_of(F.col("row.doc_id")), "key")).alias("least"))
    least = materialise(least.select(F.col("least.key").alias("_kept")), "kept-keys")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.when(_has_words(text_col), text_key(text_col)).alias("key"))
    texts = rows.where("key is not null").groupBy("key").agg(F.min_by("row", id_of(F.col("row").getField(id_col))).alias("row"))
    kept = texts.join(least, texts["key"] == least["_kept"], "left_semi")
    return kept.select("row.*").unionByName(rows.where("key is null").select("row.*"))
