"""Spelling variants: words one edit apart, found as pairs of trie nodes, and the frequent form that each follows.

Distinct words are numbered in code-point order. Their prefixes are the nodes of a trie, their suffixes those of a trie of the reversed
words, and nodes have numbers. A word is split before each of its places into (node of what is before, node of what is behind), and
skipping a character leaves (node before it, node behind it). So two integers stand for a whole string and the place of the cut:

* two words that skip to one pair differ by exactly one replaced character,
* a word that is split at the pair to which another one skips lacks exactly the skipped character.

Of characters that repeat side by side only the first counts as skipped in the second case, so each pair of words meets once. All
words at one pair differ in one character, so a group is at most as large as the alphabet, plus one word that is split there.

Nodes are numbered without a trie in one place: words are sorted by range into blocks, a block adds one node for each character
behind the prefix that a word shares with the one before it, and what a block shares with the block before is worked out on the
driver from one row per block (first word, last word and its nodes, number of nodes).

A word follows its near word of largest count (ties: the least in code-point order) if that count is at least ``RATIO`` times its own.
Forms are followed to the end by doubling; counts grow by ``RATIO`` at each step, so the number of rounds is logarithmic in the
logarithm of the largest count.

Defined cases: a null text has no words; a null document id stands as an empty one where a change of words reads it; repeated rows
count as often as they occur; words too short or too rare play no part, not even as near words; a word of one repeated letter and a
word of any length are treated like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.sources.scratch import materialise

from .arrow import raw, slices

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
SLICE_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, change: Callable[[object, Counter], Counter] | None = None, least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the letter runs of whole texts, A-Z lower-cased, counted per slice and then over the table.

    ``change`` maps a document's id and the counts of its runs of ``least_length`` or more code points to other counts.
    """
    def count(batches):
        for batch in slices(batches, "text", SLICE_BYTES):
            total = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
                runs = Counter(_RUN.findall(text.translate(_LOWER).decode("utf-8", "replace")))
                long = Counter({w: n for w, n in runs.items() if len(w) >= least_length})
                total.update(change(doc_id, long) if change else long)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    words = found.where(F.char_length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(words.where(F.col("n") >= least_count), "words")


def _paths(words: list[str]) -> tuple[list[int], int]:
    """Numbers of the trie nodes of sorted ``words``, one word's after the other, as if no words came before; and how many there are."""
    flat, path, last, made = [], [], "", 0
    for word in words:
        shared, limit = 0, min(len(word), len(last))
        if word[:limit] == last[:limit]:
            shared = limit
        else:
            while word[shared] == last[shared]:
                shared += 1
        new = len(word) - shared
        path = path[:shared] + list(range(made, made + new))
        made, last = made + new, word
        flat += path
    return flat, made


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def numbered(words: DataFrame, key: str) -> DataFrame:
    """``words`` with ``number`` (position in the order of ``key``, distinct strings) and ``path`` (trie nodes of its prefixes, root first)."""
    others = [f for f in words.schema.fields if f.name != key]
    row = T.StructType([T.StructField(key, T.StringType()), *others])
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("words", T.ArrayType(row)), T.StructField("first", T.StringType()),
        T.StructField("last", T.StringType()), T.StructField("made", T.LongType()), T.StructField("path", T.ArrayType(T.LongType()))])

    def block(batches):
        part = TaskContext.get().partitionId() << 32
        for batch in slices(batches, key, BLOCK_BYTES):
            keys = batch.column(key).to_pylist()
            flat, made = _paths(keys)
            rows = pa.StructArray.from_arrays([batch.column(f.name) for f in row], fields=[batch.schema.field(f.name) for f in row])
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), rows), pa.array([keys[0]]),
                pa.array([keys[-1]]), pa.array([made], pa.int64()), pa.array([flat[len(flat) - len(keys[-1]):]], pa.list_(pa.int64())),
            ], names=["block", "words", "first", "last", "made", "path"])
            part += 1

    ordered = words.select(key, *(f.name for f in others)).repartitionByRange(key).sortWithinPartitions(key)
    stored = materialise(ordered.mapInArrow(block, schema), "word-blocks")
    # One row per megabyte of distinct words comes to the driver.
    heads = stored.select("block", F.size("words").alias("n"), "first", "last", "made", "path").orderBy("block").collect()
    starts, last, path, nodes, number = {}, "", [], 1, 0
    for h in heads:
        own = path[:_shared(last, h["first"])]
        starts[h["block"]] = own, nodes - len(own), number
        path = [own[k] if k < len(own) else nodes - len(own) + k for k in h["path"]]
        last, nodes, number = h["last"], nodes - len(own) + h["made"], number + h["n"]
    shared = words.sparkSession.sparkContext.broadcast(starts)

    def number_(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                rows = batch.column("words")[at].values
                keys = rows.field(key).to_pylist()
                before, shift, first = shared.value[batch.column("block")[at].as_py()]
                nodes = np.array(_paths(keys)[0], np.int64)
                nodes = np.where(nodes < len(before), np.r_[before, [0]].astype(np.int64)[np.minimum(nodes, len(before))], nodes + shift)
                ends = np.cumsum([len(k) for k in keys])
                nodes = np.insert(nodes, np.r_[0, ends[:-1]], 0)  # the root
                path = pa.ListArray.from_arrays(pa.array(np.r_[0, ends + np.arange(1, len(keys) + 1)], pa.int32()), pa.array(nodes))
                yield pa.RecordBatch.from_arrays([*(rows.field(k) for k in range(rows.type.num_fields)), pa.array(np.arange(first, first + len(keys))), path],
                                                 names=[*(f.name for f in row), "number", "path"])

    out = T.StructType([*row, T.StructField("number", T.LongType()), T.StructField("path", T.ArrayType(T.LongType()))])
    return materialise(stored.select("block", "words").mapInArrow(number_, out), "numbered")


def _pairs(words: DataFrame) -> DataFrame:
    """(before, behind, n, o, first, whole): the node pairs of every word; ``o`` is the negative word number."""
    length = F.size("chars")
    skips = F.transform(F.sequence(F.lit(1), length), lambda k: F.struct(
        F.element_at("path", k).alias("before"), F.element_at("back", length - k + 1).alias("behind"),
        ((k == 1) | (F.element_at("chars", k) != F.element_at("chars", F.greatest(k - 1, F.lit(1))))).alias("first"), F.lit(False).alias("whole")))
    splits = F.transform(F.sequence(F.lit(1), length + 1), lambda k: F.struct(
        F.element_at("path", k).alias("before"), F.element_at("back", length - k + 2).alias("behind"), F.lit(False).alias("first"), F.lit(True).alias("whole")))
    chars = words.select("n", (-F.col("number")).alias("o"), "path", "back", F.split("word", "").alias("chars"))
    return chars.select("n", "o", F.inline(F.concat(skips, splits)))


def near_words(words: DataFrame) -> DataFrame:
    """(number, n_near, best) of every word of (word, n, number, path, back) that has near words; ``best`` holds the count and the negative number."""
    entry = F.struct("n", "o", "first")
    groups = _pairs(words).groupBy("before", "behind").agg(
        F.collect_list(F.when(~F.col("whole"), entry)).alias("skips"), F.max(F.when(F.col("whole"), F.struct("n", "o"))).alias("whole"))
    groups = groups.where((F.size("skips") > 1) | ((F.size("skips") > 0) & F.col("whole").isNotNull()))
    plain = lambda x: F.struct(x["n"].alias("n"), x["o"].alias("o"))
    whole = lambda x: F.when(x["first"], F.col("whole"))

    def others(x: Column) -> Column:
        return F.array_max(F.transform(F.filter("skips", lambda y: y["o"] != x["o"]), plain))

    skipped = F.transform("skips", lambda x: F.struct(
        x["o"].alias("o"), (F.size("skips") - 1 + F.when(whole(x).isNotNull(), 1).otherwise(0)).cast("long").alias("n_near"),
        F.greatest(others(x), whole(x)).alias("best")))
    longer = F.filter("skips", lambda x: x["first"])
    split = F.struct(F.col("whole.o").alias("o"), F.size(longer).cast("long").alias("n_near"), F.array_max(F.transform(longer, plain)).alias("best"))
    found = groups.select(F.inline(F.concat(skipped, F.when(F.col("whole").isNotNull(), F.array(split)).otherwise(F.array())))).where("n_near > 0")
    return found.groupBy((-F.col("o")).alias("number")).agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame, largest: int, ratio: float) -> DataFrame:
    """(number, form, root): the last of the forms that follow each other."""
    roots = materialise(forms.select("number", "form", F.col("form").alias("root")), "forms")
    steps = max(1, math.ceil(math.log(max(largest, 2), ratio)))
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        ahead = roots.select(F.col("number").alias("root"), F.col("root").alias("_ahead"))
        roots = materialise(roots.join(ahead, "root", "left").select("number", "form", F.coalesce("_ahead", "root").alias("root")), "forms")
    return roots


def spelling_variants(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with counts (word, n)."""
    if ratio <= 1:
        raise ValueError("a form must be more frequent than the word")
    forward = numbered(words.select("word", "n"), "word")
    back = numbered(forward.select(F.reverse("word").alias("drow"), F.col("number").alias("_of")), "drow")
    both = forward.join(back.select(F.col("_of").alias("number"), F.col("path").alias("back")), "number")
    known = forward.select("number", "word", "n")
    near = materialise(known.join(near_words(both), "number", "left"), "near")
    forms = near.where(F.col("best.n") >= ratio * F.col("n")).select("number", (-F.col("best.o")).alias("form"))
    roots = _roots(forms, known.agg(F.max("n")).first()[0] or 0, ratio)
    called = lambda name: known.select(F.col("number").alias(name), F.col("word").alias(f"{name}_word"), F.col("n").alias(f"{name}_n"))
    named = roots.join(called("form"), "form").join(called("root"), "root").select("number", "form_word", "form_n", "root_word")
    return near.join(named, "number", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
