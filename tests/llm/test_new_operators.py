"""Piece tables, spelling variants and automaton search against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import pytest
from pyspark.sql import Row

from depotlens.llm import automaton_search, piece_table, queries, trie_pairs
from depotlens.llm.queries import PIECES, tokenizer_file

from .conftest import WORDS, odd_pairs, prose, rows_of

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
MODEL = tokenizer_file(PIECES)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=MODEL)


# 11

SPACED = [" ", "  ", "\n", "\n\n a", " a ", "a  b", "a\n b \nc", "▁", "a▁b", "▁ ▁x", "\ta b", "日本 語\n日本", "a\x00b", "﻿x", "  y", "<s> </s>",
          "<0x0A>", "é" * 50, "x" * 5000, " " * 40, "\r\n", "🙂 🙂🙂", "á b", "<unk>", "a\n\n\nb", "\na", "a\n"]


def digests(library, pairs):
    out = []
    for doc_id, text in pairs:
        ids = library.encode(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_bytes,part_bytes", [(32 << 20, 8 << 20), (3000, 500), (1, 1)])
def test_pieces_equal_the_library(spark, library, slice_bytes, part_bytes):
    pairs = [p[:2] for p in odd_pairs()] + [(100 + k, t) for k, t in enumerate(SPACED)]
    got = piece_table.piece_digests(rows_of(spark, pairs), MODEL, slice_bytes=slice_bytes, part_bytes=part_bytes)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == digests(library, pairs)


def test_pieces_of_documents(documents, library):
    got = piece_table.piece_digests(documents, MODEL, slice_bytes=200_000, part_bytes=20_000)
    assert sorted(map(tuple, got.collect()), key=str) == digests(library, [(r.doc_id, r.text) for r in documents.collect()])


def test_ids_and_texts_come_back(spark, library, documents):
    import numpy as np
    encoded = piece_table.encode_documents(documents, MODEL, slice_bytes=300_000)
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert ids == {k: library.encode(t or "") for k, t in texts.items()}
    assert {r.doc_id: r.text for r in piece_table.decode_documents(encoded, MODEL).collect()} == {k: library.decode(v) for k, v in ids.items()}


def test_ids_that_no_text_has_are_decoded_by_the_library(spark, library):
    import numpy as np
    own = [[1, 5, 300, 2], [0, 400], [230, 131], [259, 259], [], [3 + 0xE6]]
    rows = spark.createDataFrame([Row(doc_id=k, ids=bytearray(np.array(x, "<u4").tobytes())) for k, x in enumerate(own)], "doc_id long, ids binary")
    assert {r.doc_id: r.text for r in piece_table.decode_documents(rows, MODEL).collect()} == {k: library.decode(x) for k, x in enumerate(own)}


def test_texts_are_cut_before_markers_and_around_breaks():
    model = piece_table.Model(open(MODEL, "rb").read())
    whole, starts, _ = model.cut([b"to be or not to be", b"", b"be  it\nbe"])
    chunks = [whole[a:b] for a, b in zip(starts, [*starts[1:], len(whole)])]
    assert chunks == [b" to", b" be", b" or", b" not", b" to", b" be", b" be", b"  it", b"\n", b"be"]
    ids, counts = model.segment(sorted(set(chunks)))
    assert len(counts) == 7 and counts.sum() == len(ids)


def test_models_with_pieces_across_markers_are_refused():
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    proto.pieces[400].piece = "of▁the"
    with pytest.raises(ValueError, match="cross"):
        piece_table.Model(proto.SerializeToString())
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(MODEL, "rb").read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError, match="normalizes"):
        piece_table.Model(proto.SerializeToString())


def test_no_pieces_of_nothing(none):
    assert piece_table.piece_digests(none, MODEL).count() == 0


# 12

def variants(counts, ratio=10):
    """(word, form, root, n, n_near, form_n) by comparing strings with one character left out."""
    near, whole, holes = defaultdict(set), set(counts), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            shorter = w[:k] + w[k + 1:]
            if shorter in whole:
                near[w].add(shorter)
                near[shorter].add(w)
            holes[w[:k], w[k + 1:]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted(((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()), key=str)


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def tuples(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=str)


CHAINS = {"aaaaaaa": 100_000, "aaaaaaaa": 10_000, "aaaaaaaaa": 1000, "aaaaaaaaaa": 100, "aaaaaaaaaab": 10, "aaaaaaaaaabb": 1, "aaaaaab": 100_000, "aabaaaa": 5,
          "letters": 50, "lettres": 4, "leters": 5, "lettters": 5, "lettera": 3, "letterb": 3, "letterç": 30, "lletters": 2, "életters": 2, "etters": 6,
          "abababa": 9, "bababab": 9, "ababab": 90, "bababa": 90, "x" * 3000: 40, "x" * 2999: 2, "x" * 1500 + "y" + "x" * 1499: 3, "alone": 7}


@pytest.mark.parametrize("ratio", [10, 2])
def test_variants_of_chosen_words(spark, ratio):
    assert tuples(trie_pairs.spelling_variants(frame(spark, CHAINS), ratio)) == variants(CHAINS, ratio)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_variants_of_many_words_in_any_blocks(spark, monkeypatch, block):
    import random
    r, counts = random.Random(4), {}
    for _ in range(1500):
        counts["".join(r.choice("abç") for _ in range(r.randint(1, 8)))] = r.choice([1, 2, 5, 20, 50, 300, 7000])
    monkeypatch.setattr(trie_pairs, "BLOCK_BYTES", block)
    assert tuples(trie_pairs.spelling_variants(frame(spark, counts))) == variants(counts)


def test_trie_nodes_stand_for_prefixes(spark, monkeypatch):
    monkeypatch.setattr(trie_pairs, "BLOCK_BYTES", 30)
    words = sorted({w[:k] + w for w in WORDS for k in range(1, 4)} | set(WORDS))
    rows = trie_pairs.numbered(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), "word").collect()
    assert [r.word for r in sorted(rows, key=lambda r: r.number)] == words and sorted(r.number for r in rows) == list(range(len(words)))
    nodes = {(r.word[:k], node) for r in rows for k, node in enumerate(r.path)}
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert {p for p, _ in nodes} == prefixes and len(nodes) == len(prefixes) == len({n for _, n in nodes})


def misspelt_counts(pairs):
    out = Counter()
    for doc_id, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def test_variants_of_documents(spark, small, documents):
    expected = variants(misspelt_counts([(r.doc_id, r.text) for r in documents.collect()]))
    assert tuples(queries.QUERIES["op12_trie_pairs"](spark, small)) == expected and any(row[1] for row in expected)


def test_variants_of_odd_rows(odd, none):
    counted = trie_pairs.word_counts(odd, queries._misspelt)
    assert dict(map(tuple, counted.collect())) == misspelt_counts([p[:2] for p in odd_pairs()])
    assert tuples(trie_pairs.spelling_variants(trie_pairs.word_counts(none))) == []
    with pytest.raises(ValueError):
        trie_pairs.spelling_variants(counted, 1)


def test_groups_are_bounded_by_the_alphabet(spark):
    """One replaced letter: a group holds as many words as there are letters, never all near pairs of a frequent word's variants."""
    counts = {"variant"[:k] + c + "variant"[k + 1:]: 2 for k in range(7) for c in "abcdefghijklmnopqrstuvwxyz"} | {"variant": 500}
    words = trie_pairs.numbered(frame(spark, counts), "word")
    from pyspark.sql import functions as F
    back = trie_pairs.numbered(words.select(F.reverse("word").alias("drow"), F.col("number").alias("_of")), "drow")
    pairs = trie_pairs._pairs(words.join(back.select(F.col("_of").alias("number"), F.col("path").alias("back")), "number"))
    assert pairs.groupBy("before", "behind").count().agg(F.max("count")).first()[0] <= 27


# 13

def term_list(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, k=10):
    found = [(doc_id, Counter(term_list(t)), len(term_list(t))) for doc_id, t in docs]
    found = [d for d in found if d[2]]
    n_docs, n_terms, df, out = len(found), sum(d[2] for d in found), Counter(t for d in found for t in d[1]), []
    for item_id, text in items:
        best = []
        for doc_id, tf, n in found:
            m, score = 25 + (75 * n * n_docs) // n_terms, 0
            for term in term_list(text):
                if tf[term]:
                    score += floor(1000 * log((2 * n_docs + 2) / (2 * df[term] + 1))) * (10**9 * tf[term] // (1000 * tf[term] + 8 * m))
            if score > 0:
                best.append((-score, doc_id is not None, doc_id or 0))
        out += [(item_id, rank, doc if known else None, -score) for rank, (score, known, doc) in enumerate(sorted(best)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "alpha1 beta22 ALPHA1 gamma"), (2, None), (3, "  ... "), (4, "ÉTÉ été Été"), (5, "one"), (6, "nowhere to-be found"), (7, prose(2, 200)), (8, "日本語。テスト"),
         (9, "the " * 50), (5, "two one"), (None, "kappa7 kappa7 nu8")]


def items_of(spark, items):
    return spark.createDataFrame([Row(item_id=i, text=t, doc_id=-1, score=None) for i, t in items], "item_id long, text string, doc_id long, score long")


@pytest.mark.parametrize("items_a_block,cells", [(4096, 4_000_000), (2, 7)])
def test_ranking_of_odd_rows(spark, odd, monkeypatch, items_a_block, cells):
    monkeypatch.setattr(automaton_search, "BLOCK_ITEMS", items_a_block)
    got = automaton_search.ranked_documents(odd, items_of(spark, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked([p[:2] for p in odd_pairs()], ITEMS)


def test_ranking_of_documents(spark, small, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = queries.QUERIES["op13_automaton_scan"](spark, small)
    assert sorted(map(tuple, got.collect()), key=str) == ranked([(r.doc_id, r.text) for r in documents.collect()], items)


def test_guards_keep_terms_whole(spark):
    docs = [(1, "cat catalog con-cat"), (2, "concat scatter"), (3, "CAT.cat,cat"), (4, "cat1 1cat"), (5, "çat")]
    items = [(1, "cat"), (2, "at c")]
    got = automaton_search.ranked_documents(rows_of(spark, docs), items_of(spark, items))
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items) and {r.doc_id for r in got.collect()} == {1, 3}


def test_ties_fall_to_the_smaller_document(spark):
    docs = [(k, "same words here") for k in range(40, 0, -1)] + [(100, "other")] * 50
    got = automaton_search.ranked_documents(rows_of(spark, docs), items_of(spark, [(1, "words")]))
    assert [r.doc_id for r in got.orderBy("rank").collect()] == list(range(1, 11))


def test_no_ranking_of_nothing(spark, odd, none):
    assert automaton_search.ranked_documents(none, items_of(spark, ITEMS)).count() == 0
    assert automaton_search.ranked_documents(odd, items_of(spark, [])).count() == 0


# 2

def test_pairs_at_the_threshold_become_candidates():
    """4,000 pairs of sets at a similarity of exactly 0.8: the share that no band or too few darts find."""
    import numpy as np
    from depotlens.llm import near_dedup
    from depotlens.llm.dart_minhash import signatures
    rng, missed, pairs = np.random.default_rng(11), 0, 4000
    for _ in range(pairs // 500):
        shared, own = rng.integers(0, 1 << 63, (500, 80), dtype=np.uint64), rng.integers(0, 1 << 63, (2, 500, 10), dtype=np.uint64)
        sets = np.concatenate([np.concatenate([shared, x], axis=1) for x in own])
        darts = signatures(np.repeat(np.arange(1000), 90), sets.reshape(-1), np.ones(sets.size), 1000, near_dedup.DARTS)
        same = darts[:500] == darts[500:]
        band = same[:, :near_dedup.BANDS * near_dedup.ROWS].reshape(500, near_dedup.BANDS, near_dedup.ROWS).all(axis=2).any(axis=1)
        missed += int((~band | (same.sum(axis=1) < near_dedup.AGREE)).sum())
    assert missed / pairs < 0.006


def copies_of(seed, n, copies, edits):
    """A text and copies of it, each with other words in some places."""
    import random
    words, out = prose(seed, n).split(), []
    for k in range(copies):
        r = random.Random(1000 * seed + k)
        own = list(words)
        for at in r.sample(range(n), edits):
            own[at] = f"other{seed}x{k}x{at}"
        out.append(" ".join(own))
    return [" ".join(words), *out]


@pytest.mark.parametrize("tile", [512, 4])
def test_copies_of_one_text_meet_through_it(spark, monkeypatch, tile):
    """Copies are similar to their origin and, mostly, not to each other; tiles of any size give the same classes."""
    from depotlens.llm import near_dedup
    from .test_operators import classes_of
    monkeypatch.setattr(near_dedup, "TILE", tile)
    pairs = list(enumerate(copies_of(1, 300, 40, 6) + copies_of(2, 200, 25, 5) + copies_of(3, 150, 10, 20)))
    got = near_dedup.near_duplicates(rows_of(spark, pairs))
    assert sorted(map(tuple, got.collect()), key=str) == classes_of(pairs)
