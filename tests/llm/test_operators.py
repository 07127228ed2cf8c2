"""Operators on odd rows and on whole small tables, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from depotlens.llm import (
    components, decontamination, html_extraction, mixing, near_dedup, ppm, quality, sentence_dedup, suffix_dedup, token_files, topk)
from depotlens.llm.queries import tokenizer_file

from .conftest import odd_pairs, prose, rows_of
from .test_parts import PlainPPM, covered


ODD = [p[:2] for p in odd_pairs()]


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_text(rows, column="doc_id"):
    return sorted(rows, key=lambda r: str(r[column]))


# 1


def removed_of(pairs, n):
    texts = [(t or "").encode() for _, t in pairs]
    out = []
    for (doc_id, _), t, mask in zip(pairs, texts, covered(texts, n)):
        kept = bytes(b for b, m in zip(t, mask) if not m)
        edges = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()) if len(t) else 0
        out.append((doc_id, len(t), int(mask.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,chunk", [(400, 8 << 20), (50, 2000), (30, 700)])
def test_repeated_strings_on_odd_rows(odd, length, chunk):
    got = suffix_dedup.repeat_digests(odd, length=length, chunk_bytes=chunk)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == removed_of(ODD, length)


def test_repeated_strings_on_documents(documents):
    got = suffix_dedup.repeat_digests(documents, chunk_bytes=100_000)
    assert sorted(map(tuple, got.collect()), key=str) == removed_of(pairs_of(documents), 400)


def test_remaining_bytes(spark):
    shared = prose(9, 60)
    docs = rows_of(spark, [(1, "left " + shared), (2, shared + " right")])
    rows = {r.doc_id: r for r in suffix_dedup.without_repeats(docs, length=100).collect()}
    assert bytes(rows[1].kept) == b"left " and rows[1].removed == [[5, 5 + len(shared)]]
    assert bytes(rows[2].kept) == b" right"


def test_repeated_strings_of_nothing(none):
    assert suffix_dedup.repeat_digests(none).count() == 0


def boilerplate_pairs(size):
    """Texts around one passage, most of which go on in their own way; some come in twos."""
    passage = "".join(hashlib.sha256(bytes([k])).hexdigest() for k in range(10))[:size]
    return [(k, prose(100 + k // 2 if k > 50 else 300 + k, 40) + passage + prose(500 + k // 2 if k > 50 else 700 + k, 60)) for k in range(60)]


@pytest.mark.parametrize("size", [250, 390, 450, 590])
def test_a_part_does_not_get_an_entry_of_every_text_with_a_passage(spark, monkeypatch, size):
    docs, sent = rows_of(spark, boilerplate_pairs(size)), Counter()
    merge = suffix_dedup._ranges

    def watched(runs, parts, length):
        for r in runs.collect():
            for _, text, (_, _, places) in suffix_dedup._Run(r.chunk, bytes(r.data)):
                sent[text[:201]] += len(places)
        return merge(runs, parts, length)

    monkeypatch.setattr(suffix_dedup, "_ranges", watched)
    got = suffix_dedup.repeat_digests(docs, chunk_bytes=3000, hot=20)
    assert sorted(map(tuple, got.collect()), key=str) == removed_of(pairs_of(docs), 400)
    assert max(sent.values()) <= 20


@pytest.mark.parametrize("hot", [1, 3])
def test_repeated_strings_at_hot_prefixes(odd, hot):
    got = suffix_dedup.repeat_digests(odd, length=50, chunk_bytes=2000, hot=hot)
    assert sorted(map(tuple, got.collect()), key=str) == removed_of(ODD, 50)


def test_strings_of_one_hash_are_told_apart(spark, monkeypatch):
    exact = suffix_dedup._hot_ranges
    monkeypatch.setattr(suffix_dedup, "_hot_ranges", lambda strings, parts, length: exact(strings, parts, length, bits=10))
    docs = rows_of(spark, boilerplate_pairs(450)[45:])
    got = suffix_dedup.repeat_digests(docs, chunk_bytes=3000, hot=2)
    assert sorted(map(tuple, got.collect()), key=str) == removed_of(pairs_of(docs), 400)


# 2


def multiset(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(words))
    return Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def classes_of(pairs):
    sets = [multiset(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if sets[i] and sets[j]:
                shared = sum((sets[i] & sets[j]).values())
                if shared >= 0.8 * sum((sets[i] | sets[j]).values()):
                    parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(pairs)):
        groups[root(i)].append(i)
    out = []
    for members in groups.values():
        ids = [pairs[i][0] for i in members if pairs[i][0] is not None]
        out += [(pairs[i][0], min(ids, default=None), len(members)) for i in members]
    return sorted(out, key=str)


def test_near_duplicates_on_odd_rows(odd):
    assert sorted(map(tuple, near_dedup.near_duplicates(odd).collect()), key=str) == classes_of(ODD)


def test_near_duplicates_on_documents(documents):
    assert sorted(map(tuple, near_dedup.near_duplicates(documents).collect()), key=str) == classes_of(pairs_of(documents))


def test_chains_of_near_duplicates(spark):
    """Neighbours are similar, ends are not; and passages that many texts share link none of them."""
    words = prose(4, 300).split()
    chain = []
    for k in range(12):
        words = [*words[:20 * k], *(f"new{k}x{i}" for i in range(12)), *words[20 * k + 12:]]
        chain.append((k, " ".join(words)))
    shared = prose(5, 60)
    apart = [(100 + k, shared + " " + prose(200 + k, 50)) for k in range(40)]
    got = near_dedup.near_duplicates(rows_of(spark, chain + apart))
    assert sorted(map(tuple, got.collect()), key=str) == classes_of(chain + apart)


def test_one_row_of_each_class_stays(odd, none):
    kept = near_dedup.one_per_class(odd)
    assert kept.columns == odd.columns
    pairs = odd_pairs()
    wordless = sum(not multiset(t) for _, t, _ in pairs)
    texts = {(c, n) for (d, c, n), (i, t) in zip(classes_of([p[:2] for p in pairs]), sorted(((p[0], p[1]) for p in pairs), key=str)) if multiset(t)}
    assert kept.where("text is null or not text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").count() == wordless
    assert kept.count() <= len(texts) + wordless + 2
    assert near_dedup.one_per_class(none).count() == 0 and near_dedup.near_duplicates(none).count() == 0


def test_whole_rows_are_exchanged_once(spark):
    words = [f"w{k}" for k in range(60)]
    one, near, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(words[::-1])
    rows = [(None, one, "a"), (5, one, "b"), (3, near, "c"), (3, near, "c"), (9, other, "d"), (None, other, "e"), (7, " ", "f"), (7, None, "g"), (None, "alone", "h")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = near_dedup.one_per_class(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        plan = kept._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        got = sorted(map(tuple, kept.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted([(3, near, "c"), (9, other, "d"), (7, " ", "f"), (7, None, "g"), (None, "alone", "h")], key=str)
    assert plan.count("Exchange hashpartitioning(") == 2  # rows by their text, keys


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (5, 5), (4, 1), (20, 21), (22, 21), (23, 22), (24, 23)], "a long, b long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    assert components.components(edges.limit(0)).count() == 0


# 3


def encoded(pairs):
    from tokenizers import Tokenizer
    t, start, out = Tokenizer.from_file(tokenizer_file()), 0, []
    rows = [(d, t.encode(x or "", add_special_tokens=False).ids + [2]) for d, x in pairs]
    return rows, start, out


def test_token_files_on_documents(spark, documents):
    folder = token_files.write_documents(documents, tokenizer_file(), 2)
    got = {r.doc_id: r for r in token_files.token_digests(spark, folder).collect()}
    ids = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in token_files.read_tokens(spark, folder).collect()}
    start = 0
    for doc_id, want in sorted(encoded(pairs_of(documents))[0]):
        r = got[doc_id]
        assert ids[doc_id] == want
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


SPACES = [(1, "a  b   c\n\nd \n e\tf\r\ng"), (2, " lead and trail "), (3, "it's we'll <|endoftext|> x"), (4, "nb sp   em\x1c!\x0b"),
          (5, "123 45.6 !!??  (x)"), (6, "\n"), (7, "日本 語\nété 𝔘🙂 🙂"), (8, "a\n"), (9, "\na b")]


def test_odd_texts_are_encoded_as_by_the_tokenizer(spark):
    from tokenizers import Tokenizer
    encode = Tokenizer.from_file(tokenizer_file()).encode
    with open(tokenizer_file(), encoding="utf-8") as f:
        fast = token_files.TextEncoder(f.read())
    texts = [text for _, text in SPACES] + [t or "" for _, t, _ in odd_pairs()] + ["a.b,c 3.14! x1.é é.x 'tis a's,b", "U.S.A. $5.00 (50%) #1 &co;"]
    for some in (texts, texts[::-1], [""], ["", "a"]):
        for text, ids in zip(some, fast(some)):
            assert ids.tolist() == encode(text, add_special_tokens=False).ids, text


class Counted:
    """A tokenizer that notes how many texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_new_words_are_encoded_together():
    from tokenizers import Tokenizer
    encode = Tokenizer.from_file(tokenizer_file()).encode
    with open(tokenizer_file(), encoding="utf-8") as f:
        fast = token_files.TextEncoder(f.read())
    fast.tokenizer = counted = Counted(fast.tokenizer)
    texts = [" ".join(f"wö{k}rd{k * k}" for k in range(low, low + 500)) for low in range(0, 3000, 500)]
    for text, ids in zip(texts, fast(texts)):
        assert ids.tolist() == encode(text, add_special_tokens=False).ids
    assert counted.texts < 100  # of 3,000 words
    # A vocabulary that does not name all bytes: words are encoded one by one.
    fast.known.clear()
    fast.widths[:] = 0
    for text, ids in zip(texts, fast(texts)):
        assert ids.tolist() == encode(text, add_special_tokens=False).ids
    assert counted.texts > 3000


def test_token_files_on_odd_rows(spark, odd, none):
    folder = token_files.write_documents(odd, tokenizer_file(), 2)
    rows = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((p[0] for p in odd_pairs()), key=lambda x: (x is not None, x))
    want = Counter(tuple(ids) for _, ids in encoded([p[:2] for p in odd_pairs()])[0])
    assert Counter(tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in rows) == want
    starts = np.cumsum([0] + [len(r.ids) // 4 for r in rows])[:-1]
    assert [r.start for r in rows] == starts.tolist()
    assert token_files.token_digests(spark, token_files.write_documents(none, tokenizer_file(), 2)).count() == 0


# 4


def test_mix_on_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(odd_pairs())
    sizes = {(r.doc_id, r["size"]) for r in rows}
    assert (3, 0) in sizes and (10, 1) in sizes
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    for own in by_source.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    again = Counter(map(tuple, mixing.mix(odd.repartition(5)).collect()))
    assert again == Counter(map(tuple, rows))
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_targets_stop_at_three_times_their_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0), (None, 5)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # a (weight 5) is capped at 30; d (5) has no words; null (2) is capped at 15; b and c share the rest 2 to 1.
    assert got["a"] == 30 and got["d"] == 0 and got[None] == 15
    assert got["b"] == pytest.approx(1970 * 2 / 3) and got["c"] == pytest.approx(1970 / 3)


def test_mixed_rows_are_those_taken(documents):
    taken = {r.doc_id: r.copies for r in mixing.mix(documents).collect()}
    rows = mixing.mixed_documents(documents)
    assert rows.columns == documents.columns
    assert Counter(r.doc_id for r in rows.collect()) == Counter({d: n for d, n in taken.items() if n})


def test_one_source_hits_its_target_closely(spark):
    docs = rows_of(spark, [(k, prose(k, 20 + k % 50), "ab"[k % 2]) for k in range(400)])
    rows = mixing.mix(docs).collect()
    for source in "ab":
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2


# 5


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.85


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (5, 1, 0), (77, 1, 0), (6, None, None), (None, 1, 1), (7, 3, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == len(odd_pairs()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert {r.doc_id: r.held_out for r in rows if r.doc_id}[1] == (zlib.crc32(b"1") % 5 == 0)
    same = {r.score for r in rows if r.doc_id in (3, 4)}
    assert len(same) == 1
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0
    assert quality.accepted(odd, labels).columns == odd.columns


# 6


def test_scores_on_odd_rows(odd, none):
    pairs = odd_pairs()
    trains = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    rows = ppm.ppm_scores(odd, trains, chunk_bytes=5000).collect()
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    texts = [((p[1] or "").encode().translate(lower), p[0] is None or p[0] % 3 != 0) for p in pairs]
    plain = PlainPPM([t for t, train in texts if train])
    tokens = Counter(w for t, train in texts if train for w in [*t.split(), None])
    n, v = sum(tokens.values()), len(tokens)
    want = []
    for (doc_id, _, _), (t, train) in zip(pairs, texts):
        own = [*t.split(), None]
        base = sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want.append((str(doc_id), train, len(own), sum(tokens[w] > 0 for w in own), n, round(base, 5), round(plain.score(t), 2)))
    got = [(str(r.doc_id), r.trained, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 2)) for r in rows]
    assert sorted(got) == sorted(want)
    assert ppm.ppm_scores(none, trains).count() == 0


def test_untrained_scores(odd):
    rows = ppm.ppm_scores(odd, F.lit(False)).collect()
    assert all(r.score == pytest.approx(-(len((t or "").encode()) + 1) * math.log10(257), rel=1e-5)
               for r, t in zip(by_text(rows), [p[1] for p in sorted(odd_pairs(), key=lambda p: str(p[0]))]) if r.doc_id not in (None, 1, 5))


def test_held_out_documents_are_predicted(spark):
    """Below 2.5 bits a byte with a thousand documents; a byte model without contexts needs more than 4."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = ppm.ppm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1).where("not trained")
    rows = scored.join(docs.select("doc_id", F.octet_length("text").alias("n")), "doc_id").collect()
    assert -sum(r.score for r in rows) * math.log2(10) / sum(r.n + 1 for r in rows) < 2.5


# 7


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def best_of(rows, k=5, every=50):
    import struct
    usable = []
    for vec_id, v, _ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((vec_id, [math.floor(256 * struct.unpack("f", struct.pack("f", x))[0]) for x in v]))
    out = []
    for q, a in usable:
        if q is not None and q % every == 0:
            scores = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0, i) for i, b in usable if i != q]
            out += [(q, n, x[3], -x[0]) for n, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def test_topk_on_odd_rows(spark):
    r = np.random.default_rng(2)
    rows = [(k, r.normal(size=8).tolist(), 0) for k in range(120)]
    rows += [(200, rows[0][1], 1), (201, None, 0), (250, [1.0, None] + [0.0] * 6, 0), (251, [math.nan] * 8, 0), (252, [math.inf] * 8, 0),
             (300, [0.0] * 8, 0), (None, [0.5] * 8, 0), (301, [], 0), (302, [9.0], 0), (303, [9.0], 0), (303, [9.0], 0), (350, [1e9] * 8, 0), (351, [-1e9] * 8, 0)]
    got = topk.nearest_vectors(vectors_of(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == best_of(rows)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_topk_of_few_and_none(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, 0.0], 0)]
    assert [tuple(r) for r in topk.nearest_vectors(vectors_of(spark, rows)).collect()] == [(0, 1, 1, 256 * 256)]
    assert topk.nearest_vectors(vectors_of(spark, [])).count() == 0


def test_blocks_of_queries_do_not_change_results(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(k, r.normal(size=16).tolist(), 0) for k in range(300)]
    whole = sorted(map(tuple, topk.nearest_vectors(vectors_of(spark, rows), every=10).collect()), key=str)
    monkeypatch.setattr(topk, "BLOCK", 7)
    assert sorted(map(tuple, topk.nearest_vectors(vectors_of(spark, rows), every=10).collect()), key=str) == whole == best_of(rows, every=10)


# 8


def article(html):
    """Main text of a page whose article holds headings, paragraphs, bold text and line breaks only."""
    from html import unescape
    inside = re.search(r"<article>(.*)</article>", html, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"</?b>|<br>", " " if False else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


COMMENTS = "".join(f"<div class='comment'><p>Reader {k} says that this was a long day, and that nothing of it will be forgotten soon.</p></div>" for k in range(20))
STORY = "".join(f"<p>Paragraph {k} of the story tells, in some more words, what happened on that day and why it matters.</p>" for k in range(4))
HEAD = "<h1>What happened</h1>"


@pytest.mark.parametrize("body", [
    f"<article>{HEAD}{STORY}<section class='comments'>{COMMENTS}</section></article>",
    f"<article>{HEAD}{STORY}<section class='comments'>{COMMENTS[:COMMENTS.index('</div>') + 6]}</section></article>",
    f"<article>{HEAD}{STORY}</article><div id='comments'>{COMMENTS}</div>",
    f"<div class='content'>{HEAD}{STORY}</div><div class='comments'>{COMMENTS}</div>",
    f"<article>{HEAD}{STORY}<div class='cookie notice'><p>{'We keep cookies, as the law allows us to do. ' * 40}</p></div></article>",
    f"<div class='page with-menu'><article>{HEAD}{STORY}</article><div class='comments'>{COMMENTS}</div></div>",
    f"<form id='all'><div class='share-root'><article>{HEAD}{STORY}<ol class='commentlist'>{COMMENTS}</ol></article></div></form>",
])
@pytest.mark.parametrize("classes", ["", " class='single has-sidebar comments-open'"])
def test_long_furniture_is_left_out_and_named_wrappers_are_kept(spark, small_model, body, classes):
    html = f"<html><body{classes}><nav><a href='/'>Home</a> <a href='/b'>More</a></nav>{body}<footer>All rights reserved 2024</footer></body></html>"
    got = html_extraction.extract(spark.createDataFrame([(html,)], "html string"), small_model).first()
    expected = [" ".join(re.sub("<[^>]*>", "", x).split()) for x in (HEAD + STORY).replace("</", "\n</").split("\n")]
    assert got.text == "\n".join(x for x in expected if x)


@pytest.fixture(scope="module")
def small_model(spark):
    return html_extraction.fit_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_fit_samples_are_bounded_in_bytes(spark, small, documents):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    assert html_extraction.fit_pages(pages, rows=1) == html_extraction.fit_pages(pages, most_bytes=1) != html_extraction.fit_pages(pages, rows=5)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    few, one, all_ = (quality.fit_quality(documents, labels, most_bytes=n) for n in (30_000, 1, 1 << 30))
    assert few.score([b"some text"]) != all_.score([b"some text"]) and one is not None


def test_pages_of_the_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in html_extraction.main_texts(pages).collect()}
    for p in pages.collect():
        assert got[p.page_id].text == article(p.html) and got[p.page_id].url == p.url
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


FURNITURE = """<html><head><title>A title</title></head><body><header><h2>Site name</h2></header><div id="cookie-notice">We use cookies.</div>
<nav><a href="/">Home</a> <a href="/b">News</a></nav><article class="post"><h1>Heading &amp; more</h1><p>First paragraph of the text, with words.</p>
<aside class="related"><p>Read this too</p></aside><p>Second&nbsp;paragraph,   spread
over lines.</p><div class="ad">Buy now</div><ul><li>An item of the text.</li></ul><form><label>Mail</label><button>Send</button></form>
<section class="comments"><p>A reader wrote this.</p></section></article><div class="sidebar"><p>Side words here</p></div><footer>&copy; 2020</footer></body></html>"""


def test_furniture_inside_and_around_an_article(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    model = html_extraction.fit_pages(pages)
    text = "Heading & more\nFirst paragraph of the text, with words.\nSecond paragraph, spread over lines.\nAn item of the text."
    for html in (FURNITURE, FURNITURE.replace("<article class=\"post\">", "<main>").replace("</article>", "</main>"),
                 FURNITURE.replace("<article class=\"post\">", "<div class='post'>").replace("</article>", "</div>")):
        got = html_extraction.extract(spark.createDataFrame([(html,)], "html string"), model).first()
        assert got.text == text


WRAPPED = [
    ("<body>", "<body class='single has-sidebar'>"), ("<body>", "<body id='page-with-menu'><div class='page with-menu'>"),
    ("<body>", "<body><div id='share-root'>"), ("<body>", "<body><form action='/x'>"), ('class="post"', 'class="post has-comments"'),
    ('<article class="post">', '<article class="post"><div class="entry with-tags">')]


@pytest.mark.parametrize("fit", ["small", "wrapped"])
def test_names_and_forms_around_the_whole_page(spark, small, fit):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    if fit == "wrapped":
        pages = pages.withColumn("html", F.regexp_replace("html", "<body>", "<body class='has-sidebar'><form>"))
    model = html_extraction.fit_pages(pages)
    text = "Heading & more\nFirst paragraph of the text, with words.\nSecond paragraph, spread over lines.\nAn item of the text."
    more = "".join(f"<p>Paragraph {k} goes on for some more words, and then it ends.</p>" for k in range(9))
    page = FURNITURE.replace("<aside class=\"related\">", more + "<aside class=\"related\">")
    text = text.replace("words.\nSecond", "words.\n" + "".join(f"Paragraph {k} goes on for some more words, and then it ends.\n" for k in range(9)) + "Second")
    for old, new in WRAPPED:
        for html in (page, page.replace("<article", "<main").replace("</article>", "</main>")):
            old_, new_ = (x if "<article" in html else x.replace("<article", "<main") for x in (old, new))
            assert old_ in html
            got = html_extraction.extract(spark.createDataFrame([(html.replace(old_, new_),)], "html string"), model).first()
            assert got.text == text, new_


def test_odd_pages(spark, small):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>"), (3, "u", "<article><p>open <b>text"), (3, "u", "<article><p>open <b>text"),
            (4, "u", "</div></p><article>" + "<p>long words here</p>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    got = html_extraction.main_texts(pages).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got if r.page_id in (1, 2)} == {1: "", 2: ""}
    assert [r.text for r in got if r.page_id == 3] == ["open text"] * 2
    assert next(r for r in got if r.page_id == 4).text == "\n".join(["long words here"] * 3000)
    assert html_extraction.main_texts(pages.limit(0)).count() == 0


# 9


def test_contamination_on_odd_rows(spark, odd, none):
    words = prose(2, 200).replace(".", "").split()
    items = spark.createDataFrame(
        [(1, " ".join(words[30:60]), 0), (2, "One", 0), (3, None, 0), (4, "", 0), (None, "été " * 12, 0), (1, "Tau UPSILON", 0), (5, "!!!", 0)],
        "item_id long, text string, n_words int")
    rows = decontamination.contamination(odd, items).collect()
    assert len(rows) == len(odd_pairs())
    one = [r for r in rows if r.doc_id == 1]
    assert len(one) == 2 and all(r.n_hit == 30 and r.n_items == 1 and r.items_sha256 == hashlib.sha256(b"1").hexdigest() for r in one)
    eté = next(r for r in rows if r.doc_id == 7)
    assert eté.n_hit == eté.n_words == 300 and eté.items_sha256 == hashlib.sha256(b"").hexdigest() and eté.n_items == 1
    assert {r.doc_id: (r.n_words, r.n_hit) for r in rows if r.doc_id in (3, 4, 10, 11)} == {3: (0, 0), 4: (0, 0), 10: (1, 1), 11: (1, 1)}
    blocks = decontamination.contamination(odd, items, block_bytes=30, shard_bytes=900).collect()
    assert Counter(map(tuple, blocks)) == Counter(map(tuple, rows))
    assert decontamination.contamination(none, items).count() == 0
    clean = decontamination.contamination(odd, items.limit(0)).collect()
    assert not any(r.contaminated for r in clean) and {r.doc_id: r.n_words for r in clean}[10] == 1


def test_spans_are_cut_until_none_is_left(spark):
    item = prose(7, 24)
    words = item.split()
    docs = rows_of(spark, [(1, "Before it, " + item + " after it."), (2, "clean words only"), (3, " ".join(words[:9]) + " " + item + " " + " ".join(words[9:12])), (4, None)])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.decontaminate(docs, items).collect()}
    assert rows[1].text == "Before it, \n after it." and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == "clean words only" and rows[4].text is None
    left = decontamination.contamination(decontamination.decontaminate(docs, items), items)
    assert left.where("contaminated").count() == 0 and set(decontamination.decontaminate(docs, items).columns) == set(docs.columns)


# 10


def plain_sentences(text):
    """Sentences cut character by character: after marks before white space, after wide marks that no mark follows, after line breaks."""
    out, start, k = [], 0, 0
    while k < len(text):
        white = lambda j: j < len(text) and text[j].isspace()  # noqa: E731, B023
        end = None
        if text[k] in ".!?" and white(k + 1):
            end = k + 1
        elif text[k] in "。！？" and not (k + 1 < len(text) and text[k + 1] in ".!?。！？」』”’）)"):
            end = k + 1
        elif white(k) and "\n" in text[k:next((j for j in range(k, len(text)) if not white(j)), len(text))]:
            end = k
        if end is None:
            k += 1
            continue
        while white(end):
            end += 1
        if end > start:
            out.append((start, end))
        start = k = max(end, k + 1)
    return out + ([(start, len(text))] if start < len(text) else [])


def n_words(text):
    return max(len(text.split()), sum("\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" for c in text))


def plain_spans(text):
    """The sentences of every run of three, and of the shortest runs from and to each sentence with 50 words, if they are shorter."""
    parts = [text[a:b] for a, b in plain_sentences(text)]
    count = [n_words(p) for p in parts]
    full = lambda a, b: sum(count[a:b]) >= 50
    runs = set()
    for k in range(len(parts)):
        runs |= {(k, b) for b in range(k + 1, len(parts) + 1) if full(k, b) and not any(full(k, c) for c in range(k + 1, b))}
        runs |= {(a, k + 1) for a in range(k + 1) if full(a, k + 1) and not any(full(c, k + 1) for c in range(a + 1, k + 1))}
    runs = {(a, b) for a, b in runs if b - a < 3} | {(a, a + 3) for a in range(len(parts) - 2)}
    return {(a, b): tuple(" ".join(p.split()) for p in parts[a:b]) for a, b in runs}


def sentence_removal(pairs):
    known = {text: plain_spans(text) for _, text in pairs if text}
    first = {}
    for key in sorted({(d is None, d or 0, sentence_key(t), t) for d, t in pairs if t}, key=lambda x: x[:3]):
        for (a, _), said in sorted(known[key[3]].items()):
            first.setdefault(said, (*key[:3], a))
    out = []
    for d, text in pairs:
        places = plain_sentences(text or "")
        gone = {k for (a, b), said in known.get(text, {}).items() if first[said] != (d is None, d or 0, sentence_key(text), a) for k in range(a, b)}
        kept = "".join(text[s:e] for k, (s, e) in enumerate(places) if k not in gone) if text else ""
        out.append((d, len(places), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def sentence_key(text):
    import xxhash
    return xxhash.xxh3_64_intdigest(text or "") - (1 << 63)


SHORT = "It is. So it goes. Not here. "
HAN = ["今日は天気がいい。散歩に行きましょう！本当に？はい。", "他很高兴地走了。我们没有去。明天再说。"]


def test_short_and_wide_sentences(spark):
    pairs = [(1, "First text here. " + SHORT + "Its own end."), (2, "Another start! " + SHORT + "And more words.\nLine two"), (3, SHORT.strip()),
             (4, "最初の文です。" + HAN[0] + "終わり。"), (5, "別の文から始まる。" + HAN[0] + "最後。"), (6, HAN[1] + "独自。"), (7, "開頭。" + HAN[1]),
             (8, "界" * 60 + "。短い。"), (9, "前。" + "界" * 60 + "。別。"), (10, "One. Two"), (11, "One. Two"), (12, "「彼は来た。」と言った。そうだ。"), (13, "\n\n a.\n\nb? c!d e!\t f\n")]
    rows = {r.doc_id: r for r in sentence_dedup.sentence_dedup(rows_of(spark, pairs)).collect()}
    assert sorted(((r.doc_id, r.n_sentences, r.n_removed, r.kept_sha256) for r in rows.values()), key=str) == sentence_removal(pairs)
    assert rows[2].n_removed >= 3 and rows[3].n_removed == 3 and rows[5].n_removed >= 4 and rows[7].n_removed == 3 and rows[9].n_removed >= 1
    assert rows[11].n_removed == 0


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_sentence_spans(request, which):
    docs = request.getfixturevalue(which)
    pairs = pairs_of(docs)
    got = sentence_dedup.sentence_dedup(docs).collect()
    assert sorted(((r.doc_id, r.n_sentences, r.n_removed, r.kept_sha256) for r in got), key=str) == sentence_removal(pairs)


def test_a_shared_passage_stays_in_its_first_document(spark, none):
    passage = " ".join(f"word{k}" + ("." if k % 11 == 10 else "") for k in range(66))
    docs = rows_of(spark, [(3, "Own start. " + passage + " Own end."), (1, "Other one. " + passage + " Other end."), (2, "Short. Text. Here.")])
    rows = {r.doc_id: r for r in sentence_dedup.without_repeats(docs).collect()}
    assert rows[1].kept_text == rows[1].text and rows[2].kept_text == "Short. Text. Here."
    assert rows[3].kept_text == "Own start. Own end."
    assert sentence_dedup.sentence_dedup(none).count() == 0
