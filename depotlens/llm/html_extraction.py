"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

A block is described by the elements above it, the words of their class, id and role attributes, and its text: length, share
of links, digits, capitals, punctuation, place in the page. Labels form a chain of main text and other; weights of features
and of label pairs are learned by maximum likelihood (forward-backward, Adam) and pages are decoded by Viterbi.

Furniture names, and forms, tell nothing on an element that holds the page or its article, such as a body with class
``has-sidebar``, so they are taken off there (``unwrapped``), for learning and for decoding.

Labelled pages come from the table: on at most ``FIT_PAGES`` pages (those of the least hash) that mark up one article, what
is inside it is main text unless an element around it is of a kind that is not (``OTHER_TAGS``, ``OTHER_NAMES``). So that
text and names count as well, each is learned from four times: as it is, with furniture of other pages set into and around
its article and some of its blocks in other elements, with its article named differently, and without names. Decoding reads every page in a task that only holds the
model.

Defined cases: null or empty html, and a page on which no block is main text, give an empty text; markup that is not closed or
not opened ends with its surroundings; without any labelled page the model is learned from built-in ones, which mark up the
furniture kinds alone; other columns are not read, and repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import raw, slices
from .dom import INLINE, Block, blocks

FIT_PAGES = 300
FIT_BYTES = 64 << 20
EPOCHS, BATCH, RATE, DECAY = 25, 16, 0.1, 1e-4
SLICE_BYTES = 4 << 20

# Elements and names that mark what is not main text.
OTHER_TAGS = frozenset("head title nav header footer aside form menu button select option label input textarea dialog".split())
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification "
    "alert popup modal overlay newsletter subscribe signup login comment comments commentlist respond reply replies disqus "
    "sidebar side related recommended more share sharing social follow menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager toolbar footer header masthead copyright legal widget tags toc".split())
# Of these names, those of what others than the page's author write or the site puts before readers.
FOREIGN = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification "
    "alert popup modal overlay newsletter subscribe signup login comment comments commentlist respond reply replies disqus".split())
# Words that furniture commonly holds, for learned pages.
_FURNITURE = [
    ("aside", "sidebar"), ("aside", ""), ("div", "sidebar"), ("div", "ad"), ("div", "advert"), ("section", "comments"),
    ("div", "comment"), ("ol", "commentlist"), ("div", "cookie notice"), ("div", "notice"), ("div", "banner"), ("form", ""),
    ("div", "newsletter"), ("div", "share social"), ("div", "related"), ("nav", ""), ("header", ""), ("footer", ""), ("ul", "menu"),
]
_ARTICLES = [(("main",), ()), (("div",), ("content",)), (("div",), ("article", "body")), (("div",), ("post",)), (("section",), ("entry",)), (("main", "article"), ())]
_LEAVES = [("ul", "li"), ("ol", "li"), ("div",), ("h2",), ("h3",), ("blockquote", "p"), ("section", "p"), ("table", "tr", "td"), ("pre",), ("div", "p"), ("figure", "figcaption")]
_BUILT_IN = "<html><head><title>t</title></head><body><nav>a b</nav><article><h1>One day</h1><p>It was a day, and so on.</p></article><footer>c d</footer></body></html>"


def is_other(tags, names) -> bool:
    return bool(OTHER_TAGS & set(tags)) or bool(OTHER_NAMES & set(names))


def unwrapped(page: list[Block]) -> list[Block]:
    """The page without furniture names and forms on its wrappers, and without any names on html and body.

    Wrappers are html, body and all around the article: the article or main element with the most text outside links, of those that no
    ``FOREIGN`` element holds, if there are such. An element inside it, or on a page without one, is a wrapper if it holds the heading of
    the page (h1) and half of the text that is not in furniture, or nine tenths of that and half of the paragraphs. But an element that is
    named like what others write (``FOREIGN``: comments, notices, adverts) is one only if it holds the article, or, where no
    article is marked up, the h1 and paragraphs: how long it is plays no part.
    """
    article = _article(page)
    path = frozenset(k for k, _, _ in article)
    inside = [b for b in page if not article or any(k == article[-1][0] for k, _, _ in b.above)]
    size, paragraphs, titled, total, n_paragraphs = {}, {}, set(), 0, 0
    for b in inside:
        own, is_p = max(0, len(b.text) - b.linked), int("p" in b.tags)
        for k, tag, names in reversed(b.above):
            size[k], paragraphs[k] = size.get(k, 0) + own, paragraphs.get(k, 0) + is_p
            if "h1" in b.tags:
                titled.add(k)
            if tag not in ("html", "body", "form") and is_other((tag,), names):
                break  # what furniture holds does not count for what holds the furniture
        if not _foreign(b.above[len(article):]):
            total, n_paragraphs = total + own, n_paragraphs + is_p

    def wraps(k: int, tag: str, names: tuple[str, ...]) -> bool:
        if tag in ("html", "body") or k in path:
            return True
        if FOREIGN & set(names):
            return not article and k in titled and paragraphs[k] > 0
        if not total or k not in size:
            return False
        return (k in titled and 2 * size[k] >= total) or (10 * size[k] >= 9 * total and 2 * paragraphs[k] >= n_paragraphs > 0)

    out = []
    for b in page:
        if any((tag == "form" or names and (tag in ("html", "body") or OTHER_NAMES & set(names))) and wraps(k, tag, names) for k, tag, names in b.above):
            tags = tuple(t for k, t, names in b.above if t not in INLINE and not (t == "form" and wraps(k, t, names)))
            b = b._replace(tags=tags, names=tuple(n for k, t, names in b.above if t not in ("html", "body") for n in names if n not in OTHER_NAMES or not wraps(k, t, names)))
        out.append(b)
    return out


def _foreign(above: tuple) -> bool:
    """Whether an element other than html, body and a form around everything is of a kind, or named like, what is not the author's."""
    return any(tag not in ("html", "body", "form") and (tag in OTHER_TAGS or FOREIGN & set(names)) for _, tag, names in above)


def _article(page: list[Block]) -> tuple:
    """The elements from the root to the article, or nothing: (number, tag, names) of each."""
    size, found = {}, {}
    for b in page:
        for n, (k, tag, names) in enumerate(b.above):
            if tag in ("article", "main"):
                size[k] = size.get(k, 0) + max(0, len(b.text) - b.linked)
                found.setdefault(k, b.above[:n + 1])
    total = sum(max(0, len(b.text) - b.linked) for b in page if not _foreign(b.above))
    own = [k for k in found if not _foreign(found[k])]
    # Teasers are articles as well: one that has little of the page is not its article.
    large = [k for k in own if 4 * size[k] >= total > 0] or [k for k in found if 4 * size[k] >= total]
    return found[max(large, key=size.__getitem__)] if large else ()


def describe(page: list[Block]) -> list[list[str]]:
    """Features of each block of a page."""
    out, n = [], len(page)
    longest = max((len(b.text) for b in page), default=1)
    for k, b in enumerate(page):
        words, size = b.text.count(" ") + 1, len(b.text)
        data = b.text.encode()
        share = lambda chars, steps: steps * (len(data) - len(data.translate(None, chars))) // len(data)  # noqa: B023, E731
        f = ["all", f"words:{min(words.bit_length(), 9)}", f"links:{round(4 * b.linked / size)}", f"long:{round(3 * size / longest)}"]
        f.append(f"digits:{min(3, share(b'0123456789', 10))}")
        f.append(f"upper:{min(3, share(b'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 8))}")
        f.append(f"points:{min(3, share(b',.', 40))}")
        f.append(f"ends:{b.text[-1] if b.text[-1] in '.!?:;' else 'w' if b.text[-1].isalnum() else 'o'}")
        f.append(f"place:{4 * k // n}")
        f.extend(["first"] if not k else [])
        f.extend(["last"] if k == n - 1 else [])
        f.extend([w for w in ("©", "|", "»") if w in b.text])
        f.append("tag:" + (b.tags[-1] if b.tags else ""))
        f.append("over:" + "/".join(b.tags[-2:]))
        f.extend({f"in:{t}" for t in b.tags})
        f.extend({f"name:{t}" for t in b.names})
        f.extend(["other"] if is_other(b.tags, b.names) else [])
        f.extend(["article"] if {"article", "main"} & set(b.tags) and not is_other(b.tags, b.names) else [])
        out.append(f)
    return out


class Chain:
    """Weights of two labels: ``weights`` of (feature, label main), ``pairs`` of (label, next label)."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros(0)
        self.pairs = np.zeros((2, 2))

    def fit(self, pages: list[list[list[str]]], labels: list[np.ndarray]) -> None:
        for page in pages:
            for block in page:
                for f in block:
                    self.index.setdefault(f, len(self.index))
        coded = [[np.array([self.index[f] for f in block]) for block in page] for page in pages]
        n = len(self.index)
        state = np.zeros(n + 4)
        m, v, order, step = np.zeros(n + 4), np.zeros(n + 4), np.random.default_rng(5), 0
        for _ in range(EPOCHS):
            shuffled = order.permutation(len(coded))
            for at in range(0, len(coded), BATCH):
                grad = DECAY * state
                for i in shuffled[at:at + BATCH]:
                    self._add_gradient(grad, state, coded[i], labels[i], 1 / BATCH)
                step += 1
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                state -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.weights, self.pairs = state[:n], state[n:].reshape(2, 2)

    @staticmethod
    def _add_gradient(grad: np.ndarray, state: np.ndarray, page: list[np.ndarray], y: np.ndarray, scale: float) -> None:
        """Add the gradient of the negative log-likelihood, by forward and backward sums in logarithms."""
        n, pairs = len(page), state[-4:].reshape(2, 2)
        emit = np.zeros((n, 2))
        emit[:, 1] = [state[f].sum() for f in page]
        ahead, back = emit.copy(), np.zeros((n, 2))
        for k in range(1, n):
            ahead[k] += np.logaddexp(ahead[k - 1, 0] + pairs[0], ahead[k - 1, 1] + pairs[1])
            j = n - 1 - k
            back[j] = np.logaddexp(pairs[:, 0] + emit[j + 1, 0] + back[j + 1, 0], pairs[:, 1] + emit[j + 1, 1] + back[j + 1, 1])
        total = np.logaddexp(ahead[-1, 0], ahead[-1, 1])
        main = np.exp(ahead[:, 1] + back[:, 1] - total)
        for f, p, label in zip(page, main, y):
            np.add.at(grad, f, scale * (p - label))
        if n > 1:
            both = ahead[:-1, :, None] + pairs + (emit + back)[1:, None, :] - total
            expected = np.exp(both).sum(0)
            np.add.at(expected, (y[:-1], y[1:]), -1)
            grad[-4:] += scale * expected.reshape(-1)

    def ready(self) -> tuple[dict[str, float], list[list[float]]]:
        """Weights as plain numbers, for decoding."""
        return {f: float(self.weights[k]) for f, k in self.index.items()}, self.pairs.tolist()


def viterbi(model: tuple[dict[str, float], list[list[float]]], page: list[list[str]]) -> list[int]:
    """The likeliest labels of a page."""
    weights, pairs = model
    best, came = (0.0, 0.0), []
    for k, block in enumerate(page):
        emit = sum(weights.get(f, 0.0) for f in block)
        if not k:
            best = (0.0, emit)
            continue
        stay = [(best[0] + pairs[0][y], best[1] + pairs[1][y]) for y in (0, 1)]
        came.append([int(b > a) for a, b in stay])
        best = (max(stay[0]), max(stay[1]) + emit)
    label = int(best[1] > best[0])
    labels = [label]
    for step in reversed(came):
        label = step[label]
        labels.append(label)
    return labels[::-1] if page else []


def _labelled(page: list[Block]) -> np.ndarray:
    return np.array([int("article" in b.tags and not is_other(b.tags, b.names)) for b in page])


def _learned(pages: list[list[Block]]) -> tuple[list, list]:
    """Features and labels of labelled pages and of what is made of them."""
    r, features, labels = np.random.default_rng(3), [], []

    def learn(page: list[Block], y: np.ndarray) -> None:
        features.append(describe(page))
        labels.append(y)

    texts = [b.text for page in pages for b in page if len(b.text) < 400]
    for page in pages:
        y = _labelled(page)
        learn(page, y)
        # Furniture, at the start or end of the article, inside it and around it.
        filled, y_filled = list(page), y.tolist()
        for _ in range(6):
            tag, names = _FURNITURE[r.integers(len(_FURNITURE))]
            inside = r.random() < 0.7
            base = ("html", "body", "article") if inside else ("html", "body")
            at = int(r.integers(len(filled) + 1)) if inside else int(r.choice([0, len(filled)]))
            for _ in range(int(r.integers(1, 4))):
                leaf = str(r.choice(["p", "li", "div", "span"]))
                filled.insert(at, Block(str(r.choice(texts)), (*base, tag, *([leaf] if leaf != "span" else [])), tuple(names.split()), 0))
                y_filled.insert(at, 0)
        for k, (b, main) in enumerate(zip(filled, y_filled)):
            if main and r.random() < 0.3:
                filled[k] = b._replace(tags=(*b.tags[:b.tags.index("article") + 1], *_LEAVES[r.integers(len(_LEAVES))]))
        learn(filled, np.array(y_filled))
        tags, names = _ARTICLES[r.integers(len(_ARTICLES))]
        renamed = [b._replace(tags=tuple(x for t in b.tags for x in (tags if t == "article" else (t,))), names=b.names + (names if "article" in b.tags else ())) for b in filled]
        learn(renamed, np.array(y_filled))
        # Plain markup, where only furniture is named.
        plain = [b._replace(tags=tuple("div" if t in ("article", "main") else t for t in b.tags)) for b in page]
        learn(plain, y)
    return features, labels


def fit_pages(pages: DataFrame, html_col: str = "html", rows: int = FIT_PAGES, most_bytes: int = FIT_BYTES) -> tuple[dict[str, float], list[list[float]]]:
    """The model of pages that mark up one article: in the order of a hash, until there are ``rows`` or they have ``most_bytes``."""
    marked = pages.select(F.col(html_col).alias("h")).where("h ilike '%<article%'")
    sizes = marked.groupBy(F.xxhash64("h").alias("k")).agg(F.max(F.octet_length("h")).alias("n")).orderBy("k").limit(rows).collect()
    keys, held = [], 0
    for r in sizes:
        held += r.n
        if keys and held > most_bytes:
            break
        keys.append((r.k,))
    keys = pages.sparkSession.createDataFrame(keys, "k long")  # at most ``rows``
    found = marked.withColumn("k", F.xxhash64("h")).join(F.broadcast(keys), "k").groupBy("k").agg(F.first("h").alias("h")).orderBy("k").collect()
    parsed = [unwrapped(blocks(x)) for x in [*(r.h for r in found), _BUILT_IN]]
    chain = Chain()
    chain.fit(*_learned([p for p in parsed if p]))
    return chain.ready()


def extract(pages: DataFrame, model: tuple[dict[str, float], list[list[float]]], html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of every row, its main ``text`` and its length ``n_chars``."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def decode(batches):
        for batch in slices(batches, "_html", SLICE_BYTES):
            texts = []
            for html in raw(batch.column("_html")):
                page = unwrapped(blocks(html.decode("utf-8", "replace")))
                texts.append("\n".join(b.text for b, y in zip(page, viterbi(shared.value, describe(page))) if y))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=[*keep, "text", "n_chars"])

    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    return rows.mapInArrow(decode, rows.select(*keep, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return extract(rows, fit_pages(rows), keep=("page_id", "url"))
