"""Main text of web pages by a tree-structured graphical model.

The nodes are a page's block elements; each is content or not. A node's own potential comes from its markup and text
(weights of hashed features), and a parent-child potential connects it with its parent. Messages passed upward from
the leaves and downward from the root give every node's marginal, for all pages of a batch at once, level by level.
The same messages give the expected counts from which the potentials are trained, by gradient ascent on the likelihood of
labelled pages: the small written ones below, and at most `MAX_PAGES` of the table whose markup names the article.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polderlake.llm.frames import Sent, bounded_sample, chunks

BITS = 12
MAX_PAGES = 150
CHUNK_BYTES = 1_000_000
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that part no words. What they hold is text of the block around them, which the model judges.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var "
    "audio canvas head map noscript object output picture ruby rb rp rt slot svg template video math annotation g mfrac mi mn mo mover mroot "
    "mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover path semantics text tspan".split()
)
#: Void elements that part words as white space does; all others leave a word whole.
_BREAKS = frozenset(("br", "hr"))
#: Scripts, styles, titles and form fields hold no text of the page.
_RAW = frozenset("script style textarea title iframe".split())
#: An opening tag of the key ends an open element of these.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ARTICLE = frozenset(("article", "main"))
_ASIDE = frozenset("nav header footer aside form button menu dialog".split())
_ASIDE_NAMES = frozenset("ad ads advert advertisement banner comment comments cookie newsletter promo related share sidebar social sponsored subscribe notice".split())


@dataclass
class Page:
    """Block elements in page order (a parent before its children) and the runs of text with the element of each."""

    tag: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    marked: list[str] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)


def parse(source: str | None) -> Page:
    """The elements and text runs of one page. Unclosed elements end with their parent, stray end tags are ignored."""
    page = Page()
    source = source or ""

    def element(tag: str, attributes: str, parent: int) -> int:
        page.tag.append(tag)
        found = " ".join("".join(m) for m in _NAMES.findall(attributes)) if "=" in attributes else ""
        page.names.append(tuple(x for x in re.split(r"[^a-z]+", found.lower()) if x))
        page.marked.append("main" if "data-main" in attributes else "")
        page.parent.append(parent)
        for counts in (page.words, page.linked, page.stops):
            counts.append(0)
        return len(page.tag) - 1

    open_elements = [element("#page", "", -1)]
    pending: list[str] = []
    in_link, link_words = False, 0

    def flush() -> None:
        nonlocal link_words
        if pending:
            node = open_elements[-1]
            text = "".join(pending)
            words = (html.unescape(text) if "&" in text else text).split()
            if words:
                page.runs.append((node, " ".join(words)))
                page.words[node] += len(words)
                page.linked[node] += min(link_words, len(words))
                page.stops[node] += sum(1 for w in words if w[-1] in ".!?")
            pending.clear()
        link_words = 0

    def add(text: str) -> None:
        nonlocal link_words
        if text:
            pending.append(text)
            if in_link:
                link_words += len(text.split())

    at = 0
    while True:
        found = _TAG.search(source, at)
        if found is None:
            add(source[at:])
            break
        add(source[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        closing, tag, attributes = bool(found[1] or found[4]), tag.lower(), found[3] or found[6] or ""
        if tag in _RAW:
            if not closing:
                end = re.compile(f"</{tag}", re.I).search(source, at)
                at = end.start() if end else len(source)
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = not closing
            continue
        if tag in _VOID and tag not in _BREAKS:
            continue
        flush()
        in_link = False
        if tag in _VOID:
            continue
        if closing:
            for depth in range(len(open_elements) - 1, 0, -1):
                if page.tag[open_elements[depth]] == tag:
                    del open_elements[depth:]
                    break
            continue
        if page.tag[open_elements[-1]] == "p":
            open_elements.pop()
        if page.tag[open_elements[-1]] in _ENDS.get(tag, ()):
            open_elements.pop()
            if tag == "tr" and page.tag[open_elements[-1]] == "tr":
                open_elements.pop()
        if not attributes.endswith("/"):
            open_elements.append(element(tag, attributes, open_elements[-1]))
    flush()
    return page


def labels_of(page: Page) -> list[int]:
    """What markup says: 1 inside an article, a main element or a `data-main` one, without asides, forms and comments."""
    out = []
    for i, tag in enumerate(page.tag):
        inside = page.parent[i] >= 0 and out[page.parent[i]] == 1
        if tag in _ARTICLE or page.marked[i]:
            inside = True
        if tag in _ASIDE or _ASIDE_NAMES.intersection(page.names[i]):
            inside = False
        out.append(int(inside))
    return out


def _level(n: int) -> int:
    return min(n.bit_length(), 8)


def features(page: Page, blind: bool = False) -> tuple[list[int], list[int]]:
    """(slots, node of each). `blind` hides the tags that name the article, so that the rest must tell."""
    slots, rows = [], []
    words, linked = page.words[:], page.linked[:]
    for i in range(len(page.tag) - 1, 0, -1):
        words[page.parent[i]] += words[i]
        linked[page.parent[i]] += linked[i]
    tags = ["div" if blind and (t in _ARTICLE or t == "section") else t for t in page.tag]
    for i, tag in enumerate(tags):
        link = 4 * linked[i] // words[i] if words[i] else -1
        above = tags[page.parent[i]] if i else ""
        told = ["bias", f"tag {tag}", f"above {above}", f"own {_level(page.words[i])}", f"all {_level(words[i])}", f"link {link}", f"stops {_level(page.stops[i])}", f"{tag} {_level(page.words[i])} {link}", f"{above} {tag}"]
        told += [f"name {name}" for name in page.names[i]]
        slots += [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in told]
        rows += [i] * len(told)
    return slots, rows


class Forest:
    """The nodes of several pages in one array, with their levels, for messages to all pages at once."""

    def __init__(self, pages: Sequence[Page], blind: Sequence[bool] | None = None):
        self.first = np.concatenate([[0], np.cumsum([len(p.tag) for p in pages])]).astype(np.int64)
        self.n = int(self.first[-1])
        parents, slots, rows = [], [], []
        for k, page in enumerate(pages):
            base = int(self.first[k])
            parents += [x + base if x >= 0 else -1 for x in page.parent]
            s, r = features(page, bool(blind and blind[k]))
            slots += s
            rows += [x + base for x in r]
        self.parent = np.array(parents, dtype=np.int64)
        self.slots, self.rows = np.array(slots, dtype=np.int64), np.array(rows, dtype=np.int64)
        depth = np.zeros(self.n, dtype=np.int64)
        for i, above in enumerate(parents):
            if above >= 0:
                depth[i] = depth[above] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:]

    def own(self, weights: np.ndarray) -> np.ndarray:
        """Log-potentials of the two states."""
        score = np.bincount(self.rows, weights[self.slots], self.n)
        return np.stack([-score / 2, score / 2], axis=1)

    def marginals(self, weights: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's state marginals, and the expected parent-child counts (parent's state, child's state)."""
        below = self.own(weights)
        upward = np.zeros((self.n, 2))
        for level in reversed(self.levels):
            upward[level] = np.logaddexp(below[level, None, 0] + tie[:, 0], below[level, None, 1] + tie[:, 1])
            np.add.at(below, self.parent[level], upward[level])
        whole = below.copy()
        counts = np.zeros((2, 2))
        for level in self.levels:
            above = whole[self.parent[level]] - upward[level]
            pair = above[:, :, None] + tie[None] + below[level, None, :]
            pair -= pair.max(axis=(1, 2), keepdims=True)
            odds = np.exp(pair)
            counts += (odds / odds.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            whole[level] = below[level] + np.logaddexp(above[:, 0, None] + tie[0], above[:, 1, None] + tie[1])
        whole -= whole.max(axis=1, keepdims=True)
        odds = np.exp(whole)
        return odds / odds.sum(axis=1, keepdims=True), counts


class ContentModel:
    """Weights of the features and the 2 x 2 parent-child log-potentials."""

    def __init__(self, weights: np.ndarray, tie: np.ndarray):
        self.weights, self.tie = weights, tie

    @classmethod
    def train(cls, pages: Sequence[Page], *, steps: int = 250, rate: float = 0.4, decay: float = 0.02) -> ContentModel:
        """From pages with labels in their markup, each as it is and once without the tags that name the article."""
        forest = Forest([*pages, *pages], [False] * len(pages) + [True] * len(pages))
        label = np.array([x for page in pages for x in labels_of(page)] * 2)
        children = np.flatnonzero(forest.parent >= 0)
        seen = np.bincount(label[forest.parent[children]] * 2 + label[children], minlength=4).reshape(2, 2)
        weights, tie = np.zeros(1 << BITS), np.zeros((2, 2))
        past_w, past_t = np.full(1 << BITS, 1e-3), np.full((2, 2), 1e-3)
        for _ in range(steps):
            state, expected = forest.marginals(weights, tie)
            step_w = np.bincount(forest.slots, (label - state[:, 1])[forest.rows], 1 << BITS) - decay * weights
            step_t = seen - expected - decay * tie
            past_w += step_w**2
            past_t += step_t**2
            weights += rate * step_w / np.sqrt(past_w)
            tie += rate * step_t / np.sqrt(past_t)
        return cls(weights, tie)

    def texts(self, sources: Sequence[str | None]) -> list[str]:
        """The text of the nodes that are content, in page order."""
        pages = [parse(source) for source in sources]
        forest = Forest(pages)
        content = forest.marginals(self.weights, self.tie)[0][:, 1] >= 0.5
        return [" ".join(text for node, text in page.runs if content[base + node]) for page, base in zip(pages, forest.first.tolist(), strict=False)]


_TEXT = (
    "The river rose for three days and the town watched it. Nobody had seen the water so high since the old bridge fell, and the council met twice.",
    "In the morning the engineers measured the walls again. They found no cracks, and the road to the harbour was opened before noon.",
    "She wrote about it in a letter to her brother, who had moved inland long ago. He answered that the hills were dry and the wells were low.",
    "A second report will follow in the spring.",
    "It rained. The end.",
    "Until then the gates stay shut at night, said the warden, and the boats stay in the basin",
)
# What stands around the content, before and after it, and what may stand inside it without being part of it.
_LINKS = '<a href="/a">Home</a> <a href="/b">News</a> <a href="/c">About us</a>'
_ITEMS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Contact</a></li></ul>'
_BEFORE = (
    f"<nav>{_LINKS}</nav>", f"<nav>{_ITEMS}</nav>", f'<div class="menu">{_ITEMS}</div>', f'<div id="nav">{_LINKS}</div>',
    f'<div class="topbar">{_LINKS}</div>', f'<div id="navigation">{_ITEMS}</div>', f'<div class="navbar">{_LINKS}</div>',
    f"<header><h1>The Daily Page</h1>{_LINKS}</header>", f"<header><p>News since 1901.</p><nav>{_ITEMS}</nav></header>",
    '<div id="header"><h2>My site</h2></div>', '<div class="masthead"><h1><a href="/">The Page</a></h1></div>',
    '<div class="cookie-banner"><p>We use cookies to improve this site. <button>OK</button></p></div>',
    '<div id="consent">By going on you agree to our cookies. <a href="/p">More</a></div>',
    '<div class="cookie-notice"><p>This site stores cookies.</p></div>', '<div class="notice">The site moves on Monday.</div>',
    '<div class="alert"><p>Our office is closed today. Please call again.</p></div>',
    '<form action="/s"><label>Search</label><input name="q"><button>Go</button></form>',
    '<div class="ad">Buy two lamps, get one free.</div>', '<div class="advert"><p>Lamps are cheap this week.</p></div>',
    '<div class="banner">Order now!</div>', '<div class="promo"><p>Half price on all lamps today only, so be quick and order.</p></div>',
    f'<div class="breadcrumb">{_LINKS}</div>',
)
_AFTER = (
    "<footer>&copy; 2020 The Daily Page. All rights reserved.</footer>", "<footer><p>Imprint. Terms of use.</p></footer>",
    f"<footer>{_ITEMS}</footer>", '<div class="footer">The Daily Page 2020. Contact.</div>', '<div id="footer"><p>Terms of use.</p></div>',
    "<aside><h3>Most read</h3><p>Ten bridges you must see before they fall.</p></aside>", f"<aside>{_ITEMS}</aside>",
    f'<div class="sidebar"><h3>More</h3>{_ITEMS}</div>', '<div id="sidebar"><p>Our reporters write from the whole country. Send them a note.</p></div>',
    '<section id="comments"><h2>Comments</h2><div class="comment"><p>Great story, I was there too. The water was up to my knees that day.</p></div><div class="comment"><p>Thanks for writing this.</p></div></section>',
    '<div class="comments"><p><b>Ann:</b> I saw the bridge fall. It was loud!</p></div>',
    '<section class="comments"><h3>2 comments</h3><ul><li>I was there and it was cold.</li><li>So was I.</li></ul></section>',
    '<ol class="comment-list"><li>What a lovely town it is.</li><li>It is!</li></ol>',
    '<div id="comments"><p>First! My uncle built that bridge in his youth, and he told us of it often.</p></div>',
    f'<div class="related"><h4>See also</h4>{_LINKS}</div>', '<div class="newsletter"><form><p>Subscribe to our letter.</p><input></form></div>',
    '<form><p>Sign up. We never share your address.</p><button>Send</button></form>', f'<div class="share">{_LINKS}</div>',
    '<div class="ad">Lamps are cheap this week.</div>', f'<div class="pager">{_LINKS}</div>',
)
_INSIDE = (
    "<aside><p>Read more: ten bridges you must see.</p></aside>", "<aside>Read on: the bridge.</aside>", '<div class="ad">Buy lamps now.</div>',
    "<form>Sign up here <input><button>Send</button></form>", '<div class="comments"><p>I was there and it was cold.</p></div>',
    "<footer>Written by the editors.</footer>", f'<div class="share">{_LINKS}</div>', f"<nav>{_LINKS}</nav>",
    '<div class="related"><p>Ten more bridges.</p></div>', '<section id="comments"><p>First! What a town.</p></section>',
    '<div class="newsletter">Get our news by mail.</div>', '<div class="promo"><p>Order a lamp today.</p></div>',
)
_PARTS = (
    "<h2>Measures</h2>", "<ul><li>Shut the gates.</li><li>Keep the boats in.</li></ul>", "<blockquote>The walls will hold.</blockquote>",
    "<blockquote><p>The walls will hold, said the warden.</p></blockquote>", "<table><tr><td>Depth</td><td>3 m</td></tr></table>",
    "<pre>level = 3</pre>", "<header><h1>High water</h1></header>", f"<section><h3>After</h3><p>{_TEXT[2]}</p></section>",
    "<figure><img src=x><figcaption>The bridge in spring.</figcaption></figure>", f"<div><p>{_TEXT[1]}</p></div>",
)
#: Around the content; `{}` is where it stands.
_HOLDERS = (
    "<article data-main>{}</article>", "<article data-main>{}</article>", "<main data-main>{}</main>", "<main><article data-main>{}</article></main>",
    '<div id="content" data-main>{}</div>', '<div class="content" data-main>{}</div>', '<div class="article-body" data-main>{}</div>',
    '<div class="post" data-main>{}</div>', '<div class="entry-content" data-main>{}</div>', '<div class="story" data-main>{}</div>',
    '<div class="text" data-main>{}</div>', '<div role="main" data-main>{}</div>', "<section data-main>{}</section>",
    '<div class="wrap"><div class="main-text" data-main>{}</div></div>', "<div data-main>{}</div>", "<div data-main>{}</div>",
)


def written_pages(pages: int = 320, seed: int = 9) -> list[Page]:
    """Labelled pages put together from the parts above: `data-main` marks the content, and asides in it are none."""
    draw = random.Random(seed)
    out = []
    for number in range(pages):
        parts = [f"<p>{text}</p>" for text in draw.sample(_TEXT, draw.choice((1, 2, 3, 4)))]
        parts += draw.sample(_PARTS, draw.choice((0, 0, 1, 2)))
        draw.shuffle(parts)
        if draw.random() < 0.5:
            parts.insert(0, "<h1>High water</h1>")
        bare = number % 16 == 0
        if bare:
            body = "".join(re.sub(r"^<(\w+)", r"<\1 data-main", part) for part in parts)
        else:
            for extra in draw.sample(_INSIDE, draw.choice((0, 0, 1, 2))):
                parts.insert(draw.randrange(len(parts) + 1), extra)
            body = draw.choice(_HOLDERS).format("".join(parts))
        before = "".join(draw.sample(_BEFORE, draw.choice((0, 1, 1, 2, 3))))
        after = "".join(draw.sample(_AFTER, draw.choice((0, 1, 1, 2, 3))))
        out.append(parse(f"<html><head><title>High water</title></head><body>{before}{body}{after}</body></html>"))
    for text in _TEXT:
        out.append(parse(text))
        out[-1].marked[0] = "main"
        out += [parse(f"<p data-main>{text}"), parse(f"<div data-main><p>{text}</p></div>"), parse(f"<html><body><article data-main><h1>{text}</h1><p><b>{text}<br></article></body></html>")]
    return out


def train_on(pages: DataFrame, id_column: str = "page_id", column: str = "html") -> ContentModel:
    """A model from the written pages and a bounded sample of those whose markup names the article."""
    named = pages.where(F.col(column).rlike("(?i)<(article|main)[ >]"))
    sample = bounded_sample(named, F.xxhash64(id_column, column), MAX_PAGES).select(column).limit(MAX_PAGES)
    return ContentModel.train(written_pages() + [parse(row[0]) for row in sample.collect()])


RESULT = ("text", "n_chars")


def extract(pages: DataFrame, model: ContentModel | None = None, *, id_column: str = "page_id", column: str = "html") -> DataFrame:
    """`pages` with `text` and `n_chars` (its code points) instead of `column`; they replace columns of those names.

    Character references are decoded, white space inside a block becomes one space, and blocks are joined by one space in
    page order. Scripts, styles, titles, form fields and comments in the markup are no text; inline elements, and void ones other
    than `br` and `hr`, part no words. A head needs no end. Null, empty or tagless pages have
    the text that the model takes from them, which is empty if there is none. Rows are kept one by one, repeated ones
    too. One pass over the whole pages, without a shuffle.
    """
    model = model or train_on(pages, id_column, column)
    sent = Sent(pages.sparkSession, model)
    kept = [name for name in pages.columns if name.lower() not in ("text", "n_chars", column.lower())]
    source = pages.select(*[F.col(f"`{name}`") for name in kept], column)
    schema = source.drop(column).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = sent.get()
        for part in chunks(batches, column, CHUNK_BYTES):
            texts = content.texts(part.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(name) for name in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return source.mapInArrow(run, schema)
