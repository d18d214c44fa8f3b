"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks."""

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the sample that the model is fitted on; all pages are extracted whole.
TRAINING_PAGES = 120    # with an article element, picked evenly by a hash
TRAINING_BLOCKS = 300   # of a page: of longer ones the first and the last half of these
TRAINING_TEXT = 2_048   # characters of a block; longer ones have the same features
GENERATED_PAGES = 60    # made up, in several layouts, whatever the table holds
EPOCHS = 12

# --- fixed values -----------------------------------------------------------
SILENT = frozenset("script style noscript template textarea select option svg iframe object "
                   "canvas head title".split())
RAW = frozenset("script style textarea title".split())  # only their own end tag ends them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label "
                   "mark q ruby s samp small span strike strong sub sup time tt u var "
                   "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover "
                   "munderover mstyle mpadded semantics".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl "
                           "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                           "hgroup hr main menu nav ol p pre section table ul".split())
SAME_ENDS = frozenset("li dt dd tr td th option".split())
# All that may stand in a head; anything else ends one that is open.
IN_HEAD = frozenset("title meta link base script style noscript template".split())
# Tags and parts of class, id and role names that say what a container is for.
CONTAINERS = tuple("article main section nav header footer aside form ul ol table blockquote "
                   "figure div p h1 h2 h3 h4 li button dialog".split())
CUES = {
    "article": "article story entry post-body postbody articlebody news-text",
    "content": "content main body text page-text maincontent",
    "nav": "nav menu breadcrumb breadcrumbs pagination pager toc tabs toolbar",
    "header": "header masthead topbar banner logo",
    "footer": "footer copyright legal colophon bottom imprint",
    "sidebar": "sidebar side aside widget rail related recommended popular trending more",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion teaser",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr paywall",
    "form": "form login signup subscribe newsletter search",
    "comment": "comment comments reply replies discussion disqus respond reader",
    "share": "share social follow tags byline meta author",
}
# ----------------------------------------------------------------------------

_CUE_OF = {word: cue for cue, words in CUES.items() for word in words.split()}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*["']?true|"""
                     r"""style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_SPACE = re.compile(r"\s+")


class Block:
    """A run of text between block tags, with the tags and cues above it."""

    __slots__ = ("text", "tags", "cues", "linked", "own")

    def __init__(self, text, tags, cues, linked, own):
        self.text, self.tags, self.cues, self.linked, self.own = text, tags, cues, linked, own


def _cues(attributes: str) -> frozenset:
    if "=" not in attributes:
        return frozenset()
    words = []
    for value in _NAMES.findall(attributes):
        name = re.sub(r"([a-z])([A-Z])", r"\1-\2", value.strip("\"'")).lower()
        words += re.split(r"[^a-z]+", name) + [name]
    return frozenset(_CUE_OF[w] for w in words if w in _CUE_OF)


def blocks(page: str) -> list[Block]:
    """Leaf blocks in order. Unclosed and stray tags are taken as browsers mostly do."""
    out: list[Block] = []
    # Open elements: tag, cues and block tags down to it, the last of these, silent, linked.
    stack: list[tuple] = [("", frozenset(), frozenset(), "", False, False)]
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    linked = 0
    at, n = 0, len(page)

    def close():
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                _, cues, tags, own, _, _ = stack[-1]
                out.append(Block(text, tags, cues, linked, own))
        parts, linked = [], 0

    def text_of(raw: str):
        nonlocal linked
        if stack[-1][0] == "head" and raw.strip(" \t\n\r\f"):
            pop("head", frozenset())
        if raw and not stack[-1][4]:
            raw = entities.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if stack[-1][5]:
                linked += len(raw)

    def pop(tag: str, barrier: frozenset):
        if not open_tags.get(tag):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                if any(x[0] not in INLINE for x in stack[i:]):
                    close()
                for x in stack[i:]:
                    open_tags[x[0]] -= 1
                del stack[i:]
                return
            if stack[i][0] in barrier:
                return

    while at < n:
        tag_at = page.find("<", at)
        if tag_at < 0:
            text_of(page[at:])
            break
        text_of(page[at:tag_at])
        found = _MARKUP.match(page, tag_at)
        if found is None:  # a lone < is text
            text_of("<")
            at = tag_at + 1
            continue
        at = found.end()
        tag = (found.group(2) or "").lower()
        if not tag:
            continue
        if found.group(1):
            if tag == "br":
                parts.append(" ")
            else:
                pop(tag, frozenset(("table",)) if tag in SAME_ENDS else frozenset())
            continue
        if open_tags.get("head") and tag not in IN_HEAD and not any(
                x[0] in ("noscript", "template") for x in stack):
            pop("head", frozenset())
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if tag in ENDS_PARAGRAPH:
            pop("p", frozenset(ENDS_PARAGRAPH - {"p"}))
        if tag in SAME_ENDS:
            pop(tag, frozenset(("ul", "ol", "dl", "table", "select")))
            if tag in ("dt", "dd"):
                pop("dd" if tag == "dt" else "dt", frozenset(("dl",)))
        attributes = found.group(3) or ""
        if tag not in INLINE:
            close()
        _, cues, tags, own, silent, link = stack[-1]
        silent = silent or tag in SILENT or (
            bool(attributes) and _HIDDEN.search(attributes) is not None)
        if attributes.endswith("/") and tag not in INLINE and tag in ("svg", "iframe"):
            continue
        if tag not in INLINE:
            tags, own = tags if tag in tags else tags | {tag}, tag
        named = _cues(attributes)
        stack.append((tag, cues | named if named else cues, tags, own, silent, link or tag == "a"))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            if tag == "title" and end is None:
                at = n
            else:
                at = end.start() if end else n
    close()
    return out


def _features(found: list[Block], dropped: frozenset = frozenset()) -> list[list[str]]:
    out = []
    total = len(found)
    for i, b in enumerate(found):
        n = len(b.text)
        words = b.text.count(" ") + 1
        f = ["bias", f"own:{b.own}", f"size:{min(n.bit_length(), 12)}",
             f"links:{min(4, 5 * b.linked // max(n, 1))}",
             f"stops:{min(3, sum(b.text.count(c) for c in '.!?'))}",
             f"end:{'stop' if b.text[-1] in '.!?:;' else 'other'}",
             f"few:{words < 4}", f"copyright:{'©' in b.text}"]
        f += [f"in:{t}" for t in b.tags if t in CONTAINERS and t not in dropped]
        f += [f"cue:{c}" for c in b.cues if c not in dropped]
        if i == 0:
            f.append("first")
        if i == total - 1:
            f.append("last")
        out.append(f)
    return out


class ChainModel:
    """Two labels (1: main text) with weights per feature and per pair of neighbours."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros(0)  # of a feature towards label 1
        self.pairs = np.zeros((2, 2))

    def _rows(self, features, grow=False):
        rows = []
        for names in features:
            if grow:
                for name in names:
                    self.index.setdefault(name, len(self.index))
            rows.append([self.index[x] for x in names if x in self.index])
        return rows

    def fit(self, pages: list[tuple[list, list]], epochs: int = EPOCHS, rate: float = 0.2,
            decay: float = 1e-4):
        """Maximum likelihood by forward-backward and AdaGrad steps, a page each."""
        pages = [(self._rows(f, grow=True), np.array(y)) for f, y in pages if f]
        self.weights = np.zeros(len(self.index))
        seen, seen_pairs = np.full(len(self.weights), 1e-2), np.full((2, 2), 1e-2)
        order = random.Random(7)
        for _ in range(epochs):
            order.shuffle(pages)
            for rows, y in pages:
                score = np.array([self.weights[r].sum() for r in rows])
                one, two = self._marginals(score)
                gap = y - one
                gradient = -decay * self.weights
                for r, g in zip(rows, gap):
                    gradient[r] += g
                pair_gradient = -decay * self.pairs - two
                np.add.at(pair_gradient, (y[:-1], y[1:]), 1.0)
                seen += gradient**2
                seen_pairs += pair_gradient**2
                self.weights += rate * gradient / np.sqrt(seen)
                self.pairs += rate * pair_gradient / np.sqrt(seen_pairs)
        return self

    def _marginals(self, score):
        """Probability of label 1 per block, and the expected pairs of labels."""
        n = len(score)
        node = np.stack([np.zeros(n), score], axis=1)
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[0] = node[0]
        for i in range(1, n):
            ahead[i] = node[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + self.pairs, axis=0)
        for i in range(n - 2, -1, -1):
            back[i] = np.logaddexp.reduce(self.pairs + (node[i + 1] + back[i + 1])[None, :], axis=1)
        whole = np.logaddexp.reduce(ahead[-1])
        one = np.exp(ahead[:, 1] + back[:, 1] - whole)
        two = np.zeros((2, 2))
        if n > 1:
            two = np.exp(ahead[:-1, :, None] + self.pairs[None]
                         + (node[1:] + back[1:])[:, None, :] - whole).sum(axis=0)
        return one, two

    def decode(self, features) -> list[int]:
        """The most likely labels (Viterbi); of equals, main text."""
        weights, (p00, p01), (p10, p11) = self.weights, *self.pairs.tolist()
        index, paths = self.index, []
        zero = one = 0.0
        for i, names in enumerate(features):
            score = sum(weights[index[x]] for x in names if x in index)
            if i == 0:
                zero, one = 0.0, score
                continue
            stay, leave = zero + p00, one + p10
            enter, keep = zero + p01, one + p11
            paths.append((leave >= stay, keep >= enter))
            zero, one = max(stay, leave), max(enter, keep) + score
        if not features:
            return []
        label = int(one >= zero)
        out = [label]
        for before in reversed(paths):
            label = int(before[label])
            out.append(label)
        return out[::-1]


def _redressed(found: list[Block], y: list[int], rng: random.Random) -> tuple[list, list]:
    """The page in another layout whose labels are known.

    The containers of its article and of the rest are renamed, and parts that
    pages often have are put in, with words of the page itself.
    """
    main = rng.choice([
        (("main",), ()), (("div",), ("content",)), (("div",), ("article",)),
        (("section",), ("article",)), (("article", "main"), ()), (("div", "section"), ("content",)),
        (("article", "div"), ("content",)), (("article",), ("content", "article"))])
    words = " ".join(b.text for b in found).split() or ["x"]

    def some(n):
        at = rng.randrange(len(words))
        return " ".join((words[at:at + n] or words[:n]))

    def part(tags, cues, sizes, own="div", linked=0.0, inside=main if rng.random() < 0.5 else None):
        text = some(rng.choice(sizes))
        over = set(tags) | ({"div"} if rng.random() < 0.5 else set())
        marks = set(cues)
        if inside:
            over |= set(inside[0])
            marks |= set(inside[1])
        return Block(text, frozenset(over | {own}), frozenset(marks), int(linked * len(text)), own)

    before, inner, after = [], [], []
    for _ in range(rng.randrange(1, 6)):
        before.append(part(("nav", "ul"), rng.choice([(), ("nav",)]), (1, 2, 3), "li", 1.0, None))
    if rng.random() < 0.5:
        before.append(part(("header",), rng.choice([(), ("header",)]), (1, 2, 6, 15),
                           rng.choice(["div", "p", "h1", "a"]), inside=None))
    if rng.random() < 0.5:
        before.append(part(("div",), ("notice",), (8, 25, 60), rng.choice(["p", "div"]), 0.1, None))
    for tags, cues, sizes, own, linked in (
            (("div",), ("advert",), (5, 20, 50), "div", 0.3),
            (("aside",), (), (5, 25, 60), "p", 0.4),
            (("div", "ul"), ("sidebar",), (3, 8, 20), "li", 1.0),
            (("form",), rng.choice([(), ("form",)]), (2, 5, 12), "div", 0.0),
            (("div",), ("share",), (2, 5), "div", 0.8)):
        if rng.random() < 0.5:
            rng.choice([inner, after]).append(part(tags, cues, sizes, own, linked))
    comments = []
    if rng.random() < 0.6:
        box = rng.choice(["section", "div", "article"])
        for _ in range(rng.randrange(1, 5)):
            comments.append(part((box,), ("comment",), (5, 30, 80), "p", 0.0))
    body = [Block(b.text, frozenset(set(b.tags) - {"article", "nav", "footer"} | set(main[0])),
                  frozenset(main[1]), b.linked, b.own)
            for b, label in zip(found, y) if label]
    if rng.random() < 0.4 and body:
        body.insert(rng.randrange(len(body) + 1), Block(
            some(25), frozenset({"ul", "li", *main[0]}), frozenset(main[1]), 0, "li"))
    closing = [part(("footer",), rng.choice([(), ("footer",)]), (4, 12, 25), inside=None)]
    at = rng.randrange(len(body) + 1)
    order = [(b, 0) for b in before] + [(b, 1) for b in body[:at]] + [(b, 0) for b in inner] + [
        (b, 1) for b in body[at:]] + [(b, 0) for b in after + comments + closing]
    return [b for b, _ in order], [label for _, label in order]


def _generated(rng: random.Random) -> list[Block]:
    """A made-up article: a head line, paragraphs and at times a list, a quotation, a table."""
    def text(words: int, stop: str = ".") -> str:
        out = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10)))
               for _ in range(words)]
        for at in range(rng.randint(6, 18), words - 3, rng.randint(7, 20)):
            out[at] += "."
        return " ".join(out) + stop

    def block(own: str, words: int, stop: str = ".", *above: str) -> Block:
        content = text(words, stop)
        linked = rng.choice([0, 0, 0, len(content) // 9])
        return Block(content, frozenset({"article", own, *above}), frozenset(), linked, own)

    out = [block("h1", rng.randint(2, 12), "")]
    for _ in range(rng.randint(1, 14)):
        out.append(block("p", min(400, max(4, int(rng.lognormvariate(3.6, 0.9))))))
        if rng.random() < 0.2:
            out.append(block("h2", rng.randint(1, 8), rng.choice(["", "?"])))
        if rng.random() < 0.1:
            out += [block("li", rng.randint(3, 20), rng.choice(["", "."]), "ul")
                    for _ in range(rng.randint(2, 5))]
        if rng.random() < 0.1:
            out.append(block("p", rng.randint(8, 50), ".", "blockquote"))
        if rng.random() < 0.05:
            out += [block("td", rng.randint(1, 4), "", "table", "tr") for _ in range(4)]
    return out


def generated(pages: int = GENERATED_PAGES, seed: int = 5) -> Iterator[tuple[list, list]]:
    """Features and labels of made-up pages, each in two layouts; the same ones every time."""
    rng = random.Random(seed)
    for _ in range(pages):
        found = _generated(rng)
        for _ in range(2):
            other, labels = _redressed(found, [1] * len(found), rng)
            hide = frozenset(rng.sample(["div", "section", "ul", "li", "content"], 2))
            yield _features(other, hide), labels


def labelled(pages: list[list[Block]], seed: int = 11) -> Iterator[tuple[list, list]]:
    """Features and labels of training pages, given as their blocks.

    A block belongs to the main text if it is inside an article element and
    not inside navigation, asides, forms, footers or comments there. Each page
    is also seen in two other layouts, and without some of its tags and cues.
    """
    rng = random.Random(seed)
    for found in pages:
        y = [int("article" in b.tags and not b.tags & {"nav", "aside", "form", "footer"}
                 and not b.cues & {"comment", "advert", "sidebar", "share", "nav"}) for b in found]
        if not any(y):
            continue
        yield _features(found), y
        for _ in range(2):
            other, labels = _redressed(found, y, rng)
            hide = frozenset(rng.sample(["div", "section", "ul", "li", "content"], 2))
            yield _features(other, hide), labels


def _sampled(page: str) -> list[Block]:
    """The blocks of a page that the model is fitted on."""
    found = blocks(page)
    if len(found) > TRAINING_BLOCKS:
        found = found[:TRAINING_BLOCKS // 2] + found[-TRAINING_BLOCKS // 2:]
    for b in found:
        b.linked = b.linked * min(len(b.text), TRAINING_TEXT) // max(len(b.text), 1)
        b.text = b.text[:TRAINING_TEXT].rstrip()
    return found


_BLOCKS = "turn long, blocks array<struct<text:string,tags:array<string>,cues:array<string>,linked:long,own:string>>"


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([
        ("text", pa.string()), ("tags", pa.list_(pa.string())), ("cues", pa.list_(pa.string())),
        ("linked", pa.int64()), ("own", pa.string())]))
    for batch in batches:
        found = [[{"text": b.text, "tags": sorted(b.tags), "cues": sorted(b.cues),
                   "linked": b.linked, "own": b.own} for b in _sampled(page.as_py())]
                 for page in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, kind)], names=["turn", "blocks"])


def train(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> ChainModel:
    """Fit on made-up pages and on at most TRAINING_PAGES pages of the table.

    The table's pages teach the layouts at hand if they have article elements.
    A table without them leaves a model of the made-up pages. Only the sampled
    blocks of the picked pages reach the driver.
    """
    turn = F.xxhash64(F.col(page_id).cast("long"), html)
    rows = pages.where(F.lower(html).contains("<article")).select(
        turn.alias("turn"), F.col(html).alias("html"))
    picked = [r["turn"] for r in rows.select("turn").distinct().orderBy("turn").limit(
        TRAINING_PAGES).collect()]
    taught = rows.where(F.col("turn").isin(picked)).mapInArrow(_sample, _BLOCKS)
    # Equal pages count once.
    taught = taught.groupBy("turn").agg(F.first("blocks").alias("blocks")).orderBy("turn").collect()
    found = [[Block(b["text"], frozenset(b["tags"]), frozenset(b["cues"]), b["linked"], b["own"])
              for b in r["blocks"] if b["text"]] for r in taught] if picked else []
    return ChainModel().fit([*labelled(found), *generated()])


def main_text(model: ChainModel, page: str) -> str:
    found = blocks(page)
    labels = model.decode(_features(found))
    return " ".join(b.text for b, label in zip(found, labels) if label)


def extract(pages: DataFrame, model: ChainModel | None = None, page_id: str = "page_id",
            url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    One pass without a shuffle, page by page, each page whole. A model from
    ``train`` may be given; else it is fitted on the table and on made-up pages,
    so there is one for tables of any kind.

    Null and empty pages: empty text. Null ids and urls are carried. Repeated
    rows are extracted each. No rows give no rows; further columns are ignored.
    """
    model = train(pages, page_id, html) if model is None else model

    def run(batches):
        for batch in batches:
            text = [main_text(model, page.as_py() or "") for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).cast("long"), F.col(url), F.col(html)).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
