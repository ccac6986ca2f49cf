"""Main text of web pages: boosted trees over DOM nodes, decoded so that choices agree along the tree.

A forgiving parser builds the tree of block elements; inline elements are part of the block around them,
and elements whose content is never prose (scripts, styles, form controls and so on) are left out. Each
block has features: what its tag and its class, id and role tokens say, depth, text density and link share
of its subtree, and how it compares with its siblings. Gradient-boosted trees give each block log odds of
being main text. They are trained here on pages' own structure: where ancestors' tags and tokens leave no
doubt, these are labels; half of the training rows have the tag and token features blanked, so that density
and shape must carry the decision where a page says nothing.

Decoding chooses a subtree that holds the root: a block is kept only with its parent, and the choice has the
greatest sum of weighted log odds. So nothing is kept inside a dropped block, nor dropped for its parent's sake.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.llm.staging import in_arrow

#: Pages that the trees are trained on, all of each: at most this many, those with the smallest hash of page_id.
TRAINING_PAGES = 300
#: Trees, their depth, the step, and bins of a feature.
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 24

#: Elements by their use in HTML, and tokens that authors give to parts of a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video select button textarea input datalist option".split())
RAW = frozenset("script style noscript iframe textarea title xmp".split())
CONTENT_TAGS = frozenset("article main".split())
OTHER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
CONTENT_TOKENS = frozenset("article body content entry main post story text prose".split())
OTHER_TOKENS = frozenset(
    """ad ads advert advertisement banner bar breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus footer form gdpr header
    legal links login masthead menu meta modal nav navbar navigation newsletter notice notices overlay pager pagination pop popup promo promoted promotion
    recommend recommended related replies reply respond rss search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar
    topbar tracking warning widget""".split()
)
#: Left out elements of short content, and elements that these can't hold: one of them ends a short one left open.
_SHORT = frozenset("button option select textarea datalist".split())
_PARTS = frozenset("p div ul ol li dl table section article main nav aside header footer form blockquote h1 h2 h3 h4 h5 h6 pre figure".split())
#: Elements that a start tag of the same group ends.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset("ul ol dl table tbody thead tfoot body html div section article main nav aside header footer form blockquote".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """Blocks in page order (parents first): parent, tag, depth, tokens; and segments of text, each of one block."""

    def __init__(self, text: str):
        self.parent, self.tag, self.depth, self.named = [-1], ["html"], [0], [frozenset()]
        self.segments: list[tuple[int, str, int]] = []  # block, raw text, characters in links
        self._parse(text)

    def _parse(self, text: str) -> None:
        open_blocks, links, held, link_chars = [0], 0, [], 0
        skipping: list[str] = []
        lowered = None

        def end_segment() -> None:
            nonlocal held, link_chars
            if held:
                self.segments.append((open_blocks[-1], "".join(held), link_chars))
                held, link_chars = [], 0

        def add(piece: str) -> None:
            nonlocal link_chars
            if piece and not skipping:
                piece = entities.unescape(piece)
                held.append(piece)
                if links:
                    link_chars += len(piece.strip())

        n = len(text)
        vain: set[int] = set()  # marks from which on no tag ends
        unclosed = {"\"": n, "'": n, "": n}  # from where on a mark isn't closed, or there is none

        def tag_end(start: int) -> int:
            """The place of the ``>`` that ends a tag, outside of quotation marks; -1 if none does. What was sought in vain isn't sought again."""
            place, passed = start, []
            while place < unclosed[""]:
                stop = _STOP.search(text, place)
                if not stop:
                    unclosed[""] = place
                    break
                if (mark := stop[0]) == ">":
                    return stop.start()
                if stop.start() in vain:
                    break
                passed.append(stop.start())
                end = -1 if stop.end() >= unclosed[mark] else text.find(mark, stop.end())
                if end < 0:  # a mark that nothing closes is a character like others
                    unclosed[mark] = min(unclosed[mark], stop.end())
                    place = stop.end()
                else:
                    place = end + 1
            vain.update(passed)
            return -1

        at = 0
        while at < n:
            sign = text.find("<", at)
            if sign < 0:
                add(text[at:])
                break
            add(text[at:sign])
            at = sign
            if text.startswith("<!--", at):
                end = text.find("-->", at + 4)
                at = n if end < 0 else end + 3
                continue
            if text.startswith(("<!", "<?"), at):
                end = text.find(">", at)
                at = n if end < 0 else end + 1
                continue
            m = _NAME.match(text, at)
            end = tag_end(m.end()) if m else -1
            if end < 0:
                add("<")
                at += 1
                continue
            closes, tag, attributes = m[1], m[2].lower(), text[m.end() : end]
            at = end + 1
            if tag in SKIPPED:
                if closes:
                    if tag in skipping:
                        del skipping[skipping.index(tag) :]
                elif tag in RAW:
                    lowered = lowered if lowered is not None else text.lower()
                    end = lowered.find(f"</{tag}", at)
                    stop = text.find(">", end) if end >= 0 else -1
                    at = n if stop < 0 else stop + 1
                elif tag not in VOID and not attributes.endswith("/"):
                    skipping.append(tag)
                continue
            if tag == "body" and not closes:
                skipping.clear()  # an unclosed head
            if skipping and tag not in INLINE:  # the end, or a part that none of these may hold: it was left open
                around = {self.tag[i] for i in open_blocks}
                if closes and tag in around or not closes and skipping[-1] in _SHORT and tag in _PARTS:
                    skipping.clear()
            if skipping:
                continue
            if tag == "a":
                links = 0 if closes else 1
            if tag == "br":
                add(" ")
            if tag in INLINE:
                continue
            end_segment()
            if closes:
                for i in range(len(open_blocks) - 1, 0, -1):
                    if self.tag[open_blocks[i]] == tag:
                        del open_blocks[i:]
                        break
                continue
            if tag in ("html", "body"):
                self.named[open_blocks[-1]] |= self._tokens(attributes)
                continue
            ends = _ENDS.get(tag) or (_ENDS["p"] if tag in _HOLDS or tag[:1] == "h" else None)
            if ends and self.tag[open_blocks[-1]] in ends:
                open_blocks.pop()
            self.parent.append(open_blocks[-1])
            self.tag.append(tag)
            self.depth.append(len(open_blocks))
            self.named.append(self._tokens(attributes))
            if tag not in VOID and not attributes.endswith("/"):
                open_blocks.append(len(self.tag) - 1)
        end_segment()

    @staticmethod
    def _tokens(attributes: str) -> frozenset[str]:
        return frozenset(t.lower() for value in _NAMED.findall(attributes) for t in _TOKENS.findall(value)) if attributes else frozenset()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        own, link, words, pieces = (np.zeros(n) for _ in range(4))
        for block, raw, chars in self.segments:
            clean = raw.split()
            own[block] += sum(map(len, clean))
            words[block] += len(clean)
            link[block] += chars
            pieces[block] += bool(clean)
        total, all_links, tags, blocks = own.copy(), link.copy(), np.ones(n), pieces.copy()
        for i in range(n - 1, 0, -1):
            p = parent[i]
            total[p] += total[i]
            all_links[p] += all_links[i]
            tags[p] += tags[i]
            blocks[p] += blocks[i]
        up = np.maximum(parent, 0)
        children = np.bincount(parent[1:], minlength=n)
        place = np.zeros(n)
        seen: dict[int, int] = {}
        alike: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            place[i] = seen.get(parent[i], 0)
            seen[parent[i]] = int(place[i]) + 1
            alike[parent[i], self.tag[i]] = alike.get((parent[i], self.tag[i]), 0) + 1
        siblings = np.maximum(children[up], 1)
        says = np.zeros((n, 6))
        for i in range(n):
            tag, named = self.tag[i], self.named[i]
            says[i] = (tag in CONTENT_TAGS, tag in OTHER_TAGS, tag == "p" or tag in ("h1", "h2", "h3", "blockquote", "pre"), tag in ("ul", "ol", "li", "dl"), len(named & CONTENT_TOKENS), len(named & OTHER_TOKENS))
        # What the nearest ancestors that say something say.
        inside = np.zeros((n, 2))
        for i in range(1, n):
            p = parent[i]
            inside[i, 0] = max(inside[p, 0], says[p, 0])
            inside[i, 1] = max(inside[p, 1], says[p, 1], min(1, says[p, 5]))
        shape = np.stack([
            np.array(self.depth), np.log1p(own), np.log1p(words), np.log1p(total), total / tags, all_links / np.maximum(total, 1), np.log1p(children), np.log1p(tags),
            place / siblings, np.log1p(siblings), total / np.maximum(total[up], 1), total / np.maximum(total[0], 1), total / np.maximum(blocks, 1),
            np.array([0, *(alike[parent[i], self.tag[i]] for i in range(1, n))]) / siblings, np.log1p(total[up]), all_links[up] / np.maximum(total[up], 1),
        ], 1)
        return np.hstack([says, inside, shape])

    def evident(self) -> np.ndarray:
        """1: certainly main text, 0: certainly not, -1: the page does not say."""
        n = len(self.tag)
        other, content = np.zeros(n, bool), np.zeros(n, bool)
        for i in range(1, n):
            p = self.parent[i]
            other[i] = other[p] or self.tag[i] in OTHER_TAGS or bool(self.named[i] & OTHER_TOKENS)
            content[i] = content[p] or self.tag[i] in CONTENT_TAGS
        return np.where(other, 0, np.where(content, 1, -1))

    def text(self, odds: np.ndarray) -> str:
        """The text of the best subtree; blocks joined by one space."""
        n = len(self.tag)
        chars = np.zeros(n)
        for block, raw, _ in self.segments:
            chars[block] += len(raw.strip())
        value = odds * np.where(chars > 0, np.log1p(chars), 0.1)
        value[0] = 0 if chars[0] == 0 else value[0]
        kept = value.copy()
        for i in range(n - 1, 0, -1):
            if kept[i] > 0:
                kept[self.parent[i]] += kept[i]
        keep = kept > 0
        keep[0] = True
        for i in range(1, n):
            keep[i] &= keep[self.parent[i]]
        if value[0] <= 0:
            own_root = False
        else:
            own_root = True
        out = (" ".join(raw.split()) for block, raw, _ in self.segments if keep[block] and (block or own_root))
        return " ".join(x for x in out if x)


class Trees:
    """Gradient-boosted trees for log loss, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._binned(x)
        share = np.clip(np.average(y, weights=weight), 0.01, 0.99)
        self.base = float(np.log(share / (1 - share)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        z = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(binned, (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight)
            self.trees.append(tree)
            z += self._apply(tree, binned)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    @staticmethod
    def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = (1 << (DEPTH + 1)) - 1
        feature, cut, leaf = np.full(size, -1), np.zeros(size, np.int16), np.zeros(size)
        node = np.zeros(len(g), np.int64)
        for at in range(size):
            mine = np.flatnonzero(node == at)
            total_g, total_h = g[mine].sum(), h[mine].sum()
            leaf[at] = RATE * total_g / (total_h + 1)
            if at >= (1 << DEPTH) - 1 or len(mine) < 20:
                continue
            best, old = 1e-3, total_g**2 / (total_h + 1)
            for j in range(x.shape[1]):
                sg, sh = (np.cumsum(np.bincount(x[mine, j], w[mine], BINS))[:-1] for w in (g, h))
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - old
                gain[(sh < 1) | (total_h - sh < 1)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[at], cut[at] = gain[k], j, k
            if feature[at] >= 0:
                node[mine] = 2 * at + 1 + (x[mine, feature[at]] > cut[at])
        return feature, cut, leaf

    @staticmethod
    def _apply(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, leaf = tree
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(DEPTH):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
        return leaf[node]

    def odds(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        z = np.full(len(x), self.base)
        for tree in self.trees:
            z += self._apply(tree, binned)
        return z


def train(pages: Iterable[str]) -> Trees | None:
    """Trees from the blocks of which the pages themselves say what they are; None if they say nothing."""
    xs, ys = [], []
    for text in pages:
        page = Page(text)
        y = page.evident()
        on = np.flatnonzero(y >= 0)
        xs.append(page.features()[on])
        ys.append(y[on])
    x, y = (np.concatenate(v) if v else np.zeros(0) for v in (xs, ys))
    if len(set(y.tolist())) < 2:
        return None
    blank = x.copy()
    blank[:, [0, 1, 4, 5, 6, 7]] = 0
    both, labels = np.vstack([x, blank]), np.r_[y, y].astype(np.float64)
    weight = np.where(labels == 1, 1 / max(1, labels.sum()), 1 / max(1, (1 - labels).sum())) * len(labels) / 2
    return Trees(both, labels, weight * np.r_[np.ones(len(x)), np.full(len(x), 0.5)])


def _rules(features: np.ndarray) -> np.ndarray:
    """Odds without trained trees: long blocks with few links, outside of parts that are named otherwise."""
    return np.where(features[:, 1] + features[:, 5] + features[:, 7] > 0, -3.0, np.where((features[:, 13] < 0.4) & (features[:, 9] > 3), 2.0, -1.0))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page has empty text. A row with a null id is read like the others; rows repeated under
    one id give one row each. Where no page of the sample says what its parts are, fixed odds by length,
    link share and names take the trees' place.
    """
    chosen = pages.where("html is not null").select("page_id", F.xxhash64("page_id", F.lit("trees")).alias("place"), "html")
    sample = (r["html"] for r in chosen.orderBy("place", "page_id", "html").limit(TRAINING_PAGES).toLocalIterator())
    held = pages.sparkSession.sparkContext.broadcast(train(sample))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = held.value
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                rows = batch.slice(low, 200)
                parsed = [Page(t or "") for t in rows.column("html").to_pylist()]
                features = [p.features() for p in parsed]
                every = np.vstack(features)
                odds = trees.odds(every) if trees else _rules(every)
                texts, at = [], 0
                for page, f in zip(parsed, features):
                    texts.append(page.text(odds[at : at + len(f)]))
                    at += len(f)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page_id").cast(pa.int64()), rows.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema
                )

    return pages.select("page_id", "url", "html").transform(in_arrow, run, "page_id long, url string, text string, n_chars long")
