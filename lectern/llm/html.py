"""Main text of web pages: boosted trees over DOM nodes, then one consistent choice for the whole tree.

The page is read into block elements and the runs of text between their borders;
inline elements belong to the run around them. Every node gets features of
its tag, attribute tokens, depth, subtree density and siblings, and those of its
ancestors. The trees give each node the log-odds of being main text. Decoding goes
bottom-up: a subtree is kept if its own evidence and what its children gain
sum to more than nothing, so nothing is kept inside a dropped ancestor and no
ancestor is kept for the sake of nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.boost import BoostedTrees
from lectern.llm.tables import sampled

#: The trees are fitted on nodes of at most so many pages and bytes, taken by a hash of their id, and on so many layouts made from their texts.
TRAIN_PAGES, TRAIN_BYTES, TRAIN_LAYOUTS = 200, 16 << 20, 500
#: Share of its subtree's text that an element's own evidence weighs.
CONTAINER_WEIGHT = 0.5
PAGES_AT_ONCE = 200

#: Elements without content, elements whose content is never text of a page, and elements inside a line (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style title noscript template svg iframe select textarea button object canvas annotation annotation-xml audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements of a formula, which are inside a line too.
INLINE |= frozenset("math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: A start tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Tags by what they say about their content.
TAG_KINDS = [{"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset"}, {"article", "main"}, {"section"}, {"p", "blockquote", "pre"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"div"}, {"body", "html"}, {"#text"}]
#: Words in class, id and role attributes.
TOKEN_KINDS = [
    "nav navigation navbar menu menubar topmenu breadcrumb breadcrumbs pagination pager tabs toc".split(),
    "header masthead topbar banner logo branding hero".split(),
    "footer foot bottom copyright contentinfo colophon legal".split(),
    "sidebar side aside rail widget widgets complementary related recommended recommendations more popular trending tags".split(),
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense outbrain taboola".split(),
    "comment comments disqus respond reply replies discussion reviews".split(),
    "cookie cookies consent gdpr notice notices alert popup modal overlay message warning dialog".split(),
    "form login signup register search subscribe newsletter share social sharing contact".split(),
    "article content main post entry story text body prose page".split(),
]
_KIND_OF_TAG = {t: k for k, tags in enumerate(TAG_KINDS) for t in tags}
_KIND_OF_TOKEN = {t: k for k, tokens in enumerate(TOKEN_KINDS) for t in tokens}
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""[<>"']""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?,;]")


#: Elements at which the search for an element to end stops.
_FENCES = frozenset("ul ol dl table div section article nav body".split())
_STOPS = _FENCES.union(*ENDS.values())


class Tags:
    """Finds the tags of a page one after the other. Each end of a quoted value and of an element is looked for once, so time is in proportion to the page."""

    def __init__(self, source: str):
        self.source, self.ends, self.unclosed = source, {}, set()

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it closes, name and attributes of the next tag; comments and declarations have no name. None if there is no more."""
        source = self.source
        while True:
            start = source.find("<", at)
            if start < 0:
                return None
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(source), False, "", ""
            name = _NAME.match(source, start + 1)
            if name or source[start + 1 : start + 2] in ("!", "?", "/"):
                end = self._end(name.end()) if name else -1
                if end < 0:  # a stray < or quote: the tag ends at once
                    end = source.find(">", start)
                if end < 0:
                    return None
                return (start, end + 1, bool(name[1]), name[2].lower(), source[name.end() : end]) if name else (start, end + 1, False, "", "")
            at = start + 1

    def _end(self, at: int) -> int:
        """The > that ends a tag, outside of quotes, or -1."""
        passed, end = [], -1
        while (mark := _MARK.search(self.source, at)) and mark[0] != "<":
            k = mark.start()
            if mark[0] == ">":
                end = k
                break
            if k in self.ends:
                end = self.ends[k]
                break
            passed.append(k)
            at = self.source.find(mark[0], k + 1) + 1
            if not at:
                break
        self.ends.update(dict.fromkeys(passed, end))
        return end

    def after(self, name: str, at: int) -> int:
        """Where the element of this name that is open here is over, or -1."""
        if name in self.unclosed:
            return -1
        gone = re.compile(rf"</{re.escape(name)}\b", re.I).search(self.source, at)
        end = self.source.find(">", gone.end()) if gone else -1
        if end < 0:
            self.unclosed.add(name)
        return end + 1 if end >= 0 else -1


class Page:
    """Nodes in page order: parent, tag, kinds of attribute tokens, text (of runs), and characters of the run inside links."""

    def __init__(self, source: str):
        self.parent, self.tag, self.kinds, self.text, self.linked = [-1], ["body"], [0], [None], [0]
        # open elements, of each the nearest one up to it at which a search stops, and how many are open by tag
        stack, stops, open_tags, piece, linked, in_link = [0], [0], Counter(), [], 0, 0

        def close_run() -> None:
            nonlocal linked
            if piece:
                text = " ".join(html.unescape("".join(piece)).split())
                piece.clear()
                if text:
                    self._add(stack[-1], "#text", 0, text, min(linked, len(text)))
            linked = 0

        def close_down_to(k: int) -> None:
            open_tags.subtract(self.tag[i] for i in stack[k:])
            del stack[k:], stops[k:]

        at, end, tags = 0, len(source), Tags(source)
        while at < end:
            found = tags.next(at)
            stop = found[0] if found else end
            if stop > at:
                piece.append(source[at:stop])
                linked += (stop - at) * (in_link > 0)
            if not found:
                break
            _, at, closing, name, attributes = found
            if not name:
                continue
            if name == "br":
                piece.append(" ")
            elif name in INLINE:
                if name == "a":
                    in_link = 0 if closing else 1
            elif name in SKIPPED:
                piece.append(" ")
                if not closing and not attributes.endswith("/"):
                    over = tags.after(name, at)
                    at = over if over >= 0 else (end if name in ("script", "style") else at)
            elif name in VOID:
                if name == "hr":
                    close_run()
            elif name in ("html", "head", "body"):
                close_run()
            elif closing:
                close_run()
                in_link = 0
                if open_tags[name] > 0:
                    k = len(stack) - 1
                    while self.tag[stack[k]] != name:
                        k -= 1
                    close_down_to(k)
            else:
                close_run()
                in_link = 0
                if self.tag[stack[-1]] == "p":
                    close_down_to(len(stack) - 1)
                ended = ENDS.get(name, ())
                k = stops[-1] if ended else 0
                while k:
                    open_ = self.tag[stack[k]]
                    if open_ in ended:
                        close_down_to(k)
                        break
                    if open_ in _FENCES:
                        break
                    k = stops[k - 1]
                kinds = 0
                for each in _NAMES.finditer(attributes):
                    for token in _TOKEN.findall((each[1] or each[2] or each[3] or "").lower()):
                        if token in _KIND_OF_TOKEN:
                            kinds |= 1 << _KIND_OF_TOKEN[token]
                stops.append(len(stack) if name in _STOPS else stops[-1])
                stack.append(self._add(stack[-1], name, kinds, None, 0))
                open_tags[name] += 1
        close_run()

    def _add(self, parent: int, tag: str, kinds: int, text: str | None, linked: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.kinds.append(kinds)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


class Forest:
    """The nodes of several pages as arrays."""

    def __init__(self, pages: list[Page]):
        counts = np.array([len(p.tag) for p in pages])
        self.first = np.cumsum(counts) - counts
        self.page = np.repeat(np.arange(len(pages)), counts)
        parent = np.concatenate([np.array(p.parent) + f for p, f in zip(pages, self.first)])
        parent[self.first] = self.first
        self.parent, self.roots = parent, self.first
        self.text = [t for p in pages for t in p.text]
        self.is_run = np.array([t is not None for t in self.text], bool)
        depth = np.zeros(len(parent), np.int64)
        self.levels, here = [self.first], self.first
        is_root = np.zeros(len(parent), bool)
        is_root[self.first] = True
        order = np.argsort(np.where(is_root, -1, parent), kind="stable")
        sorted_parent = np.where(is_root, -1, parent)[order]
        while True:  # children, level by level
            low, high = np.searchsorted(sorted_parent, here), np.searchsorted(sorted_parent, here, "right")
            n = high - low
            here = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            if not len(here):
                break
            depth[here] = len(self.levels)
            self.levels.append(here)
        self.depth = depth
        size = np.array([len(t) if t else 0 for t in self.text], np.float64)
        self.size = size
        tag = np.array([_KIND_OF_TAG.get(t, len(TAG_KINDS)) for p in pages for t in p.tag])
        kinds = np.array([k for p in pages for k in p.kinds])
        own = np.stack(
            [
                size,
                np.array([k for p in pages for k in p.linked], np.float64),
                np.array([len(_SENTENCE.findall(t)) if t else 0 for t in self.text], np.float64),
                np.array([t.count(" ") + 1 if t else 0 for t in self.text], np.float64),
                self.is_run.astype(np.float64),
                (~self.is_run).astype(np.float64),
            ],
            1,
        )
        self.sub = self.sums(own)
        whole = self.sub[self.first][self.page]
        above = np.zeros((len(parent), len(TAG_KINDS) + 1 + len(TOKEN_KINDS)), np.float32)
        above[np.arange(len(parent)), tag] = 1
        for k in range(len(TOKEN_KINDS)):
            above[:, len(TAG_KINDS) + 1 + k] = kinds >> k & 1
        self_part = above.copy()
        for level in self.levels[1:]:
            above[level] = np.maximum(above[level], above[parent[level]])
        inherited = above[parent]
        inherited[self.first] = 0
        siblings = np.bincount(parent, minlength=len(parent))
        kept = self.sub[:, 0]
        before = np.cumsum(size) - size
        chars = np.maximum(kept, 1)
        parent_chars = np.maximum(self.sub[parent, 0], 1)
        self.features = np.concatenate(
            [
                self_part,
                inherited,
                np.stack(
                    [
                        depth,
                        np.log1p(kept),
                        self.sub[:, 1] / chars,
                        self.sub[:, 2] / chars * 50,
                        self.sub[:, 3] / np.maximum(self.sub[:, 4], 1),
                        self.sub[:, 5] / chars * 50,
                        kept / np.maximum(whole[:, 0], 1),
                        (before - before[self.first][self.page]) / np.maximum(whole[:, 0], 1),
                        siblings[parent],
                        kept / parent_chars,
                        kept * siblings[parent] / parent_chars,
                        self.sub[parent, 1] / parent_chars,
                    ],
                    1,
                ).astype(np.float32),
            ],
            1,
        )

    def sums(self, own: np.ndarray) -> np.ndarray:
        """Of each node, the sum over its subtree."""
        total = own.copy()
        for level in self.levels[:0:-1]:
            np.add.at(total, self.parent[level], total[level])
        return total

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """True for the nodes of the best consistent choice."""
        odds = np.clip(margins, -5, 5)
        gain = np.where(self.is_run, self.size * odds, CONTAINER_WEIGHT * self.sub[:, 0] * odds)
        gain[self.roots] = 0
        for level in self.levels[:0:-1]:
            np.add.at(gain, self.parent[level], np.maximum(gain[level], 0))
        keep = gain > 0
        for level in self.levels[1:]:
            keep[level] &= keep[self.parent[level]]
        return keep


def weak_labels(page: Page) -> list[bool] | None:
    """Labels of the runs of a page whose tags name its article: those inside it, outside of marked parts."""
    inside, bad = [False] * len(page.tag), marked_parts(page)
    for i, (parent, tag) in enumerate(zip(page.parent, page.tag)):
        inside[i] = (parent >= 0 and inside[parent]) or tag in ("article", "main")
    return [a and not b for a, b in zip(inside, bad)] if any(inside) else None


def marked_parts(page: Page) -> list[bool]:
    """Whether a node is in an element that its tag or its names mark as something else than an article."""
    bad = [False] * len(page.tag)
    for i, (parent, tag, kinds) in enumerate(zip(page.parent, page.tag, page.kinds)):
        bad[i] = (parent >= 0 and bad[parent]) or tag in ("nav", "header", "footer", "aside", "form") or bool(kinds & 0b11111111)
    return bad


def plain_runs(page: Page, kept: set[int]) -> list[int]:
    """The kept runs of a page, and those that the page's marks cannot have told from them.

    Where nothing is kept, these are the runs outside of all marked parts that hold a sentence and are not mainly links. On a page without any mark, runs
    that are like a kept one are kept with it: in blocks of the same tag below the same element, with a sentence and not mainly links."""
    bad = marked_parts(page)
    if kept and (any(bad) or any(page.kinds)):
        return sorted(kept)
    plain = [i for i, t in enumerate(page.text) if t and not bad[i] and 2 * page.linked[i] < len(t) and _SENTENCE.search(t)]
    block = lambda i: (page.parent[page.parent[i]], page.tag[page.parent[i]])
    like = {block(i) for i in kept if page.parent[i] > 0}
    return sorted(kept.union(i for i in plain if not kept or (page.parent[i] > 0 and block(i) in like)))


def layouts(runs: list[str], n: int, seed: int = 1) -> list[tuple[Page, list[bool]]]:
    """Pages in many layouts, made from texts that occur; main text is marked while building and known for each run."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p
    long_, short = [r for r in runs if r.count(" ") > 7] or ["A longer line of text, as it stands in an article of some kind."], [r for r in runs if r.count(" ") <= 7] or ["Home", "More"]
    mark = "\x01"

    def some_text() -> str:
        return html.escape(pick(long_) if chance(0.75) else pick(short))

    def words() -> str:
        return html.escape(" ".join((pick(short) if chance(0.6) else pick(long_)).split()[: int(rng.integers(1, 5))]))

    def named(kind: int, tag: str = "div") -> str:
        name = pick(TOKEN_KINDS[kind])
        return f'<{tag} {pick(["class", "id"])}="{name}{pick(["", "-box", " wrap", "_1", " col-4"])}">'

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words()}</a></li>' for _ in range(int(rng.integers(2, 9)))) + "</ul>"

    def boiler(kind: int) -> str:
        if kind in (0, 3):
            inner = links() if chance(0.7) else "".join(f'<a href="/x">{words()}</a> ' for _ in range(5))
            if kind == 3 and chance(0.5):
                inner = f"<h3>{words()}</h3>" + (inner if chance(0.5) else f"<p>{some_text()}</p>")
        elif kind == 5:
            inner = "".join(f"<div class='comment'><b>{words()}</b><p>{some_text()}</p></div>" if chance(0.5) else f"<p>{some_text()}</p>" for _ in range(int(rng.integers(1, 6))))
            inner = (f"<h3>{words()}</h3>" if chance(0.5) else "") + inner
        elif kind == 7:
            inner = f"<label>{words()}</label><input name=q> <p>{words()}</p>"
        else:
            inner = some_text() if chance(0.6) else f"<p>{some_text()}</p>"
            if kind in (1, 2) and chance(0.4):
                inner += links()
        tag = {0: "nav", 1: "header", 2: "footer", 3: "aside", 7: "form"}.get(kind)
        if tag and chance(0.6):
            return (f"<{tag}>" if chance(0.6) else named(kind, tag)) + inner + f"</{tag}>"
        if kind == 5 and chance(0.3):
            return named(kind, "section") + inner + "</section>"
        return named(kind) + inner + "</div>"

    def article() -> str:
        parts = []
        for i in range(int(rng.integers(1, 9))):
            shape = rng.random()
            text = f"{mark}{some_text()}"
            parts.append(f"<h2>{mark}{words()}</h2><p>{text}</p>" if shape < 0.1 else f"<ul><li>{text}</li><li>{mark}{some_text()}</li></ul>" if shape < 0.15 else f"<p><b>{text}<br>" if shape < 0.2 else f"<blockquote><p>{text}</p></blockquote>" if shape < 0.25 else text + "<br>" if shape < 0.28 and not i else f"<p>{text}</p>")
            if chance(0.08):
                parts.append(boiler(int(pick([4, 3, 7]))))
        title = f"<h1>{mark}{words()}</h1>" if chance(0.7) else ""
        body = title + "".join(parts)
        tag = pick(["article", "main", "div", "div", "section", "bare"])
        if tag == "bare":
            return body
        return (named(8, tag) if tag == "div" or chance(0.4) else f"<{tag}>") + body + f"</{tag}>"

    made = []
    for _ in range(n):
        before = [boiler(k) for k in rng.permutation([0, 1, 3, 4, 6, 7])[: int(rng.integers(0, 5))]]
        after = [boiler(k) for k in rng.permutation([2, 3, 4, 5, 5, 0, 6])[: int(rng.integers(0, 5))]]
        source = "".join(before) + article() + "".join(after)
        if chance(0.3):
            source = f"<div class='{pick(['wrapper', 'container', 'page', 'site'])}'>{source}</div>"
        page = Page(f"<html><body>{source}</body></html>")
        main = [bool(t) and mark in t for t in page.text]
        page.text = [t and t.replace(mark, "") for t in page.text]
        made.append((page, main))
    return made


class Model:
    def __init__(self, sources: list[str]):
        """Fits the trees on the pages' own marks and on layouts made from their texts."""
        pages = [Page(s) for s in sources]
        runs = sorted({t for p in pages for t in p.text if t})
        examples = layouts(runs, TRAIN_LAYOUTS)
        examples += [(p, labels) for p in pages if (labels := weak_labels(p))]
        forest = Forest([p for p, _ in examples])
        is_main = np.array([x for _, labels in examples for x in labels], np.float64)
        main = forest.sums((is_main * forest.size)[:, None])[:, 0]
        some = (forest.sub[:, 0] > 0) & (forest.depth > 0)
        y = (main > 0.5 * forest.sub[:, 0]).astype(np.float64)
        weight = np.where(forest.is_run, 1.0, 0.7)
        self.trees = BoostedTrees().fit(forest.features[some], y[some], weight[some])

    def extract(self, sources: list[str | None]) -> list[str]:
        out = []
        for low in range(0, len(sources), PAGES_AT_ONCE):
            pages = [Page(s or "") for s in sources[low : low + PAGES_AT_ONCE]]
            forest = Forest(pages)
            keep = forest.decode(self.trees.margins(forest.features)) & forest.is_run
            kept: list[set[int]] = [set() for _ in pages]
            for i in np.flatnonzero(keep).tolist():
                kept[forest.page[i]].add(i - int(forest.first[forest.page[i]]))
            out += ["\n".join(p.text[i] for i in plain_runs(p, k)) for p, k in zip(pages, kept)]
        return out


def train(pages: DataFrame, limit: int = TRAIN_PAGES, limit_bytes: int = TRAIN_BYTES) -> Model:
    """Fits the model on at most ``limit`` pages."""
    ids = pages.where("page_id IS NOT NULL AND html IS NOT NULL").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(limit)
    taken = pages.where("html IS NOT NULL").select("page_id", "html").join(F.broadcast(ids), "page_id")
    return Model(sorted(sampled(taken, "page_id", "html", limit, limit_bytes)["html"]))


def extract_text(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) to page_id, url, text and n_chars: the blocks of main text in page order, joined by \\n.

    Where the trees keep nothing, and on pages without any mark, ``plain_runs`` adds what is like an article. Character references are decoded and white space inside a block, line breaks included, is one blank. A null, empty or text-free page
    gives an empty text. Each row is a page of its own, also with a null or repeated id; other columns are ignored."""
    model = train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, PAGES_AT_ONCE):
                rows = batch.slice(low, PAGES_AT_ONCE)
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(model.extract(rows.column("html").to_pylist()), pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return rows.withColumn("n_chars", F.length("text").cast("long"))
