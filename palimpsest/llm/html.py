"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded down the tree.

A page becomes its element tree (a lenient reader, text kept whole). Each element gets features: share and density
of the text below it, links, depth, place among its siblings and their densities, and how many of its attribute
tokens, and its ancestors', are words that sites use for content or for boilerplate. Boosted trees (Spark ML) give
the chance that an element belongs to the main text.

Decoding picks one of three states per element: outside (a wrapper above the main text), inside, dropped. Children
of a dropped element are dropped, children of an inside element are inside or dropped, so answers cannot contradict
each other from ancestor to descendant; the best assignment of a page is found bottom-up. Blocks of inside elements
give the text.

Training needs no given labels: pages that mark their article (``article`` or ``main``) are the teachers. At most
about ``SAMPLE`` pages, those with the smallest hash of their id, are used as they are and in rewritten forms, with
plain ``div`` elements whose class tokens come from the word lists, with boilerplate blocks of the article's own
sentences added, so that trees learn tokens and structure, not one site's tags.

Defined cases: a null or empty html gives an empty text; text outside any element belongs to the page; unclosed and
crossed tags are closed as their block demands; without any teaching page, elements whose own or ancestors' tokens
or tags say boilerplate are dropped and the rest kept; equal pages give equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import saved, text_of

SAMPLE, REWRITES, TREES, DEPTH, STEP = 300, 3, 16, 5, 0.3

# Words of class, id and role tokens.
CONTENT_WORDS = set("article content main post entry body story text maincontent articlebody postbody entrycontent hentry prose markdown".split())
BOILER_WORDS = set("""nav navbar navigation menu submenu header masthead topbar footer bottom sidebar aside rail ad ads advert adverts
advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter
subscribe subscription signup share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager comment
comments commentlist respond reply replies disqus discussion widget toolbar login search form copyright legal skip tags outbrain taboola""".split())
BOILER_TAGS = {"nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu"}
SKIPPED = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title", "option", "datalist"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("""html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption""".split())
# An opening tag of the key closes an open element of the value, up to the nearest of the stops.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody", "tr"}, "tfoot": {"tbody", "tr", "td", "th"}}
STOPS = {"ul", "ol", "dl", "table", "select", "html", "body", "menu", "article", "section", "main", "div"}
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(class|id|role|data-truth)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Elements of a page in document order: parent, tag, token counts, own texts (with their place in the page)."""

    __slots__ = ("parent", "tag", "content", "boiler", "truth", "texts")

    def __init__(self, source: str):
        self.parent, self.tag, self.content, self.boiler, self.truth, self.texts = [-1], ["#"], [0], [0], [None], []
        stack, at, size = [0], 0, len(source)
        while at < size:
            m = _TAG.search(source, at)
            end = m.start() if m else size
            if end > at:
                self.texts.append((stack[-1], source[at:end]))
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self._close(stack, name)
                continue
            if name in ENDS_P:
                self._close_open(stack, {"p"}, STOPS | {"td", "th", "li", "button"})
            if name in CLOSES:
                self._close_open(stack, CLOSES[name], STOPS)
            if name in ("br", "hr"):
                self.texts.append((stack[-1], " "))
            self._open(stack[-1], name, m[3])
            if name in RAW:
                close = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(source, at)
                self.texts.append((len(self.tag) - 1, source[at: close.start() if close else size]))
                at = close.end() if close else size
            elif name not in VOID:  # a slash closes void elements only
                stack.append(len(self.tag) - 1)

    def _open(self, parent: int, name: str, attributes: str) -> None:
        content = boiler = 0
        truth = None
        if "=" in attributes:
            for key, value in _ATTR.findall(attributes):
                if key == "data-truth":
                    truth = value.strip("\"'") == "1"
                    continue
                for token in _TOKEN.findall(value):
                    token = token.lower()
                    content += token in CONTENT_WORDS
                    boiler += token in BOILER_WORDS
        self.parent.append(parent), self.tag.append(name), self.content.append(content), self.boiler.append(boiler), self.truth.append(truth)

    def _close(self, stack: list[int], name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                del stack[k:]
                return
            if name not in BLOCKS and self.tag[stack[k]] in BLOCKS:
                return  # an inline end tag does not close a block

    def _close_open(self, stack: list[int], names: set[str], stops: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in names:
                del stack[k:]
                return
            if tag in stops:
                return


KINDS = {t: i for i, ts in enumerate((("article", "main"), ("section",), ("div",), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"),
                                      ("header",), ("nav", "menu"), ("footer",), ("aside",), ("form", "button", "input", "select", "textarea"),
                                      ("ul", "ol", "dl"), ("li", "dd", "dt"), ("a",), ("table", "tbody", "tr", "td", "th"), ("html", "body", "#")), 1) for t in ts}
FEATURES = 27


def node_features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all elements of all pages, and the first row of each page."""
    first = np.cumsum([0, *(len(p.tag) for p in pages)])
    n = int(first[-1])
    parent = np.fromiter((x + f if x >= 0 else -1 for p, f in zip(pages, first.tolist()) for x in p.parent), np.int64, n)
    own = np.zeros((n, 5))  # characters, characters in links, marks, words, elements
    own[:, 4] = 1
    depth, in_link, start = [0] * n, [False] * n, [0] * n
    up_content, up_boiler, sibling = [0] * n, [0] * n, [0] * n
    kind = np.empty(n)
    at = 0
    for p in pages:
        base, seen = at, [0] * len(p.tag)
        for k, (mother, tag) in enumerate(zip(p.parent, p.tag)):
            i = base + k
            kind[i] = KINDS.get(tag, 0)
            if k:
                m = base + mother
                depth[i], in_link[i] = depth[m] + 1, in_link[m] or tag == "a"
                up_content[i] = up_content[m] + (p.content[mother] > 0) + (p.tag[mother] in ("article", "main"))
                up_boiler[i] = up_boiler[m] + (p.boiler[mother] > 0) + (p.tag[mother] in BOILER_TAGS)
                sibling[i] = seen[mother]
                seen[mother] += 1
        place = 0
        for k, text in p.texts:
            if p.tag[k] in SKIPPED:
                continue
            size = len(text)
            row = own[base + k]
            row[0] += size
            row[1] += size if in_link[base + k] else 0
            row[2] += text.count(",") + text.count(".")
            row[3] += text.count(" ") + 1
            if not start[base + k]:
                start[base + k] = place
            place += size
        at += len(p.tag)
    page = np.repeat(np.arange(len(pages)), np.diff(first))
    whole = own.copy()
    deep = np.array(depth)
    for d in range(int(deep.max(initial=0)), 0, -1):
        rows = np.flatnonzero(deep == d)
        np.add.at(whole, parent[rows], whole[rows])
    mother = np.maximum(parent, 0)
    total = whole[first[:-1]][page]
    chars, links, marks, words, tags = (whole[:, c] for c in range(5))
    density = chars / tags
    family = np.zeros((n, 3))
    kids = parent >= 0
    np.add.at(family, parent[kids], np.stack([density[kids], chars[kids], np.ones(kids.sum())], 1))
    around = family[mother]
    content = np.fromiter((x for p in pages for x in p.content), float, n)
    boiler = np.fromiter((x for p in pages for x in p.boiler), float, n)
    sib = np.array(sibling, float)
    safe = lambda a, b: a / np.maximum(b, 1.0)
    return np.stack([
        kind, np.isin(kind, [6, 7, 8, 9, 10]) * 1.0, np.log1p(chars), np.log1p(own[:, 0]), safe(links, chars), safe(marks, words), np.log1p(words),
        safe(chars, words), np.log1p(tags), np.log1p(density), deep.astype(float), sib, safe(sib, around[:, 2] - 1), around[:, 2],
        density * around[:, 2] / np.maximum(around[:, 0], 1.0), safe(chars, around[:, 1]), safe(chars, total[:, 0]), safe(np.array(start, float), total[:, 0]),
        content, boiler, np.array(up_content, float), np.array(up_boiler, float), np.log1p(chars[mother]), kind[mother],
        safe(own[:, 0], chars), family[:, 2], (content > 0) * 1.0 - (boiler > 0)], 1), first


def truths(page: Page) -> list[int | None]:
    """1 inside the marked article, 0 outside, nothing for wrappers of it and for skipped elements."""
    state: list[bool | None] = []
    for k, mother in enumerate(page.parent):
        state.append(page.truth[k] if page.truth[k] is not None else (state[mother] if k else False))
    wraps = [False] * len(state)
    for k in range(len(state) - 1, 0, -1):
        if (state[k] or wraps[k]) and not state[page.parent[k]]:
            wraps[page.parent[k]] = True
    return [None if wraps[k] or page.tag[k] in SKIPPED else int(bool(s)) for k, s in enumerate(state)]


def _marked(source: str) -> str:
    """The page with its teaching marks: the article is true; menus and the like, also in it, are false."""
    main = "article" if re.search("<article[\\s>]", source, re.I) else "main"
    source = re.sub(f"<{main}(?=[\\s>])", f'<{main} data-truth="1"', source, flags=re.I)
    source = re.sub(r"<(nav|footer|aside|form)(?=[\s>])", r'<\1 data-truth="0"', source, flags=re.I)
    return re.sub(r"(<(?:div|section|ul)\s(?=[^>]*(?:class|id)\s*=\s*[\"']?(?:%s)[\"'\s>]))" % "|".join(sorted(BOILER_WORDS)), r'\1data-truth="0" ', source, flags=re.I)


def variants(source: str, seed: int) -> list[str]:
    """Teaching forms of a page: as it is, and with plain elements, drawn tokens and boilerplate of its own sentences."""
    if not re.search("<(article|main)[\\s>]", source, re.I):
        return []
    rng = np.random.default_rng(seed)
    pick = lambda words: str(rng.choice(sorted(words)))
    first = _marked(source)
    text = re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", source)).split()
    if not text:
        return [first]

    def block() -> str:
        k, size = int(rng.integers(0, len(text))), int(rng.integers(3, 60))
        tag, body = ("aside", "form", "div", "section", "div", "ul", "header")[int(rng.integers(0, 7))], " ".join(text[k: k + size])
        inner = f"<li>{body}</li>" if tag == "ul" else f"<p>{body}</p>" if rng.random() < 0.6 else body
        own = f' class="{pick(BOILER_WORDS)}"' if rng.random() < 0.5 else f' id="{pick(BOILER_WORDS)}-{pick(BOILER_WORDS)}"'
        return f'<{tag} data-truth="0"{own}>{inner}</{tag}>'

    def part() -> str:
        """A piece of content in another form: lists, tables and quotes belong to the article too."""
        cut = [" ".join(text[k: k + int(rng.integers(2, 14))]) for k in rng.integers(0, len(text), int(rng.integers(1, 5)))]
        kind = int(rng.integers(0, 4))
        if kind == 0:
            return "<ul>" + "".join(f"<li>{c}</li>" for c in cut) + "</ul>"
        if kind == 1:
            return "<table>" + "".join(f"<tr><td>{c}</td><td>{c[:9]}</td></tr>" for c in cut) + "</table>"
        return f"<blockquote>{cut[0]}</blockquote>" if kind == 2 else f"<h2>{cut[0]}</h2><div><p>{' '.join(cut)}</p></div>"

    return [first, *(_rewritten(first, rng, pick, block, part) for _ in range(REWRITES))]


def _rewritten(page: str, rng, pick, block, part) -> str:
    """One rewritten form: content parts in the article, other elements and tokens, boilerplate between the blocks."""
    at = max(page.find('data-truth="1"'), 0)
    stop = max((m.end() for m in re.finditer("</(?:article|main)>", page, re.I)), default=len(page))
    for end in [m.end() for m in re.finditer("</p>", page[:stop]) if m.end() > at][::-1]:
        if rng.random() < 0.25:
            page = page[:end] + part() + page[end:]
    way = rng.random()
    if way < 0.25:  # no element around the article: its blocks stand for themselves
        start, stop = re.search('<(?:article|main) data-truth="1"[^>]*>', page, re.I), [*re.finditer("</(?:article|main)>", page, re.I)][-1:]
        if start and stop:
            inner = re.sub(r"<(p|h[1-6]|ul|table|blockquote|div)(?=[\s>])(?! data-truth)", r'<\1 data-truth="1"', page[start.end(): stop[0].start()])
            page = page[: start.start()] + inner + page[stop[0].end():]
    elif way < 0.8:
        name = ("div", "section", "main")[int(rng.integers(0, 3))]
        page = re.sub("<(article|main) data-truth", f'<{name} class="{pick(CONTENT_WORDS)}" data-truth', page, flags=re.I)
        page = re.sub("</(article|main)>", f"</{name}>", page, flags=re.I)
    for tag in ("nav", "footer"):
        if rng.random() < 0.5:
            page = re.sub(f"<{tag}(?=[\\s>])", f'<div class="{pick(BOILER_WORDS)}"', page, flags=re.I)
            page = re.sub(f"</{tag}>", "</div>", page, flags=re.I)
    ends = [m.end() for m in re.finditer(r"</p>|</nav>|</h1>|<body[^>]*>|</article>|</main>|</section>|</ul>|</footer>", page)]
    for end in sorted(rng.choice(ends, min(len(ends), 5), replace=False).tolist(), reverse=True) if ends else []:
        page = page[:end] + block() + page[end:]
    return page


def _teach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pages = [Page(v) for source, seed in zip(batch["html"], batch["seed"]) for v in variants(source, int(seed) & 0x7FFFFFFF)]
        if pages:
            rows, _ = node_features(pages)
            label = [t for p in pages for t in truths(p)]
            keep = [i for i, t in enumerate(label) if t is not None and rows[i, 2] > 0]
            yield pd.DataFrame({"x": rows[keep].tolist(), "y": [float(label[i]) for i in keep]})


_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)|Predict: ([-\d.Ee]+)|Tree \d+ \(weight ([-\d.Ee]+)\)")


def read_trees(said: str) -> list[tuple[float, list[tuple[int, float, int, int, float]]]]:
    """The boosted trees from their text form: (weight, nodes); a node is (feature, threshold, left, right, value)."""
    trees: list = []
    open_: list[tuple[int, bool]] = []

    def put(node) -> None:
        nodes = trees[-1][1]
        nodes.append(list(node))
        if open_:
            at, right = open_.pop()
            nodes[at][3 if right else 2] = len(nodes) - 1

    for kind, feature, _, threshold, value, weight in _SPLIT.findall(said):
        if weight:
            trees.append((float(weight), []))
            open_ = []
        elif value:
            put((-1, 0.0, 0, 0, float(value)))
        elif kind == "If":
            put((int(feature), float(threshold), 0, 0, 0.0))
            at = len(trees[-1][1]) - 1
            open_ += [(at, True), (at, False)]
    return trees


#: A page that may teach: it has an article or main element.
MARKED = r"(?i)<(?:article|main)[\s>]"


def learn(pages: DataFrame, sample: int = SAMPLE):
    """The boosted trees of a bounded sample of the pages that mark their article; None where nothing can be learned."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    marked = pages.where(text_of("html").rlike(MARKED))
    mark = F.xxhash64(F.col("page_id").cast("string"), F.lit("teach"))
    # the pages of the smallest marks, whatever the number of pages
    last = marked.select(mark.alias("seed")).orderBy("seed").limit(sample).agg(F.max("seed")).first()[0]
    some = marked.select(text_of("html").alias("html"), mark.alias("seed")).where(F.col("seed") <= F.lit(last).cast("long"))
    rows = saved(some.mapInPandas(_teach, "x array<double>, y double"))
    if rows.select("y").distinct().count() < 2:
        return None
    table = rows.select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=32, seed=1, cacheNodeIds=False).fit(table)
    return read_trees(model.toDebugString)


def chances(x: np.ndarray, trees) -> np.ndarray:
    """The chance of each element to belong to the main text."""
    if trees is None:
        return np.where((x[:, 1] > 0) | (x[:, 19] > 0) | (x[:, 21] > 0), 0.05, 0.9)
    margin = np.zeros(len(x))
    for weight, nodes in trees:
        feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
        feature, at = feature.astype(int), np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            here = at[rows]
            at[rows] = np.where(x[rows, feature[here]] <= threshold[here], left[here], right[here]).astype(int)
        margin += weight * value[at]
    return 1 / (1 + np.exp(-2 * margin))


def decode(page: Page, chance: np.ndarray, own: np.ndarray) -> list[bool]:
    """The likeliest states without contradictions: which elements are inside."""
    n = len(page.tag)
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    weight = (0.2 + own).tolist()
    inside, out = np.log(p).tolist(), np.log(1 - p).tolist()
    score = [[0.0, 0.0, 0.0] for _ in range(n)]  # outside, inside, dropped: best sum of each subtree
    for k in range(n - 1, -1, -1):
        w = weight[k]
        dead = page.tag[k] in SKIPPED
        s = score[k]
        s[0] += -1e6 if dead else out[k] * w if own[k] > 0 else -0.05
        s[1] += -1e6 if dead else inside[k] * w
        s[2] += out[k] * w
        if k:
            m = score[page.parent[k]]
            m[2] += s[2]
            best = max(s[1], s[2])
            m[1] += best
            m[0] += max(best, s[0])
    state = [0] * n
    for k in range(n):
        above = state[page.parent[k]] if k else 0
        s = score[k]
        if above == 2:
            state[k] = 2
        elif above == 1:
            state[k] = 1 if s[1] >= s[2] else 2
        else:
            state[k] = max(range(3), key=lambda c: (s[c], -c))
    return [c == 1 for c in state]


def main_text(page: Page, inside: list[bool]) -> str:
    """Blocks of the inside elements, in page order; white space inside a block becomes one space."""
    block = [0] * len(page.tag)
    for k in range(1, len(page.tag)):
        block[k] = k if page.tag[k] in BLOCKS else block[page.parent[k]]
    out: list[list[str]] = [[]]
    last = None
    for k, text in page.texts:
        if block[k] != last:
            out.append([])
            last = block[k]
        if inside[k]:
            out[-1].append(references.unescape(text))
        elif text.strip():
            last = None  # what comes after a dropped part is a block of its own
    return " ".join(x for x in (" ".join("".join(parts).split()) for parts in out) if x)


def extract_texts(sources: list[str], trees) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    x, first = node_features(pages)
    p, own = chances(x, trees), x[:, 3]
    return [main_text(page, decode(page, p[a:b], own[a:b])) for page, a, b in zip(pages, first[:-1], first[1:])]


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Pages (page_id, url, html) → (page_id, url, text, n_chars)."""
    sent = pages.sparkSession.sparkContext.broadcast(learn(pages, sample))

    @F.pandas_udf(T.StringType())
    def text(source: pd.Series) -> pd.Series:
        out: list[str] = []
        for at in range(0, len(source), 200):
            out += extract_texts(source.iloc[at: at + 200].tolist(), sent.value)
        return pd.Series(out, dtype=object)
    return (pages.select("page_id", "url", text(text_of("html")).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))
