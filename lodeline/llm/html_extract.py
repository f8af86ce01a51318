"""Main text of HTML pages: boosted trees over DOM nodes, decoded down the tree.

Every block element gets the log-odds of belonging to the article, from its tag,
the words of its attributes and of those around it, how dense its subtree is in
text, links and tags, its depth, and its siblings. Choices are then made for the
whole tree at once: what stands inside a dropped element is dropped, what is kept
has all elements around it kept, and among those choices the most likely one is
taken. Inline elements follow their block.

The trees are trained on pages that ``training_page`` makes up: many layouts with
known roles, sized ``TRAINING_PAGES``. Defined cases: a null or empty page has an
empty text; a page without an article has none; rows with equal ids are rows
like others.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm import boosting
from lodeline.llm.common import texts
from lodeline.llm.dom import Tree, block_text, blocks_of, parse

TRAINING_PAGES = 500
# Blocks whose features are judged together; the pages of a task are held up to so many.
HELD_BLOCKS = 20_000
SEED = 5

# Words in attributes that tell what an element is for, by purpose.
PURPOSES = {
    "menu": "nav navigation navbar menu menus breadcrumb breadcrumbs topbar toolbar tabs pagination pager skip",
    "header": "header masthead logo branding top banner hero site",
    "footer": "footer foot copyright legal colophon bottom imprint",
    "side": "sidebar side aside rail widget widgets related trending popular recommended more tags",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion dfp adsense",
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay banner warning paywall hidden dialog alertdialog",
    "form": "form search login signin signup subscribe subscription newsletter contact register input field",
    "comment": "comment comments reply replies respond discussion disqus thread reactions reviews",
    "share": "share sharing social follow facebook twitter buttons print",
    "article": "article post entry content story body main text page blog news hentry articlebody single",
}
_PURPOSE_OF: dict[str, list[int]] = {}
for _i, _words in enumerate(PURPOSES.values()):
    for _word in _words.split():
        _PURPOSE_OF.setdefault(_word, []).append(_i)
_TAGS = [
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "dd"}, {"ul", "ol", "dl", "menu"}, {"div"}, {"section"},
    {"article", "main"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "select", "textarea", "option", "legend"},
    {"table", "tr", "td", "th", "tbody", "thead"}, {"blockquote", "pre", "figure", "figcaption"}, {"body", "html", "#page"},
]
_TAG_OF = {tag: i for i, tags in enumerate(_TAGS) for tag in tags}
_N_TAGS, _N_PURPOSES = len(_TAGS), len(PURPOSES)
# Parts of a page that hold no text of its body.
_NO_BODY = {"head", "title"}


def node_features(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of features of the block nodes, their numbers, and the characters of their own text."""
    nodes, block_of = tree.nodes, blocks_of(tree)
    n = len(nodes)
    own, links, words, stops = (np.zeros(n) for _ in range(4))
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = nodes[i].link or in_link[nodes[i].parent]
    started = np.full(n, -1.0)
    total = 0
    for node, text in tree.pieces:
        if text is None:
            continue
        held = text.strip()
        if not held:
            continue
        block = block_of[node]
        own[block] += len(held)
        words[block] += held.count(" ") + 1
        stops[block] += held.count(".") + held.count(",") + held.count("?") + held.count("!")
        if in_link[node]:
            links[block] += len(held)
        if started[block] < 0:
            started[block] = total
        total += len(held)
    chars, link_chars, n_words, n_stops, tags = own.copy(), links.copy(), words.copy(), stops.copy(), np.ones(n)
    first = started.copy()
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        for sums in (chars, link_chars, n_words, n_stops, tags):
            sums[up] += sums[i]
        if first[i] >= 0 and (first[up] < 0 or first[i] < first[up]):
            first[up] = first[i]

    blocks = [i for i in range(n) if block_of[i] == i]
    siblings: dict[int, list[int]] = {}
    for i in blocks[1:]:
        siblings.setdefault(block_of[nodes[i].parent], []).append(i)
    position, same = [0] * n, [1] * n
    for family in siblings.values():
        counts = Counter(nodes[j].tag for j in family)
        for place, j in enumerate(family):
            position[j], same[j] = place, counts[nodes[j].tag]
    around = np.zeros((n, _N_TAGS + _N_PURPOSES))
    rows = np.zeros((len(blocks), 2 * (_N_TAGS + _N_PURPOSES) + 16))
    wide = _N_TAGS + _N_PURPOSES
    for r, i in enumerate(blocks):
        node = nodes[i]
        mine = np.zeros(wide)
        if node.tag in _TAG_OF:
            mine[_TAG_OF[node.tag]] = 1
        for token in node.tokens:
            for purpose in _PURPOSE_OF.get(token, ()):
                mine[_N_TAGS + purpose] = 1
        up = block_of[node.parent] if i else -1
        rows[r, :wide] = mine
        if i:
            rows[r, wide : 2 * wide] = around[up]
        around[i] = np.maximum(around[up], mine) if i else mine
        family = len(siblings[up]) if i else 1
        size = max(chars[i], 1.0)
        rows[r, 2 * wide :] = (
            node.depth, position[i], family, same[i] / family,
            own[i], chars[i], link_chars[i] / size, tags[i], chars[i] / tags[i], n_words[i], n_stops[i] / size * 100,
            chars[i] / max(total, 1), max(first[i], 0) / max(total, 1),
            link_chars[up] / max(chars[up], 1) if i else 0, chars[up] / max(total, 1) if i else 1, own[i] / size,
        )
    return rows, np.array(blocks), own[blocks]


def decode(tree: Tree, blocks: np.ndarray, log_odds: np.ndarray, own: np.ndarray) -> list[bool]:
    """The most likely choice in which no kept node stands in a dropped one."""
    block_of = blocks_of(tree)
    keep, drop = {}, {}
    for i, odds, chars in zip(blocks.tolist(), log_odds.tolist(), own.tolist()):
        weight = 1 + log1p(chars)
        keep[i] = -weight * log1p(np.exp(-odds))
        drop[i] = -weight * log1p(np.exp(odds))
        if tree.nodes[i].tag in _NO_BODY:
            keep[i] = -np.inf
    for i in blocks[::-1].tolist():
        if i:
            up = block_of[tree.nodes[i].parent]
            keep[up] += max(keep[i], drop[i])
            drop[up] += drop[i]
    kept = [False] * len(tree.nodes)
    for i, node in enumerate(tree.nodes):
        if block_of[i] != i:
            kept[i] = kept[node.parent]
        elif i == 0:
            kept[i] = keep[0] >= drop[0]
        else:
            kept[i] = kept[block_of[node.parent]] and keep[i] >= drop[i]
    return kept


# ---- pages to train on


def training_page(draw: random.Random) -> str:
    """A made-up page; content elements carry ``data-c`` as an attribute that is no feature."""
    letters = "aaeeiioouubcdfghklmnprstvwz"

    def word() -> str:
        return "".join(draw.choice(letters) for _ in range(draw.randint(2, 9)))

    def prose(low: int = 3, high: int = 60) -> str:
        found = [word() for _ in range(draw.randint(low, high))]
        found[0] = found[0].title()
        noise = draw.choice(["", "", "", "###", "!!", " |", "&amp;&amp;"])
        for i in range(len(found)):
            found[i] += draw.choice([",", ".", noise, "", "", "", "", ""])
        return " ".join(found) + draw.choice([".", ".", "", "."])

    def inline(text: str) -> str:
        if draw.random() < 0.25:
            return text + f' <a href="/{word()}">{word()}</a> ' + prose(1, 8)
        return draw.choice(["{}", "{}", "<b>{}</b>", "<span>{}</span>"]).format(text)

    def mark(purpose: str, chance: float = 0.75) -> str:
        if draw.random() > chance:
            return ""
        named = draw.choice(PURPOSES[purpose].split())
        if draw.random() < 0.3:
            named += draw.choice(["-", "_", " "]) + draw.choice([word(), "box", "wrap", "container", "inner", "1"])
        return f' {draw.choice(["class", "class", "id"])}="{named}"'

    def links(low: int = 2, high: int = 9) -> str:
        each = draw.choice(['<li><a href="/{0}">{0}</a></li>', '<a href="/{0}">{0}</a> ', '<li><a href="#">{0} {0}</a>'])
        listed = "".join(each.format(word()) for _ in range(draw.randint(low, high)))
        return f"<ul>{listed}</ul>" if each.startswith("<li") else listed

    def content() -> str:
        kind = draw.random()
        if kind < 0.6:
            return f"<p data-c>{inline(prose(draw.choice([1, 3]), draw.choice([4, 60])))}" + draw.choice(["</p>", "</p>", "</p>", ""])
        if kind < 0.7:
            return f"<p data-c><b>{prose(1, 15)}<br>"
        if kind < 0.8:
            return f"<h{(n := draw.randint(2, 4))} data-c>{prose(1, 8)}</h{n}>"
        if kind < 0.87:
            end = draw.choice(["</li>", ""])
            return "<ul data-c>" + "".join(f"<li data-c>{inline(prose(1, draw.choice([2, 15])))}{end}" for _ in range(draw.randint(1, 6))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote data-c><p data-c>{prose()}</p></blockquote>"
        if kind < 0.96:
            return f"<div data-c>{inline(prose())}</div>"
        return f'<table data-c><tr data-c><td data-c>{prose(1, 5)}</td><td data-c>{prose(1, 5)}</td></tr></table>'

    def aside(kind: str) -> str:
        plain = draw.choice(["div", "div", "section"])
        tag = {
            "menu": draw.choice(["nav", "nav", plain, "ul"]), "header": draw.choice(["header", "header", plain]),
            "footer": draw.choice(["footer", "footer", plain]), "side": draw.choice(["aside", "aside", plain]),
            "advert": draw.choice([plain, plain, "aside"]), "form": "form", "notice": plain, "comment": plain, "share": draw.choice([plain, "ul"]),
        }[kind]
        sure = tag in ("nav", "header", "footer", "aside", "form")
        named = mark(kind, 0.5 if sure else 1.0)
        inner = {
            "menu": lambda: links(),
            "header": lambda: draw.choice(["", f"<h1>{prose(1, 4)}</h1>", f'<a href="/">{word()}</a>']) + draw.choice(["", f"<p>{prose(2, 10)}</p>", links()]),
            "footer": lambda: draw.choice(["&copy; ", ""]) + prose(2, 20) + draw.choice(["", links(), f"<p>{prose(2, 20)}</p>", " &middot; " + prose(2, 8)]),
            "side": lambda: draw.choice(["", f"<h3>{prose(1, 3)}</h3>"]) + draw.choice([links(), f"<p>{prose(3, 40)}</p>", f"<ul><li>{prose(2, 8)}</li><li>{prose(2, 8)}</li></ul>"]),
            "advert": lambda: draw.choice([prose(2, 25), f"<p>{prose(2, 25)}</p>", f'<a href="/{word()}">{prose(2, 10)}</a>']),
            "form": lambda: f"<label>{prose(1, 3)}</label><input name=q><button>{word()}</button>" + draw.choice(["", f"<p>{prose(2, 20)}</p>", f"<select><option>{word()}<option>{word()}</select>", f"<textarea>{prose(1, 5)}</textarea>"]),
            "notice": lambda: draw.choice([prose(4, 30), f"<p>{prose(4, 40)}</p>"]) + draw.choice(["", f"<button>{word()}</button>", f'<a href="/x">{word()}</a>']),
            "comment": lambda: draw.choice(["", f"<h3>{prose(1, 3)}</h3>"]) + "".join(f"<div{mark('comment')}><p>{prose(2, 50)}</p></div>" if draw.random() < 0.7 else f"<p>{prose(2, 50)}</p>" for _ in range(draw.randint(1, 5))),
            "share": lambda: links(2, 5),
        }[kind]()
        return f"<{tag}{named}>{inner}</{tag}>"

    title = prose(2, 10)
    heading = draw.choice([f"<h1 data-c>{title}</h1>", f"<h1 data-c>{title}</h1>", f"<header data-c><h1 data-c>{title}</h1></header>", ""])
    body = [content() for _ in range(draw.choice([1, 2, 3, 5, 8, 12, 20, 30]))]
    if draw.random() < 0.35:
        body.insert(draw.randint(0, len(body)), aside(draw.choice(["advert", "side", "share", "notice", "form"])))
    if draw.random() < 0.2:
        body.append(aside("comment"))
    tag = draw.choice(["article", "article", "article", "main", "div", "section"])
    main = f"<{tag} data-c{mark('article', 0.4 if tag in ('article', 'main') else 1.0)}>{heading}{''.join(body)}</{tag}>"
    before = [aside(k) for k in ("header", "menu", "notice", "advert", "form", "side") if draw.random() < 0.45]
    after = [aside(k) for k in ("comment", "side", "advert", "share", "form", "notice", "footer", "footer") if draw.random() < 0.4]
    draw.shuffle(before)
    inner = "".join([*before, main, *after])
    for _ in range(draw.choice([0, 0, 0, 1, 2])):
        inner = f'<div{draw.choice(["", mark("article"), " class=wrap", " id=container"])} data-c>{inner}</div>'
    head = f"<head><meta charset=utf-8><title>{title}</title><style>p{{margin:0}}</style></head>"
    return f"<!DOCTYPE html><html data-c>{head}<body data-c>{inner}</body></html>"


@cache
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> boosting.Forest:
    """The trees, trained on so many made-up pages."""
    draw = random.Random(seed)
    rows, labels = [], []
    for _ in range(pages):
        html = training_page(draw)
        tree = parse(html)
        found, blocks, _ = node_features(tree)
        rows.append(found)
        labels += [i == 0 or tree.nodes[i].marked for i in blocks.tolist()]
    return boosting.train(np.concatenate(rows), np.array(labels, float))


def main_text(html: str, forest: boosting.Forest) -> str:
    if not html:
        return ""
    tree = parse(html)
    rows, blocks, own = node_features(tree)
    return block_text(tree, decode(tree, blocks, forest.log_odds(rows), own))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    forest = pages.sparkSession.sparkContext.broadcast(trained())

    def judged(trees: list[Tree], measured: list[tuple]) -> Iterator[str]:
        odds = forest.value.log_odds(np.concatenate([m[0] for m in measured]))
        at = 0
        for tree, (rows, blocks, own) in zip(trees, measured):
            yield block_text(tree, decode(tree, blocks, odds[at : at + len(rows)], own))
            at += len(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, trees, measured, held = [], [], [], 0
            for html in texts(batch.column(2)):
                trees.append(parse(html))
                measured.append(node_features(trees[-1]))
                held += len(measured[-1][0])
                if held > HELD_BLOCKS:
                    found += judged(trees, measured)
                    trees, measured, held = [], [], 0
            if trees:
                found += judged(trees, measured)
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
