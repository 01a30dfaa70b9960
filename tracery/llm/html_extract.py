"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest_batches, pieces, table

#: Given pages at most, of which labelled pages are made: those with the smallest hash of their url and id.
TRAIN_PAGES = 300
#: Blocks of a training page that make one chain at most.
CHAIN = 200

# Kinds of elements.
BLOCK = set("html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main aside nav header footer form fieldset legend blockquote pre figure figcaption address hr details summary dialog center menu".split())
RAW = set("script style title textarea iframe".split())
#: Elements whose content is unseen up to their own closing tag; one that is never closed hides nothing.
HIDDEN = set("noscript template svg select button object canvas".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody"}
#: Words in class, id or role of an element that tell what it is for.
HINTS = set("""ad ads advert advertisement sponsor sponsored promo banner sidebar side rail widget related recommend more comment comments reply replies respond discussion disqus
 notice cookie cookies consent gdpr alert warning modal popup overlay subscribe newsletter signup login register search form share social follow breadcrumb breadcrumbs
 nav navbar navigation menu toolbar tabs footer header masthead topbar copyright legal meta tags pagination pager skip hidden
 content article post entry story main body text page prose copy""".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_NAMES = re.compile(r"(class|id|role|data-main|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_PHRASES = re.compile(r"copyright|all rights reserved|©|cookies?\b|subscribe|sign (?:up|in)|log ?in|advertis|sponsored|comments?\b|privacy|terms of|powered by|read more|share (?:this|on)|related", re.I)


class Block:
    __slots__ = ("label", "link", "path", "text")

    def __init__(self, path: tuple, text: str, link: int, label: int | None) -> None:
        self.path, self.text, self.link, self.label = path, text, link, label


def _describe(tag: str, attributes: str) -> tuple[str, int | None]:
    """An element's tag with its telling words, and its label where a labelled page gives one."""
    label, words = None, []
    for name, *values in _NAMES.findall(attributes) if attributes else ():
        value = next((v for v in values if v), "").lower()
        if name.lower() == "data-main":
            label = int(value)
        elif name.lower() == "style":
            if "display:none" in value.replace(" ", ""):
                words.append("hidden")
        elif "hidden" in name.lower():
            if value != "false":
                words.append("hidden")
        else:
            words += [w for w in _WORD.findall(value) if w in HINTS]
    return " ".join([tag, *sorted(set(words))]), label


def leaf_blocks(html: str) -> list[Block]:
    """Blocks of text in page order: the text between two boundaries of block elements. Character references are
    decoded; white space is one space; scripts, styles, comments and other unseen elements are left out."""
    blocks: list[Block] = []
    stack: list[tuple[str, str, int | None]] = []
    parts: list[str] = []
    link = 0
    opened: list[tuple] = []  # of each open hidden element: its entry of the stack, and what there was before it

    def flush():
        nonlocal parts, link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(tuple(s[1] for s in stack), text, link, next((s[2] for s in reversed(stack) if s[2] is not None), None)))
            parts, link = [], 0

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            text = unescape(html[at:stop])
            parts.append(text)
            if any(s[0] == "a" for s in stack):
                link += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    while opened and opened[-1][0] > k:
                        opened.pop()
                    if tag in HIDDEN:
                        _, n, parts, length, link = opened.pop()
                        del blocks[n:], parts[length:]
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK and tag not in BLOCK and (tag not in HIDDEN or stack[k][0] in ("html", "body", "table", "td", "th", "caption")):
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW and not (attributes.endswith("/") and any(s[0] == "svg" for s in stack)):
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] in BLOCK or stack[k][0] in HIDDEN:
                        break
            if tag in ("li", "tr", "td", "th", "dt", "dd"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "table", "tr", "dl", "menu") or stack[k][0] in HIDDEN:
                        break
        if tag not in VOID and not attributes.endswith("/"):
            if tag in HIDDEN:
                opened.append((len(stack), len(blocks), parts, len(parts), link))
            stack.append((tag, *_describe(tag, attributes)))
    flush()
    return blocks


def path_features(path: tuple) -> list[str]:
    """Features of a block's ancestors: their tags, their telling words, the nearest block and whether any is an article."""
    out, tags = [], []
    for element in path:
        tag, *words = element.split(" ")
        tags.append(tag)
        out += [f"in:{tag}", *(f"hint:{w}" for w in words), *(f"at:{tag}.{w}" for w in words)]
    block = next((t for t in reversed(tags) if t in BLOCK), "none")
    out.append(f"block:{block}")
    body = any(t in ("article", "main") for t in tags) or any(f"hint:{w}" in out for w in ("content", "article", "post", "entry", "story", "main"))
    aside = any(t in ("nav", "aside", "footer", "header", "form", "menu", "dialog") for t in tags)
    out += [f"body:{body}", f"aside:{aside}", f"body:{body}.{block}", f"depth:{min(len(tags), 8)}"]
    return list(dict.fromkeys(out))


def text_features(block: Block, place: float) -> list[str]:
    text = block.text
    n = len(text.split())
    links = block.link / max(len(text), 1)
    out = [f"words:{min(n.bit_length(), 7)}", f"links:{min(int(links * 4), 3)}", "end" if text[-1] in ".!?…\"'»”" else "open"]
    if _PHRASES.search(text):
        out.append("phrase:short" if n < 25 else "phrase:long")
    if place < 0.1 or place > 0.9:
        out.append("edge:low" if place > 0.5 else "edge:high")
    return out


class ChainCRF:
    """Two labels (other, main) with weights for features, for neighbouring labels and for the first."""

    def __init__(self, pages: list[list[tuple[list[str], int]]], epochs: int = 120, ridge: float = 0.02) -> None:
        names = sorted({f for page in pages for features, _ in page for f in features})
        self.index = {f: k for k, f in enumerate(names)}
        steps = max(map(len, pages), default=1)
        n = len(pages)
        inside = np.zeros((n, steps), bool)
        gold = np.zeros((n, steps), np.int64)
        rows, cols = [], []
        for i, page in enumerate(pages):
            for t, (features, label) in enumerate(page):
                inside[i, t], gold[i, t] = True, label
                rows += [i * steps + t] * len(features)
                cols += [self.index[f] for f in features]
        rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
        self.weight, self.step, self.first = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
        total = max(inside.sum(), 1)
        scale = [np.zeros_like(v) + 1e-8 for v in (self.weight, self.step, self.first)]
        known = np.eye(2)[gold] * inside[..., None]
        pair = np.einsum("nti,ntj,nt->ij", known[:, :-1], known[:, 1:], inside[:, 1:].astype(float)) if steps > 1 else np.zeros((2, 2))
        for _ in range(epochs):
            emit = np.stack([np.bincount(rows, weights=self.weight[cols, k], minlength=n * steps) for k in (0, 1)], axis=1).reshape(n, steps, 2)
            node, edge = self._marginals(emit, inside)
            error = (known - node).reshape(-1, 2)
            slopes = (
                np.stack([np.bincount(cols, weights=error[rows, k], minlength=len(names)) for k in (0, 1)], axis=1) / total - ridge / 10 * self.weight,
                (pair - edge) / total - ridge / 10 * self.step, (known[:, 0] - node[:, 0]).sum(axis=0) / total - ridge / 10 * self.first,
            )
            for v, g, s in zip((self.weight, self.step, self.first), slopes, scale, strict=True):
                s += g * g
                v += 0.25 * g / np.sqrt(s)

    def _marginals(self, emit: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward over all pages at once: probabilities of labels, and summed ones of neighbouring labels."""
        n, steps, _ = emit.shape
        ahead, back = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0] + self.first
        for t in range(1, steps):
            new = np.logaddexp(ahead[:, t - 1, :1] + self.step[0], ahead[:, t - 1, 1:] + self.step[1]) + emit[:, t]
            ahead[:, t] = np.where(inside[:, t, None], new, ahead[:, t - 1])
        for t in range(steps - 2, -1, -1):
            later = back[:, t + 1] + emit[:, t + 1]
            new = np.logaddexp(self.step[:, 0] + later[:, :1], self.step[:, 1] + later[:, 1:])
            back[:, t] = np.where(inside[:, t + 1, None], new, 0)
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        node = np.exp(ahead + back - whole[:, None, None]) * inside[..., None]
        edge = np.zeros((2, 2))
        for t in range(1, steps):
            p = np.exp(ahead[:, t - 1, :, None] + self.step + (emit[:, t] + back[:, t])[:, None, :] - whole[:, None, None])
            edge += (p * inside[:, t, None, None]).sum(axis=0)
        return node, edge

    def emission(self, features: list[str]) -> tuple[float, float]:
        found = [self.index[f] for f in features if f in self.index]
        a, b = self.weight[found].sum(axis=0)
        return float(a), float(b)

    def viterbi(self, emissions: list[tuple[float, float]]) -> list[int]:
        """The likeliest labels of a page's blocks."""
        (s00, s01), (s10, s11) = self.step.tolist()
        back = []
        a, b = self.first.tolist()
        for k, (x, y) in enumerate(emissions):
            if k:
                back.append((a + s00 < b + s10, a + s01 < b + s11))
                a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
            else:
                a, b = a + x, b + y
        labels = [int(b > a)]
        for from_other, from_main in reversed(back):
            labels.append(int(from_main if labels[-1] else from_other))
        return labels[::-1]


#: Labelled layouts: data-main marks what is main text (1) or not (0). {p} is a paragraph, {s} a sentence, {w} a few words.
LAYOUTS = [
    '<body data-main="0"><header><h2>{w}</h2><p>{s}</p></header><nav><ul><li><a>{w}</a></li><li><a>{w}</a></li></ul></nav><main data-main="1"><h1>{w}</h1><p>{p}</p><p>{p}</p><ul><li>{s}</li><li>{w}</li></ul><p>{p}</p></main><aside><h3>{w}</h3><p>{s}</p><p>{p}</p></aside><footer><p>&copy; {w}</p></footer></body>',
    '<body data-main="0"><div class="cookie-notice"><p>{s}</p></div><div class="menu"><a>{w}</a> <a>{w}</a></div><div id="content" data-main="1"><h1>{w}</h1><p>{s}</p><p>{p}</p><blockquote>{s}</blockquote><p>{p}</p></div><div id="comments"><h3>{w}</h3><div class="comment"><p>{s}</p></div><div class="comment"><p>{p}</p></div></div><div class="footer">{w}</div></body>',
    '<body data-main="0"><nav><a>{w}</a></nav><article data-main="1"><h1>{w}</h1><p>{p}</p><div class="ad" data-main="0">{s}</div><p>{p}</p><aside data-main="0"><p>{s}</p></aside><h2>{w}</h2><p>{p}</p><form data-main="0"><label>{w}</label><p>{s}</p></form><section class="comments" data-main="0"><h2>{w}</h2><article><p>{s}</p></article><p>{p}</p></section></article><footer>{w} &middot; {w}</footer></body>',
    '<body data-main="0"><div class="topbar">{w}</div><div class="wrapper"><div class="sidebar"><h4>{w}</h4><ul><li><a>{w}</a></li><li><a>{w}</a></li></ul><p>{s}</p></div><div class="post-body" data-main="1"><h2>{w}</h2><p>{p}</p><table><tr><td>{w}</td><td>{w}</td></tr></table><pre>{s}</pre><p>{s}</p></div></div><div class="related"><h3>{w}</h3><a>{s}</a></div><div class="notice">{s}</div></body>',
    '<body data-main="0"><header class="masthead"><h1>{w}</h1><form><p>{w}</p></form></header><section class="story" data-main="1"><h1>{w}</h1><h2>{s}</h2><p>{p}</p><figure><figcaption>{s}</figcaption></figure><p>{p}</p><div class="newsletter" data-main="0"><p>{s}</p></div><p>{s}</p></section><div class="share"><a>{w}</a><a>{w}</a></div><aside class="related"><p>{s}</p></aside><footer><ul><li><a>{w}</a></li></ul><p>{s}</p></footer></body>',
    '<body data-main="0"><div class="banner advert"><p>{p}</p></div><article data-main="1"><header><h1>{w}</h1></header><p>{p}</p><p>{w}</p><p>{p}</p><footer data-main="0"><p>{w}</p></footer></article><div id="respond" class="comments"><p>{s}</p><ol><li><p>{p}</p></li><li><p>{s}</p></li></ol></div><div class="ad">{s}</div></body>',
    '<body data-main="0"><div role="navigation"><ul><li><a>{w}</a></li></ul></div><div class="entry-content" data-main="1"><p>{p}</p><p>{s}</p><p>{p}</p></div><div class="widget"><p>{s}</p></div><div role="alert" class="notice"><p>{s}</p></div><footer><div>{s}</div></footer></body>',
]


def labelled_pages(pages: list[str]) -> list[list[tuple[list[str], int]]]:
    """Training pages: the given ones, of which an article element is the main text and all else is not, and the
    labelled layouts filled with their words."""
    out, paragraphs = [], []
    for html in pages:
        blocks = leaf_blocks(html)
        if any("article" in (e.split(" ")[0] for e in b.path) for b in blocks):
            page = []
            for k, b in enumerate(blocks):
                tags = [e.split(" ")[0] for e in b.path]
                inner = tags[tags.index("article") :] if "article" in tags else []
                words = {w for e in b.path[len(tags) - len(inner) :] for w in e.split(" ")[1:]}
                main = bool(inner) and not {"nav", "aside", "footer", "form"} & set(inner) and not words & {"ad", "ads", "advert", "comment", "comments", "notice", "sidebar"}
                page.append((path_features(b.path) + text_features(b, k / len(blocks)), int(main)))
                if main and len(b.text) > 80:
                    paragraphs.append(b.text)
            # long pages train as chains of CHAIN blocks each, as shorter ones are filled up to the longest
            out += [page[a : a + CHAIN] for a in range(0, len(page), CHAIN)]
    random = np.random.default_rng(17)
    paragraphs = paragraphs or ["A few plain words of text stand here. They end soon."]
    for k in range(len(LAYOUTS) * 40):
        def fill(m):
            words = paragraphs[random.integers(len(paragraphs))].split()
            n = {"p": int(random.integers(8, 120)), "s": int(random.integers(3, 22)), "w": int(random.integers(1, 7))}[m[1]]
            return " ".join(words[:n]).replace("<", "").replace("&", "and") + random.choice([".", ".", "", "!"] if m[1] != "w" else ["", "", "."])
        html = re.sub(r"\{([psw])\}", fill, LAYOUTS[k % len(LAYOUTS)])
        blocks = leaf_blocks(html)
        out.append([(path_features(b.path) + text_features(b, i / len(blocks)), b.label or 0) for i, b in enumerate(blocks)])
    return out


def main_text(html: str | None, crf: ChainCRF, paths: dict) -> str:
    """The main blocks of a page, joined by one space; empty without html or main blocks. ``paths`` remembers ancestors' weights."""
    blocks = leaf_blocks(html or "")
    if not blocks:
        return ""
    emissions = []
    for k, b in enumerate(blocks):
        own = paths.get(b.path)
        if own is None:
            if len(paths) > 100_000:
                paths.clear()
            own = paths[b.path] = crf.emission(path_features(b.path))
        key = tuple(text_features(b, k / len(blocks)))
        text = paths.get(key)
        if text is None:
            text = paths[key] = crf.emission(list(key))
        emissions.append((own[0] + text[0], own[1] + text[1]))
    return " ".join(b.text for b, main in zip(blocks, crf.viterbi(emissions), strict=True) if main)


def extract_main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``pages`` (with html) with text and n_chars: the main text of each whole page and its code points.

    The field is trained on labelled pages (at most ``train_pages`` of the given ones, and the labelled
    layouts with their words) and decoded by Viterbi. Null and empty html, and pages without main
    text, give an empty text. Columns named text or n_chars are replaced, all others are kept as they are,
    nulls and repeated rows too; an empty table gives no rows.
    """
    modest_batches(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    full = pages.where("html is not null and html <> ''").select("html", F.xxhash64("html").alias("h"))
    # only hashes of all pages are ordered; equal pages count once
    least = full.select("h").distinct().orderBy("h").limit(train_pages).agg(F.max("h")).first()[0]
    sample = full.where(F.col("h") <= F.lit(least)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").toPandas()
    crf = ChainCRF(labelled_pages(sample["html"].tolist()))
    schema = T.StructType([f for f in pages.schema.fields if f.name != "html"] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches):
        paths: dict = {}
        for b in pieces(batches, "html", size=8 << 20):
            texts = [main_text(h, crf, paths) for h in b["html"]]
            yield b.drop(columns="html").assign(text=texts, n_chars=[len(t) for t in texts])

    return pages.mapInPandas(extract, schema)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
