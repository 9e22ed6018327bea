"""Main text of web pages by wrappers that are inferred for each host.

A wrapper is a union-free regular expression over tokens: tags, text slots, repeated groups and optional groups. A page's
token stream is read as its elements; runs of like neighbours become repeated groups. Wrappers of one host are then
aligned, one after the other: tokens that match are merged, texts at one place become a slot, and what only one of both has
becomes an optional group; what the alignment brings side by side may fold into a repeated group again. Each task merges
the pages that it reads, host by host, and the parts are merged along a tree, so a host of any size is never in one place.

A slot counts the texts that fill it. What differs from page to page is content; a text that comes again on many pages with
different bodies is the site's own, wherever it stands: in the article or beside it, with a telling class name or without.
The wrapper also tells where a host's pages hold their article. Both are applied to each page; elements that by their tag or
name never are main text (menus, forms, comments) are left out before.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import materialize, shuffle_partitions

TOKEN = re.compile(r"""<!--.*?(?:--!?>|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?][^>]*(?:>|$)|<[/a-zA-Z][^>]*(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Fixed values of HTML: elements without content, with raw content, and those that stay within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe svg template xmp noembed noframes math canvas object audio video select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
BLOCK_IN_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("table ul ol dl div article section main aside nav body html td th".split())
# What never is main text: elements, and words of class, id and role.
ASIDE_TAGS = frozenset("nav header footer aside form button menu head dialog fieldset".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer header masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices notification popup promo promoted promotion recommended related replies respond rail search share sharing sidebar signup skyscraper social sponsor sponsored sponsors subscribe toolbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
# Words that say nothing beside those: a name is an aside's if all of its words are one or the other.
PLAIN_WORDS = frozenset("area article articles bar block blog body bottom box buttons column container content entry field form global group holder icons inner item items js latest layout left link links list main media more outer page panel popular post posts primary reader readers right row secondary section site slot stories sub text title top unit user users wrap wrapper".split())
# A class like has-sidebar speaks of the layout around it; an element named for one that holds the article isn't one.
MODIFIERS = frozenset("has with without no is layout page body site".split())
LAYOUT_WORDS = frozenset("footer header masthead menu navigation rail sidebar widget widgets".split())
#: Bounds of a wrapper: levels (what is deeper counts as its ancestor's), places in an element, texts counted in a slot, pages
#: remembered of a text. They bound what is known of a site, not what is read of a page.
LEVELS, PLACES, TEXTS, PAGES = 60, 200, 24, 5
#: A site's own text: its length at most, and on which share of the host's pages it stands; of a page's text it is a part only.
LONGEST, SHARE, PART = 200, 0.5, 0.5


def label_of(tag: str, attributes: str) -> tuple[str, bool]:
    """A token's name in wrappers, and whether it is one of those that never hold main text."""
    parts, aside, comment = set(), tag in ASIDE_TAGS, False
    for _, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        for name in "".join(values).split():
            found = [w for w in re.split(r"[^a-z0-9]+|\d+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
            parts.update(found)
            telling = ASIDE_WORDS.intersection(found)
            if telling and ASIDE_WORDS.union(PLAIN_WORDS).issuperset(found) and (found[0] not in MODIFIERS or len(found) > 1 and found[0] in PLAIN_WORDS):
                aside, comment = True, comment or bool(COMMENT_WORDS.intersection(found))
    whole = tag in ("html", "body", "article", "main")
    return (f"{tag}.{'.'.join(sorted(parts))}" if parts else tag), (comment and tag not in ("html", "body")) or (aside and not whole)


class Element:
    __slots__ = ("tag", "label", "aside", "children")

    def __init__(self, tag: str, label: str, aside: bool):
        self.tag, self.label, self.aside, self.children = tag, label, aside, []


def parse(page: str) -> Element:
    """The page's elements and texts (character references decoded); forgiving, and linear in its tokens."""
    root = Element("", "", False)
    stack, at, held = [root], 0, Counter()  # held: how many elements of each tag are open

    def cut(i: int) -> None:
        for x in stack[i:]:
            held[x.tag] -= 1
        del stack[i:]

    while at < len(page):
        m = TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            stack[-1].children.append(entities.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if held[tag] else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in RAW and not m[3].endswith("/"):
            closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else len(page)
            continue
        if tag in BLOCK_IN_P and held["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    cut(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        for i in range(len(stack) - 1, 0, -1) if any(held[t] for t in CLOSES.get(tag, ())) else ():
            if stack[i].tag in CLOSES[tag]:
                cut(i)
                break
            if stack[i].tag in SCOPES and stack[i].tag not in CLOSES[tag]:
                break
        new = Element(tag, *label_of(tag, m[3]))
        if tag == "header" and (held["article"] or held["main"]) and new.label == "header":
            new.aside = False  # the headline of an article
        if tag in ("article", "main") and not new.aside:
            for x in stack:
                x.aside = x.aside and not (x.tag not in ASIDE_TAGS and set(x.label.split(".")[1:]) & ASIDE_WORDS <= LAYOUT_WORDS)
        stack[-1].children.append(new)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(new)
            held[tag] += 1
    return root


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=6).digest())


def blocks(element: Element, deeper: bool = True) -> Iterator[tuple[Element, str | Element]]:
    """The element that holds it, and a block of text; with white space as it should be, without what never is main text.

    Not ``deeper``: elements that aren't inline come out as such, at their place.
    """
    line: list[str] = []
    todo: list = [*reversed(element.children)]
    holders = [element]

    def text() -> str:
        out = " ".join("".join(line).split())
        line.clear()
        return out

    while todo:
        x = todo.pop()
        if isinstance(x, str):
            line.append(x)
            continue
        if x is not None and x.tag in INLINE and not x.aside:
            todo += reversed(x.children)
            continue
        if x is not None and x.tag in INLINE:
            continue
        if out := text():
            yield holders[-1], out
        if x is None:
            holders.pop()
        elif x.tag in VOID or x.aside and deeper:
            continue
        elif deeper:
            holders.append(x)
            todo.append(None)
            todo += reversed(x.children)
        else:
            yield element, x
    if out := text():
        yield holders[-1], out


# A wrapper node: l label, c children, m repeated, o optional, a never main, n pages; of a slot: z characters, f its texts.


def wrapper_of(element: Element, page: int, level: int = 0) -> dict:
    """The wrapper of one page, whose body has the hash ``page``."""
    children = []
    for holder, x in blocks(element, level >= LEVELS):
        if isinstance(x, str):
            own = {str(_hash(f"{holder.label} {x}")): [1, [page]]} if 3 <= len(x) <= LONGEST and any(map(str.isalpha, x)) else {}
            children.append({"l": "#", "n": 1, "z": len(x), "f": own})
        elif x.aside:
            children.append({"l": x.label, "a": True, "c": [], "n": 1})
        else:
            children.append(wrapper_of(x, page, level + 1))
    return {"l": element.label, "a": element.aside, "c": fold(children), "n": 1}


def page_wrapper(page: str) -> dict:
    root = parse(page)
    return wrapper_of(root, _hash(max((x for _, x in blocks(root)), key=len, default="")))


def fold(nodes: list[dict]) -> list[dict]:
    """Neighbours of one label, and neighbouring pairs and triples of labels, become repeated groups."""
    for width in (1, 2, 3):
        out: list[dict] = []
        for x in nodes:
            out.append(x)
            while len(out) >= 2 * width and [y["l"] for y in out[-width:]] == [y["l"] for y in out[-2 * width : -width]]:
                tail = out[-width:]
                del out[-width:]
                out[-width:] = [merge(a, b) | {"m": True, "n": max(a["n"], b["n"])} for a, b in zip(out[-width:], tail)]
        nodes = out
    return nodes


def merge(a: dict, b: dict) -> dict:
    new = {"l": a["l"], "n": a["n"] + b["n"], "m": bool(a.get("m") or b.get("m")), "o": bool(a.get("o") or b.get("o"))}
    if a["l"] == "#":
        return new | {"z": a["z"] + b["z"], "f": frequent(a["f"], b["f"])}
    return new | {"a": a["a"] or b["a"], "c": align(a["c"], b["c"])}


def frequent(a: dict, b: dict) -> dict:
    """How often the texts of both slots occur, and on pages with which bodies (the least few hashes).

    Of more than TEXTS texts the counts are lowered alike until these are left: one that fills a share of over 1 / TEXTS of
    the slot is always among them.
    """
    out = {k: list(v) for k, v in a.items()}
    for k, (n, pages) in b.items():
        m, held = out.get(k, (0, []))
        out[k] = [m + n, sorted({*held, *pages})[:PAGES]]
    if len(out) > TEXTS:
        least = sorted((v[0] for v in out.values()), reverse=True)[TEXTS]
        out = {k: [n - least, pages] for k, (n, pages) in out.items() if n > least}
    return out


def align(xs: list[dict], ys: list[dict]) -> list[dict]:
    """Merges what matches in order; what only one side has becomes optional. Of more than PLACES the most usual stay."""
    if [x["l"] for x in xs] == [y["l"] for y in ys]:
        return [merge(x, y) for x, y in zip(xs, ys)]
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, [x["l"] for x in xs], [y["l"] for y in ys], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [merge(x, y) for x, y in zip(xs[i:j], ys[k:m])]
        else:
            out += [z | {"o": True} for z in xs[i:j] + ys[k:m]]
    out = fold(out)
    if len(out) > PLACES:
        keep = sorted(sorted(range(len(out)), key=lambda i: -out[i]["n"])[:PLACES])
        out = [out[i] for i in keep]
    return out


def rule_of(wrapper: dict) -> dict:
    """Where the article is (labels from the root), and the site's own texts: those that stand on a share of the host's pages
    and on PAGES pages of different bodies."""
    def weight(node: dict) -> int:
        if node.get("a"):
            return 0
        return node["z"] if node["l"] == "#" else sum(weight(c) for c in node["c"])

    best: dict[str, tuple[int, list[str]]] = {}
    own: list[int] = []
    todo: list[tuple[dict, list[str]]] = [(wrapper, [])]
    while todo:
        node, path = todo.pop()
        if node.get("a"):
            continue
        if node["l"] == "#":
            own += [int(k) for k, (n, pages) in node["f"].items() if n >= SHARE * wrapper["n"] and len(pages) >= PAGES]
            continue
        path = [*path, node["l"]]
        tag = node["l"].split(".")[0]
        if tag in ("article", "main") and weight(node) > best.get(tag, (0,))[0]:
            best[tag] = (weight(node), path)
        todo += [(c, path) for c in node["c"]]
    named = [k for k in ("article", "main") if k in best]
    return {"path": best[named[0]][1] if named else [wrapper["l"]], "own": sorted(set(own))}


def extract(page: str, rule: dict) -> str:
    """Main text of one page: blocks in page order, joined by one space."""
    root = parse(page)
    wanted, own = rule["path"], set(rule["own"])
    found: list[Element] = []
    todo = [(root, 1)] if wanted and wanted[0] == root.label else []
    while todo:
        x, depth = todo.pop()
        if depth == len(wanted):
            found.append(x)
            continue
        todo += [(c, depth + 1) for c in reversed(x.children) if not isinstance(c, str) and c.label == wanted[depth] and not c.aside]
    if not found or found == [root]:
        found = _named(root)
    lines = [(holder, x) for element in found for holder, x in blocks(element)]
    if own:
        fresh = [x for holder, x in lines if len(x) > LONGEST or _hash(f"{holder.label} {x}") not in own]
        # Copies of one article on a site have texts in common as well: what is the site's own is a small part of a page.
        if sum(map(len, fresh)) >= (1 - PART) * sum(len(x) for _, x in lines):
            return " ".join(fresh)
    return " ".join(x for _, x in lines)


def _named(root: Element) -> list[Element]:
    """On a page that its host's wrapper doesn't fit: its articles, else its main, else all of it."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.tag == tag and not x.aside:
                found.append(x)
            elif not x.aside:
                todo += [c for c in reversed(x.children) if not isinstance(c, str)]
        if found:
            return found
    return [root]


def _merge_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, dict] = {}

    def rows() -> pd.DataFrame:
        made = pd.DataFrame({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]})
        held.clear()
        return made

    for b in batches:
        for host, page in zip(b["host"], b["html"]):
            w = page_wrapper(page)
            held[host] = merge(held[host], w) if host in held else w
        if len(held) > 2000:
            yield rows()
    if held:
        yield rows()


def _merge_wrappers(part: pd.DataFrame) -> pd.DataFrame:
    parts = [json.loads(w) for w in sorted(part["wrapper"])]
    whole = parts[0]
    for w in parts[1:]:
        whole = merge(whole, w)
    return pd.DataFrame({"host": [part["host"].iloc[0]], "wrapper": [json.dumps(whole)]})


def infer_wrappers(pages: DataFrame, fan: int = 16) -> DataFrame:
    """host, wrapper (as JSON), from ``pages`` (host, html). Some ``fan`` wrappers of a host are merged in one place at a time."""
    kind = "host string, wrapper string"
    parts = materialize(pages.select("host", "html").mapInPandas(_merge_pages, kind), 500)
    most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    while most > 1:
        most = math.ceil(most / fan)
        part = F.pmod(F.xxhash64("wrapper"), F.lit(most)).alias("part")
        parts = materialize(parts.select("*", part).groupBy("host", "part").applyInPandas(_merge_wrappers, kind))
    return parts


def extract_main_text(pages: DataFrame, broadcast_bytes: int = 4 << 20) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html; other columns are ignored).

    Null html is empty; an empty or text-free page gives the empty string; a null url has a host of its own. Repeated rows
    come out as often; null page ids stay null. A wrapper's rule is small; rules of ``broadcast_bytes`` in all are broadcast,
    beyond it they are joined by host and a salt that parts large hosts.
    """
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    as_rule = F.pandas_udf(lambda w: pd.Series([json.dumps(rule_of(json.loads(x))) for x in w], dtype=object), "string")
    rules = materialize(infer_wrappers(rows).select("host", as_rule("wrapper").alias("rule")))
    size = rules.agg(F.sum(F.length("rule") + F.length("host") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        met = rows.join(F.broadcast(rules), "host", "left")
    else:
        salts = max(8, shuffle_partitions(spark))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(salts)).cast("int")).join(rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["host", "salt"], "left")

    def run(html: pd.Series, rule: pd.Series) -> pd.Series:
        known: dict[str, dict] = {}
        return pd.Series([extract(h, known[r] if r in known else known.setdefault(r, json.loads(r))) for h, r in zip(html, rule)], dtype=object)

    text = F.pandas_udf(run, "string")("html", "rule")
    return materialize(met.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long")), 500)
