"""Main text of web pages by template deduction (operator 7).

Method: equivalence classes of tokens.  The pages of a host are taken apart
into tokens: the element paths (``body/div#main/article``, digits in names
made equal) and the texts at a path.  Tokens with the same occurrence vector
over the host's pages form a class.  A vector is never built: the sum over
pages of a hash of (page, count) is equal for equal vectors, so classes come
from one grouped aggregate, however many pages a host has.

A class is kept if its tokens are equally often on each page that has them and
on ``TEXT_SUPPORT`` of the host's pages.  The class of the root (once on every page) is the
template's skeleton; the others nest: a token lies in the nearest path above it
that is a kept token, and a class whose tokens lie in paths of one class is valid and nests in
it, one whose tokens lie in several is none.  So a frame that is on most pages, or a note that
stands twice on each, is template too, and odd pages switch nothing off.  Texts of valid
classes are template text; containers bound the slots.  The slot that holds the host's main
text is chosen from the text masses that were summed with the vectors.  Each page is then
cut down to its main slot, without elements that are boilerplate by their tag (menus, notices,
adverts ...), without lists of nothing but links, and without template texts; headings
inside the main slot stay.  Forms, hidden elements, roles and words in a class or id are weak
evidence: an element stays if it holds the page's main element or
h1, or ``MAIN_MASS`` of its text while no main element beside it has a fair
share; and if nothing else is left of a page, such evidence drops nothing.

Text rules: character references are decoded, white space inside a block
becomes one space, blocks are joined by one newline in page order; nothing
else is dropped or cut.

Defined results: a null or empty page has the empty text; a page without the
host's main slot falls back to its own best container; a host of one page is
its own template (texts count as constant from ``CONSTANT_PAGES`` pages on); a
page whose texts are all template keeps them; a null or odd url is of the
empty host; repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, ready, same
from .urls import host_of

# Element names by their role in a page.
SKIPPED = frozenset("script style noscript template iframe svg math canvas object embed audio video select textarea "
                    "button datalist dialog nav footer aside menu head title map applet input".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
                   "optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul "
                   "noscript template select button textarea iframe title".split())
CONTAINERS = frozenset("html body div section article main td center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
IN_HEAD = frozenset("title meta link base script style noscript template".split())
CLOSED_BY_BLOCK = "p"
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
          "th": {"table", "tr"}, "option": {"select"}}
MAIN_WORDS = frozenset("article content main post story entry maincontent articlebody entrycontent postcontent".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsored "
    "sponsors promo promos promotion nav navbar navigation menu menus breadcrumb breadcrumbs crumbs toc pagination pager "
    "header masthead topbar toolbar footer foot copyright legal sidebar sidebars sidenav aside rail widget widgets notice "
    "notices cookie cookies consent gdpr alert alerts popup modal overlay newsletter subscribe subscription signup signin "
    "login register paywall form search searchbox share sharing social follow related recommended recommendations "
    "trending popular teaser teasers comment comments commentlist commentform reply replies respond responses discussion "
    "discussions disqus feedback reactions skip hidden sponsorship outbrain taboola".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu "
                              "menubar toolbar note".split())
#: Elements of a path; deeper ones share the path of the last.
DEPTH = 64
#: Pages of a host from which on a text that is once on every page counts as template.
CONSTANT_PAGES = 4
#: Share of a host's pages that a class of the template is on.
TEXT_SUPPORT = 0.6
#: Share of a host's pages that have a slot; share of its text mass that a slot holds.
SUPPORT, MAIN_MASS, SEMANTIC_MASS = 0.5, 0.6, 0.3

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[a-zA-Z/!?](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[a-zA-Z/!?][^>]*+>|[^<]++|<",
                    re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_READ = frozenset("class id role hidden aria-hidden".split())
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Suspect:
    """A form, a hidden element, or one that is boilerplate by its role or a word of its class or id, unless
    it holds what is main."""

    __slots__ = ("above", "holds_main", "mass", "main_mass", "dropped")

    def __init__(self, above: Suspect | None):
        self.above, self.holds_main = above, False
        self.mass = self.main_mass = 0
        self.dropped = False

    def chain(self) -> list[Suspect]:
        out, s = [], self
        while s:
            out.append(s)
            s = s.above
        return out


class Element:
    __slots__ = ("name", "path", "block", "dropped", "main", "in_main", "suspect", "top", "inline")

    def __init__(self, name: str, path: str, block: bool, dropped: bool, main: bool, in_main: bool,
                 suspect: Suspect | None = None, top: int = 0, inline: bool = False):
        self.name, self.path, self.block = name, path, block
        self.dropped, self.main, self.in_main = dropped, main, in_main
        self.suspect, self.top = suspect, top  # top: number of the outermost main element around
        self.inline = inline  # dropped by a word of an inline element's class or id


class Block:
    """A text between two block boundaries, its innermost block, and how much of it is link text."""

    __slots__ = ("path", "text", "linked", "list_path", "dropped", "number", "suspect", "top")

    def __init__(self, path: str, text: str, linked: bool, list_path: int, dropped: bool, number: int,
                 suspect: Suspect | None = None, top: int = 0):
        self.path, self.text, self.linked = path, text, linked
        self.list_path, self.dropped, self.number = list_path, dropped, number
        self.suspect, self.top = suspect, top


def _words(value: str) -> set[str]:
    out = set()
    for token in re.split(r"[^A-Za-z]+", value):
        out.add(token.lower())
        out.update(x.lower() for x in _PART.findall(token))
    return out


def _attributes(tag: str) -> dict[str, str]:
    if "=" not in tag and " hidden" not in tag.lower():
        return {}
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag, 1):  # one by one, so that a word in a value is no attribute
        name = m.group(1).lower()
        if name in _READ:
            found.setdefault(name, (m.group(2) or "").strip("\"'"))
    return found


def _boilerplate(name: str, attributes: dict[str, str], in_main: bool) -> bool:
    return name in SKIPPED or (name == "header" and not in_main)


def _suspect(name: str, attributes: dict[str, str]) -> bool:
    """A form, a hidden element, or one whose role, class or id says boilerplate."""
    if name == "form" or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if attributes.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    if name in ("html", "body", "article", "main", "h1", "header"):
        return False
    named = attributes.get("class", "") + " " + attributes.get("id", "")
    return not named.isspace() and bool(_words(named) & BOILERPLATE_WORDS)


def _element_name(name: str, attributes: dict[str, str]) -> str:
    """Tag, classes and id, digits made equal, for the path."""
    label = name
    for k, sign in (("class", "."), ("id", "#")):
        if attributes.get(k):
            label += sign + re.sub(r"\d+", "0", re.sub(r"[\s/]+", ".", attributes[k].strip()))
    return label


class Page:
    """A page taken apart: its blocks, and for each element path how often it occurs."""

    def __init__(self, source: str | None, inline_words: bool = True):
        self._inline_words, self._inline_mass = inline_words, 0
        self.blocks: list[Block] = []
        self.paths: dict[str, list] = {"": [1, False]}  # path -> [count, is a main element]
        self._stack = [Element("", "", True, False, False, False)]
        self._open_names: Counter[str] = Counter()
        self._text: list[tuple[str, bool]] = []
        self._lists, self._list_number = [], 0
        self._suspects: list[Suspect] = []
        self._opened: list[tuple[str, bool, Suspect | None]] = []
        self._tops = 0
        self._parse(source or "")
        self._flush()
        if self._inline_mass and self._inline_mass >= MAIN_MASS * (self._inline_mass + sum(
                len(b.text) for b in self.blocks if not b.dropped)):
            self.__init__(source, False)  # inline elements that hold the main share: again without that evidence
            return
        self._judge()
        for path, main, suspect in self._opened:
            if not self._gone(suspect):
                self.paths.setdefault(path, [0, main])[0] += 1

    def _judge(self) -> None:
        """Which of the suspects are dropped."""
        if not self._suspects:
            return
        total, tops = 0, {}
        for b in self.blocks:
            if b.dropped or b.linked:
                continue
            total += len(b.text)
            if b.top:
                tops[b.top] = tops.get(b.top, 0) + len(b.text)
            for s in b.suspect.chain() if b.suspect else ():
                s.mass += len(b.text)
        fair = {k for k, mass in tops.items() if mass >= SEMANTIC_MASS * total}
        around = sum(len(b.text) for b in self.blocks if not b.dropped and not b.linked and b.top in fair)
        for b in self.blocks:
            if not b.dropped and not b.linked and b.top in fair:
                for s in b.suspect.chain() if b.suspect else ():
                    s.main_mass += len(b.text)
        for s in self._suspects:
            # text of main elements that this one neither holds nor lies in is elsewhere
            beside = around - s.main_mass >= SEMANTIC_MASS * total
            s.dropped = not (s.holds_main or (s.mass and s.mass >= MAIN_MASS * total and not beside))
        if all(b.dropped or any(s.dropped for s in (b.suspect.chain() if b.suspect else ())) for b in self.blocks):
            for s in self._suspects:
                s.dropped = False
        for b in self.blocks:
            b.dropped = b.dropped or self._gone(b.suspect)

    @staticmethod
    def _gone(suspect: Suspect | None) -> bool:
        return suspect is not None and any(s.dropped for s in suspect.chain())

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join("".join(t for t, _ in self._text).split())
        if text:
            plain = any(not link and t.strip() for t, link in self._text)
            top = self._stack[-1]
            self.blocks.append(Block(next(e.path for e in reversed(self._stack) if e.block), text, not plain,
                                     self._lists[-1] if self._lists else 0, top.dropped, len(self.blocks),
                                     top.suspect, top.top))
        self._text = []

    def _pop(self, at: int) -> None:
        for e in self._stack[at:]:
            self._open_names[e.name] -= 1
            if e.name in ("ul", "ol", "menu") and self._lists:
                self._lists.pop()
        del self._stack[at:]

    def _find(self, names: set[str], stop: set[str] = frozenset()) -> int:
        """Place of the innermost open element of one of the names, 0 if none is before ``stop``."""
        if not any(self._open_names[n] for n in names):
            return 0
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].name in names:
                return k
            if self._stack[k].name in stop:
                return 0
        return 0

    def _open(self, name: str, tag: str) -> None:
        block = name in BLOCKS
        if name in VOID:
            if block:
                self._flush()
            else:
                self._text.append((" ", True)) if name == "br" else None
            return
        if block:
            self._flush()
            if name not in IN_HEAD and (k := self._find({"head"})):
                self._pop(k)
            if k := self._find({CLOSED_BY_BLOCK}, {"td", "th", "li", "div", "section", "article", "table"}):
                self._pop(k)
            if name in SIBLINGS and (k := self._find(SIBLINGS[name], BOUNDS[name])):
                self._pop(k)
        top = self._stack[-1]
        attributes = _attributes(tag)
        dropped = top.dropped or _boilerplate(name, attributes, top.in_main)
        main = name in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or (
            name in ("div", "section", "td") and bool(_words(attributes.get("class", "") + " " + attributes.get("id", ""))
                                                      & MAIN_WORDS))
        suspect, inline = top.suspect, top.inline
        if not dropped and (block or self._inline_words) and _suspect(name, attributes):
            if block:
                suspect = Suspect(suspect)
                self._suspects.append(suspect)
            else:
                dropped = inline = True
        if not dropped and suspect and (name in ("main", "h1") or attributes.get("role", "").lower() == "main"):
            for s in suspect.chain():
                s.holds_main = True
        if main and not dropped and not top.top:
            self._tops += 1
        path = top.path
        if block:
            if path.count("/") < DEPTH - 1:
                path = f"{path}/{_element_name(name, attributes)}" if path else _element_name(name, attributes)
            if not dropped:
                self._opened.append((path, main, suspect))
        if name in ("ul", "ol", "menu"):
            self._list_number += 1
            self._lists.append(self._list_number)
        self._open_names[name] += 1
        self._stack.append(Element(name, path, block, dropped, main, top.in_main or main, suspect,
                                   top.top or (self._tops if main and not dropped else 0), inline))

    def _close(self, name: str) -> None:
        block = name in BLOCKS
        k = self._find({name}, set() if block else BLOCKS)
        if block:
            self._flush()
        if k:
            self._pop(k)

    def _parse(self, source: str) -> None:
        at, n, match = 0, len(source), _TOKEN.match
        while at < n:
            m = match(source, at)
            token, at = m.group(), m.end()
            if token[0] != "<" or len(token) == 1:
                if not self._stack[-1].dropped:
                    linked = any(e.name == "a" for e in self._stack[-3:])
                    self._text.append((html.unescape(token) if "&" in token else token, linked))
                elif self._stack[-1].inline:
                    self._inline_mass += len(" ".join(token.split()))
                continue
            tag = _TAG.match(token)
            if not tag:
                continue  # comments, declarations
            name = tag.group(2).lower()
            if tag.group(1):
                self._close(name)
                continue
            self._open(name, token)
            if name in RAW and not token.endswith("/>"):
                end = re.compile(rf"</{name}\b", re.I).search(source, at)
                at = end.start() if end else n

    def kept(self) -> list[Block]:
        """Blocks outside boilerplate elements and outside lists of nothing but links."""
        alive = [b for b in self.blocks if not b.dropped]
        of_list: dict[int, list[Block]] = {}
        for b in alive:
            if b.list_path:
                of_list.setdefault(b.list_path, []).append(b)
        menus = {k for k, bs in of_list.items() if len(bs) > 1 and all(b.linked for b in bs)}
        return [b for b in alive if b.list_path not in menus]


_HEADING = re.compile(r"h[1-6](?![a-z0-9])")


def text_token(b: Block) -> str:
    return f"{b.path}\n{xxhash.xxh3_64_hexdigest(b.text.encode('utf-8', 'surrogatepass'))}"


def inside(path: str, slot: str) -> bool:
    return not slot or path == slot or path.startswith(slot + "/")


def tokens_of(source: str | None) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(token, count, mass of text, is a container, is a main element, holds the title) of a page; none of
    a page without text, which tells nothing of its host's template."""
    page = Page(source)
    blocks = page.kept()
    if not blocks:
        return []
    mass: dict[str, int] = {}
    titles: set[str] = set()
    texts: dict[str, int] = {}
    for b in blocks:
        weight = 0 if b.linked else len(b.text)
        title = b.path.rpartition("/")[2].startswith("h1")
        parts = b.path.split("/") if b.path else []
        for k in range(len(parts) + 1):
            p = "/".join(parts[:k])
            mass[p] = mass.get(p, 0) + weight
            if title:
                titles.add(p)
        t = text_token(b)
        texts[t] = texts.get(t, 0) + 1
    out = [(p, n, mass.get(p, 0), not p or re.match(r"[a-z0-9]*", p.rpartition("/")[2]).group() in CONTAINERS, main,
            p in titles) for p, (n, main) in page.paths.items()]
    return out + [(t, n, 0, False, False, False) for t, n in texts.items()]


def extract(source: str | None, slot: str | None, constant: list[str] | None) -> str:
    """The text of a page, given its host's main slot and template texts."""
    page = Page(source)
    blocks = page.kept()
    if slot is None or (slot and slot not in page.paths):
        slot = own_slot(page, blocks)
    held = [b for b in blocks if inside(b.path, slot)] or blocks
    if constant:
        known = set(constant)
        # a heading inside the main slot belongs to its text, also if other pages have it too
        held = [b for b in held if (slot and _HEADING.match(b.path.rpartition("/")[2])) or text_token(b) not in known] or held
    return "\n".join(b.text for b in held)


def own_slot(page: Page, blocks: list[Block]) -> str:
    """The main element with most text on the page, else the whole page."""
    best, most = "", 0
    for p, (_, main) in page.paths.items():
        if main:
            mass = sum(len(b.text) for b in blocks if not b.linked and inside(b.path, p))
            if mass > most or (mass == most and best and len(p) < len(best)):
                best, most = p, mass
    return best


# ---- Spark ----

def equivalence_classes(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """host, token, signature of its occurrence vector, pages it is on, its count, mass, container, main, title."""
    ready(pages.sparkSession)

    @F.pandas_udf("array<struct<token:string,n:int,mass:bigint,container:boolean,main:boolean,title:boolean>>")
    def taken_apart(sources: pd.Series) -> pd.Series:
        keys = ("token", "n", "mass", "container", "main", "title")
        return sources.map(lambda s: [dict(zip(keys, t, strict=True)) for t in tokens_of(s)], na_action=None)

    rows = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(*pages.columns).alias("page"),
                        F.explode(taken_apart(F.col(source).cast("string"))).alias("t")).select("host", "page", "t.*")
    h = F.xxhash64("page", "n")

    def part(shift: int) -> Column:  # 31 bits, so that sums of thousands of millions of pages fit
        return F.sum(F.shiftrightunsigned(h, shift).bitwiseAND((1 << 31) - 1))

    return rows.groupBy("host", "token").agg(
        part(0).alias("low"), part(31).alias("high"), F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"),
        (F.min("n") == F.max("n")).alias("steady"),
        F.sum("mass").alias("mass"), F.max("container").alias("container"), F.max("main").alias("main"),
        F.max("title").alias("title"))


def nested(classes: DataFrame) -> DataFrame:
    """host, low, high, tokens and the parent class of each valid class.

    Tokens that are equally often on each of the pages that have them, and on ``TEXT_SUPPORT`` of the host's
    pages at least, are grouped by their vector.  A token lies in the nearest path above it that is such a
    token too; a class nests in the class of that path, and is valid if there is no other one.
    """
    pages = classes.filter("token = ''").select(F.col("host").alias("h"), F.col("pages").alias("all_pages"))
    kept = (classes.join(pages, same(F.col("host"), F.col("h"))).drop("h")
            .filter(F.col("steady") & (F.col("pages") >= TEXT_SUPPORT * F.col("all_pages"))
                    & ((F.col("token") == "") | (F.col("all_pages") >= CONSTANT_PAGES)))
            .select("host", "token", "low", "high"))
    path = F.element_at(F.split("token", "\n"), 1)
    parts = F.split(path, "/")
    is_text = F.contains("token", F.lit("\n"))
    # paths above a token, the root first; a text lies in its own path
    above = F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    above = F.when(path == "", F.array(F.lit(""))).otherwise(above)
    above = F.when(is_text, above).otherwise(F.slice(above, F.lit(1), F.size(above) - 1))
    each = kept.filter("token <> ''").select("host", "token", "low", "high", F.posexplode(above).alias("depth", "up"))
    ups = kept.select(F.col("host").alias("h"), F.col("token").alias("up_token"), F.col("low").alias("up_low"), F.col("high").alias("up_high"))
    found = each.join(ups, same(F.col("host"), F.col("h")) & (F.col("up") == F.col("up_token")))
    # the nearest path that is not of the token's own class: where the class as a whole lies
    outer = found.filter((F.col("low") != F.col("up_low")) | (F.col("high") != F.col("up_high")))
    near = outer.groupBy("host", "low", "high", "token").agg(
        F.max_by(F.struct(F.col("up_low").alias("low"), F.col("up_high").alias("high")), "depth").alias("parent"))
    parents = near.groupBy("host", "low", "high").agg(F.min("parent").alias("parent"), F.max("parent").alias("other"))
    sizes = kept.groupBy("host", "low", "high").agg(F.collect_list("token").alias("tokens"))
    on = same(F.col("host"), F.col("h")) & (F.col("low") == F.col("l")) & (F.col("high") == F.col("g"))
    parents = parents.select(F.col("host").alias("h"), F.col("low").alias("l"), F.col("high").alias("g"), "parent", "other")
    both = sizes.join(parents, on, "left")
    return both.filter(F.col("parent").isNull() | (F.col("parent") == F.col("other"))).select("host", "low", "high", "tokens", "parent")


def templates(classes: DataFrame) -> DataFrame:
    """host, slot (path of the main slot), constant (the template's texts) of each host."""
    root = classes.filter("token = ''").select(F.col("host").alias("h"), F.col("pages").alias("all_pages"),
                                               F.col("low").alias("root_low"), F.col("high").alias("root_high"),
                                               F.col("mass").alias("all_mass"), F.col("title").alias("has_title"))
    t = classes.join(root, same(F.col("host"), F.col("h")))
    skeleton = (F.col("low") == F.col("root_low")) & (F.col("high") == F.col("root_high"))
    once = F.col("container") & (F.col("n") == F.col("pages")) & (F.col("pages") >= SUPPORT * F.col("all_pages"))
    share = F.when(F.col("all_mass") > 0, F.col("mass") / F.col("all_mass")).otherwise(0.0)
    depth = F.size(F.split("token", "/"))
    semantic = once & F.col("main") & (share >= SEMANTIC_MASS)
    # first main elements (the outermost, of skeleton before others), then the innermost container with
    # the mass and the title, then the root
    rank = (F.when(semantic, F.struct(F.lit(3).alias("kind"), skeleton.cast("int").alias("sure"), (-depth).alias("depth"),
                                      share.alias("share"), F.col("token")))
            .when(once & (share >= MAIN_MASS) & (F.col("title") | ~F.col("has_title")),
                  F.struct(F.lit(2).alias("kind"), skeleton.cast("int").alias("sure"), depth.alias("depth"),
                           share.alias("share"), F.col("token")))
            .when(F.col("token") == "", F.struct(F.lit(1).alias("kind"), F.lit(1).alias("sure"), F.lit(0).alias("depth"),
                                                 share.alias("share"), F.col("token"))))
    slots = t.groupBy("host").agg(F.max(rank).alias("best")).select("host", F.coalesce("best.token", F.lit("")).alias("slot"))
    texts = F.filter("tokens", lambda x: F.contains(x, F.lit("\n")))
    constant = nested(classes).select(F.col("host").alias("h"), F.explode(texts).alias("text")).groupBy("h").agg(
        F.collect_list("text").alias("constant"))
    return slots.join(constant, same(F.col("host"), F.col("h")), "left").select("host", "slot", "constant")


def main_text(pages: DataFrame, url: str = "url", source: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the main text of every page in ``to``."""
    # written: the template reads the classes twice, and pages are only shuffled to their host's
    # template if all templates together are over the session's broadcast threshold
    classes = keep(equivalence_classes(pages.select(url, source), url, source), "html-classes")
    found = keep(templates(classes), "html-templates").withColumnsRenamed(
        {"host": "_host", "slot": "_slot", "constant": "_constant"})

    @F.pandas_udf("string")
    def cut(sources: pd.Series, slots: pd.Series, constants: pd.Series) -> pd.Series:
        return pd.Series([extract(s, p, None if c is None else list(c))
                          for s, p, c in zip(sources, slots, constants, strict=True)], dtype=object)

    joined = pages.join(found, same(host_of(pages[url]), F.col("_host")), "left")
    return joined.withColumn(to, cut(F.col(source).cast("string"), "_slot", "_constant")).drop("_host", "_slot", "_constant")
