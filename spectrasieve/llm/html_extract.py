"""HTML extraction by equivalence-class template deduction."""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrasieve.llm import common
from spectrasieve.llm.url_filter import host_of

# HTML elements whose content is never text, those that start a block, those
# that have no end tag, and those whose role rules them out.
_HIDDEN = "script style noscript template svg math head title iframe object canvas select textarea button audio video"
_BLOCKS = "html body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset figure figcaption blockquote pre address details summary dialog hgroup hr center menu label legend"
_VOID = "area base br col embed hr img input link meta param source track wbr"
_OUTER = "nav header footer aside form menu dialog fieldset label legend"
# Words in class, id or role that name parts which are not the article.
_PARTS = (
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs captcha comment comments "
    "consent cookie cookies copyright disqus donate footer gdpr header login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices notification overlay pagination paywall popup popups promo promos promotion "
    "reader reactions recommended related replies reply respond sharing share sidebar signup skip social sponsor sponsored sponsors "
    "subscribe subscription tags toolbar topbar warning alert disclaimer widget widgets complementary contentinfo search"
)
_MAIN = "article main content post entry story body text articlebody maincontent"

# Nothing is scanned twice: a quoted value ends before "<" at the latest, and what never ends runs to the page's end.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?>[^<>\"']|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SETS = {k: frozenset(v.split()) for k, v in (("hidden", _HIDDEN), ("block", _BLOCKS), ("void", _VOID), ("outer", _OUTER), ("parts", _PARTS), ("main", _MAIN))}
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in _SETS["hidden"]}
_WRAPS = frozenset("wrap wrapper container layout has with no".split())
_REPEATED = ("li", "dt", "dd", "tr", "td", "th", "p")
_DEPTH = 64  # elements nested deeper have the path of the one around them


class Page:
    """One page's elements and blocks.

    ``opened`` counts elements by path, a path naming the open block elements from the outside in as
    ``tag`` or ``tag.name.name``. ``blocks`` lists (path, link characters, text) in page order; inline elements
    are part of their block's text. Elements whose content is no text, hidden ones, comments and markup are left out;
    character references are decoded and white space becomes one space.
    """

    def __init__(self, page: str):
        self.opened: Counter[str] = Counter()
        self.blocks: list[tuple[str, int, str]] = []
        self.stack: list[tuple[str, str, bool]] = []  # tag, path, hidden
        self.inside: Counter[str] = Counter()  # open elements by tag
        self.endless: set[str] = set()  # tags that no end follows any more
        self.text: list[str] = []
        self.links = self.in_link = 0
        at, end = 0, len(page)
        while at < end:
            m = _TOKEN.search(page, at)
            self._say(page[at : m.start() if m else end])
            if m is None:
                break
            at = m.end()
            if m[2]:
                at = self._tag(page, at, m[2].lower(), bool(m[1]), m[3])
        self._flush()

    def _say(self, raw: str) -> None:
        if raw:
            said = html.unescape(raw)
            self.text.append(said)
            if self.in_link:
                self.links += len(said)

    def _flush(self) -> None:
        said = " ".join("".join(self.text).split()) if self.text else ""
        if said and not (self.stack and self.stack[-1][2]):
            self.blocks.append((self.stack[-1][1] if self.stack else "", self.links, said))
        self.text.clear()
        self.links = 0

    def _tag(self, page: str, at: int, tag: str, closes: bool, attributes: str) -> int:
        """Take one tag that ends at ``at``; where to go on."""
        if tag in _SETS["hidden"]:
            if closes or attributes.endswith("/") and tag not in ("script", "style"):
                return at
            close = None if tag in self.endless else _ENDS[tag].search(page, at)
            if close is None:  # an end tag that is missing hides no more than it must
                self.endless.add(tag)
                return len(page) if tag in ("script", "style") else at
            return close.end()
        if tag == "a":
            self.in_link = not closes
        elif tag == "br":
            self.text.append(" ")
        elif tag in _SETS["block"]:
            if not closes:
                self._open(tag, attributes)
            elif self.inside[tag]:
                self._flush()
                while self._close() != tag:
                    pass
        return at

    def _close(self) -> str:
        tag = self.stack.pop()[0]
        self.inside[tag] -= 1
        return tag

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        self.in_link = False
        while self.stack and (self.stack[-1][0] in ("p", tag) if tag in _REPEATED else self.stack[-1][0] == "p"):
            self._close()
        if tag in _SETS["void"]:
            return
        names: dict[str, None] = {}
        gone = bool(self.stack and self.stack[-1][2])
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role", "itemprop"):
                names |= dict.fromkeys(w.lower() for w in _WORD.findall(value))
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                gone = True
        if len(self.stack) < _DEPTH:
            path = f"{self.stack[-1][1]}/{'.'.join([tag, *names])}" if self.stack else ".".join([tag, *names])
        else:
            path = self.stack[-1][1]
        self.stack.append((tag, path, gone))
        self.inside[tag] += 1
        self.opened[path] += 1


@lru_cache(100_000)
def role(path: str) -> int:
    """3 for an article, 2 for a main element, 1 for a part named like one, 0 for others, -1 outside the article.

    A path lies outside if any element of it has an outer tag or a name of such a part. A header inside an
    article is the article's own, and names of the page's outermost elements, or of a wrapper around article and parts
    (as in ``content-sidebar-wrap``), tell nothing.
    """
    best = 0
    for element in path.split("/"):
        tag, *names = element.split(".")
        own = 3 if tag == "article" else 2 if tag == "main" else 1 if _SETS["main"].intersection(names) and tag in ("div", "section", "td") else 0
        around = tag in ("html", "body", "main") or _SETS["main"].intersection(names) and _WRAPS.intersection(names)
        if _SETS["parts"].intersection(names) and not around and not (best and names[-1:] == ["header"]) or tag in _SETS["outer"] and not (tag == "header" and best == 3):
            return -1
        best = max(best, own)
    return best


@lru_cache(100_000)
def prefixes(path: str) -> tuple[str, ...]:
    parts = path.split("/") if path else []
    return tuple("/".join(parts[:i]) for i in range(len(parts) + 1))


def token_rows(page: Page) -> dict[str, list[int]]:
    """By path: times opened, characters of article text below it, characters of links below it. The page itself is the path ""."""
    rows = {"": [1, 0, 0]} | {p: [n, 0, 0] for p, n in page.opened.items()}
    for path, links, text in page.blocks:
        if role(path) >= 0:
            for p in prefixes(path):
                rows[p][1] += len(text)
                rows[p][2] += min(links, len(text))
    return rows


def choose(found: list[tuple[str, int, int]]) -> str:
    """The path of the slot that holds the article, of (path, characters, link characters).

    The best role wins, then the most text that is not links, then the outermost. Without any path of
    a role it is the innermost path with at least 0.6 of all text; "" if there is no text.
    """
    found = [f for f in found if role(f[0]) >= 0 and f[1]]
    named = [f for f in found if role(f[0]) > 0]
    if named:
        return min(named, key=lambda f: (-role(f[0]), f[2] - f[1], f[0].count("/"), f[0]))[0]
    most = max((f[1] - f[2] for f in found), default=0)
    rest = [f for f in found if f[1] - f[2] >= 0.6 * most]
    return min(rest, key=lambda f: (-f[0].count("/"), f[2] - f[1], f[0]))[0] if rest else ""


def text_token(path: str, text: str) -> int:
    """The token of a block's words at their place, as a 64-bit number."""
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") - (1 << 63)


class Template:
    """What a host's pages share: ``slots`` are the paths where its template holds text (path, characters, characters of
    links), ``words`` the text tokens of the template with their rank in its order."""

    def __init__(self, slots: list[tuple[str, int, int]] = (), words: dict[int, int] | None = None):
        self.slots, self.words = slots, words or {}


def main_text(page: Page, template: Template) -> str:
    """Blocks of the article's slot without the template's own words, joined by a newline.

    A page that has none of the template's slots is its own template. Words of the template count where they
    stand in the template's order; if they make up more than half of the slot's text, the page repeats
    others' article rather than a template, and all stays.
    """
    own = token_rows(page)
    there = [s for s in template.slots if own.get(s[0], (0, 0, 0))[1]]
    at = choose(there) if there and role(choose(there)) > 0 or there and not any(role(p) > 0 for p in own) else choose([(p, c, n) for p, (_, c, n) in own.items()])
    inside = [(p, t) for p, _, t in page.blocks if role(p) >= 0 and (not at or p == at or p.startswith(at + "/"))]
    if template.words:
        ranks = [template.words.get(text_token(p, t), -1) for p, t in inside]
        reached, kept = -1, []
        for (_, t), r in zip(inside, ranks, strict=True):
            if r > reached:
                reached = r
            else:
                kept.append(t)
        if 2 * sum(map(len, kept)) >= sum(len(t) for _, t in inside):
            return "\n".join(kept)
    return "\n".join(t for _, t in inside)


def templates(pages: DataFrame, least_pages: int = 4) -> DataFrame:
    """(host, slots, words) of (host, html), deduced by equivalence classes from all pages of a host.

    Tokens are element paths, and the words of a block at their path, taken together. A token's occurrence vector over the host's
    pages is kept as a fingerprint, two sums over its pages of 31-bit hashes of the page's content and the count there, beside the numbers of pages
    and of occurrences and whether the contents differ; these aggregate in any order and before the shuffle, and repeated pages change
    nothing in which vectors are equal. Tokens of a host with equal vectors form a class.

    Slots come from classes on two pages (or on the host's only one): the paths of their elements; a token
    of no such class, as an element that one page alone has, is part of the slot around it. Paths name the elements around
    them, so classes nest in those of their paths' beginnings. Words belong to the template if their class has
    two tokens or more and stands on at least half of the host's pages, on ``least_pages`` of unlike content, once on each; their rank is
    that of their mean place, and :func:`main_text` tests their order on each page.
    """

    def task(batches):
        import pyarrow as pa

        seen: dict[tuple[str, int], list] = {}

        def rows():
            cols = list(zip(*[(*k, *v) for k, v in seen.items()], strict=True)) or [[]] * 12
            seen.clear()
            types = (pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 9)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["host", "token", "path", "n_pages", "total", "one", "two", "least", "most", "place", "chars", "links"])

        def add(host, token, path, page, n, place, chars, links):
            row = seen.get((host, token))
            if row is None:
                row = seen[host, token] = [path, 0, 0, 0, 0, 1 << 62, 0, 0, 0, 0]
            h = (page ^ n * 0x9E3779B97F4A7C15) * 0xD1342543DE82EF95 & (1 << 64) - 1
            row[1] += 1
            row[2] += n
            row[3] += h >> 33
            row[4] += h >> 2 & (1 << 31) - 1
            row[5], row[6] = min(row[5], page >> 2), max(row[6], page >> 2)
            row[7] += place
            row[8] += chars
            row[9] += links

        for b in batches:
            for host, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                page, content = Page(text or ""), xxhash.xxh3_64_intdigest(text or "")
                for path, (n, chars, links) in token_rows(page).items():
                    add(host, text_token(path, ""), path, content, n, 0, chars, links)
                words: dict[int, list[int]] = {}
                for k, (path, _, said) in enumerate(page.blocks):
                    if role(path) >= 0:
                        words.setdefault(text_token(path, said), [k, 0])[1] += 1
                for token, (k, n) in words.items():
                    add(host, token, None, content, n, k, 0, 0)
                if len(seen) > 100_000:
                    yield rows()
        yield rows()

    made = common.by_batch(pages.select("host", "html"), task, "host string, token long, path string, n_pages long, total long, one long, two long, least long, most long, place long, chars long, links long")
    tokens = made.groupBy("host", "token").agg(F.max("path").alias("path"), *[F.sum(c).alias(c) for c in ("n_pages", "total", "one", "two", "place", "chars", "links")], F.min("least").alias("least"), F.max("most").alias("most"))
    tokens = common.cut(tokens.where("n_pages >= 2 or path is not null"))  # a block's words on one page are no class
    size = pages.groupBy("host").agg(F.count("*").alias("of"))
    vector = ["host", "n_pages", "total", "one", "two"]
    large = tokens.where(f"n_pages >= {least_pages} and total = n_pages and least <> most").groupBy(*vector).agg(F.count("*").alias("size")).where("size >= 2").join(size, "host").where("2 * n_pages >= of").select(*vector)
    words = tokens.where("path is null").join(large, vector).select("host", F.struct((F.col("place") / F.col("n_pages")).alias("place"), "token").alias("w"))
    words = words.groupBy("host").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w.token).alias("words"))
    slots = tokens.join(size, "host").where("path is not null and chars > 0 and (n_pages >= 2 or of = 1)").groupBy("host").agg(F.collect_list(F.struct("path", "chars", "links")).alias("slots"))
    return slots.join(words, "host", "full").select(F.coalesce(slots.host, words.host).alias("host"), "slots", "words")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The article's text of every page: page_id, url, text, n_chars (code points).

    Templates are deduced per host from all its pages, then each page gives the blocks of the slot that holds
    the article, less the template's words. Templates measuring at most ``broadcast_bytes`` are broadcast; beyond that pages are dealt by host, up
    to 1,000 or so to a task, and pass their template, which moves once a task. A null or empty html gives an empty text; null ids
    and URLs stay null (the pages without a host share one template); repeated rows give repeated results; a broken tag ends before
    the next "<", elements nested beyond 64 keep their text; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    with common.scratch(spark):
        known = common.keep(common.cut(templates(p)))
    size = known.agg(F.sum(F.length(F.to_json("slots")) + 20 * F.greatest(F.size("words"), F.lit(0)) + F.length("host") + 40)).first()[0] or 0

    def template(slots, words):
        return Template([(s["path"], s["chars"], s["links"]) for s in slots or ()], {w: i for i, w in enumerate(words or ())})

    def rows(ids, urls, texts):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    result = "page_id long, url string, text string, n_chars long"
    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast({r.host: (r.slots, r.words) for r in known.toLocalIterator()})

        def alone(batches):
            held: dict = {}
            for b in batches:
                for at in range(0, len(b), 256):
                    ids, urls, texts, hosts = (b.column(c).slice(at, 256).to_pylist() for c in ("page_id", "url", "html", "host"))
                    for h in hosts:
                        if h not in held:
                            held[h] = template(*sent.value.get(h, (None, None)))
                    yield rows(ids, urls, [main_text(Page(t or ""), held[h]) for t, h in zip(texts, hosts, strict=True)])

        return common.by_batch(p, alone, result)

    many = p.groupBy("host").agg(F.count("*").alias("c"))
    dealt = p.join(common.sized(many), "host").withColumn("deal", F.pmod(F.xxhash64("page_id", "url"), F.ceil(F.col("c") / 1000)))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("page_id", "long"), ("url", "string"), ("html", "string"))]
    left = many.select("host", F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / 1000) - 1)).alias("deal")).join(known, "host").select("host", "deal", F.lit(0).alias("kind"), *none, "slots", "words")
    right = dealt.select("host", "deal", F.lit(1).alias("kind"), "page_id", "url", "html", *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("slots", "words")])
    both = left.unionByName(right).repartition("host", "deal").sortWithinPartitions("host", "deal", "kind")

    def passing(batches):
        now, held = None, Template()
        for b in batches:
            ids, urls, texts = [], [], []
            for r in (x for at in range(0, len(b), 256) for x in b.slice(at, 256).to_pylist()):
                if r["kind"] == 0:
                    now, held = r["host"], template(r["slots"], r["words"])
                    continue
                if r["host"] != now:
                    now, held = r["host"], Template()
                ids.append(r["page_id"])
                urls.append(r["url"])
                texts.append(main_text(Page(r["html"] or ""), held))
            yield rows(ids, urls, texts)

    return common.by_batch(both, passing, result)
